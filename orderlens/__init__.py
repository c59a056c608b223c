"""Order-line analytics and recommendations for business-to-business sales, on Spark."""
