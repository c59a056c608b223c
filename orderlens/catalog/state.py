"""Carts, assignments and rejections folded from the event log.

Event types stand for the actions of a cart log: click = add, purchase = sold, error = not_sold, view = shown (which
leaves a cart as it is). The table has no type for the two remaining actions; signup stands for set_quantity,
or delete where the event id is odd. Every event is in the log.
"""

from pyspark.sql import functions as F

from ..operators import state as st
from ..plans import driver_tables as d
from .registry import cte, query

cte("v_log", """
SELECT *, CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'not_sold'
  WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'set_quantity' ELSE 'delete' END ELSE 'shown' END AS action
FROM v_events""")
cte("v_cart", """
SELECT * FROM (SELECT cart_item_id, cust_id, item_id, CAST(CASE WHEN setq IS NULL THEN adds ELSE setq + adds_after END AS INTEGER) AS quantity, unit_price, source, seller_id,
  added_at, coalesce(closing, 'in_cart') AS status, resolved_at FROM (
  SELECT cust_id, item_id, line_no, first(event_id ORDER BY ts, event_id) FILTER (action = 'add') AS cart_item_id,
    first(price ORDER BY ts, event_id) FILTER (action = 'add') AS unit_price, first(source ORDER BY ts, event_id) FILTER (action = 'add') AS source,
    first(seller_id ORDER BY ts, event_id) FILTER (action = 'add') AS seller_id, first(ts ORDER BY ts, event_id) FILTER (action = 'add') AS added_at,
    sum(quantity) FILTER (action = 'add') AS adds, last(quantity ORDER BY ts, event_id) FILTER (valid_set) AS setq,
    coalesce(sum(quantity) FILTER (action = 'add' AND (last_set_ts IS NULL OR ts > last_set_ts)), 0) AS adds_after,
    first(action) FILTER (action IN ('sold', 'not_sold', 'delete')) AS closing, first(ts) FILTER (action IN ('sold', 'not_sold', 'delete')) AS resolved_at
  FROM (SELECT *, max(CASE WHEN valid_set THEN ts END) OVER (PARTITION BY cust_id, item_id, line_no) AS last_set_ts FROM (
    SELECT *, action = 'set_quantity' AND ts > min(CASE WHEN action = 'add' THEN ts END) OVER (PARTITION BY cust_id, item_id, line_no) AS valid_set FROM (
      SELECT *, coalesce(sum(CASE WHEN action IN ('sold', 'not_sold', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY cust_id, item_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM v_log)))
  GROUP BY 1, 2, 3) WHERE cart_item_id IS NOT NULL) WHERE status <> 'delete' AND quantity > 0""")
cte("v_purchases", """
SELECT cart_item_id AS purchase_id, cust_id, item_id, quantity, unit_price, seller_id AS sold_by_seller_id, resolved_at AS sold_at, cart_item_id, source
FROM v_cart WHERE status = 'sold'""")
cte("v_changes", """
SELECT cust_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 END AS new_seller_id, ts, event_id FROM v_events WHERE event_type = 'signup'""")
cte("v_assign", """
SELECT event_id AS history_id, cust_id, previous_seller_id, new_seller_id, CASE WHEN previous_seller_id IS NULL THEN 'admin_assign'
  WHEN new_seller_id IS NULL THEN 'admin_unassign' ELSE 'admin_reassign' END AS change_reason, ts AS changed_at FROM (
  SELECT *, lag(new_seller_id) OVER (PARTITION BY cust_id ORDER BY ts, event_id) AS previous_seller_id FROM v_changes)
WHERE previous_seller_id IS DISTINCT FROM new_seller_id""")
cte("v_current", """
SELECT cust_id, s AS seller_id, a AS assigned_at FROM (SELECT cust_id, last(new_seller_id ORDER BY changed_at, history_id) AS s, max(changed_at) AS a FROM v_assign GROUP BY 1) WHERE s IS NOT NULL""")


def cart_log(events):
    changed = F.when(F.col("event_id") % 2 == 0, "set_quantity").otherwise("delete")
    action = (F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "purchase", "sold")
              .when(F.col("event_type") == "error", "not_sold").when(F.col("event_type") == "signup", changed).otherwise("shown"))
    return events.withColumn("action", action)


def cart(spark, sf):
    return st.cart_state(cart_log(d.event_log(spark, sf)))


def changes(spark, sf):
    return d.event_log(spark, sf).filter("event_type = 'signup'").select(
        "cust_id", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("event_id") % 7).cast("bigint").alias("new_seller_id"),
        "ts", "event_id")


@query("n1_cart_state", "SELECT * FROM v_cart")
def _(spark, sf):
    return cart(spark, sf)


@query("n2_checkout", "SELECT * FROM v_purchases")
def _(spark, sf):
    return st.checkout(cart(spark, sf))


@query("n3_assignment_history", "SELECT * FROM v_assign")
def _(spark, sf):
    return st.assignment_history(changes(spark, sf))


@query("n3_current_assignment", "SELECT * FROM v_current")
def _(spark, sf):
    return st.current_assignment(st.assignment_history(changes(spark, sf)))


@query("n3_deactivated_sellers", """
SELECT cust_id, seller_id AS previous_seller_id, CAST(NULL AS BIGINT) AS new_seller_id, 'seller_deactivated' AS change_reason FROM v_current WHERE seller_id IN (2, 5)""")
def _(spark, sf):
    current = st.current_assignment(st.assignment_history(changes(spark, sf)))
    gone = d.raw(spark, sf, "supplier").filter("s_suppkey IN (2, 5)").select(F.col("s_suppkey").alias("user_id"))
    return st.deactivate_sellers(current, gone)


def rejection_log(spark, sf):
    e = d.event_log(spark, sf).filter("event_type IN ('view', 'error')")
    return e.withColumn("kind", F.when(F.col("event_type") == "view", "shown").otherwise("rejected"))


# The stack in plain SQL: a rejection takes the last earlier shown event with as many rejections as shown events between them.
cte("v_rej0", "SELECT *, CASE WHEN event_type = 'view' THEN 'shown' ELSE 'rejected' END AS kind FROM v_events WHERE event_type IN ('view', 'error')")
cte("v_rejd", """
SELECT *, CASE WHEN kind = 'shown' THEN s - least(0, lo) + 1 ELSE s - least(0, lo) END AS depth FROM (
  SELECT *, coalesce(min(s_after) OVER (PARTITION BY cust_id, item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM (
    SELECT *, coalesce(sum(st) OVER (PARTITION BY cust_id, item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
      sum(st) OVER (PARTITION BY cust_id, item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_after
    FROM (SELECT *, CASE WHEN kind = 'shown' THEN 1 ELSE -1 END AS st FROM v_rej0)))""")
cte("v_rej1", """
SELECT CASE WHEN r.depth > 0 THEN m.event_id ELSE r.event_id END AS event_id, r.cust_id, r.item_id, CASE WHEN r.depth > 0 THEN m.source ELSE r.source END AS source,
  CASE WHEN r.depth > 0 THEN m.ts ELSE r.ts END AS shown_at, 'rejected' AS outcome, r.ts AS resolved_at, r.reason AS reason_code, CASE WHEN r.depth > 0 THEN 1 ELSE 0 END AS was_pending
FROM (SELECT a.*, (SELECT max(b.event_id) FROM v_rejd b WHERE b.kind = 'shown' AND b.cust_id = a.cust_id AND b.item_id = a.item_id AND b.depth = a.depth AND b.event_id < a.event_id) AS mid
  FROM v_rejd a WHERE kind = 'rejected') r LEFT JOIN v_rejd m ON m.event_id = r.mid""")
cte("v_outcomes", """
SELECT * FROM v_rej1 UNION ALL SELECT event_id, cust_id, item_id, source, ts, 'pending', NULL, NULL, 1 FROM v_rej0
WHERE kind = 'shown' AND event_id NOT IN (SELECT event_id FROM v_rej1)""")


@query("n4_rejection_resolution", "SELECT * FROM v_outcomes")
def _(spark, sf):
    return st.rejection_resolution(rejection_log(spark, sf))


@query("j6_distinct_cart_items", """
SELECT cust_id, item_id, row_number() OVER (PARTITION BY cust_id ORDER BY a, i, item_id) AS position FROM (
  SELECT cust_id, item_id, min(added_at) AS a, min(cart_item_id) AS i FROM v_cart WHERE status = 'in_cart' GROUP BY 1, 2)""")
def _(spark, sf):
    return st.distinct_cart_items(cart(spark, sf))
