"""Running aggregates over an ordered log, in two steps so that one long key is many tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
            measures: dict[str, tuple[Callable, Column]]) -> DataFrame:
    """Exclusive running sum, min or max per key.

    ``bucket`` is a coarse, order-preserving column (the day of a timestamp). Buckets are
    aggregated first, what came before a bucket is carried in, and rows only run inside it.
    """
    keys = list(keys)
    per = df.groupBy(*keys, bucket).agg(*[fn(e).alias(f"_t_{n}") for n, (fn, e) in measures.items()])
    past = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*keys, bucket, *[fn(f"_t_{n}").over(past).alias(f"_c_{n}") for n, (fn, _) in measures.items()])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumns({f"_l_{n}": fn(e).over(inside) for n, (fn, e) in measures.items()}).join(
        carry, [*keys, bucket])
    for n, (fn, _) in measures.items():
        c, loc = F.col(f"_c_{n}"), F.col(f"_l_{n}")
        if fn is F.sum:
            both = F.coalesce(c, F.lit(0)) + F.coalesce(loc, F.lit(0))
        else:
            both = F.least(c, loc) if fn is F.min else F.greatest(c, loc)
        out = out.withColumn(n, both).drop(f"_c_{n}", f"_l_{n}")
    return out
