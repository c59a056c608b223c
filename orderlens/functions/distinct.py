"""Several distinct counts beside other aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_distinct_counts(df: DataFrame, keys: Sequence[str], counts: Mapping[str, str], *aggregates: Column) -> DataFrame:
    """``aggregates`` per key, and for each name in ``counts`` the number of distinct values of its column.

    Several COUNT DISTINCT in one aggregate copy every row once per count. Here each is a grouping to
    (keys, value), which shrinks in the map-side combine, and a count of the groups. NULL keys are a group.
    """
    keys = list(keys)
    out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    for name, value in counts.items():
        pairs = df.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col(value).alias("_v")).distinct()
        if not keys:
            out = out.withColumn(name, pairs.agg(F.count("_v").alias("n")).scalar())
            continue
        own = [f"_{i}" for i in range(len(keys))]
        found = pairs.groupBy(*own).agg(F.count("_v").alias(name))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
        out = out.join(found, same).drop(*own)
    return out
