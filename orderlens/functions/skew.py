"""Joins on few or very uneven keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys that a join looks for as frequent, at most; a key above an even share of the tasks' rows is one of fewer
_TRACKED = 1000


def heavy_keys(rows: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Hashes ``_h`` of the keys that hold more rows than an even share of the tasks, and over how many tasks to deal each.

    One pass with a mergeable frequent-items summary of fixed size, so there is no shuffle of rows. Its counts are
    near enough: they decide how work is dealt, never a result. At most ``_TRACKED`` rows.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {_TRACKED}, {16 * _TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    salts = F.least(F.ceil(F.col("count") * tasks / F.col("n")), F.lit(tasks)).cast("int")
    return seen.select("n", F.inline("top")).filter(F.col("count") * tasks > F.col("n")).select(
        F.col("item").alias("_h"), salts.alias("_salts"))


def salted_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner",
                salts: int | None = None) -> DataFrame:
    """``rows`` joined with ``lookup``, frequent keys of ``rows`` dealt over several tasks.

    Only the lookup rows of such keys are repeated, as often as their share of the rows fills tasks; all others
    meet in one plain shuffle, each lookup row once. ``salts`` is the number of tasks to fill, that of a shuffle by default. A row's salt is a hash of ``by``. ``rows`` is read twice, so it
    should be a stored table.
    """
    heavy = F.broadcast(heavy_keys(rows, keys, salts))  # at most _TRACKED rows
    h = F.xxhash64(*keys).alias("_h")
    salted = rows.withColumn("_h", h).join(heavy, "_h", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int"), F.lit(0))).drop("_h", "_salts")
    every = lookup.withColumn("_h", h).join(heavy, "_h", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_h", "_salts")
    return salted.join(every, [*keys, "_salt"], how).drop("_salt")
