"""Interleaving of sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source are put in the order of a hash of their ids and cut into blocks of about
``block_chars`` characters. A source with weight w has for its i-th block (from 0) the release time
floor(i / w) and the deadline ceil((i + 1) / w); the slots of the mixture go, earliest deadline first, to the
released blocks (ties by source name). As the weights add up to 1, every block gets a slot between its release
and its deadline, so at any time each source is less than one block away from its target.

Weights are whole parts of a cycle of ``cycle`` slots, which makes the schedule repeat: it is worked out once for
one cycle, a table of that fixed size, and a block's slot follows from its number. No document is
dropped or repeated; when a source ends, its later slots stay empty and the others keep their proportions.

Running sums are split: each source is dealt into ranges of the hash, summed within a range and across
ranges, so a source with a third of all rows is spread over many tasks. Null text counts as empty; null
sources are one source, named '' in the schedule; null ids sort first; rows repeated in full may swap
places. Without target weights each source weighs the square root of its characters. Sources that
``weights`` does not name get the least weight, one part of the cycle. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

RANGE_ROWS = 20_000


def parts_of_cycle(sizes: DataFrame, cycle: int) -> DataFrame:
    """source, parts: whole numbers, at least 1, that add up to ``cycle``; from source and weight."""
    every = Window.partitionBy(F.lit(0))  # a row for each source
    shared = (sizes.withColumn("spare", F.lit(cycle) - F.count("*").over(every))
              .withColumn("due", F.col("spare") * F.coalesce("weight", F.lit(0.0)) / F.greatest(F.sum("weight").over(every), F.lit(1e-300)))
              .withColumn("whole", F.floor("due"))
              .withColumn("over", F.col("spare") - F.sum("whole").over(every))
              .withColumn("rank", F.row_number().over(every.orderBy(F.desc(F.col("due") - F.col("whole")), "source"))))
    return shared.select("source", (F.col("whole") + 1 + (F.col("rank") <= F.col("over")).cast("int")).cast("int").alias("parts"))


def schedule(parts: DataFrame, cycle: int) -> DataFrame:
    """source, turn, at, parts: the slot of each source's turn within one cycle."""
    listed = parts.agg(F.sort_array(F.collect_list(F.struct("source", "parts"))).alias("s"))
    # done: turns taken by each source; picks: the source of each slot so far
    edf = f"""aggregate(sequence(0, {cycle - 1}),
        named_struct('done', transform(s, x -> 0), 'picks', cast(array() as array<int>)),
        (acc, t) -> transform(array(array_min(filter(transform(s, (x, i) -> named_struct(
              'deadline', cast(ceil((acc.done[i] + 1) * {cycle}L / x.parts) as long), 'i', i,
              'ready', floor(acc.done[i] * {cycle}L / x.parts) <= t)), c -> c.ready)).i),
            pick -> named_struct('done', transform(acc.done, (d, i) -> if(i = pick, d + 1, d)),
                                 'picks', concat(acc.picks, array(pick))))[0],
        acc -> acc.picks)"""
    slots = listed.filter(F.size("s") > 0).select("s", F.posexplode(F.expr(edf)).alias("at", "pick"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1
    return (slots.select(F.expr("s[pick].source").alias("source"), F.expr("s[pick].parts").alias("parts"), "at")
            .select("source", turn.alias("turn"), "at", "parts"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = 64_000, cycle: int = 720) -> DataFrame:
    """doc (the row), source, block, release, slot, deadline, block_offset for every row of ``docs``."""
    key = F.md5(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.coalesce("doc.source", F.lit("")).alias("source"), key.alias("key"),
        F.coalesce(F.length("doc.text"), F.lit(0)).cast("long").alias("size"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    facts = totals.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).head()
    cycle = max(cycle, 4 * facts.sources)
    digits = max(1, math.ceil(math.log(max(facts.n or 1, 1) / RANGE_ROWS + 1, 16)))
    named = (totals.select("source", F.sqrt("total").alias("weight")) if weights is None else
             totals.select("source").join(weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double")), "source", "left"))
    turns = F.broadcast(schedule(parts_of_cycle(named, cycle), cycle))  # as many rows as the cycle has slots
    ranged = rows.withColumn("range", F.substring("key", 1, digits))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
              .withColumn("earlier", F.coalesce(F.sum("in_range").over(across), F.lit(0))).select("source", "range", "earlier"))
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = (ranged.join(ranges, ["source", "range"]).withColumn("before", before)
              .withColumn("block", F.floor(F.col("before") / block_chars)))
    parts = turns.select("source", F.col("parts").alias("per_cycle")).distinct()
    placed = (placed.join(F.broadcast(parts), "source")
              .withColumn("turn", (F.col("block") % F.col("per_cycle")).cast("int"))
              .join(turns.drop("parts"), ["source", "turn"]))
    first = F.expr(f"cast(block div per_cycle as long) * {cycle}L")
    return placed.select(
        "doc", "source", "block",
        (first + F.floor(F.col("turn") * F.lit(cycle).cast("long") / F.col("per_cycle"))).alias("release"),
        (first + F.col("at")).alias("slot"),
        (first + F.ceil((F.col("turn") + 1) * F.lit(cycle).cast("long") / F.col("per_cycle"))).alias("deadline"),
        (F.col("before") % block_chars).alias("block_offset"), "key")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows themselves, sorted as the mixture runs."""
    return mixed.orderBy("slot", "block_offset", "key", "doc.doc_id").select("doc.*")
