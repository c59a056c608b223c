"""Top-k, distributed ranks and exact quantiles that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .columns import half_up


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key in a total order.

    The ``rank <= k`` filter sits right on the window, so Spark prunes every partition
    to ``k`` rows per key before the shuffle and a hot key costs its task only
    ``k`` rows per input partition.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def _bins(df: DataFrame) -> int:
    """Bins of a value: several for each task of a shuffle, so that one bin is a fraction of a task."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bin_of(value: str, bounds: str, bins: int) -> Column:
    """Odd bins hold exactly one value (a boundary), even bins the values between two; found by halving steps.

    Both columns are bound once, as ``bounds`` may be a subquery whose every mention is planned again.
    """
    steps = ", ".join(str(1 << k) for k in reversed(range(int(bins).bit_length())))
    below = "(at, step) -> if(at + step <= size(s.b) and get(s.b, at + step - 1) < s.v, at + step, at)"
    place = f"aggregate(array({steps}), 0, {below}, at -> at * 2 + coalesce(cast(get(s.b, at) = s.v as int), 0))"
    return F.expr(f"get(transform(array(named_struct('v', {value}, 'b', {bounds})), s -> if(s.v is null, null, {place})), 0)")


def _bounds(df: DataFrame, value: str, bins: int) -> Column:
    points = ", ".join(f"{i / bins}D" for i in range(1, bins))
    sketch = f"percentile_approx({value}, array({points}), {bins * 50})"
    return df.agg(F.expr(f"array_distinct(coalesce({sketch}, cast(array() as array<double>)))")).scalar()


def _with_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """The rows with their value as ``_v`` and its bin, whose bounds are a scalar subquery over the same rows."""
    x = df.withColumn("_v", F.col(value).cast("double"))
    return x.withColumn("_b", _bounds(x, "_v", bins)).withColumn("_bin", _bin_of("_v", "_b", bins)).drop("_b")


def global_row_number(df: DataFrame, value: str, tie: str, out: str = "rn",
                      descending: bool = False, bins: int | None = None) -> DataFrame:
    """Exact ``row_number`` over the whole frame, without one task that sorts it all.

    Rows fall into bins of the value; a value too frequent for its bin has a bin
    of its own, which is cut further by the tie column. Only bin sizes (a bounded
    number of rows) are summed in one task.
    """
    bins = bins or _bins(df)
    v = F.col(value).cast("double")
    v = -v if descending else v
    x = df.withColumns({"_v": v, "_t": F.col(tie).cast("double")})
    x = x.withColumns({"_vb": _bounds(x, "_v", bins), "_tb": _bounds(x, "_t", bins)}).withColumn("_bin", _bin_of("_v", "_vb", bins))
    x = x.withColumn("_sub", F.when(F.col("_bin") % 2 == 1, _bin_of("_t", "_tb", bins)).otherwise(F.lit(0))).drop("_vb", "_tb", "_t")
    sizes = x.groupBy("_bin", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bin", "_sub").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_bin", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy("_bin", "_sub").orderBy("_v", tie))
    return (
        x.withColumn("_local", local)
        .join(starts, [x["_bin"].eqNullSafe(starts["_bin"]), x["_sub"].eqNullSafe(starts["_sub"])])
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_v", "_bin", "_sub", "_start", "_local")
    )


def with_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), by: Sequence[str] | None = None, bins: int | None = None) -> DataFrame:
    """The rows with how many of their key's values are smaller, equal, and there in all (n_smaller, n_equal, n_total).

    Rows are shuffled once, by the bin of their value. A value frequent enough to be a boundary has a bin of its own,
    whose size is all that its rows need, so they are dealt anywhere by a hash of ``by``. Only sizes of bins are summed
    per key, and there is no table of values to join. NULL values get NULLs. ``df`` is read three times: store it.
    """
    bins, keys = bins or _bins(df), list(keys)
    x = _with_bins(df, value, bins)
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sizes = x.filter("_bin IS NOT NULL").groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_s"), "_size",
        F.coalesce(F.sum("_size").over(wk.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_size").over(wk).alias("n_total"))
    alone = F.col("_bin").isNull() | (F.col("_bin") % 2 == 1)
    deal = F.when(alone, F.pmod(F.xxhash64(*(by or df.columns)), F.lit(4 * bins))).otherwise(F.lit(-1).cast("long"))
    inside = W.partitionBy(*keys, "_bin", "_deal").orderBy("_v")
    x = x.withColumn("_deal", deal).withColumns({
        "_rank": F.rank().over(inside), "_same": F.count(F.lit(1)).over(inside.rangeBetween(W.currentRow, W.currentRow))})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_s")]
    out = x.join(starts if keys else F.broadcast(starts), same, "left")  # without keys at most 2 * bins rows
    return out.withColumns({"n_smaller": F.col("_start") + F.when(alone, 0).otherwise(F.col("_rank") - 1),
                            "n_equal": F.when(alone, F.col("_size")).otherwise(F.col("_same"))}).select(
        *df.columns, "n_smaller", "n_equal", "n_total")


def average_rank_pct(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "pct") -> DataFrame:
    """Average-rank percentile: (rank + (ties - 1) / 2) / n."""
    pct = (F.col("n_smaller") + (F.col("n_equal") + 1) / 2) / F.col("n_total")
    return with_ranks(df, value, keys).withColumn(out, pct).drop("n_smaller", "n_equal", "n_total")


def min_ranks(df: DataFrame, ranks: dict[str, str], descending: bool = True) -> DataFrame:
    """Competition ranks (1, 2, 2, 4) over the whole frame, value column -> rank column.

    ``df`` is read several times per value, so it should be a stored table.
    """
    out = df
    for value, name in ranks.items():
        r = (F.col("n_total") - F.col("n_smaller") - F.col("n_equal") + 1 if descending
             else F.col("n_smaller") + 1)
        out = with_ranks(out, value).withColumn(name, r).drop("n_smaller", "n_equal", "n_total")
    return out


def quantile_score(df: DataFrame, value: str, tie: str, out: str, bins: int = 5) -> DataFrame:
    """1..5 by equal slices of the first-come rank: greatest(1, ceil((r-1)*bins/(n-1)))."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = global_row_number(df, value, tie, "_r")
    slot = F.ceil((F.col("_r") - 1) * bins / F.greatest(n - 1, F.lit(1)))
    return ranked.withColumn(out, F.greatest(F.lit(1), slot).cast("int")).drop("_r")


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: Sequence[str] = (),
                    digits: int | None = None, bins: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, by selection in a histogram.

    Rows are counted per bin of the value, the bins that hold the wanted positions are found from the counts, and only
    their rows are grouped to values and put in order; a bin of one value needs none. So all but one bin in
    many is read and counted, never shuffled. ``df`` is read several times: store it.
    """
    bins, keys = bins or _bins(df), list(keys)
    own, other = [f"`{k}`" for k in keys], [f"_k{i}" for i in range(len(keys))]
    renamed = [f"{k} AS {o}" for k, o in zip(own, other)]
    x = _with_bins(df.filter(F.col(value).isNotNull()), value, bins)
    by = f"PARTITION BY {', '.join(own) or '0'}"
    starts = x.groupBy(*keys, "_bin").agg(F.expr("count(1) AS _size"), F.expr("max(if(_bin % 2 = 1, _v, null)) AS _one")).selectExpr(
        *own, "_bin", "_size", "_one", f"sum(_size) OVER ({by} ORDER BY _bin) - _size AS _from", f"sum(_size) OVER ({by}) AS _total")
    places = ", ".join(f"named_struct('_q', '{name}', '_p', {float(q)!r}D)" for name, q in qs.items())
    wanted = starts.selectExpr("*", f"inline(array({places}))").selectExpr(
        *renamed, "_bin AS _s", "_one", "_from AS _f", "_size", "_q", "floor(_p * (_total - 1)) AS _low", "ceil(_p * (_total - 1)) AS _high",
        "_p * (_total - 1) - floor(_p * (_total - 1)) AS _frac").filter(
        "(_f <= _low AND _low < _f + _size) OR (_f <= _high AND _high < _f + _size)")
    same = F.expr(" AND ".join([*[f"{k} <=> {o}" for k, o in zip(own, other)], "_bin = _s"]))
    # values of the chosen even bins with their counts; an odd bin is one value
    inner = wanted.filter("_one IS NULL").select(*other, "_s", "_f").distinct()
    counts = x.select(*keys, "_bin", "_v").join(inner, same).groupBy(*keys, "_bin", "_f", "_v").agg(F.expr("count(1) AS _n"))
    running = f"sum(_n) OVER (PARTITION BY {', '.join([*own, '_bin'])} ORDER BY _v)"
    values = counts.selectExpr(*own, "_bin", "_v", f"_f + {running} - _n AS _first", f"_f + {running} AS _end").unionByName(
        starts.filter("_one IS NOT NULL").selectExpr(*own, "_bin", "_one AS _v", "_from AS _first", "_from + _size AS _end"))
    at = lambda place: f"max(if(_first <= {place} AND {place} < _end, _v, null))"
    found = values.join(wanted.select(*other, "_s", "_q", "_low", "_high", "_frac"), same).groupBy(*keys, "_q").agg(
        F.expr(f"{at('_low')} AS lo"), F.expr(f"{at('_high')} AS hi"), F.expr("max(_frac) AS frac"))
    out = F.expr("lo + (hi - lo) * frac")
    found = found.select(*keys, "_q", (half_up(out, digits) if digits is not None else out).alias("_out"))
    aggs = [F.expr(f"max(if(_q = '{name}', _out, null)) AS `{name}`") for name in qs]
    return found.groupBy(*keys).agg(*aggs) if keys else found.agg(*aggs)


def quantiles(df: DataFrame, measures: dict[str, tuple[str, float]], keys: Sequence[str],
              digits: int = 4, limit: int = 1_000_000) -> DataFrame:
    """Exact quantiles of several columns per key: name -> (column, q).

    The built-in aggregate buffers the values of one key in one task, so keys with more than ``limit`` rows leave it
    for the histogram; both give the same values. ``df`` should be a stored table: its key sizes are checked first, as
    a histogram of every column costs more passes than a table without such keys should pay.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    def built_in(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(*[
            half_up(F.percentile(F.col(c).cast("double"), F.lit(q)), digits).alias(n)
            for n, (c, q) in measures.items()])

    if not sizes.head(1):
        return built_in(df)
    hot = df.join(sizes, same, "left_semi")
    out = hot.select(*keys).distinct()
    for column in {c: None for c, _ in measures.values()}:
        names = {n: q for n, (c, q) in measures.items() if c == column}
        found = exact_quantiles(hot.select(*keys, column), column, names, keys, digits)
        own = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names)
        out = out.join(own, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return built_in(df.join(sizes, same, "left_anti")).unionByName(out)
