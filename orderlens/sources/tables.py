"""Scans, column adoption, load shaping and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip, resolve_column
from ..functions.ranking import first_per_key


def scan_sharded(spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet", schema=None) -> DataFrame:
    """All shard files or folders as one logical table."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def tag_fiscal_year(sources: Mapping[str, DataFrame], column: str = "fiscal_year") -> DataFrame:
    """One frame per fiscal year, tagged with its label and put together."""
    tagged = [df.withColumn(column, F.lit(label)) for label, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_columns(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def drop_columns(df: DataFrame, drop: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in drop if c in df.columns])


def adopt_columns(df: DataFrame, wanted: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Target column -> (candidate source names, type); missing ones become typed NULLs."""
    return df.select(*[resolve_column(df, names, dtype).cast(dtype).alias(target)
                       for target, (names, dtype) in wanted.items()])


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None,
                 mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Snappy Parquet, range-partitioned and sorted by key so that row groups prune."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def csv_export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str], batch: int = 10_000) -> None:
    """Optional sink of shaped rows into a serving database."""
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=dict(properties))


def shape_customers(customers: DataFrame, name_length: int = 200, code_length: int = 50) -> DataFrame:
    shaped = customers.filter(F.col("cust_id").isNotNull()).select(
        F.col("cust_id").cast("bigint").alias("cust_id"),
        F.substring(F.trim("cust_name"), 1, name_length).alias("customer_name"),
        F.substring("specialty", 1, code_length).alias("specialty_code"),
        F.substring("market", 1, code_length).alias("market_code"))
    return first_per_key(shaped, ["cust_id"], ["customer_name", "specialty_code", "market_code"])


def shape_products(items: DataFrame, description_length: int = 500, price_cap: float = 99_999.99) -> DataFrame:
    text = F.substring(F.trim("item_dsc"), 1, description_length)
    shaped = items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.when(text != "", text).alias("description"),
        F.substring("family", 1, 100).alias("family"), F.substring("category", 1, 100).alias("category"),
        F.round(clip("list_price", 0.0, price_cap), 2).alias("unit_price"),
        F.coalesce("is_private_brand", F.lit(0)).alias("is_private_brand"))
    return first_per_key(shaped, ["item_id"], ["description", "family", "category", "unit_price"])
