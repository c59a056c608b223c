"""Spark session defaults and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "orderlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_STAGE: dict[str, str] = {}
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_cleaners: dict[str, list] = {}  # application -> executions under way, and the setting to go back to


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir`` when it is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGE:
        _LOCAL_STAGE[app] = tempfile.mkdtemp(prefix="orderlens-stage-")
    return _LOCAL_STAGE[app]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files as they end.

    Otherwise the files stay until the driver happens to collect its garbage, beside all that later tables shuffle. A
    table that is written needs them no longer; a query that is run again makes its own.
    """
    app = spark.sparkContext.applicationId
    with _cleaning:
        state = _cleaners.setdefault(app, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(_SHUFFLE_CLEANUP, None)
            spark.conf.set(_SHUFFLE_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _cleaning:
            state[0] -= 1
            if not state[0] and state[1] is None:
                spark.conf.unset(_SHUFFLE_CLEANUP)
            elif not state[0]:
                spark.conf.set(_SHUFFLE_CLEANUP, state[1])


def stage_observed(df: DataFrame, name: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """``stage``, with aggregates of the rows that are taken while they are written, so checks of the table need no scan."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    table = stage(df.observe(seen, *[value.alias(key) for key, value in metrics.items()]), name)
    return table, seen.get


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The copy cuts the lineage, survives the loss of executors, keeps column pruning
    and pushdown, and gives Catalyst real sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_parts(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """One table of several frames, written one after the other, so only one of them has its shuffle files on disk."""
    spark, root = parts[0].sparkSession, f"{stage_root(parts[0].sparkSession)}/{name}-{uuid.uuid4().hex}"
    paths = [f"{root}/{i}" for i in range(len(parts))]
    for df, path in zip(parts, paths):
        with shuffles_dropped(spark):
            df.write.parquet(path)
    return spark.read.schema(parts[0].schema).parquet(*paths)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int, order: Sequence[str] = (), **options: str) -> DataFrame:
    """``stage``, with the rows of a key in one of ``buckets`` files, each sorted by ``order``.

    Groups, windows and joins on the key need no shuffle of the table. Bucketed files are read through a table of the
    catalogue; its entry goes as soon as the plan has it, so none is left there, while the files stay.
    """
    spark = df.sparkSession
    entry = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    if order:
        writer = writer.sortBy(*order)
    with shuffles_dropped(spark):
        writer.options(**options).option("path", f"{stage_root(spark)}/{entry}").saveAsTable(entry, format="parquet")
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table
