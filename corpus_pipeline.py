"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows its predecessor kept and is written as Parquet before the next one reads it, so a lost
executor costs a stage's tasks and no more. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import minhash, mixing, packing, quality, secret_scan
from orderlens.llm.common import in_fold, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.3)."""
    labels = table(spark, sf_dir, "labels").filter(~in_fold("doc_id", 5, 0))
    model = quality.fit(docs, labels)
    rows = docs.select(F.struct("*").alias("doc"), model.score(F.col("text")).alias("score"))
    return rows.filter("score >= 0.3").select("doc.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; rows with a null id stay."""
    dropped = stage(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, in which they are written."""
    return mixing.in_order(mixing.mix(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids; sequence ids ascend by task as the mixture runs.

    Files come back in no order, so the rows are sorted again: their slots follow from the rows alone. The tasks of
    a sort are ranges of the mixture, numbered in its order, and packing takes a task's rows as they come.
    """
    return packing.pack(mixing.in_order(mixing.mix(docs)), packing.word_tokens)


STAGES = [("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup), ("secret_scans", secret_scans),
          ("source_mixing", source_mixing), ("sequence_packing", sequence_packing)]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
