"""From documents to training sequences: toxicity filter, near-dedup, decontamination, PII redaction, packing.

Every stage works on all that the one before it kept, and its decisions take effect: toxic documents, copies and contaminated
documents go, personal data is replaced in the texts, and what is left is packed. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from derlem.llm import decontaminate, packing, pii, simhash, toxicity
from derlem.llm.common import durable, release, table, written


#: Documents in an Arrow batch: texts are long, and each task and its Python worker hold a batch in several buffers.
BATCH = 1000


def stage(f):
    """A stage of this pipeline: its session sends documents to Python in small batches."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select(*packing.COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Compression lengths, redaction by learnt patterns and packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, step in STAGES:
        docs = durable(step(spark, docs, sf_dir), name)
        release(spark, mark)  # what the stage and the one before it wrote, but its result
    return docs
