"""The corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage returns the columns that it was given, also those named like results
of its operator; names that begin with two underscores are the operators' own.
Null and empty texts pass all stages that judge words; a document's rows are
told apart by id and text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import cotraining, jaccard, packing, pii, superkmers
from fieldloom.llm.common import checkpoint_dir, table


def beside(docs: DataFrame, results: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's rows with docs' own columns, also those named like its results."""
    own = {c: f"__own_{c}" for c in docs.columns if c in results}
    return operator(docs.withColumnsRenamed(own)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return beside(docs, cotraining.RESULTS, lambda d: cotraining.classify(d, table(spark, sf_dir, "labels")).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the least id; five-word shingles and 0.8, while op3 has four words and 0.85."""
    return jaccard.without_near_copies(docs, percent=80, k=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = lambda d: superkmers.dedup(d).withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("bigint"))
    return beside(docs, superkmers.RESULTS, changed)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return beside(docs, pii.RESULTS, lambda d: pii.pseudonymise(d).withColumn("n_chars", F.length("text").cast("bigint")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("pii", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    from uuid import uuid4

    checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
