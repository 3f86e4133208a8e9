"""A cleaning pipeline over ``documents``: every stage calls one operator of ``lethewood.llm``.

A stage works on all rows that the one before it kept. All but the last return the columns of
the documents; secrets are cut out of the texts, and ``n_chars`` follows. The last one adds the
token ids. Null and empty texts pass the filters (of the empty ones, one stays); an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.llm import leak_search, secret_scan, sentencepiece, simhash_dedup, toxicity
from lethewood.llm.queries import PIECES
from lethewood.sources.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC_FROM = 0.3
# Documents are long rows: this many at a time go to Python, so that a batch stays at a few MB.
ARROW_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches ``TOXIC_FROM`` go."""
    _small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_toxicity"
    while score in map(str.lower, docs.columns):
        score += "_"
    scored = toxicity.score_documents(docs, model, score_col=score)
    return scored.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose fingerprints differ in at most two bits, or that
    are alike in 0.8 of their five-word shingles."""
    _small_batches(spark)
    return simhash_dedup.keep_one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _small_batches(spark)
    return leak_search.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark."""
    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts."""
    _small_batches(spark)
    return sentencepiece.encode(docs, PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", cut_secrets),
    ("sentencepiece", add_tokens),
]

# The fitted and hashed stages have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; what a stage keeps is written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
