"""Documents may have columns with any names; the stages leave them as they are."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from lethewood.llm import secret_scan, simhash_dedup

from .helpers import docs, prose

NAMES = "row key secrets found_key text_hash text_size no_id id component _id _hash _size _no_id _secrets _toxicity".split()


def crowded(table):
    """``table`` with columns that operators may want for themselves, each holding its own number."""
    return table.select("*", *(F.lit(i).alias(name) for i, name in enumerate(NAMES)))


def numbers(row):
    return [row[name] for name in NAMES]


def test_one_of_each_group_keeps_all_columns(spark):
    rows = [(3, prose(1, 90)), (2, prose(1, 90)), (5, prose(2, 90)), (None, None)]
    kept = simhash_dedup.keep_one_of_each_group(crowded(docs(spark, rows))).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 2, 5]
    assert all(numbers(r) == list(range(len(NAMES))) for r in kept)


def test_redacting_keeps_all_columns(spark):
    rows = [(1, "use password=hunter2hunter2x now"), (2, "nothing here"), (None, None), (4, "call 0123456789ABCDEF")]
    table = crowded(docs(spark, rows))
    found = spark.createDataFrame([(1, "hunter2hunter2x", True), (4, "0123456789ABCDEF", False)], "doc_id BIGINT, value STRING, is_secret BOOLEAN")
    clean = secret_scan.redact(table, found)
    assert clean.columns == table.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert got[1].text == "use password=[SECRET] now"
    assert {i: got[i].text for i in (2, None, 4)} == {i: t for i, t in rows[1:]}
    assert all(numbers(r) == list(range(len(NAMES))) for r in got.values())


def test_toxicity_stage_keeps_all_columns(spark, data):
    table = crowded(spark.read.parquet(f"{data}/documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, table, data)
    assert kept.columns == table.columns
    rows = kept.collect()
    assert rows and all(numbers(r) == list(range(len(NAMES))) for r in rows)
