"""The stages one by one against what they are to do, and the whole pipeline."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import dedup
from tests.llm.test_documents import ROWS, brute_groups


def test_dedup_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, score double, node string")
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    kept = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    assert kept == sorted({k[0] for k in brute_groups(ROWS, 5) if k[3]})
    # the copy of document 1 goes, though nothing names it
    assert [r["text"] for r in out if r["doc_id"] is None] == ["alone here in the rows of a table"] and out[0].__fields__ == docs.columns


def test_dedup_stage_tells_rows_apart_not_ids(spark):
    alone = "one text that no other row of this table holds in any form"
    rows = [(5, "the first words here are about rain and wind in the hills"), (5, alone), (4, "the first words here are about rain and wind in the hills"), (None, alone.upper()), (5, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit("clash"))
    out = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert out == [(4, rows[0][1]), (5, alone)]


def test_language_stage_rejects_what_has_no_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123 !?", None, "s", 6)], table.schema)
    out = corpus_pipeline.language_id(spark, table.unionByName(junk), "")
    assert out.columns == table.columns and {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in table.select("doc_id").collect()}


def test_whole_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in dedup.near_duplicates(docs).where("kept").collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == kept
    bins = defaultdict(int)
    for p in pieces:
        bins[p["sequence_id"]] += p["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= sum(bins.values()) // 4096 + 2
