"""Corpus preparation: language ID, near-dedup, secret scans, packing, one after the other over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import materialize, read_table
from leadloom.llm.dedup import near_duplicates
from leadloom.llm.langid import held_out, identify
from leadloom.llm.packing import pack_documents
from leadloom.llm.secret_scan import redact_secrets
from leadloom.names import free_names

#: A document goes when no language reaches this share of its words, or when it has no letter.
LEAST_LANGUAGE_SCORE = 0.3
#: Sets of row numbers up to this size (8 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; texts that are null or have no letter are rejected."""
    own = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    aside = dict(zip(own, free_names(docs.columns, *(f"own_{c}" for c in own)), strict=True))
    out = identify(docs.withColumnsRenamed(aside), ~held_out())
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the row of the smallest doc_id.

    Rows are told apart by a number written with them, not by doc_id: distinct texts that share a doc_id all stay,
    and of repeated rows one. Null doc_ids come after all others.
    """
    (row,) = free_names(docs.columns, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    number = rows.select(F.col(row).alias("row"), "doc_id", "text")
    verdict = near_duplicates(number.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    verdict = materialize(verdict, "verdict")
    groups = verdict.groupBy("group").count().where("count > 1").select("group")
    members = materialize(verdict.join(groups, "group").join(number.select("row", "doc_id"), "row"), "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = materialize(members.select(F.col("row").alias(row)).join(first.withColumnRenamed("row", row), row, "left_anti"), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row; spans whose value few owners hold are masked."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: No SQL states the learned language or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
