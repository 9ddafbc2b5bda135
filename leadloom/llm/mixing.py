"""Mixing sources to target weights by capped water-filling. DataFrame and SQL functions only.

The weights share a budget of words. A source whose share passes its cap is clamped there, and what it leaves goes to
the others by weight, until none is above. Sources stand by the level (cap by weight) at which they are clamped, so
one running sum over that order tells who is clamped, and the level of the rest follows.

A source's documents are then taken a whole number of times, and a seeded part of them once more: documents stand in
the order of a hash and are taken until the target is met; the last one is taken in part. Sums over stretches of the
hash tell in which stretch that happens, so only this stretch of each source is ever sorted.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import ordinals, running_sums
from .common import materialize, read_table

#: Fixed by the contract of the mix: words, weights of the sources in turn, budget in per cent of all words, greatest repetition.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET_PER_CENT, MAX_EPOCHS = (3, 1, 2), 150, 2
SEED = "mix-1"
#: Hex digits of the hash that name a stretch: 16 ** 3 of them in each source.
STRETCH_DIGITS = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_per_cent: int = BUDGET_PER_CENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds weight and target (double) to (source, source_size): capped water-filling.

    Sources stand by code point, null last, and take the weights in turn. A source is clamped at its cap, max_epochs
    times its size, where filling every source up to the level of this one needs no more than the budget. Where the
    budget passes all caps, each has its cap. Targets are quotients of integers, rounded once.
    """
    table = F.array(*(F.lit(w).cast("long") for w in weights))
    placed = ordinals(sources, [F.asc_nulls_last("source")])
    placed = placed.withColumn("weight", F.get(table, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")))
    placed = placed.withColumn("cap", F.col("source_size") * max_epochs).withColumn("level", F.expr(f"cap * {lcm(*weights)}L div weight"))
    placed = materialize(running_sums(placed, [F.asc("level"), F.asc_nulls_last("source")], {"caps": F.col("cap"), "weights": F.col("weight")}), "levels")
    whole = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    budget = whole["words"] * budget_per_cent  # in hundredths of words
    wide = lambda c: f"cast({c} AS decimal(38, 0))"
    clamped = F.expr(f"({budget} - 100 * {wide('caps - cap')}) * weight >= 100 * {wide('cap')} * ({whole['weights']} - weights + weight)")
    placed = placed.withColumn("clamped", clamped)
    rest = placed.agg(F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))), F.lit(0)).alias("caps"), F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)).alias("weights")).first()
    share = (F.lit(budget - 100 * rest["caps"]) * F.col("weight")).cast("double") / F.lit(float(100 * max(rest["weights"], 1)))
    return placed.select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, budget_per_cent: int = BUDGET_PER_CENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source, repeats.

    size counts the words of the whole text, 0 where it is null or blank. target is the source's; taken is the words
    that the mix takes of the document: `repeats` times all of it, and at most once more a part. A source's taken words
    are its target, rounded to a whole word. The order of documents follows from the seed and doc_id, or the text where
    doc_id is null, and from nothing else: reruns agree, and repeated rows, equal in their place, get the same in any
    order. Null sources are one source, apart from the empty one. Sources without words have target 0. Further columns are ignored.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("mark"))
    sized = materialize(sized.withColumn("stretch", F.substring("mark", 1, STRETCH_DIGITS)), "sized")

    stretches = materialize(sized.groupBy("source", "stretch").agg(F.sum("size").alias("words")), "stretches")
    targets = source_targets(stretches.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_per_cent, max_epochs)
    plan = targets.withColumn("wanted", F.floor(F.col("target") + 0.5))
    plan = plan.withColumn("repeats", F.expr("IF(source_size = 0, 0L, wanted div source_size)")).withColumn("extra", F.expr("wanted - repeats * source_size"))
    plan = materialize(plan, "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0))
    placed = stretches.withColumn("so_far", so_far)
    edges = placed.join(plan, same(placed, plan)).where("so_far > extra AND so_far - words <= extra AND extra > 0")
    edges = edges.groupBy(placed["source"].alias("edge_source")).agg(F.min("stretch").alias("edge"), F.min(F.col("extra") - F.col("so_far") + F.col("words")).alias("room"))
    plan = materialize(plan.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"), "plan")

    joined = sized.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at_edge = joined.where("stretch = edge").withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - before)))
    others = joined.where("edge IS NULL OR stretch <> edge").withColumn("more", F.expr("IF(stretch < edge, size, 0L)"))
    out = others.unionByName(at_edge)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats") + F.col("more")).alias("taken"), "source", "repeats")


def op12_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source),
rounds(r, level) AS (
  SELECT 0, sum(source_size) * {BUDGET_PER_CENT / 100} / sum(w) FROM s
  UNION ALL
  SELECT r + 1, (SELECT (sum(source_size) * {BUDGET_PER_CENT / 100} - coalesce(sum({MAX_EPOCHS} * source_size) FILTER (WHERE {MAX_EPOCHS} * source_size <= w * level), 0)) / sum(w) FILTER (WHERE {MAX_EPOCHS} * source_size > w * level) FROM s)
  FROM rounds WHERE r < 200),
top AS (SELECT max(level) AS level FROM rounds),
c AS (SELECT s.*, {MAX_EPOCHS} * source_size AS cap, {MAX_EPOCHS} * source_size <= w * level AS clamped FROM s, top),
t AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE)
  ELSE (sum(source_size) OVER () * {BUDGET_PER_CENT / 100} - coalesce(sum(cap) FILTER (WHERE clamped) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT clamped) OVER () END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS repeats FROM t),
x AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - repeats * source_size AS extra FROM p),
o AS (SELECT d.*, source_size, target, repeats, extra, sum(size) OVER (PARTITION BY d.source ORDER BY mark, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(size * repeats + greatest(0, least(size, extra - before)) AS BIGINT) AS taken, source, CAST(repeats AS BIGINT) AS repeats FROM o
"""
