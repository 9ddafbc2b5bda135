"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments, each with its own index. Round r looks up, for every segment, the values at distance
exactly r from the query's. After it every code within m * (r + 1) - 1 of the query has been met, m being the number of
segments: so a query is done as soon as its k-th verified distance is within that radius, and only the others go on. A
pair is verified once, at the segment and radius where it is first met.

Segments have 16 bits at every number of codes. Four of them cover distance 23 with 27,540 probes a query, which meet 0.42 of
random codes; three of 21 and 22 bits would cover it with 677,480 probes that meet 0.26 of them. Random codes of 64
bits have no near neighbours; codes that do end in the first rounds, at 68 to 548 probes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partition_count, read_table

SEGMENT_BITS = 16
#: Shares into which the ids of one code are dealt, to find its smallest ids without one task reading all.
SHARES = (64, 8, 1)


def _segments(bits: int) -> list[str]:
    return [f"s{i}" for i in range(bits // SEGMENT_BITS)]


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str, bits: int) -> DataFrame:
    """(id, s0, s1, ...): bit i of the code is set where component i is above 0.

    Without null ids and vectors that are null, not `bits` long, or hold a null or NaN.
    """
    v = F.col(vector_column)
    usable = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) == bits) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    width = SEGMENT_BITS
    parts = [reduce(lambda a, b: a + b, [(v[i * width + j] > 0).cast("int") * (1 << j) for j in range(width)]).alias(f"s{i}") for i in range(bits // width)]
    return vectors.where(usable).select(F.col(id_column).cast("long").alias("id"), *parts)


def _smallest_ids(codes: DataFrame, segments: list[str], keep: int) -> DataFrame:
    """Each code with its `keep` smallest ids: no result can need more of them. Repeated ids count once."""
    rows = codes.select("id", *segments)
    for share in SHARES:
        place = F.dense_rank().over(Window.partitionBy(*segments, "__share").orderBy("id"))
        rows = rows.withColumn("__share", F.pmod(F.xxhash64("id"), F.lit(share))).withColumn("__n", place).where(F.col("__n") <= keep).select("id", *segments)
    return rows.groupBy(*segments).agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("n", F.size("ids")).withColumn("first", F.col("ids")[0])


def _distance(x: str, y: str, segment: str) -> Column:
    return F.bit_count(F.col(f"{x}.{segment}").bitwiseXOR(F.col(f"{y}.{segment}")))


def _masks(radius: int) -> Column:
    """All values of a segment with `radius` bits set."""
    values = ",".join(str(sum(1 << b for b in c)) for c in combinations(range(SEGMENT_BITS), radius))
    return F.split(F.lit(values), ",").cast("array<bigint>")


def _rounds(asked: DataFrame, index: DataFrame, segments: list[str], need: int) -> DataFrame:
    """(qid, cid, first, n, d): the nearest codes of each query, by rounds until every query is done."""
    values = [F.col(s).cast("long") for s in segments]
    m = len(values)
    keyed = lambda df: df.select("*", F.posexplode(F.array(*values)).alias("j", "value"))
    posted = materialize(keyed(index.select("cid", "first", "n", *segments)), "posted")
    active, best = asked, None
    finished: list[DataFrame] = []
    by_distance = Window.partitionBy("qid").orderBy("d", "first")
    each = [_distance("p", "x", s) for s in segments]
    for radius in range(SEGMENT_BITS + 1):
        # Dealt over all tasks before a query becomes thousands of probes.
        probes = keyed(active.repartition(partition_count(asked.sparkSession), "qid")).withColumn("mask", F.explode(_masks(radius)))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
        # First met here: no segment is nearer than `radius`, and none before this one is as near.
        fresh = reduce(lambda a, b: a & b, [(d > radius) | ((d == radius) & (F.col("p.j") <= i)) for i, d in enumerate(each)])
        # Spark estimates the probes as if they were not exploded, and would broadcast them: always a shuffle.
        met = probes.hint("merge").alias("p").join(posted.alias("x"), (F.col("p.j") == F.col("x.j")) & (F.col("p.value") == F.col("x.value")) & fresh)
        met = met.select("p.qid", "x.cid", "x.first", "x.n", reduce(lambda a, b: a + b, each).alias("d"))
        both = met if best is None else met.unionByName(best)
        ranked = both.withColumn("r", F.row_number().over(by_distance)).where(F.col("r") <= need).drop("r")
        covered = m * (radius + 1) - 1
        enough = F.sum(F.when(F.col("d") <= covered, F.col("n")).otherwise(0)).over(Window.partitionBy("qid")) >= need
        state = materialize(ranked.withColumn("done", enough if radius < SEGMENT_BITS else F.lit(True)), f"round{radius}")
        finished.append(state.where("done").drop("done"))
        best = state.where("not done").drop("done")
        active = materialize(active.join(state.where("done").select("qid").distinct(), "qid", "left_anti"), f"active{radius}")
        if active.limit(1).count() == 0:
            break
    return reduce(DataFrame.unionByName, finished)


def exact_nearest(queries: DataFrame, codes: DataFrame, bits: int, k: int = 20) -> DataFrame:
    """The `k` codes nearest by Hamming distance: query_id, rank (from 1), vec_id, distance. Exact.

    Both inputs are (id, s0, ...) from sign_codes. A query's own id is no candidate. Ties go to the smaller vec_id;
    fewer candidates give fewer rows; no codes give none. Equal codes are searched once. An id that repeats with
    one code counts once; with several codes, it counts at each of them.
    """
    segments = _segments(bits)
    need = k + 1  # the query itself is among the ids
    index = materialize(_smallest_ids(codes, segments, need).withColumn("cid", F.monotonically_increasing_id()), "codes")
    asked = materialize(queries.select(*segments).distinct().withColumn("qid", F.monotonically_increasing_id()), "asked")
    found = _rounds(asked, index, segments, need)
    # The ids of each query code's nearest codes: at most k + 1 codes of at most k + 1 ids each.
    ids = found.join(index.select("cid", "ids"), "cid").groupBy("qid").agg(F.collect_list(F.struct("d", "ids")).alias("near"))
    pairs = F.array_sort(F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("id"))))))
    nearest = materialize(ids.select("qid", F.slice(pairs, 1, need).alias("near")).join(asked, "qid").drop("qid"), "nearest")
    rows = queries.distinct().join(nearest, segments)
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return rows.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").cast("int").alias("distance"))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return exact_nearest(codes.where("id % 20 = 0"), codes, 64)


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] > 0 AS INT)) AS b FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.b[i] - x.b[i]))) AS INT) AS distance
  FROM c q, c x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 20
"""
