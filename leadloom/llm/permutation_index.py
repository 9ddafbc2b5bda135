"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots from near to far, and posted in the inverted file of its nearest
pivot. A query reads the files of its own nearest pivots. What it meets there is ranked by the footrule distance
between the two orders, and the best of that ranking are reranked by the exact inner product. Orders are taken after
one more component that gives all index vectors one length, so that the largest inner product is the smallest angle.

The index is dealt into shelves by hash, each with a slice of every file. A block of queries meets a shelf in one
task, which reads the shelf's files one after another and keeps only each query's best of the footrule ranking. So a
task holds one block of queries and one batch of the stream, and a query leaves `k` rows a shelf, however long its
files are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partition_count, read_table

#: Pivots, and how many times as many vectors the sample holds that they come from; every order holds all of them.
PIVOTS, SAMPLE = 256, 8
#: Share of the files that a query reads. Vectors without clusters need this much; clustered ones far less.
READ_SHARE = 0.72
#: Slices of the index at least, and vectors of a slice on average at most; queries of a block.
SHELVES, SHELF_ROWS, BLOCK_QUERIES = 16, 4_000_000, 32_768
#: Vectors that a query reranks by the exact inner product, dealt over the shelves.
RERANK = 1024
#: Cells of a distance table that a worker fills at a time.
CELLS = 4_000_000

_PLACED = "id long, v array<double>, file int, places binary"
_FAR = np.int32(2**30)


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): v as doubles; without null ids and vectors that are null, empty, zero or hold a null or a non-finite value."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col(id_column).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return vectors.where(usable).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def smallest_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors the `keep` with the smallest ids: ties go to these, so no result can need more. Repeated rows count once."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    return vectors.withColumn("__n", place).where(F.col("__n") <= keep).drop("__n").distinct()


def levelled(vectors: np.ndarray, longest: float) -> np.ndarray:
    """With one more component, after which all have the length `longest`."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def choose_pivots(vectors: DataFrame, n: int, longest: float, rows: int) -> np.ndarray:
    """`n` distinct vectors at most, levelled and of unit length, far from one another.

    From a sample of SAMPLE * n, the smallest by hash of the vector, each pivot is the vector that is farthest from
    those before it: so a group of near copies does not take many. Of `rows` vectors most are left out by their hash
    before any is sorted, so that few reach the driver however many tasks there are.
    """
    want = SAMPLE * n
    hashed = vectors.select("v", F.xxhash64("v", F.lit(17)).alias("h"))
    smallest = lambda df: df.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(want).collect()
    bound = -(2**63) + 2**64 * 4 * want // max(rows, 4 * want)
    some = smallest(hashed.where(F.col("h") < F.lit(bound))) if rows > 4 * want else []
    if len(some) < want:
        some = smallest(hashed)
    out = levelled(np.array([r["v"] for r in some]), longest)
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    chosen, nearest_one = [0], out @ out[0]
    while len(chosen) < min(n, len(out)):
        chosen.append(int(np.where(np.isin(np.arange(len(out)), chosen), np.inf, nearest_one).argmin()))
        nearest_one = np.maximum(nearest_one, out @ out[chosen[-1]])
    return out[chosen]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(pivots, longest: float | None):
    """Adds the nearest pivot and the place of every pivot in the order; ties go to the lower pivot.

    Index vectors are levelled, queries (longest None) get a 0 as their last component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1))
            v = levelled(v, longest) if longest is not None else np.pad(v, ((0, 0), (0, 1)))
            order = np.argsort(-(v @ pivots.value.T), axis=1, kind="stable")
            places = np.empty(order.shape, "<u2")
            np.put_along_axis(places, order, np.arange(order.shape[1], dtype="<u2")[None, :], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), pa.array([p.tobytes() for p in places], pa.binary())], ["id", "v", "file", "places"])

    return run


def footrule(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Footrule distance of every query to every row; both hold a column of places for each pivot."""
    out = np.zeros((queries.shape[1], rows.shape[1]), np.int32)
    part = np.empty(out.shape, np.int16)
    for one, two in zip(queries, rows, strict=True):
        np.subtract(one[:, None], two[None, :], out=part)
        out += np.abs(part, out=part)
    return out


class Shelf:
    """One block of queries and the best they have met so far on one shelf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, read: int, keep: int):
        self.ids, self.vectors, self.read, self.keep = ids, vectors, read, keep
        self.places = np.ascontiguousarray(places.T)
        shape = (len(ids), keep)
        self.far, self.found, self.score = np.full(shape, _FAR), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -np.inf)

    def meet(self, ids: np.ndarray, files: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> None:
        """Rank a batch of rows that is sorted by file."""
        step = max(1, CELLS // len(ids))
        cuts = np.flatnonzero(np.diff(files, prepend=files[0] - 1, append=files[-1] + 1))
        places = np.ascontiguousarray(places.T)
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            own = np.ascontiguousarray(self.places[:, part])
            far = np.full((own.shape[1], len(ids)), _FAR)
            for start, end in zip(cuts, cuts[1:], strict=False):
                readers = np.flatnonzero(own[files[start]] < self.read)
                width = max(1, 65_536 // (end - start))
                for r in range(0, len(readers), width):
                    some = readers[r : r + width]
                    far[some, start:end] = footrule(own[:, some], places[:, start:end])
            far[self.ids[part][:, None] == ids[None, :]] = _FAR
            self._merge(at, far, ids, vectors)

    def _merge(self, at: int, far: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        many = min(self.keep, len(ids))
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        pick = np.argpartition(far.astype(np.int64) * len(ids) + rank, many - 1, axis=1)[:, :many]
        part = slice(at, at + len(far))
        new_far, new_ids = np.take_along_axis(far, pick, axis=1), ids[pick]
        all_far, all_ids = np.concatenate([self.far[part], new_far], axis=1), np.concatenate([self.found[part], new_ids], axis=1)
        all_score = np.concatenate([self.score[part], np.full(new_far.shape, -np.inf)], axis=1)
        best = np.lexsort((all_ids, all_far), axis=1)[:, : self.keep]
        self.far[part], self.found[part], score = (np.take_along_axis(x, best, axis=1) for x in (all_far, all_ids, all_score))
        q, slot = np.nonzero((best >= self.keep) & (self.far[part] < _FAR))  # what this batch brought
        row = pick[q, best[q, slot] - self.keep]
        for i in range(0, len(q), 50_000):
            some = slice(i, i + 50_000)
            score[q[some], slot[some]] = (self.vectors[at + q[some]] * vectors[row[some]]).sum(axis=1)
        self.score[part] = score

    def best(self, k: int) -> pa.RecordBatch:
        """The `k` of each query with the largest inner product, ties to the smaller id; an id counts once."""
        order = np.lexsort((self.found, -self.score), axis=1)
        found, score = np.take_along_axis(self.found, order, axis=1), np.take_along_axis(self.score, order, axis=1)
        real = (score > -np.inf) & (np.diff(found, axis=1, prepend=-1) != 0)
        real &= np.cumsum(real, axis=1) <= k
        q, slot = np.nonzero(real)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(found[q, slot]), pa.array(score[q, slot])], ["query_id", "vec_id", "score"])


def _search(k: int, read: int, keep: int):
    """Over rows sorted by task, kind (queries first) and file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, shelf = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            tasks, kinds, files, ids = (batch.column(i).to_numpy() for i in range(4))
            vectors = _matrix(batch.column(4))
            places = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u2").reshape(len(batch), -1).astype(np.int16)
            change = np.flatnonzero((np.diff(tasks, prepend=tasks[0] - 1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for start, end in zip(change, [*change[1:], len(batch)], strict=True):
                if tasks[start] != task:
                    if shelf is not None:
                        yield shelf.best(k)
                    task, waiting, shelf = tasks[start], [], None
                part = slice(start, end)
                if kinds[start] == 0:
                    waiting.append((ids[part], vectors[part], places[part]))
                elif waiting or shelf is not None:
                    if shelf is None:
                        shelf = Shelf(*(np.concatenate(x) for x in zip(*waiting, strict=True)), read, keep)
                        waiting = []
                    shelf.meet(ids[part], files[part], vectors[part], places[part])
        if shelf is not None:
            yield shelf.best(k)

    return run


def _found(asked: DataFrame, index: DataFrame, n_asked: int, n_index: int, k: int, read: int, rerank: int, shelves: int, shelf_rows: int, block_queries: int) -> DataFrame:
    shelves = max(shelves, -(-n_index // shelf_rows))
    blocks = max(1, -(-n_asked // block_queries))
    task = (F.col("block") * shelves + F.col("shelf")).cast("int").alias("task")
    deal = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = lambda kind: [task, F.lit(kind).alias("kind"), "file", "id", "v", "places"]
    queries = asked.withColumn("block", deal(blocks, 3)).withColumn("shelf", every(shelves)).select(*columns(0))
    rows = index.withColumn("shelf", deal(shelves, 5)).withColumn("block", every(blocks)).select(*columns(1))
    spread = min(blocks * shelves, max(partition_count(asked.sparkSession), shelves))
    met = queries.unionByName(rows).repartitionById(spread, F.col("task") % spread).sortWithinPartitions("task", "kind", "file")
    found = met.mapInArrow(_search(k, read, max(k, -(-rerank // shelves))), "query_id long, vec_id long, score double")
    # Spark limits each query's rows by rank before the shuffle and streams them after it.
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return materialize(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct(), "found")


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 20, pivots: int = PIVOTS, read_share: float = READ_SHARE, rerank: int = RERANK,
    shelves: int = SHELVES, shelf_rows: int = SHELF_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The `k` vectors found with the largest inner product: query_id, rank (from 1), vec_id, score.

    Both inputs are (id, v) from usable_vectors. A query's own id is no candidate. Ties go to the smaller vec_id;
    fewer candidates give fewer rows; no vectors give none. The index holds vectors of the most frequent length (of
    equally frequent ones the longest); others take no part. Of rows that repeat an id with one vector, one is
    returned. A query whose files hold fewer than `k` vectors reads all files.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None:
        return none
    of_length = F.size("v") == length[0]
    distinct = smallest_copies(vectors.where(of_length), k + 1)
    longest = vectors.where(of_length).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    chosen = choose_pivots(vectors.where(of_length), pivots, longest, length[1])
    model, read = spark.sparkContext.broadcast(chosen), max(1, round(read_share * len(chosen)))
    index = materialize(distinct.mapInArrow(_placed(model, longest), _PLACED), "index")
    asked = materialize(queries.where(of_length).distinct().mapInArrow(_placed(model, None), _PLACED), "asked")
    n_index, n_asked = index.count(), asked.count()
    if not n_asked:
        return none
    sizes = (k, rerank, shelves, shelf_rows, block_queries)
    search = lambda some, n, files: _found(some, index, n, n_index, sizes[0], files, *sizes[1:])
    found = search(asked, n_asked, read)
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n_index - 1))
    short = materialize(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short")
    n_short = short.count()
    if not n_short:
        return found
    again = search(short, n_short, len(chosen))
    return found.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors.where("id % 20 = 0"), vectors)
