"""Ranked lexical search: document-sharded CSR postings with precomputed integer impacts.

1. One pass counts the documents that hold a term and all their terms; the length norm needs both.
2. A second pass cuts the documents into shards of bounded size. A shard is one row: its document ids in order, the
   sorted hashes of its terms, and for each term the documents that hold it with the term's impact on each, an
   integer that no query changes.
3. Queries are taken in blocks of bounded size. For a block, the shards first give the document frequency of each of
   its terms, hence the terms' weights. Then every shard adds weight times impact, term at a time, into a dense
   accumulator over its documents, and keeps its best k with argpartition. A task merges the best of its shards as it
   goes, and one window merges the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import breaks_but, materialize, read_table, word_hashes

#: Terms are runs of digits, ASCII letters and everything beyond ASCII.
TERM_BREAKS = breaks_but((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: A shard closes at so many bytes of text or so many documents; documents have 16-bit numbers in a shard.
SHARD_BYTES, SHARD_DOCS = 16_000_000, 1 << 16
#: Bytes of query text that the driver holds, and every task reads, at a time.
BLOCK_BYTES = 4_000_000
#: Bytes of text tokenised at a time.
STEP_BYTES = 2_000_000
#: Fixed by the contract of the ranking: scales of weights and impacts, and per cent of the norm that follows length.
WEIGHT_SCALE, IMPACT_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 75


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            buf = np.frombuffer(b" " + (text.as_py() or b""), np.uint8)
            breaks = TERM_BREAKS[buf]
            n = int(np.count_nonzero(breaks[:-1] & ~breaks[1:]))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})


def _shard(ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int) -> list:
    """One row of the index. Documents stand by id, nulls last, so a smaller number is a smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    hashes, counts = [], np.zeros(len(order), np.int64)
    first, size = 0, 0
    for k, i in enumerate(order):
        size += len(texts[i])
        if size >= STEP_BYTES or k == len(order) - 1:
            part, counts[first : k + 1] = word_hashes([texts[j] for j in order[first : k + 1]], TERM_BREAKS)
            hashes.append(part)
            first, size = k + 1, 0
    hashes = np.concatenate(hashes)
    norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * counts * n_docs) // n_terms
    by_term = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[by_term], np.repeat(np.arange(len(order)), counts)[by_term]
    new_term = np.ones(len(hashes), bool)
    new_term[1:] = hashes[1:] != hashes[:-1]
    new_pair = new_term.copy()
    new_pair[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new_pair)
    tf = np.diff(at, append=len(hashes))
    docs = docs[at]
    impacts = (IMPACT_SCALE * tf) // (1000 * tf + 8 * norm[docs])
    starts = np.append(np.flatnonzero(new_term[at]), len(at))
    known = [ids[i] for i in order if ids[i] is not None]
    return [len(order), np.array(known, np.int64).tobytes(), hashes[at][starts[:-1]].tobytes(), starts.astype(np.int64).tobytes(), docs.astype(np.uint16).tobytes(), impacts.astype(np.int32).tobytes()]


SHARD_SCHEMA = "n_docs long, ids binary, terms binary, starts binary, docs binary, impacts binary"
_SHARD_TYPES = pa.schema([("n_docs", pa.int64()), *((c, pa.binary()) for c in ("ids", "terms", "starts", "docs", "impacts"))])


def _shards(n_docs: int, n_terms: int, shard_bytes: int):
    def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(_shard(ids, texts, n_docs, n_terms), _SHARD_TYPES, strict=True)], schema=_SHARD_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= shard_bytes or len(ids) == SHARD_DOCS:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return run


@dataclass(frozen=True)
class Index:
    """Shards in the shared folder, the number of documents with a term, and of all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index of whole texts. Null and empty texts hold no term and count nowhere. Every row is a document, repeated rows included."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("length(text) > 0")
    counted = texts.select("text").mapInArrow(_count_terms, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = counted["docs"] or 0, counted["terms"] or 0
    shards = texts.mapInArrow(_shards(n_docs, max(n_terms, 1), shard_bytes), SHARD_SCHEMA)
    return Index(materialize(shards, "shards"), n_docs, n_terms)


# ---------------------------------------------------------------------------------------
# Search


@dataclass(frozen=True)
class Block:
    """Queries of one block in CSR form: terms by number into the block's sorted vocabulary, with their repeats."""

    uids: list[int]
    starts: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    vocabulary: np.ndarray


def query_block(rows: list[tuple[int, str]]) -> Block:
    hashes, counts = word_hashes([text.encode() for _, text in rows], TERM_BREAKS)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    pairs, repeats = np.unique(np.repeat(np.arange(len(rows)), counts) * len(vocabulary) + number, return_counts=True)
    row, term = np.divmod(pairs, max(len(vocabulary), 1))
    return Block([uid for uid, _ in rows], np.searchsorted(row, np.arange(len(rows) + 1)), term, repeats, vocabulary)


def _found(terms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word of the vocabulary among the shard's sorted terms, -1 where it is not there."""
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    return np.where(terms[at] == vocabulary, at, -1) if len(terms) else np.full(len(vocabulary), -1)


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                at = _found(np.frombuffer(terms.as_py(), np.uint64), vocabulary)
                held = at >= 0
                df[held] += np.diff(np.frombuffer(starts.as_py(), np.int64))[at[held]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], ["number", "df"])

    return run


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal scores at the edge, those that stand first."""
    if len(scores) > k:
        edge = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        if edge > 0:
            over = np.flatnonzero(scores > edge)
            return np.concatenate([over, np.flatnonzero(scores == edge)[: k - len(over)]])
    return np.flatnonzero(scores > 0)


def _scores(block: Block, weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in block.uids]
        gain = block.repeats * weights[block.terms]
        for batch in batches:
            for i in range(batch.num_rows):
                n, ids, terms, starts, docs, impacts = (c[i].as_py() for c in batch.columns)
                ids, terms, starts = np.frombuffer(ids, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int64)
                docs, impacts = np.frombuffer(docs, np.uint16), np.frombuffer(impacts, np.int32)
                at = _found(terms, block.vocabulary)
                for q in range(len(block.uids)):
                    acc = np.zeros(n, np.int64)
                    for t in range(block.starts[q], block.starts[q + 1]):
                        place = at[block.terms[t]]
                        if place >= 0:
                            s, e = starts[place], starts[place + 1]
                            acc[docs[s:e]] += gain[t] * impacts[s:e]
                    top = best(acc, k)
                    if len(top):
                        held[q] += [(-int(acc[d]), d >= len(ids), int(ids[d]) if d < len(ids) else 0) for d in top]
                        held[q] = sorted(held[q])[:k]
        rows = [(uid, None if null else doc_id, -score) for uid, found in zip(block.uids, held, strict=True) for score, null, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["uid", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Rows (uid, text) in lists of bounded size; the driver holds one partition of queries at most."""
    rows, size = [], 0
    for uid, text in items.toLocalIterator():
        rows.append((uid, text))
        size += len(text.encode()) + 64
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(index: Index, items: DataFrame, k: int = 10, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank, doc_id, score.

    Equal scores stand by ascending doc_id, null ids last. Rows of items that share an id are ranked each by itself.
    Null and empty items, and items none of whose terms occurs, give no rows. Terms are told apart by 64-bit hashes.
    """
    spark = items.sparkSession
    given = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text")).where("length(text) > 0")
    given = materialize(given.withColumn("uid", F.monotonically_increasing_id()), "items")  # so the numbers hold from here on
    parts = []
    for rows in _blocks(given.select("uid", "text"), block_bytes) if index.n_docs else ():
        block = query_block(rows)
        weights = np.zeros(len(block.vocabulary), np.int64)
        frequencies = index.shards.select("terms", "starts").mapInArrow(_frequencies(block.vocabulary), "number long, df long")
        for number, df in frequencies.groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
            weights[number] = weight(index.n_docs, df)
        parts.append(materialize(index.shards.mapInArrow(_scores(block, weights, k), "uid long, doc_id long, score long"), "found"))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "uid long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(given.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


def op11_impact_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS did, doc_id, {_TERMS_SQL} AS terms FROM documents),
s AS (SELECT did, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
q AS (SELECT row_number() OVER () AS uid, item_id, {_TERMS_SQL} AS terms FROM benchmark),
qt AS (SELECT uid, term, count(*) AS times FROM (SELECT uid, unnest(terms) AS term FROM q) GROUP BY uid, term),
tf AS (SELECT did, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT did, doc_id, n, unnest(terms) AS term FROM s)
  WHERE term IN (SELECT term FROM qt) GROUP BY did, term),
w AS (SELECT term, CAST(floor({WEIGHT_SCALE} * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), a),
p AS (SELECT did, doc_id, term, w * (({IMPACT_SCALE} * tf) // (1000 * tf + 8 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * nn) // ll))) AS points FROM tf JOIN w USING (term), a),
r AS (SELECT uid, did, any_value(doc_id) AS doc_id, CAST(sum(times * points) AS BIGINT) AS score FROM qt JOIN p USING (term) GROUP BY uid, did),
k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN q USING (uid) WHERE rank <= 10
"""
