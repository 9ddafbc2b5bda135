"""LM scores of whole texts: a context-tree weighting model over bytes, and a word unigram as base.

Context-tree weighting: the next byte is eight binary decisions; for every context of 0 to DEPTH bytes and
every decision the corpus gives counts of both outcomes, Krichevsky-Trofimov estimates turn them into
probabilities, and each node mixes its own estimate with its children's by the weights that the recursion
P_w = (P_kt + product of the children's P_w) / 2 gives over the whole training corpus. A decision that no training
text met in a context is left to the shorter context. The model is then held fixed and scores every text; over the
256 bytes of any context its probabilities sum to 1.

No machine holds the model: subtrees below TOP bytes of context are independent, so they are dealt over tasks, and
the few nodes above meet on the driver. Texts are dealt into blocks of some BLOCK_BYTES; each block asks for the
distinct keys (context and byte) that its texts hold, and meets their probabilities in a cogroup.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, materialize, partition_count, read_table

#: Bytes of context; those above which the driver holds the nodes (at most 65,536 of each depth). Texts start after
#: DEPTH zero bytes and end with the byte 255, which UTF-8 never has.
DEPTH, TOP = 4, 2
TOP_SHIFT = 8 * (DEPTH - TOP + 1)
#: Bytes of text in a block, on average; keys that a worker folds at a time.
BLOCK_BYTES, STRETCH = 16_000_000, 200_000
#: The most frequent tokens of the corpus, each of at most HEAVY_BYTES: their counts are broadcast (a few MB at
#: most). Tokens beyond them meet their counts in a join.
HEAVY_TOKENS, HEAVY_BYTES = 65_536, 64
#: Distinct tokens a worker counts before it passes them on.
COUNTER_TOKENS = 200_000
#: Bytes of text handled at a time within a worker.
STEP_BYTES = 2_000_000
ALPHA = 0.1
#: Hashes of repeated rows up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) of stretches of the column."""
    group, size, first = [], 0, 0
    for i in range(len(column)):
        group.append((column[i].as_py() or "").encode("utf-8", "replace"))
        size += len(group[-1])
        if size >= STEP_BYTES:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, in parts; the end token is null."""
    seen: Counter[bytes] = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.binary()), pa.array([*seen.values(), ends], pa.int64())], ["token", "n"])

    for batch in batches:
        for _, group in _texts(batch.column(0)):
            for text in group:
                seen.update(text.translate(_LOWER).split())
            ends += len(group)
            if len(seen) > COUNTER_TOKENS:
                yield out()
                seen.clear()
                ends = 0
    if ends:
        yield out()


def _keys(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte under the DEPTH bytes before it, the latest one highest, as one integer; how many there are of each text, end bytes included."""
    raw = b"".join(bytes(DEPTH) + t + b"\xff" for t in group)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    keys = b[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        keys |= b[DEPTH - d : len(b) - d] << (8 * (DEPTH - d + 1))
    lens = np.fromiter(map(len, group), np.int64, len(group)) + 1
    keep = np.ones(len(keys), dtype=bool)
    starts = np.cumsum(lens + DEPTH)[:-1]  # of the texts after the first
    for d in range(1, DEPTH + 1):
        keep[starts - d] = False
    return keys[keep], lens


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    first = np.flatnonzero(np.diff(flat, prepend=flat[0] - 1))
    return flat[first], np.add.reduceat(n, first)


def _count_keys(table: pa.Table) -> pa.Table:
    """The keys of one block's texts with their counts in training texts, 0 included; a text counts `learn` times."""
    keys, counts = [], []
    for learn in pa.compute.unique(table["learn"]).to_pylist():
        for _, group in _texts(table.filter(pa.compute.equal(table["learn"], learn))["text"].combine_chunks()):
            found, n = np.unique(_keys(group)[0], return_counts=True)
            keys.append(found)
            counts.append(n * learn)
    found, n = _summed(keys, counts)
    return pa.table({"block": pa.array(np.full(len(found), table["block"][0].as_py(), np.int32)), "key": found, "n": n})


# ---------------------------------------------------------------------------------------
# The model

_SMALL = np.array([math.lgamma(k + 0.5) for k in range(4096)])
_SMALL_WHOLE = np.array([0.0, *(math.lgamma(k) for k in range(1, 4097))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lgamma(counts: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(counts + plus) of whole counts, for plus 0.5 or 1."""
    small = np.minimum(counts, 4095).astype(np.int64)
    table = _SMALL[small] if plus == 0.5 else _SMALL_WHOLE[small + 1]
    return np.where(counts < 4096, table, _stirling(np.maximum(counts, 4095) + plus))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - 2 * math.lgamma(0.5) - _lgamma(zeros + ones, 1.0)


def _weight(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate in its mixture."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _subtrees(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys in order that hold all there are of their contexts of `top` bytes.

    (keys, 8) probability of each bit of the byte as the nodes from `top` bytes down mix it; whether the node at
    `top` was seen; (65536,) sums of the log weighted probabilities of those nodes by the last byte and decision.
    """
    rows, up = [(keys, counts)], []
    for _ in range(depth - top):
        k, n = rows[-1]
        short, inverse = np.unique(k >> 16 << 8 | k & 255, return_inverse=True)
        up.append(inverse)
        rows.append((short, np.bincount(inverse, weights=n, minlength=len(short))))
    to_top = np.zeros(1 << 16)
    mixed, known = np.empty((len(keys), 8)), np.empty((len(keys), 8), bool)
    for k in range(8):
        below = None
        levels = []
        for d, (at, n) in enumerate(rows):
            new = np.diff(at >> (8 - k), prepend=-1) != 0
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            bit = at >> (7 - k) & 1
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
            own = _log_kt(total - ones, ones)
            if below is None:
                weight, log_w = None, own
            else:
                children = np.bincount(node[up[d - 1][below[0]]], weights=below[1], minlength=len(first))
                weight, log_w = _weight(own, children)[node], np.logaddexp(own, children) - math.log(2)
            p = (ones + 0.5) / (total + 1.0)
            levels.append((np.where(bit == 1, p[node], 1 - p[node]), total[node] > 0, weight))
            below = first, log_w
        at, first = rows[-1][0], below[0]
        h = 1 << k | (at[first] & 255) >> (8 - k)
        to_top += np.bincount((at[first] >> 16 & 255) << 8 | h, weights=below[1], minlength=1 << 16) if top == 2 else 0
        p, seen, _ = levels[0]
        where = np.arange(len(keys))
        for d in range(1, len(levels)):
            where = up[d - 1][where]
            own, weight = levels[d][0][where], levels[d][2][where]
            p, seen = np.where(seen, weight * own + (1 - weight) * p, own), levels[d][1][where]
        mixed[:, k], known[:, k] = p, seen
    return mixed, known, to_top


_NODE = np.array([[(1 << k) - 1 + (s >> (8 - k)) for k in range(8)] for s in range(256)])
_BIT = np.array([[(s >> (7 - k)) & 1 for k in range(8)] for s in range(256)])


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 255) counts of 0 and 1 at each node of the byte's binary tree, level by level."""
    parts = [counts.reshape(len(counts), 1 << k, 2, 1 << (7 - k)).sum(axis=3) for k in range(8)]
    return np.concatenate([p[:, :, 0] for p in parts], axis=1), np.concatenate([p[:, :, 1] for p in parts], axis=1)


def top_levels(pairs: np.ndarray, below: np.ndarray) -> np.ndarray:
    """(3, 256, 256, 8) by the last byte, the byte and its bit: with x from below, the bit has a + b * x, or c where below was not seen.

    pairs: (256, 256) counts of each byte after each; below: (256, 255) sums of the log weighted probabilities.
    """
    z1, o1 = _decisions(pairs)
    z0, o0 = _decisions(pairs.sum(axis=0)[None, :])
    own1, own0 = _log_kt(z1, o1), _log_kt(z0, o0)
    w1 = _weight(own1, below)
    w0 = _weight(own0, (np.logaddexp(own1, below) - math.log(2)).sum(axis=0)[None, :])
    bits = lambda x: np.where(_BIT == 1, x[:, _NODE], 1 - x[:, _NODE])
    k0, k1 = bits((o0 + 0.5) / (z0 + o0 + 1)), bits((o1 + 0.5) / (z1 + o1 + 1))
    w0, w1, seen = w0[:, _NODE], w1[:, _NODE], (z1 + o1)[:, _NODE] > 0
    a, b, c = w0 * k0 + (1 - w0) * w1 * k1, (1 - w0) * (1 - w1) * np.ones_like(k1), w0 * k0 + (1 - w0) * k1
    return np.stack([np.where(seen, a, k0), np.where(seen, b, 0), np.where(seen, c, k0)])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys with their counts in stretches that end where a context of TOP bytes ends; one context has 2 ** 24 keys at most."""
    keys, counts, size = [], [], 0
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if size >= STRETCH:
            own = np.flatnonzero(np.diff(k >> TOP_SHIFT, prepend=keys[-1][-1] >> TOP_SHIFT))
            if len(own):
                yield np.concatenate([*keys, k[: own[0]]]), np.concatenate([*counts, n[: own[0]]])
                keys, counts, size, k, n = [], [], 0, k[own[0] :], n[own[0] :]
        keys.append(k)
        counts.append(n)
        size += len(k)
    if size:
        yield np.concatenate(keys), np.concatenate(counts)


def _sum_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16)
    for keys, counts in _stretches(batches):
        total += _subtrees(keys, counts)[2]
    node = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(total[node])], ["node", "value"])


def _log_of_keys(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c = top.value.reshape(3, 1 << 16, 8)
        for keys, counts in _stretches(batches):
            x, seen, _ = _subtrees(keys, counts)
            at = keys >> (8 * DEPTH) << 8 | keys & 255
            p = np.where(seen, a[at] + b[at] * x, c[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(p).sum(axis=1).astype(np.float32))], ["key", "log_p"])

    return run


class Lookup:
    """Places of keys in an array that holds each once and has them all."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, h = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(left):
            free = self.slots[h] < 0
            self.slots[h[free]] = left[free]
            more = self.slots[h] != left
            left, h = left[more], (h[more] + 1) & (len(self.slots) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        h = self._hash(keys)
        out = self.slots[h]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            h[wrong] = (h[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[h[wrong]]
            if (out[wrong] < 0).any():
                raise KeyError("a key that was not asked for")
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        return out


def _score(heavy):
    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        tokens, logs = heavy.value
        lookup, log_p = Lookup(entries["key"].to_numpy()), entries["log_p"].to_numpy().astype(np.float64)
        uid = docs["block"][0].as_py() << 40 if len(docs) else 0
        parts = []
        doc_ids, times = docs["doc_id"].combine_chunks(), docs["times"].combine_chunks()
        for first, group in _texts(docs["text"].combine_chunks()):
            keys, lens = _keys(group)
            scores = np.add.reduceat(log_p[lookup.find(keys)], np.cumsum(lens) - lens)
            n_tokens, known, base, rare, rare_n = [], [], [], [], []
            for text in group:
                words = text.translate(_LOWER).split()
                at = np.fromiter(map(tokens.get, words, [-1] * len(words)), np.int64, len(words))
                found = at >= 0
                n_tokens.append(len(words) + 1)
                known.append(int(found.sum()))
                base.append(float(logs[at[found]].sum()))
                others = Counter(words[i] for i in np.flatnonzero(~found).tolist())
                rare.append(list(others))
                rare_n.append(list(others.values()))
            columns = [pa.array(np.arange(uid, uid + len(group))), doc_ids.slice(first, len(group)), pa.array(lens - 1), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64())), times.slice(first, len(group))]
            uid += len(group)
            parts.append(pa.RecordBatch.from_arrays(columns, SCORED.names))
        return pa.Table.from_batches(parts, SCORED)

    return run


SCORED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("rare_n", pa.list_(pa.int64())), ("times", pa.int64())])


def _once(given: DataFrame) -> DataFrame:
    """(doc_id, text, learn, times): rows that repeat an id with its text are one row, learnt as often as they are to be.

    A block is dealt by hash of the row, so equal rows would all meet in one task. Only rows whose hash repeats
    are grouped, combined before their shuffle; where none does, nothing moves but the hashes.
    """
    hashed = given.withColumn("h", F.xxhash64("doc_id", "text"))
    repeated = materialize(hashed.groupBy("h").count().where("count > 1").select("h"), "repeated")
    n = repeated.count()
    columns = lambda learn, times: ["doc_id", "text", learn.cast("long").alias("learn"), times.cast("long").alias("times")]
    if not n:
        return given.select(*columns(F.col("learn"), F.lit(1)))
    marked = F.broadcast(repeated) if n <= BROADCAST_HASHES else repeated
    single = hashed.join(marked, "h", "left_anti").select(*columns(F.col("learn"), F.lit(1)))
    several = hashed.join(marked, "h", "left_semi").groupBy("doc_id", "text").agg(F.sum(F.col("learn").cast("long")).alias("learn"), F.count("*").alias("times"))
    return single.unionByName(materialize(several.select(*columns(F.col("learn"), F.col("times"))), "once"))


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of every whole text by the model that learns from the rows where `training` holds.

    doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. One row per input row. Null texts
    are empty; an empty text is its end token and end byte alone. Without training rows every token has the
    base probability 1 and every byte decision is even. score counts the end byte. Null and repeated doc_ids
    keep their rows; further columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    tagged = _once(given).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    vocabulary = materialize(given.where("learn").select("text").mapInArrow(_count_words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = vocabulary.where(F.octet_length("token") <= HEAVY_BYTES).withColumn("band", F.floor(F.log2("n") * 16))
    # Whole bands of counts, as many as HEAVY_TOKENS has room for: no task sends the driver more than the broadcast holds.
    bands = sorted(short.groupBy("band").count().collect(), reverse=True)  # at most 1,024 rows
    fits = int((np.cumsum([n for _, n in bands]) <= HEAVY_TOKENS).sum())
    top_words = short.where(F.col("band") >= bands[fits - 1][0]).select("token", "n").collect() if fits else []
    heavy = sc.broadcast(({bytes(r[0]): i for i, r in enumerate(top_words)}, np.log10(np.array([r[1] for r in top_words], dtype=np.float64) + ALPHA)))

    asked = materialize(tagged.select("block", "text", "learn").groupBy("block").applyInArrow(_count_keys, "block int, key long, n long"), "keys")
    totals = materialize(asked.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    pairs, below = np.zeros(1 << 16), np.zeros(1 << 16)
    pair = (F.shiftright("key", 8 * DEPTH) * 256 + F.col("key") % 256).cast("int").alias("pair")
    for at, n in totals.groupBy(pair).agg(F.sum("n")).collect():  # at most 65,536 rows, as below
        pairs[at] = n
    ordered = totals.repartition(partition_count(docs.sparkSession), F.shiftright("key", TOP_SHIFT)).sortWithinPartitions("key")
    for at, value in ordered.mapInArrow(_sum_below, "node int, value double").groupBy("node").agg(F.sum("value")).collect():
        below[at] = value
    top = sc.broadcast(top_levels(pairs.reshape(256, 256), below.reshape(256, 256)[:, 1:]))
    model = ordered.mapInArrow(_log_of_keys(top), "key long, log_p float")
    entries = asked.select("block", "key").join(model, "key").select("block", "key", "log_p")

    schema = "uid long, doc_id long, n_bytes long, n_tokens long, known long, base double, score double, rare array<binary>, rare_n array<long>, times long"
    scored = tagged.select("block", "doc_id", "text", "times").groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(_score(heavy), schema)
    scored = materialize(scored, "scored")
    each = scored.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("times"))
    met = each.join(vocabulary.where("token is not null"), "token", "left")
    log_of = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ALPHA))
    rest = met.groupBy("uid").agg(F.sum(F.col("times") * log_of).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    ends = vocabulary.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per_token = math.log10(total + ALPHA * (distinct + 1))
    out = scored.join(rest, "uid", "left")
    # A row for each repetition, a thousand at a time.
    out = out.withColumn("part", F.explode(F.expr("sequence(0L, (times - 1) div 1000)"))).withColumn("nth", F.explode(F.expr("sequence(1L, least(1000L, times - 1000 * part))")))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + F.lit(math.log10(ends + ALPHA)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
