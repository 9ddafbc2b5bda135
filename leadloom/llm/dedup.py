"""MinHash near-duplicate groups with sequential Bayesian verification.

1. One pass over the texts gives each document its set of word shingles as a digest, 128 min-hashes
   cut into 32 bands, and a sketch of 4 bits per min-hash. Equal sets become one node.
2. Each band bucket proposes the pairs of its members with its leader, the node with the most copies.
3. Proposed pairs are compared by batches of the sketch; a pair goes as soon as the posterior probability
   of its similarity reaching the threshold is below the chosen miss probability.
4. Survivors are confirmed on their full shingle sets, and links give components.
5. Only buckets that still hold several components propose pairs again, across components. There a pair must
   also pass an exact bound: confirming a pair with its leader leaves bitmaps of what the node adds to the
   leader's set and what it lacks of it, and these bound the intersection of any two nodes with one leader from
   above. So the members of a large group that fall just short of the threshold leave no pairs behind, and no
   link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, read_table, shingle_hashes, word_hashes

HASHES, BANDS = 128, 32
SKETCH = [f"s{i}" for i in range(HASHES // 16)]
#: 64-bit parts of the bitmaps of differences from a leader.
PARTS = 8
MORE = [f"m{i}" for i in range(PARTS)]
LESS = [f"l{i}" for i in range(PARTS)]
DIFF = ["n_more", "n_less", *MORE, *LESS]
#: Hashes compared before each pruning decision.
BATCH = 32
#: Wanted texts are found by a broadcast of up to so many keys (24 bytes each), beyond that by a shuffle.
BROADCAST_NODES = 2_000_000
#: Bytes of text handled at a time within a worker.
STEP_BYTES = 2_000_000

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def _min_hashes(shingles: np.ndarray) -> np.ndarray:
    parts = [(shingles[i : i + 4096][None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1) for i in range(0, len(shingles), 4096)]
    return mix64(reduce(np.minimum, parts))


def _sketch(mins: np.ndarray) -> np.ndarray:
    """Four bits of each min-hash, sixteen to a 64-bit integer."""
    nibbles = (mins & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(nibbles, axis=1).view(np.int64)


def _bands(mins: np.ndarray) -> np.ndarray:
    out = _BAND
    for row in mins.reshape(BANDS, -1).T:
        out = mix64(out ^ row)
    return out.view(np.int64)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    runs = shingle_hashes(words, width) if len(words) >= width else words[:0]
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        out.append(np.unique(runs[end - n : end - width + 1] if n >= width else shingle_hashes(words[end - n : end], width)))
    return out


def _stepped(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) of stretches of the column."""
    group, size, first = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py()
        group.append(text or b"")
        size += len(group[-1])
        if size >= STEP_BYTES:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _stepped(batch.column(2).cast(pa.binary())):
                n, node, sketch, bands = [], [], [], []
                for s in _sets(group, width):
                    n.append(len(s))
                    if len(s):
                        mins = _min_hashes(s)
                        node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        sketch.append(_sketch(mins))
                        bands.append(_bands(mins))
                    else:
                        node.append(None)
                        sketch.append(np.zeros(len(SKETCH), np.int64))
                        bands.append(np.zeros(0, np.int64))
                sketches = np.array(sketch)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(group)), batch.column(1).slice(first, len(group)), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                        *(pa.array(sketches[:, i]) for i in range(len(SKETCH))), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", *SKETCH, "bands"],
                )

    return run


# ---------------------------------------------------------------------------------------
# Sequential Bayesian test


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """[(hashes compared, fewest equal that go on)]: below it P(similarity >= threshold | equal) < miss.

    Prior: similarity uniform on 0..1. Two 4-bit values are equal with probability s + (1 - s) / 16.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 16
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            mass = np.exp(logs - logs.max())
            if mass[s >= threshold].sum() / mass.sum() >= miss:
                out.append((n, m))
                break
    return out


def _unequal(i: int) -> str:
    """SQL for the number of unequal 4-bit values of one sketch column of aliases x and y."""
    d = f"(x.s{i} ^ y.s{i})"
    return f"bit_count(({d} | shiftright({d}, 1) | shiftright({d}, 2) | shiftright({d}, 3)) & 1229782938247303441L)"


def plausible_sql(per_cent: int, miss: float) -> str:
    """SQL over aliases x and y: sizes allow the similarity, and no batch of the sketch rules it out."""
    tests = [f"100 * least(x.n_shingles, y.n_shingles) >= {per_cent} * greatest(x.n_shingles, y.n_shingles)"]
    for n, least in least_matches(per_cent / 100, miss):
        tests.append(f"{' + '.join(_unequal(i) for i in range(n // 16))} <= {n - least}")
    return " AND ".join(f"({t})" for t in tests)


# ---------------------------------------------------------------------------------------
# Exact confirmation and components


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its lowest bits."""
    bits = np.zeros(PARTS * 64, np.uint8)
    bits[(shingles & np.uint64(PARTS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _confirm(width: int, per_cent: int):
    """Of pairs (a, b) with their texts: whether the sets reach the similarity, and how b's set differs from a's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2), batch.column(3)
            linked, diffs = [], np.zeros((len(a), len(DIFF)), np.int64)
            for i, node in enumerate(a):
                if node not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[node] = _sets([left[i].as_py().encode()], width)[0]
                one, two = known[node], _sets([right[i].as_py().encode()], width)[0]
                more, less = np.setdiff1d(two, one, assume_unique=True), np.setdiff1d(one, two, assume_unique=True)
                both = len(two) - len(more)
                linked.append(100 * both >= per_cent * (both + len(more) + len(less)))
                diffs[i] = [len(more), len(less), *_bitmap(more), *_bitmap(less)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked), *(pa.array(diffs[:, k]) for k in range(len(DIFF)))], ["a", "b", "linked", *DIFF])

    return run


def _overlap_sql() -> str:
    """SQL over aliases x and y with one leader: no fewer than the shingles their sets share.

    Inside the leader's set both lack what either lacks; outside it they share added shingles. Shared shingles
    are at most the shared bits and the bits that one node's own shingles double.
    """
    shared = lambda cols: " + ".join(f"bit_count(x.{c} & y.{c})" for c in cols)
    double = lambda n, cols: "least(" + ", ".join(f"{t}.{n} - ({' + '.join(f'bit_count({t}.{c})' for c in cols)})" for t in "xy") + ")"
    return f"(x.n_shingles - x.n_more - y.n_less + {shared(LESS)} + {double('n_less', LESS)} + {shared(MORE)} + {double('n_more', MORE)})"


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(a, b, linked, differences) of every pair, by its full shingle sets. Only the texts of nodes in pairs move."""
    wanted = materialize(
        pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", F.col("rep").alias("w_id"), F.col("text_key").alias("w_key")), "nid"), "wanted"
    )
    few = wanted.count() <= BROADCAST_NODES
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    match = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    # Rows that repeat an id with its text are one text here: combined before the shuffle, so no task gets them all.
    texts = keyed.join(F.broadcast(wanted) if few else wanted, match).groupBy("nid").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    left = pairs.join(texts.withColumnRenamed("nid", "a").withColumnRenamed("text", "t"), "a")
    both = left.join(texts.withColumnRenamed("nid", "b").withColumnRenamed("text", "u"), "b").select("a", "b", "t", "u")
    schema = "a long, b long, linked boolean, " + ", ".join(f"{c} long" for c in DIFF)
    return materialize(both.mapInArrow(_confirm(width, per_cent), schema), "links")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(nid, comp) for every node in links: comp is the smallest node reachable.

    Each round takes the smallest label of the neighbours and then jumps to that label's own label,
    so chains shorten geometrically. Labels live in tables; the driver sees one count a round.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "nid"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        best = labels.join(near.withColumnRenamed("a", "nid"), "nid").select("nid", F.col("comp").alias("old"), F.least("comp", "near").alias("best"))
        jump = labels.select(F.col("nid").alias("best"), F.col("comp").alias("to"))
        after = materialize(best.join(jump, "best", "left").select("nid", "old", F.least("best", F.coalesce("to", "best")).alias("comp")), "labels")
        labels = after.select("nid", "comp")
        if after.where("old <> comp").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Near-duplicate components of whole texts: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct runs of `width` words, or
    all words as one run where there are fewer. Documents link at `per_cent` of Jaccard similarity, confirmed
    on full sets. One row per input row, repeated rows included. Null, empty and blank texts have no
    shingles, link with nothing and are kept, each its own component. component_id is the smallest doc_id
    reachable; null doc_ids take part in links but never name a component; kept is false where doc_id is null.
    Further columns are ignored. `miss` bounds the probability at which the sketch test drops a true link.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, text_key long, n_shingles long, node binary, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"
    signed = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_signatures(width), schema), "signatures")
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = (
        signed.where("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), one, *(F.first(c).alias(c) for c in ("n_shingles", *SKETCH, "bands")))
        .select("node", "first_id", "copies", F.col("one.doc_id").alias("rep"), F.col("one.text_key").alias("text_key"), "n_shingles", *SKETCH, "bands")
        .withColumn("nid", F.expr("shiftleft(31L - least(31L, cast(log2(copies) AS bigint)), 58)").bitwiseOR(F.monotonically_increasing_id()))
    )
    nodes = materialize(nodes, "nodes")  # so the ids hold from here on; nodes with many copies have the lowest
    buckets = nodes.select("nid", F.explode("bands").alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("nid").alias("a")).where("n > 1").select("bucket", "a"), "shared")
    members = materialize(buckets.join(shared, "bucket").select("bucket", "a", "nid"), "members")
    sketches = nodes.select("nid", "n_shingles", *SKETCH)
    test = F.expr(plausible_sql(per_cent, miss))

    stars = members.where("a <> nid").select("a", F.col("nid").alias("b")).distinct()
    x = stars.join(sketches.withColumnRenamed("nid", "a"), "a").alias("x")
    y = sketches.withColumnRenamed("nid", "b").alias("y")
    near = x.join(y, (F.col("x.b") == F.col("y.b")) & test).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    near = materialize(near, "near")
    tested = _confirmed(near, nodes, docs, width, per_cent)
    links = tested.where("linked").select("a", "b")
    labels = components(links)

    zero = [F.lit(0).cast("long").alias(c) for c in DIFF]
    of_leader = tested.select(F.col("b").alias("nid"), F.col("a").alias("ref"), *DIFF).union(tested.select(F.col("a").alias("nid"), F.col("a").alias("ref"), *zero))
    of_leader = of_leader.groupBy("nid").agg(F.min(F.struct("ref", *DIFF)).alias("d")).select("nid", "d.*")
    detail = materialize(sketches.join(of_leader, "nid", "left"), "detail")
    at = members.select("bucket", "nid").join(labels, "nid", "left").select("bucket", "nid", F.coalesce("comp", "nid").alias("comp"))
    at = materialize(at, "at")
    mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    mixed = materialize(at.join(materialize(mixed, "mixed"), "bucket").join(detail, "nid"), "left")
    x, y = mixed.alias("x"), mixed.alias("y")
    possible = F.expr(f"NOT coalesce(x.ref = y.ref AND {100 + per_cent} * {_overlap_sql()} < {per_cent} * (x.n_shingles + y.n_shingles), false)")
    more = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") < F.col("y.comp")) & test & possible)
    more = more.select(F.col("x.nid").alias("p"), F.col("y.nid").alias("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    more = materialize(more.join(near, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        links = links.union(_confirmed(more, nodes, docs, width, per_cent).where("linked").select("a", "b"))
        labels = components(links)

    named = nodes.select("nid", "node", "first_id").join(labels, "nid", "left").select("node", "first_id", F.coalesce("comp", "nid").alias("comp"))
    named = materialize(named, "named")
    lowest = materialize(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "lowest")
    of_node = materialize(named.join(lowest, "comp").select("node", "component_id"), "of-node")
    out = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)
