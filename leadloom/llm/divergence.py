"""Source divergence audit over deduplicated count columns.

1. One pass over the texts counts every term in each (lang, source) group, and the documents that hold it; Spark sums
   the partial counts. A language keeps the terms of enough of its documents.
2. A kept term's counts over the sources of its language, zeros left out, are its column. Terms with one column are
   one row with a multiplicity: everything the audit computes depends on the column alone.
3. Every pair of sources is evaluated once per distinct column and multiplied by the multiplicity. Only columns in
   which one of the two has a count are met; all others share one value.
4. Terms are ranked by columns too: the best columns of a group, ties included, are found first, and only their terms
   are looked up and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import breaks_but, materialize, mix64, place_hashes, read_table, word_places

#: Terms are runs of ASCII letters and everything beyond ASCII.
TERM_BREAKS = breaks_but((0x41, 0x5A), (0x61, 0x7A))
#: Fixed by the contract: a term is kept from so many documents of its language on; shares are out of SCALE; term ranks end here.
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Bytes of text counted together in a worker.
STEP_BYTES = 4_000_000
#: Sources on one side of a block of pairs: a block's sums take 8 MB at most.
SOURCE_BLOCK = 512
#: Groups the report may have; it has a row for every pair of a language's groups, so far fewer already fill a disk.
#: Tables of groups are broadcast behind this check.
MAX_GROUPS = 1_000_000
#: Counts from here on no longer fit a product with SCALE in 64 bits.
_WIDE = 9_000_000_000


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / size), exactly."""
    if len(counts) and counts.max() >= _WIDE:
        return np.array([1 + SCALE * (c + 1) // s for c, s in zip(counts.tolist(), np.broadcast_to(sizes, counts.shape).tolist(), strict=True)], np.int64)
    return 1 + SCALE * (counts + 1) // sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, term, n, docs) of stretches of texts; every group also has a row whose term is null."""

    def flush(gids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        buf, starts, ends, counts = word_places(texts, TERM_BREAKS)
        group = np.repeat(np.array(gids, np.int64), counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        hashes = place_hashes(buf, starts, ends, TERM_BREAKS)
        key = mix64(hashes ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")  # documents stay in order within a key
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new_doc = new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        n = np.diff(at, append=len(key))
        docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        one = order[at]
        first, size = starts[one], ends[one] - starts[one]
        bounds = np.concatenate([[0], np.cumsum(size)])
        chars = buf[np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])]
        terms = pa.StringArray.from_buffers(len(one), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(chars.tobytes()))
        seen = sorted(set(gids))
        zeros = np.zeros(len(seen), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([group[one], np.array(seen, np.int64)])), pa.concat_arrays([terms, pa.nulls(len(seen), pa.string())]),
                pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros])),
            ],
            ["gid", "term", "n", "docs"],
        )

    gids, texts, size = [], [], 0
    for batch in batches:
        for gid, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            gids.append(gid.as_py())
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= STEP_BYTES:
                yield flush(gids, texts)
                gids, texts, size = [], [], 0
    if texts:
        yield flush(gids, texts)


def _pairs(totals: dict[int, np.ndarray], zero: dict[int, np.ndarray]):
    """Sums over distinct columns of (value of the pair - value of two zeros) * multiplicity, as (lang_id, a, b, value).

    `totals` has N + V of each of a language's sources in order, `zero` the shares of a count of 0. Columns come with the
    two blocks of sources that they are cut to.
    """

    def add(sums: np.ndarray, lang: int, sources: np.ndarray, columns: list[tuple]) -> None:
        base = zero[lang][sources]
        p = np.repeat(base[None, :], len(columns), axis=0)
        times = np.array([c[0] for c in columns], np.int64)
        row = np.repeat(np.arange(len(columns)), [len(c[1]) for c in columns])
        col = np.searchsorted(sources, np.concatenate([c[1] for c in columns]))
        p[row, col] = shares(np.concatenate([c[2] for c in columns]), totals[lang][sources][col])
        some = np.zeros(p.shape, bool)
        some[row, col] = True
        for s in range(len(sources)):
            rows = np.flatnonzero(some[:, s])
            if len(rows):
                q, mine, m = p[rows], p[rows, s][:, None], times[rows][:, None]
                sums[s] += (((mine - q) ** 2 // q - (base[s] - base) ** 2 // base) * m).sum(axis=0)
                other = ((q - mine) ** 2 // mine - (base - base[s]) ** 2 // base[s]) * m  # others against s, where only s has a count
                sums[:, s] += np.where(some[rows], 0, other).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            parts = []
            for (lang, i, j), (sources, sums) in held.items():
                block = sources // SOURCE_BLOCK
                wanted = ((block[:, None] == i) & (block[None, :] == j)) | ((block[:, None] == j) & (block[None, :] == i))
                a, b = np.nonzero(wanted)
                parts.append(np.stack([np.full(len(a), lang), sources[a], sources[b], sums[a, b]]))
            held.clear()
            rows = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["lang_id", "a", "b", "value"])

        for batch in batches:
            cells: dict[tuple, list[tuple]] = {}
            columns = [batch.column(k) for k in range(3)]
            lists, counts = batch.column(3), batch.column(4)
            offsets, flat_s, flat_n = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
            n_offsets, times = counts.offsets.to_numpy(), batch.column(5).to_numpy()
            for r, key in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                cells.setdefault(key, []).append((times[r], flat_s[offsets[r] : offsets[r + 1]], flat_n[n_offsets[r] : n_offsets[r + 1]]))
            for key, found in cells.items():
                if key not in held:
                    lang, i, j = key
                    every = np.arange(len(totals[lang]))
                    sources = every[np.isin(every // SOURCE_BLOCK, (i, j))]
                    held[key] = (sources, np.zeros((len(sources), len(sources)), np.int64))
                sources, sums = held[key]
                step = max(1, 1_000_000 // len(sources))
                for k in range(0, len(found), step):
                    add(sums, key[0], sources, found[k : k + step])
                if sum(len(s) ** 2 for s, _ in held.values()) > 8_000_000:
                    yield out()
        yield out()

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group of (lang, source), nulls read as ''.

    Part `pair` has each other source of the language, with the divergence summed over its kept terms; part `term` the
    group's terms that are over-represented against the language, up to rank `top_terms`. Values descend, equal values
    stand by item. Groups without kept terms have pairs but no terms; a language without kept terms has pairs of value 0; a
    language of one group has no pairs. Null and empty texts hold no term. Repeated rows count each. Further columns are ignored.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))
    groups = materialize(given.select("lang", "source").distinct(), "groups")
    if groups.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: a row for every pair of them cannot be reported")
    names = sorted(((r["lang"], r["source"]) for r in groups.collect()), key=lambda r: (r[0].encode(), r[1].encode()))
    langs = sorted({lang for lang, _ in names}, key=str.encode)
    lang_of = {lang: k for k, lang in enumerate(langs)}
    first: dict[int, int] = {}
    for gid, (lang, _) in enumerate(names):
        first.setdefault(lang_of[lang], gid)
    table = spark.createDataFrame([(gid, lang_of[lang], gid - first[lang_of[lang]], lang, source) for gid, (lang, source) in enumerate(names)], "gid long, lang_id long, number int, lang string, source string")

    texts = given.join(F.broadcast(table), ["lang", "source"]).select("gid", "text")
    counts = texts.mapInArrow(_counted, "gid long, term string, n long, docs long").where("term IS NOT NULL").groupBy("gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.join(F.broadcast(table.select("gid", "lang_id", "number")), "gid")
    terms = counts.groupBy("lang_id", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("number", "n"))).alias("column"))
    terms = materialize(terms.where(F.col("docs") >= least_docs).select("lang_id", "term", "column"), "terms")
    columns = materialize(terms.groupBy("lang_id", "column").agg(F.count("*").alias("times")), "columns")

    # N of each group and V of each language: no more rows than there are groups.
    kept = dict.fromkeys(lang_of.values(), 0) | {r["lang_id"]: r["v"] for r in columns.groupBy("lang_id").agg(F.sum("times").alias("v")).collect()}
    n_of = {(r["lang_id"], r["number"]): r["n"] for r in columns.select("lang_id", "times", F.explode("column").alias("c")).groupBy("lang_id", "c.number").agg(F.sum(F.col("times") * F.col("c.n")).alias("n")).collect()}
    width = {k: sum(1 for lang, _ in names if lang_of[lang] == k) for k in lang_of.values()}
    totals = {k: np.array([n_of.get((k, i), 0) + kept[k] for i in range(width[k])], np.int64) for k in width if kept[k]}
    zero = {k: shares(np.zeros(len(t), np.int64), t) for k, t in totals.items()}

    # Pairs: every column once for each pair of blocks that holds a count of it; with one block, that is once.
    whole = columns.join(F.broadcast(spark.createDataFrame([(k, -(-w // SOURCE_BLOCK)) for k, w in width.items()], "lang_id long, blocks int")), "lang_id")
    one = whole.where("blocks = 1").select("lang_id", F.lit(0).alias("i"), F.lit(0).alias("j"), "column", "times")
    cells = F.expr(f"filter(flatten(transform(sequence(0, blocks - 1), i -> transform(sequence(i, blocks - 1), j -> named_struct('i', i, 'j', j)))), b -> exists(column, c -> c.number div {SOURCE_BLOCK} IN (b.i, b.j)))")
    many = whole.where("blocks > 1").select("lang_id", "column", "times", F.explode(cells).alias("b")).select("lang_id", "b.i", "b.j", F.expr(f"filter(column, c -> c.number div {SOURCE_BLOCK} IN (b.i, b.j))").alias("column"), "times")
    many = many.groupBy("lang_id", "i", "j", "column").agg(F.sum("times").alias("times"))
    cut = one.unionByName(many).select("lang_id", "i", "j", F.col("column.number").alias("numbers"), F.col("column.n").alias("counts"), "times")
    sums = cut.mapInArrow(_pairs(totals, zero), "lang_id long, a long, b long, value long").groupBy("lang_id", "a", "b").agg(F.sum("value").alias("value"))
    of_lang = spark.createDataFrame(list(kept.items()), "lang_id long, v long")
    side = table.join(of_lang, "lang_id").join(spark.createDataFrame([(k, i, int(p)) for k, z in zero.items() for i, p in enumerate(z)], "lang_id long, number int, p long"), ["lang_id", "number"], "left")
    left, right = side.alias("x"), side.alias("y")
    pairs = left.join(right, (F.col("x.lang_id") == F.col("y.lang_id")) & (F.col("x.number") != F.col("y.number")))
    pairs = pairs.select(F.col("x.gid").alias("gid"), F.col("x.lang_id").alias("lang_id"), F.col("x.number").cast("long").alias("a"), F.col("y.number").cast("long").alias("b"), F.col("y.source").alias("item"), F.expr("coalesce(x.v * ((x.p - y.p) * (x.p - y.p) div y.p), 0L)").alias("base"))
    pairs = pairs.join(sums, ["lang_id", "a", "b"], "left").select("gid", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("value", F.lit(0))).alias("value"))

    # Terms: the value of a column for each source that has a count in it.
    wide = lambda c: f"cast({c} AS decimal(38, 0))"
    sizes = spark.createDataFrame([(first[k] + i, k, i, int(t), int(totals[k].sum() - len(totals[k]) * kept[k] + kept[k])) for k in totals for i, t in enumerate(totals[k])], "gid long, lang_id long, number int, size long, lang_size long")
    each = columns.select("lang_id", "column", "times", F.expr("aggregate(column, 0L, (a, c) -> a + c.n)").alias("all"), F.explode("column").alias("c")).select("*", "c.number", "c.n").join(F.broadcast(sizes), ["lang_id", "number"])
    each = each.withColumn("p", F.expr(f"1 + {SCALE} * {wide('n + 1')} div size")).withColumn("q", F.expr(f"1 + {SCALE} * {wide('all + 1')} div lang_size"))
    each = each.where("p > q").select("gid", "lang_id", "column", "times", F.expr("(p - q) * (p - q) div q").cast("long").alias("value"))
    best = each.withColumn("r", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("r") <= top_terms).select("gid", "lang_id", "column", "value")
    found = terms.join(best, ["lang_id", "column"]).select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return ranked.join(F.broadcast(table), "gid").select("lang", "source", "part", "item", "value", "rank")


def op13_count_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS did, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, did, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT did) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS cnt, 1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (n.n + v.v) AS p
  FROM n JOIN kept ON n.lang = kept.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
lp AS (SELECT c.lang, c.term, 1 + (CAST({SCALE} AS HUGEINT) * (sum(c.n) + 1)) // (any_value(ln.n) + any_value(v.v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce((SELECT sum(((a.p - b.p) * (a.p - b.p)) // b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
  WHERE a.lang = x.lang AND a.source = x.source AND b.source = y.source), 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN lp ON p.lang = lp.lang AND p.term = lp.term WHERE cnt > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
