"""Lexical search, mixing and the divergence audit against plain Python, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from leadloom.llm import divergence, lexical, mixing

DOCS = "doc_id long, text string, lang string, source string, uid string, score double, number int, size string, place int"


def table(spark, rows, clash=("x", 0.5, 7, "y", 3)):
    return spark.createDataFrame([(*r, *clash) for r in rows], DOCS)


def documents(seed, n=160):
    rng = random.Random(seed)
    words = ["der", "Die", "das", "ÉTÉ", "été", "x1", "42", "naïve", "über", "a-b", "foo_bar", "ZZ", "日本", "q", "end."]
    weights = [30, 20, 20, 3, 3, 5, 5, 2, 2, 6, 4, 2, 1, 8, 9]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", ", ", "　"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 10, 40])))
        rows.append((i * 3 % n, text, rng.choice(["de", "de", "fr", None, ""]), rng.choice(["hot", "hot", "hot", "b", "c", "d", None, ""])))
    rows += [(900, None, "de", "hot"), (901, "", "de", "only-empty"), (902, "\t \n", "xx", "one"), (None, "das das Die", "de", "b"), (903, "das ZZ 42", "de", "b"), (903, "das ZZ 42", "de", "b")]
    rows += [(904 + k, "das ZZ 42 q", "de", "hot") for k in range(30)]  # copies of one text
    return rows


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


# ---------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    held = [(doc_id, terms_of(text)) for doc_id, text, *_ in docs]
    held = [(doc_id, t) for doc_id, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(term for _, t in held for term in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, t in held:
            tf = Counter(t)
            m = 25 + (75 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms_of(text) if tf[x])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes,block_bytes", [(300, 100), (10**6, 10**6)])
def test_lexical_search(spark, shard_bytes, block_bytes):
    docs = documents(1)
    items = [(1, "Das Die été"), (2, None), (3, ""), (4, "nothing here"), (5, "zz ZZ zz 42"), (6, "q q q der über 日本"), (6, "naïve"), (None, "x1"), (7, "-_-"), (8, "das " * 500)]
    index = lexical.build_index(table(spark, docs).repartition(3), shard_bytes=shard_bytes)
    assert (index.shards.count() > 5) == (shard_bytes == 300)
    asked = spark.createDataFrame([(*i, 1, "c") for i in items], "item_id long, text string, rank int, uid string").repartition(2)
    got = sorted((tuple(r) for r in lexical.search(index, asked, 10, block_bytes=block_bytes).collect()), key=repr)
    assert got == brute_search(docs, items, 10)


def test_lexical_nothing(spark):
    none = table(spark, documents(1)).where("false")
    asked = spark.createDataFrame([(1, "das")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), asked).count() == 0
    assert lexical.search(lexical.build_index(table(spark, [(1, "...", "de", "a"), (2, None, None, None)])), asked).count() == 0
    index = lexical.build_index(table(spark, [(1, "das", "de", "a")]))
    assert lexical.search(index, asked.where("false")).count() == 0


def test_lexical_long_text(spark):
    long = ("das " * 20 + "rare ") * 40_000 + "w" * 2_000_000
    docs = [(1, long), (2, "rare das"), (3, "das")] + [(10 + k, "die") for k in range(5)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((tuple(r) for r in lexical.search(index, spark.createDataFrame([(1, "rare das"), (2, "w" * 2_000_000)], "item_id long, text string")).collect()), key=repr)
    assert got == brute_search(docs, [(1, "rare das"), (2, "w" * 2_000_000)], 10)


def test_best_is_safe_with_ties():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.integers(0, 4, rng.integers(1, 30))
        k = int(rng.integers(1, 12))
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:k]
        assert sorted(lexical.best(scores, k).tolist()) == sorted(i for _, i in want)


# ---------------------------------------------------------------------------------------


def fill(sizes, weights, budget, epochs):
    """Targets by rounds: clamp, share the excess again by weight, until none is above."""
    clamped = set()
    while True:
        rest = budget - sum(epochs * sizes[i] for i in clamped)
        total = sum(w for i, w in enumerate(weights) if i not in clamped)
        target = [Fraction(epochs * s) if i in clamped else rest * weights[i] / total for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(target) if t > epochs * sizes[i]}
        if not above:
            return target
        clamped |= above


def brute_mix(docs):
    order = lambda s: (s is None, (s or "").encode())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(d, s, size(t), hashlib.md5(f"{mixing.SEED}:{d if d is not None else t or ''}".encode()).hexdigest()) for d, t, _, s in docs]
    sources = sorted({s for _, s, _, _ in rows}, key=order)
    sizes = [sum(n for _, s, n, _ in rows if s == x) for x in sources]
    targets = fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))], Fraction(3 * sum(sizes), 2), 2)
    out = []
    for source, total, target in zip(sources, sizes, targets, strict=True):
        wanted = math.floor(target + Fraction(1, 2))
        whole, extra = divmod(wanted, total) if total else (0, 0)
        for d, _, n, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[2])):
            more = min(n, extra)
            extra -= more
            out.append((d, n, total, float(target), n * whole + more, source, whole))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [2, 3])
def test_mixing(spark, seed):
    docs = documents(seed)
    docs += [(2000 + k, "w " * 3000, "de", "giant") for k in range(3)] + [(3000 + k, "one", "de", f"s{k:03d}") for k in range(40)]
    docs += [(None, "the same row", "de", "hot")] * 50
    random.Random(seed).shuffle(docs)
    out = mixing.mix_sources(table(spark, docs).repartition(4)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute_mix(docs)
    taken = defaultdict(int)
    for r in out:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 0.5 for r in out)


def test_targets_by_rounds(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = [int(10 ** rng.uniform(0, 9)) for _ in range(rng.choice([1, 2, 17, 60]))]
        rows = [(f"s{i:03d}", n) for i, n in enumerate(sizes)]
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"), (2, 5, 3, 1), 130, 3).collect()}
        want = fill(sizes, [(2, 5, 3, 1)[i % 4] for i in range(len(sizes))], Fraction(13 * sum(sizes), 10), 3)
        assert all(got[s] == pytest.approx(float(t), rel=1e-15) for (s, _), t in zip(rows, want, strict=True))


def test_mixing_nothing(spark):
    assert mixing.mix_sources(table(spark, documents(1)).where("false")).count() == 0
    rows = mixing.mix_sources(table(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixing_is_native(spark):
    plan = mixing.mix_sources(table(spark, documents(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------------------------------


def brute_divergence(docs, least=3, top=200):
    groups, df, lang_sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        lang_sources[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in lang_sources.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda counts, kept=kept: {t: 1 + (10**9 * (counts[t] + 1)) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(groups[lang, s]) for s in sources}
        every = Counter()
        for s in sources:
            every.update(groups[lang, s])
        q = share(every)
        value = lambda a, b: ((a - b) * (a - b)) // b
        for s in sources:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-value(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,least,top", [(512, 3, 200), (2, 3, 3), (1, 1, 2)])
def test_divergence(spark, monkeypatch, block, least, top):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    docs = documents(4)
    rng = random.Random(6)
    docs += [(5000 + i, f"t{chr(97 + i % 26)} t{chr(97 + i % 7)} u{chr(97 + i % 26)}", "de", rng.choice("bcd")) for i in range(120)]
    docs += [(6000 + i, "a b c", "en", "s") for i in range(2)] + [(6010, "a b", "en", "t"), (6011, None, "en", "v"), (6012, "Z" * 100_000 + " a", "en", "s")]
    got = sorted(tuple(r) for r in divergence.source_divergence(table(spark, docs).repartition(5), least, top).collect())
    assert got == brute_divergence(docs, least, top)


def test_divergence_nothing(spark):
    assert divergence.source_divergence(table(spark, documents(1)).where("false")).count() == 0
    rows = [(1, "a b", "de", "x"), (2, None, "de", "y"), (3, "a", "fr", None)]
    got = sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows)).collect())
    assert got == [("de", "x", "pair", "y", 0, 1), ("de", "y", "pair", "x", 0, 1)]  # no term is kept


def test_shares_of_wide_counts():
    counts, sizes = np.array([0, 5, 9_000_000_000, 4 * 10**12]), np.array([10, 7, 10**13, 10**13])
    assert divergence.shares(counts, sizes).tolist() == [1 + (10**9 * (c + 1)) // s for c, s in zip(counts.tolist(), sizes.tolist(), strict=True)]
