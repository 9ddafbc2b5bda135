"""Operators on vectors, URLs and conversations against plain Python, and on awkward rows."""

import datetime
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import hamming, permutation_index, quotes, url_lists

D = datetime.date


def vectors(spark, n=400, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    drawn = 0.4 * centres[np.arange(n) % 6] + rng.normal(size=(n, dims))
    rows = [(i, (v / np.linalg.norm(v) * (1 + 0.2 * (i % 3))).tolist()) for i, v in enumerate(drawn)]
    rows += [(5000 + i, rows[20][1]) for i in range(60)]  # many copies of one vector
    bad = [(2000, None), (2001, [0.0] * dims), (2002, [float("nan")] * dims), (2003, [None] * dims), (2004, [float("inf")] * dims), (None, rows[0][1]), (2005, [])]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")), rows


def test_exact_codes(spark):
    table, rows = vectors(spark)
    codes = hamming.sign_codes(table, "vec_id", "embedding", 64)
    got = {}
    for r in hamming.exact_nearest(codes.where("id % 20 = 0"), codes, 64, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    extra = [(2001, [0.0] * 64), (2004, [1.0] * 64)]  # all bits unset; all bits set
    ids = np.array([i for i, _ in rows + extra])
    bits = np.array([v for _, v in rows + extra]) > 0
    for q in ids[ids % 20 == 0]:
        d = (bits != bits[ids == q]).sum(axis=1)
        want = sorted((int(x), int(i)) for x, i in zip(d, ids, strict=True) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, x) for k, (x, i) in enumerate(want)]
    assert len(got) == (ids % 20 == 0).sum()
    none = codes.where("false")
    assert hamming.exact_nearest(none, none, 64).count() == 0
    three = codes.where("id IN (0, 20, 40)")
    assert hamming.exact_nearest(three, three, 64).count() == 6


def test_masks(spark):
    for radius in (0, 1, 3, 16):
        got = spark.range(1).select(F.explode(hamming._masks(radius)).alias("x")).agg(F.count("*"), F.countDistinct("x"), F.min(F.bit_count("x")), F.max(F.bit_count("x"))).first()
        assert tuple(got) == (math.comb(16, radius), math.comb(16, radius), radius, radius)


def test_permutation_recall_and_order(spark):
    table, rows = vectors(spark, 1200)
    usable = permutation_index.usable_vectors(table, "vec_id", "embedding")
    assert usable.count() == len(rows)
    got = {}
    for r in permutation_index.nearest(usable.where("id % 20 = 0"), usable, 20, pivots=64, shelves=2, shelf_rows=400, block_queries=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        order = sorted((-s[k], int(i)) for k, i in enumerate(ids) if i != q)[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:], strict=False))
        assert all(abs(s[ids == i][0] - x) < 1e-9 for _, i, x in mine)
        hits += len({i for _, i in order} & {i for _, i, _ in mine})
    assert hits / (20 * len(got)) >= 0.9
    copies = [i for _, i, _ in sorted(got[20])]
    assert copies == list(range(5000, 5020))  # ties to the smaller id
    assert permutation_index.nearest(usable.where("false"), usable.where("false")).count() == 0
    assert permutation_index.nearest(usable.where("id = 0"), usable.where("id IN (0, 1, 2)")).count() == 2


def test_permutation_few_vectors_and_stray_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(21)] + [(100, [9.0] * 40), (101, [1.0, 2.0])]
    rows += rows[:3]  # repeated rows
    usable = permutation_index.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for r in permutation_index.nearest(usable, usable, 20, read_share=0.2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.array(x) for i, x in rows if len(x) == 16}
    assert set(got) == set(v)
    for q in v:
        want = sorted((-(v[i] * v[q]).sum(), i) for i in v if i != q)
        assert [(r, i) for r, i, _ in sorted(got[q])] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert all(abs(x + w) < 1e-12 for (_, _, x), (w, _) in zip(sorted(got[q]), want, strict=True))


def test_footrule():
    rng = np.random.default_rng(5)
    one, two = (np.array([rng.permutation(30) for _ in range(n)], np.int16) for n in (4, 7))
    assert (permutation_index.footrule(one.T, two.T) == np.abs(one[:, None].astype(int) - two[None]).sum(axis=2)).all()


ENTRIES = [
    ("block", "bad.example", "add", D(2024, 1, 10)),
    ("block", "bad.example", "add", D(2024, 1, 12)),
    ("block", "bad.example", "remove", D(2024, 2, 1)),
    ("block", "bad.example", "add", D(2024, 3, 1)),
    ("block", "x.example/ads", "add", D(2024, 1, 1)),
    ("allow", "good.bad.example", "add", D(2024, 1, 20)),
    ("block", "same.example", "add", D(2024, 1, 5)),
    ("block", "same.example", "remove", D(2024, 1, 5)),
    (None, "bad.example", "add", D(2024, 1, 1)),
    ("block", "bad.example", "rename", D(2023, 1, 1)),
]
CAPTURES = [
    (1, "http://bad.example/a", D(2024, 1, 9)),
    (2, "https://u:p@Sub.Bad.example:80/a?q#f", D(2024, 1, 10)),
    (3, "http://bad.example", D(2024, 1, 31)),
    (4, "http://bad.example", D(2024, 2, 1)),
    (5, "http://bad.example", D(2024, 9, 1)),
    (6, "http://good.bad.example/", D(2024, 1, 25)),
    (7, "http://x.example/ads/1", D(2024, 5, 5)),
    (8, "http://x.example/adsense", D(2024, 5, 5)),
    (9, None, D(2024, 5, 5)),
    (10, "not a url", D(2024, 5, 5)),
    (11, "http://bad.example", None),
    (12, "http://same.example", D(2024, 1, 6)),
    (3, "http://bad.example", D(2024, 1, 31)),
]


def brute_verdict(url, day):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m or day is None:
        return (0, 0, False, "")
    host, steps = m[1].lower(), [s for s in (m[2] or "").split("/") if s]
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {host + "/" + "/".join(steps[:j]) for j in range(1, len(steps) + 1)}
    active = []
    for name, rule in {(e[0], e[1]) for e in ENTRIES if e[0]}:
        days = {}
        for e in ENTRIES:
            if (e[0], e[1]) == (name, rule) and e[2] in ("add", "remove") and e[3] <= day:
                days[e[3]] = days.get(e[3], True) and e[2] == "add"
        if days and days[max(days)] and rule in keys:
            active.append(f"{name}:{rule}")
    n_block, n_allow = (sum(a.startswith(x) for a in active) for x in ("block", "allow"))
    return (n_block, n_allow, n_block > 0 and n_allow == 0, ",".join(sorted(active)))


def test_temporal_lists(spark, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "list string, rule string, action string, date date").withColumn("month", F.lit("clash"))
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched date").withColumn("rule", F.lit("clash"))
    want = sorted((p, *brute_verdict(u, d)) for p, u, d in CAPTURES)
    read = lambda: sorted((r["page_id"], r["n_block"], r["n_allow"], r["blocked"], r["rules"]) for r in url_lists.temporal_list_join(captures, entries).collect())
    assert read() == want and {w[0] for w in want if w[3]} == {2, 3, 5, 7}
    monkeypatch.setattr(url_lists, "BROADCAST_INTERVALS", 0)
    assert read() == want
    assert url_lists.temporal_list_join(captures.where("false"), entries).count() == 0
    assert not any(r["blocked"] for r in url_lists.temporal_list_join(captures, entries.where("false")).collect())


MESSAGES = [
    (1, 0, "u", "Hello there friend.\nHow are you today?"),
    (1, 1, "a", "> Hello there friend.\n> How are you today?\nI am fine, thanks a lot."),
    (1, 2, "u", ">> Hello there friend.\n>> how ARE you today?\n> I am fine, thanks a lot.\nGood to hear that."),
    (1, 3, "a", "> How are you today?\nStill fine"),
    (1, 4, "x", "> > I am fine, thanks a lot.\n> Good to hear that.\nyes\n> unknown words here\nno"),
    (2, 0, "u", None),
    (2, 1, "u", "> nothing known here\n\nok"),
    (2, 2, "u", "> Hello there friend."),
    (None, 3, "u", "x"),
    (1, None, "u", "> Hello there friend."),
    (1, 3, "a", "> How are you today?\nStill fine"),
]


def test_quotations(spark):
    rows = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).withColumn("level", F.lit(2))
    out = quotes.link_quotations(rows).collect()
    got = {(r["conv_id"], r["turn"]): (r["text"], r["n_passages"], r["n_linked"], r["reply_to"], r["root"], r["depth"]) for r in out}
    assert got[1, 0] == ("Hello there friend.\nHow are you today?", 0, 0, None, 0, 0)
    assert got[1, 1] == ("I am fine, thanks a lot.", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("Good to hear that.", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("Still fine", 1, 1, 0, 0, 1)
    assert got[1, 4] == ("yes\nno", 3, 2, 2, 0, 3)
    assert got[2, 1] == ("ok", 1, 0, None, 1, 0) and got[2, 2][3] is None and got[2, 0][0] == ""
    assert got[1, None][3] is None and got[None, 3][0] == "x"
    assert len(out) == len(MESSAGES)
    places = [(r["conv_id"], r["root"], r["turn"]) for r in out if r["conv_id"] == 1 and r["turn"] is not None]
    assert places == sorted(places)
    assert quotes.link_quotations(rows.where("false")).count() == 0


def brute_links(messages):
    """(conv_id, turn) -> (body, passages, linked, reply_to, root, depth), by plain loops."""
    normal = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()

    def units(lines):
        joined = "\n".join(lines)
        found = [(3, normal(joined)), *((2, normal(p)) for p in re.split(r"\n\s*\n", joined)), *((1, normal(x)) for x in lines if len(normal(x).split(" ")) >= quotes.LINE_WORDS)]
        return {u for u in found if u[1]}

    parsed = {}
    for conv, turn, _, text in messages:
        runs = []
        for line in text.split("\n"):
            m = re.match(r"\s*((?:>\s?)+)", line)
            level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(rest)
            else:
                runs.append((level, [rest]))
        body = "\n".join(x for level, lines in runs if not level for x in lines).strip("\n \t\r")
        said = {h for level, lines in runs if not level for _, h in units(lines)} | {normal(body)}
        parsed[conv, turn] = body, said, [(level, units(lines)) for level, lines in runs if level]
    out = {}
    for conv, turn in sorted(parsed):
        body, _, passages = parsed[conv, turn]
        replies = []
        for level, asked in passages:
            hits = []
            for weight, h in asked:
                first = min((t for c, t in parsed if c == conv and h in parsed[c, t][1]), default=turn)
                if first < turn:
                    hits.append((weight, first))
            if hits:
                replies.append((level, -max(hits)[1]))
        to = -min(replies)[1] if replies else None
        root, depth = (out[conv, to][4], out[conv, to][5] + 1) if replies else (turn, 0)
        out[conv, turn] = body, len(passages), len(replies), to, root, depth
    return out


def test_quotations_against_plain_loops(spark):
    rng = random.Random(3)
    words = "rain wind hill road lamp door".split()
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(8):
            lines = []
            for _ in range(rng.randint(1, 4)):
                kind = rng.random()
                if kind < 0.5 and texts:
                    lines += [("> " if rng.random() < 0.7 else ">") + x for x in rng.choice(texts).split("\n")[: rng.randint(1, 3)]]
                elif kind < 0.6:
                    lines.append("")
                else:
                    lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))))
            texts.append("\n".join(lines))
            rows.append((conv, turn, "u", texts[-1]))
    out = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["text"], r["n_passages"], r["n_linked"], r["reply_to"], r["root"], r["depth"]) for r in out}
    want = brute_links(rows)
    assert got == want and sum(w[2] for w in want.values()) > 50


def test_message_of_very_many_lines(spark):
    lines = [f"{'> ' * (i % 3)}line number {i} of them" for i in range(20_000)]
    out = quotes.link_quotations(spark.createDataFrame([(1, 0, "u", "\n".join(lines))], "conv_id long, turn long, role string, text string")).first()
    assert out["n_passages"] == 13_333 and out["text"].count("\n") == 6666


def test_urls_of_very_many_segments(spark):
    entries = spark.createDataFrame([("block", "a.example/x/y", "add", D(2024, 1, 1)), ("block", "b.example", "add", D(2024, 1, 1))], "list string, rule string, action string, date date")
    urls = ["http://a.example/x/y" + "/z" * 100_000, "http://" + "s." * 50_000 + "b.example/", "http://a.example/x"]
    got = url_lists.temporal_list_join(spark.createDataFrame([(i, u, D(2024, 2, 2)) for i, u in enumerate(urls)], "page_id long, url string, fetched date"), entries).collect()
    assert sorted((r["page_id"], r["rules"]) for r in got) == [(0, "block:a.example/x/y"), (1, "block:b.example"), (2, "")]


def test_long_reply_chain(spark):
    rows = [(7, 0, "u", "opening words of message zero")]
    for i in range(1, 40):
        rows.append((7, i, "u", f"> {rows[-1][3].splitlines()[-1]}\nanswer number {i} with several words"))
    out = {r["turn"]: (r["reply_to"], r["root"], r["depth"]) for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[i] == (i - 1, 0, i) for i in range(1, 40))
