"""Resolution against the rule applied row by row."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadloom import config as C
from leadloom.operators import resolve

SCHEMA = ", ".join(f"{f} string" for f in resolve.FIELDS) + ", ord long"
NAMES = {"Ann": "ann", "Ann & Co": "ann", "Bob Ltd": "bob", "Bob": "bob", "Cyril": "cyril", "...": "", None: ""}


def name_key(name):
    return NAMES[name] if name in NAMES else name.lower()


def plain_fold(register, incoming):
    """One pass in order; a dict for each lead that holds the rows it took in, and its fields worked out from them anew."""
    leads, phones, names = {}, {}, {}

    def first(rows, c):
        return next((r[c] for r in rows if r[c]), None)

    def longest(rows, c):
        return max((r[c] for r in rows if r[c]), key=len, default=None)

    def point(lead):
        rows = lead["rows"]
        if rows[0]["kind"] not in resolve.DOCUMENT_KINDS:
            if first(rows, "phone"):
                phones[first(rows, "phone")] = lead["id"]
            if name_key(longest(rows, "name")):
                names[name_key(longest(rows, "name")), (first(rows, "city") or "").lower()] = lead["id"]

    for is_new, row in [(False, r) for r in register] + [(True, r) for r in incoming]:
        target = None
        if is_new:
            if row["id"] in leads:
                target = row["id"]
            elif row["kind"] not in resolve.DOCUMENT_KINDS:
                target = phones.get(row["phone"]) if row["phone"] else None
                if target is None and name_key(row["name"]):
                    target = names.get((name_key(row["name"]), (row["city"] or "").lower()))
        if target is None:
            target = row["id"]
            leads[target] = {"id": target, "rows": [], "is_new": is_new}
        leads[target]["rows"].append(row)
        point(leads[target])

    out = {}
    for key, lead in leads.items():
        rows = lead["rows"]
        reasons = sorted((r for r in rows if r["why_now"]), key=lambda r: r["why_now_date"] or "")
        latest = [r for r in reasons if (r["why_now_date"] or "") == (reasons[-1]["why_now_date"] or "")][-1] if reasons else None
        seen = lambda c: [r[c] for r in rows if r[c]]  # noqa: E731, B023
        out[key] = {
            "name": longest(rows, "name"), "address": longest(rows, "address"), **{c: first(rows, c) for c in ("city", "phone", "email")},
            "segment": max(rows, key=lambda r: C.SEGMENT_POINTS.get(r["segment"], 0))["segment"],
            "why_now": latest["why_now"] if latest else None, "why_now_date": (latest["why_now_date"] if latest else first(rows, "why_now_date")),
            "first_seen": min(seen("first_seen"), default=None), "last_seen": max(seen("last_seen"), default=None), "status": rows[0]["status"], "source": rows[0]["source"],
            "sources": list(dict.fromkeys(r["source"] for r in rows)), "n_updated": sum(r["id"] == key for r in rows[1:]), "n_duplicate": sum(r["id"] != key for r in rows[1:]), "is_new": lead["is_new"],
            "merged": set(r["id"] for r in rows[1:] if r["id"] != key),
        }
    return out


def lead(rng, i, ids, phones, names, hot=0.0):
    row = dict.fromkeys(resolve.FIELDS)
    row |= {"id": rng.choice(ids), "kind": rng.choice(["buyer"] * 5 + ["requirement"]), "segment": rng.choice([*C.SEGMENT_POINTS, "odd", None]), "name": rng.choice(names), "city": rng.choice(["X", "Y", None]), "phone": rng.choice(phones), "source": rng.choice("stu"), "ord": i}
    row |= {"address": rng.choice([None, "a", "bb", "cc"]), "email": rng.choice([None, "e", "f"]), "status": rng.choice(["new", "won"]), "first_seen": rng.choice([None, "1", "2"]), "last_seen": rng.choice([None, "1", "2"])}
    if rng.random() < 0.5:
        row |= {"why_now": f"w{i}", "why_now_date": rng.choice([None, "1998-01-01", "1998-01-02"])}
    if rng.random() < hot:
        row |= {"id": f"own{i}", "kind": "buyer", "phone": "hot", "name": rng.choice([None, f"Leaf {'x' * rng.randint(0, 9)} {i}"])}
    elif rng.random() < hot:
        row |= {"id": f"own{i}", "kind": "buyer", "phone": rng.choice([None, f"p-{i}"]), "name": rng.choice(["Bob", "Bob Ltd"]), "city": "X"}
    elif rng.random() < hot:
        row |= {"id": "a1", "name": None, "phone": None}
    return row


def resolved(spark, register, incoming):
    df = lambda rows: spark.createDataFrame([tuple(r[f] for f in (*resolve.FIELDS, "ord")) for r in rows], SCHEMA)
    out = resolve.resolve(df(register), df(incoming))
    got = {r["id"]: r.asDict() for r in out.leads.collect()}
    for r in got.values():
        r["merged"] = set()
    for r in out.links.collect():
        got[r["lead_id"]]["merged"].add(r["merged_id"])
    return got


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.0), (2, 0.0), (3, 0.5), (4, 0.5), (5, 0.8), (6, 0.3)])
def test_leads_equal_those_of_one_pass(spark, seed, hot):
    rng = random.Random(seed)
    ids, phones = [a + b for a in "abcdef" for b in "12"] + [f"z{i}" for i in range(20)], ["p1", "p2", "p3", "hot", None, None, ""]
    register, seen = [], set()
    for i in range(12):
        r = lead(rng, i, ids, phones, list(NAMES))
        if r["id"] not in seen:
            seen.add(r["id"])
            register.append(r)
    incoming = [lead(rng, i, ids, phones, list(NAMES), hot) for i in range(60)]
    got, want = resolved(spark, register, incoming), plain_fold(register, incoming)
    assert got.keys() == want.keys()
    for key, w in want.items():
        alone = not w["n_updated"] + w["n_duplicate"]
        assert {c: got[key][c] or (None if alone else got[key][c]) for c in w if c not in ("n_updated", "n_duplicate", "is_new", "merged")} == {c: w[c] for c in w if c not in ("n_updated", "n_duplicate", "is_new", "merged")}, key
        assert [got[key][c] for c in ("n_updated", "n_duplicate", "is_new", "merged")] == [w[c] for c in ("n_updated", "n_duplicate", "is_new", "merged")], key
        assert got[key]["n_merged"] == len(w["merged"])


def _hot(spark, kinds):
    """(rows decided in the largest component, resolution): a third of 9,000 rows share each key of `kinds`, the others meet in threes; ten rows tie them to the largest component."""
    k, n, text = F.col("n") % 3, F.col("n"), F.col("n").cast("string")
    of = {"phone": k == 0, "name": k == 1, "id": k == 2}
    hot = F.lit(False)
    for kind in kinds:
        hot |= of[kind]
    three = (n / 9).cast("int").cast("string")
    tie = n % 900 == 7
    made = {f: F.lit(None).cast("string") for f in resolve.FIELDS}
    made |= {
        "id": F.when(hot & of["id"], "x").otherwise(F.concat(F.lit("r"), text)), "kind": F.lit("buyer"), "source": F.lit("s"), "city": F.lit("X"),
        "phone": F.when(hot & of["phone"], "p").when(~hot & ~tie, F.concat(F.lit("p"), three)),
        "name": F.when(hot & of["name"], "Bob").when(hot & of["phone"], F.concat(F.lit("leaf "), text)).when(tie, "Bob").when(~hot, F.concat(F.lit("name "), three)),
    }
    new = spark.range(9000).select(F.col("id").alias("n")).select(*(c.alias(f) for f, c in made.items()), (n + 10).alias("ord"))
    r = lambda **kw: dict.fromkeys(resolve.FIELDS) | {"kind": "buyer", "source": "s", "city": "X"} | kw
    old = spark.createDataFrame([tuple(x[f] for f in (*resolve.FIELDS, "ord")) for x in (r(id="x", phone="p", ord=1), r(id="y", name="Bob", phone="p", ord=2))], SCHEMA)
    seen, decide = [], resolve._decide_runs
    resolve._decide_runs = lambda runs: seen.append(runs) or decide(runs)
    try:
        out = resolve.resolve(old, new)
    finally:
        resolve._decide_runs = decide
    rows = [tuple(x) for x in old.union(new).orderBy("ord").collect()]
    as_dicts = [dict(zip((*resolve.FIELDS, "ord"), x, strict=True)) for x in rows]
    want = plain_fold(as_dicts[:2], as_dicts[2:])
    got = {x["id"]: x for x in out.leads.collect()}
    assert {i: (x["n_updated"], x["n_duplicate"], x["name"], x["n_merged"]) for i, x in got.items()} == {i: (x["n_updated"], x["n_duplicate"], x["name"], len(x["merged"])) for i, x in want.items()}
    return seen[0].groupBy("comp").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("kind", ["phone", "name", "id"])
def test_a_key_of_a_third_of_all_rows_leaves_a_few_runs(spark, kind):
    assert _hot(spark, [kind]) < 60


def test_three_such_keys_in_turns_are_decided_row_by_row(spark):
    """Each row moves the phone's lead, so no row can be left out; what is decided are keys, not leads."""
    assert _hot(spark, ["phone", "name", "id"]) > 9000


def test_rows_without_ids_repeated_ids_and_empty_tables(spark):
    r = lambda **kw: dict.fromkeys(resolve.FIELDS) | {"kind": "buyer", "source": "s", "ord": 1} | kw
    df = lambda rows: spark.createDataFrame([tuple(x[f] for f in (*resolve.FIELDS, "ord")) for x in rows], SCHEMA)
    none = df([])
    assert resolve.resolve(none, none).leads.count() == 0
    out = resolve.resolve(df([r(id="a", phone="1"), r(id="a", phone="2", ord=2)]), df([r(phone="1"), r(), r(ord=3)]))
    rows = out.leads.collect()
    assert sorted((x["id"] or "", x["phone"] or "", x["n_duplicate"]) for x in rows) == [("", "", 0), ("", "", 0), ("a", "2", 1)]


def test_components_are_decided_across_batches():
    """A component may be cut by a batch; the next one starts anew, whatever keys it shares."""
    row = lambda comp, rid, incoming: dict(comp=comp, run=f"row {rid}", id=f"i{rid}", document=False, phone="p", name_key=None, name_size=0, city_key="", has_city=False, incoming=incoming, ord=rid, rid=rid)
    rows = [row(1, 1, False), row(1, 2, True), row(1, 3, True), row(2, 4, True), row(2, 5, True)]
    for cuts in ([5], [1, 2, 2], [3, 2]):
        batches, at = [], 0
        for n in cuts:
            batches.append(pd.DataFrame(rows[at : at + n]))
            at += n
        got = pd.concat(list(resolve._decide(iter(batches))))
        assert [tuple(r) for r in got[["comp", "run", "lead", "same"]].itertuples(index=False)] == [(1, "row 1", 1, True), (1, "row 2", 1, False), (1, "row 3", 1, False), (2, "row 4", 4, True), (2, "row 5", 4, False)]


def test_only_keys_that_an_incoming_row_bears_decide(spark):
    rows = [(1, False, "a", "p", "n"), (2, False, "b", "p", "n"), (3, False, "b", None, "m"), (4, True, "c", None, "m"), (5, True, "d", "q", None)]
    table = spark.createDataFrame(rows, "rid long, incoming boolean, id string, phone string, name_key string")
    assert sorted(map(tuple, resolve.deciding_keys(table).collect())) == [(2, "i:b"), (3, "i:b"), (3, "n:m"), (4, "n:m")]
