"""Running sums and ranks over range partitions against plain loops."""

import random

from pyspark.sql import functions as F

from leadloom.names import free_names
from leadloom.operators import scans


def test_free_names():
    assert free_names(["Part", "key"], "part", "key", "key", "new") == ["part_", "key_", "key__", "new"]


def test_running_sums_and_ordinals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([None, 1, 2, 5]), rng.random(), "clash", 7) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, kind string, n long, w double, part string, offset_0 int").repartition(5)
    got = {r["id"]: r for r in scans.running_sums(table, [F.desc("w"), F.asc("id")], {"sum_n": F.col("n"), "sum_w": F.col("w")}, ["kind"], parts=7).collect()}
    assert set(got[0].asDict()) == {"id", "kind", "n", "w", "part", "offset_0", "sum_n", "sum_w"}
    sums: dict = {}
    for i, kind, n, w, part, offset in sorted(rows, key=lambda r: (-r[3], r[0])):
        a, b = sums.get(kind, (0, 0.0))
        sums[kind] = (a + (n or 0), b + w)
        r = got[i]
        assert r["sum_n"] == sums[kind][0] and abs(r["sum_w"] - sums[kind][1]) < 1e-9 and (r["part"], r["offset_0"]) == ("clash", 7)
    places = {r["id"]: r["place"] for r in scans.ordinals(table, [F.asc("n"), F.asc("id")], parts=6).collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert places == {r[0]: k + 1 for k, r in enumerate(order)}
    assert scans.ordinals(table.where("false"), [F.col("id")]).count() == 0


def test_hot_day_of_a_budget(spark):
    from leadloom.operators import series

    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 8 + ["d1", "d2", None]), rng.choice([None, 1, 3, 7]), rng.choice([1, 2, 9]), "clash") for i in range(700)]
    got = {r["id"]: (r["spent_before"], r["admitted"]) for r in series.admitted(spark.createDataFrame(rows, "id long, day string, cost long, estimate long, first_refused string"), "day", ["id"], "cost", "estimate", 300).collect()}
    spent, stopped = {}, set()
    for i, day, cost, estimate, _ in rows:
        before = spent.get(day, 0)
        if before + estimate > 300:
            stopped.add(day)
        assert got[i] == (before, day not in stopped)
        spent[day] = before + (cost or 0)
    assert stopped == {"hot"}


def test_sections_take_turns_and_end_at_their_caps(spark):
    from leadloom.operators import ranking

    rng = random.Random(5)
    rows = [(i, rng.choice(["hotel", "hotel", "hotel", "shop", None]), rng.choice(["buyer", "buyer", "requirement", "x"]), rng.randrange(20)) for i in range(400)]
    leads = spark.createDataFrame(rows, "id long, segment string, kind string, score int")
    turns: dict = {}
    got = {r["id"]: r["turn"] for r in ranking.diversified(leads).collect()}
    for i, segment, _, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        turns[segment] = turns.get(segment, 0) + 1
        assert got[i] == turns[segment]
    caps = {"buyer": 5, "requirement": 300}
    shown = {r["label"]: r["id"] for r in ranking.section_labels(leads, {"buyer": "L", "requirement": "R"}, caps).collect()}
    want = {f"{p}{k + 1}": r[0] for kind, p in (("buyer", "L"), ("requirement", "R")) for k, r in enumerate(sorted((r for r in rows if r[2] == kind), key=lambda r: (-r[3], r[0]))[: caps[kind]])}
    assert shown == want
    ends = {r["kind"]: r["cutoff"] for r in ranking.cutoffs(leads, caps).collect()}
    assert ends == {"buyer": sorted((r[3] for r in rows if r[2] == "buyer"), reverse=True)[4], "requirement": 0}
