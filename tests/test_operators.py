"""Operators against plain Python versions, and edge cases."""

import random

from pyspark.sql import functions as F

from leadloom.config import Profile
from leadloom.operators import dedupe, digest, ranking, scoring, series


def test_diversified_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randint(0, 3)) for i in range(60)]
    got = [r["id"] for r in ranking.diversified(spark.createDataFrame(rows, "id int, segment string, score int")).orderBy(*ranking.diversified_order()).collect()]
    left, used, want = sorted(rows, key=lambda r: (-r[2], r[0])), {}, []
    while left:
        tie = [r for r in left if r[2] == left[0][2]]
        pick = min(tie, key=lambda r: (used.get(r[1], 0), tie.index(r)))
        used[pick[1]] = used.get(pick[1], 0) + 1
        want.append(pick[0])
        left.remove(pick)
    assert got == want


def test_cap_keeps_a_share_of_every_source(spark):
    rows = [(i, "hotel", "big", 90) for i in range(50)] + [(100 + i, "hotel", "small", 10) for i in range(5)]
    out = ranking.capped(spark.createDataFrame(rows, "id int, segment string, source string, score int"), 20).collect()
    assert len(out) == 20 and sum(r["source"] == "small" for r in out) == 4


def test_scores(spark):
    profile = Profile(city="Bengaluru", state="Karnataka")
    today = F.lit("2026-09-14").cast("date")
    row = ("hotel", "+91", None, "w", None, "bengaluru", "a", None, "new")
    schema = "segment string, phone string, email string, website string, why_now_date date, city string, address string, lat double, status string"
    got = scoring.score_leads(spark.createDataFrame([row], schema), profile, today).collect()[0]
    assert (got["score"], got["p_segment"], got["p_contact"], got["p_recency"], got["p_city"], got["p_detail"]) == (84, 30, 30, 4, 10, 10)
    req = spark.createDataFrame([("2026-09-20", "within", "+91", "e@x", None, "elsewhere", None, "new")], "deadline string, quantity_fit string, phone string, email string, contact_name string, city string, state string, status string")
    got = scoring.score_requirements(req.withColumn("deadline", F.col("deadline").cast("date")), profile, today).collect()[0]
    assert got["score"] == 85


def test_appends_are_keyed(spark):
    log = spark.createDataFrame([("a", "1")], "type string, key string")
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "2", 3), ("a", None, 4), ("a", None, 5)], "type string, key string, n int")
    assert sorted(r["n"] for r in dedupe.append_keyed(log, new, ["n"]).collect()) == [2, 4, 5]


def test_spellings(spark):
    rows = spark.createDataFrame([("Bengaluru",), ("Bengaluru",), ("bengaluru",), ("Bengaluru,",), (None,)], "c string")
    from leadloom.functions import strings

    got = series.count_by_spelling(rows, F.col("c"), strings.city_key(F.col("c"))).collect()
    assert [(r["label"], r["n"]) for r in got] == [("Bengaluru", 4)]


def test_price_moves(spark):
    rows = spark.createDataFrame([("g", "2026-09-08", 14000.0), ("g", "2026-09-10", 15000.0), ("g", "2026-09-01", 12000.0), ("t", "2026-09-09", 1700.0)], "item string, day string, p double").withColumn("day", F.col("day").cast("date"))
    got = {r["item"]: (r["mean"], r["readings"], r["before"], r["delta_pct"]) for r in series.weekly_moves(rows, "item", "day", F.col("p"), F.lit("2026-W37")).collect()}
    assert got == {"g": (14500, 2, 12000, 21), "t": (1700, 1, None, None)}


def test_later_failure_corrects_once(spark):
    rows = spark.createDataFrame([("d", 1, "sent"), ("d", 2, "failed"), ("d", 3, "sent"), ("e", 1, "failed"), ("e", 2, "sent")], "day string, n int, status string")
    got = {r["day"]: (r["state"], r["corrected"]) for r in series.delivery_fold(rows, "day", ["n"], "status").collect()}
    assert got == {"d": ("failed later", True), "e": ("sent", False)}


def test_robots(spark):
    rules = spark.createDataFrame([("/a", False), ("/a/b", True), ("/*.pdf$", False)], "pattern string, allow boolean")
    paths = spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/z",), ("/z.pdf",), ("/z.pdf.html",)], "path string")
    assert {r["path"]: r["allowed"] for r in series.longest_rule(paths, rules).collect()} == {"/a/x": False, "/a/b/c": True, "/z": True, "/z.pdf": False, "/z.pdf.html": True}


def test_digest_gives_up_in_its_order(spark):
    rows = [(f"{p}{i}", k, "Pune", f"{p}{i} " + "n" * 60, 50 - i, "new", "w" * 50, "c" * 30, "hotel") for k, p in (("requirement", "r"), ("tender", "b"), ("registration", "g")) for i in range(6)]
    rows += [("q", "buyer", None, None, None, "new", None, None, None), ("old", "buyer", "Goa", "x", 9, "won", None, None, None)]
    leads = spark.createDataFrame(rows, "id string, kind string, city string, name string, score int, status string, why_now string, contact string, segment string")
    caps = {"requirements": 4, "buyers": 3, "registrations": 2}

    def at(limit, city="Pune"):
        return next(r for r in digest.digests(leads, caps, "T", limit).collect() if r["city"] == city)

    def plan(r):
        return [sum(x.startswith(letter) for x in r["index"]) for letter in "RLG"], r["r_lines"], r["b_lines"]

    plans = [plan(at(limit)) for limit in (150, 350, 600, 800, 1100, 1500, 1900)]
    ordered = [(4 - n[0], 3 - rl, 3 - n[1], 2 - n[2], 3 - bl) for n, rl, bl in plans]
    assert ordered == sorted(ordered, reverse=True) and ordered[-1] == (0, 0, 0, 0, 0) and ordered[0][0] == 4
    for limit in (1200, 600, 120, 20):
        assert len(at(limit)["text"]) <= limit
    full = at(1900)
    assert full["index"]["R1"] == "r0" and (full["shown"], full["considered"], full["with_contact"]) == (9, 18, 6) and "REQUIREMENTS POSTED (4 of 6)" in full["text"]
    assert digest.NO_LEADS in at(500, "Goa")["text"] and at(500, "Goa")["index"] == {}
    assert "L1  (?)" in at(500, "")["text"] and digest.NO_REQUIREMENT in at(500, "")["text"]
    assert digest.digests(leads.limit(0), caps, "T").count() == 0


def test_digest_files(spark, tmp_path):
    leads = spark.createDataFrame([(i, "buyer", f"C{i % 2}", f"n{i}", i, "new", "hotel") for i in range(40)], "id int, kind string, city string, name string, score int, status string, segment string")
    digest.write_digests(leads, {"buyers": 5}, "T", str(tmp_path))
    sheet = "".join(p.read_text() for p in sorted((tmp_path / "full" / "city=C1").glob("part-*.txt")))
    assert [line.split(" ")[1] for line in sheet.splitlines()] == [f"n{i}" for i in range(39, 0, -2)]
    assert spark.read.text(str(tmp_path / "text")).where("city = 'C0'").first()["value"].startswith("T - C0")
    assert spark.read.json(str(tmp_path / "index")).where("label = 'L1'").count() == 2


def test_accuracy_counts_missing_as_wrong(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string")
    results = spark.createDataFrame([(1, "x", 0), (1, "a", 1)], "id int, f string, o int")
    got = series.accuracy(cases, results, "id", ["f"], "o").collect()[0]
    assert (got["cases"], got["right"]) == (2, 1)
