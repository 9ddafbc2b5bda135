"""Registries, statuses and removals at their edges: empty tables, nulls, repeats, labels that lead nowhere."""

from pyspark.sql import functions as F

from leadloom.config import Profile
from leadloom.operators import changes, openings
from leadloom.sources import candidates

FIELDS = {"name": "string", "url": "string", "buys": "string"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_registry_shapes(spark):
    bodies = spark.createDataFrame(
        [('[{"name": "A", "url": "u", "more": 1}, {"name": "", "url": "v"}, {"url": "w"}]',), ('{"entries": [{"name": "B", "url": "x", "buys": "onions"}]}',), ("{}",), ("broken",), (None,)], "body string"
    )
    assert rows(candidates.registry(bodies, FIELDS)) == [("A", "u", None), ("B", "x", "onions")]
    assert candidates.registry(bodies.limit(0), FIELDS).count() == 0


def test_latest_digest_of_no_files(spark):
    files = spark.createDataFrame([("d/1998-08-01.txt",), ("d/1998-08-02.index.json",), ("d/1998-08-01.prices.txt",), ("d/notes.txt",), (None,)], "path string")
    assert sorted(r["kind"] for r in candidates.latest_digest(files).collect()) == ["prices.txt", "txt"]
    assert candidates.latest_digest(files.where("path LIKE '%notes%'")).count() == 0


def test_statuses_by_label_and_id(spark):
    leads = spark.createDataFrame([("a", "new", None), ("b", "won", "old")], "id string, status string, notes string")
    index = spark.createDataFrame([("L1", "a")], "label string, id string")
    said = [("l1", "contacted", " called ", "1998-08-01", 1), ("a", "quoted", None, "1998-08-01", 2), ("L9", "won", "x", "1998-08-01", 3), ("b", "sold", "x", "1998-08-01", 4), (None, "won", "x", "1998-08-01", 5)]
    commands = spark.createDataFrame(said, "ref string, to string, note string, at string, ord int").withColumn("at", F.col("at").cast("timestamp"))
    events = changes.status_events(leads, changes.resolve_refs(commands, index))
    assert rows(events.select("lead", "from", "to", "note")) == [("a", "contacted", "quoted", None), ("a", "new", "contacted", "called")]
    assert rows(changes.with_statuses(leads, events)) == [("a", "quoted", "1998-08-01 contacted: called"), ("b", "won", "old")]
    assert rows(changes.with_statuses(leads, events.limit(0))) == [("a", "new", None), ("b", "won", "old")]


def test_classify_orders_without_a_list(spark):
    orders = spark.createDataFrame([(1, "trial"), (2, "Trial"), (3, None)], "id long, contact_name string")
    assert rows(changes.classify_orders(orders, "trial")) == [(1, True, None), (2, False, 'not marked "trial"'), (3, False, 'not marked "trial"')]
    wanted = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert rows(changes.classify_orders(orders, "trial", wanted)) == [(1, True, None), (9, False, "no such order")]


def test_panel_search_takes_short_digits_as_text_only(spark):
    leads = spark.createDataFrame([("Hotel 12", "+919800001234", "s"), (None, "+919800001234", "s"), ("Hotel", None, "t")], "name string, phone string, source string")
    assert [changes.panel_search(leads, *a).count() for a in (("", "12"), ("", "1234"), ("s", ""), ("", " HOTEL "), ("t", "x"))] == [1, 2, 2, 2, 0]


def test_requirement_gate(spark):
    today = F.lit("1998-08-02").cast("date")
    texts = [(None, False), ("", False), ("A story of onions", False), ("Tender for onions, write to us", False), ("Tender: 50 kg onions", False), ("Tender: 50 kg onions", True)]
    df = spark.createDataFrame(texts, "t string, p boolean")
    gate = openings.requirement_reason(F.col("t"), F.col("p"), openings.plain_reads(F.col("t"), today), Profile(city="Asia"))
    assert [tuple(r["g"]) for r in df.select(gate.alias("g")).collect()] == [
        (False, "no text"), (False, "no text"), (False, "no procurement wording"), (True, "nothing read"), (False, "already read: a quantity"), (True, "an article does not name the buyer's site"),
    ]


def test_registrations_take_contacts_of_live_pages_only(spark):
    entries = spark.createDataFrame([("A", "u", "x", None, None, None, "a@reg.example"), ("B", "v", None, None, None, None, "a form"), ("C", "w", None, None, None, None, None)], "name string, url string, type string, city string, buys string, how string, contact string")
    checks = spark.createDataFrame([("u", False, 500, "Call 9812345678", "status 500"), ("v", True, 200, "Call 9812345678", None)], "url string, ok boolean, status int, text string, reason string")
    got = rows(candidates.registrations(entries, checks, {}).select("name", "phone", "email", "live", "check_reason", "contact_complete", "contact_from_page"))
    assert got == [("A", None, "a@reg.example", False, "status 500", True, False), ("B", "+919812345678", None, True, None, True, True), ("C", None, None, False, None, False, False)]
