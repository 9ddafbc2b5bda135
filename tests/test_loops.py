"""Answers, labels, report texts and rankings: golden values and greedy loops."""

import random
from collections import Counter

from pyspark.sql import functions as F

from leadloom.functions import answers, contacts, labels, markup
from leadloom.operators import orders as loop
from leadloom.operators import ranking, report


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


def test_awkward_answers(spark):
    rows = spark.createDataFrame([(None,), ("",), ("```json\n{bad}\n``` {\"segment\": \"hotel\", \"size\": \"small\", \"confidence\": 0.5}",), ('{"segment": "", "size": "", "confidence": 2, "buys": "x", "quantity": 4}',), ("{} {}",)], "t string")
    got = [r["x"] for r in rows.select(answers.parse_enrich(F.col("t")).alias("x")).collect()]
    assert [g["ok"] for g in got] == [False, False, False, True, False]
    assert got[0]["reason"] == "reply is not JSON" and got[3]["buys"] == [] and got[3]["quantity"] is None and got[3]["confidence"] == 1
    long = answers.parse_opener(F.col("t"))
    assert one(spark, long, t=None)["reason"] == "expected two lines, got 0"
    assert one(spark, answers.parse_requirement(F.col("t")), t='{"is_requirement": true, "confidence": 0.5, "deadline": "1998-02-30"}')["deadline_dropped"] == "1998-02-30"


def test_links_and_sites(spark):
    html = '<a href="/contact-us">Contact</a><a href="/x">Reach us</a><a href="/contact-us#a">again</a><a href="https://www.grandhotel.example/">Grand Hotel</a><a href="https://paper.example/grand">Grand</a>'
    page = F.lit("https://paper.example/news/1")
    assert one(spark, contacts.contact_links(markup.links(F.col("h")), page), h=html) == ["https://paper.example/contact-us", "https://paper.example/x"]
    site = lambda said: one(spark, labels.site_from_article(markup.links(F.col("h")), F.lit("paper.example"), F.lit("The Grand Hotel"), F.col("s"), ("search.example",)), h=html, s=said)
    assert site("own.example") == "https://own.example" and site("https://www.search.example/q") == "https://www.grandhotel.example/" and site(None) == "https://www.grandhotel.example/"
    rows = "<tr><td>tender for onions</td></tr><tr><td><a href='x'>tender</a></td></tr><tr><td>road</td></tr>"
    assert one(spark, labels.unlinked_matches(F.col("h"), lambda t: t.contains("tender")), h=rows) == ["tender for onions"]
    assert one(spark, labels.catalogue_label(F.col("i"), {"a": "Apples"}), i="green_peas") == "Green Peas"
    assert one(spark, labels.requirement_contact(F.col("a"), F.col("b"), F.col("c")), a=None, b="", c=None) == "contact not found yet"


def greedy_cap(rows, limit, share):
    """Rows are (id, score, segment, source) by score and id."""

    def spread(some):
        used, out, left = Counter(), [], list(some)
        while left:
            top = [r for r in left if r[1] == left[0][1]]
            pick = min(top, key=lambda r: (used[r[2]], left.index(r)))
            used[pick[2]] += 1
            out.append(pick)
            left.remove(pick)
        return out

    if len(rows) <= limit:
        return [r[0] for r in spread(rows)]
    reserve, chosen = int(limit * share), set()
    for source in sorted({r[3] for r in rows}):
        chosen |= {r[0] for r in [r for r in rows if r[3] == source][:reserve]}
    for r in spread(rows):
        if len(chosen) >= limit:
            break
        chosen.add(r[0])
    return [r[0] for r in spread([r for r in rows if r[0] in chosen])][:limit]


def test_cap_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    for n, limit, share in ((40, 10, 0.2), (40, 10, 0.5), (8, 10, 0.2), (60, 5, 0.0)):
        rows = sorted(((i, rng.randint(0, 4), rng.choice("abc"), rng.choice("stuvw")) for i in range(n)), key=lambda r: (-r[1], r[0]))
        leads = spark.createDataFrame(rows, "id long, score int, segment string, source string")
        assert [r["id"] for r in ranking.capped(leads, limit, share).collect()] == greedy_cap(rows, limit, share)


def test_report_text_fits(spark):
    rows = [("found", "", 8, None), ("with_phone", "", 7, None), ("register", "", 9, None), ("orders", "", 2, None), ("orders_total", "", 5, None)]
    rows += [("city", f"City {i}", 30 - i, None) for i in range(20)] + [("price", "Garlic", 14500, None), ("price_before", "Garlic", 12000, None), ("price_change", "Garlic", 21, None), ("blocked", "feed", 1, "gone")]
    table = spark.createDataFrame(rows, "measure string, key string, value long, note string")
    wide = report.report_text(table, "2026-W37", 10_000)
    assert "City 0 30" in wide and "+14 more" in wide and "Garlic 14500, was 12000 (+21%)" in wide and "feed (gone)" in wide
    tight = report.report_text(table, "2026-W37", 330)
    assert len(tight) <= 330 and "Garlic" not in tight and "+19 more" in tight
    assert len(report.report_text(table, "2026-W37", 50)) == 50
    assert "none this week" in report.report_text(table.where("false"), "2026-W37", 500)


def test_orders_are_kept_once(spark):
    columns = "id string, created_at timestamp, received_at timestamp, phone string, email string, business_name string, contact_name string, city string, products array<string>, details string, notes string"
    import datetime

    t = datetime.datetime(2026, 9, 14)
    orders = spark.createDataFrame([("a", None, t, None, None, None, None, None, None, None, None), ("b", t, t, "9845012345", None, "Anand", None, "Pune", ["x"], "", None), ("b", t, t, "9845012345", None, "Anand", None, "Pune", ["x"], "", None)], columns)
    leads = spark.createDataFrame([("1", "price", "Anand", "Pune", "+919845012345", None, "new", None, None, 1), ("2", "buyer", "Anand Pvt Ltd", "pune", None, None, "new", None, None, 2)], "id string, kind string, name string, city string, phone string, email string, status string, why_now string, notes string, ord long")
    none = orders.select("id").where("false")
    fresh = loop.record_orders(none, orders)
    assert fresh.count() == 2 and loop.record_orders(orders.select("id"), orders).count() == 0
    after = {r["id"]: r for r in loop.upsert_leads(leads, fresh).collect()}
    assert after["2"]["status"] == "won" and after["2"]["phone"] == "+919845012345" and after["1"]["status"] == "new" and len(after) == 3
    rows = loop.lead_orders(spark.createDataFrame([], "lead string, order_id string"), orders, leads)
    assert rows.count() == 2 and loop.lead_orders(rows.select("lead", "order_id"), orders, leads).count() == 0
