"""Source readers on small documents, PDF text, sinks and calls."""

import json

from pyspark.sql import functions as F

from leadloom.config import Profile
from leadloom.sources import candidates as C
from leadloom.sources import sinks
from leadloom.streaming import ingest
from leadloom.tools import Engine, validate

PROFILE = Profile(city="Hyderabad", exclude=("liquor",))


def today():
    return F.lit("2026-09-11").cast("date")


def frame(spark, body):
    return spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "body string")


def test_map(spark):
    body = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "Green", "shop": "greengrocer", "phone": "9845012345", "addr:street": "M G Road"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "Liquor shop"}}, {"type": "node", "id": 3, "tags": {}}]}
    got = C.map_listings(frame(spark, body), PROFILE).collect()
    assert [(r["external_id"], r["segment"], r["phone"], r["address"], r["lat"]) for r in got] == [("node/1", "retailer", "+919845012345", "M G Road", 1.0)]


def test_publishers(spark):
    item = lambda t, u, d="11 Sep 2026": f"<item><title>{t}</title><link>{u}</link><pubDate>Fri, {d} 10:00:00 GMT</pubDate></item>"
    xml = "<rss>" + item("Taj to open a 200-room hotel", "/a?utm_source=x") + item("Taj to open another hotel", "/a") + item("Corporation invites bids for groceries", "/b") + item("Road works", "/c") + item("Chain opens a restaurant", "/d", "01 Jan 2026") + "</rss>"
    rows = spark.createDataFrame([("f", "https://x.example/feed", xml)], "feed string, url string, body string")
    items = C.publisher_items(rows, PROFILE, today())
    assert {r["pos"]: r["outcome"] for r in items.collect()} == {0: "kept", 1: "repeated", 2: "kept", 3: "unmatched", 4: "stale"}
    assert C.feed_stats(items).collect()[0].asDict() == {"feed": "f", "items": 5, "kept": 2, "demand": 1, "opening": 1, "unmatched": 1, "stale": 1, "unusable_link": 0}


def test_prices_tenders_bids_cards_orders(spark):
    price = {"records": [{"state": "K", "district": "D", "market": "M", "commodity": "Garlic", "arrival_date": "11/09/2026", "min_price": "", "max_price": "15,000", "modal_price": "14500"}]}
    got = C.mandi_prices(frame(spark, price)).collect()[0]
    assert (str(got["date"]), got["min_price"], got["max_price"], got["external_id"]) == ("2026-09-11", None, 15000.0, "K|D|M|Garlic|11/09/2026")
    html = "<table><tr><td>S.No</td><td>a</td><td>b</td><td>c</td><td>d</td></tr><tr><td>1</td><td>01-Sep-2026</td><td>30-Sep-2026</td><td>Supply of vegetables to the hostel 2026_IITH_812345_1</td><td>IIT</td></tr></table>"
    got = C.tenders(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r["external_id"], str(r["deadline"]), r["organisation"]) for r in got] == [("2026_IITH_812345_1", "2026-09-30", "IIT")]
    bid = {"response": {"response": {"docs": [{"b_bid_number": "B1", "b_category_name": "Onion", "b_total_quantity": "50", "b_bid_end_date_sort": "2026-10-01T00:00"}, {"b_bid_number": "B2"}]}}}
    assert [(r["ok"], r["quantity"]) for r in C.bids(frame(spark, bid)).collect()] == [(True, "50 units")]
    assert [(r["ok"], r["reason"]) for r in C.bids(frame(spark, {"x": 1})).collect()] == [(False, "unrecognised shape")]
    card = '<div class="card"><p>A</p><p>Road</p><p>Onion</p><p>K</p><p>560001</p></div>' * 2 + '<div class="card"><p>B</p></div>'
    assert [(r["name"], r["pin"]) for r in C.exporter_cards(spark.createDataFrame([(card,)], "html string"), PROFILE).collect()] == [("A", "560001")]
    order = {"eventId": "e", "order": {"orderId": "o1", "contactName": "X", "phone": "9845012345", "products": ["Garlic", ""], "orderDetails": "a\n\n  b "}}
    got = C.orders(frame(spark, order)).collect()[0]
    assert (got["id"], got["products"], got["order_details"], got["phone"], got["ok"]) == ("o1", ["Garlic"], "a\nb", "+919845012345", True)
    assert C.orders(frame(spark, {"city": "X"})).collect()[0]["missing"] == "orderId, orderDetails or products"


def test_notices(spark):
    html = '<a href="/t1.pdf">Supply of vegetables</a><a href="/x">About</a><table><tr><td>Hostel mess groceries</td><td><a href="/t2.pdf">Download</a></td></tr></table>'
    pages = spark.createDataFrame([("https://x.example/tenders", html)], "url string, html string")
    got = {r["link"]: (r["title"], r["via"]) for r in C.notice_links(pages, ["vegetables", "groceries"], PROFILE).collect()}
    assert got == {"https://x.example/t1.pdf": ("Supply of vegetables", "anchor"), "https://x.example/t2.pdf": ("Hostel mess groceries Download", "table row")}
    doc = spark.createDataFrame([("l", "t", "Supply of 1,500 kg vegetables per month. Last date: 30/09/2026. Contact Person: Dr A Rao, ph 040-2301 6773, stores[at]x[dot]ac[dot]in")], "link string, title string, text string")
    r = C.notices(doc, PROFILE, today()).collect()[0]
    assert (r["quantity_kg"], str(r["deadline"]), r["phone"], r["email"], r["contact_name"]) == (1500.0, "2026-09-30", "+914023016773", "stores@x.ac.in", "Dr A Rao")


def test_webhook(spark):
    body = {"entry": [{"changes": [{"field": "messages", "value": {"messages": [{"id": "m", "from": "1", "timestamp": "1700000000", "type": "text", "text": {"body": "L1 won"}}], "statuses": [{"id": "s", "status": "failed", "timestamp": "1700000001", "recipient_id": "2"}]}}, {"field": "other", "value": {}}]}]}
    assert [(r["id"], r["text"]) for r in ingest.messages(frame(spark, body)).collect()] == [("m", "L1 won")]
    assert [(r["id"], r["status"]) for r in ingest.statuses(frame(spark, body)).collect()] == [("s", "failed")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"', ["x", "y"])], "id int, t string, l array<string>")
    assert [r["line"] for r in sinks.csv_lines(rows, ["id", "t", "l"]).collect()] == ['1,"a,""b""",x; y']
    first, second = str(tmp_path / "v1"), str(tmp_path / "v2")
    sinks.upsert_table(spark, rows, "id", str(tmp_path / "v0"), first)
    out = sinks.upsert_table(spark, rows.withColumn("t", F.lit("new")).unionByName(rows.withColumn("id", F.lit(2))), "id", first, second)
    assert sorted((r["id"], r["t"]) for r in out.collect()) == [(1, "new"), (2, 'a,"b"')]
    receipts = spark.createDataFrame([("r", 0, "{}"), ("r", 1, "[]"), ("q", 0, "{}")], "run string, seq int, payload string")
    sealed = sinks.evidence_bundles(receipts, "s", ["run"])
    found = {r["run"]: r["problems"] for r in sinks.verify_bundles(receipts.where("run <> 'r' OR seq <> 1"), sealed, "s", ["run"]).collect()}
    assert found == {"r": "hash differs", "q": ""}


def test_calls(spark):
    leads = spark.createDataFrame([(1, "buyer", "A hotel", "X", "hotel", "+919845012345", 80, "new", None), (2, "buyer", "B", "Y", "other", None, 40, "new", None)], "id int, kind string, name string, city string, segment string, phone string, score int, status string, notes string")
    engine = Engine(spark, {"leads": leads}, Profile(city="X"))
    hit = engine.call("leads.search", query="hotel")["result"]
    assert (hit["matched"], hit["total"], [r["id"] for r in hit["leads"].collect()]) == (1, 2, [1])
    assert not engine.call("leads.search", limit=0)["ok"] and not engine.call("nothing")["ok"]
    assert engine.call("leads.set_status", id="1", status="won")["error"] == "only the owner may"
    assert engine.call("leads.set_status", role="owner", id="1", status="won", note="yes")["ok"]
    assert engine.call("leads.get", id="1")["result"]["lead"]["status"] == "won"
    assert "L1" in engine.call("digest.render")["result"]["index"] and len(engine.receipts) == 7
    assert validate({"x": 1}, {"properties": {}})[1] == ["x: unknown"]
