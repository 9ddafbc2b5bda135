"""Golden values of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.functions import answers, contacts, dates, hashing, markup, quantity, strings


def one(spark, text, expression, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(expression(F.col("t")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("+91 98450 12345", "+919845012345"), ("09845012345", "+919845012345"), ("9845012345", "+919845012345"), ("98450 12345; 98450 12346", "+919845012345"), ("+91 80 4112 3456", "+918041123456"), ("12345", None), ("", None), (None, None)],
)
def test_phone(spark, raw, want):
    assert one(spark, raw, strings.phone) == want


def test_phones_in_text(spark):
    for text, want in [("call 040-2301 6773", "+914023016773"), ("(080) 2293 2222", "+918022932222"), ("011 2658 1234", "+911126581234")]:
        assert one(spark, text, contacts.find_phones) == [want]
    for text in ("dated 11-09-2026", "Ref 2026_IITH_812345_1", "EMD Rs 1,00,000", "PIN 560001", "valid 22.05.2024"):
        assert one(spark, text, contacts.find_phones) == []


def test_emails(spark):
    assert one(spark, "stores[at]iisc[dot]ac[dot]in", contacts.find_emails) == ["stores@iisc.ac.in"]
    assert one(spark, "eproc@nic.in or A@b.example", contacts.find_emails) == ["a@b.example"]
    assert one(spark, None, contacts.find_emails) == []
    assert one(spark, "tel; mailto:Me@X.example", strings.email) == "me@x.example"


def test_contact_name(spark):
    assert one(spark, "Contact Person: Shri R. K. Sharma, Deputy Registrar", contacts.find_contact_name) == "Shri R. K. Sharma"
    assert one(spark, "Contact Person: Page", contacts.find_contact_name) is None


def test_quantities(spark):
    best = lambda t: one(spark, t, quantity.best_quantity)
    assert best("1,500 kg vegetables per month")["kg_per_day"] == 50
    assert best("2 MT per day")["kg_per_day"] == 2000
    assert best("100 kg tomatoes")["kg_per_day"] is None
    assert best("100 kg tomatoes. Twice per day")["kg_per_day"] is None
    assert best("nothing") is None
    fit = lambda kg, headline: spark.range(1).select(quantity.quantity_fit(F.lit(kg).cast("double"), F.lit(None).cast("double"), F.lit(headline), 25, 3000, 1000).alias("x")).collect()[0]["x"]
    assert [fit(800, True), fit(5000, True), fit(50000, False), fit(5, False), fit(None, False)] == ["within", "over", "over", "small", "unstated"]


@pytest.mark.parametrize(("raw", "want"), [("05/09/2026", "2026-09-05"), ("25-Sep-2026", "2026-09-25"), ("September 25, 2026", "2026-09-25"), ("2026-01-02", "2026-01-02"), ("5.9.26", "2026-09-05"), ("31/02/2026", None), ("x", None)])
def test_dates(spark, raw, want):
    got = one(spark, raw, dates.parse_date)
    assert (got and got.isoformat()) == want


def test_deadline(spark):
    today = F.lit("2026-09-11").cast("date")
    read = lambda t: one(spark, t, lambda c: dates.find_deadline(c, today))
    assert read("Issued 01/09/2026. Last date: 30/09/2026") == datetime.date(2026, 9, 30)
    assert read("seen 01/09/2026 and 20/10/2026 and 15/10/2026") == datetime.date(2026, 10, 15)
    assert read("only 01/09/2026") is None


@pytest.mark.parametrize(("day", "week"), [("2026-09-11", "2026-W37"), ("2027-01-01", "2026-W53"), ("2024-12-30", "2025-W01")])
def test_weeks(spark, day, week):
    assert one(spark, day, lambda c: dates.iso_week(c.cast("date"))) == week


def test_week_ranges(spark):
    assert one(spark, "2026-W37", dates.week_start) == datetime.date(2026, 9, 7)
    assert one(spark, "2025-W53", dates.week_start) is None
    assert one(spark, "2026-W01", dates.previous_week) == "2025-W52"


def test_names_and_text(spark):
    assert one(spark, "The Café & Sons Pvt. Ltd.", strings.name_key) == "cafe sons"
    assert one(spark, "a  b ", strings.squeeze) == "a b"
    assert one(spark, "x" * 20, lambda c: strings.tidy(c, 10)) == "x" * 9 + "…"
    assert one(spark, 'a "b", c', strings.csv_cell) == '"a ""b"", c"'
    assert one(spark, "Example.com/", strings.website) == "https://example.com"
    assert one(spark, "l 3 WON call back", strings.command).asDict() == {"label": "L3", "status": "won", "note": "call back"}
    assert one(spark, "llm.call", strings.receipt_role) == "reader"


def test_half_up(spark):
    assert one(spark, -2.5, lambda c: dates.half_up(c), "double") == -2


def test_markup(spark):
    html = "<title>A &amp; B</title><p>one<script>x</script></p><p>two&#233;&#x41;</p><a href=\"/n?utm_source=f&a=1#t\">go</a>"
    assert one(spark, html, markup.html_text) == "A & B\none\n\ntwoéA\ngo"
    assert one(spark, html, markup.page_title) == "A & B"
    assert one(spark, html, markup.links)[0].asDict() == {"href": "/n?utm_source=f&a=1#t", "text": "go"}
    page = F.lit("https://x.example/a/b")
    clean = lambda u: one(spark, u, lambda c: markup.clean_url(c, page))
    assert [clean("/n?utm_source=f&a=1#t"), clean("c.html"), clean("javascript:x"), clean("")] == ["https://x.example/n?a=1", "https://x.example/a/c.html", None, None]
    form = '<input type="hidden" name="a" value="1"><input name="b" value="2">'
    assert one(spark, form, markup.form_state) == {"a": "1"}
    assert one(spark, '<input name="captcha">', markup.gate) == "captcha"


def test_hashes(spark):
    got = spark.range(1).select(hashing.bundle_hash("s", F.array(F.lit("{}"), F.lit("[]"))).alias("a"), hashing.bundle_hash("s", F.array(F.lit("[]"), F.lit("{}"))).alias("b")).collect()[0]
    import hashlib

    assert got["a"] == hashlib.sha256(b"s\n2\n{}\n[]\n").hexdigest() and got["a"] != got["b"]


def test_signature(spark):
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", good), ("body", "sha256=0"), (None, None)], "b string, h string")
    assert [r[0] for r in rows.select(hashing.signature_holds("k")("b", "h")).collect()] == [True, False, False]


def test_answers_and_values_are_worked_out_once(spark):
    """An expression that reads its argument often repeats it at every use; the text of the column shows how often."""
    c = F.col("c")
    assert str(answers.parse_enrich(c)).count("parse_json") == 4 and str(answers.parse_requirement(c)).count("parse_json") == 4
    assert str(markup.decode_entities(c)).count("CDATA") == 1 and str(markup.feed_items(c)).count("<item>") == 1
    assert one(spark, None, markup.decode_entities) is None and one(spark, "<![CDATA[a]]> &amp;#65; &#65;&lt;", markup.decode_entities) == "a &#65; A<"
