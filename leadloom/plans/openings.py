"""Queries over signals, registries and changes: tiers, outcomes, gates, enrichment, registrations, statuses by label, removals, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Profile
from ..functions import contacts, labels, markup
from ..operators import changes, openings, ranking, scans, series
from ..sources import candidates
from .leads import scored
from .tables import REGISTER_SQL, read, register
from .texts import NOTICES_SQL, notices

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PROFILE = Profile(city="Asia")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("{L}", "WITH " + REGISTER_SQL)
        return f

    return add


def _pick(key, *forms):
    """The form of a key's remainder."""
    return F.element_at(F.array(*(f if not isinstance(f, str) else F.lit(f) for f in forms)), (key % len(forms) + 1).cast("int"))


# ---------------------------------------------------------------------------------------
# Signals


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 3) THEN 'requirement_candidate' ELSE 'awareness' END AS tier FROM part")
def signal_tiers(spark, d):
    """The tier of a headline for each part: by its words, or as stated."""
    key = F.col("p_partkey")
    words = lambda a, b: F.concat(F.lit(a), "p_name", F.lit(b))
    text = _pick(key, words("Tender: supply of ", ", onion and potato"), words("New hotel ", " opens"), words("", " news"), words("", " story"), F.concat(F.lit("Tender "), F.repeat(F.lit("x "), 200), F.lit(" onion")), "")
    stated = F.when(key % 6 == 3, "requirement_candidate").when(key % 6 == 5, "awareness")
    return read(spark, d, "part").select("p_partkey", openings.tier_of(stated, text, PROFILE).alias("tier"))


@query(f"""{NOTICES_SQL} SELECT id, CASE id % 4 WHEN 0 THEN format('{{:,}} kg vegetables per month', id % 9000 + 1000) WHEN 2 THEN (id % 700 + 5) || ' kg'
    WHEN 1 THEN CASE WHEN 100 * (id % 50 + 1) >= 1000 * (id % 20 + 1) THEN (id % 50 + 1) || ' quintals' ELSE (id % 20 + 1) || ' MT per day' END END AS quantity,
  CASE WHEN id % 4 < 3 THEN due WHEN issued >= DATE '1996-01-01' THEN issued END AS deadline, id % 4 IN (0) AND id % 5 <> 0 AS needed, CASE WHEN id % 5 = 0 THEN 'no text' WHEN id % 4 <> 0 THEN 'no procurement wording' ELSE 'an article does not name the buyer''s site' END AS reason FROM n""")
def plain_reads(spark, d):
    """What every notice says by itself, and whether a model is asked who the buyer is; each fifth has no text for it."""
    rows = notices(spark, d).withColumn("r", openings.plain_reads(F.col("text"), F.lit("1996-01-01").cast("date")))
    gate = openings.requirement_reason(F.when(F.col("id") % 5 != 0, F.col("text")), F.lit(True), F.col("r"), PROFILE)
    return rows.withColumn("g", gate).select("id", "r.quantity", "r.deadline", "g.needed", "g.reason")


_CAP = 60


def _signals(spark, d):
    """Leads as signals in the order they are read, with what was fetched for them by fixed rules of the key."""
    key = F.col("id")
    rows = scored(spark, d).select("id", "kind", "name", "score", "segment", F.when(key % 4 == 0, "requirement_candidate").otherwise("awareness").alias("tier"), F.lit("https://paper.example/x").alias("url"))
    placed = scans.ordinals(rows.where("tier = 'requirement_candidate'"), [F.desc("score"), F.asc("id")])
    signals = placed.unionByName(rows.where("tier <> 'requirement_candidate'").withColumn("place", F.lit(None).cast("long"))).select("id", "place", "tier")
    u = F.concat(F.lit("https://paper.example/"), key.cast("string"))
    ids = rows.select("id", "name")
    links = ids.select("id", F.when(key % 5 != 0, u).alias("url"), F.when(key % 5 == 0, "robots").alias("link_reason"))
    html = F.concat(F.lit('<a href="https://paper.example/a">Grand paper</a><a href="https://grand'), key.cast("string"), F.lit('.example/">The Grand</a>'))
    articles = ids.select(
        u.alias("url"), (key % 3 != 0).alias("article_ok"), F.lit("paper.example").alias("host"), F.when(key % 7 != 0, html).otherwise("").alias("html"),
        F.when(key % 11 != 0, "A tender for onions").otherwise("A story").alias("text"), F.when(key % 3 == 0, "status 404").alias("article_reason"),
    )
    answers = ids.where(key % 13 != 0).select(
        "id", F.lit(True).alias("answer_ok"), (key % 17 != 0).alias("is_requirement"), (F.when(key % 19 == 0, 0.5).otherwise(0.9)).alias("confidence"), F.lit("Grand Hotels").alias("organisation"), F.lit(None).cast("string").alias("said_site"),
        F.lit("onions").alias("requirement"), F.lit("5 kg").alias("quantity"), F.when(key % 2 == 0, F.lit("1998-09-30").cast("date")).alias("deadline"), F.lit(None).cast("string").alias("answer_reason"),
    )
    site = F.concat(F.lit("https://grand"), key.cast("string"), F.lit(".example/"))
    met = ids.select(site.alias("site"), (key % 23 != 0).alias("contact_ok"), F.when(key % 23 != 0, "+919800000000").alias("phone"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("name"), F.lit("no phone").alias("contact_reason"))
    return openings.outcomes(signals, links, articles, answers, met, PROFILE, _CAP)


_OUTCOMES = f"""{{L}}, c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM leads WHERE id % 4 = 0),
o AS (SELECT id, CASE WHEN coalesce(sum(CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {_CAP} THEN 'capped' WHEN id % 5 = 0 THEN 'link_unresolved'
  WHEN id % 3 = 0 THEN 'article_skipped' WHEN id % 11 = 0 THEN 'not_needed' WHEN id % 13 = 0 THEN 'no_answer' WHEN id % 17 = 0 THEN 'no_requirement' WHEN id % 19 = 0 THEN 'below_gate' WHEN id % 7 = 0 THEN 'no_site' WHEN id % 23 = 0 THEN 'no_contact' ELSE 'upgraded' END AS outcome FROM c
  UNION ALL SELECT id, 'awareness' FROM leads WHERE id % 4 <> 0)"""


@query(_OUTCOMES + " SELECT id, outcome FROM o")
def opening_outcomes(spark, d):
    """What became of every signal of a run, each by the first rule that ends its reading."""
    return _signals(spark, d).select("id", "outcome")


@query(_OUTCOMES + """ SELECT l.id, CASE WHEN outcome = 'upgraded' THEN 'requirement' ELSE kind END AS kind, CASE WHEN outcome = 'upgraded' THEN coalesce(phone, '+919800000000') ELSE phone END AS phone, CASE WHEN outcome = 'upgraded' THEN coalesce(website, 'https://grand' || id || '.example/') ELSE website END AS website,
  CASE WHEN outcome = 'upgraded' THEN 'requirement reported, closes 1998-09-30' WHEN outcome = 'awareness' THEN 'opening or expansion reported' END AS why_now, CASE WHEN outcome IN ('upgraded', 'not_needed', 'no_requirement', 'below_gate', 'no_site', 'no_contact', 'capped', 'link_unresolved') THEN outcome = 'upgraded' END AS contact_complete,
  coalesce(outcome = 'awareness', false) AS awareness_only FROM leads l LEFT JOIN o USING (id)""")
def opening_leads(spark, d):
    """The register after a run's signals."""
    leads = scored(spark, d).select("id", "kind", "name", "phone", "email", F.regexp_replace("website", "/$", "").alias("website"), F.lit(None).cast("string").alias("why_now"))
    return openings.applied(leads, _signals(spark, d)).select("id", "kind", "phone", "website", "why_now", "contact_complete", "awareness_only")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://said' || page_id || '.example' ELSE 'https://grand.example/in' END AS site FROM pages")
def site_from_article(spark, d):
    """The organisation's site by the answer, else by the links that stand before each page's own."""
    html = F.concat(F.lit('<a href="https://paper.example/grand">Grand story</a><a href="https://facebook.com/grand">Grand Hotel</a><a href="https://grand.example/in">the GRAND hotel</a>'), F.coalesce("html", F.lit("")))
    said = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://said"), F.col("page_id").cast("string"), F.lit(".example")))
    said = F.when(F.col("page_id") % 3 == 1, "https://www.facebook.com/grand").otherwise(said)
    site = labels.site_from_article(markup.links(html), F.lit("paper.example"), F.lit("The Grand Hotel"), said, ("facebook.com",))
    return read(spark, d, "pages").select("page_id", site.alias("site"))


@query("SELECT page_id, unnest(['https://site.example/' || page_id || '/reach-us', 'https://site.example/enquiry?a=1', 'https://site.example/x']) AS url FROM pages")
def contact_links(spark, d):
    """The links of a page for each row that lead to contacts, absolute and once."""
    html = F.concat(F.lit('<a href="/'), F.col("page_id").cast("string"), F.lit('/reach-us">Us</a><a href="/about">About</a><a href="/enquiry?a=1#top">Ask</a><a href="/x">Get in  touch</a><a href="enquiry?a=1">Ask again</a>'))
    urls = contacts.contact_links(markup.links(html), F.lit("https://site.example/"))
    return read(spark, d, "pages").select("page_id", F.explode(urls).alias("url"))


# ---------------------------------------------------------------------------------------
# Models


@query("""SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 3 <> 2 AS needed,
  CASE WHEN c_custkey % 2 <> 0 THEN 'not in the digest' WHEN c_custkey % 3 = 2 THEN 'no fact to build on' WHEN c_custkey % 3 = 0 THEN 'has a stated quantity' ELSE 'has the title of their website, a stated quantity' END AS reason FROM customer""")
def opener_gate(spark, d):
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    facts = labels.concrete_facts(F.lit(None).cast("array<string>"), F.when(key % 3 == 1, "t"), none, F.when(key % 3 != 2, "5 kg"), F.lit(None).cast("date"))
    return read(spark, d, "customer").select(key.alias("id"), openings.opener_reason(key % 2 == 0, facts).alias("g")).select("id", "g.needed", "g.reason")


@query("{L} SELECT id, segment, segment AS segment_source, CASE WHEN id % 3 = 0 THEN 'hotel' END AS segment_model, CASE WHEN id % 3 = 0 THEN (id % 10) / 10.0::DOUBLE END AS confidence FROM leads")
def enrich_leads(spark, d):
    """Answers are kept beside what the source said."""
    leads = scored(spark, d).select("id", "segment", F.col("segment").alias("segment_source"), F.lit(None).cast("string").alias("segment_model"))
    key = F.col("id")
    answers = leads.where(key % 3 == 0).select("id", F.lit("hotel").alias("segment"), F.lit("large").alias("size"), F.array(F.lit("onion")).alias("buys"), F.lit(None).cast("date").alias("deadline"), ((key % 10) / 10).alias("confidence"))
    return openings.enriched(leads, answers, "v2").select("id", "segment", "segment_source", "segment_model", "llm.confidence")


@query("{L} SELECT id, score FROM leads WHERE id % 9 <> 0 AND coalesce(website, CASE WHEN id % 2 = 0 THEN 'x' END) IS NOT NULL AND id % 4 <> 1 ORDER BY score DESC, website IS NULL, id LIMIT 30")
def leads_to_enrich(spark, d):
    key = F.col("id")
    rows = scored(spark, d).select("id", "score", "website", F.when(key % 9 == 0, "price").otherwise("buyer").alias("kind"), F.when(key % 2 == 0, "https://x.example").alias("source_url"), F.when(key % 4 == 1, "v2").when(key % 4 == 2, "v1").alias("llm_version"))
    return openings.to_enrich(rows, 30, "v2").select("id", "score")


_INDEX_SQL = "i AS (SELECT id, 'L' || row_number() OVER (ORDER BY score DESC, id) AS label, row_number() OVER (ORDER BY score DESC, id) AS place FROM leads ORDER BY place LIMIT 25)"


def _index(spark, d):
    return ranking.section_labels(scored(spark, d), {"buyer": "L"}, {"buyer": 25}).select("label", "place", "id")


@query("{L}, " + _INDEX_SQL + " SELECT label, id, id % 2 = 0 AS needed FROM i WHERE place <= 20 AND id % 5 <> 0")
def openers_to_write(spark, d):
    """The leads of the digest that still need an opener of this version."""
    key = F.col("id")
    opened = F.when(key % 5 == 0, "two lines")
    leads = scored(spark, d).select("id", opened.alias("opener_model"), F.when(key % 5 == 0, "v1").alias("opener_version"), F.when(key % 2 == 0, F.array(F.lit("a stated quantity"))).otherwise(F.array().cast("array<string>")).alias("facts"))
    return openings.openers_to_write(_index(spark, d), leads, 20, "v1").select("label", "id", "gate.needed")


@query("""SELECT count(*) AS cases, count(*) FILTER (l.doc_id % 4 <> 0) AS valid, count(*) FILTER (l.doc_id % 4 <> 0 AND quality = CAST(n_chars > 500 AS INT) AND toxic = 0) AS all_right, CAST(coalesce(sum(l.doc_id % 100), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(l.doc_id % 7), 0) AS BIGINT) AS tokens_out,
  CAST(floor(coalesce(sum(l.doc_id % 100), 0) / count(*) + 0.5) AS BIGINT) AS mean_in, CAST(floor(coalesce(sum(l.doc_id % 7), 0) / count(*) + 0.5) AS BIGINT) AS mean_out, CAST(coalesce(sum(l.doc_id % 3), 0) AS BIGINT) AS cost, CAST(floor(coalesce(sum(l.doc_id % 50), 0) / count(*) + 0.5) AS BIGINT) AS mean_ms,
  count(*) FILTER (l.doc_id % 6 = 0) AS cache_hits FROM documents d LEFT JOIN labels l USING (doc_id)""")
def eval_totals(spark, d):
    """The labels as answers to cases made of all documents."""
    key = F.col("doc_id")
    cases = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    results = read(spark, d, "labels").select(
        "doc_id", "quality", "toxic", F.lit(0).alias("ord"), (key % 4 != 0).alias("ok"), (key % 100).alias("tokens_in"), (key % 7).alias("tokens_out"), (key % 3).alias("cost"), (key % 50).alias("ms"), (key % 6 == 0).alias("cache_hit")
    )
    return series.answer_totals(cases, results, "doc_id", ["quality", "toxic"], "ord")


# ---------------------------------------------------------------------------------------
# Registries and the register


@query("""SELECT 'reg_' || left(sha256('https://reg.example/' || s_suppkey), 20) AS external_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'hotel' ELSE 'distributor' END AS segment,
  CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 THEN '+9198' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS phone, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || s_suppkey || '@reg.example' END AS email,
  s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AS live, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 5 = 0 THEN 'status 500' END AS check_reason, (s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0) OR s_suppkey % 3 = 0 AS contact_complete FROM supplier WHERE s_suppkey % 7 <> 0""")
def registration_candidates(spark, d):
    """A registry file for each supplier, a list or an object by its key, and the checks of its page; each seventh entry has no name."""
    key, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://reg.example/"), text)
    entry = F.to_json(F.struct(
        F.when(key % 7 != 0, F.col("s_name")).alias("name"), url.alias("url"), F.when(key % 2 == 0, "hotel_group").otherwise("chain").alias("type"), F.lit("Asia").alias("city"), F.lit("onions").alias("buys"),
        F.lit("form").alias("how"), F.when(key % 3 == 0, F.concat(F.lit("r"), text, F.lit("@reg.example"))).otherwise("the form").alias("contact"),
    ))
    body = F.when(key % 2 == 0, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(F.concat(F.lit('{"entries": ['), entry, F.lit("]}")))
    fields = dict.fromkeys(("name", "url", "type", "city", "buys", "how", "contact"), "string")
    entries = candidates.registry(read(spark, d, "supplier").select(body.alias("body")), fields)
    page = F.concat(F.lit("Call 98"), F.lpad(text, 8, "0"), F.lit(" for onions"))
    checks = read(spark, d, "supplier").where(key % 4 != 0).select(url.alias("url"), (key % 5 != 0).alias("ok"), F.lit(200).alias("status"), F.when(key % 5 != 0, page).alias("text"), F.when(key % 5 == 0, "status 500").alias("reason"))
    return candidates.registrations(entries, checks, {"hotel_group": "hotel"}).select("external_id", "name", "segment", "phone", "email", "live", "check_reason", "contact_complete")


@query("""SELECT left(sha256('map c' || c_custkey), 16) AS id, 'buyer' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'hotel' ELSE 'other' END AS segment, c_name AS name, '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone,
  'buyer' || c_custkey || '@example.com' AS email, 'new' AS status, 0 AS score, '098' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS raw_phone FROM customer""")
def candidates_to_leads(spark, d):
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    rows = read(spark, d, "customer").select(
        F.lit("map").alias("source"), F.concat(F.lit("c"), key.cast("string")).alias("external_id"), none.alias("kind"), F.when(key % 2 == 0, "hotel").alias("segment"), F.concat(F.lit("  "), "c_name").alias("name"),
        F.concat(F.lit("098"), F.lpad(key.cast("string"), 8, "0")).alias("phone"), F.concat(F.lit(" Buyer"), key.cast("string"), F.lit("@Example.com")).alias("email"), F.lit(None).cast("date").alias("why_now_date"),
        *(none.alias(c) for c in ("city", "state", "address", "website", "why_now", "source_url", "licence")),
    )
    return candidates.to_lead(rows, F.lit("1998-08-02").cast("timestamp")).select("id", "kind", "segment", "name", "phone", "email", "status", "score", "raw_phone")


@query("SELECT max(CAST(o_orderdate AS DATE)) AS day, unnest(['txt', 'index.json']) AS kind FROM orders")
def latest_digest(spark, d):
    """The files of the last day among a digest, an index and a stray file for each order day."""
    day = F.col("day").cast("string")
    files = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select(F.explode(F.array(*(F.concat(F.lit(f"digests/{before}"), day, F.lit(after)) for before, after in (("", ".txt"), ("", ".index.json"), ("draft-9999-", ".txt"))))).alias("path"))
    return candidates.latest_digest(files).select("day", "kind")


def _commands(spark, d):
    """A command for each order: to the lead of its customer by id, each hundredth by a label of the digest; some to no status there is."""
    key = F.col("o_orderkey")
    ref = F.when(key % 100 == 0, F.concat(F.lit("l"), (key / 100 % 40 + 1).cast("int").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    to = _pick(key, "contacted", "quoted", "won", "lost", "sold")
    rows = read(spark, d, "orders").select(ref.alias("ref"), to.alias("to"), F.when(key % 3 == 0, F.concat(F.lit(" by   phone "), key.cast("string"))).alias("note"), F.col("o_orderdate").alias("at"), key.alias("ord"))
    return changes.resolve_refs(rows, _index(spark, d))


_COMMANDS = "{L}, " + _INDEX_SQL + """, c AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN (SELECT i.id FROM i WHERE i.label = 'L' || CAST(floor(o_orderkey / 100) % 40 + 1 AS INT)) ELSE o_custkey END AS lead, ['contacted', 'quoted', 'won', 'lost', 'sold'][CAST(o_orderkey % 5 AS INT) + 1] AS t,
  CASE WHEN o_orderkey % 3 = 0 THEN 'by phone ' || o_orderkey END AS note, o_orderdate AS w, o_orderkey AS ord FROM orders),
e AS (SELECT c.*, coalesce(lag(t) OVER (PARTITION BY lead ORDER BY w, ord), status) AS f FROM c JOIN leads ON id = lead WHERE t <> 'sold')"""


@query(_COMMANDS + ' SELECT lead, f AS "from", t AS "to", note, ord FROM e')
def status_events(spark, d):
    """The events that the commands leave."""
    leads = scored(spark, d).select(F.col("id").cast("string").alias("id"), "status")
    return changes.status_events(leads, _commands(spark, d)).select(F.col("lead").cast("long").alias("lead"), "from", "to", "note", "ord")


@query(_COMMANDS + """, g AS (SELECT lead, (list(t ORDER BY w, ord))[-1] AS last, string_agg(CAST(CAST(w AS DATE) AS VARCHAR) || ' ' || t || ': ' || note, chr(10) ORDER BY w, ord) FILTER (note IS NOT NULL) AS lines FROM e GROUP BY lead)
SELECT id, coalesce(last, status) AS status, CASE WHEN lines IS NULL THEN n ELSE concat_ws(chr(10), n, lines) END AS notes FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'first' END AS n FROM leads) LEFT JOIN g ON lead = id""")
def status_register(spark, d):
    """The register after the commands: last statuses and dated notes."""
    leads = scored(spark, d).select(F.col("id").cast("string").alias("id"), "status", F.when(F.col("id") % 2 == 0, "first").alias("notes"))
    return changes.with_statuses(leads, changes.status_events(leads, _commands(spark, d))).select(F.col("id").cast("long").alias("id"), "status", "notes")


@query("""SELECT l_orderkey * 2 AS id, coalesce(o_orderkey % 9 = 0, false) AS remove, CASE WHEN o_orderkey IS NULL THEN 'no such order' WHEN o_orderkey % 9 <> 0 THEN 'not marked "trial"' END AS reason FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey * 2""")
def classify_orders(spark, d):
    """Which of the wanted orders go, and why the others stay."""
    key = F.col("o_orderkey")
    orders = read(spark, d, "orders").select(key.alias("id"), F.when(key % 9 == 0, "trial").when(key % 2 == 0, "Trial").alias("contact_name"))
    wanted = read(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    return changes.classify_orders(orders, "trial", wanted).select("id", "remove", "reason")


@query("{L} SELECT id, name FROM leads WHERE source = 'src3' AND (lower(name) LIKE '%0000%' OR replace(coalesce(phone, ''), '+', '') LIKE '%0000%')")
def panel_search(spark, d):
    return changes.panel_search(register(spark, d), "src3", " 0000 ").select("id", "name")
