"""Queries over the register: scoring, ranking, quotas, search, deduplication, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import hashing, strings
from ..operators import dedupe, digest, ranking, resolve, scoring
from .tables import REGISTER_SQL, read, register, today

PROFILE = Profile(city="Asia", state="NATION_1")
CAPS = {"buyer": 25, "requirement": 10}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin; {L} stands for the register's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{L}", "WITH " + REGISTER_SQL)
        return f

    return add


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_leads(register(spark, d), PROFILE, today())


TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, id) AS turn FROM leads)"
#: The rule of the cap: a reserve for each source by score, the rest in diversified order, the chosen diversified anew and cut.
CAPPED = TURNS + """, own AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS own FROM t),
chosen AS (SELECT * FROM own WHERE own <= 20 UNION ALL SELECT * FROM (SELECT * FROM own WHERE own > 20 ORDER BY score DESC, turn, id LIMIT (SELECT greatest(0, 100 - count(*)) FROM own WHERE own <= 20))),
spread AS (SELECT * EXCLUDE (turn), row_number() OVER (PARTITION BY segment ORDER BY score DESC, id) AS turn FROM chosen),
cap AS (SELECT * FROM spread ORDER BY score DESC, turn, id LIMIT 100)"""


@query("{L}, " + CAPPED + ", again AS (SELECT id, segment, source, score, row_number() OVER (PARTITION BY segment ORDER BY score DESC, id) AS turn FROM cap) SELECT id, segment, source, score, CAST(turn AS INT) AS turn FROM again")
def ranked_register(spark, d):
    """The capped, diversified short list: scan, join, rules, windows, limit."""
    kept = ranking.capped(scored(spark, d), 100)
    return ranking.diversified_few(kept).select("id", "segment", "source", "score", "turn").orderBy(*ranking.diversified_order())


@query("{L} SELECT id, p_segment, p_contact, p_recency, p_city, p_detail, p_penalty, score FROM leads")
def lead_score_parts(spark, d):
    return scored(spark, d).select("id", "p_segment", "p_contact", "p_recency", "p_city", "p_detail", "p_penalty", "score")


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS deadline, r_name AS city, n_name AS state, o_totalprice AS rate, o_orderkey % 4 AS k, o_orderstatus AS s
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT id, CASE WHEN deadline - DATE '1998-08-02' < 0 THEN 0 WHEN deadline - DATE '1998-08-02' <= 7 THEN 30 WHEN deadline - DATE '1998-08-02' <= 14 THEN 25 WHEN deadline - DATE '1998-08-02' <= 30 THEN 18 ELSE 10 END AS p_deadline,
  CASE WHEN rate < 50000 THEN 8 WHEN rate > 400000 THEN 6 ELSE 25 END AS p_fit, CASE k WHEN 0 THEN 30 WHEN 1 THEN 26 WHEN 2 THEN 18 ELSE 6 END AS p_contact,
  CASE WHEN lower(city) = 'asia' THEN 15 WHEN regexp_replace(lower(state), '[^a-z]', '', 'g') = 'nation' THEN 8 ELSE 0 END AS p_place, CASE WHEN s = 'F' THEN -25 ELSE 0 END AS p_penalty FROM o)
SELECT *, greatest(0, least(100, p_deadline + p_fit + p_contact + p_place + p_penalty)) AS score FROM p""")
def requirement_score(spark, d):
    from ..functions import quantity

    places = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, d, "orders").join(places.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey") % 4
    rows = rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("deadline"), F.col("r_name").alias("city"), F.col("n_name").alias("state"),
        quantity.quantity_fit(F.col("o_totalprice"), F.lit(None).cast("double"), F.lit(False), 50_000, 400_000, 100_000).alias("quantity_fit"),
        F.when(key < 2, "+919800000000").alias("phone"), F.when((key == 0) | (key == 2), "a@b.example").alias("email"), F.lit("A Person").alias("contact_name"),
        F.when(F.col("o_orderstatus") == "F", "contacted").otherwise("new").alias("status"),
    )
    return scoring.score_requirements(rows, PROFILE, today()).select("id", "p_deadline", "p_fit", "p_contact", "p_place", "p_penalty", "score")


@query("{L}, " + TURNS + " SELECT id, segment, score, CAST(turn AS INT) AS turn FROM t")
def diversify_ties(spark, d):
    return ranking.diversified(scored(spark, d)).select("id", "segment", "score", "turn")


@query("{L}, " + CAPPED + " SELECT id, source, segment, score FROM cap")
def cap_candidates(spark, d):
    return ranking.capped(scored(spark, d), 100).select("id", "source", "segment", "score")


@query("{L} SELECT id, name, city, segment, score FROM leads WHERE status = 'new' AND regexp_replace(lower(city), '[^a-z]', '', 'g') = 'europe' AND segment = 'hotel' AND score >= 40 AND (lower(name) LIKE '%0000001%' OR regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') LIKE '%0000001%')")
def register_search(spark, d):
    rows = scored(spark, d).where((F.col("status") == "new") & (strings.city_key(F.col("city")) == "europe") & (F.col("segment") == "hotel") & (F.col("score") >= 40))
    return rows.where(strings.matches_query(F.col("name"), F.lit(None).cast("string"), F.col("phone"), "0000001")).select("id", "name", "city", "segment", "score").orderBy(F.desc("score"), "id")


@query("{L}, m AS (SELECT * FROM leads WHERE status = 'new') SELECT id, score, (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM leads) AS total FROM m ORDER BY score DESC, id LIMIT 20")
def search_with_counts(spark, d):
    leads = scored(spark, d)
    counts = leads.agg(F.count(F.when(F.col("status") == "new", 1)).alias("matched"), F.count("*").alias("total"))
    top = leads.where("status = 'new'").orderBy(F.desc("score"), "id").limit(20).select("id", "score")
    return top.join(F.broadcast(counts))  # counts is one row


@query("{L} SELECT id, CASE WHEN id % 3 = 0 THEN 'requirement' ELSE 'buyer' END AS section, score FROM leads WHERE status = 'new'")
def section_split(spark, d):
    return scored(spark, d).where("status = 'new'").select("id", F.when(F.col("id") % 3 == 0, "requirement").otherwise("buyer").alias("section"), "score")


KINDS = "k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN id % 3 = 0 THEN 'requirement' ELSE 'buyer' END ORDER BY score DESC, id) AS place, CASE WHEN id % 3 = 0 THEN 'requirement' ELSE 'buyer' END AS knd FROM leads)"


def _kinds(spark, d):
    return scored(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "requirement").otherwise("buyer"))


@query("{L}, " + KINDS + " SELECT CASE knd WHEN 'requirement' THEN 'R' ELSE 'L' END || place AS label, id, score FROM k WHERE place <= CASE knd WHEN 'requirement' THEN 10 ELSE 25 END")
def label_index(spark, d):
    return ranking.section_labels(_kinds(spark, d), {"requirement": "R", "buyer": "L"}, CAPS).select("label", "id", "score")


@query("{L}, " + KINDS + " SELECT knd AS kind, coalesce(max(CASE WHEN place = CASE knd WHEN 'requirement' THEN 10 ELSE 25 END THEN score END), 0) AS cutoff FROM k GROUP BY knd")
def digest_cutoffs(spark, d):
    return ranking.cutoffs(_kinds(spark, d), CAPS)


DIGEST_CAPS = {"requirements": 5, "buyers": 5, "registrations": 3}
#: Every city's section rows in order; plans are stated as all that the rules allow, and taken by what they give up.
DIGEST_SQL = """
s AS (SELECT city, id, score, segment, CASE WHEN id % 3 = 0 THEN 'R' WHEN id % 7 = 1 THEN 'G' ELSE 'L' END AS section, name || ' (' || score || ')' AS l1, 'since ' || why_now_date AS l2, coalesce(phone, email) AS l3 FROM leads WHERE status = 'new'),
t AS (SELECT *, row_number() OVER (PARTITION BY city, section, segment ORDER BY score DESC, id) AS turn FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY city, section ORDER BY score DESC, turn, id) AS place FROM t),
b AS (SELECT *, section || place AS label, section || place || ' ' || l1 AS b1, section || place || ' ' || l1 || coalesce(chr(10) || l2, '') AS b2, section || place || ' ' || l1 || coalesce(chr(10) || l2, '') || coalesce(chr(10) || l3, '') AS b3 FROM u)
"""
PLAN_SQL = """
c AS (SELECT city, count(*) FILTER (section = 'R') AS tr, count(*) FILTER (section = 'L') AS tb, count(*) FILTER (section = 'G') AS tg, count(*) FILTER (section = 'R' AND l3 IS NOT NULL) AS with_contact FROM b GROUP BY city),
w AS (SELECT *, least(tr, 5) AS nr, least(tb, 5) AS nb, least(tg, 3) AS ng FROM c),
p AS (SELECT w.*, r, x AS xb, g, rl, bl FROM w, range(6) AS a(r), range(6) AS e(x), range(4) AS f(g), range(1, 4) AS h(rl), range(1, 4) AS i(bl)
  WHERE r <= nr AND x <= nb AND g <= ng AND (x = nb OR (g = 0 AND bl = 1)) AND (g = ng OR bl = 1) AND (r = nr OR (rl = 1 AND x = 0 AND g = 0 AND bl = 1))),
sections AS (SELECT p.*, s.section, s.n, s.h FROM p, LATERAL (VALUES ('R', r, tr, 'REQUIREMENTS POSTED', rl), ('L', xb, tb, 'BUYERS TO APPROACH', bl), ('G', g, tg, 'WHERE TO REGISTER', 1)) AS q(section, n, total, title, lines), LATERAL (SELECT q.section, q.n, CASE WHEN q.n > 0 THEN chr(10) || q.title || ' (' || q.n || CASE WHEN q.total > q.n THEN ' of ' || q.total ELSE '' END || ')' ELSE '' END AS h, q.lines) AS s),
texts AS (SELECT sections.city, r, xb, g, rl, bl, sections.section, any_value(h) || coalesce(string_agg(chr(10) || CASE CASE sections.section WHEN 'R' THEN rl WHEN 'L' THEN bl ELSE 1 END WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, '' ORDER BY place), '') AS part
  FROM sections LEFT JOIN b ON b.city = sections.city AND b.section = sections.section AND b.place <= sections.n GROUP BY sections.city, r, xb, g, rl, bl, sections.section),
whole AS (SELECT city, r, xb, g, rl, bl, 'Morning - ' || city || string_agg(part, '' ORDER BY CASE section WHEN 'R' THEN 0 WHEN 'L' THEN 1 ELSE 2 END) AS t FROM texts GROUP BY city, r, xb, g, rl, bl),
d AS (SELECT p.*, t || CASE WHEN p.r + p.xb + p.g = 0 THEN chr(10) || 'No new leads today.' ELSE '' END || CASE WHEN tr = 0 THEN chr(10) || 'No requirement was posted anywhere we can read today.' ELSE '' END || chr(10) || 'Reply with R<n>/L<n>/G<n> won/lost/contacted to update.' AS text FROM p JOIN whole USING (city, r, xb, g, rl, bl))
"""


def _digest_leads(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "requirement").when(F.col("id") % 7 == 1, "registration").otherwise("buyer")
    return scored(spark, d).withColumns({"kind": kind, "why_now": F.concat(F.lit("since "), F.col("why_now_date").cast("string"))})


@query("{L}, " + DIGEST_SQL + ", " + PLAN_SQL + """, limits AS (SELECT d.*, m FROM d, (VALUES (400), (700), (1500)) AS v(m)), chosen AS (SELECT * FROM limits WHERE length(text) <= m QUALIFY row_number() OVER (PARTITION BY city, m ORDER BY nr - r, 3 - rl, nb - xb, ng - g, 3 - bl) = 1)
SELECT city, CAST(m AS INT) AS max_chars, text, CAST(r + xb + g AS INT) AS shown, CAST(tr + tb + tg AS INT) AS considered, CAST(tr AS INT) AS requirements_considered, CAST(with_contact AS INT) AS with_contact, CAST(rl AS INT) AS r_lines, CAST(bl AS INT) AS b_lines FROM chosen""")
def digest_by_city(spark, d):
    """The digest of every city at three limits."""
    leads, out = _digest_leads(spark, d), None
    for limit in (400, 700, 1500):
        one = digest.digests(leads, DIGEST_CAPS, "Morning", limit).drop("index").withColumn("max_chars", F.lit(limit))
        out = one if out is None else out.unionByName(one)
    return out


@query("{L}, " + DIGEST_SQL + " SELECT city, section, row_number() OVER (PARTITION BY city ORDER BY CASE section WHEN 'R' THEN 0 WHEN 'L' THEN 1 ELSE 2 END, score DESC, turn, id) AS position, id, b3 AS block FROM b")
def digest_full_sheets(spark, d):
    """Every new lead of every city with all its lines."""
    return digest.full_sheets(_digest_leads(spark, d))


@query("{L}, p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, id) AS place FROM leads WHERE status = 'new') SELECT city, CAST(place AS INT) AS place, id, score, CAST(row_number() OVER (ORDER BY city, place) AS INT) AS label FROM p WHERE place <= 3")
def per_city_buyers(spark, d):
    top = ranking.top_per(scored(spark, d).where("status = 'new'"), ["city"], [F.desc("score"), "id"], 3)
    # At most three rows a city reach the one numbering task.
    return top.select("city", "place", "id", "score", F.row_number().over(Window.orderBy("city", "place")).alias("label"))


@query("""WITH s AS (SELECT s_suppkey AS id, n_name AS city, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 3 END AS weight, 'ext' || s_suppkey AS external_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY weight, external_id) AS place FROM s) SELECT id, city, weight, CAST(place AS INT) AS place FROM p WHERE place <= 4""")
def rank_for_cap(spark, d):
    rows = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    weight = F.when(F.col("s_suppkey") % 3 == 0, 0).when(F.col("s_suppkey") % 3 == 1, 1).otherwise(3)
    rows = rows.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("city"), weight.alias("weight"), F.concat(F.lit("ext"), F.col("s_suppkey").cast("string")).alias("external_id"))
    return ranking.top_per(rows, ["city"], ["weight", "external_id"], 4).select("id", "city", "weight", "place")


@query("{L}, s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN website IS NULL THEN 1 ELSE 0 END, score DESC, id) AS place FROM leads) SELECT id, source, score, CAST(place AS INT) AS place FROM s WHERE place <= 8")
def tier_selection(spark, d):
    rows = ranking.top_per(scored(spark, d), ["source"], [F.col("website").isNull(), F.desc("score"), "id"], 8)
    return rows.select("id", "source", "score", "place")


@query("{L}, a AS (SELECT id, city, segment, score FROM leads WHERE status <> 'new' OR city < 'B'), b AS (SELECT id, city, segment, score FROM leads WHERE status = 'new'), u AS (SELECT * FROM a UNION SELECT * FROM b), t AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, id) AS turn FROM u) SELECT id, city, score, CAST(turn AS INT) AS turn FROM t")
def combine_city_sets(spark, d):
    leads = scored(spark, d).select("id", "city", "segment", "score", "status")
    both = dedupe.union_sources(leads.where("status <> 'new' OR city < 'B'"), leads.where("status = 'new'"))
    both = both.drop("status")
    return ranking.diversified(dedupe.keep_first(both, ["id"], ["ord"])).select("id", "city", "score", "turn")


@query("SELECT 's' || s_suppkey AS id, s_name AS name, 0 AS ord FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, 1 FROM customer")
def source_union(spark, d):
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return dedupe.union_sources(s, c)


@query("WITH i AS (SELECT c_custkey, c_name || '+' AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT * FROM i")
def merge_upsert_table(spark, d):
    customer = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    incoming = customer.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("+")))
    return dedupe.upsert(customer, incoming, "c_custkey")


@query("SELECT o_orderkey, o_totalprice, false AS inserted FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, true FROM orders WHERE o_orderkey % 2 = 1")
def insert_if_absent(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return dedupe.insert_absent(orders.where("o_orderkey % 2 = 0"), orders.unionByName(orders), "o_orderkey", ["o_totalprice"])


@query("WITH e AS (SELECT event_id, event_type AS type, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS key FROM events), l AS (SELECT DISTINCT type, key FROM e WHERE event_id % 10 = 0 AND key IS NOT NULL) SELECT type, key, min(event_id) AS event_id FROM e WHERE event_id % 10 <> 0 AND key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.type = e.type AND l.key = e.key) GROUP BY type, key UNION ALL SELECT type, key, event_id FROM e WHERE event_id % 10 <> 0 AND key IS NULL")
def append_events_keyed(spark, d):
    events = read(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("key"))
    return dedupe.append_keyed(events.where("event_id % 10 = 0"), events.where("event_id % 10 <> 0"), ["event_id"]).select("type", "key", "event_id")


@query("WITH p AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE), l_extendedprice ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, day, l_extendedprice, l_orderkey, l_linenumber FROM p WHERE n = 1")
def dedupe_prices(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice", "l_orderkey", "l_linenumber")
    return dedupe.keep_first(rows, ["l_partkey", "day", "l_extendedprice"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedupe_by_id(spark, d):
    return dedupe.keep_first(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_type, value FROM e WHERE n = 1")
def dedupe_external(spark, d):
    rows = read(spark, d, "events")
    return dedupe.first_per(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("WITH i AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS k FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS k FROM benchmark) SELECT min(doc_id) AS doc_id FROM i WHERE k <> '' AND k NOT IN (SELECT k FROM b) GROUP BY k UNION ALL SELECT doc_id FROM i WHERE k = ''")
def dedupe_against_news(spark, d):
    """Documents whose normalised text no benchmark passage has, one of each; those without letters all stay."""
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    return dedupe.against_lane(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark"), key, key, ["doc_id"]).select("doc_id")


def _resolved(spark, d):
    """Suppliers as leads that come in, against the customers: by phone, else by name and city."""
    leads = register(spark, d)
    shape = {"why_now": "segment", "first_seen": "why_now_date", "last_seen": "why_now_date", "notes": "status"}
    old = leads.select(*[F.col(shape.get(c, c)).alias(c) for c in resolve.FIELDS], F.col("id").alias("ord"))
    s = read(spark, d, "supplier")
    key = F.col("s_suppkey")
    new = s.select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), F.lit("buyer").alias("kind"), F.lit("hotel").alias("segment"),
        F.when(key % 2 == 0, F.concat(F.lit("Customer "), F.lpad(key.cast("string"), 9, "0"), F.lit(" Ltd"))).otherwise(F.col("s_name")).alias("name"), F.lit("Asia").alias("city"), F.lit(None).cast("string").alias("state"),
        F.when(key % 3 != 0, F.concat(F.lit("+9198"), F.lpad(key.cast("string"), 8, "0"))).alias("phone"), *(F.lit(None).cast("string").alias(c) for c in ("address", "email", "website", "why_now", "why_now_date", "first_seen", "last_seen", "notes")),
        F.lit("suppliers").alias("source"), F.lit("new").alias("status"), key.alias("ord"),
    )
    return resolve.resolve(old, new)


#: What each supplier meets: its customer by phone where both have one, or by name where that one is in Asia.
MET_SQL = """
came AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' Ltd' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN '+9198' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS phone FROM supplier),
met AS (SELECT came.*, r.id AS lead FROM came LEFT JOIN register r ON r.id = came.k AND (came.phone = r.phone OR (came.phone IS NULL AND came.k % 2 = 0 AND lower(r.city) = 'asia')))
"""


@query(f"""WITH {REGISTER_SQL}, {MET_SQL}
SELECT CAST(r.id AS VARCHAR) AS id, kind, CASE WHEN m.id IS NOT NULL AND r.segment NOT IN ('wholesale', 'food_manufacturer', 'restaurant') THEN 'hotel' ELSE r.segment END AS segment,
  CASE WHEN length(m.name) > length(r.name) THEN m.name ELSE r.name END AS name, city, state, address, coalesce(r.phone, m.phone) AS phone, email, website, r.segment AS why_now, CAST(why_now_date AS VARCHAR) AS why_now_date, source, CAST(why_now_date AS VARCHAR) AS first_seen,
  CAST(why_now_date AS VARCHAR) AS last_seen, status, status AS notes, source || CASE WHEN m.id IS NOT NULL THEN '; suppliers' ELSE '' END AS sources, 0 AS n_updated, CASE WHEN m.id IS NOT NULL THEN 1 ELSE 0 END AS n_duplicate, CASE WHEN m.id IS NOT NULL THEN 1 ELSE 0 END AS n_merged, false AS is_new
  FROM register r LEFT JOIN met m ON m.lead = r.id
UNION ALL SELECT id, 'buyer', 'hotel', name, 'Asia', NULL, NULL, phone, NULL, NULL, NULL, NULL, 'suppliers', NULL, NULL, 'new', NULL, 'suppliers', 0, 0, 0, true FROM met WHERE lead IS NULL""")
def entity_resolution_fold(spark, d):
    """The register after the suppliers; tested against a plain fold over random leads too. Ids taken in are entity_resolution_links."""
    leads = _resolved(spark, d).leads
    return leads.withColumns({"sources": F.array_join("sources", "; "), **{c: F.col(c).cast("int") for c in ("n_updated", "n_duplicate", "n_merged")}})


@query(f"WITH {REGISTER_SQL}, {MET_SQL} SELECT CAST(lead AS VARCHAR) AS lead_id, id AS merged_id, k AS first_ord FROM met WHERE lead IS NOT NULL")
def entity_resolution_links(spark, d):
    """Every id that a lead took in."""
    return _resolved(spark, d).links


@query("WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN '+9198' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS phone, 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone, replace(lower(c_name), '#', ' ') AS name FROM customer) SELECT o_orderkey, coalesce(p.c_custkey, n.c_custkey) AS lead, CASE WHEN p.c_custkey IS NOT NULL THEN 'phone' WHEN n.c_custkey IS NOT NULL THEN 'name' END AS matched FROM o LEFT JOIN c p ON o.phone = p.phone LEFT JOIN c n ON o.name = n.name")
def match_order_to_lead(spark, d):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    orders = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("+9198"), pad(F.col("o_custkey"), 8))).alias("phone"), F.concat(F.lit("customer "), pad(F.col("o_custkey"), 9)).alias("name"))
    leads = read(spark, d, "customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+9198"), pad(F.col("c_custkey"), 8))).alias("phone"), F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")).alias("name"))
    by = lambda key, name: leads.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("c_custkey").alias(name))  # first in register order
    out = orders.join(by("phone", "p"), "phone", "left").join(by("name", "n"), "name", "left")
    return out.select("o_orderkey", F.coalesce("p", "n").alias("lead"), F.when(F.col("p").isNotNull(), "phone").when(F.col("n").isNotNull(), "name").alias("matched"))


@query("SELECT c_custkey, left(sha256('src' || (c_custkey % 7) || ' ' || c_custkey), 16) AS lead_id FROM customer")
def lead_id_hash(spark, d):
    source = F.concat(F.lit("src"), (F.col("c_custkey") % 7).cast("string"))
    return read(spark, d, "customer").select("c_custkey", hashing.lead_id(source, F.col("c_custkey").cast("string")).alias("lead_id"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(c_name || CASE WHEN c_custkey % 2 = 0 THEN ', "x"' ELSE '' END, '[",\\n]') THEN '"' || replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN ', "x"' ELSE '' END, '"', '""') || '"' ELSE c_name END || ',' || c_custkey AS line FROM customer""")
def csv_cell_projection(spark, d):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ', "x"').otherwise(""))
    return read(spark, d, "customer").select("c_custkey", F.concat_ws(",", strings.csv_cell(name), strings.csv_cell(F.col("c_custkey"))).alias("line"))


@query("SELECT c_custkey, CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) = 12 THEN '+91' || right(regexp_replace(p, '[^0-9]', '', 'g'), 10) END AS phone FROM (SELECT c_custkey, '+91 98' || (c_custkey % 10) || '50 ' || (12345 + c_custkey % 1000) || CASE WHEN c_custkey % 3 = 0 THEN '; 98450 12346' ELSE '' END AS q, string_split('+91 98' || (c_custkey % 10) || '50 ' || (12345 + c_custkey % 1000), ';')[1] AS p FROM customer)")
def phone_normalise(spark, d):
    key = F.col("c_custkey")
    raw = F.concat(F.lit("+91 98"), (key % 10).cast("string"), F.lit("50 "), (12345 + key % 1000).cast("string"), F.when(key % 3 == 0, "; 98450 12346").otherwise(""))
    return read(spark, d, "customer").select("c_custkey", strings.phone(raw).alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'buyer' || c_custkey || '@example.com' END AS email FROM customer")
def email_normalise(spark, d):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("buyer"), key, F.lit("@nodot"))).otherwise(F.concat(F.lit("tel; mailto:Buyer"), key, F.lit("@Example.com, x@y.z")))
    return read(spark, d, "customer").select("c_custkey", strings.email(raw).alias("email"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ' & Sons Pvt Ltd'), '[^a-z0-9]+', ' ', 'g'), ' (sons) pvt ltd', ' and sons')) AS k FROM customer".replace("' and sons'", "' sons'"))
def name_key(spark, d):
    return read(spark, d, "customer").select("c_custkey", strings.name_key(F.concat("c_name", F.lit(" & Sons Pvt Ltd"))).alias("k"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name || ' , City'), '[^a-z]', '', 'g') AS k FROM nation")
def city_key(spark, d):
    return read(spark, d, "nation").select("n_nationkey", strings.city_key(F.concat("n_name", F.lit(" , City"))).alias("k"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 60 THEN left(s, 59) || '…' ELSE s END AS tidy, CASE WHEN length(s) > 40 THEN rtrim(left(s, 39)) || '.' ELSE s END AS clip FROM t")
def tidy_clip(spark, d):
    return read(spark, d, "documents").select("doc_id", strings.tidy(F.col("text"), 60).alias("tidy"), strings.clip(F.col("text"), 40).alias("clip"))
