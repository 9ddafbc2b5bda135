"""Queries over loops and answers: orders to leads, weekly report, signals, model answers, labels of alerts and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, labels
from ..operators import orders as loop
from ..operators import ranking, report
from ..session import scratch
from ..sources import bundles
from .leads import scored
from .reports import WEEK
from .tables import REGISTER_SQL, read, register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{L}", "WITH " + REGISTER_SQL)
        return f

    return add


# ---------------------------------------------------------------------------------------
# Answers

_ENRICH = '{"segment": "hotel", "size": "large", "confidence": 1.4, "buys": ["onion", 3, " "], "deadline": "1998-09-30", "evidence": []}'


@query("""SELECT c_custkey, k IN (0, 1, 2, 6) AS ok,
  CASE k WHEN 3 THEN 'reply is not JSON' WHEN 4 THEN 'size is missing or not a string; confidence is missing or not a number' WHEN 5 THEN 'segment "casino" is not one of the listed values' WHEN 7 THEN 'reply is not a JSON object' END AS reason,
  CASE k WHEN 0 THEN 'hotel' WHEN 1 THEN 'hotel' WHEN 2 THEN 'hotel' WHEN 6 THEN 'caterer' END AS segment, CASE k WHEN 0 THEN 'onion' WHEN 1 THEN 'onion' WHEN 2 THEN 'onion' WHEN 6 THEN '' END AS buys,
  CASE WHEN k < 3 THEN DATE '1998-09-30' END AS deadline, CASE WHEN k = 6 THEN 'soon' END AS deadline_dropped, CASE WHEN k < 3 THEN 1.0::DOUBLE WHEN k = 6 THEN (c_custkey % 10) / 10.0::DOUBLE END AS confidence
FROM (SELECT c_custkey, c_custkey % 8 AS k FROM customer)""")
def answers_enrich(spark, d):
    """One answer for each customer, in eight forms by the key: bare, fenced, in prose, broken, incomplete, unknown values, with a bad date, a list."""
    key = F.col("c_custkey")
    forms = [
        F.lit(_ENRICH), F.lit(f"Sure:\n```json\n{_ENRICH}\n```\nbye"), F.lit(f"The answer is {_ENRICH} as asked."), F.lit("no answer { here"), F.lit('{"segment": "hotel", "size": null}'),
        F.lit('{"segment": "casino", "size": "small", "confidence": 0.5}'), F.concat(F.lit('{"segment": "caterer", "size": "unknown", "deadline": "soon", "confidence": 0.'), (key % 10).cast("string"), F.lit("}")), F.lit("[1, 2]"),
    ]
    text = F.element_at(F.array(*forms), (key % 8 + 1).cast("int"))
    a = read(spark, d, "customer").select("c_custkey", answers.parse_enrich(text).alias("a"))
    return a.select("c_custkey", "a.ok", "a.reason", "a.segment", F.array_join("a.buys", ",").alias("buys"), "a.deadline", "a.deadline_dropped", "a.confidence")


@query("""SELECT s_suppkey, s_suppkey % 3 <> 2 AS ok, CASE WHEN s_suppkey % 3 = 2 THEN 'is_requirement is missing or not true/false' END AS reason,
  CASE WHEN s_suppkey % 3 <> 2 THEN s_suppkey % 3 = 0 END AS is_requirement, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS organisation, CASE WHEN s_suppkey % 3 = 0 THEN 'a ' || repeat('b', 118) END AS quantity,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.25::DOUBLE WHEN s_suppkey % 3 = 1 THEN 0.0 END AS confidence FROM supplier""")
def answers_requirement(spark, d):
    key = F.col("s_suppkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit('{"is_requirement": true, "organisation": " '), "s_name", F.lit(f'", "city": 7, "quantity": "a  {"b" * 200}", "confidence": 0.25}}')))
        .when(key % 3 == 1, F.lit('```\n{"is_requirement": false, "confidence": -3, "organisation": ""}\n```'))
        .otherwise(F.lit('{"is_requirement": "yes", "confidence": 1}'))
    )
    a = read(spark, d, "supplier").select("s_suppkey", answers.parse_requirement(text).alias("a"))
    return a.select("s_suppkey", *(f"a.{c}" for c in ("ok", "reason", "is_requirement", "organisation", "quantity", "confidence")))


@query("""SELECT p_partkey, k IN (0, 5) AS ok, CASE k WHEN 1 THEN 'expected two lines, got 1' WHEN 2 THEN 'a line is 121 characters, over the 120 limit' WHEN 3 THEN 'the reply uses marketing language' WHEN 4 THEN 'the reply contains an emoji' END AS reason,
  CASE WHEN k = 0 THEN p_name || chr(10) || 'Second' WHEN k = 5 THEN 'one' || chr(10) || 'two' END AS opener FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def answers_opener(spark, d):
    name, key = F.col("p_name"), F.col("p_partkey")
    forms = [F.concat(F.lit('- "'), name, F.lit('"\n\n* Second')), name, F.lit("x" * 121 + "\nb"), F.concat(name, F.lit("\nOur World-Class line")), F.lit("a \U0001f600\nb"), F.lit("```text\none\ntwo\nthree```")]
    a = read(spark, d, "part").select("p_partkey", answers.parse_opener(F.element_at(F.array(*forms), (key % 6 + 1).cast("int"))).alias("a"))
    return a.select("p_partkey", "a.ok", "a.reason", "a.opener")


# ---------------------------------------------------------------------------------------
# Orders to leads


def site_orders(spark, d):
    """Orders as a site takes them: two of three name the customer's phone, one of two the customer's name, all the city Asia; each fifth is sent twice."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    one = read(spark, d, "orders").select(
        F.concat(F.lit("O"), key.cast("string")).alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("received_at"),
        F.when(key % 3 != 0, F.concat(F.lit("98"), F.lpad(cust, 8, "0"))).alias("phone"), F.when(key % 4 == 0, F.concat(F.lit("Buyer"), cust, F.lit("@Order.example"))).alias("email"),
        F.when(key % 2 == 0, F.concat(F.lit("Customer "), F.lpad(cust, 9, "0"), F.lit(" Ltd"))).otherwise(F.concat(F.lit("New Buyer "), (F.col("o_custkey") % 50).cast("string"))).alias("business_name"),
        F.lit(None).cast("string").alias("contact_name"), F.lit("Asia.").alias("city"), F.array(F.concat(F.lit("p"), (key % 5).cast("string")), F.lit("q")).alias("products"),
        F.lit("line  one\r\n\n two ").alias("details"), F.lit(None).cast("string").alias("notes"), key.alias("order_key"),
    )
    return one.drop("order_key").unionByName(one.where("order_key % 5 = 0").drop("order_key"))


def lead_register(spark, d):
    rows = register(spark, d)
    return rows.select(F.col("id").cast("string").alias("id"), "kind", "name", "city", "phone", "email", "status", F.lit(None).cast("string").alias("why_now"), F.lit(None).cast("string").alias("notes"), F.col("id").alias("ord"))


ORDERS_SQL = """{L}, o AS (SELECT 'O' || o_orderkey AS id, o_orderdate AS placed, CASE WHEN o_orderkey % 3 <> 0 THEN '+9198' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS phone,
  CASE WHEN o_orderkey % 4 = 0 THEN 'buyer' || o_custkey || '@order.example' END AS email, CASE WHEN o_orderkey % 2 = 0 THEN 'Customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' Ltd' ELSE 'New Buyer ' || (o_custkey % 50) END AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'new buyer ' || (o_custkey % 50) END AS k, 'p' || (o_orderkey % 5) || ', q; line one; two' AS lines FROM orders),
r AS (SELECT id, phone, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k, regexp_replace(lower(city), '[^a-z]', '', 'g') AS c, status FROM register),
m AS (SELECT o.*, coalesce(p.id, n.id) AS lead, CASE WHEN p.id IS NOT NULL THEN 'phone' WHEN n.id IS NOT NULL THEN 'name+city' END AS matched_on, coalesce(p.status, n.status) AS status
  FROM o LEFT JOIN r p ON p.phone = o.phone LEFT JOIN r n ON n.k = o.k AND n.c = 'asia'),
x AS (SELECT *, coalesce(CAST(lead AS VARCHAR), left(sha256('site ' || coalesce(phone, k || '|asia')), 16)) AS id_of FROM m)"""


@query(ORDERS_SQL + " SELECT id, CAST(lead AS VARCHAR) AS lead, matched_on FROM x")
def order_match(spark, d):
    fresh = loop.record_orders(read(spark, d, "orders").select(F.lit("none").alias("id")).limit(0), site_orders(spark, d))
    return loop.match_leads(fresh, lead_register(spark, d)).select("id", "lead", "matched_on")


@query(ORDERS_SQL + """, g AS (SELECT id_of, (list(id ORDER BY placed, id))[-1] AS last, (list('Ordered on ' || CAST(placed AS DATE) || ': ' || lines ORDER BY placed, id))[-1] AS why, (list(phone ORDER BY placed, id) FILTER (phone IS NOT NULL))[1] AS phone,
  (list(email ORDER BY placed, id) FILTER (email IS NOT NULL))[1] AS email, (list(name ORDER BY placed, id))[1] AS name FROM x GROUP BY id_of)
SELECT coalesce(CAST(l.id AS VARCHAR), id_of) AS id, coalesce(l.name, g.name) AS name, CASE WHEN l.id IS NULL THEN 'Asia.' ELSE city END AS city, coalesce(l.phone, g.phone) AS phone, coalesce(l.email, g.email) AS email,
  CASE WHEN id_of IS NOT NULL THEN 'won' ELSE status END AS status, why AS why_now, CASE WHEN id_of IS NOT NULL AND l.id IS NOT NULL THEN 'won: order ' || last END AS notes, l.id IS NULL AS created FROM register l FULL JOIN g ON CAST(l.id AS VARCHAR) = g.id_of""")
def order_loop_leads(spark, d):
    """The register after every order of the site was recorded once."""
    leads = lead_register(spark, d)
    fresh = loop.record_orders(read(spark, d, "orders").select(F.lit("none").alias("id")).limit(0), site_orders(spark, d))
    return loop.upsert_leads(leads, fresh).select("id", "name", "city", "phone", "email", "status", "why_now", "notes", "created")


@query(ORDERS_SQL + " SELECT id_of AS lead, id AS order_id, 'p' || (CAST(id[2:] AS BIGINT) % 5) || ', q|line one|two' AS lines FROM x WHERE CAST(id[2:] AS BIGINT) % 7 <> 0 OR lead IS NULL")
def order_loop_rows(spark, d):
    """Orders to append to their leads; each seventh of a known lead was appended before."""
    orders, leads = site_orders(spark, d), lead_register(spark, d)
    before = loop.match_leads(orders, leads).where((F.substring("id", 2, 20).cast("long") % 7 == 0) & F.col("lead").isNotNull()).select("lead", F.col("id").alias("order_id"))
    return loop.lead_orders(before, orders, leads).select("lead", "order_id", F.array_join("lines", "|").alias("lines"))


@query(ORDERS_SQL + " SELECT 'order.received' AS type, id AS key, CAST(lead AS VARCHAR) AS lead, NULL AS \"from\" FROM x UNION ALL SELECT 'lead.won', id, CAST(lead AS VARCHAR), status FROM x WHERE coalesce(status <> 'won', true)")
def order_loop_events(spark, d):
    leads = lead_register(spark, d)
    fresh = loop.record_orders(read(spark, d, "orders").select(F.lit("none").alias("id")).limit(0), site_orders(spark, d))
    return loop.order_events(loop.match_leads(fresh, leads), leads).select("type", "key", "lead", "from")


def _alert():
    """An alert for each order, by its key."""
    key = F.col("o_orderkey")
    whatsapp = F.struct(
        (key % 2 == 0).alias("sent"), (key % 3 == 0).alias("window_closed"), (key % 5 == 0).alias("failed_later"), F.when(key % 7 == 0, "no number").alias("reason"),
        F.when(key % 2 == 0, F.concat(F.lit("m"), key.cast("string"))).alias("message_id"),
    )
    return F.struct((key % 11 == 0).alias("skipped"), whatsapp.alias("whatsapp"), F.struct((key % 4 == 1).alias("sent"), F.when(key % 13 == 0, "refused").alias("reason")).alias("email"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not sent' WHEN o_orderkey % 2 = 0 THEN 'WhatsApp sent'
  WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'email (WhatsApp failed: window closed)' WHEN o_orderkey % 3 = 0 THEN 'email (WhatsApp window closed)' WHEN o_orderkey % 5 = 0 THEN 'email (WhatsApp failed after sending)' ELSE 'email (WhatsApp refused)' END
  WHEN o_orderkey % 7 = 0 THEN 'not delivered: no number' WHEN o_orderkey % 13 = 0 THEN 'not delivered: refused' ELSE 'no alert recorded' END AS label, NOT (o_orderkey % 2 = 0 OR o_orderkey % 4 = 1) AS missed FROM orders""")
def alert_labels(spark, d):
    return read(spark, d, "orders").select("o_orderkey", labels.alert_label(_alert()).alias("label"), labels.alert_missed(_alert()).alias("missed"))


@query("SELECT 'm' || l_orderkey AS message_id, l_linenumber, CASE WHEN l_orderkey % 2 = 0 AND o_orderkey IS NOT NULL THEN 'O' || l_orderkey END AS order_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def alert_orders(spark, d):
    """Reports of messages with the order whose alert they were."""
    messages = read(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("message_id"), "l_linenumber")
    orders = read(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), _alert().alias("alert"))
    return loop.by_alert(messages, orders).select("message_id", "l_linenumber", "order_id")


@query("""SELECT event_id, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 = 0 THEN 'email, then the template resent (WhatsApp failed: ' || c || ')' ELSE 'template resent (WhatsApp failed: ' || c || ')' END
  WHEN k % 7 = 0 THEN 'email only (WhatsApp failed: ' || c || ')' ELSE 'not delivered (WhatsApp failed: ' || c || ')' END
  WHEN k % 3 = 0 AND k % 7 = 0 THEN CASE WHEN k % 4 = 0 THEN 'email, then the template resent' ELSE 'email and WhatsApp' END WHEN k % 3 = 0 THEN CASE WHEN k % 9 = 0 THEN 'WhatsApp (template)' ELSE 'WhatsApp' END
  WHEN k % 7 = 0 THEN CASE WHEN k % 11 = 0 THEN 'email only (closed)' ELSE 'email only' END WHEN k % 13 = 0 THEN 'not delivered: no host' WHEN k % 11 = 0 THEN 'not delivered: closed' ELSE 'nothing recorded' END AS label
FROM (SELECT event_id, event_id AS k, CASE WHEN event_id % 4 = 0 THEN '131047' ELSE 'no code' END AS c FROM events)""")
def delivery_labels(spark, d):
    k = F.col("event_id")
    email = F.struct((k % 7 == 0).alias("sent"), F.when(k % 13 == 0, "no host").alias("reason"))
    whatsapp = F.struct((k % 3 == 0).alias("sent"), (k % 4 == 0).alias("resent"), F.when(k % 9 == 0, "template").alias("via"), F.when(k % 11 == 0, "closed").alias("reason"))
    row = F.struct(email.alias("email"), whatsapp.alias("whatsapp"), (k % 2 == 0).alias("failed_later"), F.when(k % 5 == 0, "r").alias("resent_id"), F.when(k % 4 == 0, 131047).alias("code"))
    return read(spark, d, "events").select("event_id", labels.delivery_label(row).alias("label"))


@query("SELECT user_id, event_type, CASE WHEN n % 2 = 0 THEN 'seen' ELSE 'new' END AS state, n, CAST(last AS VARCHAR) AS last FROM (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2)")
def patch_events(spark, d):
    """Keyed events patched by every event of their key, in order: counted once and marked where the count is even."""
    events = read(spark, d, "events")
    log = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    log = log.select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.create_map(F.lit("state"), F.lit("new"), F.lit("n"), F.col("n").cast("string")).alias("payload"))
    each = events.select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("patch"))
    even = log.where("CAST(payload['n'] AS BIGINT) % 2 = 0").select("type", "key", F.lit(-1).cast("long").alias("ord"), F.create_map(F.lit("state"), F.lit("seen")).alias("patch"))
    p = lambda k: F.col("payload")[k]
    return loop.patch_events(log, each.unionByName(even)).select(F.col("key").cast("long").alias("user_id"), F.col("type").alias("event_type"), p("state").alias("state"), p("n").cast("long").alias("n"), p("last").alias("last"))


# ---------------------------------------------------------------------------------------
# Signals and the week


@query("""{L}, s AS (SELECT id, score, CASE WHEN id % 4 = 0 THEN 'requirement_candidate' WHEN id % 4 = 1 THEN 'awareness' END AS tier, id % 3 = 0 AS wrapped FROM leads)
SELECT id FROM (SELECT id FROM s WHERE tier = 'requirement_candidate' ORDER BY wrapped, score DESC, id LIMIT 12) UNION ALL SELECT id FROM s WHERE tier IS DISTINCT FROM 'requirement_candidate'""")
def select_signals(spark, d):
    """The first twelve requirement candidates, direct links first, then all other signals."""
    key = F.col("id")
    rows = scored(spark, d).select("id", "score", F.when(key % 4 == 0, "requirement_candidate").when(key % 4 == 1, "awareness").alias("tier"), F.when(key % 3 == 0, "https://news.google.com/rss/articles/x").otherwise("https://paper.example/x").alias("url"))
    return ranking.signals(rows, 12, labels.is_wrapped_news_link(F.col("url"))).select("id")


@query("SELECT o_orderkey AS event, coalesce(c_name, CAST(o_custkey * (CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 1 END) AS VARCHAR)) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey * (CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 1 END)")
def status_change_names(spark, d):
    """Status events with the name of their lead; each ninth speaks of a lead that is gone."""
    events = read(spark, d, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") * F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(1)).alias("lead"))
    return report.named_changes(events, register(spark, d).select("id", "name")).select("event", "name")


_IN_WEEK = "BETWEEN DATE '1998-07-27' AND DATE '1998-08-02'"
_PRICE = "SELECT 'P' || (l_partkey % 10) AS commodity, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS p FROM lineitem"


@query(f"""{{L}}, l AS (SELECT *, DATE '1998-08-02' - CAST(id % 30 AS INT) AS first_seen FROM register), f AS (SELECT * FROM l WHERE first_seen {_IN_WEEK}),
e AS (SELECT o_custkey AS lead, ['new', 'contacted', 'quoted', 'won', 'lost', 'ignored'][CAST(o_orderkey % 6 AS INT) + 1] AS t FROM orders WHERE CAST(o_orderdate AS DATE) {_IN_WEEK}),
o AS (SELECT *, CAST(o_orderdate AS DATE) {_IN_WEEK} AS w FROM orders), r AS (SELECT s_suppkey AS id, DATE '1998-07-20' + CAST(s_suppkey % 12 AS INT) AS day, 'src' || s_suppkey % 3 AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'why ' || s_suppkey % 7 END AS blocked FROM supplier),
rw AS (SELECT * FROM r WHERE day {_IN_WEEK}), p AS (SELECT commodity, CAST(floor(avg(p) FILTER (d {_IN_WEEK}) + 0.5) AS BIGINT) AS now, count(*) FILTER (d {_IN_WEEK}) AS n, CAST(floor(avg(p) FILTER (d BETWEEN DATE '1998-07-20' AND DATE '1998-07-26') + 0.5) AS BIGINT) AS before FROM ({_PRICE}) GROUP BY 1 HAVING n > 0),
a AS (SELECT 'register' AS measure, '' AS key, (SELECT count(*) FROM l) AS value, NULL AS note UNION ALL SELECT 'found', '', (SELECT count(*) FROM f), NULL UNION ALL SELECT 'with_phone', '', (SELECT count(phone) FROM f), NULL
UNION ALL SELECT 'no_contact', '', (SELECT count(*) FROM l WHERE phone IS NULL AND email IS NULL AND website IS NULL), NULL
UNION ALL SELECT 'funnel', s, (SELECT count(*) FROM l WHERE status = s), NULL FROM (SELECT unnest(['new', 'contacted', 'quoted', 'won', 'lost', 'ignored']) AS s)
UNION ALL SELECT 'changes', s, (SELECT count(*) FROM e WHERE t = s), NULL FROM (SELECT unnest(['contacted', 'quoted', 'won', 'lost', 'ignored']) AS s)
UNION ALL SELECT 'runs', '', (SELECT count(DISTINCT id) FROM rw), NULL UNION ALL SELECT 'run_days', '', (SELECT count(DISTINCT day) FROM rw), NULL
UNION ALL SELECT 'orders_total', '', (SELECT count(*) FROM o), NULL UNION ALL SELECT 'orders', '', (SELECT count(*) FROM o WHERE w), NULL UNION ALL SELECT 'not_delivered', '', (SELECT count(*) FROM o WHERE w AND NOT (o_orderkey % 2 = 0 OR o_orderkey % 4 = 1)), NULL
UNION ALL SELECT 'city', city, count(*), NULL FROM f GROUP BY city UNION ALL SELECT 'segment', replace(segment, '_', ' '), count(*), NULL FROM f GROUP BY segment
UNION ALL SELECT 'won', coalesce(name, CAST(lead AS VARCHAR)), count(*), NULL FROM e LEFT JOIN l ON l.id = e.lead WHERE t = 'won' GROUP BY 2
UNION ALL SELECT 'untouched', segment || '|' || city, count(*), NULL FROM l WHERE status = 'new' AND phone IS NOT NULL GROUP BY 2
UNION ALL SELECT 'missed_day', CAST(d AS VARCHAR), 1, NULL FROM (SELECT DATE '1998-07-27' + i AS d FROM (SELECT unnest(range(6))::INT AS i)) WHERE d NOT IN (SELECT day FROM rw)
UNION ALL SELECT 'source', source, CAST(sum(id) AS BIGINT), NULL FROM rw GROUP BY source
UNION ALL SELECT 'blocked', source, max(n), max(blocked) FROM (SELECT source, blocked, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY day, id) AS i FROM rw WHERE blocked IS NOT NULL) WHERE i = 1 GROUP BY source
UNION ALL SELECT 'order_city', 'ASIA', count(*), NULL FROM o WHERE w HAVING count(*) > 0 UNION ALL SELECT 'product', 'p' || o_orderkey % 5, count(*), NULL FROM o WHERE w GROUP BY 2
UNION ALL SELECT 'order_buyer', 'B' || o_custkey % 20, count(*), NULL FROM o WHERE w GROUP BY 2
UNION ALL SELECT 'price', commodity, now, NULL FROM p UNION ALL SELECT 'price_readings', commodity, n, NULL FROM p UNION ALL SELECT 'price_before', commodity, before, NULL FROM p
UNION ALL SELECT 'price_change', commodity, CASE WHEN before <> 0 THEN CAST(floor((now - before) / before * 100 + 0.5) AS BIGINT) END, NULL FROM p) SELECT * FROM a""")
def weekly_report(spark, d):
    """All numbers of the report of one week, as rows."""
    key = F.col("o_orderkey")
    leads = register(spark, d).withColumn("first_seen", F.date_sub(F.lit("1998-08-02").cast("date"), (F.col("id") % 30).cast("int")))
    runs = read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.date_add(F.lit("1998-07-20").cast("date"), (F.col("s_suppkey") % 12).cast("int")).cast("timestamp").alias("started_at"), F.concat(F.lit("src"), (F.col("s_suppkey") % 3).cast("string")).alias("source"),
        F.col("s_suppkey").alias("n"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("why "), (F.col("s_suppkey") % 7).cast("string"))).alias("blocked"),
    )
    orders = read(spark, d, "orders")
    to = F.element_at(F.array(*map(F.lit, ("new", "contacted", "quoted", "won", "lost", "ignored"))), (key % 6 + 1).cast("int"))
    events = orders.select(F.lit("lead.status_changed").alias("type"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("lead"), to.alias("to"))
    placed = orders.select(
        key.alias("id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("B"), (F.col("o_custkey") % 20).cast("string")).alias("business_name"), F.lit("ASIA").alias("city"),
        F.array(F.concat(F.lit("p"), (key % 5).cast("string")), F.lit(" "), F.concat(F.lit("p"), (key % 5).cast("string"))).alias("products"), labels.alert_missed(_alert()).alias("missed"),
    )
    prices = read(spark, d, "lineitem").select(F.concat(F.lit("P"), (F.col("l_partkey") % 10).cast("string")).alias("commodity"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("price"))
    return report.weekly_report(leads, runs, events, placed, prices, WEEK, F.lit("1998-08-01").cast("date"))


@query("SELECT s_suppkey AS run, s_suppkey % 3 <> 0 AS sealed FROM supplier")
def runs_to_bundles(spark, d):
    """Whether a bundle exists for each run; bundle files may repeat and may have no run."""
    runs = read(spark, d, "supplier").select(F.col("s_suppkey").alias("run"))
    files = read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.explode(F.array("s_suppkey", F.col("s_suppkey"), -F.col("s_suppkey"))).alias("i"))
    paths = files.select(F.concat(F.lit("bundles/run-"), F.col("i").cast("string"), F.lit(".json")).alias("path"))
    bundles = paths.select(F.regexp_extract("path", r"run-(-?\d+)\.json$", 1).cast("long").alias("run")).distinct().withColumn("there", F.lit(True))
    return runs.join(bundles, "run", "left").select("run", F.col("there").isNotNull().alias("sealed"))


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS run, CAST(strftime(o_orderdate, '%m') AS INT) + CAST(strftime(o_orderdate, '%Y') AS INT) AS k, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS seq FROM orders),
p AS (SELECT run, k, seq, '{"seq":' || seq || ',"type":"order.received","at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","role":"desk","data":{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' AS payload FROM o
  UNION ALL SELECT run, any_value(k), count(*), '{"seq":' || count(*) || ',"type":"evidence.sealed","at":"' || strftime(max(o_orderdate), '%Y-%m-%d') || '","role":"auditor","runId":"' || run || '","receiptCount":' || count(*) || '}' FROM o GROUP BY run),
h AS (SELECT run, any_value(k) AS k, sha256('evidence/1' || chr(10) || count(*) || chr(10) || string_agg(payload || chr(10), '' ORDER BY seq)) AS good, sha256('evidence/1' || chr(10) || count(*) || chr(10) || string_agg(replace(payload, '"status":"O"', '"status":"F"') || chr(10), '' ORDER BY seq)) AS bad FROM p GROUP BY run)
SELECT run, CASE WHEN k % 11 = 3 THEN 0 ELSE 1 END AS files, CASE WHEN k % 11 = 3 THEN '' WHEN k % 7 = 0 THEN bad ELSE good END AS recomputed, CASE WHEN k % 11 = 3 THEN 'no file' WHEN k % 7 = 0 AND bad <> good THEN 'hash mismatch; not the hash of the run' ELSE '' END AS problems FROM h
UNION ALL SELECT 'stray-' || run, 1, good, 'no run' FROM h WHERE k % 13 = 5""")
def bundle_files_verified(spark, d):
    """A bundle of each month's orders, written as a file, scanned and held against the runs; some are changed, some missing, some of no run."""
    orders = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    entries = orders.select(F.date_format("day", "yyyy-MM").alias("bundle"), F.col("o_orderkey").alias("ord"), F.lit("order.received").alias("type"), F.col("day").cast("string").alias("at"), F.lit(None).cast("string").alias("role"), F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("data"))
    none = entries.select("bundle", F.lit(0).cast("long").alias("seq"), F.lit("").alias("payload")).limit(0)
    runs = bundles.sealed(bundles.numbered(none, entries))
    k = F.substring("bundle", 6, 2).cast("int") + F.substring("bundle", 1, 4).cast("int")
    changed = F.when(k % 7 == 0, F.replace("body", F.lit('"status":"O"'), F.lit('"status":"F"'))).otherwise(F.col("body"))
    kept = runs.where(k % 11 != 3).select("bundle", changed.alias("body"))
    path = scratch(spark, "bundles")
    bundles.write_bundles(kept.unionByName(runs.where(k % 13 == 5).select(F.concat(F.lit("stray-"), "bundle").alias("bundle"), "body")), path)
    return bundles.against_runs(runs.select(F.col("bundle").alias("run"), "hash"), bundles.problems(bundles.scan(spark, path)))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' || doc_id END AS answer, doc_id % 4 = 0 AS hit FROM documents")
def calls_to_cache(spark, d):
    """Calls with the cached answer of their key, if any."""
    key = F.sha2(F.concat_ws("\n", "lang", F.col("doc_id").cast("string")), 256)
    calls = read(spark, d, "documents").select("doc_id", key.alias("key"))
    cache = read(spark, d, "documents").where("doc_id % 4 = 0").select(key.alias("key"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer"))
    return calls.join(cache, "key", "left").select("doc_id", "answer", F.col("answer").isNotNull().alias("hit"))


# ---------------------------------------------------------------------------------------
# Lines and facts

OPENERS = {"requirement": "You asked for {what}.", "registration": "Please list us for {what}.", "registration_plain": "Please list us.", "hotel": "We supply hotels.", "other": "We supply fresh produce."}


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 'You asked for ' || CASE WHEN p_partkey % 8 = 0 THEN 'RFQ onions' ELSE 'onions' END || '.' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'Please list us.' ELSE 'Please list us for Onions.' END WHEN 2 THEN 'We supply hotels.' ELSE 'We supply fresh produce.' END AS opener,
  CASE WHEN k = 0 THEN 'no quantity or closing date stated' WHEN k = 1 THEN '5 kg' WHEN k = 2 THEN '5 kg - closes 1998-09-30' ELSE 'document could not be read as text' END AS terms FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def lead_lines(spark, d):
    """Opener and terms of a lead for each part."""
    k, key = F.col("p_partkey") % 4, F.col("p_partkey")
    kind = F.when(k == 0, "requirement").when(k == 1, "registration").otherwise("buyer")
    what = F.when(key % 8 == 0, "RFQ onions.").when(key % 8 == 1, F.lit(None).cast("string")).when(k == 0, "Onions.").otherwise("Onions")
    line = labels.opener(kind, F.when(k == 2, "hotel").otherwise("bank"), what, OPENERS)
    terms = labels.requirement_terms(F.when(k.isin(1, 2), "5  kg"), F.when(k == 2, F.lit("1998-09-30").cast("date")), k == 3)
    return read(spark, d, "part").select("p_partkey", line.alias("opener"), terms.alias("terms"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'an evidence quote from their own page' END, CASE WHEN c_custkey % 3 = 0 THEN 'the title of their website' END, CASE WHEN c_custkey % 5 = 0 THEN 'the requirement text on the notice' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'a stated quantity' END, CASE WHEN c_custkey % 11 = 0 THEN 'a stated deadline' END], lambda x: x IS NOT NULL), '; ') AS facts FROM customer""")
def concrete_facts(spark, d):
    k = F.col("c_custkey")
    evidence = F.when(k % 2 == 0, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>"))
    facts = labels.concrete_facts(evidence, F.when(k % 3 == 0, "t"), F.when(k % 5 == 0, "r").otherwise(""), F.when(k % 7 == 0, "5 kg"), F.when(k % 11 == 0, F.lit("1998-09-30").cast("date")))
    return read(spark, d, "customer").select("c_custkey", F.array_join(facts, "; ").alias("facts"))


CITIES = {"Lisbon": ("lisboa",), "Porto": ("oporto", "porto city"), "Faro": ()}


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Lisbon' WHEN 1 THEN 'Porto' WHEN 2 THEN 'Faro' END AS city FROM orders")
def city_named(spark, d):
    k = F.col("o_orderkey")
    forms = [F.lit("A hotel in LISBOA, near Porto"), F.concat(F.lit("Order "), k.cast("string"), F.lit(" to porto  city")), F.lit("Faro opens"), F.lit("Portola and Farouk"), F.lit("")]
    return read(spark, d, "orders").select("o_orderkey", labels.city_named(F.element_at(F.array(*forms), (k % 5 + 1).cast("int")), CITIES).alias("city"))
