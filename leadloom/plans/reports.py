"""Queries over orders, prices and the register: counts, price series, weekly report, order views, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, hashing, quantity, strings
from ..operators import dedupe, ranking, series
from ..sources import sinks
from .leads import scored
from .tables import REGISTER_SQL, read, register, today

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WEEK = "1998-W31"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{L}", "WITH " + REGISTER_SQL)
        return f

    return add


def prices(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("market"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_orderkey", "l_linenumber")


@query("{L} SELECT segment, count(*) AS n FROM leads GROUP BY segment")
def count_by_segment(spark, d):
    return series.count_by(register(spark, d), F.col("segment"), "segment")


@query("WITH c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN upper(r_name) WHEN 1 THEN lower(r_name) ELSE r_name || ',' END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), k AS (SELECT regexp_replace(lower(raw), '[^a-z]', '', 'g') AS key, raw, count(*) AS m FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m DESC, raw) AS p, CAST(sum(m) OVER (PARTITION BY key) AS BIGINT) AS n FROM k) SELECT key, raw AS label, n FROM b WHERE p = 1")
def count_by_normalised_city(spark, d):
    raw = F.when(F.col("id") % 3 == 0, F.upper("city")).when(F.col("id") % 3 == 1, F.lower("city")).otherwise(F.concat("city", F.lit(",")))
    return series.count_by_spelling(register(spark, d), raw, strings.city_key(raw))


@query("WITH c AS (SELECT n_name AS key, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS place FROM c) SELECT key, n FROM p WHERE place <= 5 UNION ALL SELECT '+' || count(*) || ' more', CAST(sum(n) AS BIGINT) FROM p WHERE place > 5 HAVING count(*) > 0")
def top_list_with_remainder(spark, d):
    nations = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    counts = series.count_by(read(spark, d, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey")), F.col("n_name"))
    return ranking.top_with_rest(counts, "key", "n", 5)


@query("{L} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS s_{s}" for s in strings.STATUSES) + " FROM leads")
def status_funnel(spark, d):
    return register(spark, d).agg(*(F.count(F.when(F.col("status") == s, 1)).alias(f"s_{s}") for s in strings.STATUSES))


@query("SELECT l_partkey AS part, CAST(floor(avg(CASE WHEN d BETWEEN DATE '1998-07-27' AND DATE '1998-08-02' THEN p END) + 0.5) AS BIGINT) AS mean, count(CASE WHEN d BETWEEN DATE '1998-07-27' AND DATE '1998-08-02' THEN p END) AS readings, CAST(floor(avg(CASE WHEN d BETWEEN DATE '1998-07-20' AND DATE '1998-07-26' THEN p END) + 0.5) AS BIGINT) AS before, CAST(floor((floor(avg(CASE WHEN d BETWEEN DATE '1998-07-27' AND DATE '1998-08-02' THEN p END) + 0.5) - floor(avg(CASE WHEN d BETWEEN DATE '1998-07-20' AND DATE '1998-07-26' THEN p END) + 0.5)) / floor(avg(CASE WHEN d BETWEEN DATE '1998-07-20' AND DATE '1998-07-26' THEN p END) + 0.5) * 100 + 0.5) AS BIGINT) AS delta_pct FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS p FROM lineitem) GROUP BY 1 HAVING readings > 0")
def weekly_price_moves(spark, d):
    return series.weekly_moves(prices(spark, d), "part", "day", F.col("price"), F.lit(WEEK))


@query("WITH i AS (SELECT p_partkey AS part FROM part), s AS (SELECT part, CAST(unnest(generate_series(DATE '1998-07-20', DATE '1998-08-02', INTERVAL 1 DAY)) AS DATE) AS day FROM i), m AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, CAST(floor(avg(CAST(l_extendedprice AS DECIMAL(18,2))) + 0.5) AS BIGINT) AS mean FROM lineitem GROUP BY 1, 2) SELECT part, day, mean FROM s LEFT JOIN m USING (part, day)")
def price_series_dense(spark, d):
    items = read(spark, d, "part").select(F.col("p_partkey").alias("part"))
    return series.dense_series(prices(spark, d), items, "part", "day", F.col("price"), 14, today())


BEST = "b AS (SELECT l_partkey AS part, l_suppkey AS market, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey, l_linenumber) AS n FROM lineitem)"


def _best(spark, d):
    return series.best_price(prices(spark, d), "part", [F.desc("day"), "price", "l_orderkey", "l_linenumber"])


@query("WITH " + BEST + " SELECT part, market, day, CAST(price AS DOUBLE) AS price FROM b WHERE n = 1")
def best_price_per_commodity(spark, d):
    return _best(spark, d).select("part", "market", "day", F.col("price").cast("double").alias("price"))


@query("WITH " + BEST + " SELECT p_brand, part, day, CAST(price AS DOUBLE) AS price FROM (SELECT p_brand, part, day, price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM b JOIN part ON part = p_partkey WHERE n = 1) WHERE place <= 4")
def price_priority(spark, d):
    items = read(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand", "p_retailprice")
    return ranking.top_per(_best(spark, d).join(items, "part"), ["p_brand"], [F.desc("p_retailprice"), "part"], 4).select("p_brand", "part", "day", F.col("price").cast("double").alias("price"))


@query("WITH b AS (SELECT l_partkey AS part, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS price FROM lineitem WHERE l_shipdate >= DATE '1998-07-01' AND l_shipdate < DATE '1998-08-01' GROUP BY 1) SELECT p_partkey AS part, p_name AS item, CAST(price AS DOUBLE) AS price, CASE WHEN price IS NULL THEN 'no quote' ELSE CAST(price AS VARCHAR) END AS quote FROM part LEFT JOIN b ON part = p_partkey")
def price_sheet_left(spark, d):
    recent = prices(spark, d).where("day >= DATE'1998-07-01' AND day < DATE'1998-08-01'").groupBy("part").agg(F.min("price").alias("price"))
    items = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("item"))
    return items.join(recent, "part", "left").select("part", "item", F.col("price").cast("double").alias("price"), F.coalesce(F.col("price").cast("string"), F.lit("no quote")).alias("quote"))


@query("SELECT p_partkey AS part, CASE WHEN p_size > 25 THEN 'no commodity code' ELSE 'no reading in the window' END AS reason FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '1998-07-20' AND l_shipdate < DATE '1998-08-03')")
def price_without_reading(spark, d):
    seen = prices(spark, d).where("day BETWEEN DATE'1998-07-20' AND DATE'1998-08-02'").select("part")
    reason = F.when(F.col("p_size") > 25, "no commodity code").otherwise("no reading in the window")
    return read(spark, d, "part").select(F.col("p_partkey").alias("part"), reason.alias("reason")).join(seen, "part", "left_anti")


@query("SELECT l_partkey AS part, l_suppkey AS market, CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8) AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01'")
def prices_window_get(spark, d):
    rows = prices(spark, d).where(F.col("part").isin(1, 2, 3, 5, 8) & F.col("day").between("1998-01-01", "1998-12-31"))
    return rows.select("part", "market", "day", F.col("price").cast("double").alias("price")).orderBy(F.desc("day"), "part")


@query("SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'sent, not confirmed' ELSE 'not sent' END AS alert FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def orders_recent(spark, d):
    alert = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "sent, not confirmed").otherwise("not sent")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", alert.alias("alert")).orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50)


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= DATE '1998-01-01' AND p_name LIKE '%ring%'")
def orders_filter(spark, d):
    """Orders since a date with a line whose product matches."""
    rings = read(spark, d, "part").where(F.col("p_name").contains("ring")).select(F.col("p_partkey").alias("l_partkey"))
    lines = read(spark, d, "lineitem").join(rings, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").where("o_orderdate >= DATE'1998-01-01'").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH l AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, p_name) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, c_name AS buyer, n_name AS city, lines, o_orderpriority AS frequency, CASE WHEN o_orderkey % 5 = 0 THEN 'call, then "knock"' END AS notes, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey AS id, concat_ws(',', o_orderkey, day, buyer, city, coalesce(lines, ''), frequency, coalesce('"' || replace(notes, '"', '""') || '"', ''), o_orderstatus) AS line FROM r""")
def orders_csv(spark, d):
    """Every order as a line of CSV: its products in the order of its lines, then by name, joined in one cell."""
    names = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(names, "l_partkey").groupBy(F.col("l_orderkey").alias("id"))
    lines = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]).alias("lines"))
    buyers = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer"), F.col("n_name").alias("city"))
    orders = read(spark, d, "orders").join(buyers, "o_custkey").withColumnRenamed("o_orderkey", "id").join(lines, "id", "left")
    notes = F.when(F.col("id") % 5 == 0, 'call, then "knock"')
    return sinks.csv_lines(orders.withColumns({"day": F.col("o_orderdate").cast("date"), "notes": notes}), ["id", "day", "buyer", "city", "lines", "o_orderpriority", "notes", "o_orderstatus"], keep=["id"])


@query("SELECT lower(p_name) AS product, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def orders_by_product(spark, d):
    names = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("product"))
    lines = read(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(names, "l_partkey")
    return lines.groupBy("product").agg(F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1998-07-27' AND o_orderdate < DATE '1998-08-03' GROUP BY 1")
def orders_buyers(spark, d):
    rows = read(spark, d, "orders").where(dates.in_week(F.col("o_orderdate"), F.lit(WEEK)))
    return rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.count("*").alias("orders"))


@query("SELECT CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(date_trunc('week', min(o_orderdate)) AS DATE) AS monday FROM orders GROUP BY 1")
def iso_week_rollup(spark, d):
    week = dates.iso_week(F.col("o_orderdate"))
    out = read(spark, d, "orders").groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return out.select("week", "n", F.col("total").cast("double").alias("total"), dates.week_start(F.col("week")).alias("monday"))


@query("SELECT day FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def days_without_event(spark, d):
    urgent = read(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return series.days_without(urgent, F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"), spark)


@query("{L} SELECT segment, city, count(*) AS n FROM leads WHERE status = 'new' AND phone IS NOT NULL GROUP BY 1, 2")
def untouched_buckets(spark, d):
    rows = register(spark, d).where("status = 'new' AND phone IS NOT NULL")
    return rows.groupBy("segment", F.coalesce("city", F.lit("unknown city")).alias("city")).agg(F.count("*").alias("n"))


@query("{L} SELECT count(*) AS total, count(*) FILTER (why_now_date = DATE '1998-08-02') AS new_today, count(phone) AS with_phone, count(*) FILTER (phone IS NULL AND email IS NULL) AS no_contact, count(*) FILTER (score >= 60) AS strong FROM leads")
def register_tiles(spark, d):
    one = lambda c: F.count(F.when(c, 1))
    return scored(spark, d).agg(
        F.count("*").alias("total"), one(F.col("why_now_date") == today()).alias("new_today"), F.count("phone").alias("with_phone"), one(F.col("phone").isNull() & F.col("email").isNull()).alias("no_contact"), one(F.col("score") >= 60).alias("strong")
    )


@query("{L}, c AS (SELECT status, city, count(*) AS n FROM leads GROUP BY GROUPING SETS ((status), (city), ())) SELECT coalesce(status, '') AS status, coalesce(city, '') AS city, n FROM c")
def weekly_report_sets(spark, d):
    """The report's counts by status, by city and in all, in one pass."""
    register(spark, d).createOrReplaceTempView("report_register")
    out = spark.sql("SELECT status, city, count(*) AS n FROM report_register GROUP BY GROUPING SETS ((status), (city), ())")
    return out.select(F.coalesce("status", F.lit("")).alias("status"), F.coalesce("city", F.lit("")).alias("city"), "n")


@query("{L} SELECT DISTINCT 'city' AS kind, city AS option FROM leads UNION SELECT DISTINCT 'source', source FROM leads")
def filter_options(spark, d):
    rows = register(spark, d)
    return rows.select(F.explode(F.array(F.struct(F.lit("city").alias("kind"), F.col("city").alias("option")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("option")))).alias("o")).select("o.*").distinct()


@query("{L}, r AS (SELECT 1 AS prio, 'call new leads with a phone' AS action, count(*) AS n FROM leads WHERE status = 'new' AND phone IS NOT NULL UNION ALL SELECT 2, 'find contacts', count(*) FROM leads WHERE phone IS NULL AND email IS NULL UNION ALL SELECT 3, 'follow up quotes', count(*) FROM leads WHERE status = 'quoted' UNION ALL SELECT 4, 'review ignored', count(*) FROM leads WHERE status = 'ignored') SELECT prio, action, n FROM r WHERE n > 0 ORDER BY prio LIMIT 3")
def next_actions(spark, d):
    """The first three rules that hold, in the order of the rules."""
    one = lambda c: F.count(F.when(c, 1))
    new_phone = (F.col("status") == "new") & F.col("phone").isNotNull()
    rules = [(1, "call new leads with a phone", new_phone), (2, "find contacts", F.col("phone").isNull() & F.col("email").isNull()), (3, "follow up quotes", F.col("status") == "quoted"), (4, "review ignored", F.col("status") == "ignored")]
    counts = register(spark, d).agg(*(one(c).alias(f"n{p}") for p, _, c in rules))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("prio"), F.lit(a).alias("action"), F.col(f"n{p}").alias("n")) for p, a, _ in rules))).alias("r")).select("r.*")
    return rows.where("n > 0").orderBy("prio").limit(3)


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'order' END AS k, CAST(count(o_orderkey) AS BIGINT) AS left_orders, CASE WHEN count(o_orderkey) = 0 THEN 'delete' ELSE 'update' END AS plan FROM supplier LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) ON o_custkey = s_suppkey GROUP BY 1, 2")
def remove_marked_orders(spark, d):
    """Marked orders go; a lead without orders left is deleted, else updated."""
    kept = read(spark, d, "orders").where("o_orderkey % 9 <> 0").groupBy(F.col("o_custkey").alias("s_suppkey")).agg(F.count("*").alias("left_orders"))
    out = read(spark, d, "supplier").join(kept, "s_suppkey", "left").withColumn("left_orders", F.coalesce("left_orders", F.lit(0)))
    return out.select("s_suppkey", F.when(F.col("s_acctbal") > 5000, "order").alias("k"), F.col("left_orders").cast("long").alias("left_orders"), F.when(F.col("left_orders") == 0, "delete").otherwise("update").alias("plan"))


@query("{L}, x AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'requirement' ELSE 'buyer' END AS knd FROM leads) SELECT id, CASE WHEN id % 11 = 0 THEN 'cached' WHEN id % 7 = 0 THEN 'no text' WHEN array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'no segment' END, CASE WHEN abs(score - 60) <= 10 THEN 'size unknown near the cut-off' END, CASE WHEN knd = 'requirement' AND why_now_date IS NULL THEN 'no closing date' END], lambda s: s IS NOT NULL), '; ') = '' THEN 'nothing missing' ELSE array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'no segment' END, CASE WHEN abs(score - 60) <= 10 THEN 'size unknown near the cut-off' END, CASE WHEN knd = 'requirement' AND why_now_date IS NULL THEN 'no closing date' END], lambda s: s IS NOT NULL), '; ') END AS reason FROM x")
def model_gate_reason(spark, d):
    rows = scored(spark, d)
    kind = F.when(F.col("id") % 3 == 0, "requirement").otherwise("buyer")
    segment = F.when(F.col("id") % 5 == 0, "other").otherwise("hotel")
    reason = series.enrich_reason(F.col("id") % 11 == 0, F.col("id") % 7 != 0, segment, F.lit(None).cast("string"), F.col("score"), F.lit(60), kind, F.col("why_now_date"))
    return rows.select("id", reason.alias("reason"))


@query("WITH c AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS cost FROM orders), w AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c), f AS (SELECT *, max(CASE WHEN b + cost > 900000 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM w) SELECT o_orderkey, day, s = 0 AS admitted FROM f")
def budget_admission(spark, d):
    calls = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    return series.admitted(calls, "day", ["o_orderkey"], "cost", "cost", 900_000).select("o_orderkey", "day", "admitted")


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1")
def daily_spend(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))


@query("WITH d AS (SELECT doc_id, n_chars // 4 AS tin, n_chars % 500 AS tout FROM documents) SELECT doc_id, CAST(ceil((tin * 0.15 + tout * 0.6) * 88.0 / 1000000 * 10000) / 10000 AS DOUBLE) AS inr FROM d")
def cost_inr(spark, d):
    tin, tout = F.floor(F.col("n_chars") / 4), F.col("n_chars") % 500
    return read(spark, d, "documents").select("doc_id", quantity.cost_inr(tin, tout, F.lit(0.15), F.lit(0.6), 88.0).cast("double").alias("inr"))


@query("WITH r AS (SELECT doc_id, quality, toxic FROM labels), c AS (SELECT doc_id, CAST(n_chars > 500 AS INT) AS quality, 0 AS toxic FROM documents), j AS (SELECT c.doc_id, coalesce(c.quality = r.quality, false) AS q, coalesce(c.toxic = r.toxic, false) AS t FROM c LEFT JOIN r ON c.doc_id = r.doc_id) SELECT (SELECT count(*) FROM j) AS cases, 'quality' AS field, CAST((SELECT count(*) FROM j WHERE q) AS BIGINT) AS right UNION ALL SELECT (SELECT count(*) FROM j), 'toxic', CAST((SELECT count(*) FROM j WHERE t) AS BIGINT)".replace("AS right", 'AS "right"'))
def eval_accuracy(spark, d):
    cases = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    results = read(spark, d, "labels").withColumn("ord", F.lit(0))
    return series.accuracy(cases, results, "doc_id", ["quality", "toxic"], "ord")


@query("SELECT doc_id, sha256('v1' || chr(10) || lang || chr(10) || source || chr(10) || sha256(text) || chr(10)) AS key FROM documents")
def cache_key(spark, d):
    key = hashing.cache_key(F.lit("v1"), F.col("lang"), F.col("source"), F.sha2("text", 256), F.lit(None).cast("string"))
    return read(spark, d, "documents").select("doc_id", key.alias("key"))


@query("WITH p AS (SELECT o_custkey, unnest(['a', 'b', 'a', 'c' || o_orderkey % 3]) AS s, o_orderkey FROM orders) SELECT o_custkey, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT o_custkey, s FROM p WHERE s <> 'b') GROUP BY 1")
def ordered_distinct_union(spark, d):
    """Insertion-ordered union of sources, own id left out; sorted for comparison."""
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string"))).alias("s"))
    union = dedupe.ordered_union(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.col("s"), F.lit("b"))
    return rows.select("o_custkey", F.array_join(F.sort_array(union), ",").alias("sources"))


@query("WITH r AS (SELECT * FROM (VALUES ('/a/', true), ('/a/b', false), ('/b/*', false), ('/b/x', true), ('/en', false)) t(p, a)), u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages) SELECT path, NOT path LIKE '/en%' AS allowed FROM u")
def robots_longest_match(spark, d):
    rules = spark.createDataFrame([("/a/", True), ("/a/b", False), ("/b/*", False), ("/b/x", True), ("/en", False)], "pattern string, allow boolean")
    paths = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1).alias("path")).distinct()
    return series.longest_rule(paths, rules)


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank, CASE WHEN lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <> 0 THEN CAST(floor((c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) / lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) * 100 + 0.5) AS BIGINT) END AS delta_pct FROM customer")
def rank_with_delta(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    before = F.lag("c_acctbal").over(w)
    return read(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("rank"), series.delta_percent(F.col("c_acctbal"), before).alias("delta_pct"))
