"""Queries over the event log: idempotent ingest, folds, windows, per-source sums, evidence."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, hashing, strings
from ..operators import dedupe, scoring, series
from ..session import scratch
from ..sources import sinks
from ..streaming import register as stream_register
from ..streaming import replay
from .tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def event_idempotency(spark, d):
    """Each (message, status) is applied once."""
    return dedupe.keep_first(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_type AS type, user_id, event_id, value FROM events WHERE event_type <> '' AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, d):
    """The last event of each type and user."""
    log = read(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), "ts", "event_id", "value")
    return dedupe.latest_events(log, ["ts", "event_id"]).select("type", F.col("key").cast("long").alias("user_id"), "event_id", "value")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'begun' END AS state FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def runs_swapped(spark, d):
    """A run table put twice: what is known is replaced, and readers see the version the pointer names."""
    path, runs = scratch(spark, "runs"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    sinks.put_run(spark, runs.where("id % 2 = 0").withColumn("state", F.lit("begun")), path)
    return sinks.put_run(spark, runs.where("id % 3 = 0").withColumn("state", F.lit("done")), path)


@query("SELECT c_custkey, replace(CASE WHEN c_custkey % 4 IN (1, 3) THEN 'food_manufacturer' ELSE 'other' END, '_', ' ') AS said FROM customer")
def segments_described(spark, d):
    """What a lead's segment is called: the model's where it is sure and the segment is one of the rules'."""
    key = F.col("c_custkey")
    model, sure = F.when(key % 4 == 2, "odd").otherwise("food_manufacturer"), F.when(key % 4 == 0, 0.69).otherwise(0.7)
    return read(spark, d, "customer").select("c_custkey", scoring.describe_segment(F.lit("other"), model, sure).alias("said"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last_at, arg_max(event_id, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1")
def webhook_daily(spark, d):
    one = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    return read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        one("view").alias("views"), one("click").alias("clicks"), one("error").alias("errors"), F.max("ts").alias("last_at"), F.max_by(error, F.when(error.isNotNull(), F.col("ts"))).alias("last_error")
    )


@query("SELECT user_id, arg_max(event_id, event_id) AS last_event FROM (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'click') WHERE ts = m GROUP BY 1")
def last_matched(spark, d):
    """The last lead that a message matched; of equal times the last one."""
    clicks = read(spark, d, "events").where("event_type = 'click'")
    return clicks.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("SELECT user_id, max(ts) AS last, max(ts) + INTERVAL 24 HOUR > TIMESTAMP '2024-01-30 12:00:00' AS is_open FROM events WHERE event_type = 'view' GROUP BY 1")
def open_window(spark, d):
    return series.open_window(read(spark, d, "events").where("event_type = 'view'"), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS s, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS n FROM events WHERE event_type IN ('error', 'signup')),
x AS (SELECT day, count(*) AS steps, min(CASE WHEN s = 'sent' THEN n END) AS first_sent FROM e GROUP BY 1),
y AS (SELECT x.day, steps, first_sent, bool_or(s = 'failed' AND n > first_sent) AS corrected FROM x JOIN e USING (day) GROUP BY ALL)
SELECT day, CASE WHEN first_sent IS NULL THEN 'failed' WHEN coalesce(corrected, false) THEN 'failed later' ELSE 'sent' END AS state, coalesce(corrected, false) AS corrected, steps FROM y""")
def digest_deliveries(spark, d):
    events = read(spark, d, "events").where("event_type IN ('error', 'signup')")
    attempts = events.select(F.col("ts").cast("date").alias("day"), "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"))
    return series.delivery_fold(attempts, "day", ["event_id"], "status")


@query("SELECT CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def status_changes_week(spark, d):
    return read(spark, d, "events").groupBy(dates.iso_week(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT 'src' || k AS source, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k, event_id % 3 + 1 AS n FROM events) GROUP BY 1")
def per_source_sums(spark, d):
    """Sums over a map of counts per source."""
    source = F.concat(F.lit("src"), (F.get_json_object("props", "$.k").cast("bigint") % 5).cast("string"))
    maps = read(spark, d, "events").select(F.create_map(source, F.col("event_id") % 3 + 1).alias("per_source"))
    return maps.select(F.explode("per_source").alias("source", "n")).groupBy("source").agg(F.sum("n").alias("n"))


@query("SELECT user_id, arg_min(props, event_id) AS reason FROM events WHERE event_type = 'error' GROUP BY 1")
def first_blocked(spark, d):
    """The first reason that each source was blocked for."""
    return read(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min_by("props", "event_id").alias("reason"))


@query("WITH e AS (SELECT CAST(ts AS DATE) AS day, string_agg('{\"id\":' || event_id || '}', chr(10) ORDER BY event_id) AS lines, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT day, n, sha256('evidence/1' || chr(10) || n || chr(10) || lines || chr(10)) AS hash FROM e")
def bundle_hash(spark, d):
    """The hash of each day's receipts in order: one day's receipts make one bundle."""
    events = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("ts").cast("date").alias("day"), "event_id", F.to_json(F.struct(F.col("event_id").alias("id"))).alias("line"))
    days = events.groupBy("day").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("r"))
    return days.select("day", "n", hashing.bundle_hash("evidence/1", F.transform("r", lambda x: x["line"])).alias("hash"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'reader' WHEN event_type = 'signup' THEN 'owner' WHEN event_type = 'view' THEN 'scout' WHEN event_type = 'click' THEN 'verifier' ELSE 'auditor' END AS role FROM events")
def receipt_roles(spark, d):
    kind = F.col("event_type")
    typed = F.when(kind == "error", "llm.call").when(kind == "signup", "lead.status_changed").when(kind == "view", "openings.read").when(kind == "click", "openings.no_site").otherwise("other")
    return read(spark, d, "events").select("event_id", strings.receipt_role(typed).alias("role"))


@query("WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e) SELECT user_id, session, count(*) AS n, min(ts) AS started FROM s GROUP BY 1, 2")
def message_sessions(spark, d):
    """Extension: sessions of messages at most 24 hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    marked = read(spark, d, "events").withColumn("new", F.when(gap.isNull() | (gap > 86_400_000_000), 1).otherwise(0))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, d):
    """Extension: tumbling windows; the streaming form is in streaming.windows."""
    hours = read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return hours.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def streaming_idempotent_counts(spark, d):
    """A replay of the log through the streaming ingest: every (sender, status) counts once."""
    return replay.idempotent_counts(spark, f"{d}/events.parquet")


@query("""WITH s AS (SELECT 'u' || user_id AS key, ts, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS status FROM events)
SELECT key, CAST(count(*) AS BIGINT) AS sightings, max(ts) AS last_seen, (list(status ORDER BY ts DESC, status DESC) FILTER (status IS NOT NULL))[1] AS status, max(ts) + INTERVAL 5 DAY <= (SELECT max(ts) FROM s) - INTERVAL 1 DAY AS quiet FROM s GROUP BY key""")
def running_register(spark, d):
    """Users as leads: a stream over the log keeps each one's state, and tells who was not seen for five days."""
    seen = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).alias("status"))
    return replay.running_register(seen, "1 day", datetime.timedelta(days=5)).select("key", "sightings", "last_seen", "status", "quiet")


@query("""WITH a AS (SELECT event_id AS message, ts FROM events WHERE event_id % 3 = 0), f AS (SELECT event_id - event_id % 3 + CASE WHEN event_id % 7 = 0 THEN 1000000 ELSE 0 END AS message, ts FROM events WHERE event_id % 3 > 0 AND event_type = 'error')
SELECT message, CASE WHEN (SELECT min(f.ts) FROM f WHERE f.message = a.message AND f.ts BETWEEN a.ts AND a.ts + INTERVAL 2 DAY) IS NULL THEN 'sent' ELSE 'failed later' END AS state FROM a""")
def late_failures(spark, d):
    """Each third event as a message sent, the two after it as reports of it, some of none; errors make it fail later."""
    key, at = F.col("event_id"), F.col("ts").cast("timestamp").alias("at")
    events = read(spark, d, "events")
    sent = events.where(key % 3 == 0).select(key.alias("message"), at)
    reports = events.where(key % 3 > 0).select((key - key % 3 + F.when(key % 7 == 0, 1_000_000).otherwise(0)).alias("message"), F.when(F.col("event_type") == "error", "failed").otherwise("read").alias("status"), at)
    failures = replay.late_failures(sent, reports, "1 day", "2 days")
    return stream_register.corrected(sent.select("message", F.lit("sent").alias("state")), failures).select("message", "state")
