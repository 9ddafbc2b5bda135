"""Temporal list join: every capture is judged by the list entries that were active when it was fetched.

Dated additions and removals of a rule become validity intervals. A capture looks up its host, every parent
domain and every path prefix, and the as-of join keeps the intervals that hold its fetch date. Intervals are cut
by month, so a rule with a long history costs a capture no more than that month's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Intervals, cut by month, up to this number (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_INTERVALS = 500_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url: Column, labels_of: int, steps_of: int) -> Column:
    """The rules that can match a URL: its host, each parent domain of two labels or more, and host/path prefixes by segment.

    Only those of at most `labels_of` labels and `steps_of` segments, the most that any rule has: so a URL of very
    many segments has no more keys than others.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.greatest(F.lit(1), n - (labels_of - 1)), F.greatest(n - 1, F.lit(1)))
    domains = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))
    domains = F.when(F.greatest(F.lit(1), n - (labels_of - 1)) <= F.greatest(n - 1, F.lit(1)), domains).otherwise(F.array().cast("array<string>"))
    steps = F.slice(F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != ""), 1, max(1, steps_of))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda j: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, j), "/")))
    keys = F.concat(domains, F.when(F.size(steps) > 0, prefixes).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, rule, since, until) from dated entries (list, rule, action 'add' or 'remove', date); until is exclusive, null while open.

    Entries with a null in any of these, or another action, count for nothing. Of one rule and date a removal
    outweighs additions. Repeated additions extend an interval, removals of what is not listed do nothing. After the
    first step a rule has one row a date, however many entries it had.
    """
    clean = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "rule", "action", "date"])
    daily = clean.groupBy("list", "rule", F.col("date").cast("date").alias("date")).agg(F.bool_and(F.col("action") == "add").alias("listed"))
    of_rule = Window.partitionBy("list", "rule").orderBy("date")
    changes = daily.withColumn("was", F.lag("listed", 1, False).over(of_rule)).where("listed <> was")
    return changes.withColumn("until", F.lead("date").over(of_rule)).where("listed").select("list", "rule", F.col("date").alias("since"), "until")


def temporal_list_join(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """The verdict on every capture (id, url, fetched date): id, fetched, n_block, n_allow, blocked, rules.

    Entries are (list, rule, action, date); list is 'block' or 'allow', an active allowing rule outweighs blocking
    ones. rules names the active ones as list:rule, sorted, comma-joined. One row per input row: null or
    unparsable URLs and null dates match nothing and are not blocked; repeated rows stay; further columns are
    ignored; an empty list blocks nothing.
    """
    month = lambda c: F.trunc(c, "month")
    fetched = F.col("fetched").cast("date")
    last = captures.agg(F.max(fetched)).first()[0]
    cut = validity_intervals(entries).where(F.col("since") <= F.lit(last)).withColumn("stop", F.least(F.coalesce("until", F.lit(last)), F.lit(last)))
    cut = cut.withColumn("month", F.explode(F.sequence(month("since"), month("stop"), F.expr("interval 1 month")))).drop("stop")
    cut = materialize(cut, "intervals")
    parts = F.split("rule", "/")
    n, labels_of, steps_of = cut.agg(F.count("*"), F.coalesce(F.max(F.size(F.split(parts[0], r"\."))), F.lit(1)), F.coalesce(F.max(F.size(parts)) - 1, F.lit(0))).first()
    few = n <= BROADCAST_INTERVALS
    keys = F.coalesce(url_keys(F.col("url").cast("string"), labels_of, steps_of), F.array().cast("array<string>"))
    rows = captures.select(F.col(id_column), fetched.alias("fetched"), keys.alias("keys"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "captures")  # so the ids hold from here on
    asked = rows.select("uid", "fetched", month("fetched").alias("month"), F.explode("keys").alias("rule"))
    met = asked.join(F.broadcast(cut) if few else cut, ["rule", "month"])
    met = met.where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    active = met.groupBy("uid").agg(
        F.count(F.when(F.col("list") == "block", 1)).alias("n_block"),
        F.count(F.when(F.col("list") == "allow", 1)).alias("n_allow"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "list", "rule"))), ",").alias("rules"),
    )
    out = rows.drop("keys").join(active, "uid", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        id_column, "fetched", count("n_block").alias("n_block"), count("n_allow").alias("n_allow"), ((count("n_block") > 0) & (count("n_allow") == 0)).alias("blocked"), F.coalesce("rules", F.lit("")).alias("rules")
    )


# ---------------------------------------------------------------------------------------
# The tables have neither fetch dates nor lists: both follow from the pages by fixed rules.


def dated_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))


def example_entries(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts and first path steps of the pages: a quarter gets listed, some of it is removed and listed again."""
    host = url_host(F.col("url"))
    step = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    rules = pages.select(F.explode(F.array(host, F.when(step != "", F.concat(host, F.lit("/"), step)))).alias("rule")).where("rule <> ''").distinct()
    rules = rules.withColumn("c", F.crc32(F.col("rule").cast("binary")))
    entry = lambda name, action, days, when: F.when(F.expr(when), F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast({days} AS int)")).alias("date")))
    entries = F.array(
        entry("block", "add", "c % 300", "c % 4 = 0"),
        entry("block", "remove", "c % 300 + 1 + c % 90", "c % 12 = 0"),
        entry("block", "add", "c % 300 + 2 + c % 90 + c % 60", "c % 36 = 0"),
        entry("allow", "add", "c % 200", "c % 10 = 3"),
    )
    return rules.select("rule", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("rule", "e.list", "e.action", "e.date")


def op4_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return temporal_list_join(dated_pages(pages), example_entries(pages))

