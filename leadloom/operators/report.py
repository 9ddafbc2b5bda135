"""The weekly report: every number of a week as rows, and their text within a number of characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, strings
from . import ranking, series

#: Rows of each list that reach the driver for the text.
SHOWN = 12
#: How many cities, segments, prices and won names a text shows, from the widest to the tightest.
LIMITS = (
    {"cities": 6, "segments": 8, "prices": 8, "won": 6},
    {"cities": 4, "segments": 5, "prices": 5, "won": 4},
    {"cities": 3, "segments": 4, "prices": 4, "won": 3},
    {"cities": 2, "segments": 3, "prices": 3, "won": 2},
    {"cities": 2, "segments": 2, "prices": 2, "won": 1},
    {"cities": 1, "segments": 1, "prices": 0, "won": 1},
)


def _long(counts: DataFrame) -> DataFrame:
    """One row of counts as rows (measure, key, value, note); a column a__b is the measure a of the key b."""
    each = [F.struct(F.lit(c.split("__")[0]).alias("measure"), F.lit(c.split("__")[1] if "__" in c else "").alias("key"), F.col(c).cast("long").alias("value"), F.lit(None).cast("string").alias("note")) for c in counts.columns]
    return counts.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def _rows(df: DataFrame, measure: str, key: str | Column, value: str | Column, note: Column | None = None) -> DataFrame:
    k, v = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    return df.select(F.lit(measure).alias("measure"), k.cast("string").alias("key"), v.cast("long").alias("value"), (note if note is not None else F.lit(None)).cast("string").alias("note"))


def named_changes(events: DataFrame, leads: DataFrame) -> DataFrame:
    """Status events with the name of their lead; the id where the register has none."""
    return events.join(leads.select(F.col("id").alias("lead"), "name"), "lead", "left").withColumn("name", F.coalesce("name", F.col("lead").cast("string")))


def weekly_report(leads: DataFrame, runs: DataFrame, events: DataFrame, orders: DataFrame, prices: DataFrame, week: str, today: Column) -> DataFrame:
    """Rows (measure, key, value, note) of a week.

    leads: id, kind, name, city, segment, phone, email, website, status, first_seen. runs: id, started_at, source, n,
    blocked. events: type, at, lead, to. orders: id, created_at, business_name, city, products, missed. prices:
    commodity, day, price. Each table is read once for its single counts and once for each list that is keyed.
    """
    w = F.lit(week)
    within = lambda c: dates.in_week(F.col(c), w)
    one = lambda c: F.count(F.when(c, 1))
    buyers = leads.where("kind <> 'price'")
    found = buyers.where(within("first_seen"))
    status = {s: one(F.col("status") == s).alias(f"funnel__{s}") for s in strings.STATUSES}
    none = F.col("phone").isNull() & F.col("email").isNull() & F.col("website").isNull()
    register = _long(buyers.agg(F.count("*").alias("register"), one(within("first_seen")).alias("found"), one(within("first_seen") & F.col("phone").isNotNull()).alias("with_phone"), one(none).alias("no_contact"), *status.values()))
    changes = events.where((F.col("type") == "lead.status_changed") & within("at"))
    changed = _long(changes.agg(*(one(F.col("to") == s).alias(f"changes__{s}") for s in strings.STATUSES if s != "new")))
    won = series.count_by(named_changes(changes.where("to = 'won'"), leads), F.col("name"))
    week_runs = runs.where(within("started_at"))
    days = week_runs.select(F.col("started_at").cast("date").alias("day")).distinct()
    start = dates.week_start(w)
    spine = leads.sparkSession.range(1).select(F.explode(F.sequence(start, F.least(F.date_add(start, 6), today))).alias("day"))
    ran = _long(week_runs.agg(F.count_distinct("id").alias("runs"), F.count_distinct(F.col("started_at").cast("date")).alias("run_days")))
    blocked = week_runs.where("blocked IS NOT NULL").groupBy("source").agg(F.min_by("blocked", F.struct("started_at", "id")).alias("reason"), F.count("*").alias("n"))
    week_orders = orders.where(within("created_at"))
    ordered = _long(orders.agg(F.count("*").alias("orders_total"), one(within("created_at")).alias("orders"), one(within("created_at") & F.col("missed")).alias("not_delivered")))
    items = week_orders.select("id", F.explode("products").alias("p")).select("id", F.trim("p").alias("label")).where("label <> ''").groupBy("id", F.lower("label").alias("item")).agg(F.min("label").alias("label"))
    moves = series.weekly_moves(prices, "commodity", "day", F.col("price"), w)
    untouched = buyers.where("status = 'new' AND phone IS NOT NULL").groupBy(F.concat_ws("|", "segment", F.coalesce("city", F.lit("unknown city"))).alias("key")).agg(F.count("*").alias("n"))
    spelt = lambda rows: series.count_by_spelling(rows, F.col("city"), strings.city_key(F.col("city")))
    parts = [
        register, changed, ran, ordered,
        _rows(spelt(found), "city", "label", "n"), _rows(series.count_by(found, strings.segment_label(F.col("segment"))), "segment", "key", "n"),
        _rows(won, "won", "key", "n"), _rows(untouched, "untouched", "key", "n"),
        _rows(spine.join(days, "day", "left_anti"), "missed_day", "day", F.lit(1)),
        _rows(week_runs.groupBy("source").agg(F.sum("n").alias("n")), "source", "source", "n"), _rows(blocked, "blocked", "source", "n", F.col("reason")),
        _rows(spelt(week_orders), "order_city", "label", "n"), _rows(items.groupBy("label").agg(F.count("*").alias("n")), "product", "label", "n"),
        _rows(series.count_by(week_orders, F.coalesce("business_name", F.col("id").cast("string"))), "order_buyer", "key", "n"),
        _rows(moves, "price", "commodity", "mean"), _rows(moves, "price_readings", "commodity", "readings"), _rows(moves, "price_before", "commodity", "before"), _rows(moves, "price_change", "commodity", "delta_pct"),
    ]
    return reduce(DataFrame.unionByName, parts)


def shown(report: DataFrame) -> dict[str, list[tuple]]:
    """The largest SHOWN entries of every measure and how many there are: what a text can show, and no more reaches the driver."""
    top = ranking.top_per(report, ["measure"], [F.desc("value"), F.col("key")], SHOWN).select("measure", "key", "value", "note")
    sizes = report.groupBy("measure").agg(F.count("*").alias("value")).select(F.concat(F.lit("#"), "measure").alias("measure"), F.lit("").alias("key"), "value", F.lit(None).cast("string").alias("note"))
    out: dict[str, list[tuple]] = {}
    for r in sorted(top.unionByName(sizes).collect(), key=lambda r: (-(r["value"] or 0), r["key"])):
        out.setdefault(r["measure"], []).append((r["key"], r["value"], r["note"]))
    return out


def _top(d: dict, measure: str, k: int, amounts: bool = True) -> str:
    rows, total = d.get(measure, [])[:k], d.get("#" + measure, [("", 0, None)])[0][1]
    text = ", ".join(f"{key} {n}" if amounts else key for key, n, _ in rows)
    return text + (f", +{total - len(rows)} more" if total > len(rows) else "")


def _text(d: dict, week: str, limits: dict[str, int]) -> str:
    get = lambda measure, key="": next((n for k, n, _ in d.get(measure, []) if k == key), 0)
    lines = [f"Week {week}", "", f"Leads found this week: {get('found')} ({get('with_phone')} with a phone)"]
    lines += [f"{title}: {_top(d, m, limits[n])}" for title, m, n in (("City", "city", "cities"), ("Segment", "segment", "segments")) if d.get(m)]
    lines += ["", "Status changes: " + ", ".join(f"{s} {get('changes', s)}" for s in ("contacted", "quoted", "won", "lost"))]
    lines += [f"Won: {_top(d, 'won', limits['won'], False) or 'none this week'}"]
    lines += [f"Register: {get('register')} leads - " + ", ".join(f"{s} {get('funnel', s)}" for s in ("new", "contacted", "quoted", "won", "lost"))]
    lines += ["", f"Orders: {get('orders')} this week ({get('orders_total')} all time)"]
    if get("orders"):
        lines += [f"Order city: {_top(d, 'order_city', limits['cities'])}", f"Ordered by: {_top(d, 'order_buyer', limits['won'], False)}"]
        lines += [f"Ordered: {_top(d, 'product', limits['prices'])}"] if limits["prices"] and d.get("product") else []
        lines += [f"{get('not_delivered')} order alerts did not reach the owner"] if get("not_delivered") else []
    lines += ["", f"Runs: {get('runs')} on {get('run_days')} days", f"Sources: {_top(d, 'source', 6)}"]
    lines += ["Blocked: " + ("; ".join(f"{k} ({note})" for k, _, note in d.get("blocked", [])) or "none")]
    if limits["prices"]:
        before, change = ({k: n for k, n, _ in d.get(m, [])} for m in ("price_before", "price_change"))
        lines += ["", "Prices:"] + [f"  {k} {n}" + (f", was {before[k]} ({change.get(k, 0):+d}%)" if before.get(k) is not None else ", no reading before") for k, n, _ in d.get("price", [])[: limits["prices"]]]
    return "\n".join(lines).strip() + "\n"


def report_text(report: DataFrame, week: str, max_chars: int) -> str:
    """The text with the widest limits that fits; where none fits, the tightest, cut."""
    d = shown(report)
    for limits in LIMITS:
        text = _text(d, week, limits)
        if len(text) <= max_chars:
            return text
    return text[:max_chars]
