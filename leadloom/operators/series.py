"""Price series, week reports, counts by spelling, event folds and gating as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..names import free_names
from .ranking import first_per
from .scans import running_sums


def count_by(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Counts of a key's values, without null and empty ones."""
    return rows.select(key.alias(name)).where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n"))


def count_by_spelling(rows: DataFrame, raw: Column, key: Column) -> DataFrame:
    """Counts of a normalised key, labelled with its most frequent spelling, ties to the smallest."""
    each = rows.select(key.alias("key"), raw.alias("label")).where("key <> ''").groupBy("key", "label").agg(F.count("*").alias("n"))
    total = each.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("best"))
    return total.select("key", F.col("best.label").alias("label"), "n")


def mean_half_up(c: Column) -> Column:
    return dates.half_up(F.avg(c)).cast("long")


def delta_percent(now: Column, before: Column) -> Column:
    """Change in whole per cent, halves up; null without a reading before, or one of 0."""
    return F.when(before != 0, dates.half_up((now - before) / before * 100)).cast("long")


def weekly_moves(prices: DataFrame, commodity: str, day: str, price: Column, week: Column) -> DataFrame:
    """This week's mean and readings of every commodity, the week before's mean, and the change."""
    this, prior = dates.in_week(F.col(day), week), dates.in_week(F.col(day), dates.previous_week(week))
    both = prices.where(this | prior).groupBy(commodity).agg(
        F.avg(F.when(this, price)).alias("now"), F.count(F.when(this, price)).alias("readings"), F.avg(F.when(prior, price)).alias("before")
    )
    now, before = dates.half_up(F.col("now")).cast("long"), dates.half_up(F.col("before")).cast("long")
    return both.where("readings > 0").select(commodity, now.alias("mean"), "readings", before.alias("before"), delta_percent(now, before).alias("delta_pct"))


def dense_series(prices: DataFrame, items: DataFrame, commodity: str, day: str, price: Column, days: int, end: Column) -> DataFrame:
    """Mean price of every item on each of the last days; null where there is no reading."""
    means = prices.where(F.col(day).between(F.date_sub(end, days - 1), end)).groupBy(commodity, day).agg(mean_half_up(price).alias("mean"))
    spine = items.select(commodity, F.explode(dates.last_days(days, end)).alias(day))
    return spine.join(means, [commodity, day], "left")


def best_price(prices: DataFrame, commodity: str, order: list) -> DataFrame:
    return first_per(prices, [commodity], order)


def days_without(rows: DataFrame, day: Column, start: Column, end: Column, spark) -> DataFrame:
    """Days of a span on which nothing happened."""
    spine = spark.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    return spine.join(rows.select(day.alias("day")).distinct(), "day", "left_anti")


def delivery_fold(attempts: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The state of each delivery after its attempts in order: a later failure corrects a success, once.

    Attempts of one key are few: they are gathered as (order, status) pairs.
    """
    steps = F.array_sort(F.collect_list(F.struct(*order, status)))

    def step(state: Column, s: Column) -> Column:
        failed = s[status] == "failed"
        corrected = (state["state"] == "sent") & failed
        return F.struct(
            F.when(state["corrected"], state["state"]).when(corrected, F.lit("failed later")).when(failed, F.coalesce(state["state"], F.lit("failed"))).otherwise(F.lit("sent")).alias("state"),
            (state["corrected"] | F.coalesce(corrected, F.lit(False))).alias("corrected"),
            (state["steps"] + 1).alias("steps"),
        )

    first = F.struct(F.lit(None).cast("string").alias("state"), F.lit(False).alias("corrected"), F.lit(0).cast("long").alias("steps"))
    return attempts.groupBy(key).agg(F.aggregate(steps, first, step).alias("f")).select(key, "f.state", "f.corrected", "f.steps")


def open_window(messages: DataFrame, sender: str, at: str, now: Column, hours: int = 24) -> DataFrame:
    """Whether a sender's last message is less than `hours` old."""
    last = messages.groupBy(sender).agg(F.max(at).alias("last"))
    closes = F.col("last") + F.make_dt_interval(hours=F.lit(hours))
    return last.select(sender, "last", (closes > now).alias("is_open"))


def admitted(calls: DataFrame, day: str, order: list[str], cost: str, estimate: str, cap: float) -> DataFrame:
    """Calls in order until the first whose estimate no longer fits the day's cap beside what was spent before.

    Spending is summed over ranges of the order and the first refusal of a day is an aggregate, so a day of any size is
    spread over tasks. `order` must tell the calls of a day apart; a null cost or estimate counts as nothing.
    """
    key, *_ = free_names(calls.columns, "first_refused")
    summed = running_sums(calls, [F.asc(c) for c in order], {"spent_before": F.col(cost)}, [day])
    summed = summed.withColumn("spent_before", F.col("spent_before") - F.coalesce(cost, F.lit(0)))
    refused = F.col("spent_before") + F.coalesce(estimate, F.lit(0)) > cap
    first = summed.where(refused).groupBy(F.col(day).alias(f"{key}_day")).agg(F.min(F.struct(*order)).alias(key))
    met = summed.join(first, F.col(day).eqNullSafe(F.col(f"{key}_day")), "left")
    return met.withColumn("admitted", F.col(key).isNull() | (F.struct(*order) < F.col(key))).drop(key, f"{key}_day")


def enrich_reason(cache_hit: Column, has_text: Column, segment: Column, size: Column, score: Column, cutoff: Column, kind: Column, deadline: Column, band: int = 10) -> Column:
    """Why the model is asked to enrich a lead, or why not."""
    unknown_segment = F.coalesce(segment, F.lit("other")) == "other"
    near = F.coalesce(size, F.lit("unknown")).eqNullSafe("unknown") & (cutoff > 0) & (F.abs(score - cutoff) <= band)
    undated = (kind == "requirement") & deadline.isNull()
    reasons = F.concat_ws("; ", F.when(unknown_segment, "no segment"), F.when(near, "size unknown near the cut-off"), F.when(undated, "no closing date"))
    return F.when(cache_hit, "cached").when(~has_text, "no text").when(reasons == "", "nothing missing").otherwise(reasons)


def accuracy(cases: DataFrame, results: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Share of cases whose result agrees, for each field; no result counts as wrong, of several the last counts."""
    last = first_per(results, [key], [F.desc(order)])
    renamed = last.select(key, *(F.col(f).alias(f"r_{f}") for f in fields))
    both = cases.join(renamed, key, "left")
    right = [F.coalesce(F.col(f) == F.col(f"r_{f}"), F.lit(False)).cast("int") for f in fields]
    sums = both.agg(F.count("*").alias("cases"), *(F.sum(r).alias(f) for f, r in zip(fields, right, strict=True)))
    return sums.select("cases", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("right")) for f in fields))).alias("x")).select("cases", "x.field", "x.right")


def answer_totals(cases: DataFrame, results: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Over all cases in one row: valid answers, all-right cases, sums and rounded means of tokens and time, cost, cache hits.

    results have ok, tokens_in, tokens_out, cost, ms, cache_hit and the fields; a case without one counts with nothing, of several the last counts.
    """
    last = first_per(results, [key], [F.desc(order)]).select(key, "ok", "tokens_in", "tokens_out", "cost", "ms", "cache_hit", *(F.col(f).alias(f"r_{f}") for f in fields))
    both = cases.join(last, key, "left")
    ok = F.coalesce("ok", F.lit(False))
    right = ok
    for f in fields:
        right = right & F.col(f).eqNullSafe(F.col(f"r_{f}"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = lambda c: F.when(F.count("*") > 0, F.floor(total(c) / F.count("*") + 0.5)).otherwise(0).cast("long")
    return both.agg(
        F.count("*").alias("cases"), F.count_if(ok).alias("valid"), F.count_if(right).alias("all_right"), total("tokens_in").cast("long").alias("tokens_in"), total("tokens_out").cast("long").alias("tokens_out"),
        mean("tokens_in").alias("mean_in"), mean("tokens_out").alias("mean_out"), total("cost").alias("cost"), mean("ms").alias("mean_ms"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"),
    )


def longest_rule(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Whether each path is allowed: the longest matching rule wins, allowing ones on ties, no rule allows.

    rules (pattern, allow) are the few lines of one robots file, with * and a final $; they are broadcast.
    """
    quoted = F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))
    known = rules.select("pattern", "allow", F.when(F.col("pattern").endswith("$"), regex).otherwise(F.concat(regex, F.lit(".*"))).alias("regex"))
    hit = paths.join(F.broadcast(known), F.expr(f"rlike({path}, regex)"), "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "allow")))
    return hit.groupBy(path).agg(F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
