"""Ordered deduplication, upserts and keyed appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per


def keep_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of every key by a stated order, unlike dropDuplicates."""
    return first_per(rows, by, order)


def keep_last(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return first_per(rows, by, [F.desc(order)])


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources with ord, the place of their source."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def against_lane(items: DataFrame, earlier: DataFrame, key: Column, earlier_key: Column, order: list) -> DataFrame:
    """Items whose key no earlier lane has, first of each key; an empty key never counts as a repeat."""
    keyed = items.withColumn("__key", key)
    taken = earlier.select(earlier_key.alias("__key")).where("__key <> ''").distinct()
    fresh = keyed.join(taken, "__key", "left_anti")
    return keep_first(fresh.where("__key <> ''"), ["__key"], order).unionByName(fresh.where("__key = '' OR __key IS NULL")).drop("__key")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those of equal key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """Existing rows, and the first incoming row of every key that is not there."""
    new = keep_first(incoming, [key], order).join(existing.select(key), key, "left_anti")
    return existing.withColumn("inserted", F.lit(False)).unionByName(new.withColumn("inserted", F.lit(True)))


def append_keyed(log: DataFrame, events: DataFrame, order: list) -> DataFrame:
    """Events to append: keyed ones once per (type, key) and only if not logged; those without a key always."""
    keyed = keep_first(events.where("key IS NOT NULL"), ["type", "key"], order).join(log.where("key IS NOT NULL").select("type", "key"), ["type", "key"], "left_anti")
    return keyed.unionByName(events.where("key IS NULL"))


def latest_events(log: DataFrame, order: list[str]) -> DataFrame:
    """The last event of every (type, key) in `order`; events without type or key are found by nobody. Combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("type", "key")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return log.where((F.col("type") != "") & (F.col("key") != "")).groupBy("type", "key").agg(last).select("type", "key", *(F.col("last")[c].alias(c) for c in rest))


def ordered_union(a: Column, b: Column, without: Column | None = None) -> Column:
    """Distinct members of two arrays in the order they come in."""
    both = F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    return F.filter(both, lambda x: x.isNotNull() & (x != without)) if without is not None else both
