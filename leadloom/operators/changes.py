"""Changes of the register that people ask for: statuses by label or id, removal of marked orders, search of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATUSES
from ..functions import strings


def resolve_refs(commands: DataFrame, index: DataFrame) -> DataFrame:
    """Adds lead: of a label (R1, l2) the one that the index (label, id) of the last digest gives, else the reference itself."""
    label = F.when(F.col("ref").rlike(r"^[LlRrGg]\d+$"), F.upper("ref"))
    met = commands.withColumn("__label", label).join(index.select(F.col("label").alias("__label"), F.col("id").cast("string").alias("__id")), "__label", "left")
    return met.withColumn("lead", F.when(F.col("__label").isNull(), F.col("ref")).otherwise(F.col("__id"))).drop("__label", "__id")


def status_events(leads: DataFrame, commands: DataFrame) -> DataFrame:
    """One event for each command (lead, to, note, at, ord) on a known lead to a known status: lead, from, to, note, at, ord."""
    known = commands.where(F.col("to").isin(*STATUSES)).join(leads.select(F.col("id").alias("lead"), F.col("status").alias("__was")), "lead")
    before = F.lag("to").over(Window.partitionBy("lead").orderBy("at", "ord"))
    return known.withColumn("from", F.coalesce(before, F.col("__was"))).withColumn("note", strings.blank_to_null(F.substring(strings.squeeze(F.col("note")), 1, 240))).drop("__was")


def with_statuses(leads: DataFrame, events: DataFrame) -> DataFrame:
    """Leads (id, status, notes) after their status events: the last status, and every note on a dated line."""
    line = F.when(F.col("note").isNotNull(), F.struct("at", "ord", F.concat(F.col("at").cast("date").cast("string"), F.lit(" "), "to", F.lit(": "), "note").alias("line")))
    per = events.groupBy(F.col("lead").alias("id")).agg(F.max_by("to", F.struct("at", "ord")).alias("__to"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("__lines"))
    met = leads.join(per, "id", "left")
    notes = strings.blank_to_null(F.concat_ws("\n", "notes", strings.blank_to_null(F.col("__lines"))))
    return met.withColumn("status", F.coalesce("__to", "status")).withColumn("notes", notes).drop("__to", "__lines")


def classify_orders(orders: DataFrame, marker: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, remove, reason): orders whose contact is exactly the marker go; of a wanted list (id) each id gets a row, known or not."""
    marked = F.coalesce(F.col("contact_name") == marker, F.lit(False))
    rows = orders.select("id", "contact_name", F.lit(True).alias("there"))
    rows = rows if wanted is None else wanted.select("id").distinct().join(rows, "id", "left")
    reason = F.when(F.col("there").isNull(), "no such order").when(~marked, f'not marked "{marker}"')
    return rows.select("id", marked.alias("remove"), reason.alias("reason"))


def panel_search(leads: DataFrame, source: str = "", query: str = "") -> DataFrame:
    """Leads of a source whose name holds the query, or whose phone holds its digits where there are four or more."""
    rows = leads.where(F.col("source") == source) if source else leads
    asked = " ".join(query.lower().split())
    digits = "".join(c for c in asked if c.isdigit())
    hit: Column = F.lower(F.coalesce("name", F.lit(""))).contains(asked)
    if len(digits) >= 4:
        hit = hit | F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", "").contains(digits)
    return rows.where(hit) if asked else rows
