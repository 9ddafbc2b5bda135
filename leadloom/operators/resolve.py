"""Entity resolution of incoming leads against a register.

The register's rule goes row by row: an incoming lead meets the lead of its id, else the one that was touched last
among those of its phone, else of its name and city, and becomes part of it; otherwise it is a lead of its own.
Requirements and registrations meet by id only.

Which lead a row meets depends on the rows before it, what a lead becomes does not: every field is an ordered
aggregate of the rows it took in. So the work has three steps.

1. Rows fall into components by shared ids, phones and names, as far as incoming rows bear them (`deciding_keys`).
2. Within a component, rows that can only go where the row before them went are folded into runs (`_runs`), so a key
   that a third of all rows share leaves a few runs and not a task with a third of the rows. What is left of a
   component is decided in order, by its keys alone (`_decide`).
3. Leads are ordered aggregates over all rows by the lead they met (`_leads`), combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import strings
from ..session import materialize
from . import scans

DOCUMENT_KINDS = ("requirement", "registration")
FIELDS = ("id", "kind", "segment", "name", "city", "state", "address", "phone", "email", "website", "why_now", "why_now_date", "source", "first_seen", "last_seen", "status", "notes")
#: Kinds of leaves: rows that meet by this key only.
BY_PHONE, BY_ID, BY_NAME = "phone", "id", "name"


class Resolution(NamedTuple):
    """leads: FIELDS, sources, n_updated, n_duplicate, n_merged, is_new. links: lead_id, merged_id, first_ord, one row for each other id that a lead took in."""

    leads: DataFrame
    links: DataFrame


def linking_keys(rows: DataFrame, *more: str) -> DataFrame:
    """(rid, key, and the columns of `more`) for ids, phones and names. City stays out: a merge can pair one row's name with another's city."""
    keys = F.array(F.concat(F.lit("i:"), "id"), F.when(F.col("phone") != "", F.concat(F.lit("p:"), "phone")), F.when(F.col("name_key") != "", F.concat(F.lit("n:"), "name_key")))
    return rows.select("rid", *more, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def deciding_keys(rows: DataFrame) -> DataFrame:
    """(rid, key) of the keys that can decide where a row goes: several rows bear them and, but for ids, an incoming one does.

    Only incoming rows look for a lead, each by its own keys, so a phone or name that none of them bears is never asked
    for; of ids the register's last row stays. What is left grows with the incoming rows and what they meet.
    """
    keys = linking_keys(rows, "incoming")
    asked = keys.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("incoming").alias("asked")).where((F.col("n") > 1) & (F.col("asked") | F.col("key").startswith("i:")))
    return keys.join(asked.select("key"), "key").select("rid", "key")


def key_components(keys: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(rid, comp): rows that share keys, directly or through others, get one comp, their smallest rid."""
    keys = materialize(keys.distinct(), "keys")
    labels = materialize(keys.groupBy("rid").agg(F.first("rid").alias("comp")), "labels")
    for _ in range(max_rounds):
        of_key = keys.join(labels, "rid").groupBy("key").agg(F.min("comp").alias("comp"))
        near = keys.join(of_key, "key").groupBy("rid").agg(F.min("comp").alias("near"))
        best = labels.join(near, "rid").select("rid", F.col("comp").alias("old"), F.least("comp", "near").alias("best"))
        jump = labels.select(F.col("rid").alias("best"), F.col("comp").alias("to"))
        after = materialize(best.join(jump, "best", "left").select("rid", "old", F.least("best", F.coalesce("to", "best")).alias("comp")), "labels")
        labels = after.select("rid", "comp")
        if after.where("old <> comp").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _said(c: str) -> Column:
    return F.col(c) != ""


def _at() -> Column:
    """The place of a row in the order of the rule: the register first."""
    return F.struct("incoming", "ord", "rid")


def _first_said(c: str, of: str | None = None) -> Column:
    """The first value of `of` (or `c`) in order among the rows that say `c`."""
    return F.min_by(F.col(of or c), F.when(_said(c), _at()))


def _longest(c: str, of: str | None = None) -> Column:
    """The longest value, the first of equal length; of `of` where given."""
    return F.min_by(F.col(of or c), F.when(_said(c), F.struct(-F.length(c), _at())))


def _leaves(rows: DataFrame) -> DataFrame:
    """Adds leaf and leaf_key, null for rows that must be decided one by one.

    A row is a leaf by phone if its id is its own, others share the phone, and all rows of its name have that phone
    and ids of their own; by id if others share the id, and its phone and name occur with no other id; by name if id
    and phone are its own and it has the name and city most frequent in its component. A leaf goes where the leaf
    of its key before it went, unless a row of another sort stands between them.
    """
    none = F.concat(F.lit("\u0000"), F.col("rid").cast("string"))  # rows without a key share none, and are spread
    keyed = rows.withColumns({"k_id": F.coalesce("id", none), "k_phone": F.when(_said("phone"), F.col("phone")).otherwise(none), "k_name": F.when(_said("name_key"), F.col("name_key")).otherwise(none)})
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    ids = keyed.groupBy("k_id").agg(F.count("*").alias("n_id"))
    keyed = keyed.join(ids, "k_id")
    phones = keyed.groupBy("k_phone").agg(F.count("*").alias("n_phone"), one("k_id").alias("phone_of_id"))
    names = keyed.groupBy("k_name").agg((one("k_phone") & (F.max("n_id") == 1) & ~F.bool_or("document")).alias("name_of_phone"), one("k_id").alias("name_of_id"))
    keyed = keyed.join(phones, "k_phone").join(names, "k_name")
    open_name = F.col("incoming") & ~F.col("document") & (F.col("n_id") == 1) & (F.col("n_phone") == 1) & _said("name_key") & _said("city_key")
    named = F.when(open_name, F.struct("name_key", "city_key"))
    most = keyed.where(open_name).groupBy("comp", "name_key", "city_key").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by(F.struct("name_key", "city_key"), F.struct("n", "name_key", "city_key")).alias("most"))
    keyed = keyed.join(most, "comp", "left")
    by_phone = F.col("incoming") & ~F.col("document") & (F.col("n_id") == 1) & (F.col("n_phone") > 1) & _said("phone") & F.col("name_of_phone")
    by_id = F.col("incoming") & (F.col("n_id") > 1) & F.col("phone_of_id") & F.col("name_of_id")
    leaf = F.when(by_phone, BY_PHONE).when(by_id, BY_ID).when(named == F.col("most"), BY_NAME)
    keyed = keyed.withColumn("leaf", leaf)
    return keyed.select(*rows.columns, "leaf", F.when(F.col("leaf") == BY_PHONE, F.col("phone")).when(F.col("leaf") == BY_ID, F.col("id")).when(F.col("leaf") == BY_NAME, F.col("name_key")).alias("leaf_key"))


def _runs(rows: DataFrame) -> DataFrame:
    """Adds run: rows of one run meet the same lead, and may be decided as one row.

    Leaves of one sort and key, with no row of another sort between them, stand in one stretch. Its first row and
    its first row with a city stay runs of their own, as the lead is found by its name and city as they are after
    these; the rows between them and those after are a run each. Every other row is a run.
    """
    other = {f"not_{k}": (~F.col("leaf").eqNullSafe(F.lit(k))).cast("long") for k in (BY_PHONE, BY_ID, BY_NAME)}
    counted = scans.running_sums(_leaves(rows), [F.col("incoming"), F.col("ord"), F.col("rid")], other, ["comp"])
    stretch = F.when(F.col("leaf") == BY_PHONE, F.col("not_phone")).when(F.col("leaf") == BY_ID, F.col("not_id")).when(F.col("leaf") == BY_NAME, F.col("not_name"))
    counted = counted.withColumn("stretch", F.when(F.col("leaf").isNotNull(), F.concat_ws(" ", "leaf", stretch.cast("string"), "leaf_key")))
    ends = counted.where("stretch IS NOT NULL").groupBy("comp", "stretch").agg(F.min(_at()).alias("head"), F.min(F.when(_said("city"), _at())).alias("placed"))
    part = F.when(_at() == F.col("head"), 0).when(F.col("placed").isNull() | (_at() < F.col("placed")), 1).when(_at() == F.col("placed"), 2).otherwise(3)
    run = F.when(F.col("stretch").isNull(), F.concat(F.lit("row "), F.col("rid").cast("string"))).otherwise(F.concat_ws(" ", part.cast("string"), "stretch"))
    return counted.join(ends, ["comp", "stretch"], "left").select(*rows.columns, run.alias("run"))


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rule over runs that come by component, in order: (comp, run, lead, lead_id, same). Only one component is held."""
    comp, leads, found_by, met = None, {}, {}, []
    rows = lambda: [(comp, run, leads[to]["rid"], leads[to]["id"], same) for run, to, same in met]
    table = lambda out: pd.DataFrame(out, columns=["comp", "run", "lead", "lead_id", "same"])
    for pdf in batches:
        out = []
        for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            if row["comp"] != comp:
                out += rows()
                comp, leads, found_by, met = row["comp"], {}, {}, []
            own = f"i{row['id']}" if row["id"] is not None else f"r{row['rid']}"
            phone = ("phone", row["phone"]) if row["phone"] else None
            name = ("name", row["name_key"], row["city_key"]) if row["name_key"] else None
            to = None
            if row["incoming"]:
                ways = [] if row["document"] else [found_by.get(k) for k in (phone, name) if k]
                to = own if own in leads else next((w for w in ways if w), None)
            if to is None:
                to = own
                leads[own] = dict(row)
            else:
                lead = leads[to]
                lead["phone"] = lead["phone"] or row["phone"]
                if row["name_size"] > lead["name_size"]:
                    lead["name_size"], lead["name_key"] = row["name_size"], row["name_key"]
                if not lead["has_city"] and row["has_city"]:
                    lead["has_city"], lead["city_key"] = True, row["city_key"]
            met.append((row["run"], to, to == own))
            lead = leads[to]
            if not lead["document"]:
                if lead["phone"]:
                    found_by["phone", lead["phone"]] = to
                if lead["name_key"]:
                    found_by["name", lead["name_key"], lead["city_key"]] = to
        yield table(out)
    yield table(rows())


def _decide_runs(runs: DataFrame) -> DataFrame:
    """Components are dealt over the tasks and come one after the other; a group for each of them costs more than its rows."""
    spark = runs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = runs.repartition(parts, "comp").sortWithinPartitions("comp", "incoming", F.asc_nulls_last("ord"), "rid")
    return dealt.mapInPandas(_decide, "comp long, run string, lead long, lead_id string, same boolean")


def _leads(met: DataFrame) -> DataFrame:
    """Leads from the rows with the lead they met: longer names, known facts first, the better segment, the latest reason, the wider span of sightings.

    A date without a reason counts only where no row has a reason; a missing sighting counts as none.
    """
    head = F.col("rid") == F.col("lead")
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.SEGMENT_POINTS.items() for x in kv]), F.col("segment")), F.lit(0))
    reason = F.when(_said("why_now"), F.struct(F.coalesce("why_now_date", F.lit("")), _at()))
    of_head = lambda c: F.max(F.when(head, F.col(c)))
    made = {c: of_head(c) for c in ("id", "kind", "source", "status", "notes")}
    made |= {c: _longest(c) for c in ("name", "address")} | {c: _first_said(c) for c in ("city", "state", "phone", "email", "website")}
    made["segment"] = F.min_by("segment", F.struct(-points, _at()))
    made["why_now"] = F.max_by("why_now", reason)
    made["why_now_date"] = F.when(F.count(reason) > 0, strings.blank_to_null(F.max_by("why_now_date", reason))).otherwise(_first_said("why_now_date"))
    made["first_seen"], made["last_seen"] = F.min(F.when(_said("first_seen"), F.col("first_seen"))), F.max(F.when(_said("last_seen"), F.col("last_seen")))
    took = F.col("incoming") & ~head
    alone = F.count("*") == 1
    return met.groupBy("lead").agg(
        *(F.when(alone, F.max(c)).otherwise(made[c]).alias(c) for c in FIELDS), F.count(F.when(took & F.col("same"), 1)).alias("n_updated"), F.count(F.when(took & ~F.col("same"), 1)).alias("n_duplicate"), F.bool_or(head & F.col("incoming")).alias("is_new")
    )


def resolve(register: DataFrame, incoming: DataFrame) -> Resolution:
    """The register after the incoming leads, both with FIELDS and ord.

    Rows of one ord stand in any order. Of register rows with one id the last stays. A row without an id meets by
    phone and name. No list of ids is kept on a lead, as one lead may take in a third of all rows: they are `links`.
    """
    text = [F.col(c).cast("string").alias(c) for c in FIELDS]
    order = F.col("ord").cast("long").alias("ord")
    both = register.select(*text, order, F.lit(False).alias("incoming")).unionByName(incoming.select(*text, order, F.lit(True).alias("incoming")))
    rows = both.withColumns({"name_key": strings.name_key(F.col("name")), "city_key": F.coalesce(strings.city_key(F.col("city")), F.lit("")), "document": F.coalesce(F.col("kind").isin(*DOCUMENT_KINDS), F.lit(False))})
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    labels = key_components(deciding_keys(rows))
    shared = labels.groupBy("comp").agg((F.count("*") > 1).alias("shared"))
    placed = rows.join(labels.join(shared, "comp"), "rid", "left")
    several = materialize(_runs(placed.where("shared").drop("shared")), "runs")
    runs = several.groupBy("comp", "run").agg(
        F.min(_at()).alias("at"), F.min("id").alias("id"), F.bool_or("document").alias("document"), _first_said("phone").alias("phone"),
        _longest("name", "name_key").alias("name_key"), F.coalesce(F.max(F.length("name")), F.lit(0)).alias("name_size"), F.coalesce(_first_said("city", "city_key"), F.lit("")).alias("city_key"), F.bool_or(F.coalesce(_said("city"), F.lit(False))).alias("has_city"),
    )
    runs = runs.select("*", "at.incoming", "at.ord", "at.rid").drop("at")
    decided = _decide_runs(runs)
    keep = [*FIELDS, "ord", "incoming", "rid", "lead", "lead_id", "same"]
    met = several.join(decided, ["comp", "run"]).where("incoming OR rid = lead").select(*keep)
    met = met.unionByName(placed.where("shared IS NULL OR NOT shared").select(*FIELDS, "ord", "incoming", "rid", F.col("rid").alias("lead"), F.col("id").alias("lead_id"), F.lit(True).alias("same")))
    met = materialize(met, "met")
    links = met.where("incoming AND NOT same").groupBy("lead", "lead_id", F.col("id").alias("merged_id")).agg(F.min("ord").alias("first_ord"))
    sources = met.groupBy("lead", "source").agg(F.min(_at()).alias("at")).groupBy("lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda s: s["source"]).alias("sources"))
    merged = links.where("merged_id IS NOT NULL").groupBy("lead").agg(F.count("*").alias("n_merged"))
    leads = _leads(met).join(sources, "lead").join(merged, "lead", "left").withColumn("n_merged", F.coalesce("n_merged", F.lit(0)))
    return Resolution(leads.select(*FIELDS, "sources", "n_updated", "n_duplicate", "n_merged", "is_new"), links.where("merged_id IS NOT NULL").select("lead_id", "merged_id", "first_ord"))
