"""The order loop: orders are recorded once, matched to leads, and kept on the lead they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, labels, strings
from . import dedupe


def _first(leads: DataFrame, key: Column, name: str) -> DataFrame:
    """The first lead in register order of every key."""
    keyed = leads.select(key.alias("__key"), "ord", "id").where("__key IS NOT NULL")
    return keyed.groupBy("__key").agg(F.min(F.struct("ord", "id")).alias("__first")).select("__key", F.col("__first.id").alias(name))


def _name_city(name: Column, city: Column) -> Column:
    key = strings.name_key(name)
    return F.when(key != "", F.concat(key, F.lit("|"), strings.city_key(city)))


def match_leads(orders: DataFrame, leads: DataFrame) -> DataFrame:
    """Adds lead and matched_on: by phone, else by trading name and city, in each case the first in register order (ord); prices never match.

    Two equi-joins on keys aggregated before; orders without a key keep null and meet no join partner.
    """
    buyers = leads.where("kind <> 'price'")
    by_phone = _first(buyers, strings.phone(F.col("phone")), "__p").withColumnRenamed("__key", "__phone")
    by_name = _first(buyers, _name_city(F.col("name"), F.col("city")), "__n").withColumnRenamed("__key", "__name")
    keyed = orders.withColumn("__phone", strings.phone(F.col("phone"))).withColumn("__name", _name_city(F.col("business_name"), F.col("city")))
    met = keyed.join(by_phone, "__phone", "left").join(by_name, "__name", "left")
    out = met.withColumn("lead", F.coalesce("__p", "__n")).withColumn("matched_on", F.when(F.col("__p").isNotNull(), "phone").when(F.col("__n").isNotNull(), "name+city"))
    return out.drop("__p", "__n", "__phone", "__name")


def lead_id_of(order_source: str) -> Column:
    """The id of the lead that an unmatched order makes: of its phone, else of its name and city."""
    external = F.coalesce(strings.phone(F.col("phone")), F.concat(strings.name_key(F.col("business_name")), F.lit("|"), strings.city_key(F.col("city"))))
    return hashing.lead_id(F.lit(order_source), external)


def record_orders(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming orders that are not logged, the first of every id by receipt."""
    return dedupe.keep_first(incoming, ["id"], ["received_at", "business_name", "phone"]).join(log.select("id"), "id", "left_anti")


def upsert_leads(leads: DataFrame, orders: DataFrame, order_source: str = "site") -> DataFrame:
    """The register after new orders: id, kind, name, city, phone, email, status, why_now, notes, ord, created.

    A matched lead is won and gains missing phone and e-mail of its earliest order that has one; its last order is its
    reason. Unmatched orders make one lead of each id. Only aggregates of a lead's orders move; the orders
    themselves are rows of lead_orders.
    """
    placed = match_leads(orders, leads).withColumn("id_of", F.coalesce("lead", lead_id_of(order_source)))
    lines = labels.order_lines(F.col("products"), F.col("details"))
    day = F.coalesce("created_at", "received_at").cast("date")
    per = placed.withColumn("why", labels.why_now_from_order(day, lines)).withColumn("order", F.struct("received_at", "id"))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("order"), c.alias("v"))))["v"]
    of_lead = per.groupBy("id_of").agg(
        F.max_by("why", "order").alias("new_why"), F.max_by("id", "order").alias("last_order"),
        first(strings.phone(F.col("phone"))).alias("new_phone"), first(strings.email(F.col("email"))).alias("new_email"),
        F.min_by(F.coalesce("business_name", "contact_name", "id"), "order").alias("new_name"), F.min_by("city", "order").alias("new_city"),
    )
    both = leads.withColumn("here", F.lit(True)).join(of_lead, F.col("id") == F.col("id_of"), "full")
    touched, created = F.col("id_of").isNotNull(), F.col("here").isNull()
    note = F.when(touched & ~created, F.concat(F.lit("won: order "), "last_order"))
    return both.select(
        F.coalesce("id", "id_of").alias("id"), F.coalesce("kind", F.lit("buyer")).alias("kind"), F.coalesce("name", strings.tidy(F.col("new_name"), 160)).alias("name"),
        F.when(created, F.col("new_city")).otherwise(F.col("city")).alias("city"), F.coalesce("phone", "new_phone").alias("phone"), F.coalesce("email", "new_email").alias("email"),
        F.when(touched, "won").otherwise(F.col("status")).alias("status"), F.coalesce("new_why", "why_now").alias("why_now"),
        strings.blank_to_null(F.concat_ws("\n", "notes", note)).alias("notes"), "ord", created.alias("created"),
    )


def lead_orders(kept: DataFrame, orders: DataFrame, leads: DataFrame, order_source: str = "site") -> DataFrame:
    """Rows to append to a lead's orders (lead, order_id, at, lines, notes): each order once, and none that `kept` (lead, order_id) has."""
    placed = match_leads(orders, leads)
    rows = placed.select(
        F.coalesce("lead", lead_id_of(order_source)).alias("lead"), F.col("id").alias("order_id"), F.coalesce("created_at", "received_at").alias("at"),
        labels.order_lines(F.col("products"), F.col("details")).alias("lines"), "notes",
    )
    return dedupe.keep_first(rows, ["lead", "order_id"], ["at"]).join(kept.select("lead", "order_id"), ["lead", "order_id"], "left_anti")


def order_events(placed: DataFrame, leads: DataFrame) -> DataFrame:
    """Events that recording leaves: (type, key, lead, from, to), keyed so that a repeat appends nothing."""
    status = leads.select(F.col("id").alias("lead"), F.col("status").alias("from"))
    known = placed.join(status, "lead", "left")
    received = known.select(F.lit("order.received").alias("type"), F.col("id").alias("key"), "lead", F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"))
    won = known.where(F.coalesce(F.col("from") != "won", F.lit(True))).select(F.lit("lead.won").alias("type"), F.col("id").alias("key"), "lead", "from", F.lit("won").alias("to"))
    return received.unionByName(won)


def by_alert(messages: DataFrame, orders: DataFrame) -> DataFrame:
    """Message ids of later reports with the order whose alert they were: orders hold alert.whatsapp.message_id."""
    return messages.join(orders.select(F.col("id").alias("order_id"), F.col("alert.whatsapp.message_id").alias("message_id")).where("message_id IS NOT NULL"), "message_id", "left")


def patch_events(log: DataFrame, patches: DataFrame) -> DataFrame:
    """Keyed events with their maps patched: (type, key, payload map); patches (type, key, ord, patch map) apply in order, later values win."""
    entries = patches.select("type", "key", "ord", F.explode("patch").alias("name", "value"))
    last = entries.groupBy("type", "key", "name").agg(F.max_by("value", "ord").alias("value"))
    merged = last.groupBy("type", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("patch"))
    out = log.join(merged, ["type", "key"], "left")
    kept = F.map_filter("payload", lambda k, _: ~F.coalesce(F.map_contains_key("patch", k), F.lit(False)))
    return out.select("type", "key", F.when(F.col("patch").isNull(), F.col("payload")).otherwise(F.map_concat(kept, "patch")).alias("payload"))
