"""Structured Streaming ingest: idempotent messages, corrections, commands, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MESSAGE = "array<struct<id:string,`from`:string,timestamp:string,type:string,text:struct<body:string>,button:struct<text:string>,interactive:struct<button_reply:struct<title:string>,list_reply:struct<title:string>>>>"
STATUS = "array<struct<id:string,status:string,timestamp:string,recipient_id:string>>"
ENVELOPE = f"struct<entry:array<struct<changes:array<struct<field:string,value:struct<messages:{MESSAGE},statuses:{STATUS}>>>>>>"


def changes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The values of all message changes of webhook bodies."""
    entries = bodies.select(F.explode(F.from_json(body, ENVELOPE)["entry"]).alias("e"))
    return entries.select(F.explode("e.changes").alias("c")).where("c.field = 'messages'").select("c.value.*")


def messages(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per message: id, sender, at, type and its text, of plain, button and interactive messages."""
    m = changes(bodies, body).select(F.explode("messages").alias("m"))
    text = F.coalesce("m.text.body", "m.button.text", "m.interactive.button_reply.title", "m.interactive.list_reply.title")
    return m.select(F.col("m.id").alias("id"), F.col("m.from").alias("sender"), F.timestamp_seconds(F.col("m.timestamp").try_cast("bigint")).alias("at"), F.col("m.type").alias("type"), text.alias("text"))


def statuses(bodies: DataFrame, body: str = "body") -> DataFrame:
    s = changes(bodies, body).select(F.explode("statuses").alias("s"))
    return s.select(F.col("s.id").alias("id"), F.col("s.status").alias("status"), F.timestamp_seconds(F.col("s.timestamp").try_cast("bigint")).alias("at"), F.col("s.recipient_id").alias("recipient"))


def once(stream: DataFrame, keys: list[str], at: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once. Without a delay the state holds every key ever seen; with one, late repeats may pass."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys) if at and delay else stream.dropDuplicates(keys)


def windows(stream: DataFrame, at: str, delay: str, length: str, step: str | None, *by: str) -> DataFrame:
    """Extension: counts in tumbling or sliding windows, late rows dropped after the delay."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length, step), *by).agg(F.count("*").alias("n"))


def fold_batches(stream: DataFrame, apply, checkpoint: str) -> DataStreamWriter:
    """Batches in order through `apply(batch, number)`; numbers repeat after a failure, so apply must upsert."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
