"""Replays of logged events through the streaming operators, to the end of the log."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import ingest, register


def idempotent_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts by event type after each (user, type) was let through once, by a stream over the file."""
    out, state = (f"{shared_dir(spark)}/leadloom-replay-{uuid.uuid4().hex}/{part}" for part in ("out", "state"))
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if not path.endswith("/") else spark.readStream.schema(schema).parquet(path)
    first = ingest.once(stream.select("user_id", "event_type"), ["user_id", "event_type"])
    run = first.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(first.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


def written_in_order(rows: DataFrame, at: str, batches: int) -> str:
    """A folder to which the rows were written in `batches` steps of equal spans of time, so a stream over it meets them in order."""
    path = f"{shared_dir(rows.sparkSession)}/leadloom-replay-{uuid.uuid4().hex}/rows"
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    if low is None:
        rows.write.parquet(path)
        return path
    step = F.least(F.lit(batches - 1), F.floor((F.unix_micros(at) - low) * batches / max(high - low, 1)))
    for k in range(batches):
        rows.where(F.coalesce(step, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def to_the_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream writes until its sources are read: every batch's rows, kept apart by its number, so a batch that is repeated counts once."""
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/leadloom-replay-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")
    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{home}/out").parquet(f"{home}/out").drop("batch")


def _followed(rows: DataFrame, at: str, batches: int) -> DataFrame:
    """A stream over the rows in order of time, a step at a time."""
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(written_in_order(rows, at, batches))


def running_register(sightings: DataFrame, delay: str, quiet: datetime.timedelta, batches: int = 4) -> DataFrame:
    """The register after a stream has met the sightings (key, at, status) in order: each key's last state, and whether it fell quiet."""
    spark = sightings.sparkSession
    name, provider = register.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        return register.latest(to_the_end(register.running_register(_followed(sightings, "at", batches), delay, quiet), "update"))
    finally:
        spark.conf.set(name, before)


def late_failures(sent: DataFrame, reports: DataFrame, delay: str, within: str, batches: int = 4) -> DataFrame:
    """The failures that two streams over sent and reports join, to the end of both."""
    return to_the_end(register.late_failures(_followed(sent, "at", batches), _followed(reports, "at", batches), delay, within))
