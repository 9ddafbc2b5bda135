"""The register as running state of a stream, and late failures of what was sent.

Sightings are keyed by what links them, so each lead's state lies with its key; what a sighting does to it commutes,
so batches of any size, in any order, leave what one fold over all of them would. A timer tells when a lead has not
been seen for so long.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State in RocksDB: what the state processors need, set on the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Times are kept in microseconds, which no time zone of a worker touches.
STATE = "first_seen long, last_seen long, sightings long, status string, status_at long"
LEAD = f"key string, event string, {STATE}"


def linking_key(phone: Column, name_key: Column, city_key: Column, external: Column) -> Column:
    """What a sighting is kept by: its phone, else its name and city, else its own id."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(F.concat(F.lit("p:"), some(phone)), F.concat(F.lit("n:"), some(name_key), F.lit("|"), F.coalesce(city_key, F.lit(""))), F.concat(F.lit("i:"), external))


class _Register(StatefulProcessor):
    """State of one key: the span and number of its sightings, and its last status by time, the greater one on ties.

    Rows are taken one by one: a key has few in a batch, and a data frame for each key costs more than all of them. The
    timer to take back follows from the state, so none are listed.
    """

    def __init__(self, quiet: datetime.timedelta):
        self._quiet = quiet // datetime.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._lead = handle.getValueState("lead", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, n, status, at = self._lead.get() or (None, None, 0, None, None)
        old = last
        for row in rows:
            n += 1
            seen, told = row["micros"], row["status"]
            if seen is None:
                continue
            first, last = min(seen if first is None else first, seen), max(seen if last is None else last, seen)
            if told is not None and (at is None or (seen, told) > (at, status)):
                at, status = seen, told
        self._lead.update((first, last, n, status, at))
        if last != old:
            if old is not None:
                self._handle.deleteTimer(self._due(old))
            self._handle.registerTimer(self._due(last))
        yield self._row(key, "seen", (first, last, n, status, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, "quiet", self._lead.get())

    def _due(self, last: int) -> int:
        return (last + self._quiet) // 1000

    def _row(self, key, event: str, state: tuple) -> Row:
        return Row(**dict(zip((c.split()[0] for c in LEAD.split(", ")), (key[0], event, *state), strict=True)))

    def close(self) -> None:
        pass


def running_register(sightings: DataFrame, delay: str, quiet: datetime.timedelta) -> DataFrame:
    """A row of the key's whole state after each batch that saw it (event 'seen'), and one when it has not been seen for `quiet`.

    sightings (key, at, status), a stream; null statuses change none, and null times count as a sighting only. Sightings later than `delay` are dropped by the watermark.
    Null keys are left out.
    """
    rows = sightings.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("status").cast("string").alias("status"))
    rows = rows.where("key IS NOT NULL").withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    out = rows.groupBy("key").transformWithState(_Register(quiet), LEAD, "Update", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "status_at")})


def register_fold(sightings: DataFrame) -> DataFrame:
    """What running_register leaves of each key, from all sightings at once: key, first_seen, last_seen, sightings, status, status_at."""
    told = F.when(F.col("status").isNotNull() & F.col("at").isNotNull(), F.struct("at", "status"))
    out = sightings.where("key IS NOT NULL").groupBy(F.col("key").cast("string").alias("key"))
    out = out.agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("sightings"), F.max(told).alias("told"))
    return out.select("key", "first_seen", "last_seen", "sightings", F.col("told.status").alias("status"), F.col("told.at").alias("status_at"))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each key that a running register wrote: states only grow, so the most sightings are the last; quiet counts if it was told of the last sighting."""
    last = rows.groupBy("key").agg(F.max(F.struct("sightings", F.col("event") == "quiet", "first_seen", "last_seen", "status", "status_at")).alias("s"))
    return last.select("key", "s.first_seen", "s.last_seen", "s.sightings", "s.status", "s.status_at", F.col("s.col2").alias("quiet"))


def late_failures(sent: DataFrame, reports: DataFrame, delay: str, within: str) -> DataFrame:
    """sent (message, at, and more) beside the failures reported of each message within so long after it, as a stream.

    A left outer join of two streams: what failed has `failed_at`; what nothing was reported of comes with null once the
    watermark has passed its time. Reports (message, status, at) of other statuses are passed over, a failure reported
    again is one while within the delay, and reports of messages that were not sent join nothing. Null messages join nothing.
    """
    out = sent.withWatermark("at", delay).alias("s")
    failed = reports.withColumnRenamed("at", "failed_at").withWatermark("failed_at", delay)
    # A test that reads the time stays above the watermark, so every report moves it on, not only failures.
    failed = failed.where("CASE WHEN failed_at IS NULL THEN false ELSE status = 'failed' END").select(F.col("message").alias("of"), "failed_at")
    failed = failed.dropDuplicatesWithinWatermark(["of"]).alias("r")
    in_time = F.expr(f"message = of AND failed_at >= at AND failed_at <= at + interval {within}")
    return out.join(failed, in_time, "left_outer").drop("of")


def corrected(deliveries: DataFrame, failures: DataFrame) -> DataFrame:
    """deliveries (message, state) after the failures: the first one makes a delivery 'failed later', once; others stay."""
    first = failures.where("failed_at IS NOT NULL").groupBy(F.col("message").alias("of")).agg(F.min("failed_at").alias("failed_at"))
    met = deliveries.join(first, F.col("message") == F.col("of"), "left").drop("of")
    late = F.col("failed_at").isNotNull() & (F.col("state") != "failed later")
    return met.withColumn("state", F.when(late, "failed later").otherwise(F.col("state")))
