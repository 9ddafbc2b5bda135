"""Running state over streams: a replay in batches equals one fold, timers tell who fell quiet, failures come late."""

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from leadloom.streaming import register, replay

DAY = datetime.timedelta(days=1)
T0 = datetime.datetime(2026, 3, 1)


def sightings(n=300):
    rng = random.Random(4)
    rows = [(rng.choice(["p:1", "p:1", "p:1", "n:a|x", "i:7", "p:2", None]), T0 + DAY * rng.uniform(0, 20), rng.choice([None, None, "won", "lost", "quoted"])) for _ in range(n)]
    rows += [("early", T0 + DAY, "won"), ("early", T0 + DAY, "lost"), ("no time", None, "won"), ("once", T0 + DAY * 19.9, None)]
    return rows + rows[:5]  # repeated rows are sightings too


def test_linking_key(spark):
    rows = [("+91", "ann", "pune", "7"), (None, "ann", None, "7"), ("", "", "pune", "7"), (None, None, None, None)]
    got = spark.createDataFrame(rows, "p string, n string, c string, e string").select(register.linking_key(F.col("p"), F.col("n"), F.col("c"), F.col("e")).alias("k")).collect()
    assert [r["k"] for r in got] == ["p:+91", "n:ann|", "i:7", None]


def test_replay_equals_the_fold(spark):
    table = spark.createDataFrame(sightings(), "key string, at timestamp, status string")
    fields = ("first_seen", "last_seen", "sightings", "status", "status_at")
    want = {r["key"]: tuple(r[f] for f in fields) for r in register.register_fold(table).collect()}
    for batches in (1, 5):
        rows = replay.running_register(table, "2 days", 6 * DAY, batches).collect()
        assert {r["key"]: tuple(r[f] for f in fields) for r in rows} == want and len(rows) == len(want)
        quiet = {r["key"] for r in rows if r["quiet"]}
        watermark = max(at for _, at, _ in sightings() if at) - 2 * DAY
        assert quiet == {k for k, v in want.items() if v[1] and v[1] + 6 * DAY <= watermark} >= {"early"}
    assert want["early"][3] == "won" and want["no time"][:4] == (None, None, 1, None)


def test_nothing_seen(spark):
    none = spark.createDataFrame([], "key string, at timestamp, status string")
    assert replay.running_register(none, "1 day", DAY).count() == 0


def test_late_failures(spark):
    at = lambda days: T0 + DAY * days
    sent = [("kept", at(0), 1), ("late", at(1), 2), ("twice", at(2), 3), ("too late", at(3), 4), ("before", at(4), 5), (None, at(5), 6), ("read", at(6), 7), ("last", at(20), 8)]
    reports = [("late", "failed", at(2.5)), ("twice", "failed", at(2.2)), ("twice", "failed", at(2.4)), ("too late", "failed", at(9)), ("before", "failed", at(3.9)), ("orphan", "failed", at(4)), (None, "failed", at(5)), ("read", "read", at(6.1)), ("x", "read", at(21))]
    sent = spark.createDataFrame(sent, "message string, at timestamp, number int")
    reports = spark.createDataFrame(reports, "message string, status string, at timestamp")
    for batches in (1, 4):
        got = replay.late_failures(sent, reports, "1 day", "2 days", batches).collect()
        assert {r["message"]: r["failed_at"] for r in got if r["failed_at"]} == {"late": at(2.5), "twice": at(2.2)}
        # what the watermark has passed stands; the last message may still fail
        assert {r["number"] for r in got} == {1, 2, 3, 4, 5, 6, 7}
    states = {r["message"]: r["state"] for r in register.corrected(sent.select("message", F.when(F.col("number") == 2, "failed later").otherwise("sent").alias("state")), replay.late_failures(sent, reports, "1 day", "2 days")).collect()}
    assert states == {"kept": "sent", "late": "failed later", "twice": "failed later", "too late": "sent", "before": "sent", None: "sent", "read": "sent", "last": "sent"}


class Handle:
    """A state handle that notes what it is asked: one read and one write of the state a visit, no lists of timers."""

    def __init__(self):
        self.asked, self.kept, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked.append("get")
        return self.kept

    def update(self, value):
        self.asked.append("update")
        self.kept = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_visit_reads_and_writes_its_state_once(spark):
    lead, handle = register._Register(DAY), Handle()
    lead.init(handle)
    visits = [[(5_000, "won"), (None, "lost"), (3_000, None)], [(4_000, "lost")], [(9_000, None), (5_000, "zzz")]]
    got = [[tuple(r) for r in lead.handleInputRows(("k",), iter([Row(micros=m, status=s) for m, s in rows]), None)] for rows in visits]
    assert got == [[("k", "seen", 3_000, 5_000, 3, "won", 5_000)], [("k", "seen", 3_000, 5_000, 4, "won", 5_000)], [("k", "seen", 3_000, 9_000, 6, "zzz", 5_000)]]
    assert handle.asked == ["get", "update"] * 3 and handle.timers == {86_400_009}
