"""Evidence bundles as files."""

import hashlib
import json

from pyspark.sql import functions as F

from leadloom.sources import bundles

ENTRIES = "bundle string, ord long, type string, at string, role string, data struct<n:int,s:string>"


def numbered(spark, stored, entries):
    rows = bundles.numbered(spark.createDataFrame(stored, "bundle string, seq long, payload string"), spark.createDataFrame(entries, ENTRIES))
    return [(r["bundle"], r["seq"], json.loads(r["payload"])) for r in rows.orderBy("bundle", "seq").collect()]


def bundle(receipts, **over):
    payload = "s/1\n" + f"{len(receipts)}\n" + "".join(json.dumps(r, separators=(",", ":"), ensure_ascii=False) + "\n" for r in receipts)
    return {"schema": "s/1", "runId": "r", "receiptCount": len(receipts), "hash": hashlib.sha256(payload.encode()).hexdigest(), "receipts": receipts} | over


def test_receipts_are_numbered_after_those_stored(spark):
    got = numbered(spark, [("a", 0, "{}"), ("a", 1, "{}"), ("c", 0, '{"x":1}')], [("a", 9, "llm.call", "t2", None, (1, "x")), ("a", 3, "order.won", "t1", "owner", (2, None)), ("b", 1, "run.created", "t0", None, None)])
    assert [(b, s, p.get("type"), p.get("role")) for b, s, p in got] == [
        ("a", 0, None, None), ("a", 1, None, None), ("a", 2, "order.won", "owner"), ("a", 3, "llm.call", "reader"), ("a", 4, "evidence.sealed", "auditor"),
        ("b", 0, "run.created", "auditor"), ("b", 1, "evidence.sealed", "auditor"), ("c", 0, None, None),
    ]
    assert got[4][2]["receiptCount"] == 4 and got[2][2]["data"] == {"n": 2}
    assert numbered(spark, [], []) == []


def test_files_changed_missing_doubled_and_of_no_run(spark, tmp_path):
    receipts = [{"seq": 0, "type": "z", "at": "t", "a": 'quote " \\ é/', "n": 1.5}, {"seq": 1, "type": "a", "m": {"k": [1, None, True]}}]
    good = bundle(receipts)
    moved = bundle(receipts[::-1])
    files = {
        "run=good/x": json.dumps(good, indent=2, ensure_ascii=False), "run=changed/x": json.dumps(good | {"receipts": [receipts[0] | {"n": 2.5}, receipts[1]]}), "run=order/x": json.dumps(moved), "run=count/x": json.dumps(good | {"receiptCount": 7}),
        "run=short/x": json.dumps({k: v for k, v in good.items() if k not in ("receipts", "schema")}), "run=text/x": "{not json", "run=twice/x": json.dumps(good), "run=twice/y": json.dumps(good), "run=stray/x": json.dumps(good), "run=empty/x": json.dumps(bundle([])), "other": "x",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body, encoding="utf-8")
    runs = spark.createDataFrame([(r, good["hash"]) for r in ("good", "changed", "count", "twice", "gone")] + [(r, None) for r in ("order", "short", "text", "empty")], "run string, hash string")
    got = {r["run"]: r["problems"] for r in bundles.against_runs(runs, bundles.problems(bundles.scan(spark, str(tmp_path)))).collect()}
    assert got == {
        "good": "", "changed": "hash mismatch; not the hash of the run", "order": "receipt 0 has seq 1; receipt 1 has seq 0", "count": "receiptCount 7 != receipts 2", "short": "missing receipts array; missing schema", "text": "not JSON",
        "twice": "several files", "stray": "no run", "gone": "no file", "empty": "",
    }


def test_what_is_sealed_and_written_holds(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("bundle"), F.col("id").alias("ord"), F.lit("source.read").alias("type"), F.lit("t").alias("at"), F.lit(None).cast("string").alias("role"), F.struct(F.lit(1).alias("n"), F.lit('a "b" é\n').alias("s")).alias("data"))
    made = bundles.sealed(bundles.numbered(spark.createDataFrame([], "bundle string, seq long, payload string"), rows)).cache()
    bundles.write_bundles(made, str(tmp_path / "w"))
    got = bundles.against_runs(made.select(F.col("bundle").alias("run"), "hash"), bundles.problems(bundles.scan(spark, str(tmp_path / "w")))).collect()
    assert sorted((r["run"], r["files"], r["problems"]) for r in got) == [("b0", 1, ""), ("b1", 1, ""), ("b2", 1, "")]
