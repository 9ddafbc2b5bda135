"""Evidence bundles as files: sealed and written by run, scanned, hashed anew and held against the runs.

A bundle is one JSON object: schema, runId, receiptCount, hash, receipts. Its hash is worked out from the receipts as
they are stored, so any change of one, of their order or number shows. One bundle is one file and one row; runs
are what the work is spread by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, strings
from ..operators import scans

SCHEMA = "evidence/1"


def numbered(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Receipts (bundle, seq, payload) of bundles after entries (bundle, ord, type, at, role, data) came in.

    Stored receipts keep their numbers, entries follow in order of ord, counted over ranges of it; a missing role
    follows from the type. A bundle that nothing came into is not sealed again; others end with a receipt that says how many there were before it.
    """
    has = stored.groupBy("bundle").agg((F.max("seq") + 1).alias("has"))
    came = scans.ordinals(entries, [F.asc("ord")], "nth", ["bundle"]).join(has, "bundle", "left")
    seq = (F.coalesce("has", F.lit(0)) + F.col("nth") - 1).cast("long")
    fields = F.struct(seq.alias("seq"), F.col("type"), F.col("at"), F.coalesce("role", strings.receipt_role(F.col("type"))).alias("role"), F.col("data"))
    new = came.select("bundle", seq.alias("seq"), F.to_json(fields).alias("payload"))
    seals = came.groupBy("bundle").agg(F.max(seq).alias("last"), F.max("at").alias("at"))
    sealed = F.struct((F.col("last") + 1).alias("seq"), F.lit("evidence.sealed").alias("type"), F.col("at"), F.lit("auditor").alias("role"), F.col("bundle").alias("runId"), (F.col("last") + 1).alias("receiptCount"))
    return stored.select("bundle", "seq", "payload").unionByName(new).unionByName(seals.select("bundle", (F.col("last") + 1).alias("seq"), F.to_json(sealed).alias("payload")))


def sealed(receipts: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """(bundle, n, hash, body) of receipts (bundle, seq, payload): body is what the file holds."""
    each = receipts.groupBy("bundle").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda r: r["payload"]).alias("r"))
    made = each.select("bundle", F.size("r").alias("n"), hashing.bundle_hash(schema, F.col("r")).alias("hash"), "r")
    head = F.to_json(F.struct(F.lit(schema).alias("schema"), F.col("bundle").alias("runId"), F.col("n").alias("receiptCount"), "hash"))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"receipts":['), F.array_join("r", ","), F.lit("]}"))
    return made.select("bundle", "n", "hash", body.alias("body"))


def write_bundles(bundles: DataFrame, path: str) -> None:
    """One file for each (bundle, body), in a folder of the bundle's name."""
    bundles.select(F.col("bundle").alias("run"), F.col("body").alias("value")).write.mode("overwrite").partitionBy("run").text(path)


def scan(spark: SparkSession, path: str, run_of_path: str = r"run=([^/]+)/[^/]*$", pattern: str = "*") -> DataFrame:
    """(run, path, body) of the files below `path`; the run is what `run_of_path` finds in the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", run_of_path, 1).alias("run"), "path", F.decode("content", "UTF-8").alias("body")).where("run <> ''")


def problems(files: DataFrame) -> DataFrame:
    """Adds hash (as the file says), recomputed and problems, an array, empty for a file that holds."""
    parsed = files.withColumn("whole", F.from_json("body", "schema string, receiptCount long, hash string"))
    listed = F.from_json(F.get_json_object("body", "$.receipts"), "array<string>")  # each as compact text, keys in their order
    is_list = F.col("body").rlike(r'"receipts"\s*:\s*\[')
    parsed = parsed.withColumn("r", F.when(is_list, F.coalesce(listed, F.array().cast("array<string>"))))
    schema = F.col("whole.schema")
    recomputed = F.sha2(F.concat(F.coalesce(schema, F.lit("")), F.lit("\n"), F.size("r").cast("string"), F.lit("\n"), F.array_join(F.transform("r", lambda x: F.concat(x, F.lit("\n"))), "")), 256)
    parsed = parsed.withColumn("recomputed", recomputed)
    seqs = F.transform("r", lambda x, i: F.struct(i.alias("i"), F.get_json_object(x, "$.seq").alias("seq")))
    misplaced = F.transform(F.filter(seqs, lambda x: ~x["seq"].eqNullSafe(x["i"].cast("string"))), lambda x: F.concat(F.lit("receipt "), x["i"].cast("string"), F.lit(" has seq "), F.coalesce(x["seq"], F.lit("none"))))
    broken = F.try_parse_json("body").isNull()
    found = F.array(
        F.when(~broken & schema.isNull(), "missing schema"), F.when(~broken & F.col("r").isNull(), "missing receipts array"),
        F.when(F.col("r").isNotNull() & ~F.col("whole.receiptCount").eqNullSafe(F.size("r").cast("long")), F.concat(F.lit("receiptCount "), F.coalesce(F.col("whole.receiptCount").cast("string"), F.lit("none")), F.lit(" != receipts "), F.size("r").cast("string"))),
        F.when(F.col("r").isNotNull() & ~F.col("whole.hash").eqNullSafe(F.col("recomputed")), "hash mismatch"),
    )
    told = F.when(broken, F.array(F.lit("not JSON"))).otherwise(F.concat(F.filter(found, lambda x: x.isNotNull()), F.coalesce(misplaced, F.array().cast("array<string>"))))
    return parsed.select(*files.columns, F.col("whole.hash").alias("hash"), F.when(~broken, F.col("recomputed")).alias("recomputed"), told.alias("problems"))


def against_runs(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """(run, files, recomputed, problems) of every run of `runs` (run, hash) and every checked file's run.

    A run without a file, a file without a run, several files of one run and a hash that is not the run's are
    problems beside those of the files.
    """
    of_run = checked.groupBy("run").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("recomputed")).alias("recomputed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("found"))
    both = runs.select("run", F.col("hash").alias("noted"), F.lit(True).alias("known")).join(of_run, "run", "full")
    more = F.array(
        F.when(F.col("files").isNull(), "no file"), F.when(F.col("known").isNull(), "no run"), F.when(F.col("files") > 1, "several files"),
        F.when(F.col("noted").isNotNull() & F.col("files").isNotNull() & ~F.array_contains("recomputed", F.col("noted")), "not the hash of the run"),
    )
    told = F.concat(F.coalesce("found", F.array().cast("array<string>")), F.filter(more, lambda x: x.isNotNull()))
    return both.select("run", F.coalesce("files", F.lit(0)).alias("files"), F.array_join(F.coalesce("recomputed", F.array().cast("array<string>")), " ").alias("recomputed"), F.array_join(told, "; ").alias("problems"))
