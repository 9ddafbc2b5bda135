"""Sinks: register tables, keyed appends, CSV, evidence bundles, capped messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import hashing, strings
from ..operators import dedupe


def table_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A stored table, or no rows where none was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def put_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite by the commit protocol: readers see the old table or the new one. Readers of `path` itself write elsewhere first."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_table(spark: SparkSession, incoming: DataFrame, key: str, path: str, next_path: str) -> DataFrame:
    """Merge incoming rows into the table at `path`; the new version goes to `next_path`, and is returned."""
    put_table(dedupe.upsert(table_or_empty(spark, path, incoming.schema), incoming, key), next_path)
    return spark.read.schema(incoming.schema).parquet(next_path)


def _pointer(spark: SparkSession, path: str):
    """The file that names the version of the table at `path` that holds, and Hadoop's classes for paths."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    return fs, fs.Path(f"{path}/current")


def current_version(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The version of a swapped table that holds now, or no rows where none was put. A plan made from it keeps reading that version."""
    fs, pointer = _pointer(spark, path)
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{spark.read.text(pointer.toString()).first()['value']}")


def swap_table(rows: DataFrame, path: str) -> None:
    """Write `rows` as a new version, then let the pointer name it by one rename: readers see the old table or the new one, whole.

    `rows` may read the version before. A job that fails leaves the pointer, and so the table, as it was. One
    writer at a time; earlier versions stay until someone clears them.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    fs, pointer = _pointer(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    draft = fs.Path(f"{path}/_next-{version}")
    out = pointer.getFileSystem(conf).create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    files = fs.FileContext.getFileContext(pointer.getFileSystem(conf).getUri(), conf)
    files.rename(draft, pointer, how)


def put_run(spark: SparkSession, runs: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Runs into the run table: those of a known id replace it; returns the table after."""
    swap_table(dedupe.upsert(current_version(spark, path, runs.schema), runs, key), path)
    return current_version(spark, path, runs.schema)


def jdbc_table(spark: SparkSession, url: str, table: str, by: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by `parts` tasks, each a range of the number `by`; the range is asked of the database.

    Filters and columns are pushed to it. A row whose `by` is null is read by the first task; an empty table is no rows.
    """
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    lowest, highest = reader(query= f"SELECT MIN({by}) AS a, MAX({by}) AS b FROM {table}").load().first()
    if lowest is None:
        return reader(dbtable=table).load()
    return reader(dbtable=table, partitionColumn=by, lowerBound=int(lowest), upperBound=int(highest) + 1, numPartitions=parts).load()


def append_events(log: DataFrame, events: DataFrame, path: str, order: list) -> None:
    dedupe.append_keyed(log, events, order).write.mode("append").parquet(path)


def csv_lines(rows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One line a row, beside the columns to keep; cells quoted only where needed, nulls empty, arrays joined by '; '."""
    kinds = dict(rows.dtypes)
    cell = lambda c: strings.csv_cell(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c))
    return rows.select(*(keep or []), F.concat_ws(",", *map(cell, columns)).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def evidence_bundles(receipts: DataFrame, schema: str, by: list[str]) -> DataFrame:
    """(keys, n, hash) of receipts (keys, seq, payload JSON); the receipts of one run or day make one bundle."""
    each = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    packed = receipts.groupBy(*by).agg(F.count("*").alias("n"), each.alias("r"))
    return packed.select(*by, "n", hashing.bundle_hash(schema, F.transform("r", lambda x: x["payload"])).alias("hash"))


def verify_bundles(receipts: DataFrame, sealed: DataFrame, schema: str, by: list[str]) -> DataFrame:
    """Problems of each bundle: a hash that differs, gaps in seq, or nothing."""
    now = evidence_bundles(receipts, schema, by).withColumnRenamed("hash", "now")
    order = receipts.groupBy(*by).agg((F.max("seq") - F.min("seq") + 1 != F.count("*")).alias("gap"))
    both = sealed.join(now, by, "left").join(order, by, "left")
    problems = F.concat_ws("; ", F.when(~F.col("hash").eqNullSafe(F.col("now")), "hash differs"), F.when(F.coalesce("gap", F.lit(True)), "receipts missing"))
    return both.select(*by, problems.alias("problems"))


def trimmed(c: Column, limit: int = 4096, mark: str = "\n[cut]") -> tuple[Column, Column]:
    """(text within the limit, whether it was cut)."""
    cut = F.length(c) > limit
    return F.when(cut, F.concat(F.substring(c, 1, limit - len(mark)), F.lit(mark))).otherwise(c), cut


def template_params(lines: list[str], limits: tuple[int, ...] = (40, 10, 10, 400, 300)) -> list[str]:
    """A message template's parameters, clipped to their lengths."""
    return [" ".join(s.split())[:n] for s, n in zip(lines, limits, strict=False)]
