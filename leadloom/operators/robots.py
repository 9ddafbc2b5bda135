"""Robots rules of many hosts: files parsed into rules, and paths met with them through an index of prefixes.

A rule can only match paths that start with its literal part, up to the first wildcard. Rules are keyed by host and
that part; a path is cut to the lengths of its host's keys only and meets the rules in an equi-join. Patterns with
wildcards are tried on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, pattern, allow) that hold for `agent`, from (host, body): its own group's, else those of *.

    Comments go; lines without a colon and other fields are passed over. Lines of agents in a row share what follows,
    groups that name an agent again add to it. Empty patterns allow everything and are left out. One file for each host.
    """
    lines = files.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "#.*$", ""))
    parts = F.split("line", ":", 2)
    read = lines.where(F.col("line").contains(":")).select("host", "n", F.lower(F.trim(parts[0])).alias("field"), F.trim(parts[1]).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("n")
    named = F.col("field") == "user-agent"
    starts = named & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    grouped = read.withColumn("starts", starts).withColumn("group", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where(named).select("host", "group", F.lower("value").alias("agent")).where(F.col("agent").isin(agent.lower(), "*")).distinct()
    best = F.min(F.col("agent") == "*").over(Window.partitionBy("host"))  # false as soon as a group names the agent
    agents = agents.withColumn("star", F.col("agent") == "*").withColumn("only_star", best).where("star = only_star").select("host", "group").distinct()
    rules = grouped.where(~named & (F.col("value") != "")).join(agents, ["host", "group"])
    return rules.select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")).distinct()


def allowed_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed) of each distinct path: the longest matching rule wins, an allowing one on ties; no rule allows.

    rules (host, pattern, allow); * stands for any run of characters, a final $ for the end of the path. Paths hold
    their query. Null hosts and paths are left out.
    """
    anchored = F.col("pattern").endswith("$")
    literal = F.regexp_extract("pattern", r"^([^*]*?)(?:\*|\$$|$)", 1)
    quoted = F.regexp_replace(F.when(anchored, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")), r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(anchored, r"\z").otherwise(""))
    index = rules.where("pattern <> ''").select("host", literal.alias("prefix"), "pattern", "allow", F.when(F.col("pattern").contains("*") | anchored, regex).alias("regex")).distinct()
    lengths = index.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # no more than a path is long
    given = paths.select("host", "path").where("host IS NOT NULL AND path IS NOT NULL").distinct()
    cut = given.join(lengths, "host").select("host", "path", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n"))
    met = cut.select("host", "path", F.expr("left(path, n)").alias("prefix")).join(index, ["host", "prefix"])
    hit = met.where(F.col("regex").isNull() | F.expr("rlike(path, regex)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("best"))
    return given.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))
