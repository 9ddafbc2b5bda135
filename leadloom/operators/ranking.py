"""Ranking with diversity, quotas, caps and labels, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import ordinals


def diversified(leads: DataFrame, score: str = "score", group: str = "segment", tie: str = "id") -> DataFrame:
    """Adds turn: a lead's place in its group. Ordered by score, turn and tie, equal scores take turns between groups.

    Groups are few and hold the whole register, so places are counted over ranges of the order and no task holds a group.
    """
    return ordinals(leads, [F.desc(score), F.asc(tie)], "turn", [group])


def diversified_few(leads: DataFrame, score: str = "score", group: str = "segment", tie: str = "id") -> DataFrame:
    """diversified() of a list that a limit has bounded: one window."""
    return leads.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))


def diversified_order(score: str = "score", tie: str = "id") -> list[Column]:
    return [F.desc(score), F.col("turn"), F.col(tie)]


def capped(leads: DataFrame, limit: int, share: float = 0.2, score: str = "score", group: str = "segment", source: str = "source", tie: str = "id") -> DataFrame:
    """At most `limit` leads: each source's best `limit` * share by score, the rest in diversified order; of more reserved
    ones than `limit` the first in diversified order.

    Only the first rows of each source and group are looked at, limited in every task before a shuffle: a lead
    beyond the first `limit` of its group comes after `limit` others.
    """
    reserved = top_per(leads, [source], [F.desc(score), tie], int(limit * share), "__own").drop("__own")
    best = top_per(leads, [group], [F.desc(score), tie], limit, "turn").join(reserved.select(tie), tie, "left_anti")
    both = reserved.withColumn("turn", F.lit(0)).withColumn("__late", F.lit(0)).unionByName(best.withColumn("__late", F.lit(1)))
    fill = both.orderBy("__late", *diversified_order(score, tie)).limit(limit).where("__late = 1")
    chosen = reserved.unionByName(fill.select(*leads.columns))
    return diversified_few(chosen, score, group, tie).orderBy(*diversified_order(score, tie)).limit(limit).drop("turn")


def top_per(rows: DataFrame, by: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    """The first k rows of every group; Spark limits each task's rows before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def first_per(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return top_per(rows, by, order, 1, "__first").drop("__first")


def section_labels(rows: DataFrame, prefixes: dict[str, str], caps: dict[str, int], kind: str = "kind", score: str = "score", tie: str = "id") -> DataFrame:
    """Label R1, L1, G1 ... of the shown leads of each section."""
    letter = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])[F.col(kind)]
    placed, cap = _shown(rows.where(F.col(kind).isin(*prefixes)), caps, kind, score, tie)
    return placed.where(F.col("place") <= cap).withColumn("label", F.concat(letter, F.col("place").cast("string")))


def _shown(rows: DataFrame, caps: dict[str, int], kind: str, score: str, tie: str) -> tuple[DataFrame, Column]:
    """The first rows of each kind, no more than the largest cap, limited in every task before the shuffle; and each row's cap."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(kind)]
    return top_per(rows, [kind], [F.desc(score), tie], max(caps.values(), default=0)), cap


def cutoffs(rows: DataFrame, caps: dict[str, int], kind: str = "kind", score: str = "score", tie: str = "id") -> DataFrame:
    """The score of the last shown lead of each section; 0 where the section is not full."""
    placed, cap = _shown(rows.where(F.col(kind).isin(*caps)), caps, kind, score, tie)
    return placed.groupBy(kind).agg(F.coalesce(F.max(F.when(F.col("place") == cap, F.col(score))), F.lit(0)).alias("cutoff"))


def top_with_rest(counts: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """The k largest counts and one row '+m more' for the others: a limit, and an aggregate of what it leaves."""
    shown = counts.orderBy(F.desc(n), key).limit(k).select(key, n)
    sums = lambda df, sign: df.agg(F.count("*").alias("m"), F.coalesce(F.sum(n), F.lit(0)).alias("s")).select((F.col("m") * sign).alias("m"), (F.col("s") * sign).alias("s"))
    rest = sums(counts, 1).unionByName(sums(shown, -1)).agg(F.sum("m").alias("m"), F.sum("s").alias(n)).where("m > 0")
    return shown.unionByName(rest.select(F.concat(F.lit("+"), F.col("m").cast("string"), F.lit(" more")).alias(key), n))


def signals(leads: DataFrame, limit: int, wrapped: Column, score: str = "score", tier: str = "tier", tie: str = "id") -> DataFrame:
    """Signals in the order they are read, as rows with place: the first `limit` requirement candidates, direct links before wrapped ones, then all others."""
    order = [F.col("__wrapped"), F.desc(score), F.col(tie)]
    marked = leads.withColumn("__wrapped", wrapped.cast("int"))
    first = marked.where(F.col(tier) == "requirement_candidate").orderBy(*order).limit(limit)
    rest = marked.where(F.col(tier).isNull() | (F.col(tier) != "requirement_candidate"))
    placed = first.withColumn("__tier", F.lit(0)).unionByName(rest.withColumn("__tier", F.lit(1)))
    return placed.orderBy("__tier", *order).drop("__tier", "__wrapped")
