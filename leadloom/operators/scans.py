"""Running sums and ranks over an order too long for one task: range partitions, totals of the parts, offsets.

A window over one huge group sorts it in a single task. Here the rows are dealt by ranges of their order, each part is
summed by itself, and every part is shifted by the totals of those before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import free_names
from ..session import materialize


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], group: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds each of `sums` as the sum over the rows up to and including this one, in `order` within `group`.

    The order must tell rows apart where their places matter: rows equal in it stand in any order. Nulls in `group`
    are a group. Null summands count as 0, as in any sum. Existing columns of the names in `sums` are replaced. A group of any size is spread over the parts; the table
    is written once. What is broadcast is at most one row for each part, as only the first group of a part can have
    begun in an earlier one.
    """
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keep = [c for c in df.columns if c.lower() not in {s.lower() for s in sums}]
    taken = [*df.columns, *sums]
    part, *rest = free_names(taken, "part", *(f"add_{i}" for i in range(len(sums))), *(f"key_{i}" for i in range(len(order))), *(f"offset_{i}" for i in range(len(sums))))
    adds, keys, offsets = rest[: len(sums)], rest[len(sums) : len(sums) + len(order)], rest[len(sums) + len(order) :]
    placed = df.select("*", *(F.coalesce(c, F.lit(0)).alias(a) for c, a in zip(sums.values(), adds, strict=True)))
    ranges = [*(F.col(g) for g in group), *order]
    placed = materialize(placed.repartitionByRange(parts, *ranges).withColumn(part, F.spark_partition_id()), "placed")

    totals = placed.groupBy(*group, part).agg(*(F.sum(a).alias(a) for a in adds))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*(F.col(g).alias(k) for g, k in zip(group, free_names([*taken, part, *rest], *(f"group_{i}" for i in range(len(group)))), strict=True)), F.col(part).alias(keys[0]), *(F.sum(a).over(before).alias(o) for a, o in zip(adds, offsets, strict=True)))
    shift = shift.where(F.col(offsets[0]).isNotNull())
    same = F.col(part) == F.col(keys[0])
    for g, k in zip(group, shift.columns, strict=False):
        same &= F.col(g).eqNullSafe(F.col(k))
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("*", *(F.sum(a).over(within).alias(f"{o}_") for a, o in zip(adds, offsets, strict=True)))
    out = placed.join(F.broadcast(shift), same, "left")
    return out.select(*keep, *((F.col(f"{o}_") + F.coalesce(o, F.lit(0))).alias(name) for name, o in zip(sums, offsets, strict=True)))


def ordinals(df: DataFrame, order: Sequence[Column], name: str = "place", group: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds `name`: the place of each row, from 1, in `order` within `group`, like row_number() without its one task."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, group, parts)
