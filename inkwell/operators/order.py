"""Positions in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut


def with_positions(df: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """df with each row's position from 1 in a total order: range partitions, then the sizes of those before.

    Rows equal in the order get neighbouring positions. The driver sees one number a partition.
    """
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    before, n = [], 0
    for p, c in sizes:
        before.append((p, n))
        n += c
    starts = df.sparkSession.createDataFrame(before, "__p bigint, __n bigint")
    out = placed.withColumn("__p", part).join(F.broadcast(starts), "__p", "left")
    return out.withColumn(into, F.col("__n") + F.col("__at").bitwiseAND(2**33 - 1) + 1).drop("__at", "__p", "__n")


def cumulated(df: DataFrame, groups: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """df with upto, the weight (1 a row if none is named) of each row and those before it in its group, and total, that
    of the group.

    Rows are sorted into ranges by group and order, so no task has a whole group; a group's ranges are then added up, one
    row each. Rows equal in the order get neighbouring positions. Null groups are groups, null weights count 0.
    """
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    placed = cut(df.orderBy(*groups, *order).withColumns({"__bin": F.spark_partition_id(), "__w": w.cast("bigint"), "__i": F.monotonically_increasing_id()}), "sorted")
    sums = placed.groupBy(*groups, "__bin").agg(F.sum("__w").alias("__sum"))
    by_group = Window.partitionBy(*groups)
    so_far = F.sum("__sum").over(by_group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumns({"__before": F.coalesce(so_far, F.lit(0)), "total": F.sum("__sum").over(by_group)})
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bin").alias("__b"), "__before", "total")
    same = F.col("__bin") == F.col("__b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    run = placed.withColumn("__run", F.sum("__w").over(Window.partitionBy(*groups, "__bin").orderBy("__i")))
    return run.join(sums, same).select(*df.columns, (F.col("__run") + F.col("__before")).alias("upto"), "total")
