"""One ranking from several scores: Borda count over ranks, so that no score counts by its range (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.order import cumulated, with_positions
from inkwell.operators.skew import salted_join
from inkwell.session import cut


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and columns of each key's row with the greatest `order`; among equals the greatest values; null keys dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m")).select(key, *[F.col("m")[c].alias(c) for c in columns])


def score_ranks(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """key, score, greater, ties, present for every present score of every key (keys are unique).

    greater: keys with a strictly greater score; ties: keys with the same one, itself included; present: keys having
    the score. NaN counts as missing. Ranks are counted over distinct values, sorted into as many value ranges as their
    number asks for: a value of a third of all rows is one of them, and no task has a whole column.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores])).alias("x")).select(key, "x.*")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = cut(long.groupBy("score", "value").agg(F.count(F.lit(1)).alias("ties")), "counts")
    ranked = cumulated(counts, ["score"], [F.desc("value")], "ties").select("score", "value", (F.col("upto") - F.col("ties")).alias("greater"), "ties", F.col("total").alias("present"))
    long_rows = counts.agg(F.sum("ties")).first()[0] or 0
    hot = counts.where(F.col("ties") > 0.001 * long_rows).select("score", "value")
    return salted_join(long, ranked, ["score", "value"], hot, "inner").select(key, "score", "greater", "ties", "present")


def borda(df: DataFrame, key: str, scores: dict[str, float]) -> DataFrame:
    """key, points, rank: weighted Borda points of unique keys and their position from 1, ties by the smaller key.

    Each score gives (present - averaged rank + 1/2) / present points, so between 0 and 1 whatever its scale; a missing
    score gives the mid-rank's half point. Equal scores share the mean of their competition ranks. An empty table
    gives an empty ranking.
    """
    weights = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    average = F.col("greater") + (F.col("ties") + 1) / 2
    part = (F.col("present") - average + 0.5) / F.col("present") - 0.5
    extra = score_ranks(df, key, list(scores)).groupBy(key).agg(F.sum(weights[F.col("score")] * part).alias("extra"))
    points = F.round(F.lit(sum(scores.values()) / 2) + F.coalesce("extra", F.lit(0.0)), 9)
    return with_positions(df.select(key).join(extra, key, "left").select(key, points.alias("points")), [F.desc("points"), F.asc(key)])
