"""Most frequent values in bounded memory: Misra-Gries summaries (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries that one merge takes.
FAN_IN = 64
_SCHEMA = "part bigint, item string, n bigint, err bigint"


def _reduce(items: pa.Table, k: int) -> tuple[pa.Table, int]:
    """Summary of at most k counters over item, n: the next-largest counter is subtracted from all larger ones."""
    t = items.group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])
    if t.num_rows <= k:
        return t, 0
    n = t["n"].to_numpy()
    cut = int(np.partition(n, len(n) - k - 1)[len(n) - k - 1])
    left = pc.subtract(t["n"], cut)
    return pa.table({"item": t["item"], "n": left}).filter(pc.greater(left, 0)), cut


def misra_gries(df: DataFrame, item: str, weight: str | None, k: int) -> DataFrame:
    """item, low, high of at most k items: the true weight of each lies in [low, high].

    Every item heavier than total / (k + 1) is among them, and high - low is no more than that. Null items and null,
    zero or negative weights count for nothing; an empty input gives an empty table. Each partition keeps k counters
    (weighted, a batch at a time); summaries merge in a tree of FAN_IN, so a merge holds FAN_IN * k rows at most.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(F.col(item).cast("string").alias("item"), w.cast("bigint").alias("n")).where("item IS NOT NULL AND n > 0")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept, err, waiting, n = None, 0, [], 0
        for b in batches:
            waiting.append(pa.Table.from_batches([b]).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"]))
            n += waiting[-1].num_rows
            if n > 8 * k + 50_000:
                kept, cut = _reduce(pa.concat_tables([*([kept] if kept is not None else []), *waiting]), k)
                err, waiting, n = err + cut, [], 0
        if waiting or kept is not None:
            kept, cut = _reduce(pa.concat_tables([*([kept] if kept is not None else []), *waiting]), k)
            part = TaskContext.get().partitionId()
            # the row without an item carries the error of a summary, also of one that lost all counters
            rows = kept.num_rows + 1
            out = pa.table({"part": pa.array([part] * rows, pa.int64()), "item": pa.array([None, *kept["item"].to_pylist()], pa.string()), "n": pa.array([0, *kept["n"].to_pylist()], pa.int64()), "err": pa.array([err + cut] * rows, pa.int64())})
            yield from out.to_batches()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        errs, counted = int(pdf.loc[pdf["item"].isna(), "err"].sum()), pdf[pdf["item"].notna()]
        kept, cut = _reduce(pa.table({"item": pa.array(counted["item"], pa.string()), "n": pa.array(counted["n"], pa.int64())}), k)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "item": [None, *kept["item"].to_pylist()], "n": [0, *kept["n"].to_pylist()], "err": errs + cut})

    parts = rows.mapInArrow(summarise, _SCHEMA)
    n = max(1, rows.rdd.getNumPartitions())
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % n).groupBy("part").applyInPandas(merge, _SCHEMA)
        if n == 1:
            break
    return parts.where("item IS NOT NULL").select("item", F.col("n").alias("low"), (F.col("n") + F.col("err")).alias("high"))


def frequent_items(df: DataFrame, item: str, weight: str, percent: int, slack: int = 10) -> DataFrame:
    """item, weight of the items with at least `percent` % of the summed weight of all rows (also those of null items).

    Candidates come from summaries of slack * 100 / percent counters; only these are then summed exactly.
    """
    k = slack * 100 // percent
    found = misra_gries(df, item, weight, k)
    total = df.agg(F.coalesce(F.sum(F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))), F.lit(0)).alias("total"))
    likely = found.crossJoin(F.broadcast(total)).where(F.col("high") * 100 >= F.col("total") * percent).select("item", "total")
    rows = df.select(F.col(item).cast("string").alias("item"), F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).alias("w"))
    exact = rows.join(F.broadcast(likely), "item").groupBy("item").agg(F.sum("w").alias("weight"), F.first("total").alias("total"))
    return exact.where(F.col("weight") * 100 >= F.col("total") * percent).select("item", "weight")
