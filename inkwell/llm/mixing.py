"""Mixing sources to target weights by whole copies and Pareto order sampling (problem 9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import BYTE_BPE, TOKENIZERS, count_tokens
from inkwell.operators.skew import select_ranks
from inkwell.session import cut

#: Order-preserving whole numbers for ranking variables in (0, 1).
_STEPS = 2**52


def random_odds(key: str, seed: int) -> Column:
    """u in (0, 1) that depends on the key and the seed alone, so a recomputed task draws the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) + 0.5) / float(2**53)


@dataclass
class SourcePlan:
    """What a source gives to the mix: its wanted size, whole copies of all its rows, and the size drawn besides."""

    share: float
    repeats: int
    docs: int
    size: int
    wanted: float
    whole: int
    rest: int


def plan_mix(want: dict[str, tuple[float, int]], sums: dict[str, tuple[int, int]], total: float | None = None) -> dict[str, SourcePlan]:
    """Plan of every source that has rows, a share and repeats; shares are scaled to sum to 1 over these.

    want: share and most repeats; sums: rows and their size. Without a total the mix is as large as the scarcest source
    allows with all its repeats, so that every share is met. With one, a source that can't give its share even so gives
    all it may, and the report shows it below its target.
    """
    live = {s: want[s] for s in sums if s in want and want[s][0] > 0 and want[s][1] > 0}
    shares = sum(w[0] for w in live.values())
    if total is None:
        total = min((w[1] * sums[s][1] * shares / w[0] for s, w in live.items()), default=0.0)
    plan = {}
    for s, (share, repeats) in live.items():
        n, size = sums[s]
        wanted = min(share / shares * total, float(repeats * size))
        whole = min(repeats, int(wanted / size + 1e-12))
        plan[s] = SourcePlan(share, repeats, n, size, wanted, whole, round(wanted - whole * size) if whole < repeats else 0)
    return plan


def inclusion_scale(parts: list[tuple[float, float]], rest: float) -> float:
    """c for which rows of (weight, size) give `rest` when each is in with odds min(1, c * weight)."""
    low, high = 0.0, 1.0
    while sum(min(1.0, high * w) * s for w, s in parts) < rest and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, mid * w) * s for w, s in parts) < rest else (low, mid)
    return high


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", seed: int = 42, total: float | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix of sources: (key, source, size, copies) of all chosen rows, and the report of the sources.

    docs: unique key, source, size (bigint), weight (a positive number; the size if none is named). targets: source,
    target_share, max_repeats; one row a source. Sizes go by plan_mix(). Every row of a source gets the same whole number
    of copies, and the rest of the source's share is a Pareto sample of fixed size: a row's odds of inclusion are in
    proportion to its weight (1 where that would be more), rows stand in the order of their random odds divided by these,
    and are taken up to the size wanted. The last place goes to the row whose size comes nearest to what is missing, if
    any comes nearer than none.
    Rows of null or empty size or weight, of null sources and of sources without a target are in no mix; a target without
    rows, or with a share or repeats of null or 0, is reported with 0. Without usable rows the mix is empty.
    """
    spark = docs.sparkSession
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    weighed = F.col(weight or size).cast("double")
    known = docs.select(F.col(key), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"), weighed.alias("weight")).where((F.col("size") > 0) & (F.col("weight") > 0))
    # the targets are a fixed table of a row a source, read by the driver anyway
    goal = spark.createDataFrame([(s, *w) for s, w in want.items()], "source string, share double, repeats int")
    rows = known.join(F.broadcast(goal.select("source")), "source")
    # sizes by source and by weight in steps of a 16th of a doubling, at most some hundreds a source
    step = F.floor(F.log2("weight") * 16)
    binned = rows.groupBy("source", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.avg("weight").alias("weight")).collect()
    sums: dict[str, tuple[int, int]] = {}
    for r in binned:
        n, z = sums.get(r["source"], (0, 0))
        sums[r["source"]] = (n + r["n"], z + r["size"])
    plan = plan_mix(want, sums, total)
    scale = {s: inclusion_scale([(r["weight"], r["size"]) for r in binned if r["source"] == s], p.rest) for s, p in plan.items()}
    if not plan:
        chosen = rows.select(key, "source", "size", F.lit(0).alias("copies")).limit(0)
    else:
        shape = "source string, whole int, rest bigint, scale double"
        planned = spark.createDataFrame([(s, p.whole, p.rest, scale[s]) for s, p in plan.items()], shape)
        drawn = rows.join(F.broadcast(planned), "source").withColumn("u", random_odds(key, seed)).withColumn("odds", F.least(F.lit(1.0), F.col("scale") * F.col("weight")))
        ratio = F.when(F.col("odds") < 1, (F.col("u") / (1 - F.col("u"))) / (F.col("odds") / (1 - F.col("odds")))).otherwise(0.0)
        drawn = drawn.withColumn("q", F.floor(ratio / (1 + ratio) * _STEPS).cast("bigint")).select(key, "source", "size", "whole", "rest", "q")
        wanted = spark.createDataFrame([(s, 0, p.rest) for s, p in plan.items() if p.rest > 0], "source string, rank_id int, rank bigint")
        last = {r["source"]: r["value"] for r in select_ranks(drawn.select("source", "q", "size"), wanted, ["source"], "q", "size").collect()}
        border = spark.createDataFrame(list(last.items()), "source string, last bigint")
        placed = drawn.join(F.broadcast(border), "source", "left")
        below = {r["source"]: r["below"] for r in placed.where("q < last").groupBy("source").agg(F.sum("size").alias("below")).collect()}
        gap = spark.createDataFrame([(s, plan[s].rest - below.get(s, 0)) for s in last], "source string, gap bigint")
        off = F.abs(F.col("size") - F.col("gap"))
        nearest = placed.where("q >= last").join(F.broadcast(gap), "source").where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", F.col(key).alias("k"))).alias("m")).select("source", F.col("m.k").alias("final"))
        # one key a source
        final = F.broadcast(nearest)
        extra = F.when((F.col("q") < F.col("last")) | (F.col(key) == F.col("final")), 1).otherwise(0)
        chosen = placed.join(final, "source", "left").withColumn("copies", F.col("whole") + extra).where("copies > 0").select(key, "source", "size", "copies")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("size") * F.col("copies")).alias("mix_size"), F.max("copies").alias("most_copies"))
    have = spark.createDataFrame([(s, *v) for s, v in sums.items()], "source string, docs bigint, size bigint")
    report = goal.join(F.broadcast(have), "source", "left").join(F.broadcast(used), "source", "left").fillna(0, ["docs", "size", "docs_used", "mix_size", "most_copies"])
    all_ = used.agg(F.sum("mix_size").alias("all"))
    report = report.crossJoin(F.broadcast(all_)).select("source", "share", "repeats", "docs", "size", "docs_used", "mix_size", "most_copies", F.coalesce(F.try_divide("mix_size", "all"), F.lit(0.0)).alias("actual_share"))
    return chosen, report


def mix_plan(docs: DataFrame, targets: DataFrame, source: str, size: str, total: float | None = None) -> DataFrame:
    """source, docs, size, whole, rest of each source in the mix: the plan that mix() draws by."""
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect() if r["source"] is not None}
    known = docs.select(F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where("source IS NOT NULL AND size > 0")
    sums = {r["source"]: (r["n"], r["size"]) for r in known.where(F.col("source").isin(list(want))).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    plan = plan_mix(want, sums, total)
    return docs.sparkSession.createDataFrame([(s, p.docs, p.size, p.whole, p.rest) for s, p in plan.items()], "source string, docs bigint, size bigint, whole int, rest bigint")


def mix_documents(documents: DataFrame, targets: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}", seed: int = 42, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """mix() of documents by the tokens of a public tokenizer; only texts of sources with a target are counted."""
    sources = [r["source"] for r in targets.select("source").where("source IS NOT NULL").distinct().collect()]
    docs = documents.select("doc_id", "source", "text").where(F.col("source").isin(sources))
    sized = cut(count_tokens(docs, "text", path), "sized")
    return mix(sized, targets, seed=seed, total=total)
