"""Per-key results under skew: hot keys, salted joins and exact ranks by refined histograms.

Nothing here gathers the values of a hot key. A key counts as hot by its share of the rows, so there are at most
1/share of them whatever the data, and only such lists are broadcast without a further check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import BROADCAST_ROWS, cut, drop_cut

#: Values of one group that a single task may sort to finish a rank exactly.
LEAF_ROWS = 65_536
#: Bits that one histogram round resolves: 4,096 counters for each open prefix.
DIGIT = 12


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.005) -> DataFrame:
    """Key values with more than `share` of df's rows, at most 1/share of them; null keys are left out.

    Counts are combined before the shuffle, so the hottest key costs one partial count a task. Nothing runs before the
    result is used.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).where(F.col("__n") > share * total).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "left", salts: int = 32, spread: Column | None = None) -> DataFrame:
    """Equi-join whose hot left keys are spread over `salts` tasks; right has few rows a key, its hot ones are repeated.

    hot: at most 1/share rows (hot_keys). spread: what chooses the salt, by default a hash of all left columns; rows
    equal in it stay together. Null keys of left match nothing and are spread like hot ones. how: inner or left.
    """
    hot = F.broadcast(hot.select(*keys).distinct().withColumn("__hot", F.lit(True)))
    number = F.pmod(F.xxhash64(*left.columns) if spread is None else spread, F.lit(salts)).cast("int")
    null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    one = left.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot") | null, number).otherwise(0)).drop("__hot")
    many = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return one.join(many, [*keys, "__salt"], how).drop("__salt")


def _matched(rows: DataFrame, small: DataFrame, on: list[str], n: int, salts: int = 64) -> DataFrame:
    """Inner join with a table of n rows, one for each value of `on`: broadcast while n is small, else salted by x."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


def select_ranks(rows: DataFrame, ranks: DataFrame, groups: list[str], value: str, weight: str | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Exact order statistics of each group: the least value whose cumulated weight reaches a rank.

    rows: groups, value (bigint), weight (bigint, 1 if not given); null groups and values, and weights under 1, are
    left out. ranks: groups, rank_id, rank (from 1). Group columns can't be named x, v, w, prefix, digit or left; other
    columns of either table don't matter. Returns groups, rank_id, value; ranks beyond a group's weight and
    ranks of groups without rows give no row; an empty input gives an empty table. Repeated values count repeatedly.

    Each round counts, for every still open prefix of the values' bits, the weight at each next digit; such counts
    merge before the shuffle, so a group with all rows costs its counters, not its rows. A rank is settled when its
    prefix holds one value; prefixes down to `leaf_rows` values are finished by a sort of just those.
    """
    g = [F.col(c) for c in groups]
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    base = rows.select(*g, F.col(value).cast("bigint").alias("v"), w.alias("w")).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*groups, "v"]]) & (F.col("w") > 0))
    lo, hi = base.agg(F.min("v"), F.max("v")).first()
    spark = rows.sparkSession
    if lo is None:
        return ranks.select(*groups, "rank_id", F.lit(None).cast("bigint").alias("value")).limit(0)
    if hi - lo >= 2**63:
        raise ValueError("values span more than 63 bits; drop the lowest bit first")
    base = base.select(*g, (F.col("v") - F.lit(lo)).alias("x"), "w")
    bits = max(1, (hi - lo).bit_length())
    open_ = cut(ranks.select(*groups, "rank_id", F.col("rank").cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("prefix")), "ranks")
    done: list[DataFrame] = []
    shift = bits
    while True:
        n = open_.select(*groups, "prefix").distinct().count()
        if not n:
            break
        down = min(DIGIT, shift)
        prefixes = open_.select(*groups, "prefix").distinct()
        shift -= down
        inside = base.withColumn("prefix", F.shiftright("x", shift + down) if shift + down < 63 else F.lit(0).cast("bigint"))
        counts = (
            _matched(inside, prefixes, [*groups, "prefix"], n)
            .groupBy(*groups, "prefix", F.shiftright("x", shift).alias("digit"))
            .agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        )
        run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*groups, "prefix").orderBy("digit")))
        hit = open_.join(run, [*groups, "prefix"]).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        step = cut(hit.select(*groups, "rank_id", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("digit").alias("prefix"), "c", "a", "b"), "ranks")
        drop_cut(open_)
        done.append(step.where("a = b").select(*groups, "rank_id", F.col("a").alias("x")))
        rest = step.where("a < b")
        small = rest.where(F.col("c") <= leaf_rows)
        m = small.select(*groups, "prefix").distinct().count()
        if m:
            here = base.withColumn("prefix", F.shiftright("x", shift))
            few = _matched(here, small.select(*groups, "prefix").distinct(), [*groups, "prefix"], m).groupBy(*groups, "prefix", "x").agg(F.sum("w").alias("n"))
            run = few.withColumn("upto", F.sum("n").over(Window.partitionBy(*groups, "prefix").orderBy("x")))
            done.append(small.join(run, [*groups, "prefix"]).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left"))).select(*groups, "rank_id", "x"))
        open_ = rest.where(F.col("c") > leaf_rows).select(*groups, "rank_id", "left", "prefix")
    out = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], open_.select(*groups, "rank_id", F.col("left").alias("x")).schema)
    return out.select(*groups, "rank_id", (F.col("x") + F.lit(lo)).alias("value"))


def frequent_keys(rows: DataFrame, group: str, key: str, share_in: int = 50) -> DataFrame:
    """Keys standing in at least 1/share_in of all rows of their group (null keys count as rows but aren't keys).

    The keys' hashes are the values of the rank selection. A key with so many rows covers that many neighbouring
    ranks, so it must stand at one of the ranks s, 2s, 3s ... with s = rows/share_in; the at most share_in + 1 hashes
    found there are then counted exactly. Returns group, key, n_rows; an empty table gives none; ties at the limit are in.
    """
    hashed = rows.select(F.col(group).alias("grp"), F.col(key).cast("string").alias("key")).withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 1))
    sizes = rows.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n_all"), F.count(key).alias("n_keys"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_all") / share_in)).cast("bigint")
    at = sizes.where("n_keys > 0").select("grp", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("n_keys") / step).cast("bigint"))).alias("rank_id"), step.alias("s"))
    ranks = at.select("grp", "rank_id", (F.col("rank_id") * F.col("s")).alias("rank"))
    found = select_ranks(hashed.where(F.col("key").isNotNull()), ranks, ["grp"], "h").select("grp", F.col("value").alias("h")).distinct()
    exact = hashed.where(F.col("key").isNotNull()).join(F.broadcast(found), ["grp", "h"]).groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.join(F.broadcast(sizes), "grp").where(F.col("n_rows") * share_in >= F.col("n_all")).select(F.col("grp").alias(group), F.col("key").alias(key), "n_rows")


def key_quantiles(rows: DataFrame, key: str, value: str, percents: list[int], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows, non-null values and exact nearest-rank quantiles of a bigint value for every key, hot or not.

    Returns key, n_rows, n_values, p<percent>...; the quantile is the value at rank ceil(percent * n / 100). A key with
    only null values has null quantiles; null keys give no row. Keys with more than leaf_rows values go through
    select_ranks (never more than rows/leaf_rows of them), all others are sorted within their key.
    """
    base = rows.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")).where(F.col("k").isNotNull())
    sizes = cut(base.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n")), "sizes")
    big = sizes.where(F.col("n") > leaf_rows)
    n_big = big.count()
    pairs = base.where(F.col("v").isNotNull())
    names = [f"p{p}" for p in percents]
    at = lambda p, n: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col(n) / 100)).cast("bigint")
    tail = pairs
    heavy = None
    if n_big:
        if n_big <= BROADCAST_ROWS:
            keys = F.broadcast(big.select("k"))
            tail, top = pairs.join(keys, "k", "left_anti"), pairs.join(keys, "k", "left_semi")
        else:
            marked = _matched(pairs.withColumn("x", F.col("v")), big.select("k"), ["k"], n_big)
            top = marked.drop("x")
            tail = salted_join(pairs, sizes.select("k", "n"), ["k"], hot_keys(pairs, ["k"])).where(F.col("n") <= leaf_rows).drop("n")
        ranks = big.select("k", F.explode(F.array(*[F.struct(F.lit(p).alias("rank_id"), at(p, "n").alias("rank")) for p in percents])).alias("r")).select("k", "r.*")
        heavy = select_ranks(top, ranks, ["k"], "v", leaf_rows=leaf_rows)
        heavy = heavy.groupBy("k").agg(*[F.max(F.when(F.col("rank_id") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    per = tail.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    run = per.withColumns({"upto": F.sum("c").over(Window.partitionBy("k").orderBy("v")), "n": F.sum("c").over(Window.partitionBy("k"))})
    light = run.groupBy("k").agg(*[F.min(F.when(F.col("upto") >= at(p, "n"), F.col("v"))).alias(f"p{p}") for p in percents])
    quantiles = light.unionByName(heavy) if heavy is not None else light
    return sizes.join(quantiles, "k", "left").select(F.col("k").alias(key), "n_rows", F.col("n").alias("n_values"), *names)
