"""Validation and experiment statistics: coverage, distributions, latencies, recall and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.scoring import change, change_kind, percent, ratio
from inkwell.operators.order import cumulated, with_positions
from inkwell.session import cut


def coverage(df: DataFrame, signals: list[str]) -> DataFrame:
    """Rows, rows with each signal above 0, with the first two, and their percentages, in one pass."""
    has = {s: F.coalesce(F.col(s) > 0, F.lit(False)) for s in signals}
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"with_{s}") for s, c in has.items()], F.count_if(has[signals[0]] & has[signals[1]]).alias("with_both"))
    either = F.col(f"with_{signals[0]}") + F.col(f"with_{signals[1]}") - F.col("with_both")
    row = row.withColumns({f"{s}_pct": F.round(percent(F.col(f"with_{s}"), F.col("total")), 6) for s in signals} | {"either_pct": F.round(percent(either, F.col("total")), 6)})
    mean = sum((F.col(f"{s}_pct") for s in signals[1:]), F.col(f"{signals[0]}_pct")) / len(signals)
    return row.withColumn("completeness", F.round(mean, 6)).withColumn("verdict", F.when(F.col("completeness") >= 90, "good").when(F.col("completeness") >= 70, "fair").otherwise("poor"))


def buckets(df: DataFrame, column: str) -> DataFrame:
    """Rows with 0, 1-10, 11-100, 101-1000 and more; null counts as 0."""
    x = F.coalesce(F.col(column), F.lit(0))
    return df.agg(
        F.count_if(x == 0).alias("zero"), F.count_if(x.between(1, 10)).alias("to_10"), F.count_if(x.between(11, 100)).alias("to_100"),
        F.count_if(x.between(101, 1000)).alias("to_1000"), F.count_if(x > 1000).alias("more"), F.count(F.lit(1)).alias("total"),
    )


def signal_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both signals, with either alone, with none."""
    x, y = F.coalesce(F.col(a), F.lit(0)) > 0, F.coalesce(F.col(b), F.lit(0)) > 0
    return df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))


def positive_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, extremes and sum over positive values; null without any."""
    return df.where(F.col(column) > 0).agg(F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("most"), F.min(column).alias("least"), F.sum(column).alias("total"))


def correlation(df: DataFrame, a: str, b: str, least_rows: int = 100) -> DataFrame:
    """Correlation of two positive signals with its verdict; null with least_rows rows or fewer."""
    row = df.where((F.col(a) > 0) & (F.col(b) > 0)).agg(F.count(F.lit(1)).alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
    r = F.when(F.col("n") > least_rows, F.round("r", 6))
    return row.select("n", r.alias("r")).withColumn("verdict", F.when(F.col("r") > 0.8, "strong").when(F.col("r") > 0.6, "moderate").when(F.col("r").isNotNull(), "weak").otherwise("none"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys standing more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by the value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """p50, p95, p99 as the sorted values' elements at int(n * p), with extremes and rate, by group.

    Ranks come from counts of distinct values in ranges; no task sees the values of a whole group.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    run = cumulated(per, [group], [F.asc(value)], "c")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(p)), F.col(value)))
    return run.groupBy(group).agg(F.max("total").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def linear_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and interpolated percentiles by group, from counts of distinct values in ranges; groups without a
    value have nulls."""
    percents = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    per = df.groupBy(group, value).agg(F.count(value).alias("c"))
    run = cumulated(per, [group], [F.asc_nulls_first(value)], "c")
    place = {n: (F.col("total") - 1) * F.lit(p) for n, p in percents.items()}
    ends = [F.min(F.when(F.col("upto") > (F.floor(x) if low else F.ceil(x)), F.col(value))).alias(f"{n}_{'lo' if low else 'hi'}") for n, x in place.items() for low in (True, False)]
    found = run.groupBy(group).agg(F.max("total").alias("total"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"), *ends)
    return found.select(group, "mean", *[F.round(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (x - F.floor(x)), 6).alias(n) for n, x in place.items()])


def throughput(df: DataFrame, group: str, ms: str, ok: str | None = None) -> DataFrame:
    """Requests, total seconds, rate and success rate by group; 0 for an empty total."""
    good = F.count_if(F.col(ok)) if ok else F.count(F.lit(1))
    row = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.sum(ms) / 1000).alias("total_s"), good.alias("good"))
    return row.withColumns({"qps": F.when(F.col("total_s") > 0, F.col("n") / F.col("total_s")).otherwise(0.0), "success_rate": percent(F.col("good"), F.col("n"))})


def halves(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Mean of the first and the second half of each group in an order."""
    rows = cumulated(df, [group], order)
    early = F.col("upto") <= F.floor(F.col("total") / 2)
    return rows.groupBy(group).agg(F.round(F.avg(F.when(early, F.col(value))), 6).alias("first_half"), F.round(F.avg(F.when(~early, F.col(value))), 6).alias("second_half"))


def cache_effect(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """The first value of each group in an order, the mean of the later ones, and first / later; null without
    later ones, 0 where these are 0."""
    first = F.col("upto") == 1
    out = cumulated(df, [group], order).groupBy(group).agg(F.max(F.when(first, F.col(value))).alias("a"), F.avg(F.when(~first, F.col(value))).alias("b"))
    return out.select(group, F.round("a", 6).alias("first"), F.round("b", 6).alias("later"), F.round(ratio(F.col("a"), F.col("b")), 6).alias("speedup"))


def category_status(df: DataFrame, category: str, passed: str, recall: str | None = None, least: float = 70.0) -> DataFrame:
    """Tests, passes, rate, mean recall and PASS from `least` percent on."""
    extra = [F.round(F.avg(recall), 6).alias("mean_recall")] if recall else []
    row = df.groupBy(category).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col(passed)).alias("passes"), *extra)
    rate = percent(F.col("passes"), F.col("tests"))
    return row.withColumn("pass_rate", F.round(rate, 6)).withColumn("status", F.when(F.col("pass_rate") >= least, "PASS").otherwise("FAIL"))


def histogram(df: DataFrame, score: str, width: int = 10) -> DataFrame:
    """A24."""
    return df.where(F.col(score).isNotNull()).groupBy((F.floor(F.col(score) / width) * width).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Rank and the gap to the next lower score within a group.

    Neighbours meet by their rank, so no task sees a whole group.
    """
    rows = cut(cumulated(df.select(group, key, score), [group], [F.desc(score), F.asc(key)]).withColumn("rank", F.col("upto").cast("int")).drop("upto", "total"), "ranks")
    after = rows.select(F.col(group).alias("__g"), (F.col("rank") - 1).alias("__r"), F.col(score).alias("__next"))
    near = rows.join(after, F.col(group).eqNullSafe(F.col("__g")) & (F.col("rank") == F.col("__r")), "left")
    return near.select(group, key, score, "rank", F.round(F.col(score) - F.col("__next"), 6).alias("gap"))


def score_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """Count, extremes, mean and range of scores by group."""
    row = df.groupBy(group).agg(F.count(score).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.round(F.avg(score), 6).alias("mean"))
    return row.withColumn("range", F.round(F.col("most") - F.col("least"), 6))


def position_variance(df: DataFrame, position: str, value: str) -> DataFrame:
    """Sample variance of positions whose values differ between runs."""
    return df.groupBy(position).agg(F.round(F.var_samp(value), 6).alias("variance"), F.countDistinct(value).alias("values")).where("values > 1")


def identical_runs(df: DataFrame, run: str, position: str, item: str) -> DataFrame:
    """Whether all runs list the same items in the same order (lists as long as a result page)."""
    lists = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(position, item))).alias("l"))
    return lists.agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("l").alias("orders")).select("runs", (F.col("orders") <= 1).alias("same"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in both tables, only in the first, only in the second."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full")
    return both.select(key, F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both").alias("side"))


def connectivity(edges: DataFrame, members: DataFrame, group: str, key: str = "id") -> DataFrame:
    """By group, distinct directed edges between two of its members over n(n-1)."""
    m = members.select(group, key).distinct()
    a, b = m.select(F.col(group).alias("g"), F.col(key).alias("source")), m.select(F.col(group).alias("g2"), F.col(key).alias("target"))
    inside = edges.select("source", "target").distinct().where("source <> target").join(a, "source").join(b, "target").where("g = g2").groupBy("g").agg(F.count(F.lit(1)).alias("found"))
    sizes = m.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.join(inside, "g", "left").select("g", "n", F.coalesce("found", F.lit(0)).alias("found"))
    ratio = F.when(F.col("n") > 1, F.col("found") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return row.select(F.col("g").alias(group), "n", "found", F.round(ratio, 6).alias("connectivity"))


def substring_recall(results: DataFrame, expected: DataFrame) -> DataFrame:
    """By query, the share of expected strings that stand in some result title, ignoring case.

    results: query, title (a result page for each query). expected: query, wanted. A query is a success above 0.
    """
    titles = results.groupBy("query").agg(F.collect_list(F.lower("title")).alias("titles"))
    hit = F.coalesce(F.exists("titles", lambda t: t.contains(F.lower("wanted"))), F.lit(False))
    row = expected.join(titles, "query", "left").groupBy("query").agg(F.round(F.avg(hit.cast("double")), 6).alias("recall"))
    return row.withColumn("success", F.col("recall") > 0)


def compare_runs(new: DataFrame, old: DataFrame, name: str, values: dict[str, bool]) -> DataFrame:
    """Each benchmark of the new run with its change against the old one; values: column -> lower is better."""
    before = old.select(name, *[F.col(v).alias(f"old_{v}") for v in values])
    out = new.join(before, name, "left")
    for v, lower in values.items():
        out = out.withColumns({f"{v}_change": F.round(change(F.col(v), F.col(f"old_{v}")), 6), f"{v}_kind": change_kind(F.col(v), F.col(f"old_{v}"), lower)})
    return out


def length_rank(df: DataFrame, key: str, length: str) -> DataFrame:
    """Key, length and rank by length of every row, longest first, ties by the key; null lengths come last."""
    return with_positions(df.select(key, length), [F.desc_nulls_last(length), F.asc(key)])


def import_complete(imported: int, estimated: int) -> str:
    """E16."""
    return "complete" if imported >= 0.9 * estimated else "incomplete"


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """T5: n rows in random order, the same for a seed however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def last_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """T7."""
    return df.orderBy(F.desc(key)).limit(n)


def hit_rate(results: DataFrame, expected: DataFrame, group: str, top: int) -> DataFrame:
    """By group, the share of queries with an expected title among their first results, ignoring case.

    results: query, rank, title. expected: group, query, wanted. Queries without results are misses.
    """
    best = results.where(F.col("rank") <= top).select("query", F.lower("title").alias("t"))
    hits = expected.join(best, "query", "left").withColumn("hit", F.coalesce(F.col("t").contains(F.lower("wanted")), F.lit(False)))
    per = hits.groupBy(group, "query").agg(F.bool_or("hit").alias("hit"))
    return per.groupBy(group).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate"))


def quality_verdict(kind: Column, value: Column) -> Column:
    """Clustering is good above 0.7, disambiguation above 0.8, anything else above 0."""
    return F.when(kind == "clustering", value > 0.7).when(kind == "disambiguation", value > 0.8).otherwise(value > 0)


def query_type_benchmarks(df: DataFrame, name: str = "name", fallback: int = 4) -> DataFrame:
    """The benchmarks by query type, or the first few by name if there are none."""
    kinds = df.where(F.col(name).contains("Query Type"))
    return kinds if kinds.limit(1).count() else df.orderBy(name).limit(fallback)


def run_summary(results: DataFrame, success: str, recall: str) -> DataFrame:
    """One row with the totals of a run and its verdict: working above 5 passes, partial above 2."""
    row = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(success)).alias("passed"), F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("failed"), F.round(F.avg(recall), 6).alias("recall"))
    return row.withColumn("verdict", F.when(F.col("passed") > 5, "working").when(F.col("passed") > 2, "partial").otherwise("failing"))


def analogies(neighbours: DataFrame, tuples: DataFrame) -> DataFrame:
    """Of every tuple (c, d) whether d is among the neighbours (c, d) of c; as in the reference, a and b don't count."""
    near = neighbours.select("c", "d").distinct().withColumn("__hit", F.lit(True))
    return tuples.join(near, ["c", "d"], "left").select("c", "d", F.coalesce("__hit", F.lit(False)).alias("success"))


def validate_signals(df: DataFrame, signals: list[str], key: str, least: float = 50.0) -> DataFrame:
    """Name, value, passed of the checks of an enriched table, in one pass: it has rows, no key twice, and each
    signal is above 0 in at least `least` percent of them."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), *[F.count_if(F.col(s) > 0).alias(s) for s in signals])
    checks = [("rows", F.col("n").cast("double"), F.col("n") > 0), ("duplicates", (F.col("n") - F.col("keys")).cast("double"), F.col("n") == F.col("keys"))]
    checks += [(s, F.round(percent(F.col(s), F.col("n")), 6).cast("double"), percent(F.col(s), F.col("n")) >= least) for s in signals]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), p.alias("passed")) for n, v, p in checks])).alias("x")).select("x.*")


def top_overlap(df: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """How many of the n rows greatest in a are among the n greatest in b, ties by the key, with a verdict."""
    first, second = (df.orderBy(F.desc_nulls_last(c), key).limit(n).select(key) for c in (a, b))
    row = first.join(second, key).agg(F.count(F.lit(1)).alias("shared")).withColumn("share", F.round(F.col("shared") * 100.0 / n, 6))
    return row.withColumn("verdict", F.when(F.col("share") >= 50, "length tells importance").otherwise("length is no importance"))


def exists_in(sample: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """One row asked, found: the rows of a sample, and those whose key stands in another table."""
    marked = sample.select(key).join(there.select(key).distinct().withColumn("__there", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("asked"), F.count("__there").alias("found"))


def peek(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, whichever come first."""
    return df.limit(n)
