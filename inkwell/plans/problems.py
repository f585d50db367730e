"""Queries for keys holding most records (2) and orphan references (4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.lookalike import with_key
from inkwell.functions.times import micros, month
from inkwell.operators.orphans import ALWAYS, track
from inkwell.operators.skew import frequent_keys, key_quantiles
from inkwell.session import table

PERCENTS = [50, 95]
#: An instant after all references (epoch microseconds, year 2100).
LATER = 4_102_444_800_000_000


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pagelinks").select(F.lit("pagelinks.target_id").alias("field"), F.col("target_id").cast("string").alias("key"))
    counts = table(spark, sf, "backlink_counts").select(F.lit("backlink_counts.lookup_title").alias("field"), F.col("lookup_title").alias("key"))
    return frequent_keys(links.unionByName(counts), "field", "key").select("field", "key")


def _as_double(df: DataFrame) -> DataFrame:
    """Quantiles as doubles, which hold them exactly, as they may be null."""
    return df.withColumns({f"p{p}": F.col(f"p{p}").cast("double") for p in PERCENTS})


def p2_inlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: rows, and exact median and 95th percentile of when its links were seen."""
    links = table(spark, sf, "pagelinks").select("target_id", micros(F.col("seen_at")).alias("seen"))
    return _as_double(key_quantiles(links, "target_id", "seen", PERCENTS))


def p2_refined(spark: SparkSession, sf: str) -> DataFrame:
    """p2_inlinks with leaves of 50 rows, so that the values of many targets are refined digit by digit."""
    links = table(spark, sf, "pagelinks").select("target_id", micros(F.col("seen_at")).alias("seen"))
    return _as_double(key_quantiles(links, "target_id", "seen", PERCENTS, leaf_rows=50))


def p2_title_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per title: flushes (a flush written twice counts once) and quantiles of their counts."""
    counts = table(spark, sf, "backlink_counts").distinct()
    return _as_double(key_quantiles(counts, "lookup_title", "backlink_count", PERCENTS))


def p2_title_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per title: the sum over its distinct flushes; null counts as 0."""
    counts = table(spark, sf, "backlink_counts").distinct().where(F.col("lookup_title").isNotNull())
    return counts.groupBy("lookup_title").agg(F.sum(F.coalesce("backlink_count", F.lit(0))).alias("backlinks"))


def orphan_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References and parents of links, pagelinks and articles, in the tracker's columns."""
    articles, links, pages = (table(spark, sf, t) for t in ("articles", "links", "page_tbl"))
    titled = with_key(articles.select("article_id", "lookup_title", "embedding_timestamp").where("lookup_title IS NOT NULL"), "lookup_title", "title")
    # seconds to microseconds; a row without a time can't be later than a reference
    since = F.coalesce(F.col("embedding_timestamp") * 1_000_000, F.lit(ALWAYS))
    seen = micros(F.col("seen_at"))
    refs = (
        with_key(links.select("source_id", "target_title", seen.alias("at")).where("target_title IS NOT NULL"), "target_title", "link")
        .where("key IS NOT NULL")
        .select(F.lit("links").alias("ref_table"), "key", "source_id", F.col("target_title").alias("target"), "at")
        .unionByName(table(spark, sf, "pagelinks").where("target_id is not null").select(F.lit("pagelinks").alias("ref_table"), F.col("target_id").cast("string").alias("key"), "source_id", F.col("target_id").cast("string").alias("target"), seen.alias("at")))
        .unionByName(titled.select(F.lit("articles").alias("ref_table"), "key", F.col("article_id").alias("source_id"), F.col("lookup_title").alias("target"), (F.col("embedding_timestamp") * 1_000_000).alias("at")))
    )
    parents = (
        titled.select(F.lit("links").alias("ref_table"), "key", since.alias("since"))
        .unionByName(articles.where("article_id is not null").select(F.lit("pagelinks").alias("ref_table"), F.col("article_id").cast("string").alias("key"), since.alias("since")))
        .unionByName(with_key(pages.where("page_namespace = 0 AND page_title IS NOT NULL").select("page_title").distinct(), "page_title", "title").select(F.lit("articles").alias("ref_table"), "key", F.lit(ALWAYS).alias("since")))
    )
    return refs, parents


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    late, absent = track(*orphan_inputs(spark, sf))
    period = month(F.col("at")).alias("period")
    out = late.withColumn("reason", F.lit("late")).unionByName(absent.withColumn("reason", F.lit("absent")))
    return out.select("ref_table", "source_id", "target", period, "reason").distinct()


def _pagelinks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References and parents of pagelinks alone, whose keys plain SQL can compare."""
    links, articles = table(spark, sf, "pagelinks"), table(spark, sf, "articles")
    target = F.col("target_id").cast("string")
    refs = links.where("target_id is not null").select(F.lit("pagelinks").alias("ref_table"), target.alias("key"), "source_id", target.alias("target"), micros(F.col("seen_at")).alias("at"))
    parents = articles.where("article_id is not null").select(F.lit("pagelinks").alias("ref_table"), F.col("article_id").cast("string").alias("key"), F.coalesce(F.col("embedding_timestamp") * 1_000_000, F.lit(ALWAYS)).alias("since"))
    return refs, parents


def p4_pagelinks(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p4_found for pagelinks alone."""
    late, absent = track(*_pagelinks(spark, sf))
    out = late.withColumn("reason", F.lit("late")).unionByName(absent.withColumn("reason", F.lit("absent")))
    return out.select("source_id", "target", month(F.col("at")).alias("period"), "reason").distinct()


def p4_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """p4_waiting for pagelinks alone: what waited at the end of each month's batch."""
    return _waiting(*_pagelinks(spark, sf))


def p4_reopened(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting pagelinks by month, once the articles that page_tbl doesn't have are deleted after all links."""
    refs, parents = _pagelinks(spark, sf)
    there = table(spark, sf, "page_tbl").where("page_id IS NOT NULL").select(F.col("page_id").cast("string").alias("key")).distinct()
    gone = parents.select("ref_table", "key").distinct().join(there, "key", "left_anti").withColumn("at", F.lit(LATER))
    _, absent = track(refs, parents, months=6, deletions=gone)
    return absent.groupBy(month(F.col("at")).alias("period")).agg(F.count(F.lit(1)).alias("pending"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references (distinct as in p4_found) by table, period and reason."""
    return p4_found(spark, sf).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def p4_waiting(spark: SparkSession, sf: str) -> DataFrame:
    """References that waited for their parent at the end of each month's batch, by table and month of the reference.

    Rows as they come, not distinct ones as in p4_found. A month in which nothing waited has no rows.
    """
    return _waiting(*orphan_inputs(spark, sf))


def _waiting(refs: DataFrame, parents: DataFrame) -> DataFrame:
    snapshots: list[DataFrame] = []
    track(refs, parents, snapshots=snapshots)
    none = refs.select(F.lit("").alias("batch"), "ref_table", F.lit("").alias("period"), F.lit(0).cast("bigint").alias("pending")).limit(0)
    return reduce(DataFrame.unionByName, snapshots, none)


QUERIES = {f.__name__: f for f in (p2_found, p2_inlinks, p2_refined, p2_title_counts, p2_title_totals, p4_found, p4_pagelinks, p4_snapshot, p4_reopened, p4_report, p4_waiting)}

_QUANTILES = """
WITH d AS ({rows}), r AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i, count(*) OVER (PARTITION BY k) AS n FROM d WHERE v IS NOT NULL),
q AS (SELECT k, min(CASE WHEN i >= greatest(1, (50 * n + 99) // 100) THEN v END) AS p50, min(CASE WHEN i >= greatest(1, (95 * n + 99) // 100) THEN v END) AS p95 FROM r GROUP BY k),
s AS (SELECT k, count(*) AS n_rows, count(v) AS n_values FROM d GROUP BY k)
SELECT s.k AS {key}, n_rows, n_values, CAST(p50 AS DOUBLE) AS p50, CAST(p95 AS DOUBLE) AS p95 FROM s LEFT JOIN q ON s.k = q.k
"""

_SINCE = "SELECT article_id, min(coalesce(embedding_timestamp, -1000000000000)) AS since FROM articles WHERE article_id IS NOT NULL GROUP BY article_id"

ORACLES = {
    "p4_snapshot": f"""
WITH a AS ({_SINCE}),
r AS (SELECT strftime(seen_at, '%Y-%m') AS period, CASE WHEN article_id IS NULL THEN '9999-12' WHEN since < 0 THEN '0000-01' ELSE strftime(make_timestamp(since * 1000000), '%Y-%m') END AS came
  FROM pagelinks LEFT JOIN a ON target_id = article_id WHERE target_id IS NOT NULL),
b AS (SELECT DISTINCT period AS batch FROM r WHERE period IS NOT NULL),
-- an arrival after the last month comes with the last batch
w AS (SELECT period, CASE WHEN came = '9999-12' THEN came ELSE least(came, (SELECT max(batch) FROM b)) END AS came, count(*) AS n FROM r GROUP BY ALL)
SELECT batch, 'pagelinks' AS ref_table, period, CAST(sum(n) AS BIGINT) AS pending FROM b JOIN w ON coalesce(period, (SELECT max(batch) FROM b)) <= batch AND batch < came GROUP BY batch, period""",
    "p4_reopened": """
SELECT strftime(seen_at, '%Y-%m') AS period, count(*) AS pending FROM pagelinks
WHERE target_id IS NOT NULL AND NOT (EXISTS (SELECT 1 FROM articles WHERE article_id = target_id) AND EXISTS (SELECT 1 FROM page_tbl WHERE page_id = target_id)) GROUP BY period""",
    "p2_found": """
SELECT 'pagelinks.target_id' AS field, CAST(target_id AS VARCHAR) AS key FROM pagelinks WHERE target_id IS NOT NULL
GROUP BY target_id HAVING count(*) * 50 >= (SELECT count(*) FROM pagelinks)
UNION ALL
SELECT 'backlink_counts.lookup_title', lookup_title FROM backlink_counts WHERE lookup_title IS NOT NULL
GROUP BY lookup_title HAVING count(*) * 50 >= (SELECT count(*) FROM backlink_counts)""",
    "p2_inlinks": _QUANTILES.format(rows="SELECT target_id AS k, epoch_us(seen_at) AS v FROM pagelinks WHERE target_id IS NOT NULL", key="target_id"),
    "p2_refined": _QUANTILES.format(rows="SELECT target_id AS k, epoch_us(seen_at) AS v FROM pagelinks WHERE target_id IS NOT NULL", key="target_id"),
    "p2_title_counts": _QUANTILES.format(rows="SELECT lookup_title AS k, backlink_count AS v FROM (SELECT DISTINCT * FROM backlink_counts) WHERE lookup_title IS NOT NULL", key="lookup_title"),
    "p4_pagelinks": """
WITH a AS (SELECT article_id, min(coalesce(embedding_timestamp, -1000000000000)) AS since FROM articles WHERE article_id IS NOT NULL GROUP BY article_id)
SELECT DISTINCT source_id, CAST(target_id AS VARCHAR) AS target, strftime(seen_at, '%Y-%m') AS period, CASE WHEN since IS NULL THEN 'absent' ELSE 'late' END AS reason
FROM pagelinks LEFT JOIN a ON target_id = article_id WHERE target_id IS NOT NULL AND (since IS NULL OR since * 1000000 > coalesce(epoch_us(seen_at), 4000000000000000000))""",
    "p2_title_totals": "SELECT lookup_title, CAST(sum(coalesce(backlink_count, 0)) AS BIGINT) AS backlinks FROM (SELECT DISTINCT * FROM backlink_counts) WHERE lookup_title IS NOT NULL GROUP BY lookup_title",
}
