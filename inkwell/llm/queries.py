"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.block_knn import nearest, similar_pairs
from inkwell.llm.borda import borda, latest_rows, score_ranks
from inkwell.llm.bpe import encode_corpus
from inkwell.llm.heavy_hitters import frequent_items, misra_gries
from inkwell.llm.markup import TAGS
from inkwell.llm.mixing import mix_documents, mix_plan
from inkwell.llm.mojibake import learn_plausibility, planted_damage, restored_texts
from inkwell.llm.title_forms import article_index, disguised_titles
from inkwell.llm.wrappers import learn_wrappers, tag_counts, wrapped_texts
from inkwell.session import cut, table

SCORES = ["pagerank", "pageviews", "backlinks"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return wrapped_texts(table(spark, sf, "article").where("page_id IS NOT NULL"), "page_id", "text").where("marks > 0").select("page_id").distinct()


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every article once for each text it has, cleaned, with its units that had markup and those that no wrapper fits."""
    return wrapped_texts(table(spark, sf, "article").select("page_id", "text").distinct(), "page_id", "text")


def p1_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """The wrappers inferred from the articles: host, pattern, whether it is markup, streams aligned."""
    found = learn_wrappers(table(spark, sf, "article"), "text")
    return spark.createDataFrame([(h, w.pattern(), w.marked, w.streams) for h, w in found], "host string, wrapper string, marked boolean, streams int")


def p1_tags(spark: SparkSession, sf: str) -> DataFrame:
    """How often each tag stands in the articles' token streams."""
    return tag_counts(table(spark, sf, "article"), "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    articles = table(spark, sf, "articles")
    index = cut(article_index(articles), "index")
    parts = [
        disguised_titles(df, column, kind, index).select(F.lit(f"{name}.{column}").alias("field"), "value", "article_id")
        for name, column, kind, df in (
            ("articles", "lookup_title", "title", articles),
            ("links", "target_title", "link", table(spark, sf, "links")),
            ("pageviews", "title", "view", table(spark, sf, "pageviews")),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_items(table(spark, sf, "pageviews"), "title", "view_count", 1).select(F.col("item").alias("title"))


def p5_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 titles with the largest sums, each with bounds for its sum."""
    found = misra_gries(table(spark, sf, "pageviews"), "title", "view_count", 5_000)
    return found.orderBy(F.desc("high"), "item").limit(100).select(F.col("item").alias("title"), F.col("low").alias("views_low"), F.col("high").alias("views_high"))


def p5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 titles with the largest sums among the candidates of the summaries, summed exactly, and whether each sum
    keeps to its bounds."""
    views = table(spark, sf, "pageviews")
    found = misra_gries(views, "title", "view_count", 5_000)
    # at most 5,000 rows
    exact = views.join(F.broadcast(found.withColumnRenamed("item", "title")), "title").groupBy("title", "low", "high").agg(F.sum(F.greatest(F.coalesce("view_count", F.lit(0)), F.lit(0))).alias("views"))
    return exact.select("title", "views", F.col("views").between(F.col("low"), F.col("high")).alias("bounded")).orderBy(F.desc("views"), "title").limit(20)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(latest_rows(table(spark, sf, "articles"), "article_id", "embedding_timestamp", SCORES), "latest")
    ranks = score_ranks(rows.fillna(0, SCORES), "article_id", SCORES)
    worst = ranks.groupBy("article_id").agg(F.max(F.col("greater") * 100 - 3 * F.col("present")).alias("worst"))
    return worst.where("worst < 0").select("article_id")


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(latest_rows(table(spark, sf, "articles"), "article_id", "embedding_timestamp", SCORES), "latest")
    return borda(rows, "article_id", dict.fromkeys(SCORES, 1.0))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf, "vectors"), "article_id", "vector", 0.9)
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p7_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "vectors"), "article_id", "vector", 10).select(F.col("id").alias("article_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0].withColumnRenamed("size", "tokens")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source, with its documents, tokens and most copies."""
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1].withColumnsRenamed({"size": "tokens", "mix_size": "mix_tokens"})


def p9_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole copies and the size drawn besides, of each source in a mix by characters."""
    return mix_plan(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "source", "n_chars")


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Per source with a target: whether its copies stay within max_repeats, its documents, and the sum of all shares."""
    report = p9_report(spark, sf)
    total = report.agg(F.round(F.sum("actual_share"), 6).alias("all_shares"))
    return report.crossJoin(F.broadcast(total)).select("source", (F.col("most_copies") <= F.col("repeats")).alias("within"), "docs", "all_shares")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return restored_texts(table(spark, sf, "documents"), "doc_id", "text").where("damaged").select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged documents with their text as far as it could be restored."""
    return restored_texts(table(spark, sf, "documents"), "doc_id", "text").where("damaged").select("doc_id", "restored")


def p10_planted(spark: SparkSession, sf: str) -> DataFrame:
    """By pair of codecs: sentences damaged on purpose in undamaged documents, and how many were found and came back."""
    docs = table(spark, sf, "documents")
    model = learn_plausibility(docs, "text")
    rows = restored_texts(docs, "doc_id", "text", model=model).where("NOT damaged").select("doc_id", F.col("restored").alias("text"))
    planted = cut(planted_damage(rows, "doc_id", "text"), "planted")
    back = restored_texts(planted, "doc_id", "text", model=model).withColumnRenamed("doc_id", "id")
    joined = planted.join(back, F.col("doc_id") == F.col("id"))
    return joined.groupBy("pair").agg(F.count(F.lit(1)).alias("planted"), F.count_if("damaged").alias("found"), F.count_if(F.col("restored") == F.col("original")).alias("restored"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_wrappers, p1_tags, p3_found, p5_found, p5_top, p5_checked, p6_found, p6_ranking, p7_found, p7_nearest, p8_ids, p9_mix, p9_report, p9_plan, p9_kept, p10_found, p10_restored, p10_planted)}

_LATEST = "SELECT article_id, pagerank, pageviews, backlinks FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY embedding_timestamp DESC NULLS LAST, pagerank DESC NULLS LAST, pageviews DESC NULLS LAST, backlinks DESC NULLS LAST) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1"
_POINTS = "CASE WHEN {s} IS NULL THEN 0 ELSE (m_{s} - (rank() OVER (PARTITION BY {s} IS NULL ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0) + 0.5) / m_{s} - 0.5 END"

ORACLES = {
    "p9_plan": """
WITH d AS (SELECT source, count(*) AS docs, sum(n_chars) AS size FROM documents WHERE n_chars > 0 GROUP BY source),
l AS (SELECT source, docs, CAST(size AS DOUBLE) AS size, target_share AS share, max_repeats AS repeats FROM d JOIN mix_targets USING (source) WHERE target_share > 0 AND max_repeats > 0),
t AS (SELECT min(repeats * size * (SELECT sum(share) FROM l) / share) AS total FROM l),
w AS (SELECT *, least(share / (SELECT sum(share) FROM l) * total, repeats * size) AS wanted FROM l, t),
c AS (SELECT *, CAST(least(repeats, floor(wanted / size + 1e-12)) AS INTEGER) AS whole FROM w)
SELECT source, docs, CAST(size AS BIGINT) AS size, whole, CAST(CASE WHEN whole < repeats THEN round(wanted - whole * size) ELSE 0 END AS BIGINT) AS rest FROM c""",
    "p9_kept": """
SELECT source, TRUE AS within, count(doc_id) AS docs, CAST(1 AS DOUBLE) AS all_shares FROM mix_targets LEFT JOIN (SELECT doc_id, source FROM documents WHERE length(text) > 0) USING (source) GROUP BY source""",
    "p1_tags": f"""
SELECT tag, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '</?(?:{"|".join(sorted(TAGS, key=len, reverse=True))})(?:\\s[^<>]*|/)?\\s*/?>')) AS t FROM article)
CROSS JOIN LATERAL (SELECT regexp_extract(t, '^</?[a-z0-9]+') AS tag) GROUP BY tag""",
    "p5_found": "SELECT title FROM pageviews WHERE title IS NOT NULL GROUP BY title HAVING sum(coalesce(view_count, 0)) * 100 >= (SELECT sum(coalesce(view_count, 0)) FROM pageviews)",
    "p5_checked": "SELECT title, CAST(sum(coalesce(view_count, 0)) AS BIGINT) AS views, TRUE AS bounded FROM pageviews WHERE title IS NOT NULL GROUP BY title ORDER BY views DESC, title LIMIT 20",
    "p6_found": f"""
WITH l AS ({_LATEST}),
r AS (SELECT article_id, count(*) OVER () AS n, {", ".join(f"rank() OVER (ORDER BY coalesce({s}, 0) DESC) - 1 AS g_{s}" for s in SCORES)} FROM l)
SELECT article_id FROM r WHERE {" AND ".join(f"g_{s} * 100 < 3 * n" for s in SCORES)}""",
    "p6_ranking": f"""
WITH l AS ({_LATEST}),
p AS (SELECT article_id, round(1.5 + ({" + ".join(_POINTS.format(s=s) for s in SCORES)}), 9) AS points
FROM (SELECT *, {", ".join(f"count({s}) OVER () AS m_{s}" for s in SCORES)} FROM l))
SELECT article_id, points, row_number() OVER (ORDER BY points DESC, article_id) AS rank FROM p""",
    "p7_found": """
WITH v AS (SELECT DISTINCT article_id AS id, CAST(vector AS DOUBLE[]) AS v FROM vectors
  WHERE article_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0)
SELECT a.id AS article_id_a, b.id AS article_id_b FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n""",
    "p7_nearest": """
WITH v AS (SELECT DISTINCT article_id AS id, CAST(vector AS DOUBLE[]) AS v FROM vectors
  WHERE article_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
p AS (SELECT a.id AS article_id, b.id AS neighbour_id, list_dot_product(a.v, b.v) / a.n / b.n AS c FROM u a JOIN u b ON a.id <> b.id)
SELECT article_id, neighbour_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY c DESC, neighbour_id) AS INTEGER) AS rank, round(c, 6) AS cosine FROM p
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY c DESC, neighbour_id) <= 10""",
}
