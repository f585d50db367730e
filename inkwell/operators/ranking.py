"""The search service as DataFrames: related articles, article details and health (no HTTP server is part of it)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.scoring import multisignal, normalize_pagerank, normalize_pageviews, percent_score
from inkwell.functions.vectors import dot
from inkwell.operators.articles import first_match
from inkwell.operators.index import mesh

POOL, DEFAULT_K, MOST_K, THRESHOLD = 200, 32, 100, 0.65
SIGNALS = ["pagerank", "pageviews", "backlinks"]


@dataclass
class Service:
    """articles: article_id, title, lookup_title and the signals it has. index: id, unit (flat_index)."""

    articles: DataFrame
    index: DataFrame

    def signals(self) -> dict[str, bool]:
        """Q9."""
        return {s: s in self.articles.columns for s in SIGNALS}

    def _signal(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in self.articles.columns else F.lit(0.0)

    def find(self, query: str) -> DataFrame:
        """The article of a title as stored, with underscores, or by its lookup_title."""
        q = F.lit(query)
        spaced = F.replace(q, F.lit(" "), F.lit("_"))
        return first_match(self.articles, query, [F.col("title") == q, F.col("title") == spaced, F.col("lookup_title") == F.lower(spaced)], "article_id")

    def article(self, title: str) -> DataFrame:
        """Q7: an article's row with its normalised signals; empty if there is none."""
        return self.find(title).withColumns({"pagerank_norm": normalize_pagerank(self._signal("pagerank")), "pageviews_norm": normalize_pageviews(self._signal("pageviews"))})

    def context_ids(self, titles: str) -> DataFrame:
        """Q4: article_id of a comma-separated list of titles."""
        spark = self.articles.sparkSession
        wanted = spark.createDataFrame([(titles,)], "c string").select(F.explode(T.parse_context(F.col("c"))).alias("t")).select(T.normalize_title(F.col("t")).alias("lookup_title"))
        return self.articles.join(F.broadcast(wanted.distinct()), "lookup_title", "left_semi").select("article_id").distinct()

    def related(self, vector: list[float], query: str, k: int = DEFAULT_K, ranking: str = "default", debug: bool = False, context: str | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
        """Q1 to Q5: results and cross edges of a query.

        A pool of the most similar articles without the query's own one, ranked by four signals, or by similarity alone
        (ranking semantic_only or semantic). k is clamped to 0..100. Articles missing from the table and meta pages are
        dropped. Results: rank, title, score (0..100), and with debug all signals.
        """
        k = max(0, min(MOST_K, k))
        q = F.array(*[F.lit(float(x)) for x in vector])
        own = F.broadcast(self.find(query).select(F.col("article_id").alias("id")))
        pool = self.index.join(own, "id", "left_anti").withColumn("semantic", dot(F.col("unit"), q)).orderBy(F.desc("semantic"), "id").limit(POOL)
        rows = F.broadcast(pool).join(self.articles, F.col("id") == F.col("article_id")).where(~T.is_meta_page(F.col("title")))
        spaced = F.replace(F.lit(query), F.lit("_"), F.lit(" "))
        rows = rows.withColumns({"pagerank_norm": normalize_pagerank(self._signal("pagerank")), "pageviews_norm": normalize_pageviews(self._signal("pageviews")), "title_match": T.title_match(F.col("title"), spaced)})
        only = ranking in ("semantic_only", "semantic")
        score = F.col("semantic") if only else multisignal(F.col("semantic"), F.col("pagerank_norm"), F.col("pageviews_norm"), F.col("title_match"))
        best = rows.withColumn("score_float", score).orderBy(F.desc("score_float"), F.desc("semantic"), "id").limit(k)
        columns = ["id", "title", percent_score(F.col("score_float")).alias("score"), "score_float"]
        if debug:
            columns.append(F.struct("semantic", "pagerank_norm", "pageviews_norm", "title_match").alias("debug"))
        results = best.select(*columns)
        candidates = best.select("id", "unit")
        other = candidates.limit(0)
        if context:
            other = self.index.join(F.broadcast(self.context_ids(context)), F.col("id") == F.col("article_id"), "left_semi").select("id", "unit")
        edges = mesh(candidates, other, threshold)
        names = self.articles.select("article_id", "title")
        named = edges.join(names.select(F.col("article_id").alias("source"), F.col("title").alias("source_title")), "source").join(names.select(F.col("article_id").alias("target"), F.col("title").alias("target_title")), "target")
        return results, named.select(F.col("source_title").alias("source"), F.col("target_title").alias("target"), "score")

    def search(self, text: str, encode: Callable[[Column], Column], k: int = 5) -> DataFrame:
        """Q8, V2: rank, id, title, score of the k articles most similar to a text.

        encode: what encodes the articles, too (hash_encoder() or a model). A blank text finds nothing.
        """
        spark = self.articles.sparkSession
        vector = spark.createDataFrame([(text,)], "t string").select(encode(F.col("t")).alias("v")).first()["v"]
        q = F.array(*[F.lit(float(x)) for x in vector])
        alike = self.index.withColumn("score", dot(F.col("unit"), q)) if any(vector) else self.index.withColumn("score", F.lit(0.0)).limit(0)
        named = alike.select("id", "score").join(self.articles.select(F.col("article_id").alias("id"), "title"), "id")
        best = named.orderBy(F.desc("score"), "id").limit(k)
        return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", "title", "score")

    def health(self) -> DataFrame:
        """Q6: totals and coverage of each signal, in one pass."""
        there = [s for s in SIGNALS if s in self.articles.columns]
        row = self.articles.agg(F.count(F.lit(1)).alias("articles"), *[F.count_if(F.col(s) > 0).alias(f"with_{s}") for s in there])
        return row.withColumns({f"{s}_coverage": F.when(F.col("articles") > 0, F.col(f"with_{s}") * 100.0 / F.col("articles")).otherwise(0.0) for s in there})
