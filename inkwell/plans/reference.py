"""Queries of the corpus engine's own operators on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import scoring as S
from inkwell.functions import text as T
from inkwell.functions.times import micros
from inkwell.functions.vectors import dot, l2_normalize
from inkwell.operators import articles as A
from inkwell.operators import graph as G
from inkwell.operators import index as V
from inkwell.operators import quality as Q
from inkwell.operators.ranking import Service
from inkwell.session import cut, table
from inkwell.sources.wiki import count_views

Frame = DataFrame


def _t(spark: SparkSession, sf: str, *names: str) -> list[Frame]:
    return [table(spark, sf, n) for n in names]


def _articles(spark: SparkSession, sf: str) -> Frame:
    """One row of each article: the latest."""
    return A.one_per_key(table(spark, sf, "articles").where("article_id IS NOT NULL"), ["article_id"], [F.desc_nulls_last("embedding_timestamp"), F.asc_nulls_last("pagerank"), F.asc_nulls_last("lookup_title")])


def _flat(spark: SparkSession, sf: str) -> Frame:
    return V.flat_index(table(spark, sf, "embeddings"), "vec_id", "embedding")


def _queries(index: Frame, every: int = 50) -> Frame:
    return index.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "unit")


# ---- search and ranking


def knn_exact(spark: SparkSession, sf: str) -> Frame:
    """Ten nearest vectors of every vector whose id is divisible by 50."""
    index = _flat(spark, sf)
    return V.search_exact(index, _queries(index), 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


def multisignal_rank(spark: SparkSession, sf: str) -> Frame:
    """A pool of 200 by similarity, joined with its signals and ranked by four of them; the top 32."""
    index = _flat(spark, sf)
    q = F.broadcast(index.where("id = 0").select(F.col("unit").alias("q")))
    pool = index.where("id <> 0").crossJoin(q).withColumn("semantic", F.round(dot(F.col("unit"), F.col("q")), 9)).orderBy(F.desc("semantic"), "id").limit(200)
    pr, pv = (F.col("id") * 37 % 101).cast("double"), (F.col("id") * 7919 % 1000003).cast("bigint")
    title = F.round((F.col("id") % 11) / 10.0, 1)
    score = S.multisignal(F.col("semantic"), S.normalize_pagerank(pr), S.normalize_pageviews(pv), title)
    return pool.select("id", "semantic", F.round(score, 6).alias("score_float"), S.percent_score(F.round(score, 6)).alias("score")).orderBy(F.desc("score_float"), "id").limit(32)


def mesh_edges(spark: SparkSession, sf: str) -> Frame:
    index = _flat(spark, sf)
    q = F.broadcast(index.where("id = 0").select(F.col("unit").alias("q")))
    best = index.crossJoin(q).withColumn("s", F.round(dot(F.col("unit"), F.col("q")), 9)).orderBy(F.desc("s"), "id").limit(32)
    return V.mesh(best, best.limit(0), 0.3).select("source", "target", F.round("score", 6).alias("score"))


def knn_label_recall(spark: SparkSession, sf: str) -> Frame:
    """By label: the mean share of a vector's ten neighbours that have its label."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    near = knn_exact(spark, sf)
    joined = near.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("mine")), "query").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    return joined.groupBy("mine").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.avg((F.col("mine") == F.col("label")).cast("double")), 6).alias("recall")).withColumnRenamed("mine", "label")


def domain_connectivity(spark: SparkSession, sf: str) -> Frame:
    """By label: ordered pairs of members of which the second is among the ten nearest of the first, over n(n-1); all members are asked."""
    index = _flat(spark, sf)
    near = V.search_exact(index, _queries(index, 1), 10).select(F.col("query").alias("source"), F.col("id").alias("target"))
    members = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"))
    return Q.connectivity(near, members, "label")


def ivf_pq_search(spark: SparkSession, sf: str) -> Frame:
    index = cut(_flat(spark, sf), "flat")
    built = V.IvfPq.train(index, parts=16).add(index)
    return built.search(_queries(index), 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


def ivf_pq_recall(spark: SparkSession, sf: str) -> Frame:
    """Whether the mean recall of the index against the exact search is 0.9 or more, and how many hits the queries got."""
    index = cut(_flat(spark, sf), "flat")
    found = cut(V.IvfPq.train(index, parts=16).add(index).search(_queries(index), 10), "found")
    hits = found.agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("hits"))
    return V.recall(found, V.search_exact(index, _queries(index), 10)).crossJoin(F.broadcast(hits)).select((F.col("recall") >= 0.9).alias("enough"), "queries", "hits")


def l2_norms(spark: SparkSession, sf: str) -> Frame:
    unit = l2_normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.element_at(unit, 1), 6).alias("first"), F.round(dot(unit, unit), 6).alias("length"))


def health(spark: SparkSession, sf: str) -> Frame:
    rows = _articles(spark, sf)
    out = Service(rows, rows.limit(0)).health()
    return out.select("articles", *[c for s in ("pagerank", "pageviews", "backlinks") for c in (f"with_{s}", F.round(f"{s}_coverage", 6).alias(f"{s}_coverage"))])


# ---- links, graph


def backlinks_by_title(spark: SparkSession, sf: str) -> Frame:
    """Raw link targets counted by normalised title, then set on every article of that title, others 0."""
    links = table(spark, sf, "links")
    counts = G.raw_links(links).groupBy(F.col("target").alias("lookup_title")).agg(F.count(F.lit(1)).alias("backlinks"))
    return A.update_by_key(_articles(spark, sf).select("article_id", "lookup_title"), counts, "lookup_title", {"backlinks": 0}).select("article_id", "backlinks")


def backlinks_by_id(spark: SparkSession, sf: str) -> Frame:
    links = table(spark, sf, "pagelinks").where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("article_id")).agg(F.count(F.lit(1)).alias("backlinks"))
    return A.update_by_key(_articles(spark, sf).select("article_id"), links, "article_id", {"backlinks": 0})


def link_graph(spark: SparkSession, sf: str) -> Frame:
    links = table(spark, sf, "links")
    return G.resolve_links(G.raw_links(links), _articles(spark, sf))


def _edges(spark: SparkSession, sf: str) -> Frame:
    return table(spark, sf, "pagelinks").where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id").distinct()


def restricted_edges(spark: SparkSession, sf: str) -> Frame:
    return G.restrict(_edges(spark, sf), table(spark, sf, "articles"))


def out_degree(spark: SparkSession, sf: str) -> Frame:
    return G.degrees(_edges(spark, sf), "source_id")


def in_degree(spark: SparkSession, sf: str) -> Frame:
    return G.degrees(_edges(spark, sf), "target_id")


def graph_stats(spark: SparkSession, sf: str) -> Frame:
    return G.graph_stats(_edges(spark, sf))


def pagerank_3(spark: SparkSession, sf: str) -> Frame:
    """Three rounds, as plain SQL can do them."""
    out = G.pagerank(table(spark, sf, "articles"), _edges(spark, sf), iterations=3, tolerance=None)
    return out.select("article_id", F.round(F.col("rank") * 1e6, 4).alias("rank_ppm"), F.round("pagerank", 4).alias("pagerank"))


def pagerank_converged(spark: SparkSession, sf: str) -> Frame:
    return G.pagerank(table(spark, sf, "articles"), _edges(spark, sf)).select("article_id", F.round("pagerank", 3).alias("pagerank"))


def multi_hop(spark: SparkSession, sf: str) -> Frame:
    """What three hops reach from the articles whose id is divisible by 50."""
    start = table(spark, sf, "articles").where("article_id % 50 = 0").select(F.col("article_id").alias("id"))
    return G.expand(_edges(spark, sf), start, 3)


# ---- views and signals


def pageviews_by_title(spark: SparkSession, sf: str) -> Frame:
    return count_views(table(spark, sf, "pageviews"), "view_count").groupBy("lookup_title").agg(F.sum("views").alias("pageviews"))


def _signals(spark: SparkSession, sf: str) -> Frame:
    views = A.update_by_key(_articles(spark, sf).select("article_id", "lookup_title", "pagerank"), pageviews_by_title(spark, sf), "lookup_title", {"pageviews": 0})
    links = table(spark, sf, "pagelinks").where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("article_id")).agg(F.count(F.lit(1)).alias("backlinks"))
    return A.update_by_key(views, links, "article_id", {"backlinks": 0})


def signal_merge(spark: SparkSession, sf: str) -> Frame:
    return _signals(spark, sf).select("article_id", "pageviews", "backlinks")


def coverage_report(spark: SparkSession, sf: str) -> Frame:
    return Q.coverage(_articles(spark, sf), ["backlinks", "pageviews", "pagerank"])


def backlink_buckets(spark: SparkSession, sf: str) -> Frame:
    return Q.buckets(_articles(spark, sf), "backlinks")


def signal_2x2(spark: SparkSession, sf: str) -> Frame:
    return Q.signal_matrix(_articles(spark, sf), "backlinks", "pageviews")


def positive_stats(spark: SparkSession, sf: str) -> Frame:
    return Q.positive_stats(_articles(spark, sf), "backlinks")


def pagerank_backlink_corr(spark: SparkSession, sf: str) -> Frame:
    return Q.correlation(_articles(spark, sf), "pagerank", "backlinks")


def normalised_signals(spark: SparkSession, sf: str) -> Frame:
    rows = _articles(spark, sf)
    return rows.select("article_id", F.round(S.normalize_pagerank(F.when(F.col("pagerank") > 100, 100.0).otherwise(F.col("pagerank"))), 6).alias("pagerank_norm"), F.round(S.normalize_pageviews(F.col("pageviews")), 6).alias("pageviews_norm"))


def scaled_pagerank(spark: SparkSession, sf: str) -> Frame:
    rows = _articles(spark, sf).where("pagerank IS NOT NULL").select("article_id", "pagerank")
    bounds = F.broadcast(rows.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi")))
    return rows.crossJoin(bounds).select("article_id", F.round(S.minmax100(F.col("pagerank"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


def accumulated_flushes(spark: SparkSession, sf: str) -> Frame:
    """Partial counts of all workers, accumulated flush by flush: even ones first, then odd ones."""
    rows = table(spark, sf, "backlink_counts").where("lookup_title IS NOT NULL AND backlink_count IS NOT NULL")
    return A.add_counts(rows.where("flush_no % 2 = 0"), rows.where("flush_no % 2 = 1"), "lookup_title", "backlink_count")


# ---- titles and texts


def title_normalise(spark: SparkSession, sf: str) -> Frame:
    links = table(spark, sf, "links").select("target_title").distinct()
    n = T.normalize_title(F.col("target_title"))
    return links.select("target_title", n.alias("normalised"), T.is_special_page(n).alias("special"))


def title_match(spark: SparkSession, sf: str) -> Frame:
    words = table(spark, sf, "part").select("p_name").distinct()
    query = F.element_at(F.split("p_name", " "), 1)
    return words.select("p_name", F.round(T.title_match(F.col("p_name"), query), 6).alias("score"))


def skip_filter(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "articles").select("title").where("title IS NOT NULL").distinct()
    return rows.select("title", T.should_skip_article(F.col("title")).alias("skip"), T.is_meta_page(F.col("title")).alias("meta"))


def clean_text(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "article").where("text IS NOT NULL").select("page_id", "text").distinct()
    return rows.select("page_id", F.md5(T.clean_wikitext(F.col("text"))).alias("digest"))


def text_links(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "article").where("text IS NOT NULL").select("page_id", "text").distinct()
    return rows.select("page_id", F.explode(T.wikilinks(F.col("text"))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def doc_features(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.length("text").alias("chars"), F.size(T.words(F.col("text"))).alias("words"), F.size(T.wikilinks(F.col("text"))).alias("links"))


def url_decode(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "pageviews").where("title IS NOT NULL").select("title").distinct()
    return rows.select("title", T.percent_decode(F.col("title")).alias("decoded"))


def length_rank(spark: SparkSession, sf: str) -> Frame:
    return Q.length_rank(table(spark, sf, "documents"), "doc_id", "n_chars").withColumn("n_chars", F.col("n_chars").cast("double"))


# ---- quality and experiments


def duplicate_ids(spark: SparkSession, sf: str) -> Frame:
    return Q.duplicates(table(spark, sf, "articles").where("article_id IS NOT NULL"), ["article_id"])


def namespace_distribution(spark: SparkSession, sf: str) -> Frame:
    return Q.top_groups(table(spark, sf, "page_tbl"), "page_namespace", 10)


def top_targets(spark: SparkSession, sf: str) -> Frame:
    """Twenty most linked targets with their title, if the page table has it."""
    top = Q.top_groups(table(spark, sf, "pagelinks").where("target_id IS NOT NULL"), "target_id", 20)
    names = table(spark, sf, "page_tbl").where("page_namespace = 0").groupBy("page_id").agg(F.min("page_title").alias("title"))
    return names.join(F.broadcast(top), F.col("page_id") == F.col("target_id"), "right").select("target_id", "n", F.coalesce("title", F.lit("NOT IN PAGE TABLE")).alias("title"))


def latency_nearest_rank(spark: SparkSession, sf: str) -> Frame:
    return Q.nearest_rank(table(spark, sf, "events"), "event_type", "value")


def latency_linear(spark: SparkSession, sf: str) -> Frame:
    return Q.linear_percentiles(table(spark, sf, "events"), "event_type", "value")


def request_rates(spark: SparkSession, sf: str) -> Frame:
    out = Q.throughput(table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "value", "ok")
    return out.select("user_id", "n", F.round("total_s", 6).alias("total_s"), "good", F.round("qps", 6).alias("qps"), F.round("success_rate", 6).alias("success_rate"))


def warmup_halves(spark: SparkSession, sf: str) -> Frame:
    return Q.halves(table(spark, sf, "events"), "event_type", [F.asc("ts"), F.asc("event_id")], "value")


def category_pass_rate(spark: SparkSession, sf: str) -> Frame:
    return Q.category_status(table(spark, sf, "events").withColumn("passed", F.col("value") >= 20), "event_type", "passed", "value")


def histogram_tens(spark: SparkSession, sf: str) -> Frame:
    return Q.histogram(table(spark, sf, "part"), "p_size", 10)


def score_gaps(spark: SparkSession, sf: str) -> Frame:
    return Q.gaps(table(spark, sf, "part"), "p_brand", "p_retailprice", "p_partkey")


def position_variance(spark: SparkSession, sf: str) -> Frame:
    return Q.position_variance(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity")


def identical_runs(spark: SparkSession, sf: str) -> Frame:
    """Whether two searches for the 32 nearest of vector 0, the second over rows dealt out anew, list the same ids and scores."""
    index = _flat(spark, sf)
    asked = index.where("id = 0").select(F.col("id").alias("query"), "unit")
    page = F.struct("id", F.round("score", 6).alias("score")).alias("item")
    runs = [V.search_exact(rows, asked, 32).select(F.lit(i).alias("run"), "rank", page) for i, rows in enumerate((index, index.repartition(7)), 1)]
    return Q.identical_runs(runs[0].unionByName(runs[1]), "run", "rank", "item")


def overlap_sets(spark: SparkSession, sf: str) -> Frame:
    articles, pages = _t(spark, sf, "articles", "page_tbl")
    return Q.overlap(articles.where("article_id IS NOT NULL").select(F.col("article_id").alias("id")), pages.where("page_id IS NOT NULL AND page_namespace = 0").select(F.col("page_id").alias("id")), "id")


def unprocessed(spark: SparkSession, sf: str) -> Frame:
    pages, articles = _t(spark, sf, "page_tbl", "articles")
    return A.unprocessed(pages.where("page_id IS NOT NULL").select(F.col("page_id").alias("article_id")).distinct(), articles, "article_id")


def first_wins(spark: SparkSession, sf: str) -> Frame:
    """Insert-or-ignore: the earliest row of each article."""
    rows = table(spark, sf, "articles").where("article_id IS NOT NULL")
    return A.one_per_key(rows, ["article_id"], [F.asc_nulls_last("embedding_timestamp"), F.asc_nulls_last("lookup_title")]).select("article_id", "embedding_timestamp")


def last_wins(spark: SparkSession, sf: str) -> Frame:
    return _articles(spark, sf).select("article_id", "embedding_timestamp")


def first_match_lookup(spark: SparkSession, sf: str) -> Frame:
    customers = table(spark, sf, "customer")
    return A.first_match(customers, "", [F.col("c_name") == "nobody", F.col("c_custkey") == 42, F.col("c_acctbal") > 0], "c_custkey").select("c_custkey", "c_name")


def run_compare(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "events").withColumn("half", F.dayofmonth("ts") > 15)
    runs = rows.groupBy("half", "event_type").agg(F.round(F.avg("value"), 6).alias("latency"), F.count(F.lit(1)).cast("double").alias("qps"))
    out = Q.compare_runs(runs.where("half").drop("half"), runs.where("NOT half").drop("half"), "event_type", {"latency": True, "qps": False})
    return out


def json_details(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "events")
    k = F.from_json("props", "k bigint").getField("k")
    return rows.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("back"))


def epoch_dates(spark: SparkSession, sf: str) -> Frame:
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.floor(micros(F.col("ts")) / 1_000_000).alias("epoch"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        multisignal_rank, knn_exact, mesh_edges, knn_label_recall, domain_connectivity, ivf_pq_search, ivf_pq_recall, l2_norms, health, backlinks_by_title, backlinks_by_id, link_graph,
        restricted_edges, out_degree, in_degree, graph_stats, pagerank_3, pagerank_converged, multi_hop, pageviews_by_title, signal_merge, coverage_report, backlink_buckets, signal_2x2,
        positive_stats, pagerank_backlink_corr, normalised_signals, scaled_pagerank, accumulated_flushes, title_normalise, title_match, skip_filter, clean_text, text_links, doc_features,
        url_decode, length_rank, duplicate_ids, namespace_distribution, top_targets, latency_nearest_rank, latency_linear, request_rates, warmup_halves, category_pass_rate, histogram_tens,
        score_gaps, position_variance, identical_runs, overlap_sets, unprocessed, first_wins, last_wins, first_match_lookup, run_compare, json_details, epoch_dates,
    )
}

_L = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY embedding_timestamp DESC NULLS LAST, pagerank NULLS LAST, lookup_title NULLS LAST) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1"
_U = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, label FROM embeddings"
_KNN = f"""WITH u AS ({_U}), s AS (SELECT a.id AS query, b.id AS id, list_dot_product(a.v, b.v) / (a.n * b.n) AS score, a.label AS mine, b.label AS label FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s)"""
_WS = r"[\t-\r\x{85}\p{Z}]"
_STRIP = "regexp_replace(X, '^WS+|WS+$', '', 'g')".replace("WS", _WS)
_CUT = _STRIP.replace("X", "split_part(" + _STRIP.replace("X", "target_title") + ", '#', 1)")
_NORM = f"nullif(lower(replace({_CUT}, ' ', '_')), '')"
_PREFIX = "^(" + "|".join(T.SPECIAL_PREFIXES_DRAFT) + ")"
_RAW = f"SELECT source_id, t AS target FROM (SELECT source_id, {_NORM} AS t FROM links) WHERE t IS NOT NULL AND NOT regexp_matches(t, '{_PREFIX}')"
_E = "SELECT DISTINCT source_id, target_id FROM pagelinks WHERE source_id IS NOT NULL AND target_id IS NOT NULL"
_DECODED = "coalesce(try(url_decode(title)), url_decode(regexp_replace(title, '%[89A-Fa-f][0-9A-Fa-f]', chr(65533), 'g')))"
_VIEWS = f"SELECT lower({_DECODED}) AS lookup_title, CAST(sum(view_count) AS BIGINT) AS pageviews FROM pageviews WHERE project IN ('en.wikipedia', 'en') AND view_count > 0 AND title <> '-' AND title NOT LIKE '%:%' GROUP BY 1"
_IN = "SELECT target_id, count(*) AS n FROM pagelinks WHERE target_id IS NOT NULL GROUP BY 1"


def _pagerank_sql(rounds: int) -> str:
    parts = [f"v AS (SELECT DISTINCT article_id AS id FROM articles WHERE article_id IS NOT NULL), c AS (SELECT count(*) AS n FROM v), e AS ({_E}), w AS (SELECT source_id, target_id, 1.0 / count(*) OVER (PARTITION BY source_id) AS w FROM e), m AS (SELECT * FROM w WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)), r0 AS (SELECT id, CAST(1 AS DOUBLE) / n AS r FROM v, c)"]
    for i in range(rounds):
        parts.append(f"f{i} AS (SELECT target_id AS id, sum(r * w) AS f FROM m JOIN r{i} ON source_id = id GROUP BY 1), x{i} AS (SELECT v.id, 0.85 * coalesce(f, 0) + 0.15 / n AS r FROM v CROSS JOIN c LEFT JOIN f{i} ON v.id = f{i}.id), r{i + 1} AS (SELECT id, r / (SELECT sum(r) FROM x{i}) AS r FROM x{i})")
    r = f"r{rounds}"
    return f"WITH {', '.join(parts)} SELECT id AS article_id, round(r * 1e6, 4) AS rank_ppm, round((r - (SELECT min(r) FROM {r})) / (SELECT max(r) - min(r) FROM {r}) * 100, 4) AS pagerank FROM {r}"


_SCORE = "pow(greatest(semantic, 1e-8), 0.5) * pow(greatest(CASE WHEN (id * 37) % 101 > 0 THEN pow(((id * 37) % 101) / 100.0, 0.8) ELSE 0 END, 1e-8), 0.4) * pow(greatest(CASE WHEN (id * 7919) % 1000003 >= 1 THEN least(1.0, greatest(0.0, (log10((id * 7919) % 1000003) - 1) / 6)) ELSE 0 END, 1e-8), 0.05) * pow(greatest((id % 11) / 10.0, 1e-8), 0.05)"
_HAS = "coalesce({} > 0, FALSE)"

ORACLES = {
    "multisignal_rank": f"""WITH u AS ({_U}), p AS (SELECT b.id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS semantic FROM u a, u b WHERE a.id = 0 AND b.id <> 0 ORDER BY semantic DESC, id LIMIT 200),
s AS (SELECT id, semantic, round({_SCORE}, 6) AS score_float FROM p) SELECT id, semantic, score_float, CAST(trunc(score_float * 100.0) AS INTEGER) AS score FROM s ORDER BY score_float DESC, id LIMIT 32""",
    "knn_exact": f"{_KNN} SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= 10",
    "mesh_edges": f"""WITH u AS ({_U}), p AS (SELECT b.id, b.v, b.n FROM u a, u b WHERE a.id = 0 ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.id LIMIT 32)
SELECT a.id AS source, b.id AS target, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM p a JOIN p b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) > 0.3""",
    "knn_label_recall": f"{_KNN} SELECT mine AS label, count(*) AS neighbours, round(avg(CASE WHEN mine = label THEN 1.0 ELSE 0.0 END), 6) AS recall FROM k WHERE rank <= 10 GROUP BY mine",
    "domain_connectivity": f"""{_KNN}, f AS (SELECT mine AS label, count(*) AS found FROM k WHERE rank <= 10 AND mine = label GROUP BY 1), m AS (SELECT label, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY 1)
SELECT m.label, n, coalesce(found, 0) AS found, round(CASE WHEN n > 1 THEN coalesce(found, 0) / (n * (n - 1)) ELSE 0 END, 6) AS connectivity FROM m LEFT JOIN f ON m.label = f.label""",
    "ivf_pq_recall": "SELECT TRUE AS enough, count(*) AS queries, count(*) * 10 AS hits FROM embeddings WHERE vec_id % 50 = 0",
    "l2_norms": f"SELECT id AS vec_id, round(v[1] / n, 6) AS first, round(list_dot_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n)), 6) AS length FROM ({_U})",
    "health": f"SELECT count(*) AS articles, {', '.join(f'count(*) FILTER ({s} > 0) AS with_{s}, round(count(*) FILTER ({s} > 0) * 100.0 / count(*), 6) AS {s}_coverage' for s in ('pagerank', 'pageviews', 'backlinks'))} FROM ({_L})",
    "backlinks_by_title": f"SELECT article_id, coalesce(n, 0) AS backlinks FROM ({_L}) a LEFT JOIN (SELECT target, count(*) AS n FROM ({_RAW}) GROUP BY 1) c ON a.lookup_title = c.target",
    "backlinks_by_id": f"SELECT article_id, coalesce(n, 0) AS backlinks FROM (SELECT DISTINCT article_id FROM articles WHERE article_id IS NOT NULL) LEFT JOIN ({_IN}) ON article_id = target_id",
    "link_graph": f"SELECT DISTINCT source_id, target_id FROM ({_RAW}) l JOIN (SELECT lookup_title, max(article_id) AS target_id FROM ({_L}) WHERE lookup_title IS NOT NULL GROUP BY 1) t ON l.target = t.lookup_title",
    "restricted_edges": f"SELECT source_id, target_id FROM ({_E}) WHERE source_id IN (SELECT article_id FROM articles WHERE article_id IS NOT NULL) AND target_id IN (SELECT article_id FROM articles WHERE article_id IS NOT NULL)",
    "out_degree": f"SELECT source_id, count(*) AS degree FROM ({_E}) GROUP BY 1",
    "in_degree": f"SELECT target_id, count(*) AS degree FROM ({_E}) GROUP BY 1",
    "graph_stats": f"SELECT count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets, round(count(*) / count(DISTINCT source_id), 6) AS avg_out FROM ({_E})",
    "pagerank_3": _pagerank_sql(3),
    "multi_hop": f"""WITH e AS ({_E}), h0 AS (SELECT DISTINCT article_id AS id, 0 AS hop FROM articles WHERE article_id % 50 = 0),
h1 AS (SELECT DISTINCT target_id AS id, 1 AS hop FROM e WHERE source_id IN (SELECT id FROM h0) AND target_id NOT IN (SELECT id FROM h0)), a1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT DISTINCT target_id AS id, 2 AS hop FROM e WHERE source_id IN (SELECT id FROM h1) AND target_id NOT IN (SELECT id FROM a1)), a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM h2),
h3 AS (SELECT DISTINCT target_id AS id, 3 AS hop FROM e WHERE source_id IN (SELECT id FROM h2) AND target_id NOT IN (SELECT id FROM a2)) SELECT * FROM a2 UNION ALL SELECT * FROM h3""",
    "pageviews_by_title": _VIEWS,
    "signal_merge": f"SELECT article_id, coalesce(v.pageviews, 0) AS pageviews, coalesce(n, 0) AS backlinks FROM ({_L}) a LEFT JOIN ({_VIEWS}) v ON a.lookup_title = v.lookup_title LEFT JOIN ({_IN}) ON article_id = target_id",
    "coverage_report": f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (backlinks > 0) AS with_backlinks, count(*) FILTER (pageviews > 0) AS with_pageviews, count(*) FILTER (pagerank > 0) AS with_pagerank, count(*) FILTER (backlinks > 0 AND pageviews > 0) AS with_both FROM ({_L})),
p AS (SELECT *, round(with_backlinks * 100.0 / total, 6) AS backlinks_pct, round(with_pageviews * 100.0 / total, 6) AS pageviews_pct, round(with_pagerank * 100.0 / total, 6) AS pagerank_pct, round((with_backlinks + with_pageviews - with_both) * 100.0 / total, 6) AS either_pct FROM s),
c AS (SELECT *, round((backlinks_pct + pageviews_pct + pagerank_pct) / 3, 6) AS completeness FROM p) SELECT *, CASE WHEN completeness >= 90 THEN 'good' WHEN completeness >= 70 THEN 'fair' ELSE 'poor' END AS verdict FROM c""",
    "backlink_buckets": f"WITH x AS (SELECT coalesce(backlinks, 0) AS b FROM ({_L})) SELECT count(*) FILTER (b = 0) AS zero, count(*) FILTER (b BETWEEN 1 AND 10) AS to_10, count(*) FILTER (b BETWEEN 11 AND 100) AS to_100, count(*) FILTER (b BETWEEN 101 AND 1000) AS to_1000, count(*) FILTER (b > 1000) AS more, count(*) AS total FROM x",
    "signal_2x2": f"WITH x AS (SELECT coalesce(backlinks, 0) > 0 AS a, coalesce(pageviews, 0) > 0 AS b FROM ({_L})) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM x",
    "positive_stats": f"SELECT round(avg(backlinks), 6) AS mean, max(backlinks) AS most, min(backlinks) AS least, CAST(sum(backlinks) AS BIGINT) AS total FROM ({_L}) WHERE backlinks > 0",
    "pagerank_backlink_corr": f"WITH x AS (SELECT count(*) AS n, corr(pagerank, backlinks) AS c FROM ({_L}) WHERE pagerank > 0 AND backlinks > 0), y AS (SELECT n, CASE WHEN n > 100 THEN round(c, 6) END AS r FROM x) SELECT n, r, CASE WHEN r > 0.8 THEN 'strong' WHEN r > 0.6 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' ELSE 'none' END AS verdict FROM y",
    "normalised_signals": f"SELECT article_id, round(CASE WHEN pagerank > 0 THEN pow(least(pagerank, 100.0) / 100.0, 0.8) ELSE 0 END, 6) AS pagerank_norm, round(CASE WHEN pageviews >= 1 THEN least(1.0, greatest(0.0, (log10(pageviews) - 1) / 6)) ELSE 0 END, 6) AS pageviews_norm FROM ({_L})",
    "scaled_pagerank": f"WITH x AS (SELECT article_id, pagerank FROM ({_L}) WHERE pagerank IS NOT NULL) SELECT article_id, round((pagerank - (SELECT min(pagerank) FROM x)) / (SELECT max(pagerank) - min(pagerank) FROM x) * 100, 6) AS scaled FROM x",
    "accumulated_flushes": "SELECT lookup_title, CAST(sum(backlink_count) AS BIGINT) AS backlink_count FROM backlink_counts WHERE lookup_title IS NOT NULL AND backlink_count IS NOT NULL AND flush_no IS NOT NULL GROUP BY 1",
    "title_normalise": f"SELECT DISTINCT target_title, {_NORM} AS normalised, coalesce(regexp_matches({_NORM}, '{_PREFIX}'), TRUE) AS special FROM links",
    "title_match": """WITH p AS (SELECT DISTINCT p_name, lower(replace(p_name, '_', ' ')) AS t, lower(split_part(p_name, ' ', 1)) AS q FROM part), w AS (SELECT *, list_distinct(string_split(t, ' ')) AS tw FROM p),
s AS (SELECT p_name, t, q, len(list_intersect(tw, [q])) / len(list_distinct(list_concat(tw, [q]))) AS j FROM w)
SELECT p_name, round(CASE WHEN t = q THEN 1.0 ELSE CASE WHEN contains(t, q) THEN least(1.0, j * 1.5) ELSE j END END, 6) AS score FROM s""",
    "skip_filter": f"""SELECT DISTINCT title, regexp_matches(lower(title), '^({"|".join(T.SKIPPED_PREFIXES)})') OR regexp_matches(title, '^[0-9]{{4}}[-_]') OR (regexp_matches(lower(title), 'revision_act|_act_') AND regexp_matches(lower(title), 'statute|law|revision')) OR (regexp_matches(lower(title), 'honours|awards') AND regexp_matches(lower(title), 'birthday|new_year|queens|kings'))
OR regexp_matches(lower(title), '_in_[0-9]{{4}}$') OR (contains(lower(title), 'commemorative') AND contains(lower(title), 'coin')) OR contains(lower(title), '(disambiguation)') AS skip,
regexp_matches(lower(title), '^({"|".join(T.META_PREFIXES)})') OR contains(lower(title), '(disambiguation)') AS meta FROM articles WHERE title IS NOT NULL""",
    "clean_text": r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{[^}]*\}\}', '', 'g'), '(?s)<ref[^>]*>.*?</ref>', '', 'g'), '<ref[^>]*/>', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\[http[^\]]*\]', '', 'g'), '<[^>]+>', '', 'g'), 'WS+', ' ', 'g'), '^WS+|WS+$', '', 'g')) AS digest
FROM (SELECT DISTINCT page_id, text FROM article WHERE text IS NOT NULL)""".replace("WS", _WS),
    "text_links": r"SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS target FROM (SELECT DISTINCT page_id, text FROM article WHERE text IS NOT NULL)) GROUP BY 1, 2",
    "doc_features": rf"SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(regexp_extract_all(text, '[^{_WS[1:]}+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS INTEGER) AS links FROM documents WHERE text IS NOT NULL",
    "url_decode": f"SELECT DISTINCT title, {_DECODED} AS decoded FROM pageviews WHERE title IS NOT NULL",
    "length_rank": "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents",
    "duplicate_ids": "SELECT article_id, count(*) AS n FROM articles WHERE article_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "namespace_distribution": "SELECT page_namespace, count(*) AS n FROM page_tbl GROUP BY 1 ORDER BY n DESC, page_namespace NULLS FIRST LIMIT 10",
    "top_targets": "SELECT target_id, n, coalesce(title, 'NOT IN PAGE TABLE') AS title FROM (SELECT target_id, count(*) AS n FROM pagelinks WHERE target_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, target_id LIMIT 20) LEFT JOIN (SELECT page_id, min(page_title) AS title FROM page_tbl WHERE page_namespace = 0 GROUP BY 1) ON page_id = target_id",
    "latency_nearest_rank": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, len(v) AS n, v[1] AS least, v[-1] AS most, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99 FROM l",
    "latency_linear": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "request_rates": "WITH x AS (SELECT user_id, count(*) AS n, sum(value) / 1000 AS t, count(*) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1) SELECT user_id, n, round(t, 6) AS total_s, good, round(CASE WHEN t > 0 THEN n / t ELSE 0 END, 6) AS qps, round(good * 100.0 / n, 6) AS success_rate FROM x",
    "warmup_halves": "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value) FILTER (i < n // 2), 6) AS first_half, round(avg(value) FILTER (i >= n // 2), 6) AS second_half FROM x GROUP BY 1",
    "category_pass_rate": "WITH x AS (SELECT event_type, count(*) AS tests, count(*) FILTER (value >= 20) AS passes, round(avg(value), 6) AS mean_recall FROM events GROUP BY 1) SELECT *, round(passes * 100.0 / tests, 6) AS pass_rate, CASE WHEN round(passes * 100.0 / tests, 6) >= 70 THEN 'PASS' ELSE 'FAIL' END AS status FROM x",
    "histogram_tens": "SELECT CAST(floor(p_size / 10) * 10 AS BIGINT) AS bucket, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1",
    "score_gaps": "SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER w AS INTEGER) AS rank, round(p_retailprice - lead(p_retailprice) OVER w, 6) AS gap FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)",
    "position_variance": "SELECT l_linenumber, round(var_samp(l_quantity), 6) AS variance, count(DISTINCT l_quantity) AS values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 1",
    "identical_runs": "SELECT CAST(2 AS BIGINT) AS runs, TRUE AS same",
    "overlap_sets": "WITH a AS (SELECT DISTINCT article_id AS id FROM articles WHERE article_id IS NOT NULL), b AS (SELECT DISTINCT page_id AS id FROM page_tbl WHERE page_id IS NOT NULL AND page_namespace = 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.id = b.id",
    "unprocessed": "SELECT DISTINCT page_id AS article_id FROM page_tbl WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT article_id FROM articles WHERE article_id IS NOT NULL)",
    "first_wins": "SELECT article_id, min(embedding_timestamp) AS embedding_timestamp FROM articles WHERE article_id IS NOT NULL GROUP BY 1",
    "last_wins": "SELECT article_id, max(embedding_timestamp) AS embedding_timestamp FROM articles WHERE article_id IS NOT NULL GROUP BY 1",
    "first_match_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "run_compare": """WITH r AS (SELECT day(ts) > 15 AS half, event_type, round(avg(value), 6) AS latency, CAST(count(*) AS DOUBLE) AS qps FROM events GROUP BY 1, 2),
j AS (SELECT n.event_type, n.latency, n.qps, o.latency AS old_latency, o.qps AS old_qps, n.latency - o.latency AS dl, n.qps - o.qps AS dq FROM r n LEFT JOIN r o ON n.event_type = o.event_type AND NOT o.half WHERE n.half)
SELECT event_type, latency, qps, old_latency, old_qps, round(CASE WHEN abs(dl) < 0.001 THEN 0 ELSE dl END, 6) AS latency_change, CASE WHEN dl IS NULL THEN 'none' WHEN abs(dl) < 0.001 THEN 'same' WHEN dl < 0 THEN 'better' ELSE 'worse' END AS latency_kind,
round(CASE WHEN abs(dq) < 0.001 THEN 0 ELSE dq END, 6) AS qps_change, CASE WHEN dq IS NULL THEN 'none' WHEN abs(dq) < 0.001 THEN 'same' WHEN dq > 0 THEN 'better' ELSE 'worse' END AS qps_kind FROM j""",
    "json_details": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{}' ELSE '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS back FROM events",
    "epoch_dates": "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events",
}
