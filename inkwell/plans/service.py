"""Queries of the search service and of experiments on it, over a small catalogue made of parts, with their SQL."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import scoring as S
from inkwell.functions import text as T
from inkwell.functions.vectors import model_input
from inkwell.operators import articles as A
from inkwell.operators import graph as G
from inkwell.operators import index as V
from inkwell.operators import quality as Q
from inkwell.operators.probe import measure
from inkwell.operators.ranking import Service
from inkwell.operators.report import bars, comparison, html_text, json_text
from inkwell.plans.reference import _articles, _edges, _flat, _queries
from inkwell.session import cut, scratch, table
from inkwell.sources import wiki
from inkwell.sources.runs import History

Frame = DataFrame


def _catalogue(spark: SparkSession, sf: str) -> Frame:
    """Parts as articles: ids as those of the vectors, titles unique by their id, signals from size and price."""
    p = table(spark, sf, "part")
    title = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("article_id"), title.alias("title"), F.lower(title).alias("lookup_title"), (F.col("p_size") * 2.0).alias("pagerank"), F.floor(F.col("p_retailprice") * 100).cast("bigint").alias("pageviews"))


def _service(spark: SparkSession, sf: str) -> Service:
    return Service(_catalogue(spark, sf), _flat(spark, sf))


def _title(spark: SparkSession, sf: str, key: int) -> str:
    return _catalogue(spark, sf).where(F.col("article_id") == key).first()["title"]


def _related(spark: SparkSession, sf: str, **options: object) -> tuple[Frame, Frame]:
    """A search by the vector of id 0 and the title of id 3, spelt with blanks."""
    service = _service(spark, sf)
    vector = service.index.where("id = 0").first()["unit"]
    return service.related(vector, _title(spark, sf, 3).replace("_", " "), **options)


def related(spark: SparkSession, sf: str) -> Frame:
    """The service's default ranking with its debug columns."""
    found, _ = _related(spark, sf, debug=True)
    d = F.col("debug")
    return found.select("id", "title", "score", F.round("score_float", 6).alias("score_float"), *[F.round(d[c], 6).alias(c) for c in ("semantic", "pagerank_norm", "pageviews_norm", "title_match")])


def related_semantic(spark: SparkSession, sf: str) -> Frame:
    found, _ = _related(spark, sf, k=10, ranking="semantic_only")
    return found.select("id", "title", "score", F.round("score_float", 6).alias("score_float"))


def related_edges(spark: SparkSession, sf: str) -> Frame:
    """Cross edges of ten results, with two articles of the context besides."""
    context = f"{_title(spark, sf, 5)}, ,{_title(spark, sf, 8).replace('_', ' ')},no such title"
    _, edges = _related(spark, sf, k=10, ranking="semantic", context=context, threshold=0.2)
    return edges.select("source", "target", F.round("score", 6).alias("score"))


def article_details(spark: SparkSession, sf: str) -> Frame:
    """Articles by title as stored, with blanks, in capitals, and one that isn't there."""
    service, title = _service(spark, sf), _title(spark, sf, 7)
    found = [service.article(t).withColumn("asked", F.lit(n)) for n, t in (("stored", title), ("blanks", title.replace("_", " ")), ("capitals", title.upper()), ("missing", "no such title"))]
    return reduce(DataFrame.unionByName, found).select("asked", "article_id", "title", F.round("pagerank_norm", 6).alias("pagerank_norm"), F.round("pageviews_norm", 6).alias("pageviews_norm"))


def context_ids(spark: SparkSession, sf: str) -> Frame:
    service = _service(spark, sf)
    return service.context_ids(f" {_title(spark, sf, 1)} ,{_title(spark, sf, 2).replace('_', ' ').upper()},,{_title(spark, sf, 1)}")


def signals_there(spark: SparkSession, sf: str) -> Frame:
    """Which signals the catalogue has, the required columns it lacks, and a column that is added once."""
    rows = _catalogue(spark, sf)
    there = Service(rows, rows.limit(0)).signals()
    added = A.add_column(A.add_column(rows, "backlinks", "bigint", 0), "backlinks", "bigint", 5)
    missing = A.missing_columns(rows, ["article_id", "title", "char_count"])
    kept = A.available(added, ["article_id", "backlinks", "none_such"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("backlinks").alias("backlinks")).select("n", "backlinks", *[F.lit(v).alias(f"has_{s}") for s, v in there.items()], F.lit(",".join(missing)).alias("missing"), F.lit(",".join(kept.columns)).alias("columns"))


def title_scores(spark: SparkSession, sf: str) -> Frame:
    """The title score with all its penalties: places, years, listings, and titles with other halves."""
    n = table(spark, sf, "nation").select("n_name")
    made = n.select(F.explode(F.array(*[F.struct(t.alias("title"), F.lit(q).alias("query")) for t, q in (
        (F.concat(F.lit("Education_in_India_"), "n_name"), "education"), (F.concat(F.lit("Education_in_"), "n_name"), "education"), (F.concat(F.lit("2023_in_"), "n_name"), "in"), (F.concat(F.lit("1984_"), "n_name"), "nation_1"),
        (F.concat(F.lit("List_of_cities_in_Japan_"), "n_name"), "cities"), (F.concat(F.lit("History_of_"), "n_name"), "history of"), (F.concat(F.lit("A_in_B_in_France_"), "n_name"), "a in b"), (F.col("n_name"), "nation 1"), (F.lit(""), "x"),
    )])).alias("x")).select("x.*").distinct()
    return made.select("title", "query", F.round(T.title_match(F.col("title"), F.col("query")), 6).alias("score"))


def lookups(spark: SparkSession, sf: str) -> Frame:
    """The customer found by the first strategy that finds any: name, half a name, or the poorest of a segment."""
    customers = table(spark, sf, "customer")
    half = F.length("c_name") - 3
    found = []
    for n, asked in (("name", "Customer#000000007"), ("tail", "009"), ("none", "nobody")):
        q = F.lit(asked)
        found.append(A.first_match(customers, asked, [F.col("c_name") == q, F.substr("c_name", half + 1) == q, F.col("c_acctbal") < 0], "c_custkey").select(F.lit(n).alias("asked"), "c_custkey", "c_name"))
    return reduce(DataFrame.unionByName, found)


# ---- updates


def rank_merge(spark: SparkSession, sf: str) -> Frame:
    """PageRank of two rounds merged into the articles, others 0; features merged where there are any, others kept."""
    ranks = G.pagerank(table(spark, sf, "articles"), G.restrict(_edges(spark, sf), table(spark, sf, "articles")), iterations=2, tolerance=None).select("article_id", "pagerank")
    rows = A.update_by_key(_articles(spark, sf).select("article_id", "char_count", "pagerank"), ranks, "article_id", {"pagerank": 0.0})
    texts = table(spark, sf, "article").where("page_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("page_id").alias("article_id")).agg(F.max(F.length("text")).alias("char_count"))
    merged = A.update_by_key(rows, texts, "article_id", {"char_count": None}, reset=False)
    return merged.select("article_id", "char_count", (F.col("pagerank") > 0).alias("ranked"))


def snapshots(spark: SparkSession, sf: str) -> Frame:
    """Five snapshots of a growing table of which three stay, and what the newest one holds."""
    folder = f"{scratch(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select("o_orderkey")
    for n in range(1, 6):
        wiki.save_snapshot(rows.where(F.col("o_orderkey") % 5 < n), folder, n)
    newest = wiki.newest_snapshot(folder)
    left = wiki.snapshot_names(spark, folder)
    return spark.read.parquet(newest).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(len(left)).cast("int").alias("kept"), F.lit(wiki.snapshot_number(newest)).alias("newest"), F.lit(wiki.next_version(wiki.next_version(None))).alias("version"))


def replaced_table(spark: SparkSession, sf: str) -> Frame:
    """A table that is dropped and written anew holds the new rows alone."""
    path = f"{scratch(spark)}/replaced-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer")
    wiki.replace_table(rows.where("c_acctbal >= 0"), path)
    wiki.replace_table(rows.where("c_acctbal < 0"), path)
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")


def stored_index(spark: SparkSession, sf: str) -> Frame:
    """Vectors of a flat index written and read again, and those of some ids reconstructed."""
    path = f"{scratch(spark)}/flat-{uuid.uuid4().hex}"
    _flat(spark, sf).write.parquet(path)
    back = spark.read.parquet(path)
    return V.reconstruct(back, back.where("id % 7 = 0").select("id")).select("id", F.round(F.element_at("unit", 1), 6).alias("first"))


def index_consistency(spark: SparkSession, sf: str) -> Frame:
    return V.consistency(_catalogue(spark, sf), _flat(spark, sf))


# ---- experiments


def _hits(spark: SparkSession, sf: str, every: int = 50) -> Frame:
    """Result pages: the ten nearest of every vector whose id is divisible by 50, with their titles."""
    index = _flat(spark, sf)
    found = V.search_exact(index, _queries(index, every), 10).select(F.col("query").cast("string").alias("query"), "id", "rank")
    return found.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "id")


def _asked(spark: SparkSession, sf: str) -> Frame:
    """What each query is expected to find: the words of its own part's name, by the part's type."""
    p = table(spark, sf, "part").where("p_partkey % 50 = 0")
    return p.select(F.col("p_type").alias("category"), F.col("p_partkey").cast("string").alias("query"), F.explode(F.split(F.upper("p_name"), " ")).alias("wanted"))


def suite_recall(spark: SparkSession, sf: str) -> Frame:
    """The recall suite: by query the share of expected words found in result titles, whatever their case."""
    return Q.substring_recall(_hits(spark, sf), _asked(spark, sf).select("query", "wanted"))


def suite_report(spark: SparkSession, sf: str) -> Frame:
    """The same by category, and the run's totals with its smoke verdict."""
    results = _asked(spark, sf).select("category", "query").distinct().join(suite_recall(spark, sf), "query")
    return Q.category_status(results, "category", "success", "recall").crossJoin(F.broadcast(Q.run_summary(results, "success", "recall")))


def suite_hits(spark: SparkSession, sf: str) -> Frame:
    """By category, how many queries find an expected word among their first three results."""
    return Q.hit_rate(_hits(spark, sf), _asked(spark, sf), "category", 3)


def analogies(spark: SparkSession, sf: str) -> Frame:
    """a is to b as c is to d: whether d, the next but one id with c's label, is among c's ten nearest."""
    index = _flat(spark, sf)
    near = V.search_exact(index, _queries(index, 50), 10).select(F.col("query").alias("c"), F.col("id").alias("d"))
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    tuples = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("c"), (F.col("vec_id") + 2).alias("d"))
    return Q.analogies(near, tuples)


def search_path(spark: SparkSession, sf: str) -> Frame:
    """A shortest path of at most three searches from vector 0 to others, over the graph of the five nearest."""
    index = _flat(spark, sf)
    graph = V.search_exact(index, _queries(index, 1), 5).select(F.col("query").alias("source_id"), F.col("id").alias("target_id"))
    graph = cut(graph, "graph")
    out = reduce(DataFrame.unionByName, [G.find_path(graph, 0, t).withColumn("target", F.lit(t).cast("bigint")) for t in (0, 11, 50, 123, 499, 10**9)])
    return out.select("target", "success", F.col("hops").cast("int").alias("hops"))


def explored(spark: SparkSession, sf: str) -> Frame:
    """Two levels from vector 0: the three best edges of each, of the first level's five least ids."""
    index = _flat(spark, sf)
    graph = V.search_exact(index, _queries(index, 1), 5).select(F.col("query").alias("source_id"), F.col("id").alias("target_id"), "score")
    return G.beam(graph, index.where("id = 0").select("id"), "score")


def run_history(spark: SparkSession, sf: str) -> Frame:
    """Two runs with their facts; the rows of the last run beside the number of the one before."""
    history = History(spark, f"{scratch(spark)}/history-{uuid.uuid4().hex}")
    rows = table(spark, sf, "events")
    for half in (1, 2):
        run = history.create_run(f"half {half}", at=half)
        mine = rows.where((F.dayofmonth("ts") > 15) == F.lit(half == 2))
        history.log("benchmark", run, mine.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("num_queries"), F.round(F.avg("value"), 6).alias("avg_latency")))
        details = F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")))
        history.log("quality", run, mine.groupBy(F.col("event_type").alias("test_name")).agg(details.alias("details")).withColumns({"test_type": F.lit("events"), "success": F.lit(True)}))
    facts = history.facts("benchmark", run).join(history.details(run, "events", "n bigint, most double").select(F.col("test_name").alias("name"), "n", "most"), "name")
    named = facts.join(history.runs().select("run_id", "notes"), "run_id")
    return named.select("run_id", "notes", "name", "num_queries", "avg_latency", "n", "most", F.lit(history.previous(run)).cast("bigint").alias("previous"), F.col("qps").isNull().alias("no_qps"))


def score_stats(spark: SparkSession, sf: str) -> Frame:
    return Q.score_stats(table(spark, sf, "part"), "p_brand", "p_retailprice")


def cache_effect(spark: SparkSession, sf: str) -> Frame:
    """First latency of each user against the mean of the later ones."""
    return Q.cache_effect(table(spark, sf, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], "value")


def validators(spark: SparkSession, sf: str) -> Frame:
    """The checks of the enriched table, each with its figure and verdict."""
    return Q.validate_signals(_articles(spark, sf), ["backlinks", "pageviews", "pagerank"], "article_id")


def length_diagnosis(spark: SparkSession, sf: str) -> Frame:
    """Whether the longest articles are those most linked: overlap of two top lists."""
    rows = _articles(spark, sf)
    return Q.top_overlap(rows, "article_id", "char_count", "backlinks", 100)


def existing_sample(spark: SparkSession, sf: str) -> Frame:
    """How many of the 1,000 articles drawn by a hash the page table has."""
    sample = Q.sample_rows(_articles(spark, sf).select("article_id"), 1_000, "article_id")
    pages = table(spark, sf, "page_tbl").select(F.col("page_id").alias("article_id"))
    n = Q.exists_in(sample, pages, "article_id")
    all_ = Q.exists_in(_articles(spark, sf).select("article_id"), pages, "article_id")
    # which rows are drawn depends on a hash, so SQL can check only the whole table and the size
    return all_.crossJoin(F.broadcast(n.select(F.col("asked").alias("drawn"), (F.col("found") <= F.col("asked")).alias("bounded"))))


def newest_rows(spark: SparkSession, sf: str) -> Frame:
    """The last ten orders, and that a look at any five gives five."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return Q.last_rows(orders, 10, "o_orderkey").crossJoin(F.broadcast(Q.peek(orders, 5).agg(F.count(F.lit(1)).alias("peeked"))))


def benchmark_choice(spark: SparkSession, sf: str) -> Frame:
    """Benchmarks by query type where there are any, else the first four."""
    names = table(spark, sf, "part").select(F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("name")).distinct()
    marked = names.select(F.when(F.col("name").startswith("PROMO"), F.concat(F.lit("Query Type "), "name")).otherwise(F.col("name")).alias("name"))
    return Q.query_type_benchmarks(names).withColumn("chosen", F.lit("first")).unionByName(Q.query_type_benchmarks(marked).withColumn("chosen", F.lit("by type")))


def verdicts(spark: SparkSession, sf: str) -> Frame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("clustering", "disambiguation", "other")]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", kinds.alias("kind"), (F.col("value") / 200).alias("score"))
    return rows.select("event_id", "kind", Q.quality_verdict(F.col("kind"), F.col("score")).alias("good"))


# ---- small functions


def shown_numbers(spark: SparkSession, sf: str) -> Frame:
    """Sizes, thousands, bars, padded names, ratios and parsed numbers."""
    p = table(spark, sf, "customer")
    n = F.col("c_custkey") * F.col("c_custkey") * 977
    return p.select(
        "c_custkey", T.format_bytes(n).alias("size"), T.thousands(n).alias("thousands"), T.bar(F.col("c_custkey") % 21 / 20.0).alias("bar"), wiki.padded_name("chunk_", F.col("c_custkey"), 6).alias("chunk"),
        F.round(S.ratio(F.col("c_acctbal"), (F.col("c_custkey") % 3).cast("double")), 6).alias("ratio"), S.parse_int(F.concat(F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(""), F.col("c_custkey").cast("string"))).alias("parsed"),
        F.to_json(T.query_variations(F.concat(F.lit("aB_"), F.col("c_mktsegment"), F.lit(" c")))).alias("variations"), F.to_json(T.parse_context(F.concat(F.lit(" a_b , ,"), "c_mktsegment"))).alias("context"),
        model_input(F.lit("A_b"), F.col("c_name")).alias("model_input"),
    )


def json_sets(spark: SparkSession, sf: str) -> Frame:
    """The event types of each user as a JSON list without repeats."""
    return table(spark, sf, "events").groupBy("user_id").agg(T.json_set(F.col("event_type")).alias("types"))


def sparsity(spark: SparkSession, sf: str) -> Frame:
    stats = G.graph_stats(_edges(spark, sf)).first()
    n = _articles(spark, sf).count()
    return spark.createDataFrame([(round(G.sparsity(stats["edges"], n), 9),)], "sparsity double")


def label_connectivity(spark: SparkSession, sf: str) -> Frame:
    """By label: ordered pairs of members of which the second is among the ten nearest of the first, over n(n-1)."""
    index = _flat(spark, sf)
    near = V.search_exact(index, _queries(index, 1), 10).select(F.col("query").alias("source"), F.col("id").alias("target"))
    return Q.connectivity(near, table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id")), "label")


def first_rows(spark: SparkSession, sf: str) -> Frame:
    """Insert-or-ignore over whole rows: of each article the earliest one, with its scores."""
    columns = ["embedding_timestamp", "lookup_title", "pageviews", "backlinks", "pagerank", "char_count"]
    rows = table(spark, sf, "articles").where("article_id IS NOT NULL").select("article_id", *columns)
    return A.one_per_key(rows, ["article_id"], [F.asc_nulls_last(c) for c in columns])


def replaced_rows(spark: SparkSession, sf: str) -> Frame:
    """Insert-or-replace over whole rows: of each article the latest one, with its scores."""
    columns = ["embedding_timestamp", "lookup_title", "pageviews", "backlinks", "pagerank", "char_count"]
    rows = table(spark, sf, "articles").where("article_id IS NOT NULL").select("article_id", *columns)
    return A.one_per_key(rows, ["article_id"], [F.desc_nulls_last(c) for c in columns])


def changed_runs(spark: SparkSession, sf: str) -> Frame:
    """Whether the result lists of runs agree: events by type, two runs made of even and odd ids, and one with itself."""
    rows = table(spark, sf, "events").select((F.col("event_id") % 2).alias("run"), F.floor(F.col("event_id") / 2).alias("position"), "event_type")
    few = rows.where("position < 10")
    same = few.where("run = 0").unionByName(few.where("run = 0").withColumn("run", F.lit(1).cast("bigint")))
    both = [Q.identical_runs(df, "run", "position", "event_type").withColumn("compared", F.lit(n)) for n, df in (("halves", few), ("itself", same))]
    return both[0].unionByName(both[1])


def list_counts(spark: SparkSession, sf: str) -> Frame:
    """How many inverted lists an index of so many rows gets."""
    return spark.createDataFrame([(n, V.cluster_count(n)) for n in (0, 1, 38, 39, 78, 1_521, 10_000, 10**6, 10**9)], "n bigint, lists bigint")


def latency_probe(spark: SparkSession, sf: str) -> Frame:
    """Twelve probes by three workers, of which every fourth fails: each has a latency, and its success is known."""

    def call(i: int) -> None:
        if i % 4 == 3:
            raise ValueError(i)

    return measure(spark, "probe", call, 12, 3).select("name", "i", "success", (F.col("latency_ms") >= 0).alias("timed"))


def report_parts(spark: SparkSession, sf: str) -> Frame:
    """The HTML report of a run: its rows, coloured changes and bars, and the totals of its JSON twin."""
    events = table(spark, sf, "events").withColumn("passed", F.col("value") >= 20)
    categories = Q.category_status(events, "event_type", "passed", "value")
    halves = [events.where(c).groupBy("event_type").agg(F.avg("value").alias("latency")) for c in ("day(ts) > 15", "day(ts) <= 15")]
    text = html_text("Run", {"Categories": categories}, [comparison("Changes", Q.compare_runs(*halves, "event_type", {"latency": True}), "event_type", ["latency"]), bars("Rates", categories.withColumn("rate", F.col("pass_rate") / 100), "event_type", "rate")])
    totals = json.loads(json_text(Q.run_summary(events, "passed", "value")))
    return spark.createDataFrame([(text.count("<tr>"), text.count("<span style=color:"), text.count("background:"), totals["total"], totals["passed"])], "rows int, changes int, bars int, total bigint, passed bigint")


QUERIES = {
    f.__name__: f
    for f in (
        related, related_semantic, related_edges, article_details, context_ids, signals_there, title_scores, lookups, rank_merge, snapshots, replaced_table, stored_index, index_consistency,
        suite_recall, suite_report, suite_hits, analogies, search_path, explored, run_history, score_stats, cache_effect, validators, length_diagnosis, existing_sample, newest_rows,
        benchmark_choice, verdicts, shown_numbers, json_sets, sparsity, label_connectivity, first_rows, replaced_rows, changed_runs, list_counts,
        latency_probe, report_parts,
    )
}

_C = "SELECT p_partkey AS article_id, replace(p_name, ' ', '_') || '_' || p_partkey AS title, p_size * 2.0 AS pagerank, CAST(floor(p_retailprice * 100) AS BIGINT) AS pageviews FROM part"
_U = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, label FROM embeddings"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY embedding_timestamp DESC NULLS LAST, pagerank NULLS LAST, lookup_title NULLS LAST) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1"
_PRN = "CASE WHEN pagerank > 0 THEN pow(pagerank / 100.0, 0.8) ELSE 0.0 END"
_PVN = "CASE WHEN pageviews >= 1 THEN least(1.0, greatest(0.0, (log10(pageviews) - 1) / 6)) ELSE 0.0 END"


def _title_match(rows: str) -> str:
    """rows (title, query, ...) with tm, the title score."""
    words = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"
    return f"""SELECT *, CASE WHEN trim(t) = '' THEN 0.0 WHEN t = q THEN 1.0 ELSE greatest(0.0, least(1.0, (CASE WHEN contains(t, q) THEN least(1.0, j * 1.5) ELSE j END)
 * (CASE WHEN len(string_split(t, ' in ')) = 2 AND regexp_matches(string_split(t, ' in ')[2], '{"|".join(T.PLACE_WORDS)}') THEN 0.5 ELSE 1.0 END) * (CASE WHEN regexp_matches(t, '^[0-9]{{4}}') THEN 0.4 ELSE 1.0 END)
 * (CASE WHEN regexp_matches(t, '^({"|".join(T.LISTING_STARTS)})') THEN 0.3 ELSE 1.0 END))) END AS tm
FROM (SELECT *, CASE WHEN len(list_distinct(list_concat(tw, qw))) > 0 THEN len(list_intersect(tw, qw)) / len(list_distinct(list_concat(tw, qw))) ELSE 0.0 END AS j
 FROM (SELECT *, {words('t')} AS tw, {words('q')} AS qw FROM (SELECT *, lower(replace(title, '_', ' ')) AS t, lower(query) AS q FROM ({rows}))))"""


_POOL = f"""WITH u AS ({_U}), c AS ({_C}), p AS (SELECT b.id, b.v, b.n, list_dot_product(a.v, b.v) / (a.n * b.n) AS semantic FROM u a, u b WHERE a.id = 0 AND b.id <> 3 ORDER BY semantic DESC, b.id LIMIT 200),
r AS (SELECT p.id, p.v, p.n, semantic, c.title, {_PRN} AS pagerank_norm, {_PVN} AS pageviews_norm, (SELECT replace(title, '_', ' ') FROM c WHERE article_id = 3) AS query FROM p JOIN c ON p.id = c.article_id)"""
_NEAR = f"""WITH u AS ({_U}), s AS (SELECT a.id AS query, b.id AS id, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM s)"""
_PAGES = f"{_NEAR}, h AS (SELECT query, id, rank, lower(p_name) AS title FROM k JOIN part ON id = p_partkey WHERE rank <= 10 AND query % 50 = 0), x AS (SELECT p_type AS category, p_partkey AS query, unnest(string_split(lower(p_name), ' ')) AS wanted FROM part WHERE p_partkey % 50 = 0)"
_RECALL = f"{_PAGES}, y AS (SELECT query, round(avg(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.query = x.query AND contains(h.title, x.wanted)) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM x GROUP BY query)"
_HOPS = """g AS (SELECT query AS s, id AS t FROM k WHERE rank <= 5), d1 AS (SELECT DISTINCT t FROM g WHERE s = 0), d2 AS (SELECT DISTINCT t FROM g WHERE s IN (SELECT t FROM d1)), d3 AS (SELECT DISTINCT t FROM g WHERE s IN (SELECT t FROM d2)),
w AS (SELECT unnest([0, 11, 50, 123, 499, 1000000000]) AS target), z AS (SELECT target, CASE WHEN target = 0 THEN 0 WHEN target IN (SELECT t FROM d1) THEN 1 WHEN target IN (SELECT t FROM d2) THEN 2 WHEN target IN (SELECT t FROM d3) THEN 3 END AS hops FROM w)"""
_WHOLE = "embedding_timestamp, lookup_title, pageviews, backlinks, pagerank, char_count"
_SIZES = ["B", "KB", "MB", "GB", "TB"]

ORACLES = {
    "related": f"""{_POOL}, m AS ({_title_match("SELECT * FROM r")}),
f AS (SELECT *, pow(greatest(semantic, 1e-8), 0.5) * pow(greatest(pagerank_norm, 1e-8), 0.4) * pow(greatest(pageviews_norm, 1e-8), 0.05) * pow(greatest(tm, 1e-8), 0.05) AS s FROM m)
SELECT id, title, CAST(trunc(s * 100.0) AS INTEGER) AS score, round(s, 6) AS score_float, round(semantic, 6) AS semantic, round(pagerank_norm, 6) AS pagerank_norm, round(pageviews_norm, 6) AS pageviews_norm, round(tm, 6) AS title_match FROM f ORDER BY s DESC, f.semantic DESC, id LIMIT 32""",
    "related_semantic": f"{_POOL} SELECT id, title, CAST(trunc(semantic * 100.0) AS INTEGER) AS score, round(semantic, 6) AS score_float FROM r ORDER BY r.semantic DESC, id LIMIT 10",
    "related_edges": f"""{_POOL}, b AS (SELECT id, v, n, title FROM r ORDER BY semantic DESC, id LIMIT 10), o AS (SELECT * FROM b UNION SELECT id, v, n, title FROM u JOIN c ON id = article_id WHERE id IN (5, 8))
SELECT b.title AS source, o.title AS target, round(list_dot_product(b.v, o.v) / (b.n * o.n), 6) AS score FROM b JOIN o ON b.id <> o.id WHERE list_dot_product(b.v, o.v) / (b.n * o.n) > 0.2""",
    "article_details": f"SELECT asked, article_id, title, round({_PRN}, 6) AS pagerank_norm, round({_PVN}, 6) AS pageviews_norm FROM ({_C}), (SELECT unnest(['stored', 'blanks', 'capitals']) AS asked) WHERE article_id = 7",
    "context_ids": "SELECT p_partkey AS article_id FROM part WHERE p_partkey IN (1, 2)",
    "signals_there": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS backlinks, TRUE AS has_pagerank, TRUE AS has_pageviews, FALSE AS has_backlinks, 'char_count' AS missing, 'article_id,backlinks' AS columns FROM part",
    "title_scores": f"""SELECT title, query, round(tm, 6) AS score FROM ({_title_match('''SELECT DISTINCT title, query FROM (
SELECT 'Education_in_India_' || n_name AS title, 'education' AS query FROM nation UNION ALL SELECT 'Education_in_' || n_name, 'education' FROM nation UNION ALL SELECT '2023_in_' || n_name, 'in' FROM nation UNION ALL SELECT '1984_' || n_name, 'nation_1' FROM nation UNION ALL
SELECT 'List_of_cities_in_Japan_' || n_name, 'cities' FROM nation UNION ALL SELECT 'History_of_' || n_name, 'history of' FROM nation UNION ALL SELECT 'A_in_B_in_France_' || n_name, 'a in b' FROM nation UNION ALL SELECT n_name, 'nation 1' FROM nation UNION ALL SELECT '', 'x')''')})""",
    "lookups": """WITH a AS (SELECT unnest([{'n': 'name', 'q': 'Customer#000000007'}, {'n': 'tail', 'q': '009'}, {'n': 'none', 'q': 'nobody'}]) AS x),
m AS (SELECT x.n AS asked, c_custkey, c_name, CASE WHEN c_name = x.q THEN 0 WHEN right(c_name, 3) = x.q THEN 1 WHEN c_acctbal < 0 THEN 2 END AS r FROM a, customer)
SELECT asked, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY r, c_custkey) AS i FROM m WHERE r IS NOT NULL) WHERE i = 1""",
    "rank_merge": f"""WITH l AS ({_LAST}), t AS (SELECT page_id, max(length(text)) AS chars FROM article WHERE page_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
v AS (SELECT DISTINCT article_id AS id FROM articles WHERE article_id IS NOT NULL), e AS (SELECT DISTINCT source_id, target_id FROM pagelinks WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY source_id) AS w FROM e),
x0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS r FROM v), x1 AS (SELECT v.id, 0.85 * coalesce(sum(r * w), 0) + 0.15 / (SELECT count(*) FROM v) AS r FROM v LEFT JOIN (w JOIN x0 ON source_id = x0.id) ON target_id = v.id GROUP BY v.id), y1 AS (SELECT id, r / (SELECT sum(r) FROM x1) AS r FROM x1),
x2 AS (SELECT v.id, 0.85 * coalesce(sum(r * w), 0) + 0.15 / (SELECT count(*) FROM v) AS r FROM v LEFT JOIN (w JOIN y1 ON source_id = y1.id) ON target_id = v.id GROUP BY v.id)
SELECT l.article_id, CAST(coalesce(chars, char_count) AS INTEGER) AS char_count, r > (SELECT min(r) FROM x2) + 1e-12 AS ranked FROM l JOIN x2 ON l.article_id = x2.id LEFT JOIN t ON l.article_id = page_id""",
    "snapshots": "SELECT count(*) AS n, 3 AS kept, CAST(5 AS BIGINT) AS newest, 'v0.0.2' AS version FROM orders",
    "replaced_table": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
    "stored_index": f"SELECT id, round(v[1] / n, 6) AS first FROM ({_U}) WHERE id % 7 = 0",
    "index_consistency": """SELECT *, without_vector = 0 AND without_article = 0 AS consistent FROM (SELECT (SELECT count(*) FROM part) AS articles, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)) AS without_vector,
(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)) AS without_article)""",
    "suite_recall": f"{_RECALL} SELECT CAST(query AS VARCHAR) AS query, recall, recall > 0 AS success FROM y",
    "suite_report": f"""{_RECALL}, z AS (SELECT p_type AS category, recall FROM y JOIN part ON query = p_partkey), a AS (SELECT category, count(*) AS tests, count(*) FILTER (recall > 0) AS passes, round(avg(recall), 6) AS mean_recall FROM z GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (recall > 0) AS passed, count(*) - count(*) FILTER (recall > 0) AS failed, round(avg(recall), 6) AS recall FROM z)
SELECT category, tests, passes, mean_recall, round(passes * 100.0 / tests, 6) AS pass_rate, CASE WHEN round(passes * 100.0 / tests, 6) >= 70 THEN 'PASS' ELSE 'FAIL' END AS status, t.*, CASE WHEN passed > 5 THEN 'working' WHEN passed > 2 THEN 'partial' ELSE 'failing' END AS verdict FROM a, t""",
    "suite_hits": f"{_PAGES}, y AS (SELECT category, query, bool_or(EXISTS (SELECT 1 FROM h WHERE h.query = x.query AND h.rank <= 3 AND contains(h.title, x.wanted))) AS hit FROM x GROUP BY ALL) SELECT category, count(*) AS queries, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM y GROUP BY 1",
    "analogies": f"{_NEAR} SELECT vec_id AS c, vec_id + 2 AS d, EXISTS (SELECT 1 FROM k WHERE query = vec_id AND id = vec_id + 2 AND rank <= 10) AS success FROM embeddings WHERE vec_id % 50 = 0",
    "search_path": f"{_NEAR}, {_HOPS} SELECT CAST(target AS BIGINT) AS target, hops IS NOT NULL AS success, CAST(hops AS INTEGER) AS hops FROM z",
    "explored": f"""{_NEAR}, b AS (SELECT query AS s, id AS t FROM k WHERE rank <= 3), h0 AS (SELECT CAST(0 AS BIGINT) AS id), h1 AS (SELECT DISTINCT t AS id FROM b WHERE s = 0), f1 AS (SELECT id FROM h1 ORDER BY id LIMIT 5),
h2 AS (SELECT DISTINCT t AS id FROM b WHERE s IN (SELECT id FROM f1) AND t <> 0 AND t NOT IN (SELECT id FROM h1)) SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "run_history": "SELECT CAST(2 AS BIGINT) AS run_id, 'half 2' AS notes, event_type AS name, CAST(count(*) AS INTEGER) AS num_queries, round(avg(value), 6) AS avg_latency, count(*) AS n, max(value) AS most, CAST(1 AS BIGINT) AS previous, TRUE AS no_qps FROM events WHERE day(ts) > 15 GROUP BY event_type",
    "score_stats": "SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS least, max(p_retailprice) AS most, round(avg(p_retailprice), 6) AS mean, round(max(p_retailprice) - min(p_retailprice), 6) AS range FROM part GROUP BY 1",
    "cache_effect": """WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), y AS (SELECT user_id, max(value) FILTER (i = 1) AS first, avg(value) FILTER (i > 1) AS later FROM x GROUP BY 1)
SELECT user_id, round(first, 6) AS first, round(later, 6) AS later, round(CASE WHEN later > 0 THEN first / later ELSE 0 END, 6) AS speedup FROM y""",
    "validators": f"""WITH l AS ({_LAST}), s AS (SELECT count(*) AS n, count(*) FILTER (backlinks > 0) * 100.0 / count(*) AS b, count(*) FILTER (pageviews > 0) * 100.0 / count(*) AS v, count(*) FILTER (pagerank > 0) * 100.0 / count(*) AS r, count(*) - count(DISTINCT article_id) AS d FROM l)
SELECT 'rows' AS name, CAST(n AS DOUBLE) AS value, n > 0 AS passed FROM s UNION ALL SELECT 'duplicates', d, d = 0 FROM s UNION ALL SELECT 'backlinks', round(b, 6), b >= 50 FROM s UNION ALL SELECT 'pageviews', round(v, 6), v >= 50 FROM s UNION ALL SELECT 'pagerank', round(r, 6), r >= 50 FROM s""",
    "length_diagnosis": f"""WITH l AS ({_LAST}), a AS (SELECT article_id FROM l ORDER BY char_count DESC NULLS LAST, article_id LIMIT 100), b AS (SELECT article_id FROM l ORDER BY backlinks DESC NULLS LAST, article_id LIMIT 100), c AS (SELECT count(*) AS shared FROM a JOIN b USING (article_id))
SELECT shared, round(shared * 100.0 / 100, 6) AS share, CASE WHEN shared >= 50 THEN 'length tells importance' ELSE 'length is no importance' END AS verdict FROM c""",
    "existing_sample": f"SELECT count(*) AS asked, count(*) FILTER (article_id IN (SELECT page_id FROM page_tbl WHERE page_id IS NOT NULL)) AS found, least(count(*), 1000) AS drawn, TRUE AS bounded FROM ({_LAST})",
    "newest_rows": "SELECT o_orderkey, o_custkey, CAST(5 AS BIGINT) AS peeked FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    "benchmark_choice": "WITH n AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part), f AS (SELECT name, 'first' AS chosen FROM n ORDER BY name LIMIT 4) SELECT * FROM f UNION ALL SELECT 'Query Type ' || name, 'by type' FROM n WHERE name LIKE 'PROMO%'",
    "verdicts": "WITH x AS (SELECT event_id, ['clustering', 'disambiguation', 'other'][CAST(event_id % 3 AS INTEGER) + 1] AS kind, value / 200 AS s FROM events) SELECT event_id, kind, CASE kind WHEN 'clustering' THEN s > 0.7 WHEN 'disambiguation' THEN s > 0.8 ELSE s > 0 END AS good FROM x",
    "shown_numbers": f"""WITH x AS (SELECT *, c_custkey * c_custkey * 977 AS n FROM customer)
SELECT c_custkey, CASE {" ".join(f"WHEN n < {1024 ** (i + 1)} THEN printf('%.2f {u}', n / {float(1024**i)})" for i, u in enumerate(_SIZES))} END AS size, format('{{:,}}', n) AS thousands, repeat('█', CAST(floor(c_custkey % 21 / 20.0 * 20) AS INTEGER)) AS bar, printf('chunk_%06d', c_custkey) AS chunk,
round(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / (c_custkey % 3) ELSE 0 END, 6) AS ratio, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS parsed,
'["aB_' || c_mktsegment || ' c","' || lower('aB_' || c_mktsegment || ' c') || '","' || upper('aB_' || c_mktsegment || ' c') || '","aB ' || c_mktsegment || ' c","aB_' || c_mktsegment || '_c"]' AS variations, '["a b","' || c_mktsegment || '"]' AS context, 'A b. ' || c_name AS model_input FROM x""",
    "json_sets": "SELECT user_id, '[\"' || array_to_string(list_sort(list_distinct(list(event_type))), '\",\"') || '\"]' AS types FROM events GROUP BY 1",
    "first_rows": f"SELECT article_id, {_WHOLE} FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {', '.join(f'{c} NULLS LAST' for c in _WHOLE.split(', '))}) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1",
    "replaced_rows": f"SELECT article_id, {_WHOLE} FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _WHOLE.split(', '))}) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1",
    "changed_runs": """WITH l AS (SELECT event_id % 2 AS run, list(event_type ORDER BY event_id) AS l FROM events WHERE event_id < 20 GROUP BY 1)
SELECT 'halves' AS compared, count(*) AS runs, count(DISTINCT l) <= 1 AS same FROM l UNION ALL SELECT 'itself', 2, TRUE""",
    "list_counts": "SELECT n, CAST(greatest(1, least(floor(sqrt(n)), n // 39)) AS BIGINT) AS lists FROM (SELECT unnest([0, 1, 38, 39, 78, 1521, 10000, 1000000, 1000000000]) AS n)",
    "latency_probe": "SELECT 'probe' AS name, CAST(i AS INTEGER) AS i, i % 4 <> 3 AS success, TRUE AS timed FROM range(12) AS t(i)",
    "report_parts": """WITH c AS (SELECT count(DISTINCT event_type) AS n, count(DISTINCT event_type) FILTER (day(ts) > 15) AS late FROM events), b AS (SELECT count(*) AS n_both FROM (SELECT event_type FROM events WHERE day(ts) > 15 INTERSECT SELECT event_type FROM events WHERE day(ts) <= 15))
SELECT CAST(2 * n + late + 3 AS INTEGER) AS rows, CAST(n_both AS INTEGER) AS changes, CAST(n AS INTEGER) AS bars, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events WHERE value >= 20) AS passed FROM c, b""",
    "sparsity": "SELECT round(100.0 * (1 - (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM pagelinks WHERE source_id IS NOT NULL AND target_id IS NOT NULL)) / pow((SELECT count(DISTINCT article_id) FROM articles), 2)), 9) AS sparsity",
    "label_connectivity": f"""{_NEAR}, f AS (SELECT a.label, count(*) AS found FROM k JOIN embeddings a ON k.query = a.vec_id JOIN embeddings b ON k.id = b.vec_id AND a.label = b.label WHERE rank <= 10 GROUP BY 1), m AS (SELECT label, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY 1)
SELECT m.label, n, coalesce(found, 0) AS found, round(CASE WHEN n > 1 THEN coalesce(found, 0) / (n * (n - 1)) ELSE 0 END, 6) AS connectivity FROM m LEFT JOIN f ON m.label = f.label""",
}
