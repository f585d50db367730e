"""Queries of ingestion: dumps written from the test tables, read back and processed, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import articles as A
from inkwell.operators import graph as G
from inkwell.operators import quality as Q
from inkwell.plans.reference import _WS
from inkwell.session import scratch, table
from inkwell.sources import wiki
from inkwell.streaming.views import ingest_views, total_views

Frame = DataFrame


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, sf: str) -> Frame:
    """Pages in the shape of the XML source: every article text, every third a redirect, every seventh a talk page."""
    rows = table(spark, sf, "article").distinct().withColumn("ns", F.when(F.col("page_id") % 7 == 0, 1).otherwise(F.col("namespace")))
    redirect = F.when(F.col("page_id") % 3 == 0, F.struct(F.col("title").alias("_title")))
    text = F.struct(F.col("text").alias("_VALUE"), F.length("text").cast("bigint").alias("_bytes"))
    revision = F.struct(F.col("page_id").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), text.alias("text"))
    return rows.select("title", "ns", F.col("page_id").alias("id"), redirect.alias("redirect"), revision.alias("revision"))


def xml_pages(spark: SparkSession, sf: str) -> Frame:
    """Pages written as XML files and read again: what the metadata needs, and the words of the text."""
    path = _folder(spark, "xml")
    wiki.write_pages(_pages(spark, sf).where("id IS NOT NULL"), path, 1_000)
    pages = wiki.read_pages(spark, path)
    # XML readers trim and join white space, so words are compared
    words = F.regexp_replace(F.coalesce("revision.text._VALUE", F.lit("")), r"\s+", "")
    return pages.select(F.col("id").alias("page_id"), F.col("redirect").isNotNull().alias("redirected"), F.coalesce("ns", F.lit(-1)).alias("ns"), F.md5(words).alias("digest"))


def admitted(spark: SparkSession, sf: str) -> Frame:
    out = A.admit(_pages(spark, sf))
    return out.select("article_id", "title", "namespace", "char_count", "stored_chars", "lookup_title", F.md5("text").alias("digest"), F.length("model_text").alias("model_chars"))


def skip_reasons(spark: SparkSession, sf: str) -> Frame:
    return A.skip_counts(_pages(spark, sf))


def page_features(spark: SparkSession, sf: str) -> Frame:
    return A.features(_pages(spark, sf))


def page_edges(spark: SparkSession, sf: str) -> Frame:
    """Links of main articles' texts, resolved against the articles: the link graph from raw text."""
    titles = table(spark, sf, "articles").where("article_id IS NOT NULL")
    last = A.one_per_key(titles, ["article_id"], [F.desc_nulls_last("embedding_timestamp"), F.asc_nulls_last("pagerank"), F.asc_nulls_last("lookup_title")])
    return G.resolve_links(G.page_links(_pages(spark, sf)), last)


def text_backlinks(spark: SparkSession, sf: str) -> Frame:
    return A.backlinks_from_text(_pages(spark, sf))


def _dump(spark: SparkSession, sf: str) -> str:
    """A gzipped SQL dump of pagelinks, 400 tuples a line or so, with comment lines between; sources divisible by 5 are
    of namespace 1."""
    links = table(spark, sf, "pagelinks").where("source_id IS NOT NULL AND target_id IS NOT NULL")
    line = F.pmod(F.xxhash64("source_id", "target_id", "seen_at"), F.lit(max(1, links.count() // 400)))
    one = F.format_string("(%d,%d,%d)", "source_id", F.when(F.col("source_id") % 5 == 0, 1).otherwise(0), "target_id")
    lines = links.select(line.alias("line"), one.alias("t")).groupBy("line").agg(F.concat(F.lit("INSERT INTO `pagelinks` VALUES "), F.array_join(F.collect_list("t"), ","), F.lit(";")).alias("value"))
    path = _folder(spark, "dump")
    lines.select("value").unionByName(spark.createDataFrame([("-- a comment (1,0,2)",), ("INSERT INTO `page` VALUES (1,0,2);",)], "value string")).write.option("compression", "gzip").text(path)
    return path


def tuple_backlinks(spark: SparkSession, sf: str) -> Frame:
    return A.backlinks_from_tuples(wiki.read_link_tuples(spark, _dump(spark, sf)))


def dump_estimate(spark: SparkSession, sf: str) -> Frame:
    """Whether a dump's estimate and the import agree within a tenth, as the estimate comes from one line's tuples."""
    path = _dump(spark, sf)
    probe = wiki.probe_dump(spark, path).select("lines", (F.col("estimate") == F.col("lines") * F.col("first_tuples")).alias("is_product"))
    n = wiki.read_link_tuples(spark, path).agg(F.count(F.lit(1)).alias("tuples"))
    return probe.crossJoin(F.broadcast(n)).select((F.col("lines") > 0).alias("any_lines"), "is_product", "tuples", F.lit(Q.import_complete(9, 10)).alias("nine_of_ten"), F.lit(Q.import_complete(8, 10)).alias("eight_of_ten"))


def page_inlinks(spark: SparkSession, sf: str) -> Frame:
    """In-links of the most linked page by namespace of their source, and how many of these the page table has."""
    links = table(spark, sf, "pagelinks").where("target_id IS NOT NULL")
    top = Q.top_groups(links, "target_id", 1).first()["target_id"]
    tuples = links.select(F.col("source_id").alias("pl_from"), F.when(F.col("source_id") % 5 == 0, 1).otherwise(0).alias("pl_from_namespace"), F.col("target_id").alias("pl_target_id"))
    return G.inlink_counts(G.inlinks(tuples, table(spark, sf, "page_tbl"), top))


def _view_lines(spark: SparkSession, sf: str) -> Frame:
    v = table(spark, sf, "pageviews")
    return v.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("project", "title", "domain", "device", "view_count", "hourly")]).alias("value"))


def view_files(spark: SparkSession, sf: str) -> Frame:
    """Page-view lines from gzipped files, summed by title."""
    path = _folder(spark, "views")
    _view_lines(spark, sf).write.option("compression", "gzip").text(path)
    return wiki.read_views(spark, path)


def streamed_views(spark: SparkSession, sf: str) -> Frame:
    """The same by the stream, which is started twice and takes each file once."""
    path, out, state = (_folder(spark, n) for n in ("views", "out", "state"))
    _view_lines(spark, sf).write.text(path)
    for _ in range(2):
        ingest_views(spark, path, out, state)
    return total_views(spark, out)


def month_files(spark: SparkSession, sf: str) -> Frame:
    """Names of the daily files of every month that has orders."""
    months = [tuple(r) for r in table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct().collect()]
    return spark.createDataFrame([(y, m, f) for y, m in months for f in wiki.day_files(y, m)], "year int, month int, file string")


def file_sets(spark: SparkSession, sf: str) -> Frame:
    """Which of the files of parts are taken: the plain twin of a compressed one, and none that is done."""
    parts = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    paths = [f"chunk_{p:04d}.xml" for p in parts if p % 2 == 0] + [f"chunk_{p:04d}.xml.bz2" for p in parts]
    return spark.createDataFrame([(f,) for f in wiki.resolve_files(paths, {"chunk_0001.xml.bz2"})], "file string")


QUERIES = {f.__name__: f for f in (xml_pages, admitted, skip_reasons, page_features, page_edges, text_backlinks, tuple_backlinks, dump_estimate, page_inlinks, view_files, streamed_views, month_files, file_sets)}

_P = "SELECT DISTINCT page_id, title, text, CASE WHEN page_id % 7 = 0 THEN 1 ELSE namespace END AS ns, page_id % 3 = 0 AS redirected FROM article"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{[^}]*\}\}', '', 'g'), '(?s)<ref[^>]*>.*?</ref>', '', 'g'), '<ref[^>]*/>', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\[http[^\]]*\]', '', 'g'), '<[^>]+>', '', 'g'), 'WS+', ' ', 'g'), '^WS+|WS+$', '', 'g')".replace("WS", _WS)
_STRIPPED = f"regexp_replace(title, '^{_WS}+|{_WS}+$', '', 'g')"
_REASON = f"""CASE WHEN coalesce({_STRIPPED}, '') = '' THEN 'no_title' WHEN page_id IS NULL THEN 'no_id' WHEN coalesce(redirected, FALSE) THEN 'redirect' WHEN coalesce(text, '') = '' THEN 'no_text'
WHEN coalesce(ns, 0) <> 0 THEN 'namespace' WHEN title LIKE 'List of %' OR title LIKE 'List\\_of\\_%' ESCAPE '\\' THEN 'list' WHEN contains(lower(title), '(disambiguation)') THEN 'disambiguation' WHEN length({_CLEAN}) < 100 THEN 'short' ELSE 'admitted' END"""
_UNDERSCORED = f"replace({_STRIPPED}, ' ', '_')"
_SKIP = r"""regexp_matches(lower(t), '^(list_of_|index_of_|glossary_of_|outline_of_|timeline_of_|rosters_of_|history_of_|bibliography_of_|discography_of_)') OR regexp_matches(t, '^[0-9]{4}[-_]') OR (regexp_matches(lower(t), 'revision_act|_act_') AND regexp_matches(lower(t), 'statute|law|revision'))
OR (regexp_matches(lower(t), 'honours|awards') AND regexp_matches(lower(t), 'birthday|new_year|queens|kings')) OR regexp_matches(lower(t), '_in_[0-9]{4}$') OR (contains(lower(t), 'commemorative') AND contains(lower(t), 'coin')) OR contains(lower(t), '(disambiguation)')"""
_MAIN = f"SELECT * FROM ({_P}) WHERE coalesce(ns, 0) = 0 AND NOT coalesce(redirected, FALSE)"
_LINKS = r"regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)"


def _norm(x: str) -> str:
    strip = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    return f"nullif(lower(replace({strip('split_part(' + strip(x) + ', ' + chr(39) + '#' + chr(39) + ', 1)')}, ' ', '_')), '')"


_SPECIAL = "^(file:|image:|category:|template:|wikipedia:|help:|portal:|user:|talk:|mediawiki:|special:{})"
_TARGETS = f"SELECT page_id AS source_id, {_norm('x')} AS target FROM (SELECT page_id, unnest({_LINKS}) AS x FROM ({_MAIN}))"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY embedding_timestamp DESC NULLS LAST, pagerank NULLS LAST, lookup_title NULLS LAST) AS i FROM articles WHERE article_id IS NOT NULL) WHERE i = 1"
_LINES = "SELECT concat_ws(' ', coalesce(project, '-'), coalesce(title, '-'), coalesce(domain, '-'), coalesce(device, '-'), coalesce(CAST(view_count AS VARCHAR), '-'), coalesce(hourly, '-')) AS value FROM pageviews"
_FIELDS = f"SELECT regexp_split_to_array(regexp_replace(value, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+') AS f FROM ({_LINES})"
_DECODED = "coalesce(try(url_decode(f[2])), url_decode(regexp_replace(f[2], '%[89A-Fa-f][0-9A-Fa-f]', chr(65533), 'g')))"
_SUMS = f"""SELECT lower({_DECODED}) AS lookup_title, CAST(sum(TRY_CAST(f[5] AS BIGINT)) AS BIGINT) AS pageviews FROM ({_FIELDS})
WHERE len(f) >= 5 AND f[1] IN ('en.wikipedia', 'en') AND TRY_CAST(f[5] AS BIGINT) > 0 AND f[2] <> '-' AND NOT contains(f[2], ':') GROUP BY 1"""

ORACLES = {
    "xml_pages": f"SELECT page_id, coalesce(redirected, FALSE) AS redirected, coalesce(ns, -1) AS ns, md5(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS digest FROM ({_P}) WHERE page_id IS NOT NULL",
    "admitted": f"""SELECT page_id AS article_id, title, namespace, char_count, least(char_count, 20000) AS stored_chars, lower(title) AS lookup_title, md5(substr(clean, 1, 20000)) AS digest, CAST(length(title) + 2 + least(char_count, 2000) AS INTEGER) AS model_chars
FROM (SELECT page_id, {_UNDERSCORED} AS title, coalesce(ns, 0) AS namespace, {_CLEAN} AS clean, CAST(length({_CLEAN}) AS INTEGER) AS char_count FROM ({_P}) WHERE {_REASON} = 'admitted')""",
    "skip_reasons": f"SELECT {_REASON} AS reason, count(*) AS pages FROM ({_P}) GROUP BY 1",
    "page_features": f"""SELECT page_id AS article_id, CAST(length({_CLEAN}) AS INTEGER) AS char_count, CAST(len({_LINKS}) AS INTEGER) AS wikilink_count, '2024-01-01T00:00:00Z' AS last_revision_timestamp, CAST(len(regexp_extract_all(replace(t, '_', ' '), '[^{_WS[1:]}+')) AS INTEGER) AS title_word_count
FROM (SELECT *, {_UNDERSCORED} AS t FROM ({_MAIN}) WHERE coalesce(text, '') <> '') WHERE NOT coalesce({_SKIP}, FALSE)""",
    "page_edges": f"SELECT DISTINCT source_id, target_id FROM (SELECT source_id, target FROM ({_TARGETS}) WHERE target IS NOT NULL AND NOT regexp_matches(target, '{_SPECIAL.format('|draft:')}')) JOIN (SELECT lookup_title, max(article_id) AS target_id FROM ({_LAST}) WHERE lookup_title IS NOT NULL GROUP BY 1) ON target = lookup_title",
    "text_backlinks": f"SELECT target AS lookup_title, count(*) AS backlinks FROM ({_TARGETS}) WHERE target IS NOT NULL AND NOT regexp_matches(target, '{_SPECIAL.format('')}') GROUP BY 1",
    "tuple_backlinks": "SELECT target_id AS article_id, count(*) AS backlinks FROM pagelinks WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id % 5 <> 0 GROUP BY 1",
    "dump_estimate": "SELECT TRUE AS any_lines, TRUE AS is_product, count(*) AS tuples, 'complete' AS nine_of_ten, 'incomplete' AS eight_of_ten FROM pagelinks WHERE source_id IS NOT NULL AND target_id IS NOT NULL",
    "page_inlinks": """WITH t AS (SELECT target_id FROM pagelinks WHERE target_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, target_id LIMIT 1)
SELECT CASE WHEN source_id % 5 = 0 THEN 1 ELSE 0 END AS namespace, count(*) AS links, count(*) FILTER (source_id IN (SELECT page_id FROM page_tbl WHERE page_title IS NOT NULL)) AS named FROM pagelinks WHERE target_id = (SELECT target_id FROM t) GROUP BY 1""",
    "view_files": _SUMS,
    "streamed_views": _SUMS,
    "month_files": """SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, strftime(d, 'pageviews-%Y%m%d-user.bz2') AS file FROM
(SELECT unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders))""",
    "file_sets": "SELECT printf('chunk_%04d.xml', r_regionkey) || CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE '.bz2' END AS file FROM region WHERE r_regionkey <> 1",
}
