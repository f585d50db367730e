"""The link graph: edges, degrees, PageRank and bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.scoring import minmax100
from inkwell.operators.skew import hot_keys, salted_join
from inkwell.session import BROADCAST_ROWS, cut, drop_cut


def resolve_links(links: DataFrame, titles: DataFrame, order: str = "article_id") -> DataFrame:
    """Distinct (source_id, target_id) of links whose normalised target is a lookup_title.

    links: source_id, target (normalised). titles: lookup_title, article_id and the order in which the last row wins.
    Pairs are made distinct before the join, so a hot title costs its sources once, and these are spread over many tasks.
    """
    last = titles.where("lookup_title IS NOT NULL").groupBy("lookup_title").agg(F.max_by("article_id", order).alias("target_id"))
    pairs = links.select("source_id", F.col("target").alias("lookup_title")).distinct()
    hot = hot_keys(links.select(F.col("target").alias("lookup_title")), ["lookup_title"])
    return salted_join(pairs, last, ["lookup_title"], hot, "inner").select("source_id", "target_id").distinct()


def raw_links(links: DataFrame, draft: bool = True) -> DataFrame:
    """source_id, target of a table of raw targets, special ones dropped."""
    out = links.select("source_id", T.normalize_title(F.col("target_title")).alias("target"))
    return out.where(~T.is_special_page(F.col("target"), draft))


def page_links(pages: DataFrame) -> DataFrame:
    """G1: source_id, target of main articles' texts."""
    raw = F.col("revision.text._VALUE")
    rows = pages.where((F.coalesce("ns", F.lit(0)) == 0) & F.col("redirect").isNull())
    return raw_links(rows.select(F.col("id").alias("source_id"), F.explode(T.wikilinks(raw)).alias("target_title")))


def restrict(edges: DataFrame, vertices: DataFrame, key: str = "article_id", counted: DataFrame | None = None) -> DataFrame:
    """Edges with both ends among the vertices; the edges of a hot end are spread over many tasks.

    counted: what hot ends are counted in, if the edges themselves are dear to compute twice.
    """
    counted = edges if counted is None else counted
    ids = vertices.select(key).where(F.col(key).isNotNull()).distinct()
    for end in ("source_id", "target_id"):
        # ids are distinct, so an inner join keeps each edge once
        edges = salted_join(edges, ids.withColumnRenamed(key, end), [end], hot_keys(counted, [end]), "inner").select(*edges.columns)
    return edges


def degrees(edges: DataFrame, end: str) -> DataFrame:
    """Edges by source_id or target_id."""
    return edges.where(F.col(end).isNotNull()).groupBy(end).agg(F.count(F.lit(1)).alias("degree"))


def weights(edges: DataFrame) -> DataFrame:
    """Edges with 1/outdegree of their source."""
    out = degrees(edges, "source_id")
    return salted_join(edges, out, ["source_id"], hot_keys(edges, ["source_id"]), "inner").withColumn("weight", 1.0 / F.col("degree")).drop("degree")


def graph_stats(edges: DataFrame) -> DataFrame:
    """Edges, distinct ends and mean out-degree."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets")).withColumn("avg_out", F.round(F.try_divide(F.col("edges"), F.col("sources")), 6))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-6, every: int = 1) -> DataFrame:
    """article_id, rank (sums to 1) and pagerank (0 to 100).

    vertices: article_id. edges: distinct source_id, target_id; out-degrees count all of them, also those leaving the
    vertices, which carry no rank. Weighted edges are laid out by source once and stay so. Contributions are combined
    by target before their shuffle, so a hot target costs one partial sum a task. Each round is written, which cuts the
    lineage, as its sum is needed besides; tolerance (summed change, None: all rounds) is looked at every `every` rounds.
    Empty vertices give none.
    """
    ids = cut(vertices.where("article_id IS NOT NULL").select("article_id").distinct(), "vertices")
    n = ids.count()
    if not n:
        return ids.select("article_id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("pagerank"))
    edges = cut(edges.where("source_id IS NOT NULL").select("source_id", "target_id"), "edges")
    w = cut(restrict(weights(edges), ids, counted=edges).repartition("source_id"), "weights")
    drop_cut(edges)
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    held = None
    for i in range(1, iterations + 1):
        flow = w.join(rank.withColumnRenamed("article_id", "source_id"), "source_id").groupBy(F.col("target_id").alias("article_id")).agg(F.sum(F.col("rank") * F.col("weight")).alias("flow"))
        raw = cut(ids.join(flow, "article_id", "left").select("article_id", (damping * F.coalesce("flow", F.lit(0.0)) + (1 - damping) / n).alias("raw")), "rank")
        rank_next = raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("s")))).select("article_id", (F.col("raw") / F.col("s")).alias("rank"))
        change = None
        if tolerance is not None and (i % every == 0 or i == iterations):
            change = rank_next.join(rank.withColumnRenamed("rank", "old"), "article_id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        drop_cut(held)
        held, rank = raw, rank_next
        if change is not None and change < tolerance:
            break

    bounds = F.broadcast(rank.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")))
    return rank.crossJoin(bounds).select("article_id", "rank", minmax100(F.col("rank"), F.col("lo"), F.col("hi")).alias("pagerank"))


def expand(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """Id, hop of everything reached from start (id) within some hops; each id at its least hop.

    A frontier of proven small size is broadcast, a larger one is joined by a shuffle.
    """
    seen = start.select("id").where("id IS NOT NULL").distinct().withColumn("hop", F.lit(0))
    frontier = cut(seen, "hop")
    found = frontier
    for hop in range(1, hops + 1):
        n = frontier.count()
        if not n:
            break
        side = frontier.select(F.col("id").alias("source_id"))
        side = F.broadcast(side) if n <= BROADCAST_ROWS else side
        step = edges.join(side, "source_id", "left_semi").select(F.col("target_id").alias("id")).where("id IS NOT NULL").distinct()
        frontier = cut(step.join(found.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        found = found.unionByName(frontier)
    return found


def beam(edges: DataFrame, start: DataFrame, score: str, per_node: int = 3, width: int = 5, depth: int = 2) -> DataFrame:
    """Id, hop explored from start by the best edges of each node; the next level goes on from `width` of them."""
    best = Window.partitionBy("source_id").orderBy(F.desc(score), "target_id")
    frontier = start.select("id").distinct().withColumn("hop", F.lit(0))
    found = frontier
    for hop in range(1, depth + 1):
        front = F.broadcast(frontier.orderBy("id").limit(width).select(F.col("id").alias("source_id")))
        step = edges.join(front, "source_id").withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_node).select(F.col("target_id").alias("id")).distinct()
        frontier = cut(step.join(found.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "beam")
        found = found.unionByName(frontier)
    return found


def sparsity(edges: int, vertices: int) -> float:
    """Percentage of absent edges."""
    return 100.0 * (1 - edges / vertices**2) if vertices else 0.0


def inlinks(tuples: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    """The tuples that lead to a page, with the title of their source where the page table has it."""
    rows = tuples.where(F.col("pl_target_id") == page_id).select(F.col("pl_from").alias("page_id"), F.col("pl_from_namespace").alias("namespace"))
    return rows.join(pages.groupBy("page_id").agg(F.min("page_title").alias("title")), "page_id", "left")


def inlink_counts(links: DataFrame) -> DataFrame:
    """Rows of inlinks() by namespace of their source, and how many of them have a title."""
    return links.groupBy("namespace").agg(F.count(F.lit(1)).alias("links"), F.count("title").alias("named"))


def find_path(edges: DataFrame, start: int, target: int, hops: int = 3) -> DataFrame:
    """One row success, hops, path: a shortest path (ids) from start to target, if one is within some hops.

    Of several the one with the least ids, looked at from the target backwards. A start that is the target is 0 hops
    away; where nothing leads there, success is false, hops and path are null. Each hop keeps one parent for each id it
    reaches, so the path is walked back along at most `hops` rows.
    """
    spark = edges.sparkSession
    level = cut(spark.createDataFrame([(start, None, 0)], "id bigint, parent bigint, hop int"), "path")
    levels, seen = [level], level
    for hop in range(1, hops + 1):
        if seen.where(F.col("id") == target).limit(1).count():
            break
        side = level.select(F.col("id").alias("source_id"))
        side = F.broadcast(side) if level.count() <= BROADCAST_ROWS else side
        step = edges.join(side, "source_id").where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent"))
        level = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "path")
        levels.append(level)
        seen = seen.unionByName(level)
    path = []
    at = next((i for i, x in enumerate(levels) if x.where(F.col("id") == target).limit(1).count()), None)
    if at is not None:
        path = [target]
        for x in reversed(levels[1 : at + 1]):
            path.insert(0, x.where(F.col("id") == path[0]).first()["parent"])
    return spark.createDataFrame([(at is not None, at, path or None)], "success boolean, hops int, path array<bigint>")
