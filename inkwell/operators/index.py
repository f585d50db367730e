"""Vector search: exact scan, inverted lists with product quantisation, and the similarity mesh.

The coarse and the product quantisers are fitted on a bounded sample (TRAIN_ROWS, a documented parameter); every row is
indexed. Lists are a partition column of the stored index, so a search reads only those it probes. How many it probes is
chosen when the index is built, by the recall of a sample of its own rows against the exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.vectors import dot, is_finite, l2_normalize
from inkwell.session import cut, drop_cut

#: Most rows that the quantisers are fitted on.
TRAIN_ROWS = 100_000
#: Queries, and bytes of what they send along, that one pass over the index answers at most: what the driver holds and
#: sends to the tasks at once.
QUERY_BLOCK, QUERY_BYTES = 50_000, 2**25
#: Queries that a batch of the index is multiplied with at once.
QUERY_STRIP = 512
#: Mean recall that a built index must reach on its sample: 0.9, and 0.02 for the error of the sample.
RECALL = 0.92
#: Rows of the index, those of the smallest id hashes, that are asked for their RECALL_K nearest to measure it.
RECALL_QUERIES, RECALL_K = 500, 10
#: Fewest lists probed and smallest pool, as in the reference.
PROBES, POOL = 32, 200
#: Rows of the fit whose distances to all centres are in memory at once.
KMEANS_STRIP = 4_096
#: Candidates that a task of a search holds before it drops those beyond the pool.
HELD = 2_000_000


def _by_blocks(queries: DataFrame, numbers: int, search: Callable[[np.ndarray, np.ndarray], tuple[DataFrame, Broadcast]]) -> list[DataFrame]:
    """What `search` finds for the ids and vectors of the queries, in blocks by a hash of the id, however many there are.

    A block has at most QUERY_BLOCK queries and QUERY_BYTES of the `numbers` that each query sends along. Where there are several, the hits of each are
    written before the next block is read, so the driver and the tasks hold one at a time.
    """
    n = queries.count()
    blocks = max(1, -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, numbers))))))
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        rows = part.select("query", "unit").orderBy("query").collect()
        if rows:
            hits, shared = search(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64))
            if blocks > 1:
                hits = cut(hits, "hits")
                shared.unpersist()
            parts.append(hits)
    return parts


def flat_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Id, unit vector (doubles) of every usable row, one for each id; unusable vectors are left out."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(is_finite(F.col("v"))).select("id", l2_normalize(F.col("v")).alias("unit")).where("unit IS NOT NULL")
    return rows.groupBy("id").agg(F.min("unit").alias("unit"))


def search_exact(index: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Query, id, rank, score: the k nearest of each query (query, unit) by cosine.

    The queries are multiplied with the index block by block: a block of QUERY_BLOCK queries goes to every task, each
    keeps its k best a query, and these are merged. No queries, or an empty index, give no rows.
    """
    first = queries.select("unit").first()
    parts = _by_blocks(queries, len(first["unit"]) if first else 1, lambda names, matrix: _search_block(index, names, matrix, k, exclude_self))
    near = reduce(DataFrame.unionByName, parts) if parts else index.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank", "score")


def _search_block(index: DataFrame, names: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool) -> tuple[DataFrame, Broadcast]:
    shared = index.sparkSession.sparkContext.broadcast((names, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        held: pd.DataFrame | None = None
        for b in batches:
            if not len(b) or not len(ids):
                continue
            units, own = np.stack(b["unit"].to_numpy()), b["id"].to_numpy()
            found = []
            for i in range(0, len(ids), QUERY_STRIP):
                some = ids[i : i + QUERY_STRIP]
                scores = units @ m[i : i + QUERY_STRIP].T
                if exclude_self:
                    scores[own[:, None] == some[None, :]] = -np.inf
                j = min(k, len(own))
                # all that tie with the last one come along, so that the smaller id can win
                floor = np.partition(scores, len(own) - j, axis=0)[len(own) - j]
                r, c = np.nonzero((scores >= floor[None, :]) & (scores > -np.inf))
                found.append(pd.DataFrame({"query": some[c], "id": own[r], "score": scores[r, c]}))
            new = pd.concat(found)
            new = new if held is None else pd.concat([held, new])
            held = new.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
        if held is not None:
            yield held

    return index.select("id", "unit").mapInPandas(best, "query bigint, id bigint, score double"), shared


def cluster_count(n: int) -> int:
    """M8: square root of the rows, at most one list for 39 rows, at least 1."""
    return max(1, min(int(n**0.5), n // 39))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of a bounded sample; empty ones move to far rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at, far = np.empty(len(x), np.int64), np.empty(len(x))
        for i in range(0, len(x), KMEANS_STRIP):
            d = (centres**2).sum(1)[None, :] - 2 * x[i : i + KMEANS_STRIP] @ centres.T
            at[i : i + KMEANS_STRIP], far[i : i + KMEANS_STRIP] = d.argmin(1), d.min(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (n == 0).any():
            centres[n == 0] = x[np.argsort(-far)[: (n == 0).sum()]]
    return centres


@dataclass
class IvfPq:
    """V5 to V8: inverted lists over `lists` centres, and codes of `parts` sub-vectors by up to 256 centres each."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    rows: DataFrame | None = None
    probes: int = PROBES
    pool: int = POOL

    @classmethod
    def train(cls, index: DataFrame, lists: int | None = None, parts: int = 16, codes: int = 256, sample: int = TRAIN_ROWS) -> IvfPq:
        """Fit on at most `sample` rows, those of the smallest id hashes (the same on every run)."""
        n = index.count()
        rows = index.orderBy(F.xxhash64("id")).limit(sample).select("unit").collect() if n > sample else index.select("id", "unit").orderBy("id").collect()
        x = np.array([r["unit"] for r in rows], dtype=np.float64)
        centres = _kmeans(x, lists or cluster_count(n))
        rest = x - centres[(x @ centres.T - (centres**2).sum(1) / 2).argmax(1)]
        width = x.shape[1] // parts
        return cls(centres, [_kmeans(rest[:, i * width : (i + 1) * width], codes, seed=i) for i in range(parts)])

    def add(self, index: DataFrame) -> IvfPq:
        """Index every row: list, code (one byte a part) and the unit vector for re-ranking; then tune the search."""
        centres, books = self.centres, self.codebooks
        width = centres.shape[1] // len(books)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["unit"].to_numpy()).astype(np.float64)
                at = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
                rest = x - centres[at]
                code = np.stack([((c**2).sum(1)[None, :] - 2 * rest[:, i * width : (i + 1) * width] @ c.T).argmin(1) for i, c in enumerate(books)], 1).astype(np.uint8)
                yield pd.DataFrame({"id": b["id"], "unit": b["unit"], "code": [r.tobytes() for r in code], "list": at.astype(np.int32)})

        self.rows = cut(index.select("id", "unit").mapInPandas(encode, "id bigint, unit array<double>, code binary, list int"), "ivf")
        self._tune(index)
        return self

    def _tune(self, index: DataFrame) -> None:
        """Set probes and pool so that RECALL_QUERIES rows find RECALL of their RECALL_K nearest by search_exact().

        First as many probes as reach the lists of that many neighbours; then, as codes lose some too, a search is
        measured, and lists and pool grow until it finds enough. With all lists and all rows it finds everything.
        """
        sample = index.orderBy(F.xxhash64("id"), "id").limit(RECALL_QUERIES).select(F.col("id").alias("query"), "unit")
        sample = index.sparkSession.createDataFrame(sample.collect(), sample.schema)
        truth = cut(search_exact(index, sample, RECALL_K), "truth")
        near = truth.join(self.rows.select("id", "list"), "id").join(sample, "query").select("list", "unit").collect()
        if not near:
            return
        m = np.array([r["unit"] for r in near])
        scores = m @ self.centres.T - (self.centres**2).sum(1) / 2
        before = (scores > scores[np.arange(len(near)), [r["list"] for r in near]][:, None]).sum(1)
        lists, n = len(self.centres), self.rows.count()
        self.probes = min(lists, max(self.probes, int(np.sort(before)[int(np.ceil(RECALL * len(before))) - 1]) + 1))
        while recall(self.search(sample, RECALL_K), truth).first()[0] < RECALL and (self.probes < lists or self.pool < n):
            self.probes, self.pool = min(lists, self.probes + -(-lists // 20)), min(n, self.pool * 5 // 4)
        drop_cut(truth)

    def save(self, path: str) -> None:
        """V9, K9: rows by list, so that probing prunes partitions; the centres beside them."""
        self.rows.repartition("list").write.partitionBy("list").mode("overwrite").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        made = [(i, "centre", c.tolist()) for i, c in enumerate(self.centres)] + [(i * 256 + j, "code", c.tolist()) for i, b in enumerate(self.codebooks) for j, c in enumerate(b)]
        made.append((0, "search", [float(self.probes), float(self.pool)]))
        spark.createDataFrame(made, "n int, kind string, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark, path: str) -> IvfPq:  # noqa: ANN001
        """An index written by save()."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("n").collect()
        centres = np.array([r["v"] for r in rows if r["kind"] == "centre"])
        books: dict[int, list] = {}
        for r in rows:
            if r["kind"] == "code":
                books.setdefault(r["n"] // 256, []).append(r["v"])
        tuned = [int(x) for r in rows if r["kind"] == "search" for x in r["v"]]
        return cls(centres, [np.array(books[i]) for i in sorted(books)], spark.read.parquet(f"{path}/rows"), *tuned)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, pool: int | None = None, exclude_self: bool = True) -> DataFrame:
        """query, id, rank, score: the k best of a pool that the codes choose from the probed lists.

        Each query meets the rows of its `probes` nearest lists only; distances by table look-up choose `pool` of them,
        and these are ranked by their vectors. Both are as tuned where not given, which holds for k up to RECALL_K.
        Queries (query, unit) are taken in blocks of QUERY_BLOCK.
        """
        probes, pool = probes or self.probes, pool or self.pool
        # its vector, its product with each centre, and that of each part with each code
        numbers = self.centres.shape[1] + len(self.centres) + sum(map(len, self.codebooks))
        parts = _by_blocks(queries, numbers, lambda names, m: self._search_block(names, m, probes, pool, exclude_self))
        hits = reduce(DataFrame.unionByName, parts) if parts else self.rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("guess"), F.lit(0.0).alias("score")).limit(0)
        pooled = hits.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "id"))).where(F.col("n") <= pool)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return pooled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank", "score")

    def _search_block(self, names: np.ndarray, m: np.ndarray, probes: int, pool: int, exclude_self: bool) -> tuple[DataFrame, Broadcast]:
        near = m @ self.centres.T - (self.centres**2).sum(1) / 2
        probed = np.argsort(-near, axis=1)[:, : min(probes, len(self.centres))]
        by_list: dict[int, list[int]] = {}
        for i, lists in enumerate(probed):
            for c in lists:
                by_list.setdefault(int(c), []).append(i)
        width = m.shape[1] // len(self.codebooks)
        tables = [m[:, i * width : (i + 1) * width] @ b.T for i, b in enumerate(self.codebooks)]
        coarse = m @ self.centres.T
        shared = self.rows.sparkSession.sparkContext.broadcast((names, m, by_list, tables, coarse))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors, by, tab, first = shared.value
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def best() -> list[tuple[np.ndarray, ...]]:
                """The pool of each query among what is held: query number, id, guess, score."""
                if not held:
                    return []
                q, i, g, s = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((i, -g, q))
                q = q[order]
                starts = np.searchsorted(q, q)
                keep = np.arange(len(q)) - starts < pool
                return [(q[keep], *(x[order][keep] for x in (i, g, s)))]

            for b in batches:
                for c, part in b.groupby("list"):
                    code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    units, own = np.stack(part["unit"].to_numpy()), part["id"].to_numpy()
                    asked = np.array(by.get(int(c), []), dtype=np.int64)
                    for j in range(0, len(asked), QUERY_STRIP):
                        some = asked[j : j + QUERY_STRIP]
                        guess = first[some, c][:, None] + sum(tab[p][some][:, code[:, p]] for p in range(code.shape[1]))
                        if exclude_self:
                            guess[ids[some][:, None] == own[None, :]] = -np.inf
                        if len(own) > pool:
                            # all that tie with the last one come along, so that the smaller id can win
                            floor = np.partition(guess, len(own) - pool, axis=1)[:, len(own) - pool]
                        else:
                            floor = np.full(len(some), -np.inf)
                        r, col = np.nonzero((guess >= floor[:, None]) & (guess > -np.inf))
                        held.append((some[r], own[col], guess[r, col], (vectors[some] @ units.T)[r, col]))
                        size += len(r)
                        if size > HELD:
                            held = best()
                            # where the pools alone are nearly as many, the next drop waits for as many again
                            size = min(len(held[0][0]), HELD // 2)
            for q, i, g, s in best():
                yield pd.DataFrame({"query": ids[q], "id": i, "guess": g, "score": s})

        return self.rows.where(F.col("list").isin(sorted(by_list))).mapInPandas(look, "query bigint, id bigint, guess double, score double"), shared


#: Rows under which an index stays flat.
FLAT_ROWS = 1_000


def build(index: DataFrame, parts: int = 16) -> IvfPq | None:
    """V9: the inverted index, or None where the flat one is small enough to be searched as it is."""
    return None if index.count() < FLAT_ROWS else IvfPq.train(index, parts=parts).add(index)


def search(index: DataFrame, built: IvfPq | None, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest by the inverted index, or by the flat one where there's none."""
    return search_exact(index, queries, k) if built is None else built.search(queries, k)


def reconstruct(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Id and unit vector of given ids; unknown ones give no row."""
    return index.join(ids.select("id").distinct(), "id", "left_semi").select("id", "unit")


def consistency(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Ids of the table and of the index, those only in one of them, and whether both hold the same."""
    a = articles.select(F.col("article_id").alias("id"), F.lit(1).alias("a")).where("id IS NOT NULL").distinct()
    b = index.select("id", F.lit(1).alias("b")).distinct()
    row = a.join(b, "id", "full").agg(F.count("a").alias("articles"), F.count("b").alias("vectors"), F.count_if(F.col("b").isNull()).alias("without_vector"), F.count_if(F.col("a").isNull()).alias("without_article"))
    return row.withColumn("consistent", (F.col("without_vector") == 0) & (F.col("without_article") == 0))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean share of each query's true neighbours (query, id) that were found."""
    hit = truth.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).agg(F.avg("recall").alias("recall"))


def mesh(candidates: DataFrame, context: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Source, target, score of candidates and candidates or context (id, unit) more similar than a threshold.

    Results of one search: a few hundred rows, as its caller limits them; the join's build side is their union.
    """
    other = candidates.select("id", "unit").unionByName(context.select("id", "unit")).dropDuplicates(["id"])
    a = candidates.select(F.col("id").alias("source"), F.col("unit").alias("u"))
    b = F.broadcast(other.select(F.col("id").alias("target"), F.col("unit").alias("w")))
    score = dot(F.col("u"), F.col("w"))
    return a.join(b, F.col("source") != F.col("target")).withColumn("score", score).where(F.col("score") > threshold).select("source", "target", "score")
