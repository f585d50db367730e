"""Most similar vectors for every vector: a block matrix join over int8 tiles with error bounds (problem 7).

Vectors become unit length and then int8 numbers with a scale and the length of their rounding error. Tiles of two
blocks are multiplied in float32, which NumPy is fast at, so a similarity is known up to the two rounding errors and
that of the product (slack()); pairs that may qualify are computed again in double from the vectors as they came. Every
pair of vectors is in exactly one tile; blocks go by a hash of the id, so none grows with a hot value.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

#: Rows of a block: a tile's task holds two, as int8 and float32.
BLOCK_ROWS = 50_000
#: Rows whose products with a block are in memory at once, for pairs over a threshold and for the k nearest.
STRIP, NEAREST_STRIP = 256, 64
_QUANTISED = "id bigint, v array<float>, norm double, q binary, scale float, err float"
_BOUNDS = "a bigint, b bigint, low float, high float"


def slack(dim: int) -> float:
    """More than a float32 product of two vectors of at most unit length can be off: dim roundings of 2**-24 each of a
    sum of magnitudes that is 1 at most, twice over, and a few for the scales."""
    return (dim + 8) * 2.0**-23


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """id, v, norm, q, scale, err of every usable vector, one for each id.

    Null ids and vectors, vectors of another length, with null, NaN or infinite parts, and of norm 0 are left out.
    Repeated rows count once; of different vectors under one id the one of the smallest hash stays.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") == dim) & ~bad)
    one = rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b["v"].to_numpy()).astype(np.float64)
            length = np.sqrt((m * m).sum(axis=1))
            m /= np.abs(m).max(axis=1, keepdims=True).clip(1e-300)
            norm = np.sqrt((m * m).sum(axis=1))
            keep = norm > 0
            m = m[keep] / norm[keep, None]
            scale = (np.abs(m).max(axis=1) / 127).astype(np.float32)
            q = np.rint(m / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
            err = np.sqrt(((m - q * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) * (1 + 1e-6) + 1e-7
            yield pd.DataFrame({"id": b["id"].to_numpy()[keep], "v": b["v"].to_numpy()[keep], "norm": length[keep], "q": [r.tobytes() for r in q], "scale": scale, "err": err.astype(np.float32)})

    return one.mapInPandas(quantise, _QUANTISED)


def _tiles(vectors: DataFrame, blocks: int) -> DataFrame:
    """Every vector in the tiles of its block with each block, as tile number and the side it is on."""
    b = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = vectors.select("id", "q", "scale", "err", b.alias("b")).withColumn("o", other)
    return rows.select((F.least("b", "o") * blocks + F.greatest("b", "o")).alias("tile"), (F.col("b") <= F.col("o")).alias("first"), "id", "q", "scale", "err")


def _sides(pdf: pd.DataFrame, diagonal: bool) -> list[tuple]:
    """ids, float32 matrix of whole numbers, scales and errors of a tile's two sides."""
    out = []
    for part in [pdf, pdf] if diagonal else [pdf[pdf["first"]], pdf[~pdf["first"]]]:
        m = np.frombuffer(b"".join(part["q"]), np.int8).reshape(len(part), -1).astype(np.float32) if len(part) else np.zeros((0, 1), np.float32)
        out.append((part["id"].to_numpy(), m, part["scale"].to_numpy(np.float32), part["err"].to_numpy(np.float32)))
    return out


def _blocks(n: int) -> int:
    """Blocks by rows, and at least so many that the tiles keep the cluster busy while blocks are small."""
    return max(-(-n // BLOCK_ROWS), min(8, max(1, n // 2_000)), 1)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, dim: int = 64, block_rows: int | None = None) -> DataFrame:
    """a, b, cosine of all pairs a < b of usable vectors with a cosine of at least `threshold`; no pair is lost."""
    vectors = cut(usable_vectors(df, key, vector, dim), "vectors")
    n = vectors.count()
    blocks = max(1, -(-n // block_rows) if block_rows else _blocks(n))

    def screen(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        diagonal = key_[0] // blocks == key_[0] % blocks
        (ia, ma, sa, ea), (ib, mb, sb, eb) = _sides(pdf, diagonal)
        a, b = [], []
        if len(ia) and len(ib):
            worst = float(eb.max())
            mbt = np.ascontiguousarray((mb * sb[:, None]).T)
            for i in range(0, len(ia), STRIP):
                s = slice(i, i + STRIP)
                least = (threshold - ea[s] - worst * (1 + ea[s]) - slack(dim)) / sa[s]
                hit = np.flatnonzero((ma[s] @ mbt) >= least[:, None])
                r, c = np.divmod(hit, len(ib))
                x, y = ia[s][r], ib[c]
                keep = (x < y) if diagonal else (x != y)
                a.append(np.minimum(x, y)[keep])
                b.append(np.maximum(x, y)[keep])
        return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    spread = _tiles(vectors, blocks).repartition(max(1, blocks * (blocks + 1) // 2), "tile")
    maybe = spread.groupBy("tile").applyInPandas(screen, "a bigint, b bigint")
    return _exact(maybe, vectors).where(F.col("cosine") >= threshold)


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosines of pairs, in double from their vectors."""
    one = vectors.select(F.col("id").alias("a"), F.col("v").alias("u"), F.col("norm").alias("m"))
    two = vectors.select(F.col("id").alias("b"), F.col("v").alias("w"), F.col("norm").alias("n"))
    joined = pairs.join(one, "a").join(two, "b")
    dot = F.aggregate(F.zip_with("u", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return joined.select("a", "b", (dot / F.col("m") / F.col("n")).alias("cosine"))


def _merged(tiles: DataFrame, k: int) -> DataFrame:
    """a, b that may be among the k most similar ones given the bounds of all tiles: a heap of the k greatest lower
    bounds for each vector says how high an upper bound must reach."""

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in _with_end(batches):
            if b is not None:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                if not len(b):
                    continue
                # the last vector may go on in the next batch
                held = b[b["a"] == b["a"].iloc[-1]]
                b = b[b["a"] != b["a"].iloc[-1]]
            elif held is None:
                continue
            else:
                b = held
            floors = {a: heapq.nlargest(k, g)[-1] if len(g) >= k else -np.inf for a, g in b.groupby("a")["low"]}
            keep = b["high"].to_numpy() >= b["a"].map(floors).to_numpy(np.float64) if len(b) else np.zeros(0, bool)
            yield b.loc[keep, ["a", "b"]]

    return tiles.repartition("a").sortWithinPartitions("a").mapInPandas(survivors, "a bigint, b bigint")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def nearest(df: DataFrame, key: str, vector: str, k: int, dim: int = 64, block_rows: int | None = None) -> DataFrame:
    """id, neighbour, rank, cosine: the k most similar other vectors of every usable vector, ties by the smaller id.

    A tile passes on, for each of its vectors, the bounds of all that may be among the k best of the other block given
    both errors. A heap for each vector merges the tiles; only what may still be among the k best of all is computed
    again. Fewer than k others give fewer rows.
    """
    vectors = cut(usable_vectors(df, key, vector, dim), "vectors")
    n = vectors.count()
    blocks = max(1, -(-n // block_rows) if block_rows else _blocks(n))

    def best(ids: np.ndarray, m: np.ndarray, s: np.ndarray, e: np.ndarray, oids: np.ndarray, om: np.ndarray, os_: np.ndarray, oe: np.ndarray) -> list[tuple]:
        out = []
        omt = np.ascontiguousarray((om * os_[:, None]).T)
        for i in range(0, len(ids), NEAREST_STRIP):
            t = slice(i, i + NEAREST_STRIP)
            p = (m[t] @ omt) * s[t][:, None]
            p[ids[t][:, None] == oids[None, :]] = -2.0
            off = e[t][:, None] + oe[None, :] * (1 + e[t][:, None]) + slack(dim)
            low, high = p - off, p + off
            j = min(k, len(oids))
            floor = np.partition(low, len(oids) - j, axis=1)[:, len(oids) - j]
            r, c = np.nonzero((high >= floor[:, None]) & (p > -1.5))
            out.append((ids[t][r], oids[c], low[r, c], high[r, c]))
        return out

    def tile(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        diagonal = key_[0] // blocks == key_[0] % blocks
        one, two = _sides(pdf, diagonal)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))]
        if len(one[0]) and len(two[0]):
            out += best(*one, *two)
            if not diagonal:
                out += best(*two, *one)
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("a", "b", "low", "high"))})

    spread = _tiles(vectors, blocks).repartition(max(1, blocks * (blocks + 1) // 2), "tile")
    maybe = _merged(spread.groupBy("tile").applyInPandas(tile, _BOUNDS), k)
    top = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return _exact(maybe, vectors).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "rank", "cosine")
