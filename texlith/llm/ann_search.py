"""Approximate nearest neighbours by collision counting over single projections (query-aware hashing).

Each block keeps, for each of m random directions, its vectors' projections in order. A query's buckets are windows
around its own projections; virtual rehashing widens all of them by a factor each round. A vector that has fallen into
at least a set share of the windows is verified by its exact inner product; rounds end when k verified vectors lie
within a set share of the radius that the windows stand for. Once so many are verified that further rounds would cost
more than the rest of the block, the rest is verified too. With one more component (vectors.lifted) the nearest vectors
are those with the largest inner product.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from texlith.llm.vectors import lifted, searched, usable


class CollisionIndex:
    """Sorted projections of a block.

    width: of a window, in radii; a vector at the radius collides with probability 2 * Phi(width / 2) - 1, and the
    threshold lies below that share of the directions by `margin`.
    """

    def __init__(self, points: np.ndarray, directions: int = 32, width: float = 2.0, margin: float = 0.0, seed: int = 11):
        self.points, self.width = points, width
        self.axes = np.random.default_rng(seed).standard_normal((points.shape[1], directions))
        spread = points @ self.axes
        self.order = np.ascontiguousarray(spread.argsort(axis=0, kind="stable").T)
        ordered = np.take_along_axis(spread.T, self.order, axis=1)
        # One array for all directions, each in a range of its own, so that a round looks all its windows up at once.
        self.apart = 4 * (1 + float(np.abs(spread).max()))
        self.sorted = (ordered + self.apart * np.arange(directions)[:, None]).ravel()
        self.base = len(points) * np.arange(directions)
        self.threshold = int(np.ceil((2 * NormalDist().cdf(width / 2) - 1 - margin) * directions))

    def candidates(self, query: np.ndarray, k: int, enough: int, verify, start: float = 0.8, factor: float = 1.25, sure: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
        """Verified rows and their distances from `query`. verify(rows) gives distances."""
        n = len(self.points)
        centre = query @ self.axes
        ranges = self.apart * np.arange(len(centre))
        low = high = np.searchsorted(self.sorted, np.clip(centre, -self.apart / 2, self.apart / 2) + ranges)
        hits = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        rows, far = [np.zeros(0, np.int64)], [np.zeros(0)]
        verified, radius, order = 0, start, self.order.ravel()
        while True:
            half = self.width * radius / 2
            ends = [np.searchsorted(self.sorted, np.clip(centre + s, -self.apart / 2, self.apart / 2) + ranges) for s in (-half, half)]
            left, right = np.minimum(ends[0], low), np.maximum(ends[1], high)
            parts = [order[a:b] for a, b in zip(left.tolist(), low.tolist(), strict=True)] + [order[a:b] for a, b in zip(high.tolist(), right.tolist(), strict=True)]
            low, high = left, right
            hits += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((hits >= self.threshold) & ~done)
            if len(new):
                done[new] = True
                rows.append(new)
                far.append(verify(new))
                verified += len(new)
            whole = (low == self.base).all() and (high == self.base + n).all()
            if whole or verified >= k and np.partition(np.concatenate(far), k - 1)[k - 1] <= sure * radius:
                return np.concatenate(rows), np.concatenate(far)
            if verified >= enough:
                rest = np.flatnonzero(~done)
                return np.concatenate([*rows, rest]), np.concatenate([*far, verify(rest)])
            radius *= factor


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, share: float = 0.3, block_rows: int = 10_000, chunk_queries: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding, ...) with an id divisible by `every`, the
    k other rows found with the largest inner products in double precision, ties to the smaller vec_id.

    Once `share` of a block's rows, and k more, are verified, all others of the block are as well; all rows are
    indexed. Rows that are null or zero or hold null or non-finite components take no part; other columns aren't read.
    Copies collide alike and are verified together, however many. Empty: no rows.
    """

    def search(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        points, norm = lifted(matrix)
        points /= norm
        index, out = CollisionIndex(points), []
        for query_id, q in zip(query_ids.tolist(), queries, strict=True):
            unit = np.append(q / np.linalg.norm(q), 0)
            own = np.searchsorted(ids, [query_id, query_id + 1])
            copies = int(own[1] - own[0])

            every_sim: list[np.ndarray] = []

            def distances(some: np.ndarray, unit: np.ndarray = unit, every_sim: list[np.ndarray] = every_sim) -> np.ndarray:
                if not every_sim and 4 * len(some) > len(points):  # a long list is dearer to copy
                    every_sim.append(points @ unit)
                sims = every_sim[0][some] if every_sim else points[some] @ unit
                return np.sqrt(np.maximum(2 - 2 * sims, 0))

            rows, far = index.candidates(unit, k + copies, k + copies + int(share * len(ids)), distances)
            if len(rows) > k + copies:  # all that may be among the best; their scores are worked out exactly
                rows = rows[far <= np.partition(far, k + copies - 1)[k + copies - 1] + 1e-6]
            rows = rows[ids[rows] != query_id]
            scores = (matrix[rows] * q).sum(axis=1)
            best = np.lexsort((ids[rows], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows[best]], "score": scores[best]}))
        return pd.concat(out)

    return searched(usable(vectors, zero=False), every, k, search, "double", block_rows, chunk_queries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
