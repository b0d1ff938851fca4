"""Exact top-k by inner product: best-first search in an M-tree of each block.

With one more component all vectors of a block have the same norm (vectors.lifted), so that inner product is a metric's
order. The tree has pages of entries with a pivot, a covering radius and the distance to the parent's pivot; a search
takes the page with the smallest lower bound first, skips entries whose stored distances already exclude them by the
triangle inequality without computing any distance, and ends when no page can hold a better one. Scores are integers
and exact; bounds have a slack for rounding, and a bound equal to the worst kept score isn't cut, so that ties are whole.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm.vectors import lifted, searched, usable


class MTree:
    """Pages as arrays: of a leaf the rows and their distances to its pivot, of others pivots, radii, distances, pages."""

    def __init__(self, points: np.ndarray, leaf: int = 256, fan: int = 24):
        self.points, self.leaf, self.fan = points, leaf, fan
        self.pages: list[tuple] = []
        self._rng = np.random.default_rng(5)
        self.root = self._build(np.arange(len(points)), points[0], np.linalg.norm(points - points[0], axis=1))

    def _build(self, rows: np.ndarray, pivot: np.ndarray, far: np.ndarray) -> int:
        if len(rows) <= self.leaf:
            self.pages.append((True, rows, far))
            return len(self.pages) - 1
        chosen = self._rng.choice(len(rows), min(self.fan, -(-2 * len(rows) // self.leaf)), replace=False)
        pivots = self.points[rows[chosen]]
        squares = (pivots**2).sum(axis=1)[None] - 2 * self.points[rows] @ pivots.T
        nearest = squares.argmin(axis=1)
        if (nearest == nearest[0]).all():  # copies: pages in order
            nearest = np.arange(len(rows)) * min(self.fan, -(-len(rows) // self.leaf)) // len(rows)
        entries = []
        for k in np.unique(nearest):
            some = rows[nearest == k]
            own = np.linalg.norm(self.points[some] - pivots[k], axis=1)
            entries.append((pivots[k], own.max(), np.linalg.norm(pivots[k] - pivot), self._build(some, pivots[k], own)))
        centre, radius, parent, page = zip(*entries, strict=True)
        self.pages.append((False, np.stack(centre), np.array(radius), np.array(parent), np.array(page)))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, score, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k largest score(rows), ties to smaller rows; `skip` is no candidate (-1: none)."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        slack = 1e-9 * (1 + np.linalg.norm(query) + np.linalg.norm(self.points[0]))
        reach = np.inf
        heap = [(0.0, self.root, float(np.linalg.norm(query - self.points[0])))]
        while heap:
            bound, page, away = heapq.heappop(heap)
            if bound > reach:
                break
            kind, *held = self.pages[page]
            if kind:
                some = held[0][np.abs(away - held[1]) <= reach]
                some = some[some != skip]
                if not len(some):
                    continue
                rows, scores = np.concatenate((rows, some)), np.concatenate((scores, score(some)))
                if len(rows) >= k:
                    best = np.lexsort((rows, -scores))[:k]
                    rows, scores = rows[best], scores[best]
                    reach = float(np.linalg.norm(query - self.points[rows[-1]])) * (1 + 1e-9) + slack + 1e-6
            else:
                centre, radius, parent, pages = held
                near = np.flatnonzero(np.abs(away - parent) - radius <= reach)
                far = np.linalg.norm(centre[near] - query, axis=1)
                least = np.maximum(far - radius[near], bound)
                for i in np.flatnonzero(least <= reach).tolist():
                    heapq.heappush(heap, (float(least[i]), int(pages[near[i]]), float(far[i])))
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block_rows: int = 20_000, chunk_queries: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding, ...) with an id divisible by `every`, the
    k other rows with the largest integer inner products of floor(scale * x), ties to the smaller vec_id.

    Rows that are null or hold null or non-finite components take no part; other columns aren't read. With fewer rows
    than k all are returned. A repeated vec_id is a candidate as often as it stands, and never its own. Empty: no rows.
    Vectors meet those of their own dimension. Components so large that an inner product could leave 64 bits raise.
    """

    def search(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        floors = np.floor(matrix * scale), np.floor(queries * scale)
        largest = math.prod(float(np.abs(x).max(initial=1)) for x in floors) * matrix.shape[1]
        if not largest < 2**62:
            raise ValueError("inner products of these vectors don't fit into 64 bits")
        whole, asked = (x.astype(np.int64) for x in floors)
        exact = largest < 2**53
        floats = whole.astype(np.float64)
        points, _ = lifted(floats)
        tree = MTree(points)
        out = []
        for query_id, q in zip(query_ids.tolist(), asked, strict=True):
            own = np.searchsorted(ids, [query_id, query_id + 1])
            extra = max(0, own[1] - own[0] - 1)
            q_float = q.astype(np.float64)
            score = (lambda rows, q=q_float: (floats[rows] @ q).astype(np.int64)) if exact else (lambda rows, q=q: whole[rows] @ q)
            rows, scores = tree.search(np.append(q_float, 0), k + extra, score, int(own[0]) if own[1] > own[0] else -1)
            keep = np.flatnonzero(ids[rows] != query_id)[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows[keep]], "score": scores[keep]}))
        return pd.concat(out)

    return searched(usable(vectors), every, k, search, "long", block_rows, chunk_queries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""
