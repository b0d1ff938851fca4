"""A query set against all vectors, in blocks: what the exact and the approximate search share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, embedding, dim of rows without nulls and non-finite components; `zero` says whether zero vectors count."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & (F.size(e) > 0))
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("dim", F.size("embedding"))


def searched(rows: DataFrame, every: int, k: int, search: Callable, score: str, block_rows: int, chunk_queries: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of search(ids, matrix, query ids, queries) over all blocks.

    Rows are dealt into blocks of about `block_rows` by a hash of vec_id, queries (ids divisible by `every`) into
    chunks; each block meets each chunk in one task, whose memory is bounded by these two numbers, and sends k rows a
    query. Only the number of rows by dimension reaches the driver. Vectors meet those of their own dimension.
    """
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("q") / chunk_queries).cast("int").alias("chunks")).where("chunks > 0")
    rows = rows.join(F.broadcast(sizes), "dim")
    data = rows.select("dim", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "chunks").cast("int").alias("chunk"), "vec_id", "embedding")
    asked = asked.toDF("q_dim", "q_block", "q_chunk", "q_id", "q_embedding")

    def met(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        order = np.argsort(block["vec_id"].to_numpy(), kind="stable")
        ids = block["vec_id"].to_numpy(np.int64)[order]
        matrix = np.stack(block["embedding"].to_numpy()[order])
        return search(ids, matrix, queries["q_id"].to_numpy(np.int64), np.stack(queries["q_embedding"].to_numpy()))

    found = data.groupBy("dim", "block", "chunk").cogroup(asked.groupBy("q_dim", "q_block", "q_chunk")).applyInPandas(met, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def lifted(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with one more component that gives all the same norm, and that norm: among these, the nearest of
    (query, 0) by distance is the one with the largest inner product."""
    squares = np.einsum("ij,ij->i", matrix, matrix)
    top = float(squares.max(initial=0.0))
    return np.column_stack((matrix, np.sqrt(np.maximum(top - squares, 0)))), float(np.sqrt(top))
