"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texlith.llm._common import free, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for each id in links(a, b): label is the smallest id that it reaches.

    Each round sends a link's ends to smaller ids by a grouped minimum (combined before the shuffle) and one join, so
    that no id's neighbours are ever gathered; the links of a round are a table in the shared folder. Rounds end when
    each id has one link, to one that has none, its component's smallest; after about log(longest path) of them.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pointed = edges.select(F.col("v").alias("u")).distinct()
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(pointed, "u", "left_semi").isEmpty():
            break
        old, edges = edges, written(small.select("e.u", "e.v").where("u <> v").distinct())
        before, state = state, _state(edges)
        free(old)
        if before == state:
            break
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
    out.shared_path = edges.shared_path
    return out
