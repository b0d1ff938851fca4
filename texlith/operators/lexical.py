"""Document frequencies, smoothed idf, TF-IDF vectors and cosine, as joins and aggregates over (id, term) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texlith.functions.text import tokens


def term_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, tf); partial counts are combined before the shuffle."""
    return docs.select(F.col(id_).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df) of (id, term, ...) rows with one row a pair."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def smoothed_idf(df, n):
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def idf(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) with n the number of rows of corpus."""
    n = corpus.agg(F.count("*").alias("n"))
    return document_frequency(terms).crossJoin(F.broadcast(n)).select("term", "df", smoothed_idf(F.col("df"), F.col("n")).alias("idf"))


def tfidf(terms: DataFrame, idf: DataFrame, n: int | None = None) -> DataFrame:
    """(id, term, w): (1 + ln tf) * idf over the norm of all terms; terms unknown to idf count in the norm and go."""
    known = terms.join(idf, "term", "left")
    if n is None:
        n = idf.sparkSession.sql("select 0L as n").first()["n"]
    weight = (1 + F.log("tf")) * F.coalesce("idf", smoothed_idf(F.lit(0), F.lit(n)))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return known.withColumn("w", weight).withColumn("w", F.col("w") / norm).where(F.col("df").isNotNull()).select("id", "term", "w")


def cosines(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, entry, sim) of all pairs that share a term: an equi-join on the term, summed by pair."""
    right = entries.select(F.col("id").alias("entry"), "term", F.col("w").alias("we"))
    return queries.join(right, "term").groupBy("id", "entry").agg(F.sum(F.col("w") * F.col("we")).alias("sim"))


def top_k(pairs: DataFrame, k: int, by: str = "sim") -> DataFrame:
    """The k best entries of each id, ties to the smaller entry."""
    order = Window.partitionBy("id").orderBy(F.col(by).desc(), "entry")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
