"""Held-out evaluation: items with a label are scored against a fresh corpus, and the report is aggregates over the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texlith.functions.constants import LOOSE, NOT_NOVEL_MAX, NOVEL_MIN, OFF_TOPIC_MAX
from texlith.operators import calibration
from texlith.plans.scorer import State, Submission, score, sequential

#: Labels by what they are held to (fixed values).
NOVEL, NOT_NOVEL, ON_TOPIC = ("novel", "seq_first"), ("paraphrase", "generic"), ("novel", "seq_first", "paraphrase", "generic")


def passes(label: Column, score: Column, expect: Column) -> Column:
    """Whether a score is what the item's label, or its own rule `<= x` or `>= x`, asks for; null where nothing is asked."""
    bound = F.regexp_extract(expect, r"([0-9.]+)", 1).cast("double")
    own = F.when(expect.startswith(">="), score >= bound).when(expect.startswith("<="), score <= bound).when(expect.startswith(">"), score > bound).when(expect.startswith("<"), score < bound)
    rule = F.when(label.isin(*NOVEL), score >= NOVEL_MIN).when(label.isin(*NOT_NOVEL), score <= NOT_NOVEL_MAX).when(label == "off_topic", score <= OFF_TOPIC_MAX)
    return F.coalesce(own, rule)


def scored(items: DataFrame, state: State) -> DataFrame:
    """items(id, label, topic, of, expect, headline, body, stance) with score, gate and ok; nothing is admitted."""
    rated = score(items, state).select("id", "score", F.col("relevance_gate").alias("gate"))
    return items.join(rated, "id").withColumn("ok", passes(F.col("label"), F.col("score"), F.col("expect")))


def worst(failed: DataFrame, n: int = 10) -> DataFrame:
    """The first n of failed(label, id, score): by label, the highest scores first, ties by id."""
    first = failed.orderBy("label", F.col("score").desc(), "id").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("label", F.col("score").desc(), "id")))


def by_topic(rows: DataFrame) -> DataFrame:
    """(topic, n, rate) of off-topic items: the topic is what stands before a colon, `other` if nothing does."""
    topic = F.trim(F.split(F.coalesce("topic", F.lit("")), ":")[0])
    off = rows.where("label = 'off_topic'").withColumn("topic", F.when(topic == "", "other").otherwise(topic))
    return calibration.pass_rates(off, "topic", F.col("score") <= OFF_TOPIC_MAX)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(shared): how many distinct values of a column two splits share."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("shared"))


def pairs_of(items: DataFrame) -> list[tuple[Submission, Submission]]:
    """First and second submissions of the sequential pairs, in order; pairs that lack one are left out."""
    kinds = items.where("label in ('seq_first', 'seq_second') and of is not null").groupBy("of").pivot("label", ["seq_first", "seq_second"]).agg(F.first(F.struct("id", "headline", "body", "stance")))
    whole = kinds.where("seq_first is not null and seq_second is not null").orderBy("of").toLocalIterator()
    return [tuple(Submission(**r[k].asDict()) for k in ("seq_first", "seq_second")) for r in whole]


def report(items: DataFrame, state: State, failures: int = 10) -> dict:
    """Rates by label and topic, AUCs, the sequential pairs that lose their novelty, and the worst failures."""
    rows = scored(items, state).persist()
    rounded = lambda df: {r[0]: (r["n"], None if r["rate"] is None else round(r["rate"], 3)) for r in df.orderBy(df.columns[0]).collect()}
    auc = lambda of, column: calibration.auc(rows.where(F.col("label").isin(*of[0], *of[1])).select(F.col(column).alias("p"), F.col("label").isin(*of[0]).alias("positive"))).first()[0]
    loose = rows.where("label = 'off_topic'").agg(F.avg((F.col("score") <= LOOSE).cast("double"))).first()[0]
    pairs = pairs_of(items)
    lost = sequential(items.sparkSession, state, pairs).agg(F.avg(((F.col("before") >= NOVEL_MIN) & (F.col("after") <= NOT_NOVEL_MAX)).cast("double"))).first()[0] if pairs else None
    bad = worst(rows.where("not ok").select("label", "id", "score", "gate", "headline"), failures)
    out = {
        "n": rows.count(), "pass_rates": rounded(calibration.pass_rates(rows, "label", F.col("ok"))), "by_topic": rounded(by_topic(rows)), "off_topic_loose": loose,
        "auc_novelty": auc((NOVEL, NOT_NOVEL), "score"), "auc_relevance": auc((ON_TOPIC, ("off_topic",)), "gate"), "sequential": lost, "failures": [r.asDict() for r in bad.orderBy("rank").collect()],
    }
    rows.unpersist()
    return out
