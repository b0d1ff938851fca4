"""A corpus from a folder of JSON files, and the embedder that the environment names."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from texlith.plans.embedders import Embedder, EmbeddingError, HashEmbedder
from texlith.plans.scorer import Config, State, Submission
from texlith.sources import submissions as S

#: Answers of a server after which a request may be tried again (fixed values).
TRANSIENT = frozenset((408, 429, 500, 502, 503, 504))


def embedder(name: str | None = None) -> Embedder:
    """The embedder called `hash-<function>-<size>`, from TEXLITH_EMBEDDER unless given; others aren't built in and raise."""
    name = name or os.environ.get("TEXLITH_EMBEDDER") or "hash-md5-64"
    kind, _, rest = name.partition("-")
    function, _, size = rest.partition("-")
    if kind != "hash" or function not in ("md5", "crc32") or not size.isdigit() or not int(size):
        raise EmbeddingError(f"unknown embedder {name!r}")
    return HashEmbedder(int(size), function)


def transient(error: BaseException) -> bool:
    """Whether a failed request may be tried again: a time-out, a lost connection, or one of TRANSIENT as its code."""
    return isinstance(error, TimeoutError | ConnectionError) or getattr(error, "code", None) in TRANSIENT


def load_state(spark: SparkSession, folder: str, config: Config | None = None, saved: str | None = None) -> State:
    """The fitted corpus of a folder's files; relevance_negatives.json may be missing. `saved`: a log whose admitted rows are added again."""
    path = lambda name: f"{folder.rstrip('/')}/{name}.json"
    article = S.read_article(spark, path("fixed_content")).first()
    rows = lambda df: [Submission(r["id"], r["headline"], r["body"], r["stance"]) for r in df.collect()]
    held = rows(S.read_corpus(spark, path("corpus")))
    anchors = [r["anchor"] for r in S.read_anchors(spark, path("off_topic_anchors")).collect()]
    there = os.path.exists(path("relevance_negatives"))
    negatives = [(s.headline, s.body) for s in rows(S.read_negatives(spark, path("relevance_negatives")))] if there else []
    state = State((article["title"], article["text"]), held, anchors, negatives, config, embedder())
    if saved and os.path.exists(saved):
        log = spark.read.parquet(saved)
        again = S.replayable(log, spark.createDataFrame([(s.id,) for s in held], "id string")).orderBy("pos")
        state.add(rows(again))
    return state
