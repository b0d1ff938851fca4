"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; each run of signs that are no letters becomes one blank. The 2- and 3-grams of what is left are
hashed into a fixed number of buckets. Counts by language are summed over tasks as arrays of fixed size; the matrix of
log probabilities (buckets x languages, 4 bytes each) is broadcast, and texts are scored in numpy, a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texlith.llm._common import as_texts, released, slices, summed

UNKNOWN = "und"
_SLICE_CHARS = 1 << 19
#: Odd multipliers, one for the first letter and one for each order from 2 on.
_SPREAD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE3D)


class Model(NamedTuple):
    """Languages in order of name, log priors, and log probabilities by bucket and language (a last row of zeros for no bucket)."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and where each text's begin (one more at the end), and the texts' numbers of letters."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered)).encode("utf-32-le", "replace"), np.uint32)
    firsts = np.cumsum([0] + [len(t) + 1 for t in lowered])
    letter = _letters()[points]
    first = np.zeros(len(points), bool)
    first[firsts[:-1]] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    seen = np.append(0, np.cumsum(letter))
    letters = np.diff(seen[firsts])
    points = np.where(letter, points, np.uint32(32))[keep]
    bounds = np.append(0, np.cumsum(keep))[firsts]
    shift = np.uint32(32 - buckets.bit_length() + 1)
    value, out = points * np.uint32(_SPREAD[0]), []
    for n, spread in enumerate(_SPREAD[1:], 2):
        value = value[: max(0, len(points) - n + 1)] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(spread)
        grams = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
        inside = np.minimum(bounds, len(value))
        for back in range(1, n):  # those that reach into the next text count for none
            cross = bounds[1:] - back
            grams[cross[(cross >= bounds[:-1]) & (cross < len(grams))]] = buckets
        out.append((grams, inside))
    return out, letters


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id as text is divisible by 5. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, buckets: int = 1 << 16, smoothing: float = 0.5, max_languages: int = 256) -> Model:
    """Learns from all rows of labelled(text, lang, ...) with a language; null texts count as rows without n-grams.

    Repeated rows count as often as they stand; other columns aren't read; without a language nothing is learned. The
    languages' names are collected, and the counts have a fixed size a language: more than `max_languages` raise, since
    the matrix is broadcast (buckets * 4 bytes a language).
    """
    known = labelled.where(F.col("lang").isNotNull()).select("text", "lang")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        raise ValueError(f"lang has more than {max_languages} values")
    rows = {r["lang"]: r["n"] for r in counted}
    langs = sorted(rows)
    if not langs:
        return Model([], np.zeros(0), np.zeros((buckets + 1, 0)))
    place = {x: i for i, x in enumerate(langs)}

    def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(len(langs) * (buckets + 1), np.int64)
        for batch in batches:
            texts, lang = as_texts(batch["text"]), batch["lang"].map(place).to_numpy()
            for a, b in slices([len(t) for t in texts], _SLICE_CHARS):
                for grams, bounds in _grams(texts[a:b], buckets)[0]:
                    base = np.repeat(lang[a:b] * (buckets + 1), np.diff(bounds))
                    total += np.bincount(base + grams[: len(base)], minlength=len(total))
        return total

    counts = summed(known, partial, len(langs) * (buckets + 1)).reshape(len(langs), -1)[:, :-1]
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * buckets)
    prior = np.log(np.array([rows[x] for x in langs]) / sum(rows.values()))
    return Model(langs, prior, np.vstack((weights.T, np.zeros((1, len(langs))))).astype(np.float32))


def _totals(model: Model, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A slice at a time: log probabilities by text and language without priors, numbers of n-grams and of letters."""
    for a, b in slices([len(t) for t in texts], _SLICE_CHARS):
        orders, letters = _grams(texts[a:b], len(model.weights) - 1)
        total, grams_of = np.zeros((b - a, len(model.langs))), np.zeros(b - a, np.int64)
        for grams, bounds in orders:
            has = np.flatnonzero(np.diff(bounds))
            grams_of += np.diff(bounds)
            if len(has) and model.langs:
                total[has] += np.add.reduceat(model.weights[grams[: bounds[-1]]], bounds[has], axis=0, dtype=np.float64)
        yield total, grams_of, letters


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Each text's language and its posterior probability; `und` and 0 without a letter. Ties go to the first name."""
    names, sure = [], [np.zeros(0)]
    for total, _, letters in _totals(model, texts):
        if not model.langs:
            names += [UNKNOWN] * len(letters)
            sure.append(np.zeros(len(letters)))
            continue
        total = total + model.prior
        best = total.argmax(axis=1)
        odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names += [model.langs[k] if n else UNKNOWN for k, n in zip(best, letters, strict=True)]
        sure.append(np.where(letters > 0, odds, 0))
    return names, np.concatenate(sure)


def identified(model: Model, texts: list[str], min_letters: int = 20) -> np.ndarray:
    """Whether each text is in a language that was learned: it has a letter and, if it has `min_letters`, its n-grams are
    likelier in its likeliest language than if drawn from all buckets alike. Where nothing was learned a letter is enough."""
    out = [np.zeros(0, bool)]
    for total, grams, letters in _totals(model, texts):
        good = letters > 0
        if model.langs:
            good &= (letters < min_letters) | (total.max(axis=1) >= -grams * np.log(len(model.weights) - 1))
        out.append(good)
    return np.concatenate(out)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score: one pass over docs(text, ...), all other columns as they are.

    A null or letterless text gives `und` and 0; so does any text if nothing was learned. Columns named lang_pred or
    score that are there already are replaced. Repeated rows stay repeated; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sure = score_texts(shared.value, as_texts(batch["text"]))
            yield batch.assign(lang_pred=names, score=sure)

    return docs.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_letters: int = 20) -> DataFrame:
    """The rows of docs(text, lang, ...) whose text is `identified` by a model of all rows with a language.

    Null and letterless texts go, and longer ones that are less likely than chance in every learned language (another
    script, encoded data). Short texts and texts in more than one language stay; without any language in the table
    all texts with a letter stay. Repeated rows share one fate; all columns are kept as they are; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @released
    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(identified(shared.value, as_texts(batch), min_letters), dtype=bool)

    return docs.where(F.pandas_udf(kept, "boolean")("text"))
