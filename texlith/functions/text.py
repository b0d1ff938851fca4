"""Text operators as native columns; each is a pure function of a string column."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from texlith.functions import constants as C


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns evaluated once a row: a one-row generator keeps lambdas from repeating them for each element."""
    made = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once"))
    return made.select(*[c for c in df.columns if c not in columns], *[F.col(f"_once.{k}").alias(k) for k in columns])


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(C.WORD), F.lit(0))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the plain letters that they decompose to."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for i in r]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and all(map(unicodedata.combining, unicodedata.normalize("NFKD", a)[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents; native for Latin letters, whose table is built from Unicode decompositions."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{Mn}", "")


def stem(w: Column) -> Column:
    """Cuts ing, ed or s off a long enough word; the first ending that fits."""
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ing"), w.substr(F.lit(1), n - 3))
        .when((n > 4) & w.endswith("ed"), w.substr(F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), n - 1))
        .otherwise(w)
    )


def _content(w: Column) -> Column:
    return (F.length(w) > 2) & ~w.isin(C.STOPWORDS)


def tokens(text: Column) -> Column:
    """Stems of content words, with repetitions."""
    return F.transform(F.filter(words(fold(text)), _content), stem)


def generic(w: Column) -> Column:
    """In the list of generic words, or an inflection of one."""
    whole = sorted(set(C.GENERIC) | {g[: len(g) - len(back)] + end if back else g + end for g in C.GENERIC for end, back in C.GENERIC_ENDINGS if g.endswith(back)})
    return w.isin(C.GENERIC) | w.isin(whole) & ~w.isin(*C.SPECIFIC)


def specific_words(text: Column) -> Column:
    """Distinct stems of content words that aren't generic."""
    return F.array_distinct(F.transform(F.filter(words(fold(text)), lambda w: _content(w) & ~generic(w)), stem))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def distinct_share(text: Column) -> Column:
    return share(F.size(F.array_distinct(words(text))), F.size(words(text)))


def stopword_share(text: Column) -> Column:
    return share(F.size(F.filter(words(text), lambda w: w.isin(C.STOPWORDS))), F.size(words(text)))


def flat(text: Column) -> Column:
    """The folded text with runs of other signs as one blank."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the flat text; a short text is its own."""
    norm = flat(text)
    grams = F.regexp_extract_all(norm, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(norm) <= n, F.array(norm)).otherwise(F.array_distinct(grams))


def containment(a: Column, b: Column) -> Column:
    return share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clauses(text: Column, min_words: int = 4) -> Column:
    """Clause-sized parts; one of fewer words joins the part before it."""
    parts = F.filter(F.transform(F.split(text, C.CLAUSE_SPLIT, -1), _strip), lambda x: x != "")

    def step(done: Column, x: Column) -> Column:
        short = (F.size(done) > 0) & (F.size(F.split(x, r"\s+")) < min_words)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), x)))
        return F.when(short, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def substantive(clause: Column) -> Column:
    """At least 3 words; from 6 on at least a tenth function words and half of them distinct."""
    w = words(clause)
    n = F.size(w)
    stops, distinct = F.size(F.filter(w, lambda x: x.isin(C.STOPWORDS))), F.size(F.array_distinct(w))
    return (n >= 3) & ((n < 6) | (stops / n >= 0.1) & (distinct / n >= 0.5))


def foreign_share(text: Column) -> Column:
    """Share of letters outside ASCII."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    return share(F.length(F.regexp_replace(letters, "[A-Za-z]", "")), F.length(letters))


def looks_foreign(text: Column) -> Column:
    """Over 0.3 of the letters aren't ASCII, or at least two foreign function words and more than English ones."""
    ws = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + C.TOKEN), F.lit(0)), F.lower)
    foreign = F.size(F.filter(F.transform(ws, fold), lambda w: w.isin(C.FOREIGN_WORDS)))
    stops = F.size(F.filter(ws, lambda w: w.isin(C.STOPWORDS)))
    return (foreign_share(text) > C.FOREIGN_SCRIPT) | (foreign >= 2) & (foreign > stops)


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize(text: Column) -> Column:
    """Canonical form of user text. Only compatibility composition needs Python, and only for texts that aren't ASCII."""
    t = F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))
    t = F.regexp_replace(F.regexp_replace(t, C.INVISIBLE, ""), r"[\p{Cf}\p{Cs}]", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b-\x1f\x7f]", " ")
    letters = F.regexp_replace(t, r"\P{L}", "")
    odd = F.length(F.regexp_replace(letters, f"[A-Za-z{C.LOOK_ALIKES[0]}]", ""))
    latin = (F.length(letters) > 0) & (odd / F.length(letters) < C.LATIN_MAX_FOREIGN)
    t = F.when(latin, F.translate(t, *C.LOOK_ALIKES)).otherwise(t)
    return _strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def content_text(parts: Column) -> Column:
    """The substantive ones of array<struct<clause, substantive>> as one text, null if there are none."""
    kept = F.transform(F.filter(parts, lambda c: c["substantive"]), lambda c: c["clause"])
    return F.when(F.size(kept) > 0, F.array_join(kept, ". "))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
