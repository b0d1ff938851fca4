"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, scored from mapped files.

First the words are counted: their 64-bit hashes stand in sorted arrays, one file for each part of the hash range, and
are numbered, frequent ones first. Then map tasks send the distinct n-grams of a few million tokens, as
numbers and counts in packed arrays, to the parts of a hash of the n-gram; a part's task adds them up and writes its
array file into the shared folder. It hands on what its contexts sum to and which shorter n-grams its n-grams continue
(each once), which are added up in the same way, level by level down to single words. A context's sums stand beside the
count of the n-gram that it is. Nothing but a few numbers a part and level reaches the driver: counts of counts, and the
size of the part's file, so that a missing or short file raises.

A file's keys are sorted hashes, cut to 28 bits more than it takes to number them, so that an n-gram that was never seen
is taken for a seen one once in 200 million times, whatever the corpus' size; the first bits are in an index of their
first places, the other 32 in an array. Counts and totals are bytes, with the few over 254 apart; only contexts that
stand more than once have numbers of their followers. Workers map the files and look up a slice's n-grams at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm._common import as_bytes, cleaned, mixed, slices, word_hashes
from texlith.llm.stores import ROWS, Store, by_part, cuts, part_of

BEGIN, END = np.uint64(0x0B0E), np.uint64(0x0E0D)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FLUSH_TOKENS = 2_000_000
#: Bytes of text for each part of the hash range.
PART_BYTES = 3 << 22
#: Of the query's model.
ORDER = 3
#: Discounts for n-grams seen once, twice and more often, where too few are seen 1 to 4 times to estimate them.
FALLBACK = (0.5, 1.0, 1.5)
#: Keys a bucket of a file's index holds in the mean, as a power of two.
_BUCKET_BITS = 4
#: Classes of words by count, in whose order they are numbered, so that frequent words have small numbers.
_CLASSES = 16


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with order - 1 begins and one end each, where predicted ones stand, and the text of each of these."""
    words, first = word_hashes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(first))
    tokens = np.full(len(words) + n * order, BEGIN, np.uint64)
    at = np.arange(len(words)) + order * owner + order - 1
    ends = first[1:] + order * np.arange(n) + order - 1
    tokens[at], tokens[ends] = words, END
    place = np.sort(np.concatenate((at, ends)))
    return tokens, place, np.repeat(np.arange(n), np.diff(first) + 1)


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each n-gram of numbers; its words one after another, the first first."""
    key = np.full(len(columns[-1]), len(columns), np.uint64)
    for c in columns:
        key = mixed(key * _ODD + c.astype(np.uint64))
    return key


def within_part(key: np.ndarray, parts: int) -> np.ndarray:
    """A key's place in its part's range, as a fraction of 64 bits; in the order of keys."""
    return (key >> np.uint64(32)) * np.uint64(parts) << np.uint64(32) | key & np.uint64(2**32 - 1)


def _class(counts: np.ndarray) -> np.ndarray:
    """Words by the powers of two of their counts, the most frequent first."""
    return _CLASSES - 1 - np.minimum(np.log2(counts).astype(np.int64), _CLASSES - 1)


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and how long each is."""
    begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    return begin, np.diff(np.append(begin, len(first)))


def _packed(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """N-grams in order and their counts, compressed: the first two columns as differences, and bytes of the same weight together."""
    arrays, out = [np.diff(columns[0], prepend=columns[0][:0].dtype.type(0)), *columns[1:], *counts], []
    if len(columns) > 1:
        second = np.diff(columns[1].astype(np.int64), prepend=0)
        begin, _ = _runs(columns[0])
        second[begin] = columns[1][begin]
        arrays[1] = second
    for a in arrays:
        a = _small(a)
        out += [np.array([len(a), a.itemsize], np.int64).tobytes(), a.view(np.uint8).reshape(len(a), -1).T.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unpacked(blobs, columns: int, counts: int) -> list[np.ndarray]:
    """The arrays of all blobs in a row, as wide as their largest numbers need."""
    parts = []
    for blob in blobs:
        data, at, arrays = zstandard.decompress(blob), 0, []
        while at < len(data):
            n, size = np.frombuffer(data, np.int64, 2, at).tolist()
            arrays.append(np.frombuffer(data, np.uint8, n * size, at + 16).reshape(size, n).T.copy().view(f"<u{size}").ravel())
            at += 16 + n * size
        first = np.cumsum(arrays[0], dtype=np.uint64)
        if columns > 1:
            begin, length = _runs(first)
            total = np.cumsum(arrays[1], dtype=np.uint64)
            arrays[1] = _small(total - np.repeat(total[begin] - arrays[1][begin], length))
        parts.append([_small(first), *arrays[1:]])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * (columns + counts)


def _sent(kind: str, columns: list[np.ndarray], counts: list[np.ndarray], parts: int) -> list[tuple[str, int, bytes]]:
    """Rows of packed arrays for the parts that have any of the n-grams, which are in order."""
    return [(kind, k, _packed([c[at] for c in columns], [c[at] for c in counts])) for k, at in cuts(part_of(key_of(columns), parts), parts)]


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    """Where the first of equal rows stands among rows in order."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _added(counts: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, first, dtype=np.uint64) if len(first) else c.astype(np.uint64) for c in counts]


def _summed(columns: list[np.ndarray], counts: list[np.ndarray], kinds: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct n-grams of numbers below `kinds` in order, and their counts added up (without counts: how often each stands)."""
    bits = max(1, (kinds - 1).bit_length())
    if bits * len(columns) > 64:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = _firsts(columns)
        return [c[first] for c in columns], _added([c[order] for c in counts], first) if counts else [np.diff(np.append(first, len(order)))]
    whole = columns[0].astype(np.uint64)
    for c in columns[1:]:
        whole = whole << np.uint64(bits) | c.astype(np.uint64)
    if counts:
        order = np.argsort(whole)
        whole = whole[order]
        first = _firsts([whole])
        whole, counts = whole[first], _added([c[order] for c in counts], first)
    else:
        whole, n = np.unique(whole, return_counts=True)
        counts = [n]
    mask = np.uint64(2**bits - 1)
    return [(whole >> np.uint64(bits * k) & mask).astype(np.min_scalar_type(kinds)) for k in range(len(columns) - 1, -1, -1)], counts


def _file(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file: a line that says what they are, then each at a multiple of 8 bytes."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    out = [head + b" " * (-(len(head) + 1) % 8) + b"\n"]
    for a in arrays.values():
        out += [a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(out)


def _mapped(data: np.ndarray) -> dict[str, np.ndarray]:
    head = bytes(data[: 1 << 12]).split(b"\n", 1)[0]
    at, out = len(head) + 1, {}
    for name, kind, n in json.loads(head):
        size = n * np.dtype(kind).itemsize
        out[name] = data[at : at + size].view(kind)
        at += size + -size % 8
    return out


def _bytes_of(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers as bytes, with places and values of those that are over 254."""
    at = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": at.astype(np.uint32), f"{name}_more": values[at].astype(np.uint64)}


def _bytes_at(held: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = held[name][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = held[f"{name}_more"][np.searchsorted(held[f"{name}_at"], at[large])]
    return out


def gram_file(columns: list[np.ndarray], count: np.ndarray, context: list[np.ndarray] | None, parts: int) -> bytes:
    """A part's n-grams with their counts and, as contexts, totals and numbers of followers seen once, twice, and more often."""
    place = within_part(key_of(columns), parts)
    order = np.argsort(place)
    place = place[order]
    bits = max(0, (max(1, len(place)) - 1).bit_length() - _BUCKET_BITS)
    bucket = place >> np.uint64(64 - bits) if bits else np.zeros(len(place), np.uint64)
    index = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    arrays = {"index": index, "rest": (place >> np.uint64(32 - bits)).astype(np.uint32), **_bytes_of("count", count[order])}
    if context is not None:
        total, *seen = (c[order] for c in context)
        often = np.flatnonzero(total > 1)
        arrays |= _bytes_of("total", total) | {"often": often.astype(np.uint32)} | {f"seen{k}": _small(s[often]) for k, s in enumerate(seen, 1)}
    return _file(arrays)


def look_up(held: dict[str, np.ndarray], key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys a file has, and their places in its arrays."""
    index, rest = held["index"], held["rest"]
    bits = (len(index) - 1).bit_length() - 1
    place = within_part(key, parts)
    bucket = (place >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    wanted = (place >> np.uint64(32 - bits)).astype(np.uint32)
    low, high = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    end = high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (rest[np.minimum(middle, len(rest) - 1)] < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    hit = np.flatnonzero(low < end)
    hit = hit[rest[low[hit]] == wanted[hit]]
    return hit, low[hit]


class Model:
    """What tasks need besides the files: order, parts, the files' sizes by level and part, first numbers of the parts' words, discounts and totals."""

    def __init__(self, store: Store, order: int, parts: int):
        self.store, self.order, self.parts = store, order, parts
        self.discount: dict[int, np.ndarray] = {}
        self.sizes = {n: np.zeros(parts, np.int64) for n in range(order + 1)}
        self.base = np.zeros((_CLASSES, parts), np.int64)
        self.train_tokens = self.vocabulary = 0
        self.total = self.backoff = 0.0

    @property
    def kinds(self) -> int:
        """Numbers of words, and one for a begin."""
        return self.vocabulary + 1

    def _held(self, level: int, part: int) -> dict[str, np.ndarray]:
        """A file's arrays, mapped as long as they are looked at: a worker has the pages of one part at a time."""
        return _mapped(self.store.read(f"n{level}-{part}", int(self.sizes[level][part])))

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of distinct words in order."""
        ids, raw = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        for p, at in cuts(part_of(words, self.parts), self.parts):
            if self.sizes[0][p]:
                held = self._held(0, p)
                place = np.minimum(np.searchsorted(held["word"], words[at]), len(held["word"]) - 1)
                hit = held["word"][place] == words[at]
                raw[at[hit]] = held["raw"][place[hit]]
                ids[at[hit]] = self.base[_class(raw[at[hit]]), p] + held["rank"][place[hit]]
        ids[words == BEGIN] = self.vocabulary
        return ids, raw

    def look(self, level: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Counts of n-grams of numbers, and below the highest level their totals and what they leave to shorter contexts; 0 for those that weren't seen."""
        known = np.flatnonzero(np.all([c >= 0 for c in columns], axis=0))
        wanted, back = np.unique(key_of([c[known] for c in columns]), return_inverse=True)
        out = [np.zeros(len(wanted), np.int64)] + [np.zeros(len(wanted)) for _ in range(2 * (level < self.order))]
        for p, at in cuts(part_of(wanted, self.parts), self.parts):
            if not self.sizes[level][p]:
                continue
            held = self._held(level, p)
            hit, place = look_up(held, wanted[at], self.parts)
            some = at[hit]
            out[0][some] = _bytes_at(held, "count", place)
            if level < self.order:
                total, discount = _bytes_at(held, "total", place), self.discount[level + 1]
                left = np.where(total == 1, discount[1], 0.0)
                often = np.flatnonzero(total > 1)
                rank = np.searchsorted(held["often"], place[often])
                left[often] = sum(discount[k] * held[f"seen{k}"][rank] for k in (1, 2, 3)) / total[often]
                out[1][some], out[2][some] = total, left
        whole = [np.zeros(len(columns[0]), a.dtype) for a in out]
        for w, a in zip(whole, out, strict=True):
            w[known] = a[back]
        return whole

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Tokens, known ones, base score and score of each text, a slice at a time."""
        done = []
        for a, b in slices([len(t) for t in texts], 4 << 20):
            tokens, place, owner = padded(texts[a:b], self.order)
            words, back = np.unique(tokens, return_inverse=True)
            ids, raw = self.numbers(words)
            held = [x[back] for x in self.look(1, [ids])]
            ids, raw = ids[back], raw[back[place]]
            base = np.log10((raw + 1) / (self.train_tokens + self.vocabulary + 1))
            p = np.full(len(place), 1 / (self.vocabulary + 1))
            if self.total:
                lower = held[0][place]
                p = np.maximum(lower - self.discount[1][np.minimum(lower, 3)], 0) / self.total + self.backoff * p
            for n in range(2, self.order + 1):  # an n-gram's numbers stand at its last word
                total, left = held[1][place - 1], held[2][place - 1]
                first = n - 1
                held = [np.append(np.zeros(first, x.dtype), x) for x in self.look(n, [ids[first - j : len(ids) - j] for j in range(first, -1, -1)])]
                count, has = held[0][place], total > 0
                p[has] = np.maximum(count - self.discount[n][np.minimum(count, 3)], 0)[has] / total[has] + left[has] * p[has]
            k = b - a
            done.append((np.bincount(owner, minlength=k), np.bincount(owner, raw > 0, k).astype(np.int64), np.bincount(owner, base, k), np.bincount(owner, np.log10(p), k)))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0),) * 4


def _discounts(seen: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more from the numbers of n-grams seen 1 to 4 times; FALLBACK if one is 0."""
    t = seen.astype(np.float64)
    if not t[:4].all():
        return np.array([0, *FALLBACK])
    y = t[0] / (t[0] + 2 * t[1])
    return np.array([0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3))])


def _tokens(rows: Iterator[pd.DataFrame], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """padded() of some millions of tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum([0] + [len(t) for t, _ in held[:-1]])
        out = np.concatenate([t for t, _ in held]), np.concatenate([p + s for s, (_, p) in zip(starts, held, strict=True)])
        held.clear()
        return out

    for batch in rows:
        data = as_bytes(batch["text"])
        for a, b in slices([len(t) for t in data]):
            held.append(padded(data[a:b], order)[:2])
            if sum(len(p) for _, p in held) > _FLUSH_TOKENS:
                yield joined()
    if held:
        yield joined()


@cleaned
def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Counts all rows of texts(text binary, ...): null is empty and is one end. `order` is at least 2.

    Repeated rows count as often as they stand; other columns aren't read; an empty table gives a model that knows no
    word. There are as many parts as the cluster has cores, or one for each PART_BYTES of text if that is more. Where a
    level has no n-gram of some count from 1 to 4, its discounts are FALLBACK.
    """
    spark, texts = texts.sparkSession, texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    store = Store(spark)
    model = Model(store, order, parts)

    def numbers(rows: DataFrame, width: int) -> Iterator[tuple[int, np.ndarray]]:
        for r in rows.where("kind = 'stat'").toLocalIterator():
            for stats in np.frombuffer(r["data"], np.int64).reshape(-1, width):
                yield r["part"], stats

    def words_of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, place in _tokens(rows, 1):
            words, n = np.unique(tokens[place], return_counts=True)
            yield pd.DataFrame([("word", k, _packed([words[at]], [n[at]])) for k, at in cuts(part_of(words, parts), parts)], columns=["kind", "part", "data"])

    def words(part: int, blobs: dict[str, list[bytes]]) -> list[tuple[str, int, bytes]]:
        word, n = _unpacked(blobs["word"], 1, 1)
        order = np.argsort(word)
        word, first = word[order], _firsts([word[order]])
        raw = _added([n[order]], first)[0]
        kind = _class(raw)
        order, n = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=_CLASSES)
        rank = np.empty(len(raw), np.int64)
        rank[order] = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        data = _file({"word": word[first], "raw": _small(raw), "rank": _small(rank)})
        return [*store.write(0, part, data), ("stat", part, np.array([len(data), int(raw.sum()), *n], np.int64).tobytes())]

    for part, stats in numbers(store.ran(by_part(texts.mapInPandas(words_of, ROWS), parts, words)), _CLASSES + 2):
        model.sizes[0][part], model.base[:, part] = stats[0], stats[2:]
        model.train_tokens += int(stats[1])
    model.vocabulary = int(model.base.sum())
    model.base = np.cumsum(model.base).reshape(model.base.shape) - model.base

    def grams_of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, place in _tokens(rows, order):
            words, back = np.unique(tokens, return_inverse=True)
            ids = model.numbers(words)[0][back]
            yield pd.DataFrame(_sent("low", *_summed([ids[place - j] for j in range(order - 1, -1, -1)], [], model.kinds), parts), columns=["kind", "part", "data"])

    def level(n: int):
        """A part's file of a level, its counts of counts, and the next level's counts."""

        def one(part: int, blobs: dict[str, list[bytes]]) -> list[tuple[str, int, bytes]]:
            low, context = _unpacked(blobs.get("low", ()), n, 1), None
            if n < order:
                also = _unpacked(blobs.get("ctx", ()), n, 4)
                k, m = len(low[0]), len(also[0])
                none = [np.zeros(k, np.uint8)] * 4
                every = [np.concatenate((x, y)) for x, y in zip([*low, *none], [*also[:n], np.zeros(m, np.uint8), *also[n:]], strict=True)]
                del low, also
                columns, (count, *context) = _summed(every[:n], every[n:], model.kinds)
            else:
                columns, (count,) = _summed(low[:n], low[n:], model.kinds)
            data = gram_file(columns, count, context, parts) if len(count) else b""
            out = store.write(n, part, data) if data else []
            if n > 1:
                seen = count > 0
                columns, count = [c[seen] for c in columns], count[seen]
                first, c = _firsts(columns[:-1]), np.minimum(count, 3)
                out += _sent("ctx", [x[first] for x in columns[:-1]], _added([count, *((c == k).astype(np.uint64) for k in (1, 2, 3))], first), parts)
                each = np.where(columns[1] == model.vocabulary, count, 1).astype(np.uint64) if n > 2 else np.ones(len(count), np.uint64)
                out += _sent("low", *_summed(columns[1:], [each], model.kinds), parts)
            stats = [n, len(data), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count >= 3).sum()), int(count.sum())]
            passed = [(kind, part, data) for kind, held in blobs.items() if kind == "stat" or kind.startswith("file ") for data in held]
            return [*out, *passed, ("stat", part, np.array(stats, np.int64).tobytes())]

        return one

    rows = texts.mapInPandas(grams_of, ROWS)
    for n in range(order, 0, -1):
        rows = by_part(rows, parts, level(n))
    totals = {n: np.zeros(6, np.int64) for n in range(1, order + 1)}
    for part, (n, held, *stats) in numbers(store.ran(rows), 8):
        model.sizes[n][part] = held
        totals[n] += stats
    for n, t in totals.items():
        model.discount[n] = _discounts(t[:4])
    model.total = float(totals[1][5])
    model.backoff = float((model.discount[1][1:] * totals[1][[0, 1, 4]]).sum() / max(1, totals[1][5]))
    return model


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id as text leaves 2 by 7. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, held_out, text binary).

    A null or empty text is its end alone. Repeated rows stay repeated; other columns aren't read; an empty table gives no rows.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            tokens, known, base, log = model.score(as_bytes(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": tokens, "n_known": known, "train_tokens": model.train_tokens, "base_score": base, "score": log})

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out and learned documents' scores by a model of order 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return score(docs, train(docs.where(~F.col("held_out")).select("text")))
