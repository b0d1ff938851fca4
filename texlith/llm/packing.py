"""Best-fit packing of documents into sequences by minimum bin slack.

Lengths are at most the capacity, so that a histogram of them is all that the bin search needs: its size is fixed,
whatever the corpus. For each bin the longest length left is the seed; a subset-sum over the other lengths (a Python
integer as a bitset, multiplicities split in powers of two, longest first) finds the fullest feasible combination,
which leaves the histogram. As equal histograms choose alike, a combination is taken as often as its lengths last, so
that there are a few thousand combinations for any number of bins. Pieces are numbered within their length (in groups
of bounded size, so that one length can hold any share of the rows) and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texlith.llm._common import as_texts, cleaned, released, written
from texlith.llm.bpe import loaded

_RANK_BITS = 44
#: Pieces of one length that one task numbers, about.
_GROUP = 1 << 16


def cut_lengths(n: int, capacity: int) -> list[int]:
    """The lengths of a document's pieces: full ones, after a shorter first one if it doesn't divide."""
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def fullest(counts: np.ndarray, seed: int, capacity: int) -> dict[int, int]:
    """The combination with the least slack that holds `seed`: {length: times}."""
    room, bits, steps = capacity - seed, 1, []
    mask = (1 << (room + 1)) - 1
    for length in (np.flatnonzero(counts[1 : room + 1]) + 1)[::-1].tolist():
        left = min(int(counts[length]) - (length == seed), room // length)
        part = 1
        while left > 0 and not bits >> room & 1:
            take = min(part, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left, part = left - take, part * 2
        if bits >> room & 1:
            break
    chosen, at = {seed: 1}, bits.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram: np.ndarray, capacity: int) -> pd.DataFrame:
    """Slots: ranks [first, first + times * bins) of a length go to `bins` sequences from `base`, `times` a sequence, from `offset`."""
    counts, used, base, slots = histogram.astype(object).copy(), np.zeros(capacity + 1, object), 0, []
    seed = capacity
    while seed > 0:
        if not counts[seed]:
            seed -= 1
            continue
        chosen = fullest(counts, seed, capacity)
        bins = min(int(counts[k]) // m for k, m in chosen.items())
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            slots.append((length, int(used[length]), times, base, offset))
            counts[length] -= times * bins
            used[length] += times * bins
            offset += length * times
        base += bins
    return pd.DataFrame(slots, columns=["length", "first", "times", "base", "offset"]).astype(np.int64)


@cleaned
def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text, ...).

    A null or empty text is its end id alone. Only documents over the capacity are cut. Repeated rows are packed as
    often as they stand; other columns aren't read; an empty table gives no rows. Only the sizes of groups
    (one for each length and 65,536 pieces) reach the driver; they and the plan, a few thousand slots, are sent to all tasks.
    """
    spark = docs.sparkSession

    @released
    def pieces(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        end = np.array([end_id], np.int32)
        for batch in rows:
            out = []
            for doc, ids in zip(batch["doc_id"], bpe.ids(as_texts(batch["text"])), strict=True):
                data, at = np.concatenate((ids, end)).astype("<u4"), 0
                for k, n in enumerate(cut_lengths(len(data), capacity)):
                    out.append((doc, k, at, n, zlib.crc32(data[at : at + n].tobytes())))
                    at += n
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    cut = docs.select("doc_id", "text").mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = written(cut)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    groups = np.maximum(1, -(-histogram // _GROUP))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(groups.tolist()), F.col("length").cast("int")))
    cut = cut.withColumn("_group", (F.get(F.lit((np.cumsum(groups) - groups).tolist()), F.col("length").cast("int")) + salt).cast("long"))
    sizes = np.zeros(groups.sum(), np.int64)
    for row in cut.groupBy("_group").count().toLocalIterator():
        sizes[row["_group"]] = row["count"]
    of_length = np.repeat(np.arange(capacity + 1), groups)
    before = np.cumsum(sizes) - sizes - (np.cumsum(histogram) - histogram)[of_length]
    slots = plan(histogram, capacity).sort_values(["length", "first"])
    shared = spark.sparkContext.broadcast((before, slots["length"].to_numpy() << _RANK_BITS | slots["first"].to_numpy(), {c: slots[c].to_numpy() for c in slots}))

    @released
    def placed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, keys, slot = shared.value
        for batch in rows:
            length = batch["length"].to_numpy(np.int64)
            rank = before[batch["_group"].to_numpy(np.int64)] + batch["_rank"].to_numpy(np.int64) - 1
            at = np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1
            nth, times = rank - slot["first"][at], slot["times"][at]
            yield batch.drop(columns=["_group", "_rank"]).assign(sequence_id=slot["base"][at] + nth // times, offset=slot["offset"][at] + nth % times * length)

    order = Window.partitionBy("_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order).cast("long"))
    return ranked.mapInPandas(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
