"""Similarity join on word shingles: Jaccard links and their components, by token-combination prefixes.

Documents with equal sets are one node. Shingles are ordered by how frequent they are (from a sketch of fixed size over
all documents), rare ones first. A set is indexed by a prefix in this order: rare shingles as they are, frequent ones by
combinations of two within sub-classes of the shingle space; the prefix is extended until the combinations cover as
many shingles as two similar sets can differ in, so that any two linked sets share a signature. The rare ones too are
in order of their counts, so that shingles of a passage that a few texts share come into a prefix last.

Sets that share a signature aren't paired with each other: in some rounds each is compared with one pivot, that of most
of its signatures, and links form components; then only sets that share a signature and are still in different
components are compared. No link between components remains, and a group of n near copies takes about n comparisons.
A pair is first held against an upper bound from bitmaps of the parity of hashed shingles (their Hamming distance is
at most the sets' symmetric difference, so that no link is lost), and then verified by whole sets. The last join has
short bitmaps in its condition, so that texts that merely share a passage make no rows, and of the signatures that the
same sets have in the same roles only one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm._common import WORD_BYTES, as_bytes, cleaned, free, held, mixed, released, slices, summed, word_hashes, written
from texlith.llm.components import connected_components

WORDS = 5
PERCENT = 80
CELLS = 1 << 22
#: So many of them the driver works on at once.
_STEP = 1 << 16
_PROBE, _INDEX = 1, 2
_CLASS_SIZE = 16
_OFTEN = 128
#: Least and most rounds of comparisons with pivots: they go on while pairs that are still open outnumber the signatures,
#: and the last round left no more than that share of those before it. What is open after them is compared pair by pair.
_TURNS, _MOST_TURNS, _LEFT = 2, 6, 0.95
#: Least and most bits of the bitmaps that the last join holds against each other; between them, four to eight a shingle.
_SHORT, _LONG = 256, 8192
#: So many of its smallest open signatures a set carries into the last join, to meet each other set at one of them only.
_FIRST = 32
#: Sizes at which levels begin: linked sets are at most one level apart.
_LEVELS = sorted({-(-(5**k) // 4**k) for k in range(80)})
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in order; a text of fewer words is one shingle, one without words has none."""
    for a, b in slices([len(t) for t in texts], WORD_BYTES):
        hashes, first = word_hashes(texts[a:b])
        n = np.diff(first)
        full = mixed(hashes + np.uint64(words))
        for j in range(1, words):
            left = max(0, len(hashes) - j)
            full[:left] = mixed(full[:left] * _ODD + hashes[len(hashes) - left :])
        for i, k in enumerate(n.tolist()):
            if k >= words:
                yield np.unique(full[first[i] : first[i + 1] - words + 1])
            elif k:
                one = mixed(hashes[first[i] : first[i] + 1] + np.uint64(k))
                for h in hashes[first[i] + 1 : first[i + 1]]:
                    one = mixed(one * _ODD + h)
                yield one
            else:
                yield hashes[:0]


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    total = np.array([len(shingles)], np.uint64)
    if len(shingles):
        total = total + mixed(shingles * _ODD).sum(dtype=np.uint64, keepdims=True) * _ODD + np.bitwise_xor.reduce(shingles)
    return int(mixed(total).view(np.int64)[0])


def needs(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many shingles must be covered to find all smaller partners, and all larger ones."""
    return n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """A class for each cell, below _OFTEN and by its count if that is what chance gives, else by the bits of what is over that."""
    mean = counts.mean()
    chance = 6 * np.sqrt(mean) + 8
    out = np.zeros(len(counts), np.uint8)
    for at in range(0, len(counts), _STEP):
        over = counts[at : at + _STEP] - (mean + chance)
        rare = np.clip((over / chance + 2) / 2 * (_OFTEN - 1), 0, _OFTEN - 1)
        out[at : at + _STEP] = np.where(over > 0, _OFTEN - 1 + np.ceil(np.log2(np.maximum(over, 1) + 1)), rare).astype(np.uint8)
    return out


def _level(n: int) -> int:
    return bisect_right(_LEVELS, n) - 1


def _combined(tokens: np.ndarray, need: int, level: int) -> np.ndarray:
    """Signatures of a level that cover `need` of the frequent tokens."""
    low = _LEVELS[level]
    if low < _CLASS_SIZE:
        return mixed(tokens[:need] + np.uint64(level + 1))
    part = (mixed(tokens + np.uint64(7)) % np.uint64(max(1, low // _CLASS_SIZE))).astype(np.int64)
    seen: dict[int, list[int]] = {}
    out, covered = [], 0
    for k, p in enumerate(part.tolist()):
        if covered >= need:
            break
        held = seen.setdefault(p, [])
        out += [(i, k) for i in held]
        covered += bool(held)
        held.append(k)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return mixed(mixed(tokens[pairs[:, 0]]) * _ODD + tokens[pairs[:, 1]] + np.uint64(level + 1))


def signatures(shingles: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's signatures, their roles, and how many of them are single rare shingles (they come first)."""
    shift = np.uint64(64 - len(classes).bit_length() + 1)
    kind = classes[(shingles >> shift).astype(np.int64)]
    order = np.argsort(kind, kind="stable")
    rare = int((kind < _OFTEN).sum())
    probe, index = needs(len(shingles), percent)
    single = shingles[order[: min(rare, probe)]]
    out, role = [single], [np.where(np.arange(len(single)) < index, _PROBE | _INDEX, _PROBE)]
    if rare < probe:
        often, level = shingles[order[rare:]], _level(len(shingles))
        todo = [(probe - rare, level, _PROBE)]
        todo += [(index - rare, k, _INDEX) for k in (level, level + 1) if index > rare]
        for need, k, what in todo:
            out.append(_combined(often, need, k))
            role.append(np.full(len(out[-1]), what))
    return np.concatenate(out), np.concatenate(role).astype(np.uint8), len(single)


def parity(shingles: np.ndarray) -> bytes:
    """A bitmap of about two bits a shingle: which hashed places an odd number of them have."""
    bits = 1 << max(6, (2 * len(shingles)).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def short_parity(shingles: np.ndarray) -> list[int]:
    """The same bitmap in fewer bits, as signed 64-bit words. Sets of which one may link to the other are at most one doubling apart."""
    bits = min(_LONG, max(_SHORT, 1 << (4 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets: the larger bitmap is folded to the smaller one's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, set_id, parity, short) for each row."""

    @released
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            found = [(len(s), set_id(s), parity(s), short_parity(s)) for s in shingle_sets(as_bytes(batch["text"]))]
            made = pd.DataFrame(found, columns=["n", "set_id", "parity", "short"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            made.insert(1, "key", batch["key"].to_numpy())
            yield made.astype({"doc_id": "Int64", "n": "int64", "set_id": "int64"})

    return docs.mapInPandas(run, "doc_id long, key long, n long, set_id long, parity binary, short array<long>")


def _sketch(rows: Iterator[pd.DataFrame]) -> np.ndarray:
    total, sets, size = np.zeros(CELLS, np.int64), [], 0
    shift = np.uint64(64 - CELLS.bit_length() + 1)

    def add() -> None:
        cells, n = np.unique(np.concatenate(sets) >> shift, return_counts=True)
        total[cells.astype(np.int64)] += n
        sets.clear()

    for batch in rows:
        for s in shingle_sets(as_bytes(batch["text"])):
            sets.append(s)
            size += len(s)
            if size >= 300_000:
                add()
                size = 0
    if sets:
        add()
    return total


def _buckets(docs: DataFrame, classes, parts: int, percent: int) -> DataFrame:
    """(sig, set_id, n, role) of all signatures that more than one set has.

    Tasks send arrays for each part, not rows. A part holds all sets of its rare signatures, so that those with one set
    go there; combinations of frequent shingles are dealt out by set as well, and all of them stay.
    """

    def packed(sig: np.ndarray, ids: np.ndarray, n: np.ndarray, role: np.ndarray) -> bytes:
        return b"".join((np.int64(len(sig)).tobytes(), sig.tobytes(), ids.tobytes(), n.tobytes(), role.tobytes()))

    def unpacked(data: bytes) -> tuple:
        k = int(np.frombuffer(data, np.int64, 1)[0])
        at, out = 8, []
        for kind in (np.uint64, np.int64, np.uint32, np.uint8):
            out.append(np.frombuffer(data, kind, k, at))
            at += k * np.dtype(kind).itemsize
        return tuple(out)

    @released
    def emit(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            sig = np.concatenate([x[0] for x in kept])
            ids = np.repeat(np.array([x[3] for x in kept], np.int64), [len(x[0]) for x in kept])
            n = np.repeat(np.array([x[4] for x in kept], np.uint32), [len(x[0]) for x in kept])
            role = np.concatenate([x[1] for x in kept])
            often = np.concatenate([np.arange(len(x[0])) >= x[2] for x in kept])
            part = np.where(often, mixed(sig ^ mixed(ids.view(np.uint64))), mixed(sig)) % np.uint64(parts)
            slot = part.astype(np.int64) * 2 + often
            order = np.argsort(slot, kind="stable")
            cuts = np.searchsorted(slot[order], np.arange(2 * parts + 1))
            out = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[k] : cuts[k + 1]]
                out.append((k // 2, bool(k % 2), packed(sig[at], ids[at], n[at], role[at])))
            kept.clear()
            yield pd.DataFrame(out, columns=["part", "often", "data"])

        for batch in rows:
            for s in shingle_sets(as_bytes(batch["text"])):
                if len(s):
                    kept.append((*signatures(s, classes.value, percent), set_id(s), len(s)))
                    size += len(kept[-1][0])
                    if size > 300_000:
                        yield from flush()
                        size = 0
        if kept:
            yield from flush()

    def shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sig, ids, n, role = (np.concatenate(x) for x in zip(*map(unpacked, rows["data"]), strict=True))
        order = np.lexsort((ids, sig))
        sig, ids, n, role = sig[order], ids[order], n[order], role[order]
        first = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])))
        role = np.bitwise_or.reduceat(role, first)
        sig, ids, n = sig[first], ids[first], n[first]
        if not key[1]:
            same = sig[1:] == sig[:-1]
            keep = np.append(False, same) | np.append(same, False)
            sig, ids, n, role = sig[keep], ids[keep], n[keep], role[keep]
        return pd.DataFrame({"sig": sig.view(np.int64), "set_id": ids, "n": n.astype(np.int64), "role": role.astype(np.int32)})

    sent = docs.mapInPandas(emit, "part int, often boolean, data binary")
    return sent.groupBy("part", "often").applyInPandas(shared, "sig long, set_id long, n long, role int")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose bitmaps allow a link."""

    @released
    def kept(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            both = (batch["na"] + batch["nb"]) * (100 - percent)
            least = np.array([apart_at_least(x, y) for x, y in zip(batch["pa"], batch["pb"], strict=True)], np.int64)
            yield batch.loc[least * (100 + percent) <= both, ["a", "b"]]

    of = lambda k: reps.select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").mapInPandas(kept, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) of set ids that are linked, by their whole sets.

    The sets of the nodes in question are made anew from their first documents; a bitmap of fixed size over their keys
    spares the others, and the join that follows settles what it lets through.
    """

    def cells(keys: pd.Series) -> np.ndarray:
        return (mixed(keys.to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)

    def marked(rows: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(CELLS, np.int64)
        for batch in rows:
            total[cells(batch["key"])] = 1
        return total

    @released
    def remade(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = cells(batch["key"])
            some = batch[(bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)]
            made = [(k, s.tobytes()) for k, s in zip(some["key"], shingle_sets(as_bytes(some["text"])), strict=True)]
            yield pd.DataFrame(made, columns=["key", "shingles"])

    @released
    def linked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            keep = []
            for x, y in zip(batch["sx"], batch["sy"], strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    with held(_plausible(pairs, reps, percent)) as near:
        ids = near.select(F.col("a").alias("set_id")).unionAll(near.select(F.col("b").alias("set_id"))).distinct()
        with held(ids.join(reps, "set_id").select("set_id", F.col("first.key").alias("key"))) as wanted:
            bits = docs.sparkSession.sparkContext.broadcast(np.packbits(summed(wanted.select("key"), marked, CELLS, kind=bool)))
            sets = docs.select("key", "text").mapInPandas(remade, "key long, shingles binary").join(wanted, "key").select("set_id", "shingles")
            with held(sets.dropDuplicates(["set_id"]), "none") as whole:
                of = lambda k, s: whole.select(F.col("set_id").alias(k), F.col("shingles").alias(s))
                return written(near.join(of("b", "sy"), "b").join(of("a", "sx"), "a").mapInPandas(linked, "a long, b long"))


@cleaned
def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach. A text without words (or null) has no shingles and is its own
    component. Repeated rows have equal sets and stay as rows; key is a hash of id and text; kept marks the rows of
    the component's first key (a null doc_id comes last). Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    nodes = written(_nodes(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    reps = written(nodes.where("n > 0").groupBy("set_id", "n").agg(first, F.first("parity").alias("parity"), F.first("short").alias("short")))
    counts = summed(docs.select("text"), _sketch, CELLS)
    classes = spark.sparkContext.broadcast(frequency_classes(counts))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() // 12_000_000) + 1)
    del counts  # 33 MB of the driver
    placed = written(_buckets(docs.select("text"), classes, parts, percent).withColumn("label", F.col("set_id")))

    close = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and x.label <> y.label"
    known = labels = None

    def compared(pairs: DataFrame) -> None:
        """Looks at pairs that weren't looked at, joins the components that they link, and labels what is still open anew."""
        nonlocal known, labels, placed
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        found = _verified(pairs, docs, reps, percent)
        known = pairs if known is None else known.unionAll(pairs)
        if labels is None:
            reached = connected_components(found)
            labels = written(reached)
        else:  # only components that are linked anew: their labels stand for their sets
            of = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"))
            ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            reached = connected_components(ends)
            again = reached.select(F.col("id").alias("label"), F.col("label").alias("to"))
            moved = labels.join(again, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            alone = reached.join(labels, "id", "left_anti")
            old_labels, labels = labels, written(moved.unionAll(alone))
            free(old_labels)
        free(found)
        fresh = placed.drop("label").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        fresh = written(fresh)
        # Signatures of the same sets in the same roles give the same pairs: one of them stays.
        marks = [F.sum(F.xxhash64("set_id", "role", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in range(2)]
        still = fresh.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *marks).where("lo <> hi")
        old, placed = placed, written(fresh.join(still.groupBy("mark0", "mark1").agg(F.min("sig").alias("sig")), "sig", "left_semi"))
        free(old, fresh, reached)

    def open_pairs() -> tuple[float, float]:
        """The signatures' rows, and pairs of sets of one signature in different components."""
        each = placed.groupBy("sig", "label").agg(F.count("*").cast("double").alias("n")).groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        return tuple(each.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first())

    before = float("inf")
    for turn in range(_MOST_TURNS):
        if placed.isEmpty():
            break
        if turn >= _TURNS - 1:
            rows, pairs = open_pairs()
            if turn >= _TURNS and (pairs <= 2 * rows or pairs > _LEFT * before):
                break
            before = pairs
        drawn = F.struct(F.xxhash64("set_id", F.lit(turn)).alias("draw"), "set_id", "n", "label")
        pivots = placed.groupBy("sig").agg(F.min(drawn).alias("p")).select("sig", "p.set_id", "p.n", "p.label")
        pivots = written(pivots)
        met = pivots.alias("x").join(placed.alias("y"), "sig").where(f"x.set_id <> y.set_id and {close}")
        shared = met.groupBy(F.col("y.set_id").alias("a"), F.col("x.set_id").alias("b")).agg(F.count("*").alias("sigs"))
        compared(shared.groupBy("a").agg(F.max(F.struct("sigs", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
        free(pivots)
    larger = "(x.n > y.n or x.n = y.n and x.set_id > y.set_id)"
    least = "least(size(x.short), size(y.short))"
    folded = "if(size({0}.short) > {1}, zip_with(slice({0}.short, 1, {1}), slice({0}.short, {1} + 1, {1}), (v, w) -> v ^ w), {0}.short)"
    apart = f"aggregate(zip_with({folded.format('x', least)}, {folded.format('y', least)}, (v, w) -> bit_count(v ^ w)), 0, (s, v) -> s + v)"
    near = f"{100 + percent} * {apart} <= {100 - percent} * (x.n + y.n)"
    # A pair is made at its smallest common signature; where that isn't among those that both carry, at each.
    smallest = lambda role: F.slice(F.sort_array(F.collect_list(F.when(F.col("role").bitwiseAND(role) > 0, F.col("sig")))), 1, _FIRST)
    firsts = placed.groupBy("set_id").agg(smallest(_PROBE).alias("probes"), smallest(_INDEX).alias("indexes"))
    once = "coalesce(array_min(array_intersect(x.probes, y.indexes)) >= x.sig, true)"
    short = placed.join(reps.select("set_id", "short"), "set_id").join(firsts, "set_id")
    rest = None if placed.isEmpty() else short.alias("x").join(short.alias("y"), "sig").where(f"{larger} and {close} and x.role & {_PROBE} > 0 and y.role & {_INDEX} > 0 and {near} and {once}")
    if rest is not None:
        compared(rest.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")))

    member = reps.withColumn("label", F.lit(None).cast("long")) if labels is None else reps.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    member = member.select("set_id", "n", "first", F.coalesce("label", "set_id").alias("label"))
    leasts = member.groupBy("label").agg(F.min("first").alias("least"))
    of_set = written(member.join(leasts, "label").select("set_id", "n", "least"))
    free(placed, labels, reps)
    out = nodes.drop("parity", "short").join(of_set, ["set_id", "n"], "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), ((F.col("n") == 0) | (F.col("key") == F.col("least.key"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns and rows of docs, one row for each component of near copies: that of its smallest doc_id (a null one comes last).

    Rows without words (or null) all stay; rows equal in doc_id and text are one; an empty table stays empty. Columns
    named as the join's own are carried like any other.
    """
    kept = link_components(docs).where("kept").select("key").distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(kept, keyed["_row_key"] == kept["key"], "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2
"""
