"""Pieces that several corpus operators share: shared-folder tables, word hashes, fixed-size sums."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into arrays at once, which take about 50 bytes for each byte of text.
SLICE_BYTES = 1 << 19
#: The same for words.
WORD_BYTES = 1 << 19

_KEY, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
#: Longer spans are hashed one by one.
_LONG_SPAN = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset a local master gets a folder of this machine; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + _own_folder()
    return f"{base.rstrip('/')}/texlith-{uuid.uuid4().hex}"


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="texlith-")


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, or None if only Spark can open it."""
    scheme = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return "/" + path.removeprefix("file:").lstrip("/") if scheme == "file" else None


#: Folders whose tables were read back whole.
_shared: set[str] = set()
#: Tables of the operators that are being called, innermost last.
_open: list[list[str]] = []


def opened(path: str) -> None:
    """Says that an operator wrote a folder, so that it is deleted some time."""
    if _open:
        _open[-1].append(path)


def written(df: DataFrame, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives a lost executor.

    Off local masters the first table of a process is counted again after it was written, so that a folder that the
    driver and the executors don't share raises.
    """
    spark, path = df.sparkSession, path or shared_folder(df.sparkSession)
    opened(path)
    schema, base = df.schema, path.rsplit("/", 1)[0]
    check = base not in _shared and not is_local(spark) and local_path(spark, path) is not None
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if check else df).write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    if check:
        n = seen.get["n"]
        if out.count() != n:
            raise RuntimeError(f"{path} lacks rows that were written: it isn't a folder that the driver and all executors share")
        if n:
            _shared.add(base)
    out.shared_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "shared_path", None):
            remove(table.sparkSession, path)


@contextmanager
def held(df: DataFrame, compression: str = "zstd") -> Iterator[DataFrame]:
    """The rows as such a table for the time of the block."""
    path = shared_folder(df.sparkSession)
    try:
        yield written(df, compression, path)
    finally:
        remove(df.sparkSession, path)


def cleaned(operator: Callable) -> Callable:
    """Tables that an operator wrote go if it fails; those that its result reads go when the process ends."""

    @wraps(operator)
    def call(*args, **kwargs):
        _open.append([])
        try:
            return operator(*args, **kwargs)
        except BaseException:
            for path in _open[-1]:
                remove(SparkSession.getActiveSession(), path)
            raise
        finally:
            _left.extend(_open.pop())

    return call


_left: list[str] = []


@atexit.register
def _remove_left() -> None:
    spark = SparkSession.getActiveSession()
    for path in _left if spark is not None else []:
        with suppress(Exception):  # the JVM may be gone
            remove(spark, path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(data: bytes, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first min(length, 8) bytes at each place as a number, of data that goes on for 8 bytes after the last place."""
    every = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    return every[at] & (_ALL >> (np.uint64(8) * (8 - np.minimum(length, 8)).astype(np.uint64)))


_ALL = np.uint64(2**64 - 1)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], none of them empty, the same wherever the bytes stand; 8 bytes a round, each round mixed by a bijection."""
    data, length = bytes(data) + bytes(8), ends - starts
    h = mixed(length.astype(np.uint64) * _ODD + _KEY)
    h = mixed(h ^ blocks(data, starts, length))
    live = np.flatnonzero((length > 8) & (length <= _LONG_SPAN))
    at = 8
    while len(live):
        h[live] = mixed((h[live] * _ODD + _KEY) ^ blocks(data, starts[live] + at, length[live] - at))
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > _LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def same_spans(data: bytes, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a + length] and data[b:b + length] have the same bytes."""
    data, out, at = bytes(data) + bytes(8), np.ones(len(a), bool), 0
    live = np.flatnonzero(a != b)
    while len(live):
        x, y, n = a[live] + at, b[live] + at, length[live] - at
        out[live] = blocks(data, x, n) == blocks(data, y, n)
        at += 8
        live = live[out[live] & (length[live] > at)]
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """Long texts cut at white space, so that arrays stay small."""
    at = 0
    while len(text) - at > 2 * WORD_BYTES:
        cut = at + WORD_BYTES
        while cut < len(text) and not SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes each; a larger row stands alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` after A-Z to a-z, and where each text's words begin (one more at the end)."""
    parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t or b"")]
    counts = np.zeros(len(texts) + 1, np.int64)
    out = []
    for a, b in slices([len(p) for _, p in parts], WORD_BYTES):
        data = b" " + b" ".join(p for _, p in parts[a:b]).lower() + b" "
        space = SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        out.append(span_hashes(data, starts, ends))
        firsts = np.cumsum([0] + [len(p) + 1 for _, p in parts[a : b - 1]]) + 1
        bounds = np.append(np.searchsorted(starts, firsts), len(starts))
        np.add.at(counts, [i + 1 for i, _ in parts[a:b]], np.diff(bounds))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def as_bytes(column: pd.Series) -> list[bytes]:
    """A binary column's values; null is empty."""
    return [b"" if x is None else bytes(x) for x in column]


def as_texts(column: pd.Series) -> list[str]:
    """A string column's values; null is empty."""
    return [x if isinstance(x, str) else "" for x in column]


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function of rows, that gives back what it freed: a worker stays for later tasks, and memory that its allocators keep would add to theirs and the JVM's."""

    @wraps(run)
    def call(rows: Iterator) -> Iterator:
        try:
            yield from run(rows)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return call


def summed(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray], cells: int, step: int = 1 << 16, kind: type = np.int64) -> np.ndarray:
    """The sum over tasks of partial(rows), an array of `cells` counts (of `kind`; bool: whether there are any): fixed size, whatever the input.

    Each task sends its array in chunks; a chunk's arrays are added one after another as they stream in,
    so that no task holds more than one array a chunk.
    """

    def packed(chunk: int, a: np.ndarray) -> pd.DataFrame:
        small = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        return pd.DataFrame({"chunk": [chunk], "kind": [small.dtype.str], "cells": [small.tobytes()]})

    def unpacked(row) -> np.ndarray:
        return np.frombuffer(row.cells, row.kind).astype(np.int64)

    @released
    def emit(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = partial(rows)
        for at in range(0, cells, step):
            if a[at : at + step].any():
                yield packed(at // step, a[at : at + step])

    @released
    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in rows:
            for row in batch.itertuples():
                held[row.chunk] = held[row.chunk] + unpacked(row) if row.chunk in held else unpacked(row)
        for chunk, a in held.items():
            yield packed(chunk, a)

    schema = "chunk int, kind string, cells binary"
    total = np.zeros(cells, kind)
    for row in df.mapInPandas(emit, schema).repartition(-(-cells // step), "chunk").mapInPandas(add, schema).collect():
        a = unpacked(row)
        total[row.chunk * step : row.chunk * step + len(a)] = a
    return total


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_folder() named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def threads() -> int:
    """Threads a worker may use, if it wants several."""
    return max(1, int(os.environ.get("OMP_NUM_THREADS", "1") or 1))
