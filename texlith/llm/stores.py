"""Sorted arrays by parts of a hash range, written by tasks as files that all executors can map."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm._common import local_path, opened, shared_folder

ROWS = "kind string, part int, data binary"


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys, so that all parts' arrays in a row are one sorted array."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and where, in order."""
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def by_part(rows: DataFrame, parts: int, one) -> DataFrame:
    """The rows of one(part, blobs by kind) for each part, each in a task of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: dict[int, dict[str, list[bytes]]] = {}
        for batch in batches:
            for kind, part, data in batch.itertuples(index=False):
                given.setdefault(part, {}).setdefault(kind, []).append(data)
        for part in sorted(given):
            yield pd.DataFrame(one(part, given.pop(part)), columns=["kind", "part", "data"])

    return rows.repartitionById(parts, "part").mapInPandas(run, ROWS)


class Store:
    """Files in a folder that driver and executors share.

    Where the shared folder is a path of the file system, tasks write the files there and workers map them in place. In
    a store that only Spark opens, tasks return the files as table rows, the table goes to each executor by addFile, and
    the first worker that needs a file unpacks them beside it.
    """

    def __init__(self, spark: SparkSession, mapped: bool | None = None):
        self.folder = shared_folder(spark)
        self.direct = local_path(spark, self.folder) if mapped is not False else None
        self.tables: list[str] = []
        opened(self.folder)

    def write(self, level: int, part: int, data: bytes) -> list[tuple[str, int, bytes]]:
        name = f"n{level}-{part}"
        if not self.direct:
            return [(f"file {name}", part, data)]
        os.makedirs(self.direct, exist_ok=True)
        held = f"{self.direct}/.{name}-{uuid.uuid4().hex}"
        with open(held, "wb") as f:
            f.write(data)
        os.replace(held, f"{self.direct}/{name}")  # a task that runs again writes the same
        return []

    def ran(self, rows: DataFrame) -> DataFrame:
        """Runs the tasks; gives the rows that are no files, and shares the files."""
        if self.direct:
            return rows
        path = f"{self.folder}-{len(self.tables)}"
        rows.write.option("compression", "none").parquet(path)
        rows = rows.sparkSession.read.schema(ROWS).parquet(path)
        rows.where(F.col("kind").startswith("file ")).write.option("compression", "none").parquet(f"{path}-files")
        rows.sparkSession.sparkContext.addFile(f"{path}-files", recursive=True)
        self.tables.append(os.path.basename(path) + "-files")
        return rows.where(~F.col("kind").startswith("file "))

    def read(self, name: str, size: int) -> np.ndarray:
        """The file's bytes; one that isn't there or isn't of this size raises."""
        path = f"{self.direct or _unpack(tuple(self.tables))}/{name}"
        if os.path.getsize(path) != size:
            raise OSError(f"{path} doesn't have the {size} bytes that were written")
        return np.asarray(np.memmap(path, np.uint8, "r"))


@lru_cache(4)
def _unpack(tables: tuple[str, ...]) -> str:
    """Files from an executor's copies of the tables, unpacked once for all its workers."""
    import fcntl

    import pyarrow.parquet as pq

    to = os.path.join(SparkFiles.getRootDirectory(), tables[-1] + "-unpacked")
    with open(to + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(to):
            os.makedirs(to + ".part", exist_ok=True)
            for table in tables:
                top = SparkFiles.get(table)
                for f in sorted(x for x in os.listdir(top) if x.endswith(".parquet")):
                    for batch in pq.ParquetFile(os.path.join(top, f)).iter_batches(4):
                        for row in batch.to_pylist():
                            with open(f"{to}.part/{row['kind'].split(' ')[1]}", "wb") as out:
                                out.write(row["data"])
            os.rename(to + ".part", to)
    return to
