"""What the operators of this package share: scratch tables, Arrow slices, hashing of text in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.session import shared_dir

SLICE_BYTES = 4 << 20
Kept = TypeVar("Kept")


#: Folders given out by :func:`scratch` in this process.
FOLDERS: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; nothing of an earlier run is read again."""
    FOLDERS.append(f"{shared_dir(spark).rstrip('/')}/siftline/{name}-{uuid.uuid4().hex}")
    return FOLDERS[-1]


def discard(folders: list[str], docs: DataFrame) -> None:
    """Delete ``folders`` on their file system, but for those that ``docs`` reads."""
    spark, read = docs.sparkSession, docs.inputFiles()
    for folder in folders:
        if not any(folder.rpartition("/")[2] in file for file in read):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """What a Python worker keeps under ``key`` from task to task, made once. It keeps one such thing at a time."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give up what earlier tasks of this Python worker have kept: Spark hands a worker on from stage to stage and from query
    to query, and an executor has to hold all of its workers."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def whole(text: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column``, so that Python objects of few rows live at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        place = np.cumsum(np.nan_to_num(sizes)) // most
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
        del batch  # before the next one is read


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
