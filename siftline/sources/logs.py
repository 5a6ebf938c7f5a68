"""Logs in append order: lines keep the place they have in their files, in batch and as a stream that follows growing files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as AFS
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as TY
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftline.operators.ordered import top_k
from siftline.sources.files import parse_lines

#: The job that wrote a file, in the name the writer gives it; any other file is a job of its own.
_JOB = r"^part-\d+-([0-9a-f-]{36})"
#: Bytes of a growing file that one task reads.
RANGE_BYTES = 128 << 20
CHUNK = 1 << 20


# --- batch ----------------------------------------------------------------------------------------


def _plain(path: Column) -> Column:
    """A path with one slash behind its scheme: readers write it in two ways."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def _file_order(spark: SparkSession, path: str) -> DataFrame:
    """``file, since, job`` of every file: when the job that wrote it left its first file in that folder. Only the listing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_plain(F.col("path")).alias("file"), "modificationTime")
    name = F.element_at(F.split("file", "/"), -1)
    job = F.coalesce(F.nullif(F.regexp_extract(name, _JOB, 1), F.lit("")), name)
    of = listed.select("file", job.alias("job"), F.regexp_replace("file", r"/[^/]*$", "").alias("folder"), "modificationTime")
    first = of.groupBy("folder", "job").agg(F.min("modificationTime").alias("since"))
    return of.join(first, ["folder", "job"]).select("file", "since", "job")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``run_dir, place, value`` of every line under ``path``; ``place`` sorts a folder's lines in the order they were appended.

    Files come in the order of the jobs that wrote them, then by name. Inside a file a line is placed by the start of its split
    and its number in it, so a large file is read by many tasks. Jobs that wrote to a folder within the same tick of the file
    system's clock are ordered by their names.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("run_dir"), _plain(file).alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    return lines.join(_file_order(spark, path), "file").select("run_dir", F.struct("since", "job", "file", "block", "line").alias("place"), "value")


def read_json_log(spark: SparkSession, path: str, schema: str | TY.StructType) -> DataFrame:
    """JSON-lines logs with ``run_dir`` and ``place``; lines that do not hold one object are dropped."""
    return parse_lines(ordered_lines(spark, path), "value", schema)


def last_lines(log: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` readable lines of every folder, ``nth`` counted from the last one."""
    keyed = log.withColumn("_spread", F.xxhash64("place.file", "place.line"))
    return top_k(keyed, ["run_dir"], [F.desc("place")], limit, "_spread", rank="nth").drop("_spread")


# --- stream ---------------------------------------------------------------------------------------


class LineRange(InputPartition):
    """The lines of a file that begin in ``[start, stop)``."""

    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


def ranges(path: str, start: int, stop: int, most: int) -> list[LineRange]:
    return [LineRange(path, a, min(a + most, stop)) for a in range(start, stop, most)]


def lines_of(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Byte offset and bytes of each line that begins in ``[start, stop)``; what has no line end yet is left for later."""
    at = start
    if start:
        file.seek(start - 1)
        at = None  # a line that began before belongs to the range before
    held, base = b"", max(start - 1, 0)
    while chunk := file.read(CHUNK):
        held += chunk
        begin = 0
        while (end := held.find(b"\n", begin)) >= 0:
            if at is not None:
                if at >= stop:
                    return
                yield at, held[begin:end]
            begin = end + 1
            at = base + begin
        held, base = held[begin:], base + begin
        if at is not None and at >= stop:
            return


class GrowingLogReader(DataSourceStreamReader):
    """Offsets are the ends of the last whole line of each file; a line that is still being written waits."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}

    def _open(self) -> tuple[AFS.FileSystem, str]:
        return AFS.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (AFS.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = self._open()
        for info in files.get_file_info(AFS.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or info.base_name.startswith((".", "_")):
                continue
            size, end = self.ends.get(info.path, (0, 0))
            if info.size != size:
                with files.open_input_file(info.path) as file:
                    self.ends[info.path] = info.size, _last_end(file, info.size, end)
        return {path: end for path, (_, end) in sorted(self.ends.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return [r for path, stop in sorted(end.items()) for r in ranges(path, start.get(path, 0), stop, self.most)]

    def read(self, partition: LineRange) -> Iterator[tuple[str, int, str]]:
        files, _ = self._open()
        with files.open_input_file(partition.path) as file:
            for at, line in lines_of(file, partition.start, partition.stop):
                yield partition.path, at, line.decode("utf-8", "replace")


def _last_end(file: pa.NativeFile, size: int, known: int) -> int:
    """The place behind the last line end before ``size``; ``known`` is an earlier one."""
    at = size
    while at > known:
        a = max(known, at - CHUNK)
        file.seek(a)
        found = file.read(at - a).rfind(b"\n")
        if found >= 0:
            return a + found + 1
        at = a
    return known


class GrowingLog(DataSource):
    """Lines of files that grow, ``file, at, value``: ``at`` is the line's byte offset, which orders the lines of a file.

    The option ``path`` names a folder on any file system that Arrow can open. A large piece of a file is read in ranges by
    many tasks. Progress is one number for each file, so a restarted stream goes on where it was. Files only grow.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema: TY.StructType) -> GrowingLogReader:
        return GrowingLogReader(dict(self.options))


def follow_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the whole lines that are appended to the files below ``path``."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", path).option("rangeBytes", range_bytes).load()
