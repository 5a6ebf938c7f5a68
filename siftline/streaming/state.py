"""State tables of streaming jobs: the newest row of every key, written in proportion to the keys that a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Default number of buckets of keys; a batch reads only the buckets of its keys.
BUCKETS = 64


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class StateTable:
    """Versions of keyed rows under ``root``, one folder for each micro-batch.

    Version ``m`` (batch ``m - 1``) holds the newest rows of the keys that the last ``m & -m`` batches touched. Every second
    version is therefore the rows of its own batch, every fourth those of two more, and so on: the state after
    version ``m`` is spread over at most ``log2(m) + 1`` versions, and a row is written again at most ``log2(m)`` times.
    A batch that is run again after a failure reads the same versions before it and replaces its own, so every
    batch counts once. Versions that others replace are deleted two batches later; until then they can be read. The
    folder must outlive executors: a shared folder on a cluster.
    """

    def __init__(self, root: str, schema: str, key: tuple[str, ...] = ("domain",), buckets: int = BUCKETS) -> None:
        self.root, self.schema, self.key, self.buckets = root, schema, list(key), buckets

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    @staticmethod
    def _chain(version: int, down_to: int = 0) -> list[int]:
        """The versions that make up the state after ``version``, the newest first, as far as they are above ``down_to``."""
        out = []
        while version > down_to:
            out.append(version)
            version -= version & -version
        return out

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _stored(self, spark: SparkSession, versions: list[int]) -> DataFrame:
        """Rows of ``versions`` with their ``bucket`` and ``version``."""
        read = spark.read.schema(f"{self.schema}, bucket int, version int").option("basePath", self.root)
        return read.parquet(*map(self._path, versions))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.key, "bucket", "version")]
        return rows.groupBy("bucket", *self.key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("bucket", *self.key, "_r.*")

    def at(self, spark: SparkSession, batch: int) -> DataFrame:
        """All rows as batch ``batch`` left them."""
        stored = self._stored(spark, self._chain(batch + 1))
        return self._newest(stored).select(*[f.name for f in stored.schema.fields if f.name not in ("bucket", "version")])

    def before(self, keys: DataFrame, batch: int, initial: DataFrame | None = None) -> DataFrame | None:
        """The rows of ``keys`` as the batch before left them.

        The first batch gets all rows of ``initial``, and must write them.
        """
        if batch == 0:
            return initial
        spark = keys.sparkSession
        wanted = keys.select(*self.key).distinct().withColumn("bucket", self._bucket())
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most ``self.buckets``
        stored = self._stored(spark, self._chain(batch)).filter(F.col("bucket").isin(buckets))
        return self._newest(stored.join(wanted, ["bucket", *self.key], "left_semi")).drop("bucket")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Write ``rows``, the new rows of the keys that ``batch`` touches, each key once."""
        spark, version = rows.sparkSession, batch + 1
        rows = rows.withColumn("bucket", self._bucket())
        if held := self._chain(version - 1, version - (version & -version)):
            both = rows.withColumn("version", F.lit(version)).unionByName(self._stored(spark, held))
            rows = self._newest(both)
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(version))
        replacing = version - 2
        if replacing > 0:
            for old in self._chain(replacing - 1, replacing - (replacing & -replacing)):
                delete_folder(spark, self._path(old))
