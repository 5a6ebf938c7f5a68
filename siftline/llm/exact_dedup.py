"""Exact dedup as a stateful stream: keyed state on disk that never expires, and a comparison of full bytes on every hit.

A feed of content digests is read as a stream. For every digest the state (RocksDB) keeps the number of rows, the
stable identifier of the row that stays and the locator of its content; rows of a digest are combined inside each task
before they are shuffled, so a text that makes up a third of all rows costs one row per task. Each micro-batch writes
the states it changed. Every row with the digest of another one is then compared with the content under the locator,
byte by byte; rows that only share the digest are grouped anew by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.llm.common import cut, scratch, whole

#: State on disk. Without the second line every partition's store reserves megabytes of disk that it may never use; without
#: the last one an executor holds the stores of all its partitions open, each with megabytes of memory outside the heap.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_states(spark: SparkSession, feed: str, batch_bytes: int = 1 << 30) -> DataFrame:
    """The state after the stream has read all of ``feed``: ``digest, keep_id, at, group_size``.

    ``batch_bytes`` bounds a micro-batch. A batch that is run again after a failure overwrites its own folder.
    """
    out, checkpoint = scratch(spark, "dedup-states"), scratch(spark, "dedup-checkpoint")
    rows = spark.readStream.schema(spark.read.parquet(feed).schema).option("maxBytesPerTrigger", batch_bytes).parquet(feed)
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("last"), F.count(F.lit(1)).alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    written = spark.read.schema("digest string, last struct<doc_id:bigint,at:string>, group_size bigint, batch bigint").parquet(out)
    newest = written.groupBy("digest").agg(F.max_by(F.struct("last", "group_size"), "batch").alias("s"))
    return newest.select("digest", F.col("s.last.doc_id").alias("keep_id"), F.col("s.last.at").alias("at"), "s.group_size")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 1 << 30) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, digest, keep_id, group_size, kept``.

    Of rows with equal texts the one with the largest ``doc_id`` stays. A null text is the empty text. Rows that repeat
    both id and text are all kept if theirs is the largest id; a null id is smaller than any other and stays only in a
    group without ids. Other columns are not read. An empty table gives an empty result. ``digest`` may be any function
    of the text: a weak one costs time, never rows.
    """
    spark = docs.sparkSession
    content = docs.select(F.col("doc_id").cast("bigint"), whole().alias("text"))
    feed = scratch(spark, "dedup-feed")
    # The locator of a content is the file that holds it, beside its identifier.
    content.select("doc_id", digest(F.col("text")).alias("digest"), F.input_file_name().alias("at")).write.parquet(feed)
    fed = spark.read.parquet(feed)
    if fed.isEmpty():
        return fed.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    # Both sides are read from tables, so that Spark can split a digest that many rows have.
    rows = fed.join(cut(digest_states(spark, feed, batch_bytes), "dedup-groups"), "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))

    hits = rows.filter("group_size > 1").select("doc_id", "digest", "keep_id").distinct()
    keyed = content.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    # Whole texts are shuffled once; behind that join there are only the texts of rows with a hit.
    found = keyed.join(hits.withColumnsRenamed({"doc_id": "h_id", "digest": "h_digest"}), keyed.doc_id.eqNullSafe(F.col("h_id")) & (keyed.digest == F.col("h_digest"))).select("doc_id", "digest", "keep_id", "text")
    found = cut(found, "dedup-hits")
    keepers = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("text").alias("kept_text"))
    other = found.join(cut(keepers, "dedup-keepers"), "digest").filter(F.col("text") != F.col("kept_text"))
    if other.isEmpty():
        return rows
    # Equal digests of different texts: group the rows of those digests by the texts themselves.
    digests = other.select("digest").distinct()
    apart = keyed.join(digests, "digest")
    by_text = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = apart.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return rows.join(digests, "digest", "left_anti").select(again.columns).unionByName(again)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    same = docs.doc_id.cast("bigint").eqNullSafe(F.col("_kept_id")) & (sha256(F.coalesce(docs.text.cast("string"), F.lit(""))) == F.col("_kept_digest"))
    return docs.join(kept, same, "left_semi")
