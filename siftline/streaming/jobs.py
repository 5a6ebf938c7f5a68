"""Structured Streaming forms of the log-driven operators.

The learners reuse the batch operators inside ``foreachBatch``, on top of the stored rows of the domains that a batch
touches, so hot keys are handled as in batch. They depend on the order of ``seq``: rows can wait for others for a given
delay, and those that come later still are put aside. The shortlist keeps the rows that decide its merge and is exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as TY
from pyspark.sql.streaming import StreamingQuery

from siftline.operators import patterns as PT, shortlist as SL, tactics as TC
from siftline.operators.runs import model_call
from siftline.sources.files import TIME_FORMAT
from siftline.streaming.state import StateTable, delete_folder

TACTICS_SCHEMA = "domain string, preferred_tool string, reason string, last_verified timestamp_ntz, success_count long, pos long"
PATTERNS_SCHEMA = (
    "domain string, param_names array<string>, path_hints array<string>, example_urls array<string>, "
    "success_count long, last_verified timestamp_ntz, pos long"
)
#: Default number of buckets of the shortlist's state; give a stream of many runs more.
BUCKETS = 64


def read_log(spark: SparkSession, path: str, schema: str | TY.StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of log files as a stream; the schema is given, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_log(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append a stream's rows to a log; rows without a time get the batch's."""
    rows = stream.withColumn("ts", F.coalesce("ts", F.current_timestamp().cast("timestamp_ntz")))
    return (
        rows.writeStream.format(fmt).option("timestampNTZFormat", TIME_FORMAT).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def _in_order(batch: DataFrame, root: str, n: int, late: str | None, delay: int) -> DataFrame:
    """The rows whose turn it is: the learners depend on the order of ``seq``.

    Rows wait in ``{root}-held`` until one of a ``seq`` more than ``delay`` above theirs has arrived, so that a delay of less
    than that changes nothing. A row not behind all those that were already learned (or without ``seq``) is too late: it goes
    to ``late``, see :func:`late_rows`, and the stream goes on; without such a folder it is an error.
    """
    spark = batch.sparkSession
    learned, seen = None, None
    rows = batch
    if n > 0:
        learned, seen = spark.read.schema("learned long, seen long").parquet(f"{root}-order/batch={n - 1}").first()
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{root}-held/batch={n - 1}"))
    behind = F.col("seq").isNotNull() if learned is None else F.coalesce(F.col("seq") > learned, F.lit(False))
    top, low, passed = batch.agg(F.max("seq"), F.min(F.when(~behind, F.col("seq"))), F.count_if(~behind)).first()
    highest = max((x for x in (seen, top) if x is not None), default=None)
    upto = max((x for x in (learned, None if highest is None else highest - delay) if x is not None), default=None)
    if late is not None:
        batch.filter(~behind).write.mode("overwrite").parquet(f"{late}/batch={n}")
    elif passed:
        raise ValueError(f"{passed} rows of micro-batch {n}, the first of them row {low}, come after row {learned}")
    ready = F.lit(False) if upto is None else F.col("seq") <= upto
    rows.filter(behind & ~ready).write.mode("overwrite").parquet(f"{root}-held/batch={n}")
    spark.range(1).select(F.lit(upto).cast("long").alias("learned"), F.lit(highest).cast("long").alias("seen")).write.mode("overwrite").parquet(f"{root}-order/batch={n}")
    if n > 1:
        delete_folder(spark, f"{root}-held/batch={n - 2}")
    return rows.filter(behind & ready)


def late_rows(spark: SparkSession, late: str, schema: str | TY.StructType) -> DataFrame:
    """Rows that came too late for a learner, with the micro-batch that brought them."""
    fields = TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(TY.StructType([*fields.fields, TY.StructField("batch", TY.LongType())])).parquet(late)


def learn_tactics(
    events: DataFrame, table: StateTable, checkpoint: str, initial: DataFrame | None = None, late: str | None = None, delay: int = 0
) -> StreamingQuery:
    """Tactics kept up to date from a stream of tool events; a micro-batch reads and writes the domains it touches."""

    def work(batch: DataFrame, n: int) -> None:
        rows = _in_order(batch, table.root, n, late, delay)
        prior = table.before(TC.tactic_signals(rows).select("domain"), n, initial)
        table.write(TC.learn_tactics(rows, prior).select(*TC.COLUMNS), n)

    return _each_batch(events, checkpoint, work)


def learn_patterns(
    visits: DataFrame, table: StateTable, checkpoint: str, initial: DataFrame | None = None, late: str | None = None, delay: int = 0
) -> StreamingQuery:
    """URL patterns kept up to date from a stream of visited URLs; a micro-batch reads and writes the domains it touches.

    Its URLs are taken apart once: what is learned from them is stored, and deleted by the batch after.
    """

    def work(batch: DataFrame, n: int) -> None:
        found = PT.learnable(_in_order(batch, table.root, n, late, delay))
        found.write.mode("overwrite").parquet(f"{table.root}-rows/batch={n}")
        rows = batch.sparkSession.read.schema(found.schema).parquet(f"{table.root}-rows/batch={n}")
        prior = table.before(rows.select("domain"), n, initial)
        table.write(PT.learn_from(rows, prior), n)
        if n > 0:
            delete_folder(batch.sparkSession, f"{table.root}-rows/batch={n - 1}")

    return _each_batch(visits, checkpoint, work)


def upsert_shortlist(candidates: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Shortlist kept up to date from a stream of candidate mentions, which may arrive in any order.

    The state of a key is its decisive rows, see :func:`siftline.operators.shortlist.decisive_rows`: a few, and one for each
    rise of a price since the last reset. A micro-batch reads and writes the keys it touches, not the log of all mentions.
    The merged rows are stored by batch, see :func:`current_shortlist`.
    """

    def work(batch: DataFrame, n: int) -> None:
        columns = [*SL.MERGED, *(["extra"] if "extra" in batch.columns else [])]
        rows = SL.accepted(SL.check_candidates(batch)).select(*columns).withColumn("mentions", F.lit(1).cast("long"))
        held = [f for f in rows.schema.fields if f.name not in SL.KEY]
        keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in SL.KEY)
        table = StateTable(f"{root}/state", f"{keys}, held array<{TY.StructType(held).simpleString()}>", tuple(SL.KEY), buckets)
        prior = table.before(rows.select(*SL.KEY), n)
        both = rows if prior is None else rows.unionByName(prior.select(*SL.KEY, F.inline("held")))
        both.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        both = batch.sparkSession.read.schema(rows.schema).parquet(f"{root}/rows/batch={n}")
        table.write(SL.decisive_rows(both).groupBy(*SL.KEY).agg(F.collect_list(F.struct(*[f.name for f in held])).alias("held")), n)
        SL.merge_candidates(both).write.mode("overwrite").parquet(f"{root}/shortlist/batch={n}")
        if n > 0:
            delete_folder(batch.sparkSession, f"{root}/rows/batch={n - 1}")

    return _each_batch(candidates, checkpoint, work)


def current_shortlist(spark: SparkSession, root: str) -> DataFrame:
    """Latest merged row of every key."""
    stored = spark.read.parquet(f"{root}/shortlist")
    rest = [c for c in stored.columns if c not in (*SL.KEY, "batch")]
    return stored.groupBy(*SL.KEY).agg(F.max_by(F.struct(*rest), "batch").alias("_m")).select(*SL.KEY, "_m.*")


def live_counters(log: DataFrame) -> DataFrame:
    """Running counters per run, a streaming aggregation."""
    result = F.col("type") == "tool_result"
    return log.groupBy("run_id").agg(
        F.count_if(model_call()).alias("llm_calls"),
        F.count_if(result).alias("tool_calls"),
        F.count_if(result & (F.col("tool") == "web_search")).alias("search_calls"),
    )


def write_counters(log: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Counters of the runs that a micro-batch touches, in a folder of its own; see :func:`current_counters`."""
    return _each_batch(live_counters(log), checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/batch={n}"), mode="update")


def current_counters(spark: SparkSession, root: str) -> DataFrame:
    """Latest counters of every run."""
    stored = spark.read.schema("run_id long, llm_calls long, tool_calls long, search_calls long, batch long").parquet(root)
    return stored.groupBy("run_id").agg(F.max_by(F.struct("llm_calls", "tool_calls", "search_calls"), "batch").alias("_l")).select("run_id", "_l.*")
