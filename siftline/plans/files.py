"""Scans and sinks: delivered tables written out by the sinks and read back by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siftline.session import shared_dir
from siftline.sources import files as FL, logs as LG, tables as T

#: Most items of a strategy document, and keys of a keyed one: documents grow in number, not in size.
ITEMS, ENTRIES = 10_000, 100_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/files/{uuid.uuid4().hex}"


def _part(of: Column, slot: Column) -> Column:
    """The folder's name of one slot of a document that is written in parts."""
    return F.concat_ws("-", of.cast("bigint"), slot.cast("bigint")).alias("run_id")


def _part_of(group: int) -> Column:
    return F.regexp_extract("run_dir", r"^run_id=(\d+)-(\d+)$", group).cast("bigint")


def event_log_files(s: SparkSession, d: str) -> DataFrame:
    """The tool-event log, appended to JSON-lines files by run and read back; one event in five has no time of its own."""
    folder, rows = _folder(s), T.tool_events(s, d).withColumn("ts", F.when(F.col("seq") % 5 > 0, F.col("ts")))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    for part in (0, 1):
        FL.append_log(rows.filter(F.col("seq") % 2 == part), f"{folder}/log", now)
    back = FL.read_json_lines(s, f"{folder}/log", rows.drop("run_id").schema)
    run = F.regexp_extract("run_dir", r"^run_id=(\d+)$", 1).cast("bigint")
    return back.withColumn("run_id", run).withColumn("price_hints", F.array_join("price_hints", "|")).drop("run_dir")


_add(
    "event_log_files",
    event_log_files,
    T.with_tables(["tool_events"], """
SELECT * REPLACE (array_to_string(price_hints, '|') AS price_hints, CASE WHEN seq % 5 > 0 THEN ts ELSE TIMESTAMP '2024-03-01 00:00:00' END AS ts) FROM tool_events"""),
)


def log_tail_files(s: SparkSession, d: str) -> DataFrame:
    """The last 80 lines of each run, read from files that hold neither a number nor a time; the log is appended in two parts."""
    folder, rows = _folder(s), T.tool_events(s, d).select("run_id", "seq", "tool", "url")
    half = F.col("seq") % 5000 < 2500
    for part in (half, ~half):
        # Files of one append are numbered in the order of their rows.
        ordered = rows.filter(part).repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq")
        ordered.select("run_id", "tool", "url").write.mode("append").partitionBy("run_id").json(f"{folder}/log")
    last = LG.last_lines(LG.read_json_log(s, f"{folder}/log", "tool string, url string"), 80)
    return last.select(F.regexp_extract("run_dir", r"^run_id=(\d+)$", 1).cast("bigint").alias("run_id"), "nth", "tool", "url")


_add(
    "log_tail_files",
    log_tail_files,
    T.with_tables(["tool_events"], """
SELECT run_id, nth::INT AS nth, tool, url FROM (SELECT run_id, tool, url, row_number() OVER (PARTITION BY run_id ORDER BY seq % 5000 < 2500, seq DESC) AS nth FROM tool_events) WHERE nth <= 80"""),
)


def snapshot_files(s: SparkSession, d: str) -> DataFrame:
    """Candidates as snapshots by run; the runs of a second snapshot replace theirs, the others stay."""
    folder = _folder(s)
    rows = T.candidates(s, d).select("seq", "run_id", "name", "source_url", "price", "details")
    FL.write_snapshot(rows, f"{folder}/shortlist")
    FL.write_snapshot(rows.filter("run_id < 3 AND seq % 2 = 0"), f"{folder}/shortlist")
    return s.read.schema(rows.schema).json(f"{folder}/shortlist").select(*rows.columns)


_add(
    "snapshot_files",
    snapshot_files,
    T.with_tables(["candidates"], "SELECT seq, run_id, name, source_url, price, details FROM candidates WHERE run_id >= 3 OR seq % 2 = 0"),
)


def task_files(s: SparkSession, d: str) -> DataFrame:
    """The first user message of every conversation as a task file, read back whole and trimmed."""
    folder = _folder(s)
    first = T.messages(s, d).filter("role = 'user'").groupBy("run_id").agg(F.min_by("content", "turn").alias("task"))
    FL.write_texts(first.withColumn("task", F.concat(F.lit("\n  "), "task", F.lit(" \n"))), f"{folder}/tasks", "task")
    return FL.read_tasks(s, f"{folder}/tasks").select(F.regexp_extract("run_dir", r"^run_id=(\d+)$", 1).cast("bigint").alias("run_id"), "task")


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_add(
    "task_files",
    task_files,
    T.with_tables(["messages"], f"SELECT run_id, trim(arg_min(content, turn), {_WS}) AS task FROM messages WHERE role = 'user' GROUP BY run_id"),
)


def keyed_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents for each nation that map its customers to records, a range of keys each, written as texts and read back as rows."""
    folder = _folder(s)
    customers = T.read(s, d, "customer")
    record = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("c_name").alias("key"), record.alias("value"))))
    part = _part(F.col("c_nationkey"), F.expr(f"c_custkey div {ENTRIES}"))
    FL.write_texts(customers.groupBy(part).agg(F.to_json(entries).alias("body")), f"{folder}/maps", "body")
    back = FL.document_map(FL.read_documents(s, f"{folder}/maps"), "body", "struct<segment:string,custkey:bigint>", "name")
    return back.select(_part_of(1).alias("nation"), "name", "segment", "custkey")


_add("keyed_documents", keyed_documents, "SELECT c_nationkey::BIGINT AS nation, c_name AS name, c_mktsegment AS segment, c_custkey::BIGINT AS custkey FROM customer")


def strategy_documents(s: SparkSession, d: str) -> DataFrame:
    """Strategy documents of both shapes, some items under the older names, written in parts by range of keys and read back.

    An item's place counts from the first part of its document: the parts before, whose sizes are known from the keys, come first.
    """
    folder, k = _folder(s), F.col("p_partkey")
    old, name, kind = k % 3 == 0, F.col("p_name"), F.col("p_type")
    item = F.struct(
        F.when(~old, name).when(k % 2 == 0, "").alias("trigger"), F.when(~old, kind).alias("tactic"), F.when(old, name).alias("when"), F.when(old, kind).alias("then"),
        F.col("p_brand").alias("efficiency_gain"),
    )
    parts = T.read(s, d, "part").withColumn("document", (k % 7).cast("bigint")).withColumn("slot", F.expr(f"p_partkey div {7 * ITEMS}"))
    lists = parts.groupBy("document", "slot").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("item")))).alias("l"))
    items = F.transform("l", lambda x: x["item"])
    body = F.when(F.col("document") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("strategies"))))
    FL.write_texts(lists.select(_part(F.col("document"), F.col("slot")), body.alias("body")), f"{folder}/strategies", "body")
    back = FL.strategy_items(FL.read_documents(s, f"{folder}/strategies"), "body").withColumn("document", _part_of(1)).withColumn("slot", _part_of(2))
    before = F.coalesce(F.sum("n").over(W.partitionBy("document").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("document", "slot").agg(F.count(F.lit(1)).alias("n")).select("document", "slot", before.alias("start"))
    return back.join(starts, ["document", "slot"]).select("document", (F.col("start") + F.col("pos")).cast("bigint").alias("pos"), "trigger", "tactic", "efficiency_gain")


_add("strategy_documents", strategy_documents, """
SELECT p_partkey % 7 AS document, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1 AS pos, p_name AS trigger, p_type AS tactic, p_brand AS efficiency_gain FROM part""")
