"""Streaming jobs run to the end over the delivered tables, which arrive as a log in several parts.

The result must equal the batch operator's, so the SQL checks are the batch ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators import guard as GD
from siftline.plans import learning as LN, runs as RN, shortlists as SH
from siftline.session import shared_dir
from siftline.sources import tables as T
from siftline.streaming import guard as SG, jobs as J
from siftline.streaming.state import StateTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Rows of a file of an arriving log, at least.
LEAST_ROWS = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"


def arriving(s: SparkSession, rows: DataFrame, folder: str, parts: int = 3) -> DataFrame:
    """A table as a log that arrives in ``parts`` pieces by ``seq``, read as a stream of a micro-batch for each.

    Each piece has as many files as the first one's scan has tasks, or as there are cores where every piece has rows enough
    that none stays empty: a batch takes so many files, and reads them side by side.
    """
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // parts + 1
    rows.withColumn("_part", F.expr(f"(seq - {low}) div {step}")).write.partitionBy("_part").parquet(f"{folder}/parts")
    pieces = [s.read.schema(rows.schema).parquet(f"{folder}/parts/_part={i}") for i in range(parts)]
    files = max(pieces[0].rdd.getNumPartitions(), min(s.sparkContext.defaultParallelism, min(p.count() for p in pieces) // LEAST_ROWS))
    for i, piece in enumerate(pieces):
        piece.repartition(files).write.mode("append").parquet(f"{folder}/log/part-{i}")
    return J.read_log(s, f"{folder}/log", rows.schema, "parquet", files_per_batch=files)


def _last_batch(query) -> int:
    query.awaitTermination()
    return query.lastProgress["batchId"]


def site_tactics_stream(s, d):
    folder = _folder(s)
    table = StateTable(f"{folder}/tactics", J.TACTICS_SCHEMA)
    events = arriving(s, T.tool_events(s, d).select("seq", "ts", "tool", "url", "ok", "blocked", "error"), folder)
    return table.at(s, _last_batch(J.learn_tactics(events, table, f"{folder}/checkpoint")))


def url_patterns_stream(s, d):
    folder = _folder(s)
    table = StateTable(f"{folder}/patterns", J.PATTERNS_SCHEMA)
    visits = arriving(s, T.search_urls(s, d), folder)
    found = table.at(s, _last_batch(J.learn_patterns(visits, table, f"{folder}/checkpoint")))
    return found.withColumns({c: F.array_join(c, "|") for c in LN._lists})


def shortlist_stream(s, d):
    folder = _folder(s)
    mentions = arriving(s, T.candidates(s, d), folder)
    J.upsert_shortlist(mentions, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return J.current_shortlist(s, f"{folder}/table").withColumns(
        {c: F.array_join(c, "|") for c in ("matched", "unmatched", "unknown")}
    ).drop("notes")


def run_counters_stream(s, d):
    folder = _folder(s)
    J.write_counters(arriving(s, T.run_log(s, d), folder), f"{folder}/counters", f"{folder}/checkpoint").awaitTermination()
    return J.current_counters(s, f"{folder}/counters")


def event_log_stream(s, d):
    """Rows appended to a JSON log by a stream, read back."""
    folder = _folder(s)
    rows = T.tool_events(s, d)
    J.append_log(arriving(s, rows, folder), f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema(rows.schema).json(f"{folder}/events").withColumn("price_hints", F.array_join("price_hints", "|"))


def session_guard_stream(s, d):
    folder = _folder(s)
    facts = GD.attempts_with_facts(T.attempts(s, d), LN.patterns(s, d)).select(*GD.COLUMNS)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, ROCKSDB)
    try:
        verdicts = SG.guard_stream(arriving(s, facts, folder))
        query = (
            verdicts.writeStream.format("parquet").option("path", f"{folder}/verdicts")
            .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        s.conf.unset(key) if before is None else s.conf.set(key, before)
    return s.read.schema(GD.OUTPUT).parquet(f"{folder}/verdicts")


_add("site_tactics_stream", site_tactics_stream, LN.ORACLES["site_tactics"])
_add("url_patterns_stream", url_patterns_stream, LN.ORACLES["url_patterns"])
_add("shortlist_stream", shortlist_stream, SH.ORACLES["shortlist"])
_add(
    "run_counters_stream",
    run_counters_stream,
    T.with_tables(["run_log"], """
SELECT run_id, count(*) FILTER (type IN ('llm_request', 'planner_request')) AS llm_calls, count(*) FILTER (type = 'tool_result') AS tool_calls,
  count(*) FILTER (tool = 'web_search') AS search_calls FROM run_log GROUP BY run_id"""),
)
_add("event_log_stream", event_log_stream, T.with_tables(["tool_events"], "SELECT * REPLACE (array_to_string(price_hints, '|') AS price_hints) FROM tool_events"))
_add("session_guard_stream", session_guard_stream, RN.ORACLES["session_guard"])
