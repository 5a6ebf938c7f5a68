"""Files of research runs: JSON-lines logs, JSON documents, texts, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as TY

from siftline.functions.text import utrim
from siftline.operators.ordered import top_k


# Times are written with all their digits; readers take them as they are.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


# --- scans ----------------------------------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str, schema: str | TY.StructType) -> DataFrame:
    """JSON-lines logs under ``path``; lines that do not hold one object are dropped, ``run_dir`` is the folder name.

    Lines get no number of their own: see :mod:`siftline.sources.logs` for a log in append order.
    """
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_dir"))
    rows = parse_lines(lines, "value", schema)
    return rows.select(*[c for c in rows.columns if c != "run_dir"], "run_dir")


def parse_lines(lines: DataFrame, line: str, schema: str | TY.StructType) -> DataFrame:
    """:func:`read_json_lines` for lines that are a column already."""
    fields = (TY.DataType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    with_bad = TY.StructType([*fields, TY.StructField("_bad", TY.StringType())])
    parsed = F.from_json(F.col(line), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        lines.filter(F.col(line).rlike(r"^\s*\{"))
        .withColumn("_p", parsed)
        .filter(F.col("_p").isNotNull() & F.col("_p._bad").isNull())
        .select(*[c for c in lines.columns if c != line], *[F.col(f"_p.`{f.name}`") for f in fields])
    )


def tail_lines(rows: DataFrame, limit: int, seq: str = "seq") -> DataFrame:
    """Last ``limit`` rows of every run."""
    return top_k(rows, ["run_id"], [F.desc(seq)], limit, seq)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: ``run_dir, file, body``."""
    where = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("run_dir"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("body")
    )


def document_items(documents: DataFrame, body: str, item: str) -> DataFrame:
    """Items of JSON documents that are a list, or an object holding it under ``items`` or ``strategies``.

    Unreadable documents have no items.
    """
    wrapped = F.from_json(body, f"struct<items:array<{item}>,strategies:array<{item}>>")
    items = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item}>")).otherwise(
        F.coalesce(wrapped["items"], wrapped["strategies"])
    )
    return documents.withColumn("_items", items).select(
        *[c for c in documents.columns if c != body], F.posexplode("_items").alias("pos", "item")
    )


def strategy_items(documents: DataFrame, body: str) -> DataFrame:
    """``pos, trigger, tactic, efficiency_gain`` of strategy documents; items may use the older names ``when`` and ``then``."""
    items = document_items(documents, body, "struct<trigger:string,tactic:string,efficiency_gain:string,`when`:string,`then`:string>")
    either = lambda new, old: F.coalesce(F.nullif(F.col(f"item.{new}"), F.lit("")), F.col(f"item.{old}"), F.lit("")).alias(new)
    return items.select(*[c for c in items.columns if c != "item"], either("trigger", "when"), either("tactic", "then"), F.col("item.efficiency_gain"))


def document_map(documents: DataFrame, body: str, value: str, key: str = "domain") -> DataFrame:
    """Entries of JSON documents that map a key to a record; unreadable documents have no entries."""
    entries = F.from_json(body, f"map<string,{value}>")
    return documents.withColumn("_m", entries).select(
        *[c for c in documents.columns if c != body], F.posexplode("_m").alias("pos", key, "_v")
    ).select(*[c for c in documents.columns if c != body], "pos", key, "_v.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task texts, trimmed."""
    return read_documents(spark, path).withColumn("task", utrim(F.col("body"))).drop("body")


# --- sinks ----------------------------------------------------------------------------------------


def with_default_ts(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows without a time get ``now``."""
    return rows.withColumn("ts", F.coalesce("ts", F.current_timestamp() if now is None else now))


def append_log(rows: DataFrame, path: str, now: Column | None = None, writers: int = 8) -> None:
    """Append rows to a JSON-lines log, one folder per run, each written by up to ``writers`` tasks."""
    out = with_default_ts(rows, now)
    if "run_id" in out.columns:
        slot = F.pmod(F.xxhash64(*out.columns), F.lit(writers))
        out.repartition("run_id", slot).write.mode("append").partitionBy("run_id").option("timestampNTZFormat", TIME_FORMAT).json(path)
    else:
        out.write.mode("append").option("timestampNTZFormat", TIME_FORMAT).json(path)


def write_snapshot(rows: DataFrame, path: str, fmt: str = "json", writers: int | None = None) -> None:
    """Replace the partitions of the runs in ``rows``; other runs' files stay.

    A run is written by as many tasks as its size needs (adaptive execution splits it at the advisory size), or by up to
    ``writers`` tasks where that is given.
    """
    dealt = rows.hint("rebalance", "run_id") if writers is None else rows.repartition("run_id", F.pmod(F.xxhash64(*rows.columns), F.lit(writers)))
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("timestampNTZFormat", TIME_FORMAT)
        .partitionBy("run_id")
        .format(fmt)
        .save(path)
    )


def write_texts(rows: DataFrame, path: str, text: str) -> None:
    """Text documents, one folder per run (reports, state and task files)."""
    write_snapshot(rows.select("run_id", F.col(text).alias("value")), path, "text", writers=1)
