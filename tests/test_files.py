"""Sources and sinks in a temporary folder."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline.operators import runs as R
from siftline.plans import files as plans
from siftline.sources import files


def test_json_lines_drop_bad_lines_and_keep_the_tail(spark, tmp_path):
    run = tmp_path / "run-a"
    run.mkdir()
    lines = [json.dumps({"seq": i, "title": f"t{i}"}) for i in range(5)] + ["{oops", "", "[1", '[{"seq": 8}, {"seq": 9}]', "3", "null"]
    (run / "notes.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = files.read_json_lines(spark, str(run / "notes.jsonl"), "seq long, title string")
    kept = rows
    assert {r.run_dir for r in kept.collect()} == {"run-a"} and kept.count() == 5
    tail = files.tail_lines(kept.withColumn("run_id", F.col("run_dir")), 2)
    assert sorted(r.seq for r in tail.collect()) == [3, 4]


def test_documents_of_every_shape(spark, tmp_path):
    bodies = {"a": '[{"n":"1"},{"n":"2"}]', "b": '{"items":[{"n":"3"}]}', "c": '{"strategies":[{"n":"4"}],"updated_at":"x"}', "d": "[{", "e": "{}", "f": ""}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    docs = files.read_documents(spark, str(tmp_path))
    got = sorted((r.file[0], r.pos, r.n) for r in files.document_items(docs, "body", "struct<n:string>").select("file", "pos", "item.n").collect())
    assert got == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("c", 0, "4")]
    maps = spark.createDataFrame([('{"x.be":{"success_count":3},"y.be":{"success_count":1}}',), ("broken",)], "body string")
    got = files.document_map(maps, "body", "struct<success_count:bigint>").collect()
    assert [(r.pos, r.domain, r.success_count) for r in got] == [(0, "x.be", 3), (1, "y.be", 1)]


def test_tasks_are_trimmed(spark, tmp_path):
    (tmp_path / "task.md").write_text("\n  # Find\n\nx " + chr(0xA0) + "\n", encoding="utf-8")
    assert files.read_tasks(spark, str(tmp_path)).first().task == "# Find\n\nx"


def test_append_and_snapshot(spark, tmp_path):
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], "run_id long, title string, ts timestamp_ntz")
    now = F.lit("2024-01-01 00:00:00.123456").cast("timestamp_ntz")
    files.append_log(rows, log, now)
    files.append_log(rows.filter("run_id = 1"), log, now)
    back = spark.read.schema("title string, ts timestamp_ntz, run_id long").json(log)
    assert back.count() == 3 and {r.ts.microsecond for r in back.collect()} == {123456}
    files.write_snapshot(rows.drop("ts"), snap)
    files.write_snapshot(spark.createDataFrame([(2, "new")], "run_id long, title string"), snap)
    got = sorted((r.run_id, r.title) for r in spark.read.schema("title string, run_id long").json(snap).collect())
    assert got == [(1, "a"), (2, "new")]


def test_text_documents(spark, tmp_path):
    row = ("completed", 3, 4, 5, 6, "", None)
    df = spark.createDataFrame([(7, *row)], "run_id long, status string, llm_calls long, tool_calls long, sources_count long, notes_count long, progress string, key_findings string")
    doc = R.state_document(df.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    files.write_texts(doc, str(tmp_path / "state"), "document")
    text = files.read_documents(spark, str(tmp_path / "state" / "run_id=7")).first().body
    assert text.startswith("# Research state\n\n- Updated: 2024-01-01T00:00:00\n- Status: completed\n- LLM calls: 3\n")
    assert "## Progress\n(none)\n\n## Key findings (compact)\n(none yet)\n" in text


@pytest.mark.parametrize(("name", "most"), [("strategy_documents", 10_000), ("keyed_documents", 100_000)])
def test_documents_grow_in_number_not_in_size(spark, tmp_path, monkeypatch, name, most):
    key = F.col("id") * 2 + F.floor(F.col("id") / 50_000)  # gaps, and keys of every remainder
    spark.range(160_000).select(key.alias("p_partkey"), *[F.concat(F.lit(c), "id").alias(f"p_{c}") for c in ("name", "type", "brand")]).write.parquet(f"{tmp_path}/part.parquet")
    nation = F.when(F.col("id") % 10 == 0, 3).otherwise(1)
    spark.range(160_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), nation.alias("c_nationkey"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(plans, "_folder", lambda s: f"{tmp_path}/out")
    got = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns) and sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())
    sizes = [len(v["strategies"]) if "strategies" in v else len(v) for v in (json.loads(r.body) for r in files.read_documents(spark, f"{tmp_path}/out/*").collect())]
    assert sum(sizes) == 160_000 and max(sizes) <= most


def test_a_large_run_is_written_by_many_tasks(spark, tmp_path):
    path, key = f"{tmp_path}/snap", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(9).alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        files.write_snapshot(rows, path)
    finally:
        spark.conf.set(key, before)
    back = spark.read.schema("title string, run_id long").json(path)
    assert sorted(map(tuple, back.select("run_id", "title").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "snap" / "run_id=9").glob("part-*"))) > 4
