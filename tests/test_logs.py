"""Logs in append order: split files, several appends, and files that grow under a stream."""

from __future__ import annotations

import json
import os
import random
import time

import pyarrow as pa
import pytest

from siftline.sources import logs as LG


def notes(run: int, first: int, n: int) -> list[str]:
    rng = random.Random(run)
    return ["{broken" if rng.random() < 0.05 else json.dumps({"n": i, "text": "é" * rng.randrange(40)}, ensure_ascii=False) for i in range(first, first + n)]


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_last_lines_equal_a_plain_reader(spark, tmp_path, split):
    want = {}
    for run in range(3):
        folder = tmp_path / f"run-{run}"
        folder.mkdir()
        lines = notes(run, 0, 60 + 300 * run)
        (folder / "notes.jsonl").write_text("\n".join(lines) + "\n" + "[1]\n\n", encoding="utf-8")
        good = [json.loads(x) for x in lines if x != "{broken"]
        want |= {(f"run-{run}", i): x["n"] for i, x in enumerate(reversed(good[-80:]), 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        log = LG.read_json_log(spark, str(tmp_path), "n long, text string")
        assert split > 700 or log.select("place.file", "place.block").distinct().count() > 3
        got = {(r.run_dir, r.nth): r.n for r in LG.last_lines(log, 80).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_appends_keep_their_order(spark, tmp_path):
    for first in (0, 40, 80):
        rows = spark.createDataFrame([(1, first + i) for i in range(40)], "run_id long, n long").repartitionByRange(3, "n").sortWithinPartitions("run_id", "n")
        rows.write.mode("append").partitionBy("run_id").json(f"{tmp_path}/log")
        time.sleep(0.05)
    got = LG.last_lines(LG.read_json_log(spark, f"{tmp_path}/log", "n long"), 50).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.nth)] == list(range(119, 69, -1))


@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_ranges_hold_each_line_once(tmp_path, most, monkeypatch):
    monkeypatch.setattr(LG, "CHUNK", 16)
    raw = b"".join(b"x" * random.Random(i).randrange(30) + b"\n" for i in range(50)) + b"unfinished"
    (tmp_path / "f").write_bytes(raw)
    got = []
    for r in LG.ranges(str(tmp_path / "f"), 0, raw.rfind(b"\n") + 1, most):
        with pa.OSFile(r.path) as file:
            got += LG.lines_of(file, r.start, r.stop)
    at, want = 0, []
    for line in raw.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_a_stream_follows_growing_files(spark, tmp_path):
    source, out = tmp_path / "log", str(tmp_path / "out")
    source.mkdir()

    def run() -> list:
        query = LG.follow_log(spark, str(source), 64).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((os.path.basename(r.file), r["at"], r.value) for r in rows)

    lines = {"a": [], "b": []}
    with open(source / "a", "w") as a, open(source / "b", "w") as b:
        for step in range(3):
            for name, file in (("a", a), ("b", b)):
                if lines[name] and step:
                    file.write(" rest\n")
                    lines[name][-1] += " rest"
                new = [f"{name} {step} {i} " + "y" * i for i in range(9)]
                file.write("\n".join(new))  # the last line is not finished
                file.flush()
                lines[name] += new
            got = run()
            want = []
            for name in lines:
                at = 0
                for line in lines[name][:-1]:
                    want.append((name, at, line))
                    at += len(line) + 1
            assert got == want
