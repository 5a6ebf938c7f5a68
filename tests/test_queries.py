"""Every registered query against its SQL at the smallest scale, and the shape of the plans."""

from __future__ import annotations

import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftline.operators import ordered as OR

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The training-data queries have tests of their own.
OWN = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
STREAMS = {n for n in OWN if n.endswith("_stream")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def comparable(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [tuple(comparable(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    got = [tuple(comparable(r[c]) for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_streamed_guard_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, entry.queries()[n](spark, SF).collect()))
    assert rows("session_guard_stream") == rows("session_guard")


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"domain", "tool", "events"}


PYTHON_NODES = {
    "html_title_text": "ArrowEvalPython", "fetch_outcomes": "ArrowEvalPython", "session_guard": "MapInPandas",
    **{n: "MapInPandas" for n in ("url_patterns", "pattern_lookup", "root_open_rejections", "root_open_rejections_as_of", "memory_digest")},
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(OWN - STREAMS))
def test_plan_has_no_cross_join_and_little_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan.replace("ArrowEvalPython", "")
    if name not in PYTHON_NODES:
        assert "Python" not in plan and "InPandas" not in plan
    for spec in re.findall(r"Window \[.*", plan):
        assert not re.search(r"windowspecdefinition\([a-z_]+#\d+L? (ASC|DESC)", spec), "window without partition keys"


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(entry.queries()["tool_routing"](spark, SF))
    assert "html" not in plan and "props" not in plan


def test_running_columns_shuffle_the_rows_once(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    df = OR.running(events, ["user_id"], "event_id", 100, sums={"n": F.lit(1).cast("long")})
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1
