"""The registered queries: names, SQL, and the pipeline against a plain version."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftline.llm import language_id, queries
from tests.llm.fixtures import documents, frame
from tests.llm.test_sets_and_groups import plain_near, plain_removed

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names, cols = [c[0] for c in cur.description], sorted(df.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = [tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(names) == cols and sorted(map(repr, want)) == sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())


def test_stages_of_the_pipeline(spark):
    docs = frame(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert docs.columns == frame(spark).columns
        kept[name] = [tuple(r) for r in docs.collect()]
    letters = [r for r in documents() if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(repr, kept["language_id"])) == sorted(map(repr, letters))
    largest = {t: max((r[0] for r in letters if r[1] == t and r[0] is not None), default=None) for t in {r[1] for r in letters}}
    once = [r for r in letters if r[0] == largest[r[1]]]
    assert sorted(map(repr, kept["exact_dedup"])) == sorted(map(repr, once))
    near = [r for r, n in zip(once, plain_near(once, 5)) if n[3]]
    assert sorted(map(repr, kept["near_dedup"])) == sorted(map(repr, near))
    lost = {(i, n, gone) for i, n, gone, *_ in plain_removed(near)}
    assert {(r[0], len(r[1].encode())) for r in kept["suffix_dedup"]} >= {(i, n - gone) for i, n, gone in lost if n > gone and all(ord(c) < 128 for r in near if r[0] == i for c in r[1])}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in kept["suffix_dedup"]}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejected_languages_go(spark):
    model = language_id.language_model(frame(spark))
    assert model.langs == ["en"]


def test_the_rest_imports_without_this_package(tmp_path):
    """As after the folders are gone: the entry point has all other queries."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('siftline.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and not any(n.startswith('op1_') for n in e.queries())\n"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, check=True)
