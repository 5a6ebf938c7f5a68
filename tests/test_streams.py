"""Streaming jobs: rows that arrive late, and counters of the runs a micro-batch touches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siftline.operators import shortlist as SL
from siftline.plans import streams as ST
from siftline.streaming import jobs as J
from siftline.streaming.state import StateTable

EVENTS = "seq long, ts timestamp_ntz, tool string, url string, ok boolean, blocked boolean, error string"


def arrive(spark, folder, rows):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(s, at, "web_fetch", f"http://{d}/x", False, True, None) for s, d in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def test_late_rows_stop_a_learner(spark, tmp_path):
    folder, table = str(tmp_path), StateTable(f"{tmp_path}/tactics", J.TACTICS_SCHEMA)
    run = lambda: J.learn_tactics(J.read_log(spark, f"{folder}/log", EVENTS, "parquet"), table, f"{folder}/checkpoint").awaitTermination()
    arrive(spark, folder, [(1, "a.be"), (2, "b.be")])
    run()
    arrive(spark, folder, [(3, "a.be")])
    run()
    assert {r.domain: r.success_count for r in table.at(spark, 1).collect()} == {"a.be": 2, "b.be": 1}
    arrive(spark, folder, [(2, "a.be")])
    with pytest.raises(StreamingQueryException):
        run()


def test_counters_of_touched_runs(spark, tmp_path):
    schema, folder = "run_id long, seq long, type string, tool string", str(tmp_path)
    for part in ([(1, 1, "planner_request", None), (1, 2, "planner_response", None), (1, 3, "planner_error", None), (2, 4, "llm_request", None)], [(2, 5, "tool_result", "web_search")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        J.write_counters(J.read_log(spark, f"{folder}/log", schema, "parquet"), f"{folder}/counters", f"{folder}/checkpoint").awaitTermination()
    assert sorted(map(tuple, J.current_counters(spark, f"{folder}/counters").collect())) == [(1, 1, 0, 0), (2, 1, 1, 1)]
    assert spark.read.parquet(f"{folder}/counters/batch=1").select(F.collect_list("run_id")).first()[0] == [2]


def learned(spark, folder, table, late=None, delay=0):
    query = J.learn_tactics(J.read_log(spark, f"{folder}/log", EVENTS, "parquet"), table, f"{folder}/checkpoint", late=late, delay=delay)
    query.awaitTermination()
    return {r.domain: (r.success_count, r.pos) for r in table.at(spark, query.lastProgress["batchId"]).collect()}


def test_late_rows_are_put_aside(spark, tmp_path):
    folder, late = str(tmp_path), f"{tmp_path}/late"
    table = StateTable(f"{tmp_path}/tactics", J.TACTICS_SCHEMA)
    arrive(spark, folder, [(1, "a.be"), (5, "b.be")])
    learned(spark, folder, table, late)
    arrive(spark, folder, [(3, "a.be"), (6, "a.be"), (None, "b.be")])
    assert learned(spark, folder, table, late) == {"a.be": (2, 1), "b.be": (1, 5)}
    arrive(spark, folder, [(7, "b.be")])
    assert learned(spark, folder, table, late) == {"a.be": (2, 1), "b.be": (2, 5)}
    assert sorted((r.seq or 0, r.batch) for r in J.late_rows(spark, late, EVENTS).collect()) == [(0, 1), (3, 1)]


def test_rows_wait_for_those_before_them(spark, tmp_path):
    folder, late = str(tmp_path), f"{tmp_path}/late"
    table = StateTable(f"{tmp_path}/tactics", J.TACTICS_SCHEMA)
    arrive(spark, folder, [(4, "a.be"), (9, "b.be")])
    assert learned(spark, folder, table, late, delay=4) == {"a.be": (1, 4)}
    arrive(spark, folder, [(5, "a.be"), (6, "b.be")])  # row 5 is one too late, row 6 is in time
    assert learned(spark, folder, table, late, delay=4) == {"a.be": (1, 4)}
    arrive(spark, folder, [(20, "c.be")])
    assert learned(spark, folder, table, late, delay=4) == {"a.be": (1, 4), "b.be": (2, 6)}
    arrive(spark, folder, [(21, "c.be")])
    assert learned(spark, folder, table, late) == {"a.be": (1, 4), "b.be": (2, 6), "c.be": (2, 20)}
    assert [r.seq for r in J.late_rows(spark, late, EVENTS).collect()] == [5]


def test_state_table_writes_what_is_touched(spark, tmp_path):
    table, want, sizes = StateTable(str(tmp_path / "t"), "k long, v long", ("k",), 4), {}, []
    for batch in range(9):
        new = {k: 100 * batch + k for k in ([*range(20)] if batch == 0 else [batch % 3, 30 + batch])}
        rows = spark.createDataFrame([*new.items()], "k long, v long")
        for _ in range(2 if batch in (3, 4) else 1):  # a batch that is run again
            prior = table.before(rows, batch)
            assert batch == 0 or {r.k: r.v for r in prior.collect()} == {k: want[k] for k in new if k in want}
            table.write(rows, batch)
        want.update(new)
        sizes.append(spark.read.parquet(f"{table.root}/version={batch + 1}").count())
        assert {r.k: r.v for r in table.at(spark, batch).collect()} == want
        if batch:
            table.at(spark, batch - 1).count()  # still readable
    # keys of one, two, one, four, ... batches
    assert sizes == [20, 21, 2, 23, 2, 4, 2, 27, 2]
    assert sorted(p.name for p in (tmp_path / "t").glob("version=*")) == [f"version={v}" for v in (4, 6, 7, 8, 9)]  # replaced ones go two batches later
    assert table.before(rows.limit(0), 9).count() == 0


CANDIDATES = "run_id long, seq long, ts timestamp_ntz, session string, name string, source_url string, price string, details string, match_status string, matched array<string>, unmatched array<string>, unknown array<string>"


def mentions(n, seed):
    rng = random.Random(seed)
    price = lambda: rng.choice([None, "", "on request", f"{rng.randrange(1, 40)}", f"€ {rng.randrange(1, 40)},0", "7", "7 EUR"])
    return [
        (
            rng.choice([0, 0, 0, 1]), seq, datetime(2024, 1, 1) + timedelta(seconds=seq), rng.choice(["", "s1", None]), rng.choice(["Hotel Abc", "abc", "ABC spa", "The Xyz"]),
            rng.choice(["", " ", "http://a/search?x=1", "http://a/b", "http://a/c", "http://a/longer/path"]), price(),
            rng.choice(["", " x ", "pool", None, "d" * 1250, " " + "e" * 1300]), "full", [f"m{seq}"], [], [],
        )
        for seq in range(n)
    ]


def merged(df):
    return {(r.run_id, r.name_key): tuple(r) for r in df.collect()}


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def counted(df):
    return df.withColumn("mentions", F.lit(1).cast("long"))


def test_decisive_rows_decide_the_merge(spark, tmp_path):
    ok = stored(SL.accepted(SL.check_candidates(spark.createDataFrame(mentions(400, 5), CANDIDATES))).select(*SL.MERGED), tmp_path / "ok")
    early, late = ok.filter("seq % 2 = 0 OR seq > 300"), ok.filter("seq % 2 = 1 AND seq <= 300")
    few = stored(SL.decisive_rows(early), tmp_path / "few")
    assert merged(SL.merge_candidates(few)) == merged(SL.merge_candidates(early))
    again = stored(SL.decisive_rows(few.unionByName(counted(late))), tmp_path / "again")
    assert merged(SL.merge_candidates(again)) == merged(SL.merge_candidates(ok))
    once = stored(SL.decisive_rows(ok), tmp_path / "once")
    assert sorted(map(tuple, again.select("seq", "mentions").collect())) == sorted(map(tuple, once.select("seq", "mentions").collect()))
    assert once.count() < ok.count() // 4


def test_price_reset_that_arrives_after_later_prices(spark, tmp_path):
    """Rows 1, 2, 4 and 5 arrive first; the reset of row 3, which arrives last, leaves 20 as the lowest price."""
    one = lambda seq, price: (1, seq, datetime(2024, 1, 1), "s", "Abc", "http://a/b", price, "", "full", ["m"], [], [])
    rows = [one(1, "10"), one(2, "30"), one(4, "20"), one(5, "25"), one(3, "on request")]
    ok = stored(SL.accepted(SL.check_candidates(spark.createDataFrame(rows, CANDIDATES))).select(*SL.MERGED), tmp_path / "ok")
    early = stored(SL.decisive_rows(ok.filter("seq <> 3")), tmp_path / "early")
    assert sorted(r.seq for r in early.collect()) == [1, 4, 5]
    found = SL.merge_candidates(SL.decisive_rows(early.unionByName(counted(ok.filter("seq = 3"))))).first()
    assert (found.price, found.mentions, found.first_seq, found.last_seq) == ("20", 5, 1, 5)


def test_shortlist_of_mentions_in_any_order(spark, tmp_path):
    folder, rows = str(tmp_path), mentions(120, 9)
    random.Random(2).shuffle(rows)
    for part in (rows[:50], rows[50:51], rows[51:]):
        spark.createDataFrame(part, CANDIDATES).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        J.upsert_shortlist(J.read_log(spark, f"{folder}/log", CANDIDATES, "parquet"), f"{folder}/table", f"{folder}/checkpoint", buckets=4).awaitTermination()
    whole = SL.accepted(SL.check_candidates(spark.createDataFrame(rows, CANDIDATES))).select(*SL.MERGED)
    want = SL.merge_candidates(whole)
    assert merged(J.current_shortlist(spark, f"{folder}/table").select(*want.columns)) == merged(want)


def test_urls_of_a_micro_batch_are_taken_apart_once(spark, tmp_path):
    """What is learned from is stored, for this batch only, and nothing else reads the visits."""
    schema, folder = "seq long, ts timestamp_ntz, url string, tool string, error string, price_hints array<string>", str(tmp_path)
    table = StateTable(f"{folder}/patterns", J.PATTERNS_SCHEMA)
    at = datetime(2024, 1, 1)
    for seqs in ((1, 2), (3, 4)):
        rows = [(s, at, f"http://a{s % 2}.be/search/{s}?q=1", "browser_open", None, ["x"]) for s in seqs] + [(seqs[-1], at, "http://c.be/", "web_fetch", None, [])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        J.learn_patterns(J.read_log(spark, f"{folder}/log", schema, "parquet"), table, f"{folder}/checkpoint").awaitTermination()
    assert {r.domain: (r.success_count, r.path_hints) for r in table.at(spark, 1).collect()} == {"a0.be": (2, ["/search/4", "/search/2"]), "a1.be": (2, ["/search/3", "/search/1"])}
    assert sorted(r.seq for r in spark.read.parquet(f"{folder}/patterns-rows/batch=1").collect()) == [3, 4]
    assert not (tmp_path / "patterns-rows" / "batch=0").exists()


def test_pieces_of_a_log_have_a_file_for_each_core(spark, tmp_path):
    for n in (30_000, 30):
        ST.arriving(spark, spark.range(n).withColumnRenamed("id", "seq").coalesce(1), f"{tmp_path}/{n}")
        files = {len(list((tmp_path / str(n) / "log" / f"part-{i}").glob("*.parquet"))) for i in range(3)}
        assert files == {min(spark.sparkContext.defaultParallelism, 10) if n > 30 else 1}
