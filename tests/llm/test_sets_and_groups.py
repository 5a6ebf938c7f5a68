"""Operators that compare documents with one another, against brute force."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, graph, near_dedup, suffix_dedup
from tests.llm.fixtures import documents, frame, sentence


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# --- exact dedup ----------------------------------------------------------------------------------


def plain_groups(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[t], len(ids), i == keep[t]) for t, ids in groups.items() for i in ids]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: (F.length(text) % 7).cast("string")], ids=["sha256", "weak"])
def test_exact_groups(spark, digest):
    got = exact_dedup.exact_groups(frame(spark).repartition(5), digest, batch_bytes=1500)
    assert sorted(map(repr, plain_groups(documents()))) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got.collect())


def test_states_are_not_held_open(spark, monkeypatch):
    """An executor has the stores of the tasks that run, not of all its partitions."""
    key, seen = "spark.sql.streaming.stateStore.unloadOnCommit", []
    held = spark.conf.get(key, None)
    run = exact_dedup.digest_states
    feed = exact_dedup.scratch(spark, "feed")
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "doc_id bigint, digest string, at string").write.parquet(feed)
    unset = type(spark.conf).unset
    monkeypatch.setattr(type(spark.conf), "unset", lambda self, k: (seen.append((k, self.get(k, None))), unset(self, k))[1])
    assert sorted(map(tuple, run(spark, feed, 1).select("digest", "keep_id", "group_size").collect())) == [("a", 2, 2), ("b", 3, 1)]
    assert (key, "true") in seen or held == "true"
    assert spark.conf.get(key, None) == held


def test_exact_dedup_keeps_whole_rows(spark):
    kept = exact_dedup.drop_copies(frame(spark))
    keep = {t: k for t, k in ((r[1] or "", max((x[0] for x in documents() if (x[1] or "") == (r[1] or "") and x[0] is not None), default=None)) for r in documents())}
    want = [r for r in documents() if r[0] == keep[r[1] or ""]]
    assert kept.columns == frame(spark).columns and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in kept.collect())
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


# --- components -----------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [tuple(map(int, e)) for e in rng.integers(200, 300, (70, 2))] + [(400, 400)]
    plain = Union()
    for a, b in edges:
        plain.tie(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: plain.find(n) for e in edges for n in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_spare_the_driver(spark, monkeypatch):
    """Stars take one round, and no round broadcasts a table."""
    plans, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), write(df, name))[1])
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 1), (7, 8)], "a bigint, b bigint")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)


def test_near_groups_without_further_links_join_once(spark, monkeypatch):
    calls, join = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: (calls.append(edges), join(edges))[1])
    base = sentence(41, 120)
    docs = spark.createDataFrame([(5, base + " end"), (2, base), (9, base), (7, sentence(42, 50)), (None, base)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert got == {5: 2, 2: 2, 9: 2, 7: 7, None: None} and len(calls) == 1


def test_near_groups_with_further_links(spark):
    """An id that repeats with another text ties two components that links had made."""
    one, two = sentence(43, 120), sentence(44, 120)
    docs = spark.createDataFrame([(1, one), (4, one + " end"), (6, two), (8, two + " end"), (8, one + " other end")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()} == {1: 1, 4: 1, 6: 1, 8: 1}


# --- near-duplicates ------------------------------------------------------------------------------


def plain_near(rows: list[tuple], size: int = 4) -> list[tuple]:
    sets = [(d[0], near_dedup.shingles(d[1] or "", size)) for d in rows]
    tie = Union()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                tie.tie(a, b)
    return [(a, len(x), tie.find(a) if a is not None else None, a is None or tie.find(a) == a) for a, x in sets]


def test_near_groups_of_awkward_rows(spark):
    got = [tuple(r) for r in near_dedup.near_groups(frame(spark)).collect()]
    assert sorted(map(repr, plain_near(documents()))) == sorted(map(repr, got))
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    kept = near_dedup.keep_first_of_groups(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == sum(r[3] for r in plain_near(documents()))


def near_copies() -> list[tuple]:
    """Copies at every distance from one text, some of which only meet through others, among texts with a common passage."""
    rng, base = np.random.default_rng(7), sentence(11, 120).split()
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(len(words), rng.integers(0, 12), replace=False):
            words[at] = f"w{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:60]) + " " + sentence(500 + i, int(rng.integers(1, 40)))) for i in range(120)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_groups_of_many_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = spark.createDataFrame(near_copies(), "doc_id bigint, text string")
    assert sorted(plain_near(near_copies())) == sorted(tuple(r) for r in near_dedup.near_groups(docs).collect())


def test_estimates_are_close_to_the_similarity():
    a, b = ({("w", i) for i in range(900)}, {("w", i) for i in range(100, 1000)})
    hashes = [np.array([hash((7, x[1])) & (2**64 - 1) for x in sorted(s)], np.uint64) for s in (a, b)]
    low = np.array([near_dedup.minima(near_dedup.mix(h)) for h in hashes]) & np.uint64(15)
    like = near_dedup.estimate(*near_dedup.packed(low))
    assert abs(like - 0.8) < 0.15 and near_dedup.estimate(*near_dedup.packed(low[[0, 0]])) == 1 and 0.6 < near_dedup.lowest(80) < 0.7


def test_hashed_sets_have_the_sizes_of_full_sets():
    texts = [d[1] or "" for d in documents()]
    for size in (4, 5):
        assert [len(s) for s in near_dedup.shingle_hashes(texts, size)] == [len(near_dedup.shingles(t, size)) for t in texts]
    assert [list(s) for s in near_dedup.shingle_hashes(texts, 4)] == [list(near_dedup.shingle_hashes([t], 4)[0]) for t in texts]


# --- suffix arrays --------------------------------------------------------------------------------


def plain_removed(rows: list[tuple]) -> list[tuple]:
    length, first = suffix_dedup.LENGTH, {}
    order = lambda i: -(2**63) if i is None else i
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, raw in raws:
        for k in range(len(raw) - length + 1):
            gram = raw[k : k + length]
            first[gram] = min(first.get(gram, order(i)), order(i))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < order(i):
                gone[k : k + length] = True
        out.append((i, len(raw), int(gone.sum()), len(suffix_dedup.spans_of(gone)[0]), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_removed_passages(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = [tuple(r) for r in suffix_dedup.removed(frame(spark)).collect()]
    assert sorted(map(repr, plain_removed(documents()))) == sorted(map(repr, got))


def test_texts_without_repeats(spark):
    kept = suffix_dedup.without_repeats(frame(spark))
    assert kept.columns == frame(spark).columns
    rows = {(r.doc_id, r.text): r for r in kept.collect()}
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert {1, 2, 12, 15}.intersection({i for i, _ in rows}) == {15}  # a copy of 50 bytes or more goes, a short one stays
    assert (5, "") in rows and (6, "") in rows
    assert suffix_dedup.removed(frame(spark, [])).count() == 0 == suffix_dedup.without_repeats(frame(spark, [])).count()


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=120), st.integers(2, 9))
def test_suffix_order(text, length):
    raw = np.frombuffer(text.encode() or b"a", np.uint8)
    order, rank = suffix_dedup.suffix_order(raw, length)
    keys = [raw.tobytes()[i : i + length] for i in range(len(raw))]
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (keys[i], i))
    assert [[rank[i] == rank[j] for j in range(len(raw))] for i in range(0, len(raw), 7)] == [[keys[i] == keys[j] for j in range(len(raw))] for i in range(0, len(raw), 7)]


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60))
def test_previous_smaller(values):
    got = suffix_dedup.previous_smaller(np.array(values)).tolist()
    assert got == [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]


def test_long_text_in_stretches(monkeypatch):
    raw = sentence(21, 9000).encode()
    whole = suffix_dedup.segments(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    windows = lambda parts: {(int(h), w) for h, _, a, b in zip(*parts) for w in range(a, b + 1)}
    near = [suffix_dedup.segments(np.frombuffer(raw[a : a + 1000 + 49], np.uint8), np.array([len(raw[a : a + 1000 + 49])])) for a in range(0, len(raw), 1000)]
    assert windows(whole) == {(h, w + 1000 * k) for k, part in enumerate(near) for h, w in windows(part)}


def test_previous_smaller_of_a_long_climb():
    began = time.process_time()
    got = suffix_dedup.previous_smaller(np.append(np.arange(1, 100_001), 0))
    assert got.tolist() == [*range(-1, 99_999), -1] and time.process_time() - began < 6


def test_segments_of_blocks_are_those_of_each_text(monkeypatch):
    texts = [sentence(i, n).encode() for i, n in enumerate([40, 0, 3, 200, 1, 900, 12, 5000, 0, 60, 60])] + [b""]
    own = lambda part: {(int(i), int(h), int(p - b), w - b) for i, h, p, a, z in zip(*part[2:]) for b in [part[1][i]] for w in range(a, z + 1)}
    alone = {(i, *rest) for i, text in enumerate(texts) for _, *rest in own(suffix_dedup._batch_segments([text]))}
    for block, most in ((1 << 17, 1 << 20), (500, 1 << 20), (500, 700), (1, 1)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "SLICE", max(most, 60))
        assert own(suffix_dedup._batch_segments(texts)) == alone
    assert own(suffix_dedup._batch_segments([b"", b""])) == set()


def test_unlike_texts_hardly_share_anchors():
    words = "the of and to in is that for it on by this with as was or an be at not are from".split()
    rng, owners = np.random.default_rng(8), {}
    for i in range(60):
        raw = " ".join(rng.choice(words, 5000)).encode()
        for h in set(suffix_dedup.segments(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0].tolist()):
            owners.setdefault(h, set()).add(i)
    shared = sum(len(o) > 1 for o in owners.values())
    assert len(owners) > 50_000 and shared < len(owners) / 500


def test_shared_anchors_of_packed_ones(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 2)
    monkeypatch.setattr(suffix_dedup, "GATHERED", 500)
    line, pair = sentence(31, 40), sentence(32, 40)
    texts = [(i, f"{sentence(100 + abs(i) % 97, 60)} {line if i % 2 else ''} {pair if i in (4, 2**62) else ''}") for i in (-(2**63), 4, 5, 7, 9, 9, 2**62, 11)]
    own = {}
    for i, text in texts:
        for h in suffix_dedup.segments(np.frombuffer(text.encode(), np.uint8), np.array([len(text.encode())]))[0]:
            own.setdefault(int(suffix_dedup._names(np.array([h]))[0]), []).append((i, text))
    want = sorted({(i, 2 * name + (len(set(rows)) > 2)) for name, rows in own.items() if len({i for i, _ in rows}) > 1 for i, _ in rows})
    rows = spark.createDataFrame(texts, "doc bigint, text string")
    for parts in (1, 7):
        got = [tuple(r) for r in suffix_dedup.shared_anchors(suffix_dedup.anchors(rows, parts)).collect()]
        assert sorted(set(got)) == want and any(m % 2 for _, m in want) and not all(m % 2 for _, m in want)


def test_lists_and_spans_are_gathered_from_thin_rows(spark):
    plan = suffix_dedup.without_repeats(frame(spark))._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Initial Plan") :].splitlines() if "Initial Plan" in plan else plan.splitlines()
    below = [after for line, after in zip(lines, lines[1:]) if "functions=[collect_list(" in line]
    assert below and all("functions=[partial_collect_list(" in line for line in below)  # no exchange of lists between the two
