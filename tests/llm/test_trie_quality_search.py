"""Prefix trie, quality classifier and lexical search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import lexical_search as LS, prefix_trie as PT, quality as QL
from tests.llm.fixtures import documents, frame, sentence

# --- prefix trie ----------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, part int, nth bigint, d1 string, depth int, h int, own string"


def chats() -> list[tuple]:
    rng, said = random.Random(5), ["hi", "", None, "ok", "Éç 😀", "x" * 300]
    rows = []
    for conv in [*range(0, 12), *range(95, 130), 200, 305, 306, 1000, -100, -37]:
        rows += [(conv, t, ("user", "assistant")[t % 2], rng.choice(said[:4])) for t in range(rng.randint(0, 9))]
    rows += [(400, t, "user", "same") for t in range(40)] + [(401, t, "user", "same") for t in range(40)]
    rows += [(7, None, None, None), (7, None, "user", None), (500, 0, "user", "a"), (500, 0, "user", "a"), (500, 1, "user", "a"), (None, 0, "user", "nowhere")]
    return [(*r, 1, 2, "z", 3, 4, "o") for r in rows]


def plain_trie(rows: list[tuple]) -> set[tuple]:
    convs: dict[int, list] = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members: dict[tuple, list[int]] = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    out = set()
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)
        ends = [c for c in ids if rebuilt[c] == node]
        out.add((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(m) == len(node) + 1 for m in below), sum(map(leaf, below)),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_rows(df, names=COLUMNS) -> list[tuple]:
    return [tuple(r[c] for c in names) for r in df.collect()]


def test_trie_equals_a_plain_one(spark):
    got = as_rows(PT.trie(spark.createDataFrame(chats(), TURNS).repartition(5)))
    assert len(got) == len(set(got)) and set(got) == plain_trie(chats())


def test_trie_of_a_long_conversation_in_many_partitions(spark):
    rows = [(3, t, "user", f"t{t % 7}", 1, 2, "z", 3, 4, "o") for t in range(700)] + [(0, t, "user", "t0", 1, 2, "z", 3, 4, "o") for t in range(3)]
    df = spark.createDataFrame(rows, TURNS).repartition(8)
    turns = PT.with_ties(PT.turn_table(df)).select("*", *[c.alias(n) for c, n in zip(PT.digests(F.col("role"), F.col("text"), 0), ("d1", "d2"))], F.length("text").cast("bigint").alias("chars"))
    products = PT.running_products(turns, PT.bases(0))
    assert products.filter("conv = 3").select("nth").distinct().count() == 700
    assert set(as_rows(PT.trie(df))) == plain_trie(rows)


def test_weak_digests_are_found_out(spark):
    rows = [(c, 0, "user", f"text {c}", 1, 2, "z", 3, 4, "o") for c in range(6)]
    df = spark.createDataFrame(rows, TURNS)
    weak = lambda role, text, seed: PT.digests(role, text, seed) if seed else (F.length(text).cast("bigint"), F.lit(1).cast("bigint"))
    assert set(as_rows(PT.trie(df, digest=weak))) == plain_trie(rows)
    with pytest.raises(ValueError):
        PT.trie(df, attempts=1, digest=weak)


def test_trie_of_an_empty_table(spark):
    assert PT.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_powers_go_on(spark):
    assert PT.powers(12345, 3, 9).tolist() == [pow(12345, 3 + i, PT.PRIME) for i in range(9)]


# --- quality --------------------------------------------------------------------------------------


def plain_features(text: str) -> Counter:
    """Words, repeats and n-grams as strings, one feature after the other."""
    out = Counter({"end": 1})
    words = [w for w in re.split(r"[\x00-\x20\x85\xa0 -   　]+", text) if w]
    for i, w in enumerate(words):
        out[f"w{w}"] += 1
        if i and words[i - 1] == w:
            out["again"] += 1
        for n in QL.GRAMS:
            whole = f" {w} "
            for k in range(len(whole) - n + 1):
                out[f"g{whole[k : k + n]}"] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", " ", "the the  the cat", "Éé 😀😀 x", "one\ntwo\ttwo　two", "x" * 700, sentence(4, 300)])
def test_features_are_those_of_a_plain_reader(text):
    own, bucket = (np.concatenate(x) for x in zip(*QL._of_texts(["before before", text, "behind"])))
    got = bucket[own == 1]
    want = plain_features(text)
    assert len(got) == sum(want.values())
    # Equal features share a bucket, so the counts of the buckets are sums of the plain counts.
    assert len(set(got.tolist())) <= len(want) and max(Counter(got.tolist()).values()) >= max(want.values())


def test_long_texts_are_cut_between_words(monkeypatch):
    text = sentence(9, 400)
    whole = Counter(np.concatenate([b for _, b in QL._of_texts([text])]).tolist())
    monkeypatch.setattr(QL, "STRETCH", 500)
    assert Counter(np.concatenate([b for _, b in QL._of_texts([text])]).tolist()) == whole


def test_classifier_learns_and_handles_awkward_rows(spark):
    rng = random.Random(3)
    good = [sentence(i, 40) for i in range(120)]
    bad = [" ".join(f"{w}!!" for w in sentence(1000 + i, 40).upper().split()) for i in range(60)]
    texts = good + bad
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], None, "src", 1, "z", "r", 5, 6, 7, "sp", "sc") for i, k in enumerate(order)]
    rows += [(i + 1000, t, *r) for i, (_, t, *r) in enumerate(documents())]
    labels = [(i, int(k < 120), 0) for i, k in enumerate(order)] + [(0, None, 0), (1, 7, 1), (None, 1, 0), (99999, 0, 0), (5, int(order[5] < 120), 0)]
    got = {r.doc_id: r for r in QL.predicted(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r, int(order[i] < 120)) for i, r in got.items() if i < len(order) and r.held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in QL.predicted(frame(spark), none).collect()} == {0.5}
    assert QL.predicted(frame(spark, []), none).count() == 0


# --- lexical search -------------------------------------------------------------------------------


def plain_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    split = lambda t: [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(d[0], Counter(split(d[1]))) for d in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(0, "the thing of and"), (1, None), (2, ""), (3, "Straße éé 中文 apache license"), (4, sentence(3, 30)), (4, "one two three"), (5, "x" * 700), (6, "nowhere-to be-found qqq"), (7, sentence(1, 3000))]


@pytest.mark.parametrize("room, first, k", [(256, 128, 50), (1, 2, 3), (1, 1, 1)])
def test_search_equals_plain_ranking(spark, monkeypatch, room, first, k):
    monkeypatch.setattr(LS, "ROOM", room)
    monkeypatch.setattr(LS, "FIRST", first)
    monkeypatch.setattr(LS, "BLOCK", 4)
    monkeypatch.setattr(LS, "LOOKUPS", 1 << 12)
    items = spark.createDataFrame([(*i, "t", 1) for i in ITEMS], "item_id bigint, text string, rank string, score int")
    got = as_rows(LS.search(frame(spark), items, k), ["item_id", "rank", "doc_id", "score"])
    assert sorted(got, key=repr) == plain_search(documents(), ITEMS, k)


def test_bounds_are_never_below_scores():
    rng = random.Random(2)
    for seed in range(20):
        counts = Counter(LS.terms_of(sentence(seed, rng.choice([1, 5, 400])) + " again" * rng.choice([0, 1, 300])))
        bits, places, most = LS.sketch(counts)
        entries = dict(zip(np.frombuffer(places, LS._place_type(bits)).tolist(), most))
        assert list(entries) == sorted(entries) and len(entries) == len(most)
        for term, n in counts.items():
            assert entries[zlib.crc32(term) & ((1 << bits) - 1)] >= min(n, LS.MANY)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert LS.search(frame(spark, []), items).count() == 0
    assert LS.search(frame(spark), items.filter("false")).count() == 0
