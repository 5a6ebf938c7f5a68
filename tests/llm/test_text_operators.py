"""Operators that look at one text at a time, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from siftline.llm import bpe, fingerprints, language_id, license_scan, packing, pieces
from tests.llm.fixtures import documents, frame, sentence

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- license scan ---------------------------------------------------------------------------------


def test_license_scan_of_awkward_rows(spark):
    got = license_scan.scan_licenses(frame(spark)).collect()
    assert len(got) == len(documents())
    by = {r.doc_id: r for r in got}
    assert by[20][1:7] == (12, 2, 3, 8, "apache,gpl", "apache,apache-2.0,gpl") and by[20].score == 1.0
    assert by[21][1:6] == (6, 3, 0, 4, "cc-by,mit")
    assert by[5][1:] == (0, 0, None, None, "", "", 0.0) == by[6][1:]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License", "apache,apache-2.0"), ("licensed under the apache licence", ""), ("under the Apache License", "apache"),
        ("This fine work is licensed under the terms of the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("This is licensed under the GNU General Public License as published by the Free Software Foundation; version 2", "gpl,gpl-2.0"),
        ("licensed under the terms of GNU General Public License version 3", "gpl"), ("Released under the MIT-License", "mit,mit-notice"),
        ("this software of ours and friends is licensed under CC BY-NC", "cc-by,cc-by-nc-4.0"),
    ],
)
def test_mandatory_words_must_match(text, labels):
    assert license_scan.scanner()(text)[5] == labels


FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
NOTICES = {
    "gpl,gpl-3.0": FSF.format("", 3),
    "gpl,gpl-2.0": FSF.format("", 2).replace(", either", "; either"),
    "lgpl-3.0": FSF.format("Lesser ", 3),
    "lgpl-2.1": FSF.format("Lesser ", 2.1),
    "agpl-3.0": FSF.format("Affero ", 3),
    "apache,apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by,cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


@pytest.mark.parametrize("labels", NOTICES)
def test_standard_notices(labels):
    assert license_scan.scanner()("Copyright 2020 us.\n" + NOTICES[labels] + " Thank you.")[5] == labels


def readings(template: str) -> list[tuple[list[str], list[bool]]]:
    """The template's shortest and fullest readings: words, and whether each is mandatory."""
    out = []
    for full in (False, True):
        words, fixed, depth = [], [], 0
        for part in license_scan.MARK.split(template):
            if part in ("optional", "/optional"):
                depth += 1 if part == "optional" else -1
            elif part.startswith("any:"):
                if full:
                    words += ["whatever"] * int(part[4:])
                    fixed += [False] * int(part[4:])
            elif full or not depth:
                words += part.split()
                fixed += [not depth] * len(part.split())
        out.append((words, fixed))
    return out


@pytest.mark.parametrize("rule", range(len(license_scan.TEMPLATES)))
def test_one_changed_mandatory_word_loses_the_template(rule):
    label, template = license_scan.TEMPLATES[rule]
    scan = license_scan.scanner([license_scan.TEMPLATES[rule]], {})
    for words, fixed in readings(template):
        text = " ".join(words)
        assert scan(text)[5:] == (label, 1.0)
        for i in np.flatnonzero(fixed).tolist():
            assert scan(" ".join([*words[:i], "changed", *words[i + 1 :]]))[5] == ""


def test_template_markup():
    a = license_scan.compiled("t", "a <<optional>>b <<optional>>c <</optional>><</optional>><<any:2>>d")
    reach = lambda s: a.longest(s.split(), 0)
    assert [reach(s) for s in ("a d", "a b d", "a b c d", "a x y d", "a x y z d", "a c d", "a b c x y d e")] == [2, 3, 4, 4, -1, 3, 6]
    for bad in ("<<optional>>a", "<<optional>>a<</optional>>", "<<any:2>>a"):
        with pytest.raises(ValueError):
            license_scan.compiled("bad", bad)


# --- language -------------------------------------------------------------------------------------


def plain_bits(counts: dict[bytes, dict[int, int]], raw: bytes, order: int) -> float:
    """PPM as in the textbook: method C with exclusion, one byte after the other."""
    total = 0.0
    for i, byte in enumerate(raw):
        out: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = {b: n for b, n in counts.get(raw[i - k : i], {}).items() if b not in out}
            if not seen:
                continue
            n = sum(seen.values()) + len(seen)
            if byte in seen:
                total -= np.log2(seen[byte] / n)
                break
            total -= np.log2(len(seen) / n)
            out |= set(seen)
        else:
            total += np.log2(256 - len(out))
    return total


def test_code_lengths_are_those_of_plain_ppm():
    samples, order, rows = {"a": sentence(1, 200), "b": sentence(2, 200, "der die ung en sch ein zu")}, 3, []
    trees: dict[str, dict] = {"a": {}, "b": {}}
    for lang, text in samples.items():
        code, n = np.unique(language_id._grams(text.encode(), order), return_counts=True)
        rows += [(lang, int(c), int(k)) for c, k in zip(code, n)]
        for i, byte in enumerate(text.encode()):
            for k in range(min(order, i) + 1):
                node = trees[lang].setdefault(text.encode()[i - k : i], {})
                node[byte] = node.get(byte, 0) + 1
    model = language_id.build(rows, order)
    texts = [sentence(3, 300), "q zz é unseen", "x", sentence(4, 2, "ung"), "the " * 700]
    got = model.code_lengths([t.encode() for t in texts])
    for t, bits in zip(texts, got):
        assert bits == pytest.approx([plain_bits(trees[x], t.encode(), order) for x in ("a", "b")], rel=1e-4)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predicted(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out AND n_chars > 40").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert {r.held_out for r in language_id.predicted(docs).filter("doc_id < 50").collect() if (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) != r.held_out} == set()


def test_language_of_awkward_rows(spark):
    got = language_id.predicted(frame(spark)).collect()
    assert len(got) == len(documents())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (5, 6, 7, 8)) and by[0].lang_pred == "en"
    kept = language_id.keep_identified(frame(spark))
    assert kept.columns == frame(spark).columns and {r.doc_id for r in kept.collect()}.isdisjoint({5, 6, 7, 8})
    empty = frame(spark, [])
    assert language_id.predicted(empty).count() == 0
    unlabelled = frame(spark, [(1, "words", None, None, None, *documents()[0][5:])])
    assert [tuple(r) for r in language_id.predicted(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_sample_counts_copies_once(spark):
    copied = [("en", f"copied {i}") for i in range(3)] * 2000 + [("xx", f"other {i}") for i in range(3)] * 2000
    rows = spark.createDataFrame(copied + [("en", f"single {i}") for i in range(600)] + [("few", "a"), ("few", "b")], "lang string, text string").repartition(4)
    got = [tuple(r) for r in language_id.sampled(rows).collect()]
    by = {lang: [t for x, t in got if x == lang] for lang in ("en", "xx", "few")}
    assert len(by["en"]) == len(set(by["en"])) == 400
    assert sorted(by["xx"]) == ["other 0", "other 1", "other 2"] and sorted(by["few"]) == ["a", "b"]
    assert sorted(got) == sorted(tuple(r) for r in language_id.sampled(rows.repartition(7)).collect())


def test_a_language_keeps_its_contexts_beside_longer_ones(spark):
    few = [("bb", sentence(i, 6, "der die ung en sch ein zu")) for i in range(5)]
    rows = lambda more: spark.createDataFrame(few + more, "lang string, text string")
    alone, beside = (language_id.train(rows(more), states=100) for more in ([], [("aa", sentence(i, 400)) for i in range(50)]))
    texts = [sentence(99, 50, "der die ung en sch ein zu").encode(), b"die sch"]
    assert beside.langs == ["aa", "bb"] and beside.code_lengths(texts)[:, 1] == pytest.approx(alone.code_lengths(texts)[:, 0])


def test_texts_go_to_the_workers_once_and_memory_of_other_operators_is_given_up(spark, monkeypatch):
    docs = frame(spark)
    sent, plain = [], type(docs).mapInArrow

    def noted(df, run, *more):
        sent.append((df, run))
        return plain(df, run, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    kept = language_id.keep_identified(docs)
    scored, predict = sent[-1]
    assert scored.schema["row"].dataType.names == [c for c in docs.columns if c != "text"] and sum(c == "text" for c in scored.columns) == 1
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} < whole
    before = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json")) is before
    list(predict(iter(scored.limit(3).toArrow().to_batches())))
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json")) is not before


# --- byte-level BPE -------------------------------------------------------------------------------

VOCABULARY = bpe.vocabulary(RANKS, public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "中", "😀", "1", "'s", "'ll", "!", "\x00", "<|endoftext|>", "\xa0", "ß", "tion"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=8))
def test_bpe_equals_the_library(batch):
    ids = VOCABULARY.encode(batch)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [PLAIN.encode_ordinary(t) for t in batch]
    assert [VOCABULARY.decode(i).decode() for i in ids] == batch


def test_bpe_of_long_matches():
    texts = ["a" * 3000, "ab" * 900, " " * 999, "é" * 333, "=-" * 400, "".join(np.random.default_rng(1).choice(list("abcdefgh"), 1500))]
    assert [np.frombuffer(i, "<u4").tolist() for i in VOCABULARY.encode(texts)] == [PLAIN.encode_ordinary(t) for t in texts]


def test_bpe_of_awkward_rows(spark):
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.round_trip(frame(spark), RANKS, public_tokenizers.PATTERN).collect()}
    for doc_id, text, *_ in documents():
        raw = (text or "").encode()
        row, ids = got[doc_id, hashlib.sha256(raw).hexdigest()], PLAIN.encode_ordinary(text or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert sum(len(r.ids) for r in bpe.encoded(frame(spark), RANKS, public_tokenizers.PATTERN).collect()) == sum(r.n_tokens for r in bpe.round_trip(frame(spark), RANKS, public_tokenizers.PATTERN).collect())


def test_ranks_file_is_read_as_it_is():
    with open(RANKS, "rb") as lines:
        token, rank = lines.readline().split()
    assert VOCABULARY.ranks[base64.b64decode(token)] == int(rank)


# --- packing --------------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 60)), max_size=12))
def test_plan_uses_every_piece_once(lengths):
    histogram = np.zeros(33, np.int64)
    for length, n in lengths:
        histogram[length] += n
    used = np.zeros(33, np.int64)
    for configuration, times in packing.solve(histogram, 32):
        assert sum(k * n for k, n in configuration) <= 32 and times > 0
        for k, n in configuration:
            used[k] += n * times
    assert (used == histogram).all()


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(rng.lognormal(5.5, 0.8, 200_000).astype(int) + 1, 1024), minlength=1025)
    assert sum(n for _, n in packing.solve(histogram, 1024)) <= 1.004 * (histogram @ np.arange(1025)) / 1024 + 1


HARD = {"one length": [300], "halves, thirds, sixths": [*range(513, 560), *range(342, 370), *range(171, 190)], "340 to 520": range(340, 521), "257 to 345": range(257, 346)}


@pytest.mark.parametrize("lengths", HARD.values(), ids=HARD)
def test_plan_meets_the_linear_program(lengths):
    histogram = np.bincount(np.random.default_rng(1).choice(np.array(lengths), 30_000), minlength=1025)
    fractional, bound = packing.program(histogram, 1024)
    covered = np.zeros(1025)
    for configuration, times in fractional.items():
        assert sum(k * n for k, n in configuration) <= 1024 and times >= 0
        for k, n in configuration:
            covered[k] += n * times
    assert (covered >= histogram * (1 - 1e-9)).all()
    value, taken = sum(fractional.values()), sum(n for _, n in packing.solve(histogram, 1024))
    assert value <= 1.001 * bound and bound <= taken <= packing.best_fit(histogram, 1024).total()
    assert taken <= np.ceil(bound) + np.count_nonzero(histogram)


def test_bound_of_the_linear_program_is_one_of_any_packing():
    """Two pieces of 500 or three of 300 fill a sequence, and mixed sequences hold no more: 500 and 333 sequences."""
    histogram = np.zeros(1025, np.int64)
    histogram[300], histogram[500] = 999, 1000
    _, bound = packing.program(histogram, 1024)
    assert 832 < bound <= 833.01 and sum(n for _, n in packing.solve(histogram, 1024)) in (833, 834)
    assert packing.program(np.zeros(1025, np.int64), 1024) == ({}, 0.0) and packing.solve(np.zeros(1025, np.int64), 1024) == []


def test_a_program_with_rare_lengths_beats_best_fit():
    histogram = np.bincount(np.random.default_rng(5).integers(150, 500, 20_000), minlength=1025)
    _, bound = packing.program(histogram, 1024)
    taken, plain = sum(n for _, n in packing.solve(histogram, 1024)), packing.best_fit(histogram, 1024).total()
    assert taken < 1.01 * bound and plain > 1.03 * bound


def test_packing_of_awkward_rows(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    want = []
    for doc_id, text, *_ in documents():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            want.append((doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.pack(frame(spark), TOKENIZER).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------


def test_equal_substrings_are_cut_alike():
    text = sentence(9, 400)
    inside, moved = (fingerprints.fingerprints([t])[0] for t in (text, "some other words before " + text))
    assert fingerprints.likeness(inside, moved) > 0.9
    assert fingerprints.likeness(*fingerprints.fingerprints([text, sentence(10, 400)])) < 0.2
    symbols = np.frombuffer(b"abcabcabdabcabcabd" * 40, np.uint8)
    starts = fingerprints.phrase_starts(symbols, np.arange(len(symbols)) == 0)
    assert (starts[18:-18].reshape(-1, 18) == starts[18:36]).all() and 2 <= 18 / starts[18:36].sum() <= 12


def test_fingerprints_of_awkward_rows(spark):
    got = [tuple(r) for r in fingerprints.compared(frame(spark)).collect()]
    rows = sorted(((d[0] if d[0] is not None else -(2**63), d[1] or "") for d in documents()))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        other = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        a, b, c = fingerprints.fingerprints([text, other, following])
        want.append((None if doc_id == -(2**63) else doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fingerprints.compared(frame(spark, [])).count() == 0
    alone = fingerprints.compared(frame(spark, documents()[:1])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_words_are_encoded_without_the_signs_behind_them():
    seen: list[str] = []
    memory = pieces.PieceMemory(lambda batch: seen.extend(batch) or [p.encode() for p in batch])
    batch = ["a cat, the cat. cat! été? x1 中, no.\nAnd so", "cat's  tail"]
    assert memory.encode(batch) == [t.encode() for t in batch]
    assert seen.count(" cat") == 1 and not {" cat,", " cat.", " cat!", " été?", " x1"} & set(seen)
    assert " 中," in seen and "." in seen and "1" in seen


@given(st.lists(st.lists(st.sampled_from(["a", "Z", "é", "ß", "中", "я", "\u0301", "'s", "'", ".", ",", "_", "1", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\0", "\u00a0", "😀"]), max_size=14).map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def test_cut_texts_have_the_ids_of_whole_ones(batch):
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.encode(batch) == own.whole(batch)
