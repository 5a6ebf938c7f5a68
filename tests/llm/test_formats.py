"""Chat formatting and WARC packages: exact round trips, and the state machine."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
from itertools import groupby

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import chat_format, warc_zip
from siftline.llm.common import scratch

# --- chats ----------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be <kind>"), (1, 1, "user", "hi </s> [INST] \\1 \\0 \\"), (1, 2, "assistant", "<s> [/INST] <<SYS>>\n\\\\"), (1, 3, "user", ""), (1, 4, "assistant", None),
    (2, 0, "assistant", "starts"), (3, 0, "user", "no answer"), (4, 0, "user", "a"), (4, 1, "tool<|text|>", "b <|end|>"), (4, 2, None, "c <|role|>"), (4, 3, "assistant", " padded \n"),
    (5, 1, "assistant", "second"), (5, 0, "user", "first"), (5, 0, "user", "first"), (6, None, "user", "no turn"), (6, 0, "assistant", "é 中 😀" * 3000), (None, 0, "user", "none"),
    (7, 0, "user", "[IN[INST]ST] </</s>s> <<<SYS>>"), (7, 1, "assistant", "<|<|end|>end|>"),
]


def chats(spark, rows=TURNS):
    return chat_format.format_chats(spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, segments string, formatted string"))


def test_chats_are_read_back(spark):
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    want = {k: list(g) for k, g in groupby(sorted(TURNS, key=order), key=lambda t: t[0])}
    got = chats(spark).select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = want[r.conv_id]
        assert [tuple(b) for b in r.back] == [(t[2] or "", t[3] or "") for t in turns]
        assert r.loss == "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments) and len(r.segments) == 3 * len(turns)
    assert {r.conv_id for r in got if r.valid} == {1, 6, 7}
    assert chats(spark, []).count() == 0


def test_a_mark_never_stands_in_a_text(spark):
    text = "".join(chat_format.INSTRUCT.controls) * 2 + "\\1<\\1s>"
    row = spark.range(1).select(chat_format.escaped(F.lit(text), chat_format.INSTRUCT).alias("e")).withColumn("u", chat_format.unescaped(F.col("e"), chat_format.INSTRUCT)).first()
    assert row.u == text and not any(c in row.e for c in chat_format.INSTRUCT.controls)


def test_chat_plan_has_no_python(spark):
    plan = chats(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- WARC -----------------------------------------------------------------------------------------

LONG = "<p>" + "é" * 60 + "</p>"
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "u\r\nX: y", "\r\n\r\n" * 40), (7, "u", "x" * 3_000_000), (8, "u", "x" * 3_000_000), (None, "n", LONG), (1, "http://a/1", LONG)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "c", "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, first string, payload_bytes int")


def test_archives_are_read_back(spark):
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(raw) >= 100 else None
        again = first is not None and page_id is not None and page_id != first
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc_zip.archive_round_trip(spark, pages(spark)).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    assert warc_zip.archive_round_trip(spark, pages(spark, [])).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(spark, zip64):
    folder = scratch(spark, "warc-test")
    manifest = warc_zip.write_packages(warc_zip.planned(pages(spark)), folder, package_bytes=1000, zip64=zip64)
    packages = [r.package for r in manifest.collect()]
    assert len(packages) > 2 and sum(r.records for r in manifest.collect()) == len(PAGES)
    for package in packages:
        store, path = warc_zip.opened(package)
        with store.open_input_file(path) as file:
            data = file.read()
            own = warc_zip.members(file)
        with zipfile.ZipFile(io.BytesIO(data)) as archive:  # the standard library agrees
            assert archive.testzip() is None and {m: archive.read(m) for m in own} == {n: data[m.start : m.start + m.size] for n, m in own.items()}
    read = {(r.page_id, r.url): bytes(r.payload) for r in warc_zip.read_packages(manifest).filter("payload IS NOT NULL").collect()}
    assert read[6, "u%0D%0AX: y"] == b"\r\n\r\n" * 40 and read[5, ""] == b""


def opened(data: bytes):
    return pa.BufferReader(data)


def archive(**options) -> bytes:
    out = io.BytesIO()
    writer = warc_zip.Writer(out, **options)
    writer.member("a", [b"first ", b"member"])
    writer.member("b", [b""])
    writer.close()
    return out.getvalue()


def test_directories_of_other_writers():
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"abc")
        z.writestr("packed", b"abc" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    with opened(stored.getvalue()) as file:
        found = warc_zip.members(file)
        file.seek(found["x"].start)
        assert set(found) == {"x"} and file.read(found["x"].size) == b"abc"


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_own_writer(zip64):
    data = archive(zip64=zip64)
    assert (b"PK\x06\x06" in data) == zip64
    with opened(b"" + data) as file:
        found = warc_zip.members(file)
    assert {n: data[m.start : m.start + m.size] for n, m in found.items()} == {"a": b"first member", "b": b""}


@pytest.mark.parametrize("broken", [b"", b"PK\x05\x06", archive()[:-30], archive(zip64=True).replace(b"PK\x06\x07", b"PK\x00\x00"), archive().replace(b"PK\x01\x02", b"PK\x00\x00")])
def test_broken_directories_are_errors(broken):
    with opened(broken) as file, pytest.raises((ValueError, struct.error)):
        warc_zip.members(file)


def foreign(index_of=str, archive_kind=zipfile.ZIP_STORED) -> bytes:
    """A package of two archives and three indexes by another writer; pages 1 to 6, of which 5 and 6 stand in a packed index."""
    raws = [gzip.compress(warc_zip.record("response", i, "u", hashlib.sha256(b"%d" % i).hexdigest(), b"%d" % i)) for i in range(1, 7)]
    one, two = raws[:3], raws[3:]
    at = lambda parts, k: index_of(sum(map(len, parts[:k])))
    line = lambda name, parts, k: f"key {k} " + json.dumps({"offset": at(parts, k), "length": str(len(parts[k])), "filename": name})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(one), archive_kind)
        z.writestr("archive/sub/two.warc.gz", b"".join(two))
        z.writestr("indexes/a.cdxj", "!meta 0 {}\n" + "\n".join(line("one.warc.gz", one, k) for k in (2, 0, 1)))  # no newline at the end
        z.writestr("indexes/b.cdx", line("archive/sub/two.warc.gz", two, 0) + "\n\n")
        z.writestr("indexes/c.cdxj.gz", b"".join(gzip.compress((line("sub/two.warc.gz", two, k) + "\n").encode()) for k in (1, 2)))
        z.writestr("datapackage.json", "{}")
    return out.getvalue()


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_every_index_and_archive_is_read(most):
    with opened(foreign(int)) as file:
        found = [(r["page_id"], r["payload"]) for r in warc_zip.records(file, most)]
    assert found == [(i, b"%d" % i) for i in (3, 1, 2, 4, 5, 6)]


def test_indexes_that_name_nothing_are_errors():
    for data, reason in ((foreign(archive_kind=zipfile.ZIP_DEFLATED), "not a stored member"), (foreign(lambda at: at + 5000), "points behind")):
        with opened(data) as file, pytest.raises(ValueError, match=reason):
            list(warc_zip.records(file))
