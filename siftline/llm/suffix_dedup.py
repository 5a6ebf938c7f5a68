"""Removal of repeated passages with longest-previous-factor arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of a smaller id. To bring equal
strings together, each window of ``LENGTH`` bytes is known by its anchor, the run of ``ANCHOR`` bytes in it with the
smallest hash: equal windows have equal anchors. Windows with one anchor lie side by side and form a segment. Copies of
whole texts are set aside first. Which anchors several documents have is found from packed hashes of all of them. An anchor is
so long that unlike documents hardly share one by chance, however many they are: of a short one, all that follows would grow
faster than the input. Of anchors that several documents have, the digests of their segments are compared: equal
segments go in all documents but the first. Where segments of one anchor differ, checksums of what is around the anchor
tell whether they can share a window; only then their bytes are brought together.

In each task the distinct segments of many anchors form one text. Its suffix array, ordered up to ``LENGTH`` bytes by
prefix doubling, gives for every window the nearest suffixes of smaller documents before and behind it in suffix order;
the longer of the two common prefixes is the longest previous factor. Windows of different anchors differ, so a factor of
``LENGTH`` bytes never joins two groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import cut, mix, slices, spans_of, texts, whole

LENGTH, ANCHOR = 50, 32
#: One odd number for each word of 8 bytes of an anchor.
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Documents of an anchor that are compared in one task; anchors of more go the way of :func:`frequent_firsts`.
MOST = 4096
#: Bytes of segments in one suffix array; one anchor's segments stay together.
CHUNK = 1 << 20
#: Bytes of text that a task hashes at once: each takes about ten numbers of 8 bytes.
SLICE = 1 << 20
#: Of these, as many go through each step together as fit into a core's cache with all their numbers.
BLOCK = 1 << 17
#: Bytes of text whose anchors, about a tenth as many, a task looks through at once for those of several documents.
PART = 1 << 22
#: Anchors that a task gathers before it deals them out to the parts.
GATHERED = 1 << 20


# --- anchors --------------------------------------------------------------------------------------


def _words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as a number; zeros stand behind the end."""
    full = np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)])
    data, out = full.tobytes(), np.empty(len(full) - 8, np.uint64)
    for i in range(8):
        view = np.frombuffer(data, ">u8", (len(full) - 8) // 8, i)
        out[i::8] = view
    return out[: len(raw)]


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash and place, first and last window start of each segment of the documents that end at ``ends`` in ``raw``.

    The anchor of a window is its run with the smallest 40-bit hash, the leftmost of equal ones.
    """
    n, width = len(raw), LENGTH - ANCHOR + 1
    starts = np.concatenate([[0], ends[:-1]])
    own = np.repeat(ends.astype(np.int32), ends - starts)
    window = np.arange(n, dtype=np.int32)
    window = window[window + np.int32(LENGTH) <= own]
    if not len(window):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    eight = _words_at(raw)
    known = n - ANCHOR + 8
    run = eight[:known] * FACTORS[0]
    for k, factor in enumerate(FACTORS[1:], 1):
        run += eight[8 * k : 8 * k + known] * factor
    del eight, own
    run ^= run >> np.uint64(31)
    run *= np.uint64(0x94D049BB133111EB)
    run ^= run >> np.uint64(30)
    reach, step = (run & ~np.uint64((1 << 24) - 1)) | np.arange(len(run), dtype=np.uint64), 1
    while step * 2 <= width:
        reach = np.minimum(reach[: len(reach) - step], reach[step:])
        step *= 2
    if step < width:
        reach = np.minimum(reach[: len(reach) - (width - step)], reach[width - step :])
    at = (reach[window] & np.uint64((1 << 24) - 1)).astype(np.int32)
    del reach
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return run[at[new]], at[new].astype(np.int64), window[new].astype(np.int64), np.append(window[new[1:] - 1], window[-1]).astype(np.int64)


def _batch_segments(raw_texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts: all bytes, their starts, and text, anchor, its place, first and last window start of each segment."""
    raw, sizes = np.frombuffer(b"".join(raw_texts), np.uint8), np.array([len(t) for t in raw_texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    parts = [segments(raw[:0], np.zeros(1, np.int64))]
    edges = np.append(starts[np.flatnonzero(np.diff(starts // BLOCK, prepend=-1))], len(raw)).tolist()  # blocks of whole texts
    for begin, end in zip(edges, edges[1:]):
        # A very long text: its windows in stretches that overlap by a window.
        stretch = max(end - begin, 1) if end - begin <= 2 * SLICE else SLICE
        for at in range(begin, end, stretch):
            near = raw[at : min(at + stretch + LENGTH - 1, end)]
            own = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + len(near))] - at
            h, p, a, b = segments(near, np.append(own, len(near)))
            parts.append((h, p + at, a + at, b + at))
    anchor, place, first, last = (np.concatenate(x) for x in zip(*parts))
    return raw, starts, np.searchsorted(ends, first, side="right"), anchor, place, first, last


def _names(anchor: np.ndarray) -> np.ndarray:
    """32 bits that tell anchors of one part from each other. Two of one name pass for shared, and are told apart by their bytes."""
    return mix(anchor).astype(np.uint32).view(np.int32)


def _groups(anchor: np.ndarray) -> np.ndarray:
    """40 bits by which segments of one anchor come together: two anchors of one group are as one that has more segments."""
    return (mix(anchor) >> np.uint64(24)).view(np.int64)


def _rows_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bytes of the numbers from each of the places ``at`` to the next."""
    ends = pa.py_buffer((np.append(at, len(data)) * data.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(data))])


PACKED = "part int, anchors binary, docs binary"


def anchors(rows: DataFrame, parts: int) -> DataFrame:
    """``part, anchors, docs``: each anchor of each document once, of rows ``doc, text``. Anchors fall into ``parts``; those of
    many documents that fall into one are a row: their names, and how far each one's document is from the one before, the
    bytes of one place together, so that small distances leave zeros in a row."""

    def deal(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        part = ((mix(anchor) >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, doc = part[order].astype(np.int32), doc[order].view(np.uint64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        step = np.diff(doc, prepend=np.uint64(0))
        step[at] = doc[at]
        steps, edges = step.astype("<u8").view(np.uint8).reshape(-1, 8), [*at.tolist(), len(part)]
        docs = pa.array([steps[a:b].T.tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[at]), _rows_of(_names(anchor[order]), at), docs], ["part", "anchors", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", SLICE):
                _, _, own, anchor, *_ = _batch_segments([t.encode() for t in texts(part)])
                order = np.lexsort((anchor, own))
                own, anchor = own[order], anchor[order]
                new = np.diff(own, prepend=-1).astype(bool) | np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
                held.append((anchor[new], part.column("doc").to_numpy()[own[new]]))
                size += len(held[-1][0])
                if size >= GATHERED:
                    yield deal(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
            if size:
                yield deal(*(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(run, PACKED)


def shared_anchors(found: DataFrame) -> DataFrame:
    """``doc, mark`` of anchors that several documents have: twice the name, and one more where they are more than ``MOST``."""

    def flush(packed: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        name = np.frombuffer(b"".join(x for x, _ in packed), np.int32)
        doc = np.concatenate([np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0]).view(np.int64) for _, x in packed])
        order = np.argsort(name)
        name, doc = name[order], doc[order]
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.append(start, len(name)))
        several = np.maximum.reduceat(doc, start) > np.minimum.reduceat(doc, start)
        keep, hot = np.repeat(several, size), np.repeat(size > MOST, size)
        mark = (name.astype(np.int64) * 2 + hot)[keep]
        order = np.argsort(doc[keep], kind="stable")  # rows of one document in a row take less room
        return pa.RecordBatch.from_arrays([pa.array(doc[keep][order]), pa.array(mark[order])], ["doc", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                    if part != last and held:
                        yield flush(held)
                        held = []
                    last = part
                    held.append(packed)
            if held:
                yield flush(held)

    return found.repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc bigint, mark bigint")


class Chosen(NamedTuple):
    """Segments of a batch whose anchors its rows list: all bytes of the batch, and for each segment its text, anchor's group, place
    in the text, place among all bytes, length, and the anchor's place in it."""

    raw: bytes
    own: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    at: np.ndarray
    size: np.ndarray
    inside: np.ndarray


def _chosen(part: pa.RecordBatch, column: str) -> Chosen:
    """The segments whose anchors the row lists in ``column``: by group in ``wanted``, else by name."""
    raw_texts = [t.encode() for t in texts(part)]
    raw, base, own, anchor, place, first, last = _batch_segments(raw_texts)
    group, lists = _groups(anchor), part.column(column)
    told = group if column == "wanted" else _names(anchor)
    edges, chosen = np.searchsorted(own, np.arange(len(raw_texts) + 1)), np.zeros(len(anchor), bool)
    for i in range(len(raw_texts)):
        a, b = edges[i], edges[i + 1]
        chosen[a:b] = np.isin(told[a:b], lists[i].values.to_numpy(zero_copy_only=False))
    own, first = own[chosen], first[chosen]
    return Chosen(raw.tobytes(), own, group[chosen], first - base[own], first, last[chosen] + LENGTH - first, place[chosen] - first)


def _digests(raw: bytes, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit digest of each stretch of ``size`` bytes, ``width`` at most, from ``at`` on: a chain of scrambled words."""
    data = raw + bytes(width + 8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the 8 bytes from every place, without a copy
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, width, 8):
        rest = np.clip(size - k, 0, 8).astype(np.uint64) * np.uint64(8)
        # Bytes behind the end are shifted out; a shift by all 64 bits is done in two steps.
        word = (words[at + k] << ((np.uint64(64) - rest) >> np.uint64(1))) << ((np.uint64(65) - rest) >> np.uint64(1))
        h = mix((h ^ word) + np.uint64(0xD1B54A32D192ED03))
    return h


def _sides(found: Chosen) -> np.ndarray:
    """Two 16-bit checksums of half a window to the left and to the right of each anchor, 0 where no window reaches so far.

    A window has at least half of what is not its anchor on one side, so segments that share a window share a checksum.
    """
    half = (LENGTH - ANCHOR) // 2
    width, place = half + ANCHOR, found.at + found.inside
    check = lambda at: (_digests(found.raw, at, np.full(len(at), width), width) >> np.uint64(48)) | np.uint64(1)
    left = np.where(found.inside >= half, check(np.maximum(place - half, 0)), np.uint64(0))
    right = np.where(found.inside + width <= found.size, check(place), np.uint64(0))
    return ((left << np.uint64(16)) | right).astype(np.uint32).view(np.int32)


def _spans_of(start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Start and end of each span in one number (no Spark text is longer than 31 bits tell)."""
    return pa.array(start.astype(np.int64) << 32 | stop.astype(np.int64))


SPANS = "doc bigint, tag bigint, span bigint"
KEYS = "anchor bigint, key bigint, sides int, doc bigint, tag bigint, span bigint"
#: A segment starts at most so many bytes before its anchor and ends so many behind it.
WIDEST = 2 * LENGTH - ANCHOR


def segment_keys(listed: DataFrame, column: str) -> DataFrame:
    """A row for each segment of ``doc, tag, text`` whose anchor is in ``column``; ``key`` is a digest of its bytes, ``sides``
    checksums of what is around the anchor. Equal segments that overlap, as in a text that repeats itself, are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", SLICE):
                found = _chosen(part, column)
                own, anchor, at, size = found.own, found.anchor, found.at, found.size
                key, sides, stop = _digests(found.raw, at, size, WIDEST).view(np.int64), _sides(found), at + size
                same = (own[1:] == own[:-1]) & (anchor[1:] == anchor[:-1]) & (key[1:] == key[:-1]) & (at[1:] <= stop[:-1])
                one = np.flatnonzero(np.r_[True, ~same][: len(own)])
                size = stop[np.append(one[1:], len(own)) - 1] - at[one]
                take = pa.array(own[one])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[one]), pa.array(key[one]), pa.array(sides[one]), part.column("doc").take(take), part.column("tag").take(take),
                        _spans_of(found.start[one], found.start[one] + size),
                    ],
                    ["anchor", "key", "sides", "doc", "tag", "span"],
                )

    return listed.filter(F.size(column) > 0).select("doc", "tag", "text", "row", "few", "many").mapInArrow(run, KEYS)


SEGMENTS = "anchor bigint, doc bigint, tag bigint, starts array<bigint>, bytes binary"


def segment_bytes(listed: DataFrame, column: str) -> DataFrame:
    """``anchor, doc, tag, starts, bytes``: the distinct segments of each row whose anchors are in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", SLICE):
                raw, own, anchor, start, at, size, _ = _chosen(part, column)
                rows: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
                for i, h, s, a, n in zip(own.tolist(), anchor.tolist(), start.tolist(), at.tolist(), size.tolist()):
                    rows.setdefault((i, raw[a : a + n]), (h, []))[1].append(s)
                take = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h for h, _ in rows.values()], pa.int64()), part.column("doc").take(take), part.column("tag").take(take),
                        pa.array([x for _, x in rows.values()], pa.list_(pa.int64())), pa.array([b for _, b in rows], pa.binary()),
                    ],
                    ["anchor", "doc", "tag", "starts", "bytes"],
                )

    return listed.filter(F.size(column) > 0).select("doc", "tag", "text", "row", column).mapInArrow(run, SEGMENTS)


def compared_keys(keys: DataFrame) -> DataFrame:
    """``doc, tag, span, wanted``: what goes because an earlier document has an equal segment, and the anchors of
    segments that are the first of their kind and may share a window with another document's."""
    names = ["anchor", "key", "sides", "doc", "tag", "span"]

    def alike(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether another document has the same checksum at the anchor."""
        order = np.lexsort((side, anchor))
        new = np.flatnonzero(np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (side[order][1:] != side[order][:-1])])
        several = np.maximum.reduceat(doc[order], new) > np.minimum.reduceat(doc[order], new)
        out = np.zeros(len(anchor), bool)
        out[order] = np.repeat(several, np.diff(np.append(new, len(anchor))))
        return out & (side != 0)

    def compare(columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((columns[3], columns[1], columns[0]))
        anchor, key, sides, doc, tag, span = (c[order] for c in columns)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])]
        kind = np.cumsum(new) - 1
        gone = doc > doc[np.flatnonzero(new)][kind]
        # One row of each kind stands for it; alone among its kinds at the anchor it is alike to none.
        h, s, d = anchor[new], sides[new].view(np.uint32), doc[new]
        ask = (alike(h, s >> np.uint32(16), d) | alike(h, s & np.uint32(0xFFFF), d))[kind] & ~gone
        order = np.argsort(doc[gone], kind="stable")  # rows of one document in a row take less room
        d, t, span = (c[gone][order] for c in (doc, tag, span))
        rows = pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(span), pa.nulls(len(d), pa.int64())], [*"dtsw"])
        d, h = doc[ask], anchor[ask]
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)]
        d, h = d[new], h[new]
        asked = pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.zeros(len(d), np.int64)), pa.nulls(len(d), pa.int64()), pa.array(h)], [*"dtsw"])
        return pa.Table.from_batches([rows, asked]).rename_columns(["doc", "tag", "span", "wanted"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(n).to_numpy() for n in names])
            size += batch.num_rows
            if size >= 1 << 19:
                columns = [np.concatenate(c) for c in zip(*held)]
                at = int(np.searchsorted(columns[0] == columns[0][-1], True))  # the last anchor may go on
                if at:
                    yield from compare([c[:at] for c in columns]).to_batches()
                held, size = [[c[at:] for c in columns]], len(columns[0]) - at
        if size:
            yield from compare([np.concatenate(c) for c in zip(*held)]).to_batches()

    return keys.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"{SPANS}, wanted bigint")


# --- suffix arrays --------------------------------------------------------------------------------


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the pairs, from 1, and the places in their order, ties by place."""
    n = len(high)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    if int(high.max()).bit_length() + int(low.max()).bit_length() + int(bits) <= 64:
        width = np.uint64(int(low.max()).bit_length())
        both = np.sort((((high << width) | low) << bits) | np.arange(n, dtype=np.uint64))
        order, key = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    else:
        order = np.lexsort((low, high))
        key = np.cumsum(np.append(0, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.append(1, key[1:] != key[:-1])).astype(np.uint64)
    return rank, order


def suffix_order(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``raw``, ordered by the first ``length`` bytes and then by place, and each place's rank.

    Equal ranks mean equal first ``length`` bytes. The end comes before any byte.
    """
    after = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    rank, done = raw.astype(np.uint64) + np.uint64(1), 1
    order = np.argsort(raw, kind="stable")
    while done < length:
        step = min(done, length - done)
        rank, order = _ranked(rank, after(rank, step))
        done += step
    return order, rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: pointers that jump over larger values."""
    at = np.arange(-1, len(values) - 1)
    wrong = np.arange(len(values))
    while len(wrong):  # only those whose place may still be wrong are looked at again
        to = at[wrong]
        still = (to >= 0) & (values[to] >= values[wrong])
        wrong, to = wrong[still], to[still]
        at[wrong] = at[to]
    return at


def earlier_factors(raw: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the longest previous factor of each window, over windows of smaller ``doc``, has ``length`` bytes at least.

    In suffix order the suffix with the longest common prefix among those of smaller documents is the nearest one before
    or behind.
    """
    order, rank = suffix_order(raw, length)
    number = np.full(len(raw), -1)
    number[windows] = np.arange(len(windows))
    inside = number[order]
    inside = inside[inside >= 0]  # windows in suffix order
    value, place = doc[inside], rank[windows[inside]]
    before = previous_smaller(value)
    behind = len(value) - 1 - previous_smaller(value[::-1])[::-1]
    out = np.zeros(len(windows), bool)
    hit = (before >= 0) & (place[before] == place)
    hit |= (behind < len(value)) & (place[np.minimum(behind, len(value) - 1)] == place)
    out[inside] = hit
    return out


def _spans(rows: list[tuple[int, int, int, list[int], bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """``doc, tag, start, end`` of what goes in whole groups of segments, ordered by anchor and document."""
    first: dict[bytes, int] = {}
    owner = [first.setdefault(r[4], i) for i, r in enumerate(rows)]
    kinds: dict[int, int] = {}
    for i in first.values():
        kinds[rows[i][0]] = kinds.get(rows[i][0], 0) + 1
    several = [i for i in first.values() if kinds[rows[i][0]] > 1]  # else all segments of the anchor are equal
    runs: dict[int, list[tuple[int, int]]] = {}
    if several:
        size = np.array([len(rows[i][4]) for i in several])
        base = np.cumsum(size) - size
        n = size - LENGTH + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(np.arange(len(several)), n)
        hit = earlier_factors(np.frombuffer(b"".join(rows[i][4] for i in several), np.uint8), base[own] + nth, np.array([rows[i][1] for i in several])[own])
        new = np.append(np.diff(own) > 0, True)
        # A False behind each segment's windows keeps runs apart.
        apart = np.insert(hit, np.flatnonzero(new) + 1, False)
        shift = np.insert(nth, np.flatnonzero(new) + 1, -1)
        whose = np.insert(own, np.flatnonzero(new) + 1, -1)
        for a, b in zip(*spans_of(apart)):
            runs.setdefault(several[whose[a]], []).append((int(shift[a]), int(shift[b - 1])))
    for i, (_, doc, tag, starts, raw) in enumerate(rows):
        if doc > rows[owner[i]][1]:
            yield from ((doc, tag, s, s + len(raw)) for s in starts)
        else:
            yield from ((doc, tag, s + a, s + b + LENGTH) for a, b in runs.get(owner[i], ()) for s in starts)


def differing_spans(found: DataFrame) -> DataFrame:
    """``doc, tag, span``: what goes of segments that differ, from suffix arrays over groups of anchors."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        spans = np.array(list(_spans(rows)), np.int64).reshape(-1, 4).T
        doc, tag, start, stop = spans[:, np.argsort(spans[0], kind="stable")]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), _spans_of(start, stop)], ["doc", "tag", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK and row[0] != rows[-1][0]:
                    yield batch_of(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield batch_of(rows)

    return found.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(run, SPANS)


def frequent_firsts(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For anchors of many documents, as aggregates and joins that no single task has to hold: ``doc, tag, span`` of
    segments that an earlier document has, and ``doc, wanted`` of those that are the first of their kind."""
    first = keys.groupBy("anchor", "key").agg(F.min("doc").alias("first"))
    seen = keys.join(first, ["anchor", "key"])
    copied = seen.filter("doc > first").select("doc", "tag", "span")
    return copied, seen.filter("doc = first").groupBy("doc").agg(F.collect_set("anchor").alias("wanted"))


def frequent_windows(found: DataFrame) -> DataFrame:
    """``doc, tag, span`` of windows of segments that a smaller document among them has."""
    # Known by half of a SHA-256, which is a third as long.
    window = F.substring(F.unhex(F.sha2(F.substring("bytes", F.col("at"), F.lit(LENGTH)), 256)), 1, 16)
    place = F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - LENGTH + 1)).alias("at")
    windows = found.select("doc", "tag", "starts", "bytes", place).select("doc", "tag", "starts", "at", window.alias("window"))
    smallest = windows.groupBy("window").agg(F.min("doc").alias("first"))
    gone = windows.join(smallest, "window").filter("first < doc").select("doc", "tag", "at", F.explode("starts").alias("start"))
    start = F.col("start") + F.col("at") - 1
    return gone.select("doc", "tag", F.shiftleft(start, 32).bitwiseOR(start + LENGTH).alias("span"))


# --- documents ------------------------------------------------------------------------------------


def with_spans(docs: DataFrame, row: list[str]) -> DataFrame:
    """``row`` (the named columns), ``text``, ``tag``, ``copy`` (an earlier document has the whole text) and ``spans``
    (``tag, span`` of what goes; null for nothing).

    All joins are on ``doc``, which is never null. All branches take the same columns along, needed or not, so that they read
    one shuffle of the texts and one of the lists.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc")
    rows = docs.select(key, whole().alias("text"), F.struct(*row).alias("row"))
    thin = cut(rows.select("doc", F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digests")
    first = cut(thin.groupBy("digest").agg(F.min("doc").alias("first")), "firsts")
    about = cut(thin.join(first, "digest").groupBy("doc").agg((F.count(F.lit(1)) > 1).alias("repeated"), (F.min("first") < F.first("doc")).alias("copy")), "about")
    # Only texts of an id that repeats need a tag to tell them apart, and they go the long way.
    told = rows.join(about.hint("merge"), "doc").select("doc", "text", "row", F.when(F.col("repeated"), F.xxhash64("text")).otherwise(0).alias("tag"), (F.col("copy") & ~F.col("repeated")).alias("copy"))

    parts = 1 + (thin.agg(F.sum("size")).first()[0] or 0) // PART
    shared = shared_anchors(anchors(told.filter("NOT copy").select("doc", "text", "row"), parts))
    marked = lambda bit: F.collect_list(F.when(F.col("mark").bitwiseAND(1) == bit, F.shiftright("mark", 1).cast("int")))
    # Gathered from thin rows: the lists of each task for each document would hold less and less the more tasks there are.
    lists = shared.repartition("doc").groupBy("doc").agg(marked(0).alias("few"), marked(1).alias("many"))
    listed = told.filter("NOT copy").join(lists.hint("merge"), "doc")
    few = compared_keys(segment_keys(listed, "few"))
    copied, wanted_many = frequent_firsts(segment_keys(listed, "many"))
    asked = few.filter("wanted IS NOT NULL").select("doc", "wanted").repartition("doc").groupBy("doc").agg(F.collect_list("wanted").alias("wanted"))
    asking = lambda wanted: told.filter("NOT copy").join(wanted.hint("merge"), "doc")
    spans = few.filter("span IS NOT NULL").select("doc", "tag", "span").union(differing_spans(segment_bytes(asking(asked), "wanted")))
    spans = spans.union(copied).union(frequent_windows(segment_bytes(asking(wanted_many), "wanted")))
    gathered = spans.repartition("doc").groupBy("doc").agg(F.collect_list(F.struct("tag", "span")).alias("spans"))
    return told.join(gathered.hint("merge"), "doc", "left").select("row", "text", "tag", "copy", "spans")


def _kept(part: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes of each text, and which of them stay."""
    spans = part.column("spans")
    ends, (tags, both) = spans.offsets.to_numpy(), (c.to_numpy() for c in spans.values.flatten())
    for text, tag, copy, a, b in zip(texts(part), part.column("tag").to_pylist(), part.column("copy").to_pylist(), ends, ends[1:]):
        raw = text.encode()
        if copy and len(raw) >= LENGTH:
            yield raw, np.zeros(len(raw), bool)
            continue
        own = both[a:b][tags[a:b] == tag]
        if not len(own):
            yield raw, np.ones(len(raw), bool)
            continue
        change = np.bincount(own >> 32, minlength=len(raw) + 1) - np.bincount(own & (2**32 - 1), minlength=len(raw) + 1)
        yield raw, np.cumsum(change[:-1]) == 0


def removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text is the empty text; texts of fewer than ``LENGTH`` bytes lose nothing. Rows that repeat an id are parts of
    one document, which never removes anything from itself; rows without an id are one that comes before all others.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            out = []
            for raw, kept in _kept(part):
                rest = np.frombuffer(raw, np.uint8)[kept].tobytes() if not kept.all() else raw
                out.append((len(raw), len(raw) - len(rest), len(spans_of(~kept)[0]), hashlib.sha256(rest).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ["doc_id"])
    out = found.mapInArrow(run, "row struct<doc_id:bigint>, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the rest of their texts; a character goes if all of its bytes go, a row if no text is left.

    Rows whose text was empty before stay. ``n_chars``, where there is one, is counted anew.
    """
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            kept_texts, stays = [], []
            for text, (plain, kept) in zip(texts(part), _kept(part)):
                if not kept.all():
                    raw = np.frombuffer(plain, np.uint8)
                    start = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole_characters = np.repeat(np.logical_or.reduceat(kept, start), np.diff(np.append(start, len(raw))))
                    kept_texts.append(raw[whole_characters].tobytes().decode())
                else:
                    kept_texts.append(text)
                stays.append(bool(kept_texts[-1]) or not text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept_texts, pa.string())], ["row", "text"]).filter(pa.array(stays))

    found = with_spans(docs, others)
    out = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    columns = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
