"""Byte-level BPE in numpy: encoding in length-bucketed padded matrices, decoding by table.

A text is cut at spaces that stand before a word; no match of the split pattern reaches across such a place, so each
distinct piece is split and encoded once for each worker. The distinct matches of a batch are put into matrices by their
lengths, one row each. In every round each row looks up its neighbouring pairs in a hash table and merges its leftmost
pair of minimum rank; rows are compacted to the left, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftline.llm.common import kept, mix, slices, texts, whole
from siftline.llm.pieces import PieceMemory

NONE = np.int32(2**31 - 1)
#: Matches of more bytes are merged with a heap, where a matrix would take a round for each merge over the whole row.
WIDEST = 128

class Vocabulary:
    """Ranks of byte strings, and the pairs of ranks that merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        # \s means White_Space here, which excludes the separators U+001C to U+001F.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_to_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs, np.uint64).T
        self.keys, self.values = self._table((left << np.uint64(32)) | right, merged.astype(np.int32))
        self.memory = PieceMemory(self.encode_pieces)

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing, at most a quarter full; an empty slot holds the largest number."""
        size = 1 << (len(keys) * 4).bit_length()
        slots, out = np.full(size, ~np.uint64(0)), np.full(size, NONE, np.int32)
        at, todo = mix(keys) & np.uint64(size - 1), np.arange(len(keys))
        while len(todo):
            free = todo[slots[at[todo]] == ~np.uint64(0)]
            slots[at[free]] = keys[free]  # of several for one slot, the last one is in
            done = slots[at[todo]] == keys[todo]
            out[at[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64(size - 1)
        return slots, out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merged pair; NONE where the pair does not merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        last = np.uint64(len(self.keys) - 1)
        at = mix(key) & last
        held = self.keys[at]
        out = np.where(held == key, self.values[at], NONE)
        open_ = np.flatnonzero((held != key) & (held != ~np.uint64(0)))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & last
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != ~np.uint64(0))]
        return out

    # --- encoding ---------------------------------------------------------------------------------

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of byte strings of one length or nearly so, none of them empty."""
        width = max(map(len, rows))
        sizes = np.array([len(r) for r in rows])
        ids = self.bytes_to_rank[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8)].reshape(len(rows), width)
        place = np.arange(width)
        ids[place >= sizes[:, None]] = -1
        out: list[bytes] = [b""] * len(rows)
        alive = np.arange(len(rows))
        ranks = np.full((len(rows), max(width - 1, 1)), NONE, np.int32)
        pair = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        ranks[:, : width - 1][pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(alive):
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            rank = ranks[np.arange(len(alive)), best]
            ended = rank == NONE
            if ended.any():
                row, at = ids[ended], 0
                flat = row[place[: row.shape[1]] < sizes[ended][:, None]].astype("<u4").tobytes()
                for r, n in zip(alive[ended].tolist(), (sizes[ended] * 4).tolist()):
                    out[r] = flat[at : at + n]
                    at += n
                ids, ranks, alive, sizes, best, rank = ids[~ended], ranks[~ended], alive[~ended], sizes[~ended], best[~ended], rank[~ended]
                if not len(alive):
                    break
            r = np.arange(len(alive))
            # Compaction: everything right of the merged pair moves one place to the left.
            source = np.minimum(np.arange(ids.shape[1])[None, :] + (np.arange(ids.shape[1])[None, :] > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[r, best] = rank
            ranks = np.take_along_axis(ranks, np.minimum(source[:, : ranks.shape[1]], ranks.shape[1] - 1), axis=1)
            sizes = sizes - 1
            ids[r, sizes] = -1
            ids, ranks = ids[:, : max(sizes.max(), 2)], ranks[:, : max(sizes.max() - 1, 1)].copy()
            ranks[np.arange(ranks.shape[1])[None, :] >= (sizes - 1)[:, None]] = NONE
            for at in (best - 1, best):  # only the pairs beside the merged one are new
                ok = np.flatnonzero((at >= 0) & (at + 1 < sizes))
                ranks[ok, at[ok]] = self.pair_ranks(ids[ok, at[ok]], ids[ok, at[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long match: a linked list, and a heap of pairs by rank and place."""
        ids = self.bytes_to_rank[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token, rank_of = self.tokens, self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(token[ids[i]] + token[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them has been merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(token[rank] + token[ids[k]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of.get(token[ids[h]] + token[rank])) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_matches(self, matches: set[str]) -> dict[str, bytes]:
        """Ids of each match of the split pattern."""
        known: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            raw = match.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[match] = rank.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                known[match] = self.merge_long(raw)
            else:
                buckets.setdefault((len(raw) + 1) // 2, []).append((match, raw))
        for bucket in buckets.values():
            for i in range(0, len(bucket), 16384):
                names, rows = zip(*bucket[i : i + 16384])
                known.update(zip(names, self.merge_rows(rows)))
        return known

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those that begin with a space and a character are split by the pattern as one text."""
        led = [i for i, p in enumerate(pieces) if p.startswith(" ") and p[1:2].strip()]
        own = sorted(set(range(len(pieces))).difference(led))
        joined = self.pattern.findall("".join(pieces[i] for i in led))
        apart = [self.pattern.findall(pieces[i]) for i in own]
        known = self.encode_matches(set(joined).union(*apart))
        out = {i: b"".join(map(known.__getitem__, parts)) for i, parts in zip(own, apart)}
        ids = list(map(known.__getitem__, joined))
        flat = b"".join(ids)
        ends = np.cumsum([0, *map(len, joined)])  # in characters
        at = np.cumsum([0, *map(len, ids)])  # in bytes of ids
        cuts = at[np.searchsorted(ends, np.cumsum([0, *(len(pieces[i]) for i in led)]))].tolist()
        out.update((i, flat[x:y]) for i, x, y in zip(led, cuts, cuts[1:]))
        return [out[i] for i in range(len(pieces))]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return self.memory.encode(batch)

    # --- decoding ---------------------------------------------------------------------------------

    @property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_decoding"):
            last = max(self.tokens) + 1
            sizes = np.zeros(last, np.int64)
            sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
            self._decoding = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(last)), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._decoding

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all tokens, one after the other."""
        table, starts, sizes = self._bytes
        tokens = np.frombuffer(ids, "<u4")
        n = sizes[tokens]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        step = np.repeat(starts[tokens] - (ends - n), n)
        return table[step + np.arange(ends[-1])].tobytes()


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file; read once in each worker."""

    def read() -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    return kept((Vocabulary, path, pattern), read)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_tokens, ids_sha256, decoded_sha256``, without a shuffle.

    A null text is the empty text: no tokens. Other columns are not read; repeated rows give repeated results. ``path`` is
    the rank file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for part in slices(batches, "text"):
            ids = own.encode(texts(part))
            digest = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array((digest(own.decode(i)) for i in ids), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs.doc_id.cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids (array<int>)`` of every row of ``docs``, for users who want the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for part in slices(batches, "text"):
            rows = [np.frombuffer(i, "<u4").astype(np.int32) for i in own.encode(texts(part))]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(docs.doc_id.cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
