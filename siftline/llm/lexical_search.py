"""Ranked lexical search with hashed max-sketches: upper bounds for all documents, exact scores only where they can matter.

Each document is folded into a sketch whose width is a power of two: a term's occurrences go to the place its hash names, and
a place keeps the largest. Sketches are wide, so few terms meet, and stored as their taken places. An occurrence count gives
an impact that grows with it, so the entry at a query term's place is an upper bound of the term's impact, and the weighted
sum over an item's terms one of its score. Bounds of many documents and all items of a block are computed at once.

Documents are scored exactly in descending order of their bounds, in rounds over the cluster: first the ``FIRST`` documents
of each item with the largest bounds. The score at the wanted rank is a threshold that no document with a smaller bound can
reach; every document with a bound at or above it is scored next, and then the ranks are final. Nothing is left out: where
bounds are loose, more documents are scored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import cut, slices, texts, whole
from siftline.operators.ordered import top_k

#: Places of a sketch for each distinct term, at least; with fewer places more terms meet, and bounds are looser.
ROOM = 256
#: Occurrences from here on are one entry, whose impact is the largest possible.
MANY = 255
#: Documents of an item that the first round scores.
FIRST = 128
#: Items that are searched together: what a task holds of the items grows with it.
BLOCK = 1024
#: Bounds, and entries that add to them, that a task holds at once, about.
LOOKUPS = 1 << 20
#: Stands for a null id where numbers are compared.
NO_ID = -(2**63)

#: Bytes that are no part of a term become spaces, A-Z become lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_TERM_BYTES).split()


def sketch(counts: Counter[bytes]) -> tuple[int, bytes, bytes]:
    """Binary logarithm of the width, the taken places in ascending order, and the largest occurrence count at each."""
    bits = min(32, max(3, (ROOM * len(counts) - 1).bit_length()))
    place = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts)) & np.uint32((1 << bits) - 1)
    most = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MANY)
    order = np.lexsort((most, place))
    last = order[np.flatnonzero(np.append(place[order][1:] != place[order][:-1], True))]  # the largest count of each place
    return bits, place[last].astype(_place_type(bits)).tobytes(), most[last].astype(np.uint8).tobytes()


def _place_type(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


class Block(NamedTuple):
    """Items that are searched together: their distinct terms, and the term numbers and weights of all items in a row."""

    items: list[int | None]
    terms: list[bytes]
    slots: np.ndarray
    starts: np.ndarray
    weights: np.ndarray

    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and weights in the order of the terms that they hold, and where each term's begin."""
        order = np.argsort(self.slots, kind="stable")
        item = np.repeat(np.arange(len(self.items)), np.diff(np.append(self.starts, len(self.slots))))
        return item[order], self.weights[order], np.searchsorted(self.slots[order], np.arange(len(self.terms) + 1))

    def weighted(self, df: list[int], n_docs: int) -> Block:
        """The block with the weights that these document counts give."""
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
        return self._replace(weights=weight[self.slots] if len(self.slots) else np.zeros(0, np.int64))


def block_of(items: list[tuple[int | None, str | None]]) -> Block:
    """A block of items; rows of one id are one item, and an item without terms is left out, as no document can match it."""
    each: dict[int | None, set[bytes]] = {}
    for item, text in items:
        each.setdefault(item, set()).update(terms_of(text or ""))
    each = {i: t for i, t in each.items() if t}
    number = {t: k for k, t in enumerate(sorted(set().union(*each.values())))}
    slots = [sorted(number[t] for t in ts) for ts in each.values()]
    starts = np.cumsum([0, *map(len, slots)])[:-1]
    return Block(list(each), list(number), np.array([k for s in slots for k in s], np.int64), starts.astype(np.int64), np.zeros(0, np.int64))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of a term's weight that ``tf`` occurrences give, in millionths."""
    return (1000000000 * tf) // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 50 + (50 * n * n_docs) // max(n_terms, 1)


INDEX = "row bigint, doc_id bigint, n bigint, bits int, places binary, most binary, text string"


def build_index(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n``, the sketch and the text of every row with a term, as a table in the shared folder.

    The text lies beside its sketch, so that a row is scored where its bound is computed and no text is shuffled.
    ``row`` tells rows of one id apart: a digest of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keep, n, drawn = [], [], []
            for i, text in enumerate(texts(part)):
                counts = Counter(terms_of(text))
                if counts:
                    keep.append(i)
                    n.append(sum(counts.values()))
                    drawn.append(sketch(counts))
            take = pa.array(keep, pa.int64())
            columns = [part.column("row").take(take), part.column("doc_id").take(take), pa.array(n, pa.int64())]
            columns += [pa.array([d[i] for d in drawn], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, part.column("text").take(take)], ["row", "doc_id", "n", "bits", "places", "most", "text"])

    return cut(_rows(docs).mapInArrow(run, INDEX), "sketches")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("bigint"), whole().alias("text"))


def document_counts(docs: DataFrame, terms: list[bytes]) -> list[int]:
    """How many rows hold each of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = {t: k for k, t in enumerate(terms)}, np.zeros(len(terms), np.int64)
        for part in slices(batches, "text"):
            for text in texts(part):
                held = [number[t] for t in number.keys() & set(terms_of(text))]
                found[held] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "df"])

    out = [0] * len(terms)
    # A row for each of the block's terms at most.
    for r in _rows(docs).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``n`` places from ``first`` on: the range and the place of each of them."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(own))


def _bounds(block: Block, part: pa.RecordBatch, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows in the batch, and the upper bound of every item's score for each of them."""
    bits = part.column("bits").to_numpy()
    m = length_factor(part.column("n").to_numpy(), n_docs, n_terms)
    hashes = np.array([zlib.crc32(t) for t in block.terms], np.int64)
    items, weights, begin = block.by_term()
    step = max(1, LOOKUPS // max(len(block.slots), len(block.items)))
    for width in np.unique(bits).tolist():
        same = np.flatnonzero(bits == width)
        by_place = np.argsort(hashes & ((1 << width) - 1), kind="stable")
        asked = (hashes & ((1 << width) - 1))[by_place]
        for at in range(0, len(same), step):
            some = same[at : at + step]
            take = pa.array(some)
            drawn = [np.frombuffer(x, _place_type(width)) for x in part.column("places").take(take).to_pylist()]
            places, entry = np.concatenate(drawn).astype(np.int64), np.frombuffer(b"".join(part.column("most").take(take).to_pylist()), np.uint8).astype(np.int64)
            doc = np.repeat(np.arange(len(some)), [len(x) for x in drawn])
            first, stop = np.searchsorted(asked, places), np.searchsorted(asked, places, "right")
            hit = np.flatnonzero(stop > first)
            # Each entry at the place of query terms, for each of the terms, then for each item that holds the term.
            own, nth = _expanded(first[hit], (stop - first)[hit])
            term, own = by_place[nth], hit[own]
            value = np.where(entry[own] == MANY, 1000000, impact(entry[own], m[some[doc[own]]]))
            pair, slot = _expanded(begin[term], begin[term + 1] - begin[term])
            key = doc[own][pair] * len(block.items) + items[slot]
            # Sums of whole numbers far below 2**53: exact in doubles.
            total = np.bincount(key, (value[pair] * weights[slot]).astype(np.float64), len(some) * len(block.items))
            yield some, total.astype(np.int64).reshape(len(some), -1)


BOUNDS = "item int, row bigint, doc_id bigint, bound bigint"


def largest_bounds(index: DataFrame, block: Block, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """``item, row, doc_id, bound``: the ``most`` rows of the largest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [np.zeros((4, 0), np.int64)], 0  # item, bound, row, document
        lowest = np.zeros(len(block.items), np.int64)

        def best() -> np.ndarray:
            both = np.concatenate(held, axis=1)
            both = both[:, np.lexsort((-both[1], both[0]))]
            item, bound = both[:2]
            nth = np.arange(len(item)) - np.searchsorted(item, item)
            full = nth == most - 1
            lowest[item[full]] = bound[full]
            return both[:, nth < most]

        for part in slices(batches, "places", 1 << 20):
            row, doc_id = part.column("row").to_numpy(), part.column("doc_id").fill_null(NO_ID).to_numpy()
            for some, bound in _bounds(block, part, n_docs, n_terms):
                i, item = np.nonzero(bound > lowest)
                held.append(np.stack([item, bound[i, item], row[some[i]], doc_id[some[i]]]))
                fresh += len(i)
                if fresh > 1 << 18:
                    held[:], fresh = [best()], 0
        item, bound, row, doc_id = best()
        columns = [pa.array(item.astype(np.int32)), pa.array(row), pa.array(doc_id, mask=doc_id == NO_ID), pa.array(bound)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "row", "doc_id", "bound"])

    return top_k(index.drop("text").mapInArrow(run, BOUNDS), ["item"], [F.desc("bound"), F.asc("doc_id"), F.asc("row")], most, "row")


class Best:
    """The ``k`` best scores of each item among the rows it is shown."""

    def __init__(self, block: Block, n_docs: int, n_terms: int, k: int):
        self.block, self.totals, self.k = block, (n_docs, n_terms), k
        self.number, self.ends = {t: i for i, t in enumerate(block.terms)}, np.append(block.starts, len(block.slots))
        self.heaps: list[list[tuple]] = [[] for _ in block.items]

    def score(self, text: str, doc_id: int | None, row: int, items: list[int]) -> None:
        """Score one whole text for some of the items."""
        counts = Counter(terms_of(text))
        tf = np.zeros(len(self.block.terms), np.int64)
        for t in self.number.keys() & counts.keys():
            tf[self.number[t]] = counts[t]
        value = impact(tf, length_factor(np.array([sum(counts.values())]), *self.totals))
        for item in items:
            at = slice(self.ends[item], self.ends[item + 1])
            score = int((value[self.block.slots[at]] * self.block.weights[at]).sum())
            # The smaller id is the better one of equal scores; rows without an id come last.
            entry, heap = (score, doc_id is not None, -(doc_id or 0), -row), self.heaps[item]
            if score > 0 and len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif score > 0 and entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def batch(self) -> pa.RecordBatch:
        out = [(item, -e[2] if e[1] else None, -e[3], e[0]) for item, heap in enumerate(self.heaps) for e in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["item", "doc_id", "row", "score"])


SCORES = "item int, doc_id bigint, row bigint, score bigint"


def scored_rows(index: DataFrame, wanted: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, row, score, rank``: the ``k`` best of each item among the rows that ``wanted (row, doc_id, items)`` names,
    at most a fixed number for each item of the block."""
    right = F.broadcast(wanted.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), "items"))
    found = index.join(right, (index.row == F.col("_row")) & index.doc_id.eqNullSafe(F.col("_id"))).select("row", "doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block, n_docs, n_terms, k)
        for part in slices(batches, "text"):
            for row, doc_id, items, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "items", "text"))):
                best.score(text, doc_id, row, items)
        yield best.batch()

    return _ranked(found.mapInArrow(run, SCORES), k)


def scored_above(index: DataFrame, block: Block, n_docs: int, n_terms: int, least: np.ndarray, k: int) -> DataFrame:
    """``item, doc_id, row, score, rank``: the ``k`` best of each item among all rows with a bound of at least ``least`` for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block, n_docs, n_terms, k)
        for part in slices(batches, "text", 1 << 20):
            row, doc_id, text = part.column("row").to_numpy(), part.column("doc_id"), part.column("text")
            for some, bound in _bounds(block, part, n_docs, n_terms):
                hit = bound >= least
                for i in np.flatnonzero(hit.any(1)).tolist():
                    at = int(some[i])
                    best.score(text[at].as_py(), doc_id[at].as_py(), int(row[at]), np.flatnonzero(hit[i]).tolist())
        yield best.batch()

    return _ranked(index.mapInArrow(run, SCORES), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], k, "row", rank="rank")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best rows of ``docs (doc_id, text)`` for each of ``items (item_id, text)``: ``item_id, rank, doc_id, score``.

    Only scores above 0 count; equal scores are ranked by ascending ``doc_id``, rows without an id last. Rows that repeat an
    id are ranked each on its own, unless they repeat the text as well: then all of them are ranked, too. Null texts have no
    term. Items that repeat an id are one item with the terms of all of them; an item without terms has no result. Other
    columns are not read. Empty tables give an empty result.

    Items are read in blocks of ``BLOCK``, each searched over all documents; what a block's terms take is all that the driver
    and the tasks hold of them.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    results, held = [], []
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    one_id = items.select(F.col("item_id").cast("bigint"), whole().alias("text")).groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    for item in one_id.orderBy("item_id").toLocalIterator():
        held.append((item["item_id"], item["text"]))
        if len(held) == BLOCK:
            results.append(_searched(docs, index, block_of(held), n_docs, n_terms, k))
            held = []
    if held:
        results.append(_searched(docs, index, block_of(held), n_docs, n_terms, k))
    for found in results:
        empty = empty.unionByName(found)
    return empty


def _searched(docs: DataFrame, index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, item) for i, item in enumerate(block.items)], "item int, item_id bigint")
    if not block.items or not n_docs:
        return names.filter("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    block = block.weighted(document_counts(docs, block.terms), n_docs)
    first = cut(largest_bounds(index, block, n_docs, n_terms, max(k, FIRST)), "bounds")
    asked = cut(first.groupBy("row", "doc_id").agg(F.collect_set("item").alias("items")), "asked")
    scored = scored_rows(index, asked, block, n_docs, n_terms, k)
    # At most ``k`` scores of each of the block's items. An item with fewer than ``k`` is searched to the end.
    least = np.ones(len(block.items), np.int64)
    for r in scored.filter(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    final = scored_above(index, block, n_docs, n_terms, least, k)
    return cut(final.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
