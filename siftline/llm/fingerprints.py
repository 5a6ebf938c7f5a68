"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, the phrases into longer phrases, and so on. Where a phrase begins is decided by
deterministic coin tossing: a symbol's label is the lowest bit in which it differs from the symbol before, with that
bit's value; a few rounds of it leave labels below six, neighbours still differ, and a phrase begins at every local
maximum. A cut thus depends on a few symbols around it alone, so equal substrings are cut alike inside, wherever they
stand. A phrase's name is a hash of the names in it. The fingerprint holds the smallest hashes of the names of all phrases
from level ``LOWEST`` on, and the likeness of two fingerprints estimates the share of phrases that both texts have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import mix, slices, texts, whole

#: Levels of phrases (a phrase of level n + 1 has about three of level n), and hashes in a fingerprint.
LOWEST, HIGHEST, KEPT = 2, 5, 64
ROUNDS = 3
_PLACES = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, 64, dtype=np.uint64)


# --- parsing --------------------------------------------------------------------------------------


def _labels(symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Coin tossing: twice the lowest differing bit, plus its value in the symbol. Equal symbols must not be neighbours."""
    differ = symbols ^ before
    low = differ & (~differ + differ.dtype.type(1))
    return (np.bitwise_count(low - low.dtype.type(1)) * np.uint8(2) + ((symbols & low) != 0)).astype(np.uint8)


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each symbol; ``first`` marks the first symbol of each text. Neighbours of one text differ."""
    before = np.empty_like(symbols)
    before[1:], before[first] = symbols[:-1], ~symbols[first]
    labels = _labels(symbols, before)
    for _ in range(ROUNDS):
        before = np.empty_like(labels)
        before[1:], before[first] = labels[:-1], ~labels[first]
        labels = _labels(labels, before)
    behind = np.zeros_like(labels)
    behind[:-1] = np.where(first[1:], 0, labels[1:])
    before = np.zeros_like(labels)
    before[1:] = labels[:-1]
    last = np.append(first[1:], True)
    return first | ((labels > before) & (labels > behind) & ~last)


def levels(raw: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the phrases of each level, from the first, with the number of the text of each. Texts are not empty."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    symbols: np.ndarray = raw
    for _ in range(HIGHEST):
        # Runs of one symbol become one symbol, named by the symbol and the length.
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(symbols)))
        symbols, own = symbols[at], own[at]
        if symbols.dtype == np.uint8:
            symbols = symbols.astype(np.uint32) + ((run - 1) << 8).astype(np.uint32)
        else:
            symbols = np.where(run > 1, mix(symbols + run.astype(np.uint64)), symbols)
            # Two runs with one name side by side would break the labels: tell them apart by place.
            same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (own[1:] == own[:-1])) + 1
            symbols[same] += np.uint64(1)
        first = np.ones(len(symbols), bool)
        first[1:] = own[1:] != own[:-1]
        start = np.flatnonzero(phrase_starts(symbols, first))
        place = np.arange(len(symbols)) - np.repeat(start, np.diff(np.append(start, len(symbols))))
        own = own[start]
        symbols = mix(np.add.reduceat(mix(symbols.astype(np.uint64) + _PLACES[place & 63]), start))
        yield symbols, own


def fingerprints(batch: list[str]) -> list[np.ndarray]:
    """The smallest distinct hashes of each text's phrases, in order; none for an empty text."""
    raws = [t.encode() for t in batch]
    some = [i for i, r in enumerate(raws) if r]
    out = [np.zeros(0, np.uint32)] * len(batch)
    if not some:
        return out
    with np.errstate(over="ignore"):
        found = [x for n, x in enumerate(levels(np.frombuffer(b"".join(raws), np.uint8), np.array([len(raws[i]) for i in some])), 1) if n >= LOWEST]
    hashes = np.concatenate([(names >> np.uint64(32)) for names, _ in found])
    own = np.concatenate([o for _, o in found]).astype(np.uint64)
    both = np.unique((own << np.uint64(32)) | hashes)
    edges = np.searchsorted(both >> np.uint64(32), np.arange(len(some) + 1))
    for k, i in enumerate(some):
        out[i] = both[edges[k] : min(edges[k] + KEPT, edges[k + 1])].astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From the smallest hashes of both together: the share that is in both, as a share of the phrases of one text.

    1 for equal fingerprints, the empty ones among them, 0 without a common hash.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEPT]
    common = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    j = common.sum() / len(union)
    return float(2 * j / (1 + j))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


# --- documents and their neighbours ---------------------------------------------------------------


def in_order(docs: DataFrame) -> DataFrame:
    """``block, borrowed, doc, doc_id, text``: blocks of neighbouring ids, each with the document that follows it.

    Blocks are cut at quantiles of the ids, so that they are about even; only the cuts and the smallest id of each block,
    a few numbers for each task, go through the driver. The first document of a block is lent to the block before; that of
    the first block to the last one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("bigint")
    def block_of(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc.to_numpy(), side="right"))

    least = sorted(tuple(r) for r in rows.select("doc", block_of("doc").alias("block")).groupBy("block").agg(F.min("doc")).collect())
    lent = {doc: least[i - 1][0] for i, (_, doc) in enumerate(least)}
    firsts, to = np.array([d for _, d in least], np.int64), np.array([lent[d] for _, d in least], np.int64)

    @F.pandas_udf("array<bigint>")
    def places(doc: pd.Series) -> pd.Series:
        values = doc.to_numpy()
        own = np.searchsorted(bounds, values, side="right")
        at = np.minimum(np.searchsorted(firsts, values), max(len(firsts) - 1, 0))
        return pd.Series([[a] if f != d else [a, t] for a, d, f, t in zip(own, values, firsts[at], to[at])] if len(firsts) else [[a] for a in own])

    return rows.select("doc", "doc_id", "text", F.posexplode(places("doc")).alias("borrowed", "block"))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the beginning of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): fingerprints of the text and of its edited text, and their likeness.

    The next document is the one with the next larger id, after the last one the first; rows that repeat an id follow each
    other by their texts, and rows without an id come first. A null text is the empty text, with an empty fingerprint. A
    single document is its own next one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            """Results of all rows but the last, which only follows; borrowed rows have none."""
            text = [r[3] for r in rows]
            prints = fingerprints(text)
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]
            changed = [edited(text[i], text[i + 1]) for i in own]
            out = [
                (rows[i][2], len(text[i]), hashlib.sha256(c.encode()).hexdigest(), written(prints[i]), written(e), likeness(prints[i], e), likeness(prints[i], prints[i + 1]))
                for i, c, e in zip(own, changed, fingerprints(changed))
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: list[tuple] = []
        for part in slices(batches, "text", 1 << 20):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("block", "borrowed", "doc_id")), texts(part)))
            held += rows
            if len(held) > 1:
                yield done(held)
                held = held[-1:]

    placed = in_order(docs)
    order: list[Column | str] = ["block", "borrowed", "doc", "text"]
    return placed.repartition("block").sortWithinPartitions(*order).select("block", "borrowed", "doc_id", "text").mapInArrow(run, RESULT)
