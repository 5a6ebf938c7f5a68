"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles gets ``BANDS * ROWS`` minima. Bands of minima give candidates; of every minimum the low
``BITS`` bits are kept and packed, and equal fields, counted by bit counts and corrected for chance collisions, estimate
the similarity of a candidate pair. Pairs that the estimate does not rule out are confirmed on the full sets. Texts with
equal sets are one class from the start, and stand as one row in everything that follows.

No bucket is expanded into all its pairs: first each text is held against the ends of its buckets and the confirmed links
are joined to components; then only members of different components in one bucket are compared, in blocks, by signatures
of more minima and one bit each, which leave few pairs to the full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import cut, mix, slices, whole
from siftline.llm.graph import components

BANDS, ROWS, BITS = 32, 5, 4
#: Minima of the finer signatures, one bit of each.
FINE = 2048
SHINGLE, PERCENT = 4, 80
#: A pair goes on to the full comparison unless its estimate is this many standard deviations below the threshold.
DEVIATIONS = 4.75
#: Members of a bucket in one block; larger buckets are compared block by block.
BLOCK = 2048

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINE_FACTORS = _RANDOM.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- sets and signatures --------------------------------------------------------------------------


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower, cut at the space and at U+0009 to U+000D."""
    return text.encode().lower().split()


def shingles(text: str, size: int = SHINGLE) -> set:
    """The full set: distinct runs of ``size`` words; all words as one if there are fewer; empty without words."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles, sorted."""
    raw = np.frombuffer(b"\n".join([t.encode().lower() for t in texts] + [b""]), np.uint8)
    ends_of_text = np.cumsum([len(t.encode()) + 1 for t in texts])
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    length = ends - starts
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    value = np.where(space, 0, (raw.astype(np.uint64) + np.uint64(1)) * POWERS[place % len(POWERS)])
    word = mix(np.add.reduceat(value, starts) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(starts, np.concatenate([[0], ends_of_text]))
    n = len(word) - size + 1
    run = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        run += word[k : k + n] * PLACES[k] if n > 0 else run
    run, out = mix(run), []
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            out.append(mix((word[a:b] * PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The minimum of each hash function: the upper half of a multiplication by its odd factor."""
    out = np.full(len(factors), 2**32 - 1, np.uint64)
    step = max(1, (1 << 18) // len(factors))
    for i in range(0, len(hashes), step):
        out = np.minimum(out, ((hashes[None, i : i + step] * factors[:, None]) >> np.uint64(32)).min(axis=1))
    return out


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Fields of the ``bits`` low bits in 64-bit words; ``low``: (n, functions)."""
    each = 64 // bits
    fields = (low & np.uint64(2**bits - 1)).reshape(len(low), -1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(fields, axis=2)


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity from packed signatures: the share of equal fields without the ``2**-bits`` that agree by chance."""
    x, shift = a ^ b, 1
    while shift < bits:  # gathers each field in its lowest bit
        x = x | (x >> np.uint64(shift))
        shift *= 2
    ones = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    share = 1 - np.bitwise_count(x & ones).sum(axis=-1, dtype=np.int64) / (a.shape[-1] * (64 // bits))
    return (share - 2.0**-bits) / (1 - 2.0**-bits)


def lowest(percent: int, functions: int = BANDS * ROWS, bits: int = BITS) -> float:
    """Estimates below this rule a pair out."""
    t = percent / 100
    agree = t + (1 - t) * 2.0**-bits
    return t - DEVIATIONS * (agree * (1 - agree) / functions) ** 0.5 / (1 - 2.0**-bits)


SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed binary"


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Set size, a 128-bit digest of the set, band keys and packed minima of every row; an empty set has no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", 1 << 20):
                sets = shingle_hashes(part.column("text").to_pylist(), size)
                low = np.array([minima(s) for s in sets])
                own = mix(low.reshape(len(sets), BANDS, ROWS) + PLACES[:ROWS])
                keys = mix((own * PLACES[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                fields = packed(low)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n), pa.array([int(mix(s).sum().astype(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(mix(s ^ FACTORS[0]).sum().astype(np.int64)) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1))), pa.array([f.tobytes() for f in fields], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(sign, SIGNATURES)


def fine_signatures(texts: DataFrame, size: int) -> DataFrame:
    """``rep, n_shingles, fine`` of rows ``rep, text``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", 1 << 20):
                sets = shingle_hashes(part.column("text").to_pylist(), size)
                fields = packed(np.array([minima(s, FINE_FACTORS) for s in sets]), 1)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array([f.tobytes() for f in fields], pa.binary())], ["rep", "n_shingles", "fine"])

    return texts.select("rep", "text").mapInArrow(sign, "rep bigint, n_shingles bigint, fine binary")


# --- pairs ----------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint64).reshape(batch.num_rows, -1)


def _may_be_as_large(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``pairs (a, b, ...)`` that are not ruled out, with their estimate ``like``."""
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("packed").alias(f"p_{s}"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = estimate(_rows(batch, "p_a"), _rows(batch, "p_b"))
                fits = _may_be_as_large(*(batch.column(c).to_numpy() for c in ("n_a", "n_b")), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.where(fits, like, -1.0))], ["a", "b", "like"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return both.mapInArrow(hold, "a bigint, b bigint, like double").filter(F.col("like") >= lowest(percent))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The distinct ``pairs (a, b)`` whose full sets are similar enough; ``texts (rep, text)``."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for part in slices(batches, "text_b"):
            a, text_a, b, text_b = (part.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b"))
            good = []
            for i in range(len(a)):
                if text_a[i] != last:
                    last, own = text_a[i], shingles(text_a[i], size)
                other = shingles(text_b[i], size)
                common = len(own & other)
                good.append(100 * common >= percent * (len(own) + len(other) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))

    second = pairs.select("a", "b").distinct().join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(hold, "a bigint, b bigint").distinct()


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members (key, rep, root, n_shingles, fine, bands, size)`` in one bucket, of different roots, not ruled out.

    A pair that shares several buckets comes from that of its first common band.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    placed = members.withColumn("_blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "root", "n_shingles", "fine", "bands")

    def compare(table: pa.RecordBatch) -> pa.RecordBatch:
        key, i, j, own, rep, root, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "rep", "root", "n_shingles"))
        sign, bands, out = _rows(table, "fine"), table.column("bands").flatten().to_numpy().reshape(-1, BANDS), []
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        last = np.repeat(np.r_[start[1:], len(key)], np.diff(np.r_[start, len(key)]))
        at = np.arange(len(key))
        for step in range(1, int((last - at).max(initial=1))):
            at = at[at + step < last[at]]
            to = at + step
            ok = (root[at] != root[to]) & ((i[at] == j[at]) | (own[at] != own[to]))
            x, y = at[ok], to[ok]
            fits = _may_be_as_large(n[x], n[y], percent)
            x, y = x[fits], y[fits]
            good = estimate(sign[x], sign[y], 1) >= lowest(percent, FINE, 1)
            good &= bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key[x]
            out.append(np.stack([np.minimum(rep[x[good]], rep[y[good]]), np.maximum(rep[x[good]], rep[y[good]])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = held.column("key").to_numpy(), held.column("i").to_numpy(), held.column("j").to_numpy()
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            full = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if full:  # the last group may go on in the next batch; a group has two blocks at most
                yield compare(held.slice(0, full).combine_chunks().to_batches()[0])
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield compare(held.combine_chunks().to_batches()[0])

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


# --- groups ---------------------------------------------------------------------------------------


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets; ``component_id`` is the smallest id
    that can be reached over links, and the document of that id is kept. Texts without words, null ones among them, are
    linked with nothing, as are rows without an id, whose component is null and which are kept. Rows that repeat an id
    count as one document with the links of all of them. Other columns are not read.
    """
    signed = cut(signatures(docs, size), "signatures")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "packed")).alias("f"))
    reps = cut(first.select("set_a", "set_b", F.col("f.doc_id").alias("rep"), "f.n_shingles", "f.bands", "f.packed"), "reps")

    # Buckets with two members at least. Counts and members read one shuffle, and are merged as they come from it.
    keyed = reps.select(F.explode("bands").alias("key"), "rep").repartition("key")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("size > 1")
    hits = cut(keyed.join(buckets.hint("merge"), "key"), "buckets")
    texts = cut(docs.select(F.col("doc_id").cast("bigint").alias("rep"), whole().alias("text")).join(hits.select("rep").distinct(), "rep", "left_semi"), "texts")

    # Against both ends of the buckets: the best candidate of each kind.
    ends = hits.select(F.col("rep").alias("b"), F.explode(F.array("low", "high")).alias("a"), (F.col("rep") > F.col("low")).alias("_")).filter("a <> b").select("a", "b").distinct()
    liked = estimated(ends, reps, percent).withColumn("below", F.col("a") < F.col("b"))
    best = liked.groupBy("b", "below").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut(confirmed(best, texts, size, percent), "links")
    roots = cut(components(links), "roots")

    # Whatever is still apart in one bucket.
    rooted = hits.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h"), F.count(F.lit(1)).alias("size")).filter("_l <> _h").select("key", "size")
    mixed_members = cut(rooted.join(mixed, "key"), "mixed")
    fine = cut(fine_signatures(texts.join(mixed_members.select("rep").distinct(), "rep", "left_semi"), size), "fine")
    members = mixed_members.join(fine.join(reps.select("rep", "bands"), "rep"), "rep")
    more = confirmed(across(members, percent), texts, size, percent)

    # Rows that repeat an id with different sets tie their classes together.
    classes = real.select("doc_id", "set_a", "set_b").join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    repeated = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    tied = classes.join(repeated.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    further = cut(more.union(tied), "further")
    # Stars stand for the links that made them; without further links they are final.
    joined = roots if further.isEmpty() else components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(further))
    final = joined.withColumnRenamed("node", "rep")
    found = classes.join(final, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component: Column = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first_of_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    kept = near_groups(docs, size, percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_kept_id")), "left_semi")
