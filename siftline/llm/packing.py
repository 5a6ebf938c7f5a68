"""Best-fit packing by the configuration linear program over the histogram of lengths.

Only the histogram leaves the executors: at most ``capacity`` counts. A configuration is a multiset of lengths that fits
into one sequence; the program asks for the fewest configurations, in fractions, that cover the histogram. Multiplicative
weights solve it over the configurations found so far, a knapsack dynamic program prices all others, and the two values
meet within a tolerance. The solution is rounded down, as running sums, and what is left is packed by best fit. The plan lists which ranks
of each length go to which sequences, and pieces find their place in it by length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siftline.llm.common import cut, kept, slices, texts, whole
from siftline.llm.pieces import PieceMemory

CAPACITY, END_ID = 1024, 2
#: The linear program is solved to within this share of its bound, in at most so many rounds.
TOLERANCE, ROUNDS = 0.001, 30
#: Updates of the weights in a round, and how fast they follow what is lacking or gained.
STEPS, RATE = 300, 0.3


# --- pieces ---------------------------------------------------------------------------------------


class Encoder:
    """Ids by a tokenizer file, each distinct piece encoded once. Texts that hold a special token are encoded whole.

    Pieces that begin with a space go to the tokenizer in long texts, because a call costs more than a piece; the ids of a
    piece are those that make up its bytes.
    """

    JOINED = 4096

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character stands for one byte
        self.memory = PieceMemory(self.pieces)

    def whole(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def pieces(self, batch: list[str]) -> list[bytes]:
        led = [i for i, p in enumerate(batch) if p.startswith(" ") and p[1:2].strip()]
        own = sorted(set(range(len(batch))).difference(led))
        out = dict(zip(own, self.whole([batch[i] for i in own])))
        begun = [batch[i] for i in led]
        sizes = np.fromiter(map(len, map(str.encode, begun)), np.int64, len(led))
        group = np.cumsum(sizes) // self.JOINED
        edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(led)]
        ids = self.whole(["".join(begun[a:b]) for a, b in zip(edges, edges[1:])])
        for a, b, joined in zip(edges, edges[1:], ids):
            ends = np.cumsum(self.sizes[np.frombuffer(joined, "<u4")])
            at = [0, *(np.searchsorted(ends, np.cumsum(sizes[a:b]), side="right") * 4).tolist()]
            out.update((i, joined[x:y]) for i, x, y in zip(led[a:b], at, at[1:]))
        return [out[i] for i in range(len(batch))]

    def encode(self, batch: list[str]) -> list[bytes]:
        out = self.memory.encode(["" if any(s in t for s in self.special) else t for t in batch])
        for i, text in enumerate(batch):
            if text and not out[i]:
                out[i] = self.whole([text])[0]
        return out


def encoder(path: str) -> Encoder:
    return kept((Encoder, path), lambda: Encoder(path))


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its text (null: empty) and ``end_id``. A longer one is cut into pieces of ``capacity``, the
    first of which holds the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, end = encoder(path), int(end_id).to_bytes(4, "little")
        for part in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts(part))):
                ids += end
                n, first = len(ids) // 4, (len(ids) // 4 - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + capacity if k else first
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs.doc_id.cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(run, PIECES)


# --- the linear program ---------------------------------------------------------------------------


Configuration = tuple[tuple[int, int], ...]


class Pricing:
    """The knapsack over all capacities for one set of prices."""

    def __init__(self, prices: np.ndarray, capacity: int):
        """``value[c]``: the highest total price of pieces that fit into c; ``taken[c]``: the length taken last."""
        lengths = np.flatnonzero(prices > 0)
        price, upto = prices[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        self.capacity, self.prices = capacity, prices
        self.value, self.taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for c in range(1, capacity + 1):
            self.value[c] = self.value[c - 1]
            if k := upto[c]:
                gains = self.value[c - lengths[:k]] + price[:k]
                if gains[j := gains.argmax()] > self.value[c]:
                    self.value[c], self.taken[c] = gains[j], lengths[j]

    def best_with(self, length: int) -> Configuration:
        """The configuration of the highest total price among those that hold ``length``."""
        out, c = Counter({length: 1}), self.capacity - length
        while c > 0:
            if t := int(self.taken[c]):
                out[t] += 1
            c -= t or 1
        return tuple(sorted(out.items(), reverse=True))


class Master:
    """The program restricted to the configurations found so far: multiplicities and prices under multiplicative weights."""

    def __init__(self, pool: list[Configuration], lengths: np.ndarray, demand: np.ndarray):
        entries = [(i, length, n) for i, c in enumerate(pool) for length, n in c]
        self.which, length, times = np.array(entries, np.int64).T
        self.row, self.times = np.searchsorted(lengths, length), times.astype(float)
        self.columns, self.lengths, self.demand = len(pool), lengths, demand

    def covered(self, x: np.ndarray) -> np.ndarray:
        """The share of each length's demand that multiplicities ``x`` cover."""
        return np.bincount(self.row, self.times * x[self.which], len(self.lengths)) / self.demand

    def worth(self, y: np.ndarray) -> np.ndarray:
        """The total price of each configuration."""
        return np.bincount(self.which, self.times * y[self.row], self.columns)

    def run(self, x: np.ndarray, y: np.ndarray, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Means of multiplicities and prices over ``steps`` updates.

        A price grows by a factor with the uncovered share of its length, a multiplicity with what its configuration is
        worth above the cost of one sequence. Each factor takes the newest difference twice and the one before off again,
        which keeps the two from circling.
        """
        total_x, total_y = np.zeros_like(x), np.zeros_like(y)
        lacking, gain = 1 - self.covered(x), self.worth(y) - 1
        for _ in range(steps):
            before, lacking = lacking, 1 - self.covered(x)
            y = y * np.exp(np.clip(rate * (2 * lacking - before), -0.5, 0.5))
            before, gain = gain, self.worth(y) - 1
            x = x * np.exp(np.clip(rate * (2 * gain - before), -0.5, 0.5))
            total_x += x
            total_y += y
        return total_x / steps, total_y / steps


def program(histogram: np.ndarray, capacity: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[dict[Configuration, float], float]:
    """A fractional solution of the configuration linear program, and a bound that no packing can be below.

    The program: multiplicities, at least 0, of configurations, with the smallest sum that covers each length's demand. Its
    dual: prices, at least 0, under which no configuration is worth more than 1, with the largest worth of the demand.
    The first multiplicities are those of best fit, the first prices the lengths' shares of a sequence. Each round prices by the knapsack table: prices divided by the table's highest worth are feasible for the dual and give
    a bound; for every length, the configuration of the highest worth that holds it joins the pool if it is worth 1 or
    more. The pool's program then takes ``STEPS`` updates of multiplicative weights; lengths short of their demand are
    topped up with sequences of that length alone. Rounds end when the sum is at most ``1 + tolerance`` times the bound, or
    after ``rounds``; the best solution and the best bound are returned either way.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return {}, 0.0
    demand, alone = histogram[lengths].astype(float), capacity // lengths
    singles = [((int(length), int(n)),) for length, n in zip(lengths, alone)]
    pool: dict[Configuration, float] = {c: float(n) for c, n in best_fit(histogram, capacity).items()}
    best, least, bound, y = dict(pool), sum(pool.values()), 0.0, lengths / capacity
    for turn in range(rounds + 1):
        prices = np.zeros(capacity + 1)
        prices[lengths] = y
        pricing = Pricing(prices, capacity)
        bound = max(bound, float(y @ demand / pricing.value[capacity]))
        if least <= (1 + tolerance) * bound or turn == rounds:
            break
        for length, amount in zip(lengths.tolist(), demand):
            found = pricing.best_with(length)
            if found not in pool and sum(prices[k] * n for k, n in found) > 0.999:
                pool[found] = amount * 0.001
        master, x = Master(list(pool), lengths, demand), np.array(list(pool.values()))
        x, y = master.run(np.maximum(x, 1e-6 * x.mean()), y, STEPS, RATE)
        pool = dict(zip(pool, x))
        short = np.maximum(0, 1 - master.covered(x)) * demand / alone
        if x.sum() + short.sum() < least:
            best = dict(pool)
            for single, more in zip(singles, short):
                best[single] = best.get(single, 0.0) + more
            least = sum(best.values())
    return best, bound


def best_fit(histogram: np.ndarray, capacity: int) -> Counter[Configuration]:
    """Times of configurations that take every length as often as it occurs: the largest piece opens a sequence, and the largest that still fits follows."""
    left, out = histogram.astype(np.int64).copy(), Counter()
    while len(used := np.flatnonzero(left)):
        room, found, remaining = capacity, {}, left.copy()
        while len(fits := used[(used <= room) & (remaining[used] > 0)]):
            k = int(fits[-1])
            n = min(room // k, int(remaining[k]))
            found[k], room = n, room - n * k
            remaining[k] = 0
        times = min(int(left[k]) // n for k, n in found.items())
        out[tuple(found.items())] += times
        for k, n in found.items():
            left[k] -= n * times
    return out


def solve(histogram: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> list[tuple[Configuration, int]]:
    """``[(configuration, times)]``; every length is taken as often as it occurs.

    The multiplicities of :func:`program` are rounded down as running sums, fuller configurations first, so that what is cut
    off one counts for the next; none is taken more often than is left. Best fit packs the rest. Where the histogram is so
    thin that best fit alone takes fewer sequences, that is the result.
    """
    fractional, _ = program(histogram, capacity, tolerance)
    left, out, total = histogram.astype(np.int64).copy(), Counter(), 1e-6
    for configuration, times in sorted(fractional.items(), key=lambda c: (-sum(k * n for k, n in c[0]), c[0])):
        before, total = int(total), total + times
        rounded = min(int(total) - before, *(int(left[k]) // n for k, n in configuration))
        if rounded > 0:
            out[configuration] += rounded
            for k, n in configuration:
                left[k] -= n * rounded
    out.update(best_fit(left, capacity))
    return list(min(out, best_fit(histogram, capacity), key=Counter.total).items())


def plan_of(histogram: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks of a length: rank ``first + j`` stands in sequence ``sequence + j // per`` at ``offset + j % per * length``."""
    runs, ranks, sequence = [], Counter(), 0
    for configuration, times in solve(histogram, capacity):
        offset = 0
        for length, per in configuration:
            runs.append((length, ranks[length], per, sequence, offset))
            ranks[length] += per * times
            offset += per * length
        sequence += times
    runs.sort()
    return dict(zip(("length", "first", "per", "sequence", "offset"), np.array(runs, np.int64).reshape(-1, 5).T))


# --- jobs -----------------------------------------------------------------------------------------


def ranked(pieces: DataFrame, group_rows: int = 50_000) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length. A length's rows are numbered in slots of about ``group_rows``."""
    slots = pieces.count() // group_rows + 1
    slotted = pieces.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    local = slotted.withColumn("_n", F.row_number().over(W.partitionBy("length", "_slot").orderBy("doc_id", "piece")) - 1)
    counts = slotted.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("length").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "_slot", before.alias("_before"))
    return local.join(starts, ["length", "_slot"]).withColumn("rank", F.col("_before") + F.col("_n")).drop("_slot", "_n", "_c", "_before")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all of ``docs`` (``doc_id, text``): ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty and so a document of ``end_id`` alone; a document without an id is packed like any other, and rows
    that repeat an id are documents of their own. Other columns are not read. An empty table gives no pieces.
    """
    spark: SparkSession = docs.sparkSession
    pieces = cut(token_pieces(docs, path, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    plan = plan_of(histogram, capacity)
    key = (plan["length"] << 40) + plan["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            j, per = rank - plan["first"][run], plan["per"][run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(plan["sequence"][run] + j // per), pa.array(plan["offset"][run] + j % per * length)], [*names, "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
