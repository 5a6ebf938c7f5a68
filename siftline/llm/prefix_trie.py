"""Prefix trie of rebuilt conversations, from fingerprints that compose as a monoid.

A rebuilt conversation is the head of its base conversation and the rest of its own turns. No rebuilt text is made. The
fingerprint of a sequence of turns is a pair of its length and, in four lanes, the sum of each turn's digest times a power
of the lane's base at the turn's place, modulo a prime. Two such pairs compose to that of the joined sequence: lengths add
up, and the second sum is moved by the power of the first length. So one running product over the turns of each
conversation gives every range of turns by a difference, and the fingerprint of any rebuilt prefix is a product of a base's
head and an own range.

Turns of a conversation are ordered and numbered in range partitions, so that a conversation of any length is spread over
tasks; the products of its parts are composed afterwards. Rows carry references to turns, never texts. Rebuilt prefixes with
one depth and fingerprint are a node. That equal fingerprints mean equal turns is verified: all turns of one digest are
compared with the text of the one that stands for them, and all members of a node must have one parent and one last digest.
Should a comparison fail, everything is done again with other digests and bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.llm.common import cut
from siftline.operators.ordered import running

#: Lanes are numbers modulo this prime, two of them in one column.
PRIME = (1 << 31) - 1
LANES = 4
#: Turns of the base's head that a conversation takes, at most.
HEADS = 6
#: Numbers in one row of a node's list of ends.
CHUNK = 1 << 13
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def bases(seed: int) -> list[int]:
    """The base of each lane."""
    return [int.from_bytes(hashlib.sha256(f"{seed}/{lane}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for lane in range(LANES)]


def lanes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The lanes of two columns, as rows."""
    mask = (1 << 31) - 1
    return np.stack([high >> 31, high & mask, low >> 31, low & mask])


def columns(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values[0] << 31) | values[1], (values[2] << 31) | values[3]


def powers(base: int, first: int, n: int) -> np.ndarray:
    """``base ** first`` and the ``n - 1`` powers after it, modulo the prime."""
    out = np.empty(max(n, 1), np.int64)
    out[0], done = pow(base, first, PRIME), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, PRIME) % PRIME
        done += more
    return out[:n]


def _lane(high: str, low: str, k: int) -> Column:
    c = F.col(high if k < 2 else low)
    return F.shiftright(c, 31) if k % 2 == 0 else c.bitwiseAND(F.lit(PRIME))


def _two(values: list[Column]) -> tuple[Column, Column]:
    join = lambda a, b: F.shiftleft(a.cast("bigint"), 31).bitwiseOR(b.cast("bigint"))
    return join(values[0], values[1]), join(values[2], values[3])


# --- products of original conversations -----------------------------------------------------------

PRODUCTS = "conv bigint, part int, nth bigint, d1 bigint, d2 bigint, chars bigint, b1 bigint, b2 bigint, a1 bigint, a2 bigint"


def digests(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """Two columns of lanes for a turn; whether equal ones mean equal turns is checked later."""
    both = [F.xxhash64(F.lit(2 * seed + i), role, F.lit("\n"), text) for i in range(2)]
    part = lambda h: F.shiftleft(F.pmod(F.shiftrightunsigned(h, 32), F.lit(PRIME)), 31).bitwiseOR(F.pmod(h.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(PRIME)))
    return part(both[0]), part(both[1])


def turn_table(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with empty texts and roles for null ones; rows without a conversation are left out."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")


def with_ties(turns: DataFrame) -> DataFrame:
    """``turns`` with ``tie``, role and text of rows that share their turn with others, null for all others: only texts that
    decide an order are shuffled."""
    tied = cut(turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn")), "ties")
    said = F.struct("role", "text")
    if tied.isEmpty():
        return turns.withColumn("tie", F.when(F.lit(False), said))
    same = (turns.conv == F.col("_conv")) & turns.turn.eqNullSafe(F.col("_turn"))
    return turns.join(tied, same, "left").withColumn("tie", F.when(F.col("_conv").isNotNull(), said)).drop("_conv", "_turn")


def running_products(turns: DataFrame, base: list[int]) -> DataFrame:
    """``conv, nth, d1, d2, chars, b1, b2, a1, a2``: each turn's number, digest and length, and the product of the conversation
    before and after it. ``turns`` has ``conv, turn, tie, d1, d2, chars`` and is ordered by all of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, count, held = TaskContext.get().partitionId(), None, 0, np.zeros((LANES, 1), np.int64)
        for batch in batches:
            convs = batch.column("conv").to_numpy()
            n = len(convs)
            if not n:
                continue
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            start = np.flatnonzero(np.r_[convs[0] != conv, convs[1:] != convs[:-1]])
            begin = np.zeros(n, np.int64)
            begin[start] = start
            begin = np.maximum.accumulate(begin)
            nth = np.arange(n) - begin
            goes_on = begin == 0 if convs[0] == conv else np.zeros(n, bool)
            nth[goes_on] += count
            terms = np.stack([powers(b, 0, int(nth.max()) + 1)[nth] if nth.max() < 4 * n else _far(b, nth, count, goes_on) for b in base]) * lanes(d1, d2) % PRIME
            sums = np.cumsum(terms, axis=1)
            before = sums - terms
            after = (sums - np.where(goes_on, 0, before[:, begin]) + np.where(goes_on, held, 0)) % PRIME
            before = (after - terms) % PRIME
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (convs, np.full(n, part, np.int32), nth, d1, d2, batch.column("chars").to_numpy(), *columns(before), *columns(after))],
                ["conv", "part", "nth", "d1", "d2", "chars", "b1", "b2", "a1", "a2"],
            )
            conv, count, held = convs[-1], int(nth[-1]) + 1, after[:, -1:]

    order = ["conv", "turn", "tie.role", "tie.text", "d1", "d2"]
    ordered = turns.select("conv", "turn", "tie", "d1", "d2", "chars").repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut(ordered.select("conv", "d1", "d2", "chars").mapInArrow(scan, PRODUCTS), "products")
    # A conversation that lies in several partitions: at most two of each partition, composed from their products.
    parts = local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("a1", "a2"), "nth").alias("product"))
    several = parts.withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy("conv"))).filter("_parts > 1")
    behind = several.withColumn("first", F.sum("n").over(W.partitionBy("conv").orderBy("part")) - F.col("n"))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            power = np.array([[pow(b, int(f), PRIME) for f in first] for b in base], np.int64).reshape(LANES, len(first))
            got = lanes(batch.column("a1").to_numpy(), batch.column("a2").to_numpy()) * power % PRIME
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("first"), *[pa.array(x) for x in power], *[pa.array(x) for x in got]], names)

    names = ["conv", "part", "first", *[f"p{k}" for k in range(LANES)], *[f"m{k}" for k in range(LANES)]]
    kinds = ["bigint", "int", *["bigint"] * (1 + 2 * LANES)]
    placed = behind.select("conv", "part", "first", "product.a1", "product.a2").mapInArrow(moved, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    upto = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = placed.select("conv", "part", "first", *[f"p{k}" for k in range(LANES)], *[F.pmod(F.coalesce(F.sum(f"m{k}").over(upto), F.lit(0)), F.lit(PRIME)).alias(f"c{k}") for k in range(LANES)])
    joined = local.join(carry, ["conv", "part"], "left")

    def composed(high: str, low: str) -> list[Column]:
        values = [F.pmod(F.coalesce(F.col(f"c{k}") + _lane(high, low, k) * F.col(f"p{k}"), _lane(high, low, k)), F.lit(PRIME)) for k in range(LANES)]
        return [c.alias(n) for c, n in zip(_two(values), (high, low))]

    return joined.select("conv", (F.col("nth") + F.coalesce("first", F.lit(0))).alias("nth"), "d1", "d2", "chars", *composed("b1", "b2"), *composed("a1", "a2"))


def _far(base: int, nth: np.ndarray, count: int, goes_on: np.ndarray) -> np.ndarray:
    """Powers at ``nth`` where a conversation that goes on is far ahead of what the batch holds."""
    out = powers(base, 0, len(nth))[np.where(goes_on, 0, nth)]
    out[goes_on] = powers(base, count, int(goes_on.sum()))
    return out


# --- rebuilt prefixes -----------------------------------------------------------------------------


def rebuilt(products: DataFrame, base: list[int]) -> DataFrame:
    """``conv, depth, f1, f2, p1, p2, d1, d2, chars, last``: every prefix of every rebuilt conversation but the empty one, its
    fingerprint, its parent's, the digest and length of its last turn, and whether it is the whole conversation."""
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    # Without a look at long conversations as a whole: a head is at most five rows.
    convs = products.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100})
    early = products.filter(F.col("nth") < HEADS).select(F.col("conv").alias("from"), "nth", "d1", "d2", "chars", "b1", "b2", "a1", "a2")
    heads = early.join(convs, (early["from"] == convs.base) & (early.nth < convs.h))
    taken = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("taken"), F.max_by(F.struct("a1", "a2"), "nth").alias("head"))
    skipped = early.join(convs, (early["from"] == convs.conv) & (early.nth < convs.h)).groupBy("conv").agg(F.max_by(F.struct("a1", "a2"), "nth").alias("skip"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("a1"), F.lit(0).cast("bigint").alias("a2"))
    # The product of the head, that of the own turns it replaces, and how far the rest moves to the front.
    plan = convs.join(taken, "conv", "left").join(skipped, "conv", "left").select(
        "conv", "own", "h", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("head", nothing).alias("head"), F.coalesce("skip", nothing).alias("skip")
    )
    plan = cut(plan.select("conv", "own", "h", "taken", F.col("head.a1").alias("h1"), F.col("head.a2").alias("h2"), F.col("skip.a1").alias("s1"), F.col("skip.a2").alias("s2")), "plans")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    own = products.join(plan, "conv").filter("nth >= h")
    back = [[pow(b, -k, PRIME) for k in range(HEADS)] for b in base]

    def composed(high: str, low: str) -> tuple[Column, Column]:
        values = []
        for k in range(LANES):
            rest = F.pmod(_lane(high, low, k) - _lane("s1", "s2", k), F.lit(PRIME))
            move = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in back[k]]), (F.col("h") - F.col("taken") + 1).cast("int"))
            values.append(F.pmod(_lane("h1", "h2", k) + rest * move, F.lit(PRIME)))
        return _two(values)

    f, p = composed("a1", "a2"), composed("b1", "b2")
    depth = (F.col("nth") - F.col("h") + F.col("taken") + 1).cast("bigint")
    of_own = own.select("conv", depth.alias("depth"), f[0].alias("f1"), f[1].alias("f2"), p[0].alias("p1"), p[1].alias("p2"), "d1", "d2", "chars", (depth == length).alias("last"))
    of_head = heads.select("conv", "nth", "a1", "a2", "b1", "b2", "d1", "d2", "chars").join(plan.select("conv", length.alias("length")), "conv").select(
        "conv", (F.col("nth") + 1).cast("bigint").alias("depth"), F.col("a1").alias("f1"), F.col("a2").alias("f2"), F.col("b1").alias("p1"), F.col("b2").alias("p2"), "d1", "d2", "chars",
        (F.col("nth") + 1 == F.col("length")).alias("last"),
    )
    zero = F.lit(0).cast("bigint")
    root = plan.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("p1"), zero.alias("p2"), zero.alias("d1"), zero.alias("d2"), zero.alias("chars"), (length == 0).alias("last"))
    return cut(of_own.unionByName(of_head).unionByName(root), "prefixes")


# --- verification ---------------------------------------------------------------------------------


def differing_turns(turns: DataFrame) -> DataFrame:
    """Turns (``conv, turn, role, text, d1, d2``) that differ from the stored turn that stands for their digest.

    A reference names that turn; only digests that occur more than once are looked at, and no two turns of a group are
    compared with each other.
    """
    reference = F.struct("conv", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.xxhash64("role", "text").alias("check"))
    stands = cut(turns.groupBy("d1", "d2").agg(F.min(reference).alias("ref"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2", "ref"), "references")
    named = turns.join(stands, ["d1", "d2"]).select("d1", "d2", "role", "text", reference.eqNullSafe(F.col("ref")).alias("stands"))
    # Rows that repeat a turn may stand for it as well; they must be equal, too.
    held = named.filter("stands").groupBy("d1", "d2").agg(F.min(F.struct("role", "text")).alias("held"))
    return named.join(held, ["d1", "d2"]).filter((F.col("role") != F.col("held.role")) | (F.col("text") != F.col("held.text")))


NODE = ["depth", "f1", "f2"]


def trie(conversations: DataFrame, attempts: int = 4, digest=digests) -> DataFrame:
    """A row for each node of the rebuilt ``conversations (conv_id, turn, role, text)``: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn``, null first, and rows that repeat one by role and text; each of them is a turn.
    Null roles and texts are empty. Rows without a ``conv_id`` belong to no conversation. Other columns are not read. An empty
    table has no conversation and gives no node, not even the root. ``digest`` may be any function of role, text and seed: a
    weak one costs further attempts, never a wrong node, and an error if none holds.
    """
    source = with_ties(turn_table(conversations))
    for seed in range(attempts):
        d1, d2 = digest(F.col("role"), F.col("text"), seed)
        turns = source.select("*", d1.alias("d1"), d2.alias("d2"), F.length("text").cast("bigint").alias("chars"))
        if not differing_turns(turns).isEmpty():
            continue
        base = bases(seed)
        prefixes = rebuilt(running_products(turns, base), base)
        nodes = prefixes.groupBy(*NODE).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.bool_or("last").alias("ends"),
            *[f(c).alias(f"{n}_{c}") for c in ("p1", "p2", "d1", "d2") for n, f in (("least", F.min), ("most", F.max))],
        )
        nodes = cut(nodes, "nodes")
        mixed = " OR ".join(f"least_{c} <> most_{c}" for c in ("p1", "p2", "d1", "d2"))
        if nodes.filter(mixed).isEmpty():
            return _described(prefixes, nodes.withColumnsRenamed({"least_p1": "p1", "least_p2": "p2"}))
    raise ValueError(f"no digest of {attempts} tells all turns apart")


def _described(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    inner = nodes.filter("depth > 0")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    counted = cut(counted.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children", "ends", saved.alias("saved")), "counted")
    # Below a node's depth the smallest member of a node stays the smallest: each node is told to its ancestors by that member
    # alone, which is a member of all of them.
    told = counted.groupBy("conv_id").agg(F.sum("saved").alias("told"), F.count_if(F.col("n_children") == 0).alias("leaves")).withColumnRenamed("conv_id", "conv")
    sums = prefixes.select("conv", *NODE).join(told, "conv").groupBy(*NODE).agg(F.sum("told").alias("told"), F.sum("leaves").alias("n_leaves"))
    # What that member tells of nodes above this one is no part of its subtree.
    above = running(counted.select("conv_id", *NODE, "saved"), ["conv_id"], "depth", sums={"upto": F.col("saved")}).select(*NODE, (F.col("upto") - F.col("saved")).alias("above"))
    parents = counted.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = node_ends(prefixes.filter("last"))
    joined = counted.join(parents, ["depth", "p1", "p2"], "left").join(sums, NODE).join(above, NODE).join(ends, NODE, "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"), "n_leaves",
        (F.col("told") - F.col("above")).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"),
    )


def node_ends(rows: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256``: the digest of the ascending ids in ``conv``, joined by commas.

    A digest is made in order. So that a node of very many ends is no long list anywhere, its ids are ordered and written as
    text in range partitions; one task then reads a node's text piece by piece.
    """
    keys = [*NODE, "conv"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in NODE])
            start = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            pieces = [(a, b) for x, y in zip(start, [*start[1:], batch.num_rows]) for a, b in ((i, min(i + CHUNK, y)) for i in range(x, y, CHUNK))]
            conv = batch.column("conv")
            text = [",".join(map(str, conv.slice(a, b - a).to_pylist())) for a, b in pieces]
            take = pa.array([a for a, _ in pieces])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in keys] + [pa.array(text)], [*keys, "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key == at:
                    made.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, made.hexdigest()))
                at, made = key, hashlib.sha256(ids.encode())
            yield result(out)
        if at is not None:
            yield result([(*at, made.hexdigest())])

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])

    kinds = "depth bigint, f1 bigint, f2 bigint"
    pieces = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(written, f"{kinds}, conv bigint, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*keys).mapInArrow(digested, f"{kinds}, ends_sha256 string")
