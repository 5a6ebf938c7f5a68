"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to ``ORDER`` bytes counts which byte follows. A byte's probability comes
from the longest context that is known; a byte new to it costs an escape (method C, with exclusion of the bytes already
ruled out) to the next shorter one, and at last all 256 bytes are equally likely. The statistics are frozen after
training, so each tree becomes a table: the state is the longest context known to its language, and each state and byte
have a code length and a next state. The tables lie one behind the other. A text's language is the one with the shortest code for all of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.llm.common import cut, release, slices

#: Context bytes; contexts of each language; distinct texts of each language that are learned from, chosen by their hash.
ORDER, STATES, TRAINING_ROWS = 4, 8192, 400
MOST_LANGUAGES = 500
#: Texts are scored in stretches of so many bytes side by side; each begins in the state that the bytes before it lead to.
STRETCH = 256
#: Bytes of text that a task scores at once.
SLICE = 1 << 20
#: Letters A-Z count as a-z, for learning and scoring alike.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NONE = "und"


# --- training -------------------------------------------------------------------------------------


def _grams(raw: bytes, order: int) -> np.ndarray:
    """Codes of all contexts with the byte that follows: the length above, then the bytes, the last one lowest."""
    x = FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint64)
    out, code = [], np.zeros(len(x), np.uint64)
    for k in range(order + 1):
        if k >= len(x):
            break
        code = (x[: len(x) - k] << np.uint64(8 * k)) | code[1:] if k else x
        out.append(code | np.uint64(k << 56))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n``: how often each context and byte occur, over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, "text", SLICE):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).append(_grams(text.encode(), order))
            for lang, grams in by.items():
                code, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each language and hash in a task; no more of them are remembered than were chosen."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        fresh = []
        for key in zip(batch.column("lang").to_pylist(), batch.column("_hash").to_pylist()):
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def sampled(labelled: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``rows`` distinct texts of each language, or all where it has fewer: those with the smallest hash. Copies count once.

    Hashes are made distinct and chosen without their texts; a first threshold, from the counts of distinct hashes, leaves
    about twice as many to rank. Only a chosen text is shuffled, at most once by each task. The counts, a row for each
    language, are held by the driver; more than ``MOST_LANGUAGES`` are an error.
    """
    hashed = labelled.select("lang", "text", F.xxhash64("text").alias("_hash"))
    distinct = cut(hashed.select("lang", "_hash").distinct(), "hashes")
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return labelled.select("lang", "text")
    least = {r["lang"]: min(1 << 30, (1 << 30) * (2 * rows + 50) // r["n"]) for r in counts}  # of 2**30 hashes
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang"))
    place = F.pmod("_hash", F.lit(1 << 30))
    order = W.partitionBy("lang").orderBy(place, "_hash")
    chosen = distinct.filter(place < share).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).select("lang", "_hash")
    # At most ``rows`` hashes of each of ``MOST_LANGUAGES`` languages.
    found = hashed.join(F.broadcast(chosen), ["lang", "_hash"], "left_semi").select("lang", "text", "_hash")
    once = found.mapInArrow(_first_of_each, "lang string, text string, _hash bigint")
    return once.groupBy("lang", "_hash").agg(F.min("text").alias("text")).select("lang", "text")


@dataclass(frozen=True)
class Model:
    """``bits[place + symbol]``: code lengths; ``following[place + symbol]``: the next place. A state's place is where its
    ``symbols`` cells begin; ``roots`` are the places of the empty contexts, one for each language."""

    langs: list[str]
    symbol: np.ndarray
    symbols: int
    roots: np.ndarray
    bits: np.ndarray
    following: np.ndarray
    order: int

    def code_lengths(self, raw: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        flat = self.symbol.astype(np.int16)[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(raw)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[owner] + nth * STRETCH
        length = np.minimum(STRETCH, starts[owner] + sizes[owner] - at)
        order = np.argsort(-length, kind="stable")
        at, length, owner, nth = at[order], length[order], owner[order], nth[order]
        later = np.flatnonzero(nth > 0)  # the state after the bytes before; the longest context is shorter than a stretch
        active = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # stretches of more than j bytes
        out = np.zeros((len(raw), len(self.langs)))
        for lang, root in enumerate(self.roots.tolist()):
            place = np.full(len(at), root, np.int64)
            for j in range(self.order, 0, -1):
                place[later] = self.following[place[later] + flat[at[later] - j]]
            total = np.zeros(len(at))
            for j in range(int(length[0]) if len(length) else 0):
                n = active[j]
                step = place[:n] + flat[at[:n] + j]
                total[:n] += self.bits[step]
                place[:n] = self.following[step]
            out[:, lang] = np.bincount(owner, total, len(raw))
        return out


def _table(gram: np.ndarray, n: np.ndarray, symbol: np.ndarray, width: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths and next states of one language, a row for each context, by length and bytes. ``gram`` is unique."""
    contexts = np.unique(np.append(gram >> 8, 0))
    size, value = contexts >> 48, contexts & ((1 << 48) - 1)

    def find(keys: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(contexts, keys), len(contexts) - 1)
        return np.where(contexts[i] == keys, i, -1)

    shorter = np.zeros(len(contexts), np.int64)
    for k in range(1, order):
        found = find((k << 48) | (value & ((1 << 8 * k) - 1)))
        shorter = np.where((size > k) & (found >= 0), found, shorter)
    parent, last = np.where(size > 0, find(((size - 1) << 48) | (value >> 8)), -1), symbol[value & 255]
    following = np.zeros((len(contexts), width), np.int64)
    for k in range(order + 1):
        level = np.flatnonzero(size == k)
        if k:
            following[level] = following[shorter[level]]
        children = np.flatnonzero((size == k + 1) & (parent >= 0))
        following[parent[children], last[children]] = children
    table = np.zeros((len(contexts), width))
    table[find(gram >> 8), symbol[gram & 255]] = n
    # ``out``: bytes with a chance already; ``escape``: what is left for the others. The root's bytes are ruled out
    # after it, so that staying there adds nothing.
    chance, out, escape = np.zeros((len(contexts), width)), np.zeros((len(contexts), width), bool), np.ones(len(contexts))
    at = np.arange(len(contexts))
    for _ in range(order + 1):
        row = np.where(out, 0, table[at])
        total, kinds = row.sum(1), (row > 0).sum(1)
        chance += escape[:, None] * row / np.maximum(total + kinds, 1)[:, None]
        escape *= np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
        out |= row > 0
        at = shorter[at]
    chance = np.where(out, chance, (escape / np.maximum(256 - out.sum(1), 1))[:, None])
    return -np.log2(chance).astype(np.float32), following


def compiled(langs: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Model:
    """The tables of unique ``lang, gram`` with their counts. With each context of a language its shorter suffixes and
    prefixes are among them."""
    names, of = np.unique(langs, return_inverse=True)
    seen = np.unique(grams & 255)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    width, roots, bits, following, place = len(seen) + 1, [], [], [], 0
    kind = np.int32 if (len(grams) + len(names)) * width < 1 << 31 else np.int64
    for lang in range(len(names)):
        own = of == lang
        code, then = _table(grams[own], counts[own], symbol, width, order)
        roots.append(place)
        bits.append(code.reshape(-1))
        following.append((then * width + place).astype(kind).reshape(-1))
        place += code.size
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Model([str(x) for x in names], symbol[FOLD], width, np.array(roots, np.int64), flat(bits, np.float32), flat(following, np.int64), order)


def build(counts: list[tuple[str, int, int]], order: int = ORDER) -> Model:
    """:func:`compiled` of rows ``(lang, gram, n)``."""
    langs, grams, n = zip(*counts) if counts else ((), (), ())
    return compiled(np.array(langs, object), np.array(grams, np.int64), np.array(n, np.int64), order)


def train(labelled: DataFrame, order: int = ORDER, states: int = STATES, rows: int = TRAINING_ROWS) -> Model:
    """Learn from ``lang, text`` (neither null). The driver gets the ``states`` most frequent contexts of each language, at
    most 256 rows each, and nothing else; what a language keeps does not depend on the others."""
    grams = cut(gram_counts(sampled(labelled, rows), order).withColumn("context", F.expr("gram >> 8")), "grams")
    # A shorter suffix or prefix of a context is at least as frequent, and comes first at equal counts.
    order_by = W.partitionBy("lang").orderBy(F.desc("total"), F.expr("context >> 48"), "context")
    totals = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"))
    frequent = totals.withColumn("_n", F.row_number().over(order_by)).filter(F.col("_n") <= states)
    kept = grams.join(frequent.select("lang", "context"), ["lang", "context"], "left_semi").select("lang", "gram", "n").toArrow()
    return compiled(*(kept.column(c).to_numpy() for c in ("lang", "gram", "n")), order)


# --- prediction -----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scored(rows: DataFrame, model: Model, through: list[str]) -> DataFrame:
    """The columns ``through`` of ``rows`` as they are, ``lang_pred`` and ``score``, from the column ``text``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # bounded by its states and languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = sent.value
        for part in slices(batches, "text", SLICE):
            # A text without letters counts as an empty one.
            text = [t if known else "" for t, known in zip(part.column("text").to_pylist(), part.column("_letters").to_pylist())]
            names, score = [NONE] * len(text), np.zeros(len(text))
            if own.langs:
                bits = own.code_lengths([t.encode() for t in text])
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                names = [own.langs[b] if t else NONE for b, t in zip(bits.argmin(axis=1), text)]
                score = np.where([bool(t) for t in text], share, 0.0)
            yield pa.RecordBatch.from_arrays([*map(part.column, through), pa.array(names, pa.string()), pa.array(score)], [*through, "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in through)
    return rows.select("row", "text", letters).mapInArrow(predict, f"{kinds}lang_pred string, score double")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (``doc_id, text``), in one pass without a shuffle.

    ``score`` is the share of the language among all, if they were equally likely before. A text that is null or has no
    letter, and any text where no language was learned, is ``und`` with score 0. Other columns are not read.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, ["row"]).select("row.doc_id", "lang_pred", "score")


def language_model(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` with text and language that are not held out."""
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return train(usable.select(F.col("lang").cast("string"), F.col("text").cast("string")))


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs`` (``doc_id, text, lang``)."""
    return identify(docs, language_model(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns; ``und`` and scores below ``least`` go."""
    # Texts go to the Python workers and back once, beside the other columns.
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    known = _scored(rows, language_model(docs), ["row", "text"]).filter((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return known.select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])
