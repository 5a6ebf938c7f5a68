"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax over the labels.

A document's features are its words, their character n-grams (a word's borders count as characters) and, as the one kind of
word pair that carries over to words never seen, a word that follows itself. They are hashed to ``BUCKETS`` learned vectors. The vectors of a document's features are averaged and mapped to the two labels; both maps are trained by
stochastic gradient descent in numpy. The training sample is bounded (``TRAINING_ROWS`` distinct texts of each label) and lies
in ``SHARDS`` parts; in each epoch every part makes its own pass from the same weights, and the results are averaged by the
rows they saw, so no task holds the sample and the driver holds weights only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.llm.common import mix, scratch, slices, texts, whole
from siftline.operators.ordered import top_k

BUCKETS, DIMENSIONS = 1 << 16, 16
#: Lengths of the character n-grams.
GRAMS = (3, 4)
#: Distinct texts of each label that the classifier learns from; all, where there are fewer.
TRAINING_ROWS = 3000
SHARDS, EPOCHS, RATE = 8, 6, 2.0
#: Scores from here on count as label 1.
THRESHOLD = 0.3
#: Characters whose features are hashed at once; a longer text is cut between words.
STRETCH = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _STEP) | np.uint64(1)


def _points(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, each between two blanks, with all white space as blanks, and the text of each point."""
    points = np.frombuffer("".join(f" {t} " for t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points <= 32) | (points == 0x85) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A)) | ((points >= 0x2028) & (points <= 0x2029)) | (points == 0x3000)
    return np.where(blank, np.uint32(32), points), np.repeat(np.arange(len(some)), [len(t) + 2 for t in some])


def _features(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature, and a place inside it."""
    wide, blank = points.astype(np.uint64), points == 32
    found, places = [], []
    edge = np.flatnonzero(np.diff(blank.astype(np.int8)))
    start, stop = edge[::2] + 1, edge[1::2] + 1  # texts begin and end with a blank
    if len(start):
        inside = np.arange(len(points)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(points)]))
        terms = np.where(blank, np.uint64(0), (wide + np.uint64(1)) * _PLACES[inside & 63])
        words = np.add.reduceat(terms, start) ^ (stop - start).astype(np.uint64)
        again = start[1:][(words[1:] == words[:-1]) & (own[start[1:]] == own[start[:-1]])]
        found += [words, np.full(len(again), 1, np.uint64)]
        places += [start, again]
    for n in GRAMS:
        last = len(points) - n + 1
        if last <= 0:
            continue
        ok = ~blank[1 : 1 + last]
        for k in range(2, n - 1):
            ok &= ~blank[k : k + last]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _STEP + wide[at + k]
        found.append(h)
        places.append(at + 1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (mix(np.concatenate(found) * _STEP) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(places)


def _stretches(text: str) -> Iterator[str]:
    """A long text in parts of about ``STRETCH`` characters, cut at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        end = next((i for i in range(at + STRETCH, len(text)) if text[i].isspace()), len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _of_texts(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of every feature, in the order of the texts; each text has one more in bucket 0."""
    with np.errstate(over="ignore"):
        held: list[int] = []
        size = 0
        for i, text in enumerate([*some, None]):
            if held and (text is None or size + len(text) > STRETCH):
                points, own = _points([some[k] for k in held])
                bucket, place = _features(points, own)
                yield np.concatenate([np.array(held), np.array(held)[own[place]]]), np.concatenate([np.zeros(len(held), np.int64), bucket])
                held, size = [], 0
            if text is None:
                return
            if len(text) <= STRETCH:
                held.append(i)
                size += len(text)
                continue
            yield np.array([i]), np.zeros(1, np.int64)
            for part in _stretches(text):
                bucket, _ = _features(*_points([part]))
                yield np.full(len(bucket), i), bucket


@dataclass(frozen=True)
class Classifier:
    """``vectors[bucket]`` and ``output[:, label]``; ``bias`` is the log odds of label 1 that learning starts from."""

    vectors: np.ndarray
    output: np.ndarray
    bias: float

    def weights(self) -> np.ndarray:
        """What a feature of each bucket adds to the log odds of label 1, before the mean is taken."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def trained_on(row: Column) -> Column:
    """Whether a document's label may be learned from."""
    return F.pmod(F.crc32(row.cast("string")), F.lit(5)) != 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``hash, label, text``: ``rows`` distinct texts of each label, those with the smallest hashes, or all where there are fewer.

    They are chosen without their texts; only a chosen text is shuffled, at most once by each task.
    """
    ids = F.col("doc_id").cast("bigint")
    known = labels.select(ids.alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & trained_on(F.col("doc_id"))).distinct()
    hashed = docs.select(ids.alias("doc_id"), whole().alias("text")).filter(trained_on(F.col("doc_id"))).withColumn("hash", F.xxhash64("text"))
    distinct = hashed.select("doc_id", "hash").join(known, "doc_id").select("hash", "label").distinct()
    chosen = top_k(distinct, ["label"], [F.asc("hash")], rows, "hash")
    # At most ``rows`` hashes of each of two labels.
    found = hashed.select("hash", "text").join(F.broadcast(chosen), "hash")
    return found.groupBy("hash", "label").agg(F.min("text").alias("text"))


def _written_features(spark: SparkSession, sampled: DataFrame) -> str:
    """A folder with a file of features for each shard: ``hash, label, buckets, shares`` of every text, ordered by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            held: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
            for own, bucket in _of_texts(texts(part)):
                order = np.argsort(own, kind="stable")
                start = np.searchsorted(own[order], np.arange(part.num_rows + 1))
                for i in np.unique(own):
                    held[i].append(bucket[order[start[i] : start[i + 1]]])
            out = []
            for each in held:
                bucket, n = np.unique(np.concatenate(each), return_counts=True)
                out.append((bucket.astype("<i4").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
            columns = [part.column("shard"), part.column("hash"), part.column("label"), *[pa.array(c, pa.binary()) for c in zip(*out)]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "hash", "label", "buckets", "shares"])

    sharded = sampled.withColumn("shard", F.pmod(F.shiftright("hash", 7), F.lit(SHARDS)).cast("int"))
    rows = sharded.select("shard", "hash", "label", "text").mapInArrow(run, "shard int, hash bigint, label int, buckets binary, shares binary")
    path = scratch(spark, "features")
    rows.repartition("shard").sortWithinPartitions("shard", "hash", "label").write.partitionBy("shard").parquet(path)
    return path


def descend(vectors: np.ndarray, output: np.ndarray, bias: float, buckets: np.ndarray, shares: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on one document, in place."""
    some = vectors[buckets]
    mean = shares @ some
    odds = mean @ output + np.array([0, bias], np.float32)
    odds = np.exp(odds - odds.max())
    slope = odds / odds.sum()
    slope[label] -= 1
    back = output @ slope
    output -= rate * np.outer(mean, slope)
    vectors[buckets] = some - rate * np.outer(shares, back)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, epochs: int = EPOCHS) -> Classifier:
    """The classifier of ``labels (doc_id, quality)`` learned from the texts of ``docs (doc_id, text)``.

    Labels that are neither 0 nor 1, and those of held-out or absent documents, are not learned. Without any label, or with
    labels of one kind only, every text gets the score that the counts of the labels give, one of each kind added.
    """
    spark = docs.sparkSession
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS, 2), np.float32)
    path = _written_features(spark, sample(docs, labels, rows))
    features = spark.read.schema("hash bigint, label int, buckets binary, shares binary, shard int").parquet(path)
    counts = {r["label"]: r["n"] for r in features.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bias = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    if len(counts) < 2:
        return Classifier(np.zeros_like(vectors), output, bias)
    shards = [r["shard"] for r in features.select("shard").distinct().orderBy("shard").collect()]
    parts = reduce(DataFrame.unionByName, [spark.read.schema(features.schema).parquet(f"{path}/shard={i}").coalesce(1) for i in shards])
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        sent = spark.sparkContext.broadcast((vectors, output))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, output = (x.copy() for x in sent.value)
            n = 0
            for batch in batches:
                for label, buckets, shares in zip(*(batch.column(c).to_pylist() for c in ("label", "buckets", "shares"))):
                    descend(vectors, output, bias, np.frombuffer(buckets, "<i4"), np.frombuffer(shares, "<f4"), label, rate)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([vectors.tobytes()]), pa.array([output.tobytes()])], ["n", "vectors", "output"])

        sums = [np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2))]
        seen = 0
        # One result at a time: ``SHARDS`` rows of fixed size.
        for r in parts.mapInArrow(run, "n bigint, vectors binary, output binary").toLocalIterator():
            seen += r["n"]
            sums[0] += r["n"] * np.frombuffer(r["vectors"], np.float32).reshape(BUCKETS, DIMENSIONS)
            sums[1] += r["n"] * np.frombuffer(r["output"], np.float32).reshape(DIMENSIONS, 2)
        sent.unpersist()
        vectors, output = ((x / seen).astype(np.float32) for x in sums)
    return Classifier(vectors, output, bias)


def scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``score``, how likely label 1 is for the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        for part in slices(batches, "text", 1 << 20):
            total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for own, bucket in _of_texts(texts(part)):
                total += np.bincount(own, weight[bucket], part.num_rows)
                n += np.bincount(own, minlength=part.num_rows)
            score = 1 / (1 + np.exp(-(bias + total / n)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], "score"])

    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*kept).alias("row"), whole().alias("text"))
    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "score")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of ``docs (doc_id, text)``: ``doc_id, held_out, score, predicted``.

    Null texts are empty; an empty text has one feature, that of a text's end. Rows that repeat an id are scored each by its
    own text, and each of them is learned with the id's labels. A null id is never held out and has no label. Other columns
    are not read. An empty table gives an empty result.
    """
    found = scores(docs.select(F.col("doc_id").cast("bigint"), "text"), train(docs, labels))
    return found.select("doc_id", F.coalesce(~trained_on(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
