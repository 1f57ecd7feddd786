"""Operator 7, quality classifier: hashed word n-grams, logistic regression by FTRL-proximal, scores as sparse dot products.

A text is cut into runs of letters, digits and non-ASCII bytes, and runs of other non-space bytes. Its features are the
hashes of runs and of pairs of neighbours (lower case), and a back-reference in place of a run that repeats the one
before it; each counts as its share of the runs. FTRL keeps per-coordinate sums and sets weights to zero below the L1
threshold. The model is a vector of 2^bits weights and a bias, which is the only thing that is broadcast (2 MB at 18 bits).

Fitting uses a bounded sample, MAX_FIT labelled documents in the order of a hash of their id; scoring covers all rows. Texts
become sparse vectors where they lie; one task then learns from these, as a stream that is sorted by epoch and order, so it
holds the weights and FIT_ROWS vectors (of at most 2^bits numbers each), however long the texts are.

Defined cases: a null or empty text has no features and scores the bias; ids without label only get a score; a document
with several labels counts with the lowest; null labels are ignored; without any label the score is 0.5 (predicted 1);
a null id is never held out; repeated rows score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import LOWER, arrow_rows, bounded_batches, documents, mix64, powers, slices, trimmed

MAX_FIT = 6000
BITS = 18
EPOCHS = 4
#: Vectors that the learning task holds at once.
FIT_ROWS = 200
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0

_SAME = np.uint64(0x5EED)
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each run of one kind, and the number of runs before each text (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams: of single runs, and of the pairs that end at each run (-1 where a text begins)."""
    hashes, bounds = token_hashes(data, offsets)
    mask = np.uint64((1 << bits) - 1)
    first = np.zeros(len(hashes), bool)
    first[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    before = np.roll(hashes, 1)
    hashes_seen = np.where(~first & (before == hashes), _SAME, hashes)
    single = (mix64(hashes_seen) & mask).astype(np.int64)
    pair = (mix64(before * np.uint64(3) + hashes_seen) & mask).astype(np.int64)
    pair[first] = -1
    return single, pair, bounds


class Model:
    """Weights of 2^bits features and a bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.bits = len(weights).bit_length() - 1

    def scores(self, column) -> np.ndarray:
        out = np.zeros(len(column))
        for at, to, data, offsets in slices(column):
            single, pair, bounds = features(data, offsets, self.bits)
            worth = self.weights[single] + np.where(pair >= 0, self.weights[pair], 0.0)
            total = np.concatenate([[0.0], np.cumsum(worth)])
            runs = np.maximum(1, np.diff(bounds))
            out[at:to] = SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / runs
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


class Ftrl:
    """FTRL-proximal over 2^bits features and a bias (the last number)."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -40, 40))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] += g * g

    def model(self) -> Model:
        w = self.weights(slice(None))
        return Model(w[:-1].copy(), float(w[-1]))


def examples(column, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sparse vector of each text: feature numbers and their shares of the runs, times SCALE; last the bias."""
    for _, _, data, offsets in slices(column):
        single, pair, bounds = features(data, offsets, bits)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.concatenate([single[a:b], pair[a:b][pair[a:b] >= 0]])
            index, count = np.unique(own, return_counts=True)
            yield np.append(index, 1 << bits), np.append(SCALE * count / max(1, b - a), 1.0)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, **rates: float) -> Model:
    """FTRL-proximal over texts in memory, in the given order."""
    rows, learner = list(examples(texts, bits)), Ftrl(bits, **rates)
    for _ in range(epochs):
        for (index, value), label in zip(rows, labels, strict=True):
            learner.learn(index, value, label)
    return learner.model()


def held_out(row_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(row_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, order, text) -> (id, label, order, features, shares)."""
    for batch in batches:
        for k, (index, value) in enumerate(examples(batch.column(3))):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([index.astype(np.int32)]), pa.array([value])], ["id", "label", "order", "features", "shares"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in the order of learning -> one row: bias, and numbers and weights of the features that have one."""
    learner = Ftrl()
    for batch in batches:
        for label, index, value in zip(batch.column("label").to_pylist(), batch.column("features"), batch.column("shares"), strict=True):
            learner.learn(np.asarray(index.values), np.asarray(value.values), label)
    model = learner.model()
    used = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([used]), pa.array([model.weights[used]])], ["bias", "at", "worth"])


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """A model from at most max_fit labelled documents that aren't held out; it is fitted in one task, of bounded size."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_fit)
    chosen = chosen.select(F.col("doc_id").alias("id"), "label", "order")
    texts = docs.select(F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("own_text"))
    rows = texts.join(F.broadcast(chosen), F.col("own_id") == F.col("id"))
    sample = rows.groupBy("id", "label", "order").agg(F.min("own_text").alias("text"))
    vectors = sample.mapInArrow(_vectors, "id long, label int, order long, features array<int>, shares array<double>")
    stream = vectors.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).repartition(1).sortWithinPartitions("epoch", "order", "id")
    with arrow_rows(docs.sparkSession, FIT_ROWS):
        found = stream.mapInArrow(_learn, "bias double, at array<long>, worth array<double>").first()
    weights = np.zeros(1 << BITS)
    if found is None:
        return Model(weights, 0.0)
    weights[np.asarray(found["at"], np.int64)] = found["worth"]
    return Model(weights, found["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double")


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with a score of at least 0.5, as they are; nothing is shuffled."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        with trimmed():
            for batch in batches:
                yield batch.filter(pa.array(own.scores(batch.column(at).fill_null("")) >= 0.5))

    return docs.mapInArrow(work, docs.schema)
