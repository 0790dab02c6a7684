"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader.

A text is a sparse vector over BINS bins. Its n-grams of one and two words are hashed as they are
(lower-cased a-z) and, for words that teaching never saw, n-grams of one to three words by their form:
the classes of their characters (small, capital, digit, each mark by itself; repeats count once) and
which words of the n-gram are equal. An n-gram's value is the square root of its share among the text's
n-grams of its kind, so long and short texts weigh alike; a bin's value adds up what falls into it.

Teaching rows are labelled rows, at most MOST_LABELLED by hash of their id. They are made sparse where
they lie, then one task takes them in a fixed order, EPOCHS times, by the per-coordinate updates of
FTRL-proximal (McMahan et al. 2013): a coordinate keeps its sum of squared gradients and its shifted sum
of gradients, its weight is zero until the latter exceeds L1. The task holds these two arrays and one
batch of rows. The model is BINS single-precision weights at most; a score is the logistic of a sparse
dot product, computed where the text lies: no shuffle.

Defined results: a null, empty or wordless text has no n-grams and scores by the bias alone; rows that
repeat a labelled id teach once, by their least text, and a label given both ways counts as 0; rows whose
doc_id is null are scored, never teach and are not held out; without labels of both classes there is no
model and every score is about 0 (only label 0) or about 1 (label 1 or none); an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_rows, released, sliced, text_of, written

#: Teaching rows at most, passes over them, bins of n-grams, and the score from which a text is kept.
MOST_LABELLED, EPOCHS, BINS, THRESHOLD = 8000, 2, 1 << 20, 0.3
#: Learning rate and its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02

U = np.uint64
_rng = np.random.default_rng(20240611)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACES = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A byte's class: a small letter (with all of UTF-8 beyond ASCII), a capital, a digit, or the byte itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 97, 97, 65, 48


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of values[start:stop] for each span, whatever stands before it."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


@dataclass
class Sparse:
    """Vectors one after another: those of text k are bins[bounds[k]:bounds[k + 1]], each bin once, ascending."""

    bounds: np.ndarray
    bins: np.ndarray
    values: np.ndarray


def sparse(texts: pa.Array) -> Sparse:
    """The vectors of a batch of texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]  # a slice's texts begin within the buffer
    first = np.zeros(len(data) + 1, bool)  # where a text begins
    first[offsets] = True
    solid = ~_BLANK[data]
    begins = solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]]))[: len(data)]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(solid & (first[1:] | ~np.concatenate([solid[1:], [False]]))[: len(data)]) + 1
    if not len(starts):
        return Sparse(np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0))
    up, down = _powers(len(data))
    words = _spans(_BYTES[_LOWER[data]], starts, stops, up, down)
    # Forms: of a word's bytes only those whose class is not that of the byte before.
    kind = _CLASS[data]
    turns = begins | (solid & np.concatenate([[True], kind[1:] != kind[:-1]]))
    before = np.concatenate([[0], np.cumsum(turns)])
    forms = _spans(_BYTES[kind[turns]], before[starts], before[stops], up, down)
    text = np.searchsorted(offsets, starts, side="right") - 1
    equal = lambda k: (words[k:] == words[:-k]).astype(np.uint64)
    grams = [(text, words * _PLACES[0]), (text, forms * _PLACES[1] + U(1))]
    if len(words) > 1:
        pair = equal(1)
        grams += [(text[1:], words[:-1] * _PLACES[2] + words[1:] * _PLACES[3]), (text[1:], forms[:-1] * _PLACES[4] + forms[1:] * _PLACES[5] + pair)]
    if len(words) > 2:
        same = pair[:-1] + U(2) * pair[1:] + U(4) * equal(2)
        grams.append((text[2:], forms[:-2] * _PLACES[6] + forms[1:-1] * _PLACES[7] + forms[2:] * _PLACES[5] + same))
    keys, values = [], []
    for k, (of, gram) in enumerate(grams):
        inside = of == text[: len(of)]  # n-grams lie within a text
        of, gram = of[inside], gram[inside]
        total = np.bincount(of, minlength=n)
        key, count = np.unique((of.astype(np.int64) << 20) | (_mix(gram + U(k)) >> U(44)).astype(np.int64), return_counts=True)
        keys.append(key)
        values.append(np.sqrt(count / total[key >> 20]))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return Sparse(np.searchsorted(key >> 20, np.arange(n + 1)), key & (BINS - 1), np.bincount(at, np.concatenate(values)))


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


class Leader:
    """FTRL-proximal for a logistic loss, one example at a time; the bias is a coordinate of value 1 without penalties."""

    def __init__(self, bins: int = BINS):
        self.z, self.n, self.bias_z, self.bias_n = np.zeros(bins), np.zeros(bins), 0.0, 0.0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def bias(self) -> float:
        return -self.bias_z * ALPHA / (BETA + self.bias_n**0.5)

    def learn(self, bins: np.ndarray, values: np.ndarray, label: int) -> None:
        w, b = self.weights(bins), self.bias()
        error = float(_logistic(w @ values + b)) - label
        g, n = error * values, self.n[bins]
        more = n + g * g
        self.z[bins] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[bins] = more
        n = self.bias_n + error * error
        self.bias_z += error - (n**0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n = n


@dataclass(frozen=True)
class Model:
    """Weights of all bins, none where there is no model, and the bias."""

    weights: np.ndarray | None
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), _logistic(self.bias))
        x = sparse(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[x.bins] * x.values)])
        return _logistic(sums[x.bounds[1:]] - sums[x.bounds[:-1]] + self.bias)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(label_id, quality, place, text) of at most ``most`` teaching rows, placed by hash of the id."""
    teach = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    teach = teach.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0).groupBy("label_id").agg(F.min("quality").alias("quality"))
    place = F.xxhash64("label_id").alias("place")
    # At most ``most`` rows of three numbers: a proven bound.
    some = F.broadcast(teach.select("*", place).orderBy("place", "label_id").limit(most))
    found = docs.select("doc_id", text_of().alias("text")).join(some, F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id", "quality", "place").agg(F.min("text").alias("text"))


SPARSE = "label_id long, place long, quality int, bins binary, data binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        x = sparse(batch.column("text"))
        cut = lambda values, kind: pa.array([values[a:b].astype(kind).tobytes() for a, b in zip(x.bounds, x.bounds[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("place"), batch.column("quality"), cut(x.bins, "<u4"), cut(x.values, "<f4")], names=["label_id", "place", "quality", "bins", "data"])


MODEL = "bins binary, weights binary, bias double"


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leader, seen = Leader(), [0, 0]
    for batch in batches:
        for label, bins, data in zip(batch.column("quality").to_pylist(), batch.column("bins"), batch.column("data")):
            leader.learn(np.frombuffer(bins.as_buffer(), "<u4"), np.frombuffer(data.as_buffer(), "<f4").astype(np.float64), label)
            seen[label] += 1
    if all(seen):
        weights = leader.weights(slice(None)).astype("<f4")
        bins = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"bins": [bins.astype("<u4").tobytes()], "weights": [weights[bins].tobytes()], "bias": [leader.bias()]}, schema=pa.schema([("bins", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, epochs: int = EPOCHS) -> Model:
    """The model of the teaching rows among docs; what reaches the driver is its weights."""
    with batch_rows(docs.sparkSession, 512):
        vectors = written(labelled(docs, labels, most).mapInArrow(released(_vectors), SPARSE), "quality-vectors")
        again = vectors.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        rows = again.repartition(1).sortWithinPartitions("epoch", "place", "label_id").mapInArrow(released(_train), MODEL).collect()
    if not rows:
        share = vectors.agg(F.avg("quality")).first()[0]
        return Model(None, -35.0 if share == 0 else 35.0)
    weights = np.zeros(BINS, np.float32)
    weights[np.frombuffer(rows[0]["bins"], "<u4")] = np.frombuffer(rows[0]["weights"], "<f4")
    return Model(weights, rows[0]["bias"])


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = model.scores(batch.column("text"))
            held = [held_out(i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(released(run), SCORED)


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(model.scores(batch.column(batch.schema.names.index("text"))) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
