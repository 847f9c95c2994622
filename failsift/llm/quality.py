"""Quality classifier: random-indexing word vectors and a two-layer network.

A token is a run of letters and digits as written, or a run of other characters that are
not blank. Tokens fall into ``BUCKETS`` buckets by hash. Each bucket has a fixed sparse
ternary index vector; its context vector is the sum of the index vectors of the neighbours
of its tokens, up to two on either side, over all documents. Context vectors, centred and
of length one, are the word vectors: a table of fixed size.

A document is pooled to the mean of its word vectors, the mean absolute difference of
neighbouring vectors and its length (logarithm). A network of one hidden layer is fitted on
at most ``labelled.MAX_TRAINING_DOCUMENTS`` labelled documents by a fixed number of steps,
and its logits are divided by a temperature that suits a part of the sample kept from the
fit. Fit and scores depend on the texts alone.

Defined cases: a null text is empty; empty texts have all features 0 and get the score of
that point. Documents whose id is null count as held out. Without labels of both classes the
score is the share of label 1 in the sample, or 0.5 without labels. Every row gives a row,
repeated ones too. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.labelled import training_documents
from failsift.llm.tables import arrays, held_out, small_batches
from failsift.llm.words import token_hashes

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 60
BATCH = 128
VALIDATION = 5  # every fifth document of the sample sets the temperature
FEATURES = 2 * DIMENSIONS + 1
THRESHOLD = 0.5
_VECTOR = [f"v{i}" for i in range(DIMENSIONS)]


def buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.intp)


@cache
def index_vectors() -> np.ndarray:
    """Ternary vectors with ``NONZERO`` places, half of them 1 and half -1."""
    rng = np.random.default_rng(7)
    table = np.zeros((BUCKETS + 1, DIMENSIONS))
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    signs = np.where(np.arange(NONZERO) % 2 == 0, 1.0, -1.0)
    np.put_along_axis(table[:BUCKETS], places, np.broadcast_to(signs, places.shape), axis=1)
    return table  # the last row, all 0, stands between documents


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vector of each bucket over all documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((BUCKETS + 1, DIMENSIONS))
        gap = np.full(REACH, BUCKETS)
        for batch in batches:
            group, size = [gap], 0
            for tokens in [*token_hashes(batch.column(0).to_pylist()), None]:
                if tokens is not None:
                    group += [buckets(tokens), gap]
                    size += len(tokens)
                if group[1:] and (tokens is None or size > 1 << 17):
                    row = np.concatenate(group)
                    around = np.zeros((len(row) - 2 * REACH, DIMENSIONS))
                    for offset in range(2 * REACH + 1):
                        if offset != REACH:
                            around += index[row[offset : offset + len(around)]]
                    middle = row[REACH:-REACH]
                    for d in range(DIMENSIONS):
                        sums[:, d] += np.bincount(middle, weights=around[:, d], minlength=BUCKETS + 1)
                    group, size = [gap], 0
        used = np.flatnonzero(sums[:BUCKETS].any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *(pa.array(sums[used, d].astype(np.int64)) for d in range(DIMENSIONS))],
            ["bucket", *_VECTOR],
        )

    schema = "bucket int, " + ", ".join(f"{v} long" for v in _VECTOR)
    total = docs.select("text").mapInArrow(gather, schema).groupBy("bucket").agg(*[F.sum(v).alias(v) for v in _VECTOR])
    rows = arrays(total)
    sums = np.zeros((BUCKETS, DIMENSIONS))
    sums[rows["bucket"]] = np.stack([rows[v] for v in _VECTOR], axis=1)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    known = sums.any(axis=1)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    unit[known] -= unit[known].mean(axis=0) if known.any() else 0
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return (unit * known[:, None]).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    features = np.zeros((len(texts), FEATURES), np.float32)
    for i, tokens in enumerate(token_hashes(texts)):
        n = len(tokens)
        if n == 0:
            continue
        total, moved = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for start in range(0, n, 1 << 14):  # neighbours share one token between blocks
            block = vectors[buckets(tokens[start : start + (1 << 14) + 1])]
            total += block[: 1 << 14].sum(axis=0)
            moved += np.abs(block[1:] - block[:-1]).sum(axis=0)
        features[i, :DIMENSIONS] = total / n
        features[i, DIMENSIONS : 2 * DIMENSIONS] = moved / max(1, n - 1)
        features[i, -1] = np.log1p(n) / 10
    return features


@dataclasses.dataclass
class Network:
    """Standardised inputs, one hidden layer (tanh), one logit and its temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss with a fixed seed; then the temperature."""
    rng = np.random.default_rng(11)
    shift, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    start = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    model = Network(shift, scale, start[0], start[1], start[2], 0.0)
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    checked = np.arange(len(x)) % VALIDATION == 0 if len(x) >= 10 * VALIDATION else np.zeros(len(x), bool)
    z, t = (x[~checked] - shift) / scale, y[~checked].astype(float)
    params, first, second, step = start, [np.zeros_like(p) for p in start], [np.zeros_like(p) for p in start], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            a, b = z[order[at : at + BATCH]], t[order[at : at + BATCH]]
            hidden = np.tanh(a @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - b) / len(b)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Network(shift, scale, params[0], params[1], params[2], float(params[3][0]))
    if checked.any():
        logit, truth = model.logits(x[checked]), y[checked]
        losses = [
            (np.logaddexp(0, np.where(truth == 1, -logit, logit) / heat).mean(), heat) for heat in np.geomspace(0.25, 8, 41)
        ]
        model.temperature = float(min(losses)[1])
    return model


@dataclasses.dataclass
class Quality:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.network.scores(pool(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame) -> Quality:
    small_batches(docs.sparkSession)
    vectors = word_vectors(context_sums(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = pool(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(list(pooled), pa.list_(pa.float32()))], ["id", "label", "x"]
            )

    sample = (
        training_documents(docs, labels, "quality")
        .mapInArrow(features, "id long, label int, x array<float>")
        .dropDuplicates(["id"])
        .orderBy("id")
        .toArrow()
    )
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(float)
    return Quality(vectors, fit_network(x, sample.column("label").to_numpy().astype(int)))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted by a broadcast model with ``scores(texts)``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.value.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    given = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(apply, "doc_id long, held_out boolean, score double")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all columns."""
    return accepted(docs, train(docs, labels), lambda s: s >= THRESHOLD)


def accepted(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of ``docs`` whose score suits ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(shared.value.scores(batch.column("text").to_pylist())), pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
