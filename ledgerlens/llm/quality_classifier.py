"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing: every word has a fixed sparse index vector of +1 and -1, drawn from its hash, and its
word vector is the sum of the index vectors of the words around it, over all documents. These sums are
integers, made by tasks and added up by Spark, so they do not depend on how the table is cut. Words are
told apart by a hash into `BUCKETS` rows, which bounds the table of vectors (BUCKETS x DIMENSIONS)
whatever the corpus holds; each row is then taken relative to the corpus' mean context and scaled to
length one.

A document is the mean and the spread of its words' vectors, the likeness of neighbouring words, the
share of distinct words and its length. A network with one hidden layer gives a logit from that; the logit
is divided by a temperature that is fitted on labelled documents held back from the network, so that scores
are probabilities. The network is fitted on at most `TRAIN_LIMIT` labelled documents, chosen by a hash of
the key; vectors and scores cover all documents and whole texts.

Defined cases: a null text is an empty one; a text without words has zeros for all of its numbers and is
scored like any other; very long texts are pooled in pieces of `PIECE` words; labels that are null or
neither 0 nor 1 are not learnt from, and a document labelled twice counts as good if all its labels say
so; of several rows with a labelled key one, that with the smallest numbers, is learnt from. Without labelled rows
of both kinds every score is the share of good ones (0.5 if there are none). Repeated rows score alike, an
empty table gives an empty result, and only the key and the text are read for a score.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlens.llm.common import bounded_sample, text_slices

BUCKETS = 1 << 16
DIMENSIONS = 64
#: Entries of an index vector that are not zero.
NONZERO = 4
#: How far a word's context reaches to either side.
WINDOW = 2
#: Most labelled documents that the network is fitted on; a quarter of them sets the temperature.
TRAIN_LIMIT = 30_000
HIDDEN = 32
#: Words that are taken at a time.
PIECE = 50_000
_RARE = 8

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """The buckets of the words of a piece without white space; what was learnt is forgotten at a limit, so memory is bounded."""

    def __init__(self, limit: int = 600_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        # A first letter's case is set by its place in a sentence; a word in capitals is another word.
        rest = piece[1:]
        plain = piece.lower() if rest == rest.lower() else piece
        words = (plain,) if plain.isalpha() else _WORD.findall(plain)
        found = tuple([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 12) % BUCKETS for w in words])
        if len(piece) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.array(list(itertools.chain.from_iterable(map(self.__getitem__, (text or "").split()))), np.int32)


def index_vectors() -> np.ndarray:
    """BUCKETS x DIMENSIONS: NONZERO signs in each row, a fixed draw."""
    draw = np.random.default_rng(12)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    places = draw.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, (draw.integers(0, 2, places.shape) * 2 - 1).astype(np.int8), axis=1)
    return out


def add_contexts(ids: list[np.ndarray], index: np.ndarray, sums: np.ndarray) -> None:
    """Add to each word's row of `sums` the index vectors of its neighbours within the window, text by text."""
    gap = np.full(WINDOW, BUCKETS, np.int32)
    row = np.concatenate([gap, *(x for text in ids for x in (text, gap))])
    index = np.vstack([index, np.zeros((1, DIMENSIONS), np.int8)])  # what stands between texts adds nothing
    for start in range(WINDOW, len(row) - WINDOW, PIECE):
        end = min(start + PIECE, len(row) - WINDOW)
        own = index.take(row[start - WINDOW : end + WINDOW], axis=0)
        n = end - start
        context = sum((own[WINDOW + k : WINDOW + k + n] for k in range(-WINDOW, WINDOW + 1) if k), np.zeros((n, DIMENSIONS), np.int8))
        real = np.flatnonzero(row[start:end] < BUCKETS)
        if not len(real):
            continue
        words = row[start:end][real].astype(np.uint16)
        order = np.argsort(words, kind="stable")
        words, order = words[order], real[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        counts = np.diff(np.append(first, len(words)))
        # Words that are rare here are added occurrence by occurrence, the others summed up first: one sum has a fixed cost for each component.
        for k in range(_RARE):
            some = first[(counts <= _RARE) & (counts > k)]
            sums[words[some]] += context[order[some + k]]
        often = counts > _RARE
        if often.any():
            found = np.add.reduceat(context[order[np.repeat(often, counts)]], np.concatenate([[0], np.cumsum(counts[often])[:-1]]), axis=0, dtype=np.int32)
            sums[words[first[often]]] += found


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n, d0, d1, ...): occurrences of each bucket's words, and the sums of their contexts, over all texts."""
    names = ["n", *(f"d{i}" for i in range(DIMENSIONS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), Buckets()
        sums, counts = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches, text="text"):
            ids = [buckets.of(t) for t in batch.column(0).to_pylist()]
            counts += np.bincount(np.concatenate(ids), minlength=BUCKETS)
            add_contexts(ids, index, sums)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 4096):
            rows = used[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts[rows]), *(pa.array(sums[rows, i]) for i in range(DIMENSIONS))], names=["bucket", *names])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["bucket", *names]))
    return partial.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIMENSIONS: unit vectors of the words, zeros where a bucket has none."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    found = context_sums(docs, text).toArrow()  # BUCKETS rows at most, some 35 MB
    if not found.num_rows:
        return out
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy().astype(float)
    sums = np.stack([found.column(f"d{i}").to_numpy() for i in range(DIMENSIONS)], axis=1).astype(float)
    sums -= n[:, None] * (sums.sum(axis=0) / n.sum())
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    out[bucket] = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    return out


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, likeness of neighbours, share of distinct words, log of the length."""
    if not len(ids):
        return np.zeros(2 * DIMENSIONS + 3)
    total, squares, near = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0
    for at in range(0, len(ids), PIECE):
        own = vectors.take(ids[at : at + PIECE + 1], axis=0)  # with the first word of the next piece
        near += float(np.einsum("ij,ij->", own[:-1], own[1:], dtype=float))
        own = own[:PIECE]
        total += own.sum(axis=0, dtype=float)
        squares += np.einsum("ij,ij->j", own, own, dtype=float)
    mean = total / len(ids)
    spread = np.sqrt(np.maximum(squares / len(ids) - mean * mean, 0))
    return np.concatenate([mean, spread, [near / max(1, len(ids) - 1), len(np.unique(ids)) / len(ids), np.log1p(len(ids))]])


@dataclass
class Network:
    """One hidden layer over standardised inputs; `temperature` divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Inputs far from all that was seen in training are held at its edge.
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def log_loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = logits / temperature
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, batch: int = 128, seed: int = 12) -> Network:
    """Log loss by Adam on shuffled batches, with weight decay."""
    draw = np.random.default_rng(seed)
    scale = x.std(axis=0)
    net = Network(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    z = np.clip((x - net.centre) / net.scale, -8, 8)
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps = 0
    for _ in range(epochs):
        order = draw.permutation(len(z))
        for at in range(0, len(z), batch):
            xs, ys = z[order[at : at + batch]], y[order[at : at + batch]]
            inner = xs @ weights[0] + weights[1]
            active = np.maximum(inner, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ weights[2] + weights[3][0], -40, 40)))
            slope = (p - ys) / len(xs)
            back = np.outer(slope, weights[2]) * (inner > 0)
            gradients = [xs.T @ back + decay * weights[0], back.sum(axis=0), active.T @ slope + decay * weights[2], np.array([slope.sum()])]
            steps += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= rate * (first[i] / (1 - 0.9**steps)) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray, low: float = 0.1, high: float = 20.0) -> float:
    """The temperature of least log loss, by golden section on its logarithm: the loss has one minimum in 1 / T."""
    a, b, ratio = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if log_loss(logits, y, np.exp(c)) <= log_loss(logits, y, np.exp(d)):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: list[str | None], buckets: Buckets) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        x = np.array([pooled(buckets.of(t), self.vectors) for t in texts]).reshape(len(texts), -1)
        return self.network.probabilities(x)


def document_features(docs: DataFrame, vectors: np.ndarray, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and the pooled numbers of each text, as `features`."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS x 4 bytes: 16 MB
    kept = docs.select(*keep, F.col(text).alias("text"))
    types = dict(docs.dtypes)

    def run(batches):
        buckets = Buckets()
        for batch in text_slices(batches):
            found = [pooled(buckets.of(t), sent.value) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"])

    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "features array<double>"]))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: int = TRAIN_LIMIT, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Word vectors of all documents, and a network of at most `limit` labelled ones for whose key `train` holds."""
    vectors = word_vectors(docs, text)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy(key).agg(F.min(F.col(label).cast("int")).alias("good"))
    sample = F.broadcast(bounded_sample(rows, key, limit))  # at most `limit` rows
    known = docs.select(key, F.col(text).alias("text")).join(sample, key)
    held_back = (F.pmod(F.xxhash64(key, F.lit("temperature")), F.lit(4)) == 0).alias("held_back")
    found = document_features(known, vectors, key, "good").groupBy(key, "good").agg(F.min("features").alias("features")).select("features", "good", held_back).orderBy(key).toArrow()
    if not found.num_rows:
        return QualityModel(vectors, None, 0.5)
    x = found.column("features").combine_chunks().values.to_numpy().reshape(found.num_rows, -1)
    y, aside = found.column("good").to_numpy().astype(float), found.column("held_back").to_numpy()
    if len(set(y[~aside])) < 2:
        return QualityModel(vectors, None, float(y.mean()))
    network = fit_network(x[~aside], y[~aside])
    if len(set(y[aside])) == 2:
        network.temperature = fit_temperature(network.logits(x[aside]), y[aside])
    return QualityModel(vectors, network, float(y.mean()))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, the calibrated probability of good quality) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        buckets = Buckets()
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1).to_pylist(), buckets))], names=[key, "score"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")
