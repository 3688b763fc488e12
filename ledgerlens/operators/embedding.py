"""Embeddings of customers: principal axes, and a variational autoencoder with optional heads.

The autoencoder is a small model of a customer matrix. It is trained on all rows, by tasks that keep theirs
and exchange sums of gradients, and applied to all rows in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.exchange import Exchange
from ledgerlens.operators.graph import checkpointed


def centred(vectors: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    means = vectors.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda e: e["m"]).alias("__mean"))
    return vectors.crossJoin(F.broadcast(mean)).select(key, F.zip_with(vector, "__mean", lambda x, m: x.cast("double") - m).alias(vector))


#: Most tasks of a training, and most bytes that the first one receives in a step.
TASKS = 32
EXCHANGED = 64_000_000
#: Rows whose gradients are made at once, so that layers stay in the processor's cache, however large a batch is.
TOGETHER = 1_024


@dataclass
class Components:
    """Coordinates of all rows, loadings by row of the vector, and the share of variance each axis explains."""

    coordinates: DataFrame
    loadings: np.ndarray
    explained: list[float]


def principal_components(vectors: DataFrame, n: int = 16, key: str = "id", vector: str = "v") -> Components:
    data = centred(vectors, key, vector).withColumn("__f", array_to_vector(vector))
    model = PCA(k=n, inputCol="__f", outputCol="__c").fit(data)
    return Components(model.transform(data).select(key, vector_to_array("__c").alias(vector)), model.pc.toArray(), model.explainedVariance.toArray().tolist())


@dataclass
class Head:
    """A target predicted from the latent mean through one hidden layer: squared error, or logistic loss for 0/1 targets with a ranking part."""

    name: str
    width: int
    weight: float = 1.0
    binary: bool = False
    ranking_weight: float = 0.0


@dataclass
class Autoencoder:
    """Weights by layer, and the history of losses. Layers are ReLU but for the means, log variances and outputs."""

    sizes: tuple[int, ...]
    latent: int
    heads: tuple[Head, ...] = ()
    seed: int = 1
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    history: list[dict[str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)
        shapes = {f"e{k}": s for k, s in enumerate(zip(self.sizes, self.sizes[1:], strict=False))}
        shapes |= {"mu": (self.sizes[-1], self.latent), "lv": (self.sizes[-1], self.latent)}
        back = (self.latent, *reversed(self.sizes))
        shapes |= {f"d{k}": s for k, s in enumerate(zip(back, back[1:], strict=False))}
        for h in self.heads:
            shapes |= {f"i_{h.name}": (self.latent, self.latent), f"h_{h.name}": (self.latent, h.width)}
        for name, (a, b) in shapes.items():
            self.weights[name] = rng.standard_normal((a, b)) * np.sqrt(2 / a) * (0.1 if name == "lv" else 1)
            self.weights[f"{name}_b"] = np.zeros(b)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Latent means."""
        for k in range(len(self.sizes) - 1):
            x = np.maximum(0, x @ self.weights[f"e{k}"] + self.weights[f"e{k}_b"])
        return x @ self.weights["mu"] + self.weights["mu_b"]

    def decode(self, z: np.ndarray) -> np.ndarray:
        for k in range(len(self.sizes)):
            z = z @ self.weights[f"d{k}"] + self.weights[f"d{k}_b"]
            if k < len(self.sizes) - 1:
                z = np.maximum(0, z)
        return z

    def loss_and_gradients(self, x: np.ndarray, targets: dict[str, np.ndarray], beta: float, noise: np.ndarray, pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[dict[str, float], dict[str, np.ndarray]]:
        """Squared error of the reconstruction, beta times the divergence from the normal, and the heads' losses; means over rows."""
        w, n, grads = self.weights, len(x), {}
        hidden = [x]
        for k in range(len(self.sizes) - 1):
            hidden.append(np.maximum(0, hidden[-1] @ w[f"e{k}"] + w[f"e{k}_b"]))
        mu = hidden[-1] @ w["mu"] + w["mu_b"]
        raw = hidden[-1] @ w["lv"] + w["lv_b"]
        lv = np.clip(raw, -10, 10)
        deviation = np.exp(lv / 2)
        z = mu + deviation * noise
        steps = [z]
        for k in range(len(self.sizes)):
            out = steps[-1] @ w[f"d{k}"] + w[f"d{k}_b"]
            steps.append(np.maximum(0, out) if k < len(self.sizes) - 1 else out)
        error = steps[-1] - x
        losses = {"reconstruction": float((error**2).sum() / n), "divergence": float(-0.5 * (1 + lv - mu**2 - np.exp(lv)).sum() / n)}

        def through(name: str, inputs: np.ndarray, grad: np.ndarray) -> np.ndarray:
            grads[name] = grads.get(name, 0) + inputs.T @ grad
            grads[f"{name}_b"] = grads.get(f"{name}_b", 0) + grad.sum(axis=0)
            return grad @ w[name].T

        grad = 2 * error / n
        for k in range(len(self.sizes) - 1, -1, -1):
            grad = through(f"d{k}", steps[k], grad)
            if k:
                grad = grad * (steps[k] > 0)
        g_mu = grad + beta * mu / n
        g_lv = (grad * noise * deviation / 2 + beta * 0.5 * (np.exp(lv) - 1) / n) * (np.abs(raw) <= 10)
        total = losses["reconstruction"] + beta * losses["divergence"]
        for h in self.heads:
            inner = np.maximum(0, mu @ w[f"i_{h.name}"] + w[f"i_{h.name}_b"])
            logits = inner @ w[f"h_{h.name}"] + w[f"h_{h.name}_b"]
            y = targets[h.name]
            if h.binary:
                p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                own = float((np.logaddexp(0, logits) - y * logits).sum() / n)
                g = (p - y) / n
                if h.ranking_weight and pairs:
                    good, bad = pairs[h.name]
                    rows = np.flatnonzero(good >= 0)
                    gap = logits[rows, good[rows]] - logits[rows, bad[rows]]
                    own += h.ranking_weight * float(np.logaddexp(0, -gap).sum() / n)
                    slope = -h.ranking_weight / (1 + np.exp(np.clip(gap, -30, 30))) / n
                    np.add.at(g, (rows, good[rows]), slope)
                    np.add.at(g, (rows, bad[rows]), -slope)
            else:
                own = float(((logits - y) ** 2).sum() / n)
                g = 2 * (logits - y) / n
            losses[h.name] = own
            total += h.weight * own
            g_mu = g_mu + through(f"i_{h.name}", mu, through(f"h_{h.name}", inner, h.weight * g) * (inner > 0))
        back = through("mu", hidden[-1], g_mu) + through("lv", hidden[-1], g_lv)
        for k in range(len(self.sizes) - 2, -1, -1):
            back = through(f"e{k}", hidden[k], back * (hidden[k + 1] > 0))
        losses["total"] = total
        return losses, grads


def train_autoencoder(x: np.ndarray, latent: int = 16, hidden: Sequence[int] = (128, 64), beta: float = 1.0, warm_up: int = 10, epochs: int = 50, batch: int = 128, rate: float = 1e-3, seed: int = 1, heads: Sequence[Head] = (), targets: dict[str, np.ndarray] | None = None) -> Autoencoder:
    """Adam on shuffled batches; beta grows linearly over the first `warm_up` epochs."""
    model = Autoencoder((x.shape[1], *hidden), latent, tuple(heads), seed)
    rng = np.random.default_rng(seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        now = beta * min(1.0, (epoch + 1) / max(1, warm_up))
        order = rng.permutation(len(x))
        sums: dict[str, float] = {}
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            y = {h.name: targets[h.name][rows] for h in heads}
            pairs = {h.name: _pairs(y[h.name], rng) for h in heads if h.ranking_weight}
            losses, grads = model.loss_and_gradients(x[rows], y, now, rng.standard_normal((len(rows), latent)), pairs)
            step += 1
            _adam(model, grads, first, second, step, rate)
            for name, value in losses.items():
                sums[name] = sums.get(name, 0.0) + value * len(rows) / len(x)
        model.history.append({"epoch": epoch, "beta": now, **sums})
    return model


def _adam(model: Autoencoder, grads: dict[str, np.ndarray], first: dict[str, np.ndarray], second: dict[str, np.ndarray], step: int, rate: float) -> None:
    for name, g in grads.items():
        first[name] = 0.9 * first[name] + 0.1 * g
        second[name] = 0.999 * second[name] + 0.001 * g * g
        model.weights[name] = model.weights[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def _pairs(y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A positive and a negative column of each row, drawn; -1 where a row lacks one of them."""
    return _pairs_by(y, rng.random(y.shape))


def _pairs_by(y: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    good, bad = np.where(y > 0, draw, -1).argmax(axis=1), np.where(y > 0, -1, draw).argmax(axis=1)
    none = (y > 0).all(axis=1) | (y <= 0).all(axis=1)
    return np.where(none, -1, good), np.where(none, -1, bad)


def uniforms(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by row hash, column and salt, the same however rows are spread."""
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, width + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def normals(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    u = uniforms(hashes, 2 * width, salt)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def train_on_rows(vectors: DataFrame, latent: int = 16, hidden: Sequence[int] = (128, 64), beta: float = 1.0, warm_up: int = 10, epochs: int = 50, batches: int = 12, rate: float = 1e-3, seed: int = 1, heads: Sequence[Head] = (), targets: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, key: str = "id", vector: str = "v", tasks: int | None = None) -> Autoencoder:
    """Adam over all rows of a table; every epoch deals them into `batches` by hash, at any size of the table.

    One barrier stage does it: its tasks run side by side, read their rows once and keep them. In each step a
    task sums losses and gradients over its rows of the batch, all tasks exchange these sums, and each takes the same
    Adam step with the totals. If a task is lost, Spark runs the stage again, with the same result. What is sent in
    a step is bounded: tasks times weights, at most `EXCHANGED` bytes. `targets` makes the heads' targets
    of a matrix of rows. Barrier stages don't run with dynamic allocation of executors.
    """
    data = vectors.where(F.col(vector).isNotNull())
    data = checkpointed(data.select(F.col(vector).cast("array<double>").alias("x"), F.xxhash64(key, F.lit(seed)).alias("h")))
    head = data.first()
    if head is None:
        raise ValueError("no rows to train on")
    sizes = (len(head["x"]), *hidden)
    start = Autoencoder(sizes, latent, tuple(heads), seed)
    names, kinds = list(start.weights), ["reconstruction", "divergence", *(h.name for h in heads), "total"]
    width = 1 + len(kinds) + sum(w.size for w in start.weights.values())
    if tasks is None:
        tasks = max(1, min(TASKS, data.sparkSession.sparkContext.defaultParallelism, EXCHANGED // (width * 8)))

    def run(arrow):
        context = BarrierTaskContext.get()
        exchange = Exchange(context)
        parts = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)) for b in arrow if b.num_rows]
        x = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, sizes[0]))
        h = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, np.int64)
        model = Autoencoder(sizes, latent, tuple(heads), seed)
        first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            now = beta * min(1.0, (epoch + 1) / max(1, warm_up))
            dealt = np.floor(uniforms(h, 1, 1_000_003 + epoch)[:, 0] * batches).astype(int)
            met, seen = np.zeros(len(kinds)), 0
            for k in range(batches):
                rows = np.flatnonzero(dealt == k)
                own = np.zeros(width)
                own[0] = len(rows)
                for at in range(0, len(rows), TOGETHER):
                    few = rows[at : at + TOGETHER]
                    y = targets(x[few]) if targets else {}
                    pairs = {a.name: _pairs_by(y[a.name], uniforms(h[few], y[a.name].shape[1], 2 * step + 1)) for a in heads if a.ranking_weight}
                    losses, grads = model.loss_and_gradients(x[few], y, now, normals(h[few], latent, 2 * step), pairs)
                    own[1:] += np.concatenate([[losses[a] for a in kinds], *(np.ravel(grads[a]) for a in names)]) * len(few)
                total = exchange.total(own)
                step += 1
                if not total[0]:
                    continue
                met, seen = met + total[1 : 1 + len(kinds)], seen + int(total[0])
                flat, at, grads = total[1 + len(kinds) :] / total[0], 0, {}
                for name in names:
                    size = model.weights[name].size
                    grads[name], at = flat[at : at + size].reshape(model.weights[name].shape), at + size
                _adam(model, grads, first, second, step, rate)
            model.history.append({"epoch": epoch, "beta": now, "rows": seen, **dict(zip(kinds, (met / max(1, seen)).tolist(), strict=True))})
        exchange.close()
        if context.partitionId() == 0:
            flat = np.concatenate([np.ravel(model.weights[a]) for a in names])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([json.dumps(model.history)])], names=["weights", "history"])

    (found,) = data.repartition(tasks, "h").mapInArrow(run, "weights binary, history string", barrier=True).collect()
    flat, at = np.frombuffer(bytes(found["weights"])), 0
    for name in names:
        size = start.weights[name].size
        start.weights[name], at = flat[at : at + size].reshape(start.weights[name].shape).copy(), at + size
    start.history = json.loads(found["history"])
    return start


def recommendation_heads(names: Sequence[str], means: Sequence[float], scales: Sequence[float], largest: Sequence[float], variant: str, weight: float = 1.0, share_weight: float = 1.0, magnitude_weight: float = 1.0, ranking_weight: float = 0.2) -> tuple[tuple[Head, ...], Callable[[np.ndarray], dict[str, np.ndarray]]]:
    """Heads of a variant, and their targets from standardised rows whose components are named.

    `product_group` predicts the shares of groups, `bucketed` the shares within buckets and the buckets' sizes (each
    over its largest), `hybrid` all three, and `cross_sell` which groups are bought at all. A ValueError tells
    which features are missing.
    """
    kinds = {
        "groups": [n for n, name in enumerate(names) if name.startswith("share__")],
        "local": [n for n, name in enumerate(names) if name.startswith("bucketshare__")],
        "sizes": [n for n, name in enumerate(names) if name.startswith("bucket_")],
    }
    wanted = {"product_group": ["groups"], "bucketed": ["local", "sizes"], "hybrid": ["groups", "local", "sizes"], "cross_sell": ["groups"]}
    if variant not in wanted:
        raise ValueError(f"unknown variant {variant}")
    missing = [k for k in wanted[variant] if not kinds[k]]
    if missing:
        raise ValueError(f"{variant} needs features for {', '.join(missing)}")
    weights = {"groups": weight, "local": weight * share_weight, "sizes": weight * magnitude_weight}
    binary = variant == "cross_sell"
    heads = tuple(Head(k, len(kinds[k]), weights[k], binary, ranking_weight if binary else 0.0) for k in wanted[variant])
    means, scales, largest = (np.asarray(v, dtype=float) for v in (means, scales, largest))

    def targets(x: np.ndarray) -> dict[str, np.ndarray]:
        raw = x * scales + means
        out = {k: raw[:, kinds[k]] for k in wanted[variant]}
        if "sizes" in out:
            out["sizes"] = out["sizes"] / np.maximum(largest[kinds["sizes"]], 1e-12)
        return {k: (v > 1e-9).astype(float) for k, v in out.items()} if binary else out

    return heads, targets


def embed(vectors: DataFrame, model: Autoencoder, key: str = "id", vector: str = "v") -> DataFrame:
    """Latent means of all rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = model.encode(np.stack([np.asarray(v, dtype=np.float64) for v in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, vector])

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, `{vector}` array<double>")


def low_rank(vectors: DataFrame, rank: int, key: str = "id", vector: str = "v") -> DataFrame:
    """Rows rebuilt from their first principal axes."""
    parts = principal_components(vectors, rank, key, vector)
    axes = parts.loadings
    means = vectors.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).orderBy("p").toPandas()["m"].to_numpy()

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = np.stack([np.asarray(v) for v in b.column(1).to_pylist()]) @ axes.T + means
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, vector])

    return parts.coordinates.mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, `{vector}` array<double>")
