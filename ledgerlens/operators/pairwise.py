"""All vectors against all, in blocks: every block of one side passes by every block of the other as a matrix.

The number of distances is the square of the number of vectors, as nearest neighbours and silhouettes are
defined here; what is shuffled is blocks, what leaves a task is a few rows for each vector, and a task holds
two blocks.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import checkpointed

#: Vectors in a block, about.
BLOCK = 2_048
#: Groups of blocks, at least where there are as many blocks; most blocks in a group; rows and pairs measured at once.
GROUPS, GROUP, CHUNK, PART = 48, 64, 512, 1 << 16


def distances(one: np.ndarray, many: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of a vector to the rows of a matrix; NaN where the cosine of a zero vector is asked for."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - many @ one / (np.linalg.norm(many, axis=1) * np.linalg.norm(one))
    return np.sqrt(((many - one) ** 2).sum(axis=1))


def compact(x: np.ndarray) -> np.ndarray:
    """In single precision, if that is exactly the same."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if np.array_equal(small, x) else x


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, ids=np.array(pdf["id"].tolist()), tags=np.array(pdf["tag"].tolist(), dtype=np.int64), vectors=compact(np.array(pdf["vector"].tolist(), dtype=np.float64)))
        return pd.DataFrame({"part": [key[0]], "data": [out.getvalue()]})

    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).applyInPandas(pack, "part bigint, data binary")


def _read(data: bytes) -> dict[str, np.ndarray]:
    block = dict(np.load(io.BytesIO(data)))
    block["vectors"] = block["vectors"].astype(np.float64)
    return block


def all_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices as one product; what is small beside the vectors is measured again, by differences."""
    centre = a.mean(axis=0)
    left, right = a - centre, b - centre
    own, other = (left * left).sum(axis=1), (right * right).sum(axis=1)
    out = np.hstack([-2 * left, np.ones((len(a), 1)), own[:, None]]) @ np.vstack([right.T, other, np.ones(len(b))])
    small = np.flatnonzero(~(out > 1e-6 * (own.max(initial=0.0) + other.max(initial=0.0))))
    np.sqrt(np.maximum(out, 0, out=out), out=out)
    flat = out.reshape(-1)
    for start in range(0, len(small), PART):
        i, j = np.divmod(small[start : start + PART], len(b))
        flat[small[start : start + PART]] = np.sqrt(((b[j] - a[i]) ** 2).sum(axis=1))
    return out


class ClusterSums:
    """A block's sums of distances to the clusters of all blocks that passed by, for each of its labelings."""

    def __init__(self, block: dict[str, np.ndarray]):
        self.block, self.found = block, [{} for _ in range(block["tags"].shape[1])]

    def meet(self, other: dict[str, np.ndarray], same: bool) -> None:
        x, tags = self.block["vectors"], other["tags"]
        clusters = [np.unique(tags[:, n], return_inverse=True) for n in range(tags.shape[1])]
        names = np.unique(np.concatenate([self.block["ids"], other["ids"]]), return_inverse=True)[1] if same else None
        for start in range(0, len(x), CHUNK):
            d = all_distances(x[start : start + CHUNK], other["vectors"])
            # Equal ids lie in one block.
            itself = names[start : start + len(d)][:, None] == names[len(x) :] if same else None
            if same:
                d[itself] = 0.0
            finite = np.isfinite(d).all()
            for n, (values, at) in enumerate(clusters):
                flags = at[:, None] == np.arange(len(values)) if len(values) <= 64 else None
                if flags is not None and finite:
                    sums = d @ flags.astype(np.float64)
                else:
                    order = np.argsort(at, kind="stable")
                    sums = np.add.reduceat(d[:, order], np.searchsorted(at[order], np.arange(len(values))), axis=1)
                counts = np.broadcast_to(np.bincount(at, minlength=len(values)), sums.shape)
                if same:
                    row, col = np.nonzero(itself)
                    counts = counts - np.bincount(row * len(values) + at[col], minlength=sums.size).reshape(sums.shape)
                for k, c in enumerate(values.tolist()):
                    if c not in self.found[n]:
                        self.found[n][c] = np.zeros(len(x)), np.zeros(len(x), np.int64)
                    self.found[n][c][0][start : start + len(d)] += sums[:, k]
                    self.found[n][c][1][start : start + len(d)] += counts[:, k]

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = self.block["ids"]
        for n, clusters in enumerate(self.found):
            for c, (sums, counts) in clusters.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(len(some), n)), pa.array(self.block["tags"][some, n]), pa.array(np.full(len(some), c)), pa.array(sums[some]), pa.array(counts[some])], schema=schema)


def cluster_sums(rows: DataFrame) -> DataFrame:
    """(i, labeling, cluster, c, sum, n): of every row (id, tag, vector) the distances to all other rows with the label c, for each of the labels in `tag`.

    Blocks are kept in groups, and every block passes by each group once; the number of groups is fixed
    until a group has `GROUP` blocks, so what is shuffled grows as the table, and only sums leave.
    """
    parts = max(1, -(-rows.count() // BLOCK))
    blocks = checkpointed(_packed(rows, parts))
    groups = min(parts, max(GROUPS, -(-parts // GROUP)))
    schema = pa.schema([("i", pa.string()), ("labeling", pa.int64()), ("cluster", pa.int64()), ("c", pa.int64()), ("sum", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                group, kind, part = (batch.column(c)[n].as_py() for c in range(3))
                block = _read(batch.column(3)[n].as_py())
                if group != at:
                    for own in held.values():
                        yield from own.batches(schema)
                    at, held = group, {}
                if kind == 0:
                    held[part] = ClusterSums(block)
                else:
                    for name, own in held.items():
                        own.meet(block, name == part)
        for own in held.values():
            yield from own.batches(schema)

    everywhere = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), "part", "data")
    hosts = blocks.select(F.pmod("part", F.lit(groups)).alias("group"), F.lit(0).alias("kind"), "part", "data")
    dealt = hosts.union(everywhere).repartition(groups, "group").sortWithinPartitions("group", "kind", "part")
    return dealt.mapInArrow(run, "i string, labeling bigint, cluster bigint, c bigint, sum double, n bigint")


def each_against_all(rows: DataFrame, one: Callable[[object, int, np.ndarray, dict[str, np.ndarray]], list[tuple]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """`one(id, tag, vector, block)` for every row (id, tag, vector) and every block (ids, tags, vectors) of the rows: its tuples as a table."""
    parts = max(1, -(-rows.count() // BLOCK))
    blocks = checkpointed(_packed(rows, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = _read(data)
                if kind == 0:
                    last, held = part, block
                elif part == last:
                    out = [r for i, t, v in zip(block["ids"], block["tags"], block["vectors"], strict=True) for r in one(i, t, v, held)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*out, strict=True)], schema=schema)

    everywhere = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "data")
    dealt = blocks.select("part", F.lit(0).alias("kind"), "data").union(everywhere).repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(run, spark_schema)
