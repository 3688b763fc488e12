"""Nearest neighbours by multi-index hashing of learned binary codes.

Rotations are learned on a sample so that the signs of rotated vectors keep the angles (iterative
quantization, from several starts). Every vector gets the code of its signs; the code is split into
substrings, each of which is indexed. Thresholds for the substrings are chosen so that two codes within the
radius are within the threshold of some substring, so probing each index that far finds every code within
the radius. Where the values to probe are more than the codes of a chunk, the codes themselves are looked
through, which finds the same. The vectors found are reranked by their exact cosine in double precision.

The index is held in chunks of about `CHUNK` vectors, and queries are asked in blocks of about `BLOCK`. Chunks
and blocks are dealt by chunk; a task holds one chunk while the blocks pass by, and gives back the best few of
each query. The radius is learned on the sample too: it holds the asked share of true neighbours there.
Queries that find fewer than k vectors within it are asked again without a radius.

The sample has at most `SAMPLE` vectors; every vector is indexed. Defined cases: vectors that are null,
zero, of another length than most (the shorter of equally common ones), or hold null or non-finite components
take no part; equal scores are ranked by the smaller id; rows that repeat an id are separate candidates except
for a query with that id; a query row that repeats id and vector is asked once, and one that repeats the id
with another vector is a query of its own; fewer than k candidates are all returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_sample, checkpointed

#: Vectors in the sample; in a chunk of the index; queries in a block.
SAMPLE, CHUNK, BLOCK = 20_000, 4_096, 512
#: Rotations, each of which gives as many bits as a vector has components; bits of a substring; and the share of
#: true neighbours that the radius must hold on the sample.
ROTATIONS, SUBSTRING_BITS, SHARE = 4, 16, 0.98


@dataclass(frozen=True)
class Coder:
    """Rotations to bits, and the radius."""

    rotation: np.ndarray
    radius: int

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """One row of 16-bit numbers, which are the substrings, for each vector of length one."""
        return np.packbits(unit @ self.rotation > 0, axis=1, bitorder="little").view("<u2")


def thresholds(radius: int, substrings: int) -> list[int]:
    """Bits for each substring, such that codes within the radius are within some substring's: with each plus one they add up to one more than the radius. -1 where none has to be probed."""
    each, more = divmod(max(0, radius - substrings + 1), substrings)
    return [each + (j < more) for j in range(substrings)] if radius >= substrings else [0] * (radius + 1) + [-1] * (substrings - radius - 1)


def learn_rotation(unit: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Iterative quantization: turn the principal axes so that signs are near to the values."""
    dims = unit.shape[1]
    bits = -(-dims // SUBSTRING_BITS) * SUBSTRING_BITS
    _, _, axes = np.linalg.svd(unit, full_matrices=False)
    axes = np.vstack([axes, np.zeros((dims - len(axes), dims))]) if len(axes) < dims else axes
    values = unit @ axes.T
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(values @ turn).T @ values)
        turn = (left @ right).T
    rotation = axes.T @ turn
    if bits > dims:  # further bits look along random directions
        rotation = np.hstack([rotation, np.random.default_rng(seed + 1).standard_normal((dims, bits - dims))])
    return rotation


def learn_coder(sample: np.ndarray, k: int, share: float = SHARE, queries: int = 200) -> Coder:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    coder = Coder(np.hstack([learn_rotation(unit, seed=seed) for seed in range(ROTATIONS)]), 0)
    codes = coder.encode(unit)
    distances = []
    for q in range(min(queries, len(unit))):
        score = unit @ unit[q]
        score[q] = -2
        best = np.argsort(-score)[: min(k, len(unit) - 1)]
        distances.append(np.bitwise_count(codes[best] ^ codes[q]).sum(axis=1))
    all_distances = np.concatenate(distances) if distances else np.zeros(0)
    radius = int(np.ceil(np.quantile(all_distances, share))) if len(all_distances) else SUBSTRING_BITS * codes.shape[1]
    return Coder(coder.rotation, radius)


@functools.lru_cache(maxsize=SUBSTRING_BITS + 1)
def flips(bits: int) -> np.ndarray:
    """All numbers of `SUBSTRING_BITS` bits with at most so many bits set."""
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class Chunk:
    """The substring indexes of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.norms = np.linalg.norm(vectors, axis=1)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius."""
        bits = thresholds(radius, len(code))
        if sum(len(flips(b)) for b in bits if b >= 0) > len(self.codes):
            return np.flatnonzero(np.bitwise_count(self.codes ^ code).sum(axis=1, dtype=np.int32) <= radius)
        parts = [self._probe(j, flips(b) ^ code[j]) for j, b in enumerate(bits) if b >= 0]
        rows = np.unique(np.concatenate(parts))
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int32) <= radius]

    def _probe(self, j: int, values: np.ndarray) -> np.ndarray:
        """Rows that have one of the values as their substring j."""
        starts = np.searchsorted(self.sorted[:, j], values, side="left")
        ends = np.searchsorted(self.sorted[:, j], values, side="right")
        met = np.flatnonzero(ends > starts).tolist()
        return np.concatenate([np.zeros(0, np.int64), *(self.order[starts[k] : ends[k], j] for k in met)])

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest within the radius, or of all vectors."""
        rows = self.within(code, radius) if radius is not None else np.arange(len(self.ids))
        rows = rows[self.ids[rows] != query_id]
        score = self.vectors[rows] @ query / (self.norms[rows] * np.linalg.norm(query))
        if len(rows) > k:  # all that are as good as the k-th
            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            rows, score = rows[near], score[near]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _blocks(rows: DataFrame, group: Column, coder: Coder) -> DataFrame:
    """(part, data): ids, vectors, keys and codes of each group, packed."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"], kind="stable")
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        codes = coder.encode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        return pd.DataFrame({"part": [key[0]], "data": [_packed(ids=pdf["id"].to_numpy(), keys=pdf["key"].to_numpy(), vectors=vectors, codes=codes)]})

    return rows.groupBy(group.alias("part")).applyInPandas(pack, "part bigint, data binary")


def _ask(index: DataFrame, queries: DataFrame, chunks: int, radius: int | None, k: int) -> DataFrame:
    """(query_id, key, id, score): the best of each chunk for each query. Every block passes by every chunk, which is read once."""

    def probe(batches):
        last, chunk = None, None
        for batch in batches:
            for number, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.load(io.BytesIO(data))
                if kind == 0:
                    last, chunk = number, Chunk(held["ids"], held["vectors"], held["codes"])
                    continue
                if number != last:
                    continue  # a chunk without vectors
                out: list[list] = [[], [], [], []]
                for query_id, key, query, code in zip(held["ids"], held["keys"], held["vectors"], held["codes"], strict=True):
                    ids, scores = chunk.nearest(query_id, query, code, radius, k)
                    for column, value in zip(out, (np.full(len(ids), query_id), np.full(len(ids), key), ids, scores), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "key", "id", "score"])

    everywhere = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "data")
    dealt = index.select("part", F.lit(0).alias("kind"), "data").union(everywhere).repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(probe, "query_id bigint, key bigint, id bigint, score double")


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, the key, score: the k nearest found for each row for which `is_query` holds."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    # Underflow can make a tiny vector's length zero, where it has no direction.
    rows = rows.where(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) > 0)
    names = f"query_id bigint, rank int, `{key}` bigint, score double"
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], names)
    rows = rows.where(F.size("vector") == common["dims"]).withColumn("key", F.xxhash64("vector"))
    sample = bounded_sample(rows, "id", SAMPLE).select("id", "vector").toPandas().sort_values("id", kind="stable")["vector"]
    coder = learn_coder(np.stack(list(sample)), k, share) if len(sample) else None
    asked = rows.where("query").dropDuplicates(["id", "vector"])
    total, n = common["count"], asked.count()
    if coder is None or not n:
        return vectors.sparkSession.createDataFrame([], names)
    chunks, blocks = -(-total * 4 // (CHUNK * 3)), -(-n * 4 // (BLOCK * 3))
    place = lambda parts, *c: F.pmod(F.xxhash64(*c), F.lit(parts))
    index = checkpointed(_blocks(rows, place(chunks, "id", F.monotonically_increasing_id()), coder))
    queries = checkpointed(_blocks(asked, place(blocks, "id", "key"), coder))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = checkpointed(best(_ask(index, queries, chunks, coder.radius, k)))
    full = found.groupBy("query_id", "key").count().where(F.col("count") >= k)
    short = asked.join(full.select(F.col("query_id").alias("id"), "key"), ["id", "key"], "left_anti")
    left = short.count()
    if left:
        blocks = -(-left * 4 // (BLOCK * 3))
        more = best(_ask(index, checkpointed(_blocks(short, place(blocks, "id", "key"), coder)), chunks, None, k))
        found = found.join(short.select(F.col("id").alias("query_id"), "key"), ["query_id", "key"], "left_anti").unionByName(more)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
