"""Exact nearest neighbours in blocks around pivots; only blocks that the triangle inequality can't rule out meet.

Every vector belongs to its nearest pivot, and a pivot's vectors are cut into rings by their distance from
it, so a block knows its pivot and its inner and outer radius. The k-th distance of each vector inside its own block
bounds what it still needs. A pair of blocks meets if their pivots and radii leave room below the
largest of these bounds, and in a meeting only vectors whose own distance from the other pivot leaves room take
part. Blocks that ask are kept in groups, and the others pass by a group once, the nearest first, so that the
bounds shrink, and what leaves a task is no more than the best of each vector. On vectors without clusters nothing is ruled out, and all blocks meet, as they must.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import checkpointed
from ledgerlens.operators.ordering import numbered
from ledgerlens.operators.pairwise import BLOCK, compact

#: Most pivots; their distances are a table of at most its square.
PIVOTS = 256
#: Room for the rounding of distances, relative to the vectors' size.
SLACK = 1e-7
#: Groups of blocks, at least where there are as many blocks; and most blocks in a group.
GROUPS, GROUP = 48, 64
#: Rows that pass by a block at once, and pairs that are measured at once.
CHUNK, PART = 512, 1 << 16


@dataclass
class Meetings:
    """`found` (i, j, d): the best of all blocks that a vector met; how many pairs of blocks met, of how many."""

    found: DataFrame
    met: int
    every: int


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def _blocks(rows: DataFrame, pivots: np.ndarray, most: int, with_self: bool, size: int) -> DataFrame:
    """(block, pivot, inner, outer, reach, data); `reach` is the largest distance that a vector of the block still needs."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = _squares(x, pivots).argmin(axis=1)
                far = np.sqrt(((x - pivots[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far)], names=["id", "vector", "pivot", "far"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, part = key
        x, ids, far = np.array(pdf["vector"].tolist()), np.array(pdf["id"].tolist()), pdf["far"].to_numpy()
        need = most if with_self else most + 1  # a vector itself is the nearest to it
        reach = np.full(len(x), np.inf)
        if len(x) >= need:
            reach = np.sqrt(np.partition(_squares(x, x), need - 1, axis=1)[:, need - 1])
        out = io.BytesIO()
        np.savez(out, ids=ids, vectors=compact(x), reach=reach, centre=pivots[pivot], ring=np.array([far.min(), far.max()]))
        return pd.DataFrame({"block": [part * len(pivots) + pivot], "pivot": [pivot], "inner": [far.min()], "outer": [far.max()], "reach": [reach.max()], "data": [out.getvalue()]})

    kind = dict(rows.dtypes)["id"]
    dealt = checkpointed(rows.mapInArrow(assign, f"id {kind}, vector array<double>, pivot bigint, far double"))
    ordered = numbered(dealt, "pivot", "far", "id")
    return ordered.groupBy("pivot", F.floor((F.col("number") - 1) / size).alias("part")).applyInPandas(pack, "block bigint, pivot bigint, inner double, outer double, reach double, data binary")


def meetings(rows: DataFrame, most: int, with_self: bool, places: int, size: int = BLOCK) -> Meetings:
    """The `most` nearest of every vector (id, vector) in each block it meets; with itself among them if `with_self`."""
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // size))).collect()
    pivots = np.array([r["vector"] for r in chosen])
    blocks = checkpointed(_blocks(rows, pivots, most, with_self, size))
    kind = dict(rows.dtypes)["id"]
    # Pivots first, of which there are few: a table of those pairs between which anything can be near enough.
    widest = {r["pivot"]: (r["outer"], r["reach"]) for r in blocks.groupBy("pivot").agg(F.max("outer").alias("outer"), F.max("reach").alias("reach")).collect()}
    size_of = float(np.abs(pivots).max(initial=1.0)) + max(outer for outer, _ in widest.values())
    slack = SLACK * size_of
    between = np.sqrt(_squares(pivots, pivots))
    near = [(p, q, float(between[p, q])) for p in widest for q in widest if between[p, q] - widest[p][0] - widest[q][0] <= widest[p][1] + slack]
    near = blocks.sparkSession.createDataFrame(near, "pivot bigint, pivot2 bigint, between double")
    one = blocks.select("block", "pivot", "inner", "outer", "reach")
    other = one.select(F.col("block").alias("block2"), F.col("pivot").alias("pivot2"), F.col("inner").alias("inner2"), F.col("outer").alias("outer2"))
    gap = F.greatest(F.col("between") - F.col("outer") - F.col("outer2"), F.col("inner") - F.col("between") - F.col("outer2"), F.col("inner2") - F.col("between") - F.col("outer"))
    pairs = checkpointed(one.join(F.broadcast(near), "pivot").join(other, "pivot2").where(gap <= F.col("reach") + slack).select("block", "block2", gap.alias("gap")))

    # Query blocks go in groups, to each of which a block comes once; the number of groups is fixed until a group has `GROUP` blocks.
    count = blocks.count()
    groups = min(count, max(GROUPS, -(-count // GROUP)))
    grouped = checkpointed(one.select("block", (F.ntile(groups).over(Window.orderBy("pivot", "block")) - 1).cast("long").alias("group")))  # a row for each block
    visits = pairs.join(F.broadcast(grouped), "block").groupBy("group", F.col("block2").alias("block")).agg(F.collect_list("block").alias("wanted"), F.min("gap").alias("gap"))
    visits = visits.join(blocks.select("block", "data"), "block").select("group", "block", "wanted", "gap", "data")
    hosts = blocks.join(F.broadcast(grouped), "block").select("group", "block", F.lit(None).cast("array<bigint>").alias("wanted"), F.lit(float("-inf")).alias("gap"), "data")
    dealt = hosts.union(visits).repartition(groups, "group").sortWithinPartitions("group", F.isnotnull("wanted"), "gap", "block")
    id_type = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                group, block, wanted = (batch.column(c)[n].as_py() for c in range(3))
                data = dict(np.load(io.BytesIO(batch.column(4)[n].as_py())))
                if group != at:
                    yield from (h.batch(id_type) for h in held.values())
                    at, held = group, {}
                if wanted is None:
                    held[block] = Host(data, most, with_self, places, slack, size_of)
                else:
                    for own in wanted:
                        held[own].meet(data)
        yield from (h.batch(id_type) for h in held.values())

    return Meetings(dealt.mapInArrow(run, f"i {kind}, j {kind}, d double"), pairs.count(), count**2)


class Host:
    """A block that other blocks pass by, with the `most` best of each row so far; what a row still needs shrinks with them."""

    def __init__(self, block: dict, most: int, with_self: bool, places: int, slack: float, size_of: float):
        self.ids, self.x, self.reach = block["ids"], block["vectors"].astype(np.float64), block["reach"].copy()
        self.most, self.with_self, self.places, self.slack, self.size_of = most, with_self, places, slack, size_of
        self.squares = (self.x * self.x).sum(axis=1)
        self.left, self.right, self.far = np.zeros(0, np.int64), self.ids[:0], np.zeros(0)

    def meet(self, b: dict) -> None:
        other = b["vectors"].astype(np.float64)
        centre = np.sqrt(((self.x - b["centre"]) ** 2).sum(axis=1))
        inner, outer = b["ring"]
        rows = np.flatnonzero(np.maximum(centre - outer, inner - centre) <= self.reach + self.slack)
        if not len(rows):
            return
        squares = (other * other).sum(axis=1)
        limits = (self.reach[rows] + self.slack) ** 2 + self.slack * self.size_of
        # Single precision sorts out most pairs where its error is small beside what is looked for.
        width = self.x.shape[1]
        size = (np.sqrt(self.squares[rows].max()) + np.sqrt(squares.max())) ** 2
        error = (width + 8) * 1.2e-7 * size
        kind = np.float32 if size < 1e30 and error < 0.05 * np.median(limits) else np.float64
        bound = limits - self.squares[rows] + (error if kind is np.float32 else (width + 8) * 2.3e-16 * size)
        many = np.vstack([other.T, squares]).astype(kind)
        found_left, found_right, found_far = [], [], []
        for start in range(0, len(rows), CHUNK):
            own = rows[start : start + CHUNK]
            close = np.hstack([-2 * self.x[own], np.ones((len(own), 1))]).astype(kind) @ many
            # The bound is rounded up, so none that it lets through is lost.
            at, some = np.divmod(np.flatnonzero(close <= np.nextafter(bound[start : start + CHUNK].astype(kind), kind(np.inf))[:, None]), len(other))
            if not self.with_self:
                fresh = b["ids"][some] != self.ids[own[at]]
                at, some = at[fresh], some[fresh]
            for part in range(0, len(at), PART):
                left, right = own[at[part : part + PART]], some[part : part + PART]
                found_left.append(left)
                found_right.append(right)
                found_far.append(np.round(np.sqrt(((other[right] - self.x[left]) ** 2).sum(axis=1)), self.places))
        if found_left:
            self._add(np.concatenate(found_left), b["ids"][np.concatenate(found_right)], np.concatenate(found_far))

    def _add(self, left: np.ndarray, right: np.ndarray, far: np.ndarray) -> None:
        left, right, far = np.concatenate([self.left, left]), np.concatenate([self.right, right]), np.concatenate([self.far, far])
        order = np.lexsort((right, far, right != self.ids[left], left))
        left = left[order]
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        rank = np.arange(len(left)) - np.repeat(starts, np.diff(np.append(starts, len(left))))
        keep = rank < self.most
        order = order[keep]
        self.left, self.right, self.far = left[keep], right[order], far[order]
        last = np.flatnonzero(rank[keep] == self.most - 1)
        self.reach[self.left[last]] = np.minimum(self.reach[self.left[last]], self.far[last] + 10.0**-self.places)

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.left], id_type), pa.array(self.right, id_type), pa.array(self.far)], names=["i", "j", "d"])
