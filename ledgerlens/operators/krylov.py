"""Linear systems and singular vectors of matrices kept as edge tables (i, j, v).

Vectors with an entry for each node are tables; products are joins on the edges' ends, inner products are
aggregates, and the driver holds nothing but small matrices of inner products.
"""

from __future__ import annotations

import io
import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import sparse, walks
from ledgerlens.operators.lineage import checkpointed, scratch, stored
from ledgerlens.operators.ordering import numbered

#: Edges of a unit, about; a row with more of them is in none.
UNIT = 1 << 20


@dataclass
class Solution:
    """`values` (i, v), the residual's norm over the right side's, and the products that were made."""

    values: DataFrame
    residual: float
    products: int


def solve(edges: DataFrame, start: DataFrame, beta: float, tolerance: float = 1e-8, restart: int = 30, most: int = 600) -> Solution:
    """x with (I - beta A) x = b by restarted GMRES, for any beta at which the matrix has an inverse.

    Vectors are cut into pieces of whole arrays, and the edges once into units that stay as they are. Each product
    makes two exchanges of packed numbers, none of edges, and gives all inner products with the vectors so far, whose
    coefficients make up a small least-squares problem. A cycle ends where that problem's residual falls below the
    tolerance, and what is returned is the residual computed from x itself; if it is too large, the next
    cycle starts from x. A series in beta would diverge from 1 / spectral radius on.
    """
    cut = _pieces(edges, start)
    state = cut.start
    scale = np.sqrt(_dots(state)[0]) if not state.isEmpty() else 0.0
    if scale == 0.0:
        return Solution(_values(cut, state), 0.0, 0)

    def rest(b, x, q, y, moved):
        r = b - (y - beta * moved)
        return q, r, [r @ r]

    def image(b, x, q, y, moved):
        w = y - beta * moved
        return q, w, [w @ w, *(q @ w)]

    products = 0
    state = _mapped_state(state, lambda x, q, w: (x, q[:0], x))
    while True:
        state = stored(_multiplied(cut, state, rest))
        norm = float(np.sqrt(_dots(state)[0]))
        products += 1
        if norm <= tolerance * scale or products >= most:
            return Solution(_values(cut, state), norm / scale, products)
        basis = _mapped_state(state, lambda x, q, w, by=norm: (x, (w / by)[None], w / by))
        small = np.zeros((restart + 1, restart))
        for k in range(restart):
            met = stored(_multiplied(cut, basis, image))
            products += 1
            dots = _dots(met)
            h = dots[1:]
            left = float(np.sqrt(max(dots[0] - h @ h, 0.0)))
            small[: k + 1, k], small[k + 1, k] = h, left
            right = np.zeros(k + 2)
            right[0] = norm
            y, *_ = np.linalg.lstsq(small[: k + 2, : k + 1], right, rcond=None)
            estimate = np.linalg.norm(small[: k + 2, : k + 1] @ y - right)
            if estimate <= tolerance * scale / 2 or left <= 1e-14 * np.sqrt(dots[0]) or products >= most:
                break
            basis = _mapped_state(met, lambda x, q, w, h=h, left=left: (x, np.vstack([q, (w - h @ q) / left]), (w - h @ q) / left))
        state = _mapped_state(met, lambda x, q, w, step=y: (x + step @ q, q[:0], x + step @ q))


#: Nodes of a piece of a vector, and edges of a unit of a product, about.
PIECE, EDGES = 1 << 16, 1 << 20

_STATE = "piece int, b binary, x binary, q binary, w binary, dots array<double>"
_READY = "piece int, b binary, x binary, q binary, y binary"


@dataclass
class Pieces:
    """A square matrix cut for products: `nodes` (i, piece, k) tells each node's place, `start` is the state with b and no x,
    `units` (unit, piece, data) hold the edges into one piece, and `wants` (unit, piece, places) what they need of each other piece.
    """

    nodes: DataFrame
    start: DataFrame
    units: DataFrame
    wants: DataFrame


def _pieces(edges: DataFrame, start: DataFrame) -> Pieces:
    """Nodes are dealt over pieces by hash. Edges into a piece are dealt over its units by the hash of their other end, so neither a row nor a column of many edges is in one unit alone."""
    edges = edges.select("i", "j", F.col("v").cast("double").alias("v")).where("i is not null and j is not null")
    start = start.groupBy("i").agg(F.sum("v").cast("double").alias("b"))
    names = stored(edges.select("i").union(edges.select(F.col("j").alias("i"))).union(start.select("i")).distinct())
    pieces = max(1, -(-names.count() // PIECE))
    order = Window.partitionBy("piece").orderBy("i")
    nodes = stored(names.withColumn("piece", F.pmod(F.xxhash64("i"), F.lit(pieces)).cast("int")).withColumn("k", F.row_number().over(order) - 1))
    place = lambda end: nodes.select(F.col("i").alias(end), F.col("piece").alias(f"p{end}"), F.col("k").alias(f"k{end}"))
    placed = stored(edges.join(place("i"), "i").join(place("j"), "j").select("pi", "ki", "pj", "kj", "v"))
    parts = placed.groupBy("pi").agg(F.ceil(F.count(F.lit(1)) / EDGES).alias("parts"))
    unit = (F.col("pi") * F.lit(1 << 32) + F.pmod(F.xxhash64("pj", "kj"), F.col("parts"))).alias("unit")

    def pack(key, pdf):
        pi, ki, pj, kj, v = (pdf[c].to_numpy() for c in ("pi", "ki", "pj", "kj", "v"))
        order = np.lexsort([ki, kj, pj])
        ki, pj, kj, v = ki[order].astype(np.int32), pj[order], kj[order], v[order]
        starts = np.flatnonzero((np.diff(pj, prepend=-1) != 0) | (np.diff(kj, prepend=-1) != 0))
        weights = v[:1] if (v == v[0]).all() else v  # one number where all edges weigh the same
        counts = np.diff(np.append(starts, len(v))).astype(np.int32)
        data = np.array([len(ki), len(counts)], dtype=np.int64).tobytes() + ki.tobytes() + counts.tobytes() + weights.tobytes()
        others, at = np.unique(pj[starts], return_index=True)
        places = [k.astype(np.int32).tobytes() for k in np.split(kj[starts], at[1:])]
        rows = [(key[0], int(pi[0]), data, None), *((key[0], int(p), None, k) for p, k in zip(others, places, strict=True))]
        return pd.DataFrame(rows, columns=["unit", "piece", "data", "places"])

    packed = placed.join(F.broadcast(parts), "pi").select(unit, "pi", "ki", "pj", "kj", "v").groupBy("unit").applyInPandas(pack, "unit bigint, piece int, data binary, places binary")
    packed = stored(packed)
    tasks = edges.sparkSession.sparkContext.defaultParallelism * 4
    # In this order the tables stay for all products; only vectors come to them.
    units = checkpointed(packed.where("data is not null").select("unit", "piece", "data").repartition(tasks, "unit"))
    wants = checkpointed(packed.where("places is not null").select("unit", "piece", "places").repartition(tasks, "piece"))

    def begin(pdf):
        b = np.zeros(len(pdf))
        b[pdf["k"].to_numpy()] = pdf["b"].fillna(0.0).to_numpy()
        return pd.DataFrame([(pdf["piece"].iloc[0], b.tobytes(), bytes(8 * len(b)), b"", b.tobytes(), [float(b @ b)])], columns=["piece", "b", "x", "q", "w", "dots"])

    first = checkpointed(nodes.join(start, "i", "left").groupBy("piece").applyInPandas(begin, _STATE))
    return Pieces(nodes, first, units, wants)


def _mapped_state(state: DataFrame, made: Callable) -> DataFrame:
    """`made(x, q, w)` of each piece: x, the vectors so far as rows, and the vector that is multiplied next."""

    def run(batches):
        for batch in batches:
            rows = []
            for piece, b, x, q, w in zip(*(batch.column(c).to_pylist() for c in ("piece", "b", "x", "q", "w")), strict=True):
                x, w = np.frombuffer(x), np.frombuffer(w)
                x, q, y = made(x, np.frombuffer(q).reshape(-1, len(x)), w)
                rows.append((piece, b, x.tobytes(), q.tobytes(), y.tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["piece", "b", "x", "q", "y"])

    return state.mapInArrow(run, _READY)


def _multiplied(cut: Pieces, ready: DataFrame, made: Callable) -> DataFrame:
    """The state after A times y, to be stored as files: a checkpoint would carry the optimizer's size of it on, which is squared in each product: `made(b, x, q, y, A y)` of each piece gives the vectors so far, the new one, and inner products."""

    def gather(vectors, wants):
        if not len(wants):
            return pd.DataFrame({"unit": [], "piece": [], "y": []})
        y = np.frombuffer(vectors["y"].iloc[0])
        return pd.DataFrame({"unit": wants["unit"], "piece": wants["piece"], "y": [y[np.frombuffer(k, np.int32)].tobytes() for k in wants["places"]]})

    def multiply(units, values):
        raw = units["data"].iloc[0]
        n, columns = np.frombuffer(raw, np.int64, 2).tolist()
        i, counts, v = np.frombuffer(raw, np.int32, n, 16), np.frombuffer(raw, np.int32, columns, 16 + 4 * n), np.frombuffer(raw[16 + 4 * (n + columns) :])
        y = np.frombuffer(b"".join(values.sort_values("piece")["y"]))
        return pd.DataFrame([(units["piece"].iloc[0], np.bincount(i, np.repeat(y, counts) * v).tobytes())], columns=["piece", "s"])

    def finish(own, sums):
        row = own.iloc[0]
        b, x, y = (np.frombuffer(row[c]) for c in ("b", "x", "y"))
        moved = np.zeros(len(b))
        for s in sums["s"]:
            part = np.frombuffer(s)
            moved[: len(part)] += part
        q, w, dots = made(b, x, np.frombuffer(row["q"]).reshape(-1, len(b)), y, moved)
        return pd.DataFrame([(row["piece"], row["b"], row["x"], q.tobytes(), w.tobytes(), [float(d) for d in dots])], columns=["piece", "b", "x", "q", "w", "dots"])

    values = ready.select("piece", "y").groupBy("piece").cogroup(cut.wants.groupBy("piece")).applyInPandas(gather, "unit bigint, piece int, y binary")
    sums = cut.units.groupBy("unit").cogroup(values.groupBy("unit")).applyInPandas(multiply, "piece int, s binary")
    return ready.groupBy("piece").cogroup(sums.groupBy("piece")).applyInPandas(finish, _STATE)


def _dots(state: DataFrame) -> np.ndarray:
    """Inner products over all pieces."""
    width = state.select(F.max(F.size("dots"))).first()[0]
    return np.array(state.agg(*[F.sum(F.col("dots")[n]) for n in range(width)]).first(), dtype=float)


def _values(cut: Pieces, state: DataFrame) -> DataFrame:
    """(i, v): x by node."""

    def run(nodes, own):
        return pd.DataFrame({"i": nodes["i"], "v": np.frombuffer(own["x"].iloc[0])[nodes["k"].to_numpy()]})

    return cut.nodes.groupBy("piece").cogroup(state.select("piece", "x").groupBy("piece")).applyInPandas(run, f"i {dict(cut.nodes.dtypes)['i']}, v double")


@dataclass
class Factors:
    """A is about U diag(values) V^T: `left` (id, u) and `right` (id, u) hold the rows of U and V, `residuals` |A v - s u| of each axis."""

    left: DataFrame
    values: np.ndarray
    right: DataFrame
    residuals: np.ndarray


def _arrays(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as one Arrow column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


@dataclass
class Dense:
    """A tall matrix in files, with a row for each number from 0: `lines` (start, n, file, at) are its pieces."""

    lines: DataFrame
    folder: str
    width: int

    def files(self) -> list[str]:
        return sorted(self.lines.inputFiles())


LINES = "start bigint, n bigint, file string, at bigint, triangle array<double>"


class DenseWriter:
    """The file of one task."""

    def __init__(self, folder: str):
        self.folder, self.file, self.at, self.out = folder, uuid.uuid4().hex, 0, None

    def put(self, start: int, rows: np.ndarray) -> pa.RecordBatch:
        if self.out is None:
            system, path = fs.FileSystem.from_uri(self.folder)
            system.create_dir(path)
            self.out = system.open_output_stream(f"{path}/{self.file}")
        self.out.write(np.ascontiguousarray(rows, np.float64))
        self.at += len(rows)
        return _line(start, len(rows), self.file, self.at - len(rows), None)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _line(*values) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["start", "n", "file", "at", "triangle"])


class DenseRows:
    """The rows as a task sees them, mapped into memory where the folder is a local one."""

    def __init__(self, folder: str, files: list[str], width: int):
        lines = sparse.names_of(files, ("start", "n", "file", "at")).filter(pc.is_valid(pc.field("file")))
        order = np.argsort(lines.column("start").to_numpy())
        self.start, self.at = lines.column("start").to_numpy()[order], lines.column("at").to_numpy()[order]
        names = lines.column("file").to_pylist()
        self.names, self.folder, self.width, self.held = [names[n] for n in order], folder, width, {}

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Of numbers in order."""
        out = np.empty((len(keys), self.width))
        line = np.searchsorted(self.start, keys, "right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(keys) else []
        for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            n = int(line[start])
            name = self.names[n]
            if name not in self.held:
                system, path = fs.FileSystem.from_uri(self.folder)
                own = np.memmap(f"{path}/{name}", np.float64, "r") if isinstance(system, fs.LocalFileSystem) else np.frombuffer(system.open_input_file(f"{path}/{name}").read())
                self.held[name] = own.reshape(-1, self.width)
            out[start:end] = self.held[name][keys[start:end] - self.start[n] + self.at[n]]
        return out


def _as_dense(rows: DataFrame, width: int) -> Dense:
    """The rows (number, u), one for each number from 0."""
    folder = scratch(rows.sparkSession, "dense")

    def run(batches):
        out = DenseWriter(folder)
        for b in batches:
            if b.num_rows:
                yield out.put(b.column(0)[0].as_py(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        out.close()

    ordered = rows.select("number", "u").repartitionByRange("number").sortWithinPartitions("number")
    return Dense(stored(ordered.mapInArrow(run, LINES)), folder, width)


def _product(matrix: sparse.Kept, rows: int, edges: int, right: Dense, by: np.ndarray, unit: int) -> tuple[Dense, np.ndarray]:
    """A right, times a small matrix, and the triangle of its QR factorisation: each task has some rows and factors them, the driver the triangles of the tasks."""
    spark, folder = right.lines.sparkSession, scratch(right.lines.sparkSession, "dense")
    kept, files = matrix.folder, matrix.index_files()
    right_folder, right_files, width, wide = right.folder, right.files(), right.width, by.shape[1]
    together = int(max(1, min(1 << 16, unit * rows // max(1, edges) // 4)))

    def run(batches):
        a, x, out = sparse.Rows.of(kept, files), DenseRows(right_folder, right_files, width), DenseWriter(folder)
        r = np.zeros((0, wide))
        for batch in batches:
            for start in batch.column(0).to_numpy():
                keys = np.arange(start, min(start + together, rows))
                ends, cols, vals = a.rows(keys)
                local = np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0))
                made = np.zeros((len(keys), width))
                for at in range(0, len(cols), 1 << 18):
                    some = slice(at, at + (1 << 18))
                    names, place = np.unique(cols[some], return_inverse=True)
                    walks.Piece(place, local[some], vals[some]).add(x.rows(names), made)
                made = made @ by
                r = np.linalg.qr(np.vstack([r, made]), mode="r")
                yield out.put(int(start), made)
        out.close()
        if len(r):
            yield _line(None, None, None, None, r.ravel())

    starts = spark.range(0, rows, together)
    table = stored(sparse.in_tasks(starts, -(-rows // together), 1 << 20, "id").mapInArrow(run, LINES))
    # A triangle for each task.
    found = np.concatenate([np.array(r[0]).reshape(-1, wide) for r in table.where("triangle is not null").select("triangle").collect()])
    return Dense(table, folder, wide), np.linalg.qr(np.vstack([found, np.zeros((wide, wide))]), mode="r")


def _side(names: DataFrame, rows: Dense, by: np.ndarray) -> DataFrame:
    """(id, u): the rows times a small matrix, with their names (id, number)."""
    folder, files, width = rows.folder, rows.files(), rows.width

    def run(batches):
        x = DenseRows(folder, files, width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _arrays(x.rows(b.column(1).to_numpy()) @ by)], names=["id", "u"])

    ordered = names.select("id", "number").repartitionByRange("number").sortWithinPartitions("number")
    return stored(ordered.mapInArrow(run, f"id {dict(names.dtypes)['id']}, u array<double>"))


@dataclass
class RowUnits:
    """A matrix cut along its rows: `packed` (unit, data) holds the edges of whole rows, `wants` the columns (unit, j) and rows (unit, i) that each unit meets, `long` (i, j, v) the rows in no unit."""

    packed: DataFrame
    wants: dict[str, DataFrame]
    long: DataFrame | None
    kinds: tuple[str, str]


def _row_units(edges: DataFrame, size: int) -> RowUnits:
    """Units of about `size` edges, in order of the rows; a row of more edges than that stays a table of edges."""
    counts = checkpointed(edges.groupBy("i").agg(F.count(F.lit(1)).alias("n")))
    long = None
    if not counts.where(F.col("n") > size).isEmpty():
        long = checkpointed(edges.join(counts.where(F.col("n") > size), "i", "left_semi"))
    unit = F.floor((F.col("done") - F.col("n")) / size).cast("long").alias("unit")
    placed = stored(edges.join(numbered(counts.where(F.col("n") <= size), "i", done="n").select("i", unit), "i").select("unit", "i", "j", "v"))
    kinds = dict(edges.dtypes)

    def pack(key, pdf):
        i_names, i = np.unique(pdf["i"].to_numpy(), return_inverse=True)
        j_names, j = np.unique(pdf["j"].to_numpy(), return_inverse=True)
        order = np.lexsort([j, i])
        out = io.BytesIO()
        lists = {n: x.astype(str) if x.dtype == object else x for n, x in (("i_names", i_names), ("j_names", j_names))}
        np.savez_compressed(out, i=i[order].astype(np.int32), j=j[order].astype(np.int32), v=pdf["v"].to_numpy()[order], **lists)
        return type(pdf)({"unit": [key[0]], "data": [out.getvalue()]})

    packed = stored(placed.groupBy("unit").applyInPandas(pack, "unit bigint, data binary"))
    return RowUnits(packed, {side: stored(placed.select("unit", side).distinct()) for side in ("i", "j")}, long, (kinds["i"], kinds["j"]))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _in_units(units: RowUnits, right: DataFrame, made: Callable[[dict, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, width: int, left: DataFrame | None = None) -> DataFrame:
    """`made(edges, rows of left, rows of right)` of every unit, with the rows (id, u) that its edges name, in the order of `i_names` and `j_names`.

    Only dense rows are shuffled, one for each column or row that a unit meets, however many edges name it.
    """
    kinds = units.kinds
    none = lambda kind: F.lit(None).cast(kind)
    rows = lambda side, order: units.wants[side].join(side_of[side].select(F.col("id").alias(side), "u"), side).select("unit", F.lit(order).alias("kind"), F.col("i") if side == "i" else none(kinds[0]).alias("i"), F.col("j") if side == "j" else none(kinds[1]).alias("j"), "u", none("binary").alias("data"))
    side_of = {"j": right} if left is None else {"j": right, "i": left}
    dealt = units.packed.select("unit", F.lit(0).alias("kind"), none(kinds[0]).alias("i"), none(kinds[1]).alias("j"), none("array<double>").alias("u"), "data")
    dealt = dealt.union(rows("j", 1) if left is None else rows("j", 1).union(rows("i", 2)))
    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "kind")
    two_sides = left is not None

    def ordered(names: np.ndarray, parts: list[tuple[pa.Array, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(names), width))
        if parts:
            x[np.searchsorted(names, pa.concat_arrays([n for n, _ in parts]).to_numpy(zero_copy_only=False).astype(names.dtype))] = np.concatenate([u for _, u in parts])
        return x

    def finish(data: bytes, parts: dict[int, list]) -> Iterator[pa.RecordBatch]:
        own = dict(np.load(io.BytesIO(data)))
        yield from made(own, ordered(own["i_names"], parts[2]) if two_sides else np.zeros((0, width)), ordered(own["j_names"], parts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, parts = None, {}
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(kind) != 0) | (kind[1:] == 0)) + 1).tolist(), batch.num_rows]
            for start, end in itertools.pairwise(cuts):
                if end == start:
                    continue
                if kind[start] == 0:
                    if data is not None:
                        yield from finish(data, parts)
                    data, parts = batch.column(5)[start].as_py(), {1: [], 2: []}
                else:
                    piece = batch.slice(start, end - start)
                    parts[int(kind[start])].append((piece.column(3 if kind[start] == 1 else 2), piece.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))
        if data is not None:
            yield from finish(data, parts)

    return dealt.mapInArrow(run, schema)


def singular_factors(edges: DataFrame, rank: int, extra: int = 10, tolerance: float = 1e-9, most: int = 60, seed: int = 1, unit: int = UNIT) -> Factors:
    """The `rank` largest singular values and vectors of a sparse matrix, by block iteration from random directions.

    A step multiplies a block of rank + extra vectors by A and then by its transpose. Both are kept by rows in files, as is the block, and tasks
    read the rows they need, so a step shuffles nothing. The block in between is made orthogonal by the triangle of its QR factorisation. It stops where no
    singular value changes by more than the tolerance, relative to the largest. Fewer axes come back where the matrix
    has fewer rows or columns.
    """
    edges = stored(edges.select("i", "j", F.col("v").cast("double").alias("v")).where("i is not null and j is not null"))
    names = {side: stored(numbered(edges.select(side).distinct(), side).select(F.col(side).alias("id"), (F.col("number") - 1).cast("long").alias("number"))) for side in ("i", "j")}
    sides = [names[side].count() for side in ("i", "j")]
    width = min(rank + extra, *sides)
    if not width:
        nothing = edges.select(F.col("i").alias("id"), F.array(F.lit(0.0)).alias("u")).limit(0)
        return Factors(nothing, np.zeros(0), nothing, np.zeros(0))
    uniform = lambda n: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n)), F.lit(1 << 40)) / float(1 << 40)) * 2 - 1
    left_names, right_names = (names[side].select(F.col("id").alias(side), F.col("number").alias(f"n{side}")).hint("merge") for side in ("i", "j"))
    met = stored(edges.join(left_names, "i").join(right_names, "j").groupBy(F.col("ni").alias("i"), F.col("nj").alias("j")).agg(F.sum("v").alias("v")))
    count, a, transposed = met.count(), sparse.keep(met), sparse.keep(met.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    right, by = _as_dense(names["j"].select("number", F.array(*[uniform(n) for n in range(width)]).alias("u")), width), np.eye(width)
    before = np.full(width, np.inf)
    for _ in range(most):
        left, triangle = _product(a, sides[0], count, right, by, unit)
        back, r = _product(transposed, sides[1], count, left, np.linalg.pinv(triangle, rcond=1e-12), unit)
        values = np.linalg.svd(r, compute_uv=False)
        right, by = back, np.linalg.pinv(r)
        if np.max(np.abs(values[:rank] - before[:rank])) <= tolerance * values[0]:
            break
        before = values
    # back = A^T left, so A is about left r^T right^T, whose factors are those of the small matrix r^T.
    inner_left, values, inner_right = np.linalg.svd(r.T)
    axes = min(rank, int(np.sum(values > values[0] * 1e-13)))
    to_left, to_right = np.linalg.pinv(triangle, rcond=1e-12) @ inner_left[:, :axes], by @ inner_right.T[:, :axes]
    u, v = _side(names["i"], left, to_left), _side(names["j"], right, to_right)
    gap = _side(names["i"], _product(a, sides[0], count, right, to_right, unit)[0], np.eye(axes)).withColumnRenamed("u", "w").join(u, "id")
    residuals = gap.agg(*[F.sqrt(F.sum(F.pow(F.col("w")[n] - float(values[n]) * F.col("u")[n], 2))) for n in range(axes)]).first()
    return Factors(u, values[:axes], v, np.array(residuals, dtype=float))


def rebuilt(factors: Factors, pairs: DataFrame) -> DataFrame:
    """(i, j, v): entries of U diag(s) V^T at the pairs (i, j)."""
    width = len(factors.values)
    if not width:
        return pairs.select("i", "j", F.lit(0.0).alias("v")).limit(0)
    units = _row_units(pairs.where("i is not null and j is not null").select("i", "j", F.lit(1.0).alias("v")), UNIT)
    kinds, values = units.kinds, factors.values

    def made(own: dict, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = own["i"], own["j"]
        v = sum(s * a[i, n] * b[j, n] for n, s in enumerate(values))
        yield pa.RecordBatch.from_arrays([pa.array(own["i_names"][i], _arrow(kinds[0])), pa.array(own["j_names"][j], _arrow(kinds[1])), pa.array(v)], names=["i", "j", "v"])

    found = _in_units(units, factors.right, made, f"i {kinds[0]}, j {kinds[1]}, v double", width, factors.left)
    if units.long is None:
        return found
    sides = units.long.join(factors.left.select(F.col("id").alias("i"), F.col("u").alias("a")), "i").join(factors.right.select(F.col("id").alias("j"), F.col("u").alias("b")), "j")
    value = sum((F.lit(float(s)) * F.col("a")[n] * F.col("b")[n] for n, s in enumerate(factors.values)), F.lit(0.0))
    return found.union(sides.select("i", "j", value.alias("v")))
