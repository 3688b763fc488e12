"""Rows of A + f1 A^2 + f2 A^3 + ... without a table of the products in between.

A task takes some rows of the result through all steps. While they have few entries, a step reads only the rows of A that
the entries name (`sparse.Kept`), so the work is the number of products. Where the products would be more than a share `DENSE` of all edges
times rows, the rows go on as arrays over all nodes, `CELLS` numbers at most (or one row), by passing the edges, stored in order of their
column, piece by piece. Only what is asked of the finished rows leaves the task, so nothing is shuffled but the edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import sparse
from ledgerlens.operators.lineage import stored

#: Numbers of an array of rows, rows that go together at most, edges of a piece, and nodes that are added at once.
CELLS, TOGETHER, PIECE, CHUNK = 8_000_000, 32, 1 << 20, 4_096
#: Edges that a task keeps; of longer tables the pieces are read in each step.
KEPT = 12_000_000
#: Entries of an Arrow batch, and products that are made at once, about.
ENTRIES = 200_000
PRODUCTS = 1 << 22
#: Products by edges times rows beyond which rows are passed as arrays; edges of a column that are added one after the other.
DENSE, SLOTS = 0.025, 256


class Edges:
    """The stored edges (i, j, v) in pieces."""

    def __init__(self, files: Sequence[str], count: int):
        self.files, self.keep, self.kept = files, count <= KEPT, None

    def pieces(self) -> Iterator[Piece]:
        if self.keep and self.kept is None:
            self.kept = list(self._read())
        return iter(self.kept) if self.keep else self._read()

    def _read(self) -> Iterator[Piece]:
        for file in self.files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as opened:
                for b in pq.ParquetFile(opened).iter_batches(PIECE, columns=["i", "j", "v"]):
                    i, j, v = (b.column(n).to_numpy(zero_copy_only=False) for n in range(3))
                    yield Piece(i, j, v)


class Piece:
    """Edges in order of their column: columns by how many edges they have, and the n-th edges of all columns that have so many."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
        sizes = np.diff(np.append(starts, len(j)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        self.to, plain, self.slots = j[starts], bool((v == 1.0).all()), []
        for n in range(min(SLOTS, int(sizes[0]) if len(sizes) else 0)):
            at = starts[: np.searchsorted(-sizes, -n)] + n
            self.slots.append((i[at], None if plain else v[at]))
        long = np.flatnonzero(sizes > SLOTS)
        self.long = [(n, i[a + SLOTS : a + sizes[n]], v[a + SLOTS : a + sizes[n]]) for n, a in zip(long, starts[long], strict=True)]

    def add(self, rows: np.ndarray, out: np.ndarray) -> None:
        """Adds the rows (kept as columns: node, row) times these edges."""
        held = np.empty((CHUNK, rows.shape[1]))
        for start in range(0, len(self.to), CHUNK):
            own = np.zeros((min(CHUNK, len(self.to) - start), rows.shape[1]))
            for ends, v in self.slots:
                ends = ends[start : start + CHUNK]
                if not len(ends):
                    break
                part = np.take(rows, ends, axis=0, out=held[: len(ends)], mode="clip")
                if v is not None:
                    part *= v[start : start + CHUNK, None]
                own[: len(ends)] += part
            out[self.to[start : start + CHUNK]] += own
        for n, ends, v in self.long:
            for start in range(0, len(ends), CHUNK):
                out[self.to[n]] += v[start : start + CHUNK] @ rows[ends[start : start + CHUNK]]


def step(rows: np.ndarray, edges: Edges) -> np.ndarray:
    """The rows (kept as columns: node, row) times the matrix."""
    out = np.zeros_like(rows)
    for piece in edges.pieces():
        piece.add(rows, out)
    return out


def sparse_step(current: tuple[np.ndarray, np.ndarray, np.ndarray], kept: sparse.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries (row, node, value), ordered by row, times the matrix, some products after the other."""
    r, c, v = current
    done = np.cumsum(kept.sizes(c))
    out = None
    cuts = np.searchsorted(done, np.arange(0, int(done[-1]) if len(done) else 0, PRODUCTS), "right") if len(done) else []
    for start, end in zip(cuts, [*cuts[1:], len(c)], strict=True):
        keys = np.unique(c[start:end])
        made = sparse.multiply_unit((r[start:end], c[start:end], v[start:end]), keys, *kept.rows(keys))
        out = made if out is None else sparse.merged(out, made)
    return out if out is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _some(entries: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(x[which] for x in entries)


def walk_rows(edges: DataFrame, factors: Sequence[float], rows: DataFrame | None = None, columns: DataFrame | None = None, best: int | None = None, places: int = 6, strip: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, v) of A + factors[0] A^2 + factors[1] A^3 + ..., for positive weights.

    Of the rows (a table i) and columns (a table j) asked for, or of all. With `best`, only the so many
    largest entries of a row as rounded to `places`, ties to the smaller j, among the columns that the row has no edge to.
    With `strip`, names (kind:name) come without their kind; with `digits`, values as round(v + 1e-9, digits) makes them, which Spark takes longer for than for all else.
    """
    kind_i, kind_j = (dict(edges.dtypes)[c] for c in ("i", "j"))
    a = stored(edges.groupBy("i", "j").agg(F.sum("v").cast("double").alias("v")))
    numbers = stored(sparse.node_numbers(a))
    kind = dict(numbers.dtypes)["node"]
    numbered = stored(sparse.with_numbers(a, numbers))
    matrix = sparse.keep(numbered)
    nodes, count = numbers.count(), numbered.count()
    # A row's first steps have few entries; only what follows can be dense.
    many = len(factors) > 2
    files = sorted(stored(numbered.repartitionByRange("j", "i").sortWithinPartitions("j", "i")).inputFiles(), key=lambda f: f.rsplit("/", 1)[-1]) if many else []
    name_files = sparse.named(numbers, rows, columns, strip)
    folder, index_files = matrix.folder, matrix.index_files()
    begin = numbers if rows is None else numbers.join(rows.select(F.col("i").alias("node")).distinct().hint("merge"), "node", "left_semi")
    begin = stored(begin.select("number"))
    together = max(1, min(TOGETHER, CELLS // max(1, nodes))) if many else TOGETHER
    blocks = max(1, -(-begin.count() // together))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = Edges(files, count), sparse.Rows.of(folder, index_files)
        found = sparse.names_of(name_files, ("node", "col"))
        names, wanted = found.column("node").combine_chunks(), found.column("col").to_numpy()
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for start in range(0, len(numbers), together):
                yield from finished(numbers[start : start + together], held, kept, names, wanted)

    def finished(ids: np.ndarray, held: Edges, kept: sparse.Rows, names: pa.Array, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends, cols, vals = kept.rows(ids)
        own = current = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0)), cols.astype(np.int64), vals
        # Entries of columns that aren't asked for are left out, and of lists those of edges, whatever they come to.
        total = _some(own, wanted[own[1]] if best is None else slice(0, 0))
        for n, factor in enumerate(factors):
            if not len(current[0]):
                break
            if many and kept.sizes(current[1]).sum() > DENSE * count * len(ids):
                total = dense(current, total, factors[n:], held, len(ids), wanted)
                break
            current = sparse_step(current, kept)
            more = _some((current[0], current[1], factor * current[2]), wanted[current[1]])
            total = sparse.merged(total, more) if len(total[0]) and len(more[0]) else total if len(total[0]) else more
        r, c, v = total
        if best is not None:
            which = sparse.fresh_best(r, c, v, sparse.met(r * nodes + c, own[0] * nodes + own[1]), best, places)
            r, c, v = r[which], c[which], v[which]
        if digits is not None:
            v = sparse.decimals(v + 1e-9, digits) / 10.0**digits
        for at in range(0, len(r), ENTRIES):
            some = slice(at, at + ENTRIES)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(ids[r[some]])), names.take(pa.array(c[some])), pa.array(v[some])], names=["i", "j", "v"])

    def dense(current: tuple, total: tuple, left: Sequence[float], held: Edges, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        now, out = np.zeros((nodes, width)), np.zeros((nodes, width))
        now[current[1], current[0]], out[total[1], total[0]] = current[2], total[2]
        for factor in left:
            now = step(now, held)
            out += factor * now
        out[~wanted] = 0.0
        r, c = np.nonzero(out.T)
        return r, c, out[c, r]

    # A task has at most 64 blocks of rows.
    out = begin.repartitionByRange(max(min(blocks, 32), -(-blocks // 64)), "number").sortWithinPartitions("number").mapInArrow(run, f"i {kind}, j {kind}, v double")
    return out.select(F.col("i").cast(kind_i).alias("i"), F.col("j").cast(kind_j).alias("j"), "v")
