"""Products of sparse matrices in compact rows, with the rows of the result cut to their largest values.

The left matrix is cut once, along its edges in order of (row, column), into units of about `WORK` products
each, however many edges its rows have: a row with many edges lies in several units. The right matrix is
kept by rows in files of the shared folder (`Kept`), which tasks map into memory. A task has a unit's edges as arrays,
reads the rows that they name, adds up the products row by row, cuts each row that lies in
the unit as a whole to its largest values, and writes it into a file of the same kind. Only rows that lie in several units
are written as parts, and are added up and cut by Spark. So a product shuffles the edges of the left matrix
and nothing of the right one, and no task has more than a unit's products and one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.lineage import scratch, stored
from ledgerlens.operators.ordering import numbered

#: Products of a unit, about.
WORK = 1 << 21
#: Units that a task takes, at most.
PER_COPY = 4096
#: Rows that are added up together, and entries of an Arrow batch, about.
ROWS_TOGETHER = 512
ENTRIES = 200_000
ROWS = "i bigint, cols array<bigint>, vals array<double>"
INDEX = "i bigint, first bigint, file string, at bigint, n bigint, whole boolean"


LINE = "unit bigint, i bigint, first bigint, file string, at bigint, n bigint"


@dataclass
class Units:
    """The left matrix in files: `lines` (unit, i, first, file, at, n, open) has the pieces of rows of each unit, `open` if the row lies in several; how many units there are."""

    lines: DataFrame
    folder: str
    count: int

    @property
    def packed(self) -> DataFrame:
        """(unit, is, ks, vs): the edges of the units as lists."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit, lines in by_unit(batches):
                own = Rows(folder, lines)
                cols, vals = own.pieces(np.arange(len(own.i)))
                yield pa.RecordBatch.from_pylist([{"unit": unit, "is": np.repeat(own.i, own.n).tolist(), "ks": cols.tolist(), "vs": vals.tolist()}])

        return self.dealt().mapInArrow(run, "unit bigint, is array<bigint>, ks array<bigint>, vs array<double>")

    def dealt(self) -> DataFrame:
        return in_tasks(self.lines, self.count, PER_COPY, "unit").sortWithinPartitions("unit", "i", "first")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The lines of each unit, which lie one after the other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        units = held.column("unit").to_numpy()
        cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
        for start, end in zip(np.append(0, cuts[:-1]) if len(cuts) else [], cuts, strict=True):
            yield int(units[start]), held.slice(int(start), int(end - start))
        held = held.slice(int(cuts[-1])) if len(cuts) else held
    if held is not None:
        yield int(held.column("unit")[0].as_py()), held


@dataclass
class Kept:
    """Rows in files: `index` (i, first, file, at, n, whole) has a line for each piece of a row, of n entries from entry `at` on."""

    index: DataFrame
    folder: str

    def index_files(self) -> list[str]:
        return sorted(self.index.inputFiles())

    def entries(self) -> DataFrame:
        """(i, j, v) of all pieces."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                kept = Rows(folder, pa.Table.from_batches([batch]))
                for start in range(0, len(kept.i), ROWS_TOGETHER):
                    piece = np.arange(start, min(start + ROWS_TOGETHER, len(kept.i)))
                    cols, vals = kept.pieces(piece)
                    ids = np.repeat(kept.i[piece], kept.n[piece])
                    for at in range(0, len(cols), ENTRIES):
                        some = slice(at, at + ENTRIES)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(cols[some].astype(np.int64)), pa.array(vals[some])], names=["i", "j", "v"])

        return self.index.select("i", "first", "file", "at", "n").mapInArrow(run, "i bigint, j bigint, v double")


class Writer:
    """The files of one task: columns and values of rows, one after the other. A task that runs again has other files, and only those of the index are read."""

    def __init__(self, folder: str):
        self.folder, self.file, self.at, self.out = folder, uuid.uuid4().hex, 0, None

    def put(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, whole: bool = True) -> pa.RecordBatch:
        """Entries ordered by row; gives the lines of the index."""
        if self.out is None:
            system, path = fs.FileSystem.from_uri(self.folder)
            system.create_dir(path)
            self.out = [system.open_output_stream(f"{path}/{self.file}.{end}") for end in ("cols", "vals")]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        self.out[0].write(np.ascontiguousarray(cols, np.int32))
        self.out[1].write(np.ascontiguousarray(vals, np.float64))
        lines = [pa.array(rows[first].astype(np.int64)), pa.array(cols[first].astype(np.int64)), pa.array([self.file] * len(first), pa.string()), pa.array(self.at + first), pa.array(np.diff(np.append(first, len(rows)))), pa.array(np.full(len(first), whole))]
        self.at += len(rows)
        return pa.RecordBatch.from_arrays(lines, names=["i", "first", "file", "at", "n", "whole"])

    def close(self) -> None:
        for out in self.out or []:
            out.close()


class Rows:
    """Kept rows as a task sees them."""

    #: The last ones opened by a worker, as its next task has the same; and its mapped files.
    opened: dict[str, Rows] = {}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, folder: str, lines: pa.Table):
        i, first, at, n = (lines.column(c).to_numpy() for c in ("i", "first", "at", "n"))
        names = lines.column("file").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        order = np.lexsort((first, i))
        self.i, self.at, self.n, self.file = i[order], at[order], n[order], names.indices.to_numpy()[order]
        self.folder, self.names = folder, names.dictionary.to_pylist()

    @classmethod
    def of(cls, folder: str, files: Sequence[str], most: int = 16) -> Rows:
        if folder not in cls.opened:
            while len(cls.opened) >= most:
                del cls.opened[next(iter(cls.opened))]
            parts = []
            for file in files:
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as opened:
                    parts.append(pq.read_table(opened, columns=["i", "first", "file", "at", "n"]))
            cls.opened[folder] = cls(folder, pa.concat_tables(parts))
        return cls.opened[folder]

    def _arrays(self, file: int) -> tuple[np.ndarray, np.ndarray]:
        name = self.names[file]
        if name not in self.held:
            if len(self.held) >= 4096:
                self.held.clear()
            system, path = fs.FileSystem.from_uri(self.folder)
            path = f"{path}/{name}"
            if isinstance(system, fs.LocalFileSystem):
                self.held[name] = np.memmap(f"{path}.cols", np.int32, "r"), np.memmap(f"{path}.vals", np.float64, "r")
            else:
                self.held[name] = tuple(np.frombuffer(system.open_input_file(f"{path}.{end}").read(), kind) for end, kind in (("cols", np.int32), ("vals", np.float64)))
        return self.held[name]

    def pieces(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of pieces, one after the other."""
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(0)
        n, at, file = self.n[which], self.at[which], self.file[which]
        ends = np.cumsum(n)
        cols, vals = np.empty(int(ends[-1]), np.int32), np.empty(int(ends[-1]))
        breaks = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
        for start, end in zip(breaks, np.append(breaks[1:], len(file)), strict=True):
            own_cols, own_vals = self._arrays(int(file[start]))
            lengths, begin = n[start:end], int(ends[start] - n[start])
            to = slice(begin, int(ends[end - 1]))
            if (at[start + 1 : end] == at[start : end - 1] + lengths[:-1]).all():
                place = slice(int(at[start]), int(at[end - 1] + n[end - 1]))
            else:
                place = np.repeat(at[start:end] - (ends[start:end] - lengths - begin), lengths) + np.arange(to.stop - begin)
            cols[to], vals[to] = own_cols[place], own_vals[place]
        return cols, vals

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        """How many entries the rows have."""
        ends = np.concatenate([[0], np.cumsum(self.n)])
        return ends[np.searchsorted(self.i, keys, "right")] - ends[np.searchsorted(self.i, keys, "left")]

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, columns, values) of the rows, one after the other."""
        low, high = np.searchsorted(self.i, keys, "left"), np.searchsorted(self.i, keys, "right")
        count = high - low
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cols, vals = self.pieces(which)
        sums = np.concatenate([[0], np.cumsum(self.n[which])])
        return sums[np.cumsum(count)], cols, vals


def keep(edges: DataFrame) -> Kept:
    """The rows of (i, j, v), numbered ends, in files; in order, whatever the length of a row."""
    folder = scratch(edges.sparkSession, "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            if batch.num_rows:
                yield out.put(*(batch.column(n).to_numpy() for n in range(3)))
        out.close()

    ordered = edges.select("i", "j", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j")
    return Kept(stored(ordered.mapInArrow(run, INDEX)), folder)


def node_numbers(edges: DataFrame) -> DataFrame:
    """(node, number) of all ends, from 0 in the order of the nodes."""
    ends = edges.select(F.col("i").alias("node")).union(edges.select(F.col("j").alias("node"))).distinct()
    return numbered(ends, "node").select("node", (F.col("number") - 1).cast("long").alias("number"))


def with_numbers(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    left, right = numbers.select(F.col("node").alias("i"), F.col("number").alias("ni")), numbers.select(F.col("node").alias("j"), F.col("number").alias("nj"))
    # Names in order take so little room in files that Spark would broadcast a table of millions of them.
    return edges.join(left.hint("merge"), "i").join(right.hint("merge"), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), F.col("v").cast("double").alias("v"))


def to_rows(edges: DataFrame) -> DataFrame:
    """(i, cols, vals) with columns ascending; a row is one value, so its entries have to fit into a task."""
    listed = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    return listed.select("i", F.col("row.j").alias("cols"), F.col("row.v").alias("vals"))


def to_edges(rows: DataFrame | Kept) -> DataFrame:
    if isinstance(rows, Kept):
        return rows.entries()
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))


def cut_units(edges: DataFrame, longest: int, work: int = WORK, *flags: bool, squared: bool = True) -> Units:
    """Units of the matrix (i, j, v), numbered ends; `longest` is the most entries that a row of later right matrices has, and if it is `squared` (also as fourth), its own rows are right ones, too."""
    if all(flags) and squared:
        lengths = edges.groupBy(F.col("i").alias("j")).agg(F.count(F.lit(1)).alias("n"))
        weighed = edges.join(lengths, "j", "left").select("i", "j", "v", F.greatest(F.coalesce("n", F.lit(0)), F.lit(longest)).cast("long").alias("weight"))
    else:
        weighed = edges.select("i", "j", "v", F.lit(longest).cast("long").alias("weight"))
    placed = numbered(weighed, "i", "j", done="weight").select("i", "j", "v", F.floor((F.col("done") - F.col("weight")) / work).cast("long").alias("unit"))
    folder = scratch(edges.sparkSession, "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            if batch.num_rows:
                i, j, v, unit = (batch.column(n).to_numpy() for n in range(4))
                for part in np.split(np.arange(len(i)), np.flatnonzero(unit[1:] != unit[:-1]) + 1):
                    lines = out.put(i[part], j[part], v[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(lines.num_rows, unit[part[0]])), *lines.columns[:5]], names=["unit", "i", "first", "file", "at", "n"])
        out.close()

    lines = stored(placed.mapInArrow(run, LINE))
    several = lines.groupBy("i").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low < high").select("i", F.lit(True).alias("open"))
    lines = stored(lines.join(several, "i", "left").select("unit", "i", "first", "file", "at", "n", F.coalesce("open", F.lit(False)).alias("open")))
    return Units(lines, folder, lines.select("unit").distinct().count())


def rounded(values: np.ndarray, places: int | None) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    if places is None:
        return values
    return np.copysign(np.floor(np.abs(values) * 10.0**places + 0.5) / 10.0**places, values)


def decimals(values: np.ndarray, places: int) -> np.ndarray:
    """The values in units of the last place, rounded as Spark does: by their decimal digits, halves away from zero."""
    scaled = np.abs(values) * 10.0**places
    whole = np.floor(scaled + 0.5)
    close = np.abs(scaled - np.floor(scaled) - 0.5) <= np.maximum(1e-3, scaled * 1e-15)
    for n in np.flatnonzero(close):
        whole[n] = float(Decimal(repr(abs(float(values[n])))).scaleb(places).to_integral_value(ROUND_HALF_UP))
    return np.copysign(whole, values)


def add_up(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, column) in order, with their sums, for rows that ascend."""
    if not len(rows):
        return rows, cols, vals
    local = np.cumsum(np.concatenate([[0], rows[1:] != rows[:-1]]))
    low = cols.min()
    span = int(cols.max() - low) + 1
    if (local[-1] + 1) * span <= 4 * len(rows) + 65_536:
        # Few enough cells for a table of them; the sums are the same, and much quicker than by sorting.
        cell = local * span + (cols - low)
        found = np.flatnonzero(np.bincount(cell))
        names = rows[np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))]
        return names[found // span], found % span + low, np.bincount(cell, vals)[found]
    bits = len(rows).bit_length()
    if (int(local[-1]) + 1) * span < 1 << (63 - bits):
        # Cell and place as one number, which sorts quicker than places by two keys.
        key = ((local * span + (cols - low)) << bits) | np.arange(len(rows))
        key.sort()
        cell, order = key >> bits, key & ((1 << bits) - 1)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        return rows[order[first]], cols[order[first]], np.add.reduceat(vals[order], first)
    order = np.lexsort((cols, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])]))
    return rows[first], cols[first], np.add.reduceat(vals, first)


def merged(one: Sequence[np.ndarray], other: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of two lists of entries, each ordered by row."""
    both = [np.concatenate(x) for x in zip(one, other, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return add_up(*(x[order] for x in both))


def met(cells: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the cells, in order, are among some others."""
    found = np.zeros(len(cells), dtype=bool)
    if len(cells):
        at = np.minimum(np.searchsorted(cells, some), len(cells) - 1)
        found[at[cells[at] == some]] = True
    return found


def largest(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, most: int | None, places: int | None) -> np.ndarray:
    """Which entries, ordered by (row, column), are among the `most` largest signed values of their row; ties go to the smaller column."""
    keep = np.ones(len(rows), dtype=bool)
    if most is None or not len(rows):
        return keep
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    for start, size in zip(starts[sizes > most], sizes[sizes > most], strict=True):
        own = rounded(vals[start : start + size], places)
        bound = np.partition(own, size - most)[size - most]
        keep[start : start + size] = own > bound
        equal = np.flatnonzero(own == bound)
        keep[start + equal[: most - np.count_nonzero(own > bound)]] = True
    return keep


def _as_lists(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Entries ordered by row as (i, cols, vals)."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(rows)), pa.int32())
    return pa.array(rows[starts]), pa.ListArray.from_arrays(offsets, pa.array(cols)), pa.ListArray.from_arrays(offsets, pa.array(vals))


def multiply_unit(a: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, ends: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the product of the edges (i, k, v) with rows that lie one after the other: row n, of key keys[n], ends at ends[n]."""
    i, k, v = a
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    met = keys[at] == k
    i, v, at = i[met], v[met], at[met]
    starts = np.concatenate([[0], ends[:-1]])
    lengths = (ends - starts)[at]
    place = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(at) else np.zeros(0, np.int64)
    return add_up(np.repeat(i, lengths), cols[place], np.repeat(v, lengths) * vals[place])


def in_tasks(table: DataFrame, count: int, per_task: int, key: str) -> DataFrame:
    """Dealt in order of the key, of which there are `count`, over enough tasks to even out, of at most some `per_task`."""
    tasks = max(-(-count // per_task), min(count, 4 * table.sparkSession.sparkContext.defaultParallelism), 1)
    return table.repartitionByRange(tasks, key).sortWithinPartitions(key)


def multiply_rows(units: Units, right: DataFrame | Kept, most: int | None = None, places: int | None = None) -> Kept:
    """The product, each row cut to its `most` largest values."""
    kept = right if isinstance(right, Kept) else keep(to_edges(right))
    from_folder, files, folder, left = kept.folder, kept.index_files(), scratch(units.lines.sparkSession, "rows"), units.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Rows.of(from_folder, files), Writer(folder)
        for _, lines in by_unit(batches):
            edges = Rows(left, lines)
            k, v = edges.pieces(np.arange(len(edges.i)))
            keys = np.unique(k)
            rows, cols, vals = multiply_unit((np.repeat(edges.i, edges.n), k, v), keys, *own.rows(keys))
            part = np.isin(rows, lines.column("i").filter(lines.column("open")).to_numpy())
            for which, whole in ((part, False), (~part, True)):
                r, c, x = rows[which], cols[which], vals[which]
                best = largest(r, c, x, most if whole else None, places)
                if len(r):
                    yield out.put(r[best], c[best], x[best], whole)
        out.close()

    made = stored(units.dealt().mapInArrow(run, INDEX))
    parts = Kept(made.where("not whole"), folder)
    if parts.index.isEmpty():
        return Kept(made, folder)
    summed = parts.entries().groupBy("i", "j").agg(F.sum("v").alias("v"))
    if most is not None:
        value = F.round("v", places) if places is not None else F.col("v")
        summed = summed.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc(value), "j"))).where(F.col("r") <= most).drop("r")
    summed = summed.select("i", "j", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            if batch.num_rows:
                yield out.put(*(batch.column(n).to_numpy() for n in range(3)))
        out.close()

    return Kept(stored(made.where("whole").union(summed.mapInArrow(write, INDEX))), folder)


def names_of(files: Sequence[str], columns: Sequence[str]) -> pa.Table:
    """Stored tables in the order of their files."""
    found = []
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as opened:
            found.append(pq.read_table(opened, columns=list(columns)))
    return pa.concat_tables(found)


def named(numbers: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None, strip: bool = False) -> list[str]:
    """Files of (node, row, col), in order of the numbers: the names (with `strip`, without their kind), and whether they are among the rows (a table i) and columns (a table j) asked for."""
    out = numbers
    for wanted, key, flag in ((rows, "i", "row"), (columns, "j", "col")):
        if wanted is None:
            out = out.withColumn(flag, F.lit(True))
        else:
            marked = wanted.select(F.col(key).alias("node")).distinct().withColumn(flag, F.lit(True))
            out = out.join(marked.hint("merge"), "node", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    name = F.substring_index("node", ":", -1).alias("node") if strip else F.col("node")
    table = stored(out.select("number", name, "row", "col").repartitionByRange("number").sortWithinPartitions("number"))
    return sorted(table.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])


def best_columns(values: np.ndarray, most: int, places: int) -> np.ndarray:
    """Places of the `most` largest positive values as rounded, ties to the first."""
    some = np.flatnonzero(values > 0)
    if len(some) > most:
        bound = np.partition(values[some], len(some) - most)[len(some) - most]
        some = some[values[some] >= bound - 2 * 10.0**-places]
    order = np.lexsort((some, -decimals(values[some], places)))
    return np.sort(some[order[:most]])


def fresh_best(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, seen: np.ndarray, most: int, places: int) -> np.ndarray:
    """Places of the best entries of each row (entries ordered by row, column), without those that are seen."""
    some = np.flatnonzero(~seen)
    if not len(some):
        return some
    starts = np.flatnonzero(np.concatenate([[True], rows[some][1:] != rows[some][:-1]]))
    return np.concatenate([some[a:b][best_columns(vals[some[a:b]], most, places)] for a, b in zip(starts, np.append(starts[1:], len(some)), strict=True)])


def add_powers(numbers: DataFrame, powers: Sequence[Kept], factors: Sequence[float], most: int | None = None, places: int | None = None, rows: DataFrame | None = None, columns: DataFrame | None = None, best: int | None = None, best_places: int = 6) -> DataFrame:
    """(i, j, v) with names: the sum of the kept matrices times their factors, each row cut to its `most` largest values after each sum.

    Of the rows and columns asked for. With `best`, only the best entries of a row that the first matrix has not.
    """
    kept = [(p.folder, p.index_files()) for p in powers]
    files, kind, spark = named(numbers, rows, columns), dict(numbers.dtypes)["node"], numbers.sparkSession
    count = numbers.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_names = names_of(files, ("node", "row", "col"))
        names, row, col = all_names.column("node").combine_chunks(), all_names.column("row").to_numpy(), all_names.column("col").to_numpy()
        own = [Rows.of(*k) for k in kept]

        def entries(of: Rows, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ends, cols, vals = of.rows(keys)
            return np.repeat(keys, np.diff(ends, prepend=0)), cols, vals

        for batch in batches:
            for start in batch.column(0).to_numpy():
                keys = np.arange(start, min(start + ROWS_TOGETHER, count))
                keys = keys[row[keys]]
                r, c, v = entries(own[0], keys)
                for of, factor in zip(own[1:], factors, strict=True):
                    more = entries(of, keys)
                    r, c, v = merged((r, c, v), (more[0], more[1], factor * more[2]))
                    best_of = largest(r, c, v, most, places)
                    r, c, v = r[best_of], c[best_of], v[best_of]
                which = np.flatnonzero(col[c])
                if best is not None:
                    r, c, v = r[which], c[which], v[which]
                    had = entries(own[0], keys)
                    which = fresh_best(r, c, v, met(r * count + c, had[0] * count + had[1]), best, best_places)
                for at in range(0, len(which), ENTRIES):
                    some = which[at : at + ENTRIES]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(r[some])), names.take(pa.array(c[some])), pa.array(v[some])], names=["i", "j", "v"])

    starts = spark.range(0, max(count, 1), ROWS_TOGETHER)
    return in_tasks(starts, -(-count // ROWS_TOGETHER), 1024, "id").mapInArrow(run, f"i {kind}, j {kind}, v double")
