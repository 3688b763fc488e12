"""Vector code compression: every vector becomes eight indexes into small codebooks of integers.

A component x is taken as floor(4096 x), so all sums and distances are exact and no result hangs on the
order of rows, tasks or machines. A codebook starts as the parts of the rows with the smallest keys; each
round, tasks find the nearest entry of every part and add up what falls on it, Spark adds the tasks'
sums, and the driver holds nothing but the codebooks (parts x entries x components of a part).

Equal-average search: the squared gap between the component sums of a part and of an entry, over the
number of components, is never more than their squared distance. Entries lie in order of their sums; from a
part's own sum the search goes outwards, the nearer side first, until that bound strictly exceeds the best
distance. Entries at the same distance are thus all seen, and the lowest index wins.

Defined cases: a null vector, one with a null, NaN or infinite component and one without components take
no part; so do vectors of another length than the commonest (the greater one of two), as codebooks have
one width. A length that eight does not divide is filled up with zeros at the end. Rows with one key count
each; a null key comes last in the order of keys, and equal keys go by their vectors. With fewer than 16
rows there are as many entries as rows; an empty table gives an empty one. A component of more than 2**30
units over the components of a part (2**17 in plain numbers for 64 dimensions) is an error, as its
distances could leave 64 bits. Other columns stay; those of the results get another name where the table
has theirs already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import checkpointed, spare_names

PARTS = 8
ENTRIES = 16
ROUNDS = 6
UNITS = 4096
#: A label with more than this share of the rows is met by broadcast; there are fewer such labels than its inverse.
HOT_SHARE = 1 / 1000


@dataclass
class Codebooks:
    """`entries` holds parts x entries x components; `width` is the length of the vectors, `rows` how many were fitted."""

    entries: np.ndarray
    width: int
    rows: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sound(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integer_parts(column: pa.Array, width: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components as rows x parts x components)."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == width)
    values = pc.list_flatten(column.take(pa.array(rows)))
    matrix = np.asarray(pc.fill_null(values.cast(pa.float64()), float("nan"))).reshape(len(rows), width)
    sound = np.isfinite(matrix).all(axis=1)
    rows, matrix = rows[sound], np.floor(matrix[sound] * UNITS)
    length = -(-width // parts)
    if matrix.size and np.abs(matrix).max() > 2**30 // length:
        raise OverflowError(f"a component is beyond {2**30 // length // UNITS}: its distances could leave 64 bits")
    out = np.zeros((len(rows), parts * length), dtype=np.int64)
    out[:, :width] = matrix
    return rows, out.reshape(len(rows), parts, length)


def nearest_entries(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point, by equal-average search."""
    n, length = points.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, last = sums[order], len(book) - 1
    own = points.sum(axis=1)
    up = np.searchsorted(sums, own)
    down = up - 1
    best = np.full(n, np.iinfo(np.int64).max // length)
    index = np.full(n, len(book))
    far = np.int64(2**31)
    open_rows = np.arange(n)
    while len(open_rows):
        mine, d, u = own[open_rows], down[open_rows], up[open_rows]
        below = np.where(d >= 0, mine - sums[np.maximum(d, 0)], far)
        above = np.where(u <= last, sums[np.minimum(u, last)] - mine, far)
        lower = below <= above
        gap = np.where(lower, below, above)
        left = ((d >= 0) | (u <= last)) & (gap * gap <= best[open_rows] * length)
        open_rows, lower = open_rows[left], lower[left]
        entry = order[np.where(lower, d[left], u[left])]
        distance = ((points[open_rows] - book[entry]) ** 2).sum(axis=1)
        better = (distance < best[open_rows]) | ((distance == best[open_rows]) & (entry < index[open_rows]))
        best[open_rows[better]], index[open_rows[better]] = distance[better], entry[better]
        down[open_rows[lower]] -= 1
        up[open_rows[~lower]] += 1
    return index, best


def _first_entries(sound: DataFrame, width: int, key: str, vector: str, parts: int, entries: int) -> np.ndarray:
    first = sound.where(F.size(vector) == width).select(vector, key).orderBy(F.asc_nulls_last(key), vector).limit(entries).collect()
    _, found = integer_parts(pa.array([r[0] for r in first], pa.list_(pa.float64())), width, parts)
    return found.transpose(1, 0, 2).copy()


def _summed(rows: DataFrame, books: Codebooks, vector: str) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts fall on an entry, and the sums of their components."""
    entries, width = books.entries, books.width
    parts, count, length = entries.shape
    names = [f"s{i}" for i in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * count, np.int64), np.zeros((parts * count, length), np.int64)
        for batch in batches:
            _, points = integer_parts(batch.column(0), width, parts)
            for part in range(parts):
                index, _ = nearest_entries(points[:, part], entries[part])
                at = slice(part * count, (part + 1) * count)
                n[at] += np.bincount(index, minlength=count)
                # A batch's sums stay far below 2**53, so the product of floats is exact.
                sums[at] += ((index == np.arange(count)[:, None]).astype(float) @ points[:, part].astype(float)).astype(np.int64)
        used = np.flatnonzero(n)
        columns = [pa.array(used // count), pa.array(used % count), pa.array(n[used]), *(pa.array(sums[used, i]) for i in range(length))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

    partial = rows.select(vector).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["part", "entry", "n", *names]))
    return partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def fit_codebooks(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all rows; None where no row takes part."""
    sound = rows.where(_sound(vector))
    found = sound.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if found is None:
        return None
    books = Codebooks(_first_entries(sound, found["width"], key, vector, parts, entries), found["width"], found["n"])
    for _ in range(rounds):
        new = books.entries.copy()
        for part, entry, n, *sums in _summed(rows, books, vector).collect():  # parts x entries rows at most
            new[part, entry] = [s // n for s in sums]
        books.entries = new
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The rows that take part, without their vectors, with `code` (two hex digits for each part) and `error` (squared distances summed)."""
    others = [f for f in rows.schema.fields if f.name != vector]
    code, error = spare_names(rows.drop(vector), "code", "error")
    schema = T.StructType([*others, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    entries, width = books.entries, books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, points = integer_parts(batch.column(batch.num_columns - 1), width, len(entries))
            found = [nearest_entries(points[:, part], entries[part]) for part in range(len(entries))]
            codes = [bytes(row).hex() for row in np.stack([index for index, _ in found], axis=1).astype(np.uint8)]
            total = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
            left = batch.take(pa.array(kept))
            columns = [*left.columns[:-1], pa.array(codes, pa.string()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.select(*[F.col(f"`{f.name}`") for f in others], vector).mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over the rows of their label, where null is a label too.

    Sums are made on the map side first. A label with many rows is looked up by broadcast (fewer than
    1 / HOT_SHARE labels can have that share of the rows), so no task gets all rows of one label.
    """
    sums = checkpointed(rows.groupBy(F.col(label).alias("_label")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")))
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    same = F.col(label).eqNullSafe(F.col("_label"))
    hot, cold = (sums.where(c).drop("_n") for c in (F.col("_n") > total * HOT_SHARE, F.col("_n") <= total * HOT_SHARE))
    common = rows.join(F.broadcast(hot), same)
    rare = rows.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return common.union(rare).drop("_label")


def code_digests(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all rows of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    books = fit_codebooks(rows)
    if books is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = checkpointed(encode(rows, books))
    summed = with_group_sum(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
