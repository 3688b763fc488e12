"""Helpers shared by the operators: reading, checkpoints, batches of texts, cached tokenization."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Where the setting is absent, a temporary folder is used if driver and executors are one process; on a
    cluster that is an error, as executors can't share such a folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where the table has them already, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def packed_texts(docs: DataFrame, text: str) -> DataFrame:
    """The same rows with compressed texts, which a shuffle then moves and holds."""
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField(f.name, T.BinaryType(), True) if f.name == text else f for f in docs.schema])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in text_slices(batches, text=text):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in columns[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def unpacked_texts(docs: DataFrame, text: str) -> DataFrame:
    """The rows of `packed_texts` as they were."""
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField(f.name, T.StringType(), True) if f.name == text else f for f in docs.schema])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in text_slices(batches, limit=1_500_000, text=text):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else unpack(t).decode("utf-8", "replace") for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


class ChunkCache:
    """What `encode` gives for each chunk, as bytes, kept for short chunks; cleared at `entries`, so its memory is bounded.

    `encode` maps a list of distinct chunks to a list of bytes.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = 200_000, longest: int = 40):
        self.encode, self.entries, self.longest = encode, entries, longest
        self.known: dict[str, bytes] = {}

    def lookup(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        missing = [c for c in set(chunks) if c not in known]
        if missing:
            if len(known) + len(missing) > self.entries:
                known.clear()
                missing = list(set(chunks))
            known.update(zip(missing, self.encode(missing), strict=True))
        out = list(map(known.__getitem__, chunks))
        for c in missing:
            if len(c) > self.longest:
                del known[c]
        return out


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, chosen by a hash of the key; all rows where there are no more than that.

    The share that the hash lets through leaves a margin of five percent below the limit.
    """
    total = rows.count()
    if total <= limit:
        return rows
    share = int(1_000_000 * 0.95 * limit / total)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).limit(limit)
