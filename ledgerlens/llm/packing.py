"""Shortest-pack-first packing of token pieces over the histogram of their lengths.

Documents become ids, are cut at the capacity, and the lengths of all pieces are counted. The plan is
made from that histogram alone (at most `capacity` numbers on the driver): lengths are placed longest
first, always into the pack with the most room, and packs that look alike are kept as one pattern with
a count. Pieces then find their place by their rank among the pieces of the same length.

Defined cases: a null text is an empty one, which is the end id alone; repeated rows are packed each on
their own; an empty table gives an empty result; ties in length are ranked by key and start.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, text_slices
from ledgerlens.llm.word_tokens import word_tokenizer

#: Pieces that one window task ranks, about.
RANKED_TOGETHER = 50_000


@dataclass(frozen=True)
class Pattern:
    """`count` packs that each hold `runs`: (length, how many of it), longest first."""

    runs: tuple[tuple[int, int], ...]
    count: int

    @property
    def filled(self) -> int:
        return sum(length * times for length, times in self.runs)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest-pack-first over a histogram {length: number of pieces}; lengths are 1 to `capacity`."""
    room: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)

    def put(space: int, runs: tuple[tuple[int, int], ...], count: int) -> None:
        if count:
            room[space][runs] = room[space].get(runs, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # A pack takes as many of this length as its room allows before the next one is looked at.
        for space in sorted((s for s in room if s >= length), reverse=True):
            for runs, count in sorted(room[space].items()):
                if not left:
                    break
                most = space // length
                full = min(count, left // most)
                part = left - full * most if full < count and left - full * most < most else 0
                rest = count - full - bool(part)
                del room[space][runs]
                put(space, runs, rest)
                put(space - most * length, (*runs, (length, most)), full)
                if part:
                    put(space - part * length, (*runs, (length, part)), 1)
                left -= full * most + part
            if not room[space]:
                del room[space]
        if left:
            most = capacity // length
            put(capacity - most * length, ((length, most),), left // most)
            if left % most:
                put(capacity - left % most * length, ((length, left % most),), 1)
    return [Pattern(runs, count) for space in sorted(room) for runs, count in sorted(room[space].items(), reverse=True)]


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go: slots sorted by length and by the first rank they hold."""

    key: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    RANKS = 1 << 44

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Places:
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for pattern in patterns:
            offset = 0
            for length, times in pattern.runs:
                rows.append((length * cls.RANKS + used[length], sequence, times, offset))
                used[length] += times * pattern.count
                offset += length * times
            sequence += pattern.count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return cls(*table.T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with each rank (from 0) among its length."""
        key = length * self.RANKS + rank
        slot = np.searchsorted(self.key, key, side="right") - 1
        within = key - self.key[slot]
        return self.sequence[slot] + within // self.times[slot], self.offset[slot] + within % self.times[slot] * length


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: key, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        own = word_tokenizer(tokenizer_file)
        for batch in text_slices(batches):
            rows = []
            for row, value in enumerate(batch.column(1).to_pylist()):
                raw = own.encode(value or "") + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    rows.append((row, start, len(piece) // 4, zlib.crc32(piece), n, *([np.frombuffer(piece, dtype="<u4").astype(np.int64)] if with_ids else [])))
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:5])]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces, which must be cheap to read twice (a checkpoint or a table).

    Only the histogram of lengths reaches the driver. A length that many pieces share is ranked in
    salted groups, whose sizes are summed first, so no task gets all of it.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places.of(plan_patterns(histogram, capacity))
    salts = max(16, -(-sum(histogram.values()) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(key, "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("salt", "before")
    names = [c for c in pieces.columns]

    def run(batches):
        for batch in batches:
            at = lambda name: batch.column(batch.schema.get_field_index(name))
            sequence, offset = places.find(at("length").to_numpy(), at("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(at(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.select(*names, "rank").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and place whole documents; pieces are checkpointed so that texts are tokenized once."""
    return place_pieces(checkpointed(token_pieces(docs, tokenizer_file, capacity, end_id, key, text, with_ids)), capacity, key)
