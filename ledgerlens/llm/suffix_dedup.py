"""Repeated passages by a distributed merge sort of suffixes that never compares a known prefix again.

A byte is removed if a string of `WINDOW` bytes that covers it also starts in a document with a smaller
id. Suffixes are sorted where the text itself says so: each window has an anchor, the place of its
smallest hashed string of `SEED` bytes, so equal windows have equal anchors and about one place in twenty is
sorted. A record is an anchor with all windows that chose it: the suffix from the anchor on, and the
bytes before it.

1. Every task sorts the records of some megabytes of documents into a run, front-codes it (each suffix
   as the length it shares with the one before, and the rest), cuts it at splitters that were sampled
   from the table, and sends the pieces. With more than `FANOUT` ranges the exchange has two levels: pieces
   go to about the root of that number of wide ranges first, where as many runs are merged into a longer one
   that is cut again, so that pieces don't grow with the square of the table. Beginnings too frequent for one range are taken apart: each of
   their windows is a record of its own, dealt over all ranges by a hash of the window. Of equal records
   only those of the smallest id are sent; the others are repeats already.
2. Every task merges the pieces of its range with a loser tree that knows for each head how much it
   shares with the last suffix put out. Heads that share different lengths are ordered by these alone;
   otherwise bytes are compared from the shared length on.
3. The shared lengths of the merged order, and those of the bytes before the anchors, number the equal
   windows; a window whose number has a smaller id is a repeat.
4. Spans come together by document, are joined, and the bytes are cut.

Equal records leave a run once, so a passage that many documents share is met in each range at most once
for each run, and so is a window that was dealt. Defined cases: a null text is an empty one; texts shorter
than a window stay whole; rows that repeat an id never remove each other's bytes; an empty table gives an
empty result; other columns are ignored or kept as the function says.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, packed_texts, spare_names, text_slices

#: A seed has 8 to 16 bytes.
WINDOW, SEED = 50, 12
#: Most bytes before an anchor that a window can have.
BEFORE = WINDOW - SEED
#: Bytes of text in a run, in a range, and in one step of the search for anchors.
RUN_BYTES, RANGE_BYTES, STEP_BYTES = 6_000_000, 6_000_000, 1_000_000
#: Places whose hashes are looked at together, so that they stay in the processor's cache.
SCAN = 16_384
#: The splitters are sampled from this share of the documents, or from so many where that is more; sampled suffixes
#: for each range; and sampled suffixes below which no beginning is hot.
SPLITTER_SHARE, SPLITTER_DOCS, SPLITTER_ROWS, HOT_ROWS = 0.005, 4_000, 2_048, 24
#: Ranges beyond which the exchange has two levels.
FANOUT = 8_192

#: Suffix, bytes before it backwards, document, row, place in the document.
Record = tuple[bytes, bytes, int, int, int]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts put end to end: places of anchors, and the first and last window start that chose each."""
    raw = b"".join(texts)
    n = len(raw)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    # The first and the last eight bytes of the seed at every place.
    words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=raw, strides=(1,))
    places, width = n - SEED + 1, WINDOW - SEED + 1
    # A place's number is half of its hash and then the place, so that the smallest is the leftmost of equals.
    place = np.empty(places - width + 1, dtype=np.int64)
    for at in range(0, len(place), SCAN):
        end = min(at + SCAN, len(place)) + width - 1
        value = words[at:end] * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value += words[at + SEED - 8 : end + SEED - 8]
        value *= np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(32)
        value <<= np.uint64(32)
        value |= np.arange(at, end, dtype=np.uint64)
        span = 1
        while span < width:  # the smallest of ever longer stretches
            step = min(span, width - span)
            value = np.minimum(value[:-step], value[step:])
            span += step
        place[at : at + SCAN] = value & np.uint64(0xFFFFFFFF)
    ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))
    # Windows begin anew with each text; those that begin in a text's last bytes lie in none.
    new = np.ones(len(place), dtype=bool)
    np.not_equal(place[1:], place[:-1], out=new[1:])
    borders = np.concatenate([ends, ends - WINDOW + 1])
    new[borders[(borders > 0) & (borders < len(place))]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    keep = first + WINDOW <= ends[np.searchsorted(ends, first, side="right")]
    first, last = first[keep], last[keep]
    return place[first], first, last


def _steps(batch: list[tuple[int, int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents, rows and texts of about `STEP_BYTES` at a time."""
    start = 0
    while start < len(batch):
        size, end = 0, start
        while end < len(batch) and (end == start or size + len(batch[end][2]) <= STEP_BYTES):
            size += len(batch[end][2])
            end += 1
        docs, rows, texts = zip(*batch[start:end], strict=True)
        yield list(docs), list(rows), list(texts)
        start = end


def records(batch: list[tuple[int, int, bytes]]) -> list[Record]:
    """(suffix, bytes before it backwards, doc, row, place in the document) of documents (doc, row, text)."""
    return run_of(batch).records() if batch else []


def in_order(rows: list[Record]) -> list[Record]:
    """The rows sorted; their first sixteen bytes are sorted as numbers before, so that most rows are compared with their neighbours alone."""
    if not rows:
        return []
    firsts = np.array([r[0][:16] for r in rows], dtype="S16").view(">u8").reshape(-1, 2)
    out = [rows[k] for k in np.lexsort((firsts[:, 1], firsts[:, 0])).tolist()]
    out.sort()
    return out


def single_windows(record: tuple[bytes, bytes, int, int, int]) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """A record as one record for each of its windows."""
    suffix, before, doc, row, place = record
    for x in range(WINDOW - len(suffix), len(before) + 1):
        yield suffix[: WINDOW - x], before[:x], doc, row, place


@dataclass(frozen=True)
class Run:
    """Records as columns: suffixes and bytes before them as rows of bytes filled up with zeros, and the lengths of both."""

    suffix: np.ndarray
    before: np.ndarray
    length: np.ndarray
    left: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.suffix, self.before, self.length, self.left, self.doc, self.row, self.place

    def take(self, rows: np.ndarray | slice) -> Run:
        return Run(*(c[rows] for c in self.columns()))

    def records(self) -> list[Record]:
        suffixes, befores = self.suffix.tobytes(), self.before.tobytes()
        starts = zip(range(0, len(suffixes), _WIDE), self.length.tolist(), range(0, len(befores), _WIDE_BEFORE), self.left.tolist(), self.doc.tolist(), self.row.tolist(), self.place.tolist(), strict=True)
        return [(suffixes[a : a + n], befores[b : b + m], doc, row, place) for a, n, b, m, doc, row, place in starts]

    def in_order(self) -> Run:
        """Sorted as the records are: pairs of words of eight bytes at a time, and only rows that are equal so far are looked at again."""
        words, back = (c.view(">u8") for c in (self.suffix, self.before))
        keys = [*words.T, self.length, *back.T, self.left, self.doc, self.row, self.place]
        order, at, group = np.arange(len(self)), np.arange(len(self)), np.zeros(len(self), dtype=np.int64)
        while keys and len(at):
            rows = order[at]
            own = [k[rows].astype(np.int64 if k.dtype.kind == "i" else np.uint64) for k in keys[:2]]
            by = np.lexsort([*own[::-1], group])
            order[at] = rows[by]
            same = np.zeros(len(at) + 1, dtype=bool)
            same[1:-1] = np.diff(group) == 0  # groups stay where they are
            for k in own:
                k = k[by]
                same[1:-1] &= k[1:] == k[:-1]
            group = np.cumsum(~same[:-1])
            tied = same[:-1] | same[1:]
            at, group, keys = at[tied], group[tied], keys[2:]
        return self.take(order)

    def shared(self) -> np.ndarray:
        """How many bytes each suffix shares with the one before; 0 for the first."""
        found = shared_lengths(self.suffix[:, :WINDOW])
        found[1:] = np.minimum(found[1:], np.minimum(self.length[1:], self.length[:-1]))
        return found

    def first_of_equals(self) -> tuple[Run, list[tuple[int, int, bytes]]]:
        """As `_first_of_equals` does for records in order."""
        same = np.zeros(len(self), dtype=bool)
        same[1:] = (self.length[1:] == self.length[:-1]) & (self.left[1:] == self.left[:-1])
        for words in (self.suffix.view("<u8"), self.before.view("<u8")):
            at = np.flatnonzero(same)
            same[at] = (words[at] == words[at - 1]).all(axis=1)
        if not same.any():
            return self, []
        firsts = np.maximum.accumulate(np.where(same, 0, np.arange(len(self))))
        local = self.doc != self.doc[firsts]
        gone = self.take(local)
        return self.take(~local), list(_span_rows(gone.doc, gone.row, gone.place - gone.left, gone.place + gone.length))


#: Bytes of a row of suffixes, and of bytes before an anchor: whole words.
_WIDE, _WIDE_BEFORE = -(-WINDOW // 8) * 8, -(-BEFORE // 8) * 8
_MASK, _MASK_BEFORE = (np.where(np.arange(w) < np.arange(w + 1)[:, None], 255, 0).astype(np.uint8).view(np.uint64) for w in (_WIDE, _WIDE_BEFORE))


def run_of(batch: list[tuple[int, int, bytes]]) -> Run:
    """The records of documents (doc, row, text) as columns."""
    parts: list[tuple[np.ndarray, ...]] = []
    for docs, rows, texts in _steps(batch):
        raw = np.frombuffer(b"".join([*texts, bytes(_WIDE)]), dtype=np.uint8)
        n = len(raw) - _WIDE
        back = np.concatenate([raw[:n][::-1], np.zeros(_WIDE_BEFORE, dtype=np.uint8)])
        at, first, last = anchors(texts)
        borders = np.cumsum([0, *map(len, texts)])
        owner = np.searchsorted(borders, first, side="right") - 1
        length, left = last + WINDOW - at, at - first
        suffix = np.lib.stride_tricks.sliding_window_view(raw, _WIDE)[at]
        before = np.lib.stride_tricks.sliding_window_view(back, _WIDE_BEFORE)[n - at]
        for words, mask, size in ((suffix, _MASK, length), (before, _MASK_BEFORE, left)):
            view = words.view(np.uint64)
            view &= mask[size]
        parts.append((suffix, before, length, left, np.array(docs, dtype=np.int64)[owner], np.array(rows, dtype=np.int64)[owner], at - borders[owner]))
    return Run(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def as_run(rows: list[Record]) -> Run:
    suffixes, befores, doc, row, place = zip(*rows, strict=True)
    length, left = (np.fromiter(map(len, x), dtype=np.int64, count=len(rows)) for x in (suffixes, befores))
    return Run(_matrix(b"".join(suffixes), length, _WIDE), _matrix(b"".join(befores), left, _WIDE_BEFORE), length, left, *(np.array(x, dtype=np.int64) for x in (doc, row, place)))


def _matrix(joined: bytes, lengths: np.ndarray, width: int) -> np.ndarray:
    """Strings put end to end as rows of bytes, filled up with zeros."""
    out = np.zeros((len(lengths), width), dtype=np.uint8)
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(joined, dtype=np.uint8)
    return out


def shared_lengths(matrix: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(matrix), dtype=np.int64)
    if len(matrix) > 1:
        same = np.column_stack([matrix[1:] == matrix[:-1], np.zeros(len(matrix) - 1, dtype=bool)])
        out[1:] = same.argmin(axis=1)
    return out


def write_piece(rows: list[Record] | Run) -> bytes:
    """A sorted piece, front-coded."""
    run = rows if isinstance(rows, Run) else as_run(rows)
    shared = run.shared()
    cells, cells_before = np.arange(_WIDE, dtype=np.uint8), np.arange(_WIDE_BEFORE, dtype=np.uint8)
    skip, length, left = (c.astype(np.uint8) for c in (shared, run.length, run.left))
    tails = run.suffix[(cells >= skip[:, None]) & (cells < length[:, None])].tobytes()
    befores = run.before[cells_before < left[:, None]].tobytes()
    docs, at = np.unique(run.doc, return_inverse=True)
    parts = [skip.tobytes(), length.tobytes(), left.tobytes(), at.astype("<u4").tobytes(), run.row.astype("<u4").tobytes(), run.place.astype("<u4").tobytes(), docs.astype("<i8").tobytes(), tails, befores]
    head = np.array([len(run), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def read_piece(data: bytes) -> dict:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw[:40], dtype="<u4").tolist()
    parts, at = [], 40
    for size in head[1:]:
        parts.append(raw[at : at + size])
        at += size
    shared, lengths, before = (np.frombuffer(p, dtype=np.uint8).astype(np.int64) for p in parts[:3])
    suffixes, last, at = [], b"", 0
    for c, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        last = last[:c] + parts[7][at : at + n - c]
        at += n - c
        suffixes.append(last)
    docs = np.frombuffer(parts[6], dtype="<i8")
    return {"suffixes": suffixes, "shared": shared.tolist(), "lengths": lengths, "before": before, "befores": parts[8], "doc": docs[np.frombuffer(parts[3], dtype="<u4")], "row": np.frombuffer(parts[4], dtype="<u4").astype(np.int64), "place": np.frombuffer(parts[5], dtype="<u4").astype(np.int64)}


def records_of(piece: dict) -> Iterator[Record]:
    """The records of a piece that was read."""
    ends = itertools.accumulate(piece["before"].tolist(), initial=0)
    befores = [piece["befores"][s:e] for s, e in itertools.pairwise(ends)]
    return zip(piece["suffixes"], befores, piece["doc"].tolist(), piece["row"].tolist(), piece["place"].tolist(), strict=True)


def merge_runs(suffixes: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: the run of each suffix in order, and how much it shares with the one put out before it.

    `shared` has the same for each run alone. A node of the tree keeps the loser of its match; what a
    head shares with the last suffix put out is in `known`, and it is all that most matches look at. Heads are
    numbers: the bytes, zeros up to the longest, and the length, so what two of them share shows in their difference.
    """
    size = 1
    while size < len(suffixes):
        size *= 2
    wide = max((len(x) for s in suffixes for x in s), default=0)
    bits, tops = 8 * wide + 16, [n.to_bytes(2, "big") for n in range(wide + 1)]
    numbers = [iter([int.from_bytes(x.ljust(wide, b"\0") + tops[len(x)], "big") for x in s]) for s in suffixes]
    follow = [iter(s) for s in shared]
    heads = [next(n, 0) for n in numbers] + [0] * (size - len(suffixes))
    # A run at its end knows less than all others, so it loses.
    known = [-1 if next(f, None) is None else 0 for f in follow] + [-1] * (size - len(suffixes))
    loser = [0] * (2 * size)

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser, of those that know as much; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if known[a] < 0:
            return a, b
        at = (bits - (x ^ y).bit_length()) >> 3
        if y < x:
            a, b = b, a
        known[b] = min(at, x & 65535, y & 65535)
        return a, b

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = match(a, b) if known[a] == known[b] else (a, b) if known[a] > known[b] else (b, a)
    best = winners[1] if size > 1 else 0
    runs, lengths = [], []
    now = known[best]
    while now >= 0:
        runs.append(best)
        lengths.append(now)
        now = known[best] = next(follow[best], -1)
        heads[best] = next(numbers[best], 0)
        node = (best + size) >> 1
        while node:
            other = loser[node]
            rival = known[other]
            if now < rival:
                best, loser[node] = other, best
                now = rival
            elif now == rival and now >= 0:
                x, y = heads[best], heads[other]
                if y < x:
                    best, loser[node], other = other, best, best
                at, end = (bits - (x ^ y).bit_length()) >> 3, (x if x < y else y) & 65535
                known[other] = at if at < end else min(at, x & 65535, y & 65535)
            node >>= 1
    return runs, lengths


def repeated_windows(shared: np.ndarray, lengths: np.ndarray, before: np.ndarray, befores: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted records: most and least bytes before the anchor of their windows that a smaller doc has; -1 where none is."""
    n = len(shared)
    most, least = np.full(n, -1), np.full(n, -1)
    new = shared < SEED
    new[:1] = True
    # Only beginnings that several documents have can hold repeats.
    starts = np.flatnonzero(new)
    several = np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), np.diff(np.append(starts, n))) if n else new
    if not several.all():
        if several.any():
            most[several], least[several] = repeated_windows(*(x[several] for x in (shared, lengths, before, befores, doc)))
        return most, least
    group = np.cumsum(new)
    columns = np.zeros((n, -(-BEFORE // 8) * 8), dtype=np.uint8)
    columns[:, :BEFORE] = befores
    order = np.lexsort([*(columns.view(">u8")[:, k] for k in range(columns.shape[1] // 8 - 1, -1, -1)), group])
    left = shared_lengths(befores[order])
    left[group[order] != np.concatenate([[-1], group[order][:-1]])] = -1
    left_next, shared_next = np.append(left[1:], -1), np.append(shared[1:], 0)
    near_left = np.empty(n, dtype=np.int64)
    near_left[order] = np.maximum(left, left_next)
    near_right = np.maximum(np.where(new, 0, shared), np.where(np.append(new[1:], True), 0, shared_next))
    numbers = np.empty(n, dtype=np.int64)
    for x in range(BEFORE + 1):
        rows = np.flatnonzero((before >= x) & (lengths >= WINDOW - x) & (near_left >= x) & (near_right >= WINDOW - x))
        if not len(rows):
            continue
        numbers[order] = np.cumsum(left < x)
        key = numbers[rows] * (n + 1) + np.cumsum(shared < WINDOW - x)[rows]
        by_key = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[by_key], prepend=-1))
        smallest = np.minimum.reduceat(doc[rows][by_key], starts)
        hit = rows[by_key][doc[rows][by_key] > np.repeat(smallest, np.diff(np.append(starts, len(rows))))]
        most[hit] = x
        least[hit] = np.where(least[hit] < 0, x, least[hit])
    return most, least


def _span_rows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, row, spans as bytes) with the spans of a document joined."""
    if not len(doc):
        return
    order = np.lexsort([start, row, doc])
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
    for s, e in zip(new, [*new[1:], len(doc)], strict=True):
        yield int(doc[s]), int(row[s]), joined(start[s:e], end[s:e]).astype("<u4").tobytes()


def joined(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch, put together: rows (start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    firsts = np.flatnonzero(new)
    return np.column_stack([start[firsts], end[np.append(firsts[1:], len(start)) - 1]])


OUT = "range int, part int, piece binary, doc bigint, row int, spans binary"
NAMES = ["range", "part", "piece", "doc", "row", "spans"]
KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]


@dataclass(frozen=True)
class Ranges:
    """Where sorted records are cut, and the beginnings that are in no range; `width` ranges together make a wide one."""

    splitters: tuple[bytes, ...]
    hot: frozenset[bytes]
    width: int = 1

    @property
    def number(self) -> int:
        return len(self.splitters) + 1

    def split(self, rows: list[Record]) -> tuple[list[Record], list[Record]]:
        """Sorted records without hot beginnings, and those with one."""
        cold, hot, at = [], [], 0
        for first in sorted(self.hot):  # no byte of UTF-8 is 255
            start, end = bisect.bisect_left(rows, (first,)), bisect.bisect_left(rows, (first[:-1] + bytes([first[-1] + 1]),))
            cold += rows[at:start]
            hot += rows[start:end]
            at = end
        return (cold + rows[at:] if at else rows), hot

    def split_run(self, run: Run) -> tuple[Run, list[Record]]:
        """As `split` does for records in order."""
        if not self.hot or not len(run):
            return run, []
        hot = np.array(list(self.hot), dtype=f"S{SEED}")
        firsts = np.ascontiguousarray(run.suffix[:, :SEED]).view(f"S{SEED}").ravel()
        change = np.zeros(len(run) + 1, dtype=np.int64)
        np.add.at(change, np.searchsorted(firsts, hot, side="left"), 1)
        np.add.at(change, np.searchsorted(firsts, hot, side="right"), -1)
        inside = np.cumsum(change[:-1]) > 0
        return run.take(~inside), run.take(inside).records()

    def deal(self, hot: list[Record], width: int) -> dict[int, list[Record]]:
        """Windows at hot beginnings, by a hash of the window."""
        dealt: dict[int, list[Record]] = {}
        for r in hot:
            dealt.setdefault(zlib.crc32(r[1][::-1] + r[0]) % self.number // width, []).append(r)
        return dealt

    def cut(self, cold: list[Record], hot: list[Record], wide: bool) -> Iterator[tuple[int, list[Record]]]:
        """The rows of each range, or of each wide one. Windows at hot beginnings are dealt by a hash of the window."""
        width = self.width if wide else 1
        splitters = self.splitters[width - 1 :: width]
        dealt = self.deal(hot, width)
        cuts = [0, *(bisect.bisect_left(cold, (s,)) for s in splitters), len(cold)]
        for k, (start, end) in enumerate(itertools.pairwise(cuts)):
            own = cold[start:end]
            if k in dealt:
                own = sorted(own + dealt.pop(k))
            if own:
                yield k, own

    def cut_run(self, cold: Run, hot: list[Record]) -> Iterator[tuple[int, Run]]:
        """The rows of each wide range, as `cut` gives them."""
        splitters = self.splitters[self.width - 1 :: self.width]
        dealt = self.deal(hot, self.width)
        firsts = np.ascontiguousarray(cold.suffix[:, :SEED]).view(f"S{SEED}").ravel()
        cuts = [0, *np.searchsorted(firsts, np.array(splitters, dtype=f"S{SEED}")).tolist(), len(cold)] if splitters else [0, len(cold)]
        for k, (start, end) in enumerate(itertools.pairwise(cuts)):
            own = cold.take(slice(start, end))
            if k in dealt:
                own = Run(*(np.concatenate(c) for c in zip(own.columns(), as_run(dealt.pop(k)).columns(), strict=True))).in_order()
            if len(own):
                yield k, own


def _first_of_equals(rows: list[Record]) -> tuple[list[Record], list[tuple[int, int, bytes]]]:
    """Of sorted records those of the smallest id among equal ones, and the spans of the others, which are repeats."""
    same = [k for k, (a, b) in enumerate(itertools.pairwise(rows)) if a[0] == b[0] and a[1] == b[1]]
    if not same:
        return rows, []
    kept, local, at, smallest = [], [], 0, None
    for k in same:
        if k >= at:  # equal records are sorted by document, so the first of them has the smallest id
            kept += rows[at : k + 1]
            smallest = rows[k][2]
        (kept if rows[k + 1][2] == smallest else local).append(rows[k + 1])
        at = k + 2
    kept += rows[at:]
    if not local:
        return kept, []
    place = np.array([r[4] for r in local], dtype=np.int64)
    start, stop = place - [len(r[1]) for r in local], place + [len(r[0]) for r in local]
    return kept, list(_span_rows(np.array([r[2] for r in local]), np.array([r[3] for r in local]), start, stop))


def _send_runs(ranges: Ranges, parts: int):
    """For mapInArrow over (doc, row, text): pieces for the (wide) ranges, and spans that the run itself shows, which go to some range too."""
    targets = -(-ranges.number // ranges.width)

    def send(batch, part):
        cold, hot = ranges.split_run(run_of(batch).in_order())
        cold, spans = cold.first_of_equals()
        hot, more = _first_of_equals(in_order([w for r in hot for w in single_windows(r)]))
        for doc, row, own in spans + more:
            yield doc % targets, part, None, doc, row, own
        for k, own in ranges.cut_run(cold, hot):
            yield k, part, write_piece(own), 0, 0, None

    def run(batches):
        held, size, runs = [], 0, TaskContext.get().partitionId()
        for batch in text_slices(batches, limit=STEP_BYTES):
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if doc is not None and len(raw) >= WINDOW:
                    held.append((doc, row, raw))
                    size += len(raw)
            if size >= RUN_BYTES:
                yield from _batches(send(held, runs % parts))
                held, size, runs = [], 0, runs + 1
        if held:
            yield from _batches(send(held, runs % parts))

    return run


def _batches(rows, most: int = 4_000_000):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2] or b"") + len(r[5] or b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)


def _merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one range to spans; spans that came along go on."""
    pieces = [read_piece(p) for p in pdf["piece"] if p is not None]
    ready = pdf[pdf["piece"].isna()][["doc", "row", "spans"]]
    found: list[tuple[int, int, bytes]] = []
    if pieces:
        runs, shared = merge_runs([p.pop("suffixes") for p in pieces], [p.pop("shared") for p in pieces])
        runs = np.array(runs)
        base = np.cumsum([0, *(len(p["doc"]) for p in pieces)])
        order = np.empty(len(runs), dtype=np.int64)
        for k in range(len(pieces)):
            order[runs == k] = np.arange(base[k], base[k + 1])
        whole = {c: np.concatenate([p[c] for p in pieces])[order] for c in ("lengths", "before", "doc", "row", "place")}
        befores = np.concatenate([_matrix(p["befores"], p["before"], BEFORE) for p in pieces])[order]
        most, least = repeated_windows(np.array(shared), whole["lengths"], whole["before"], befores, whole["doc"])
        hit = np.flatnonzero(most >= 0)
        found = list(_span_rows(whole["doc"][hit], whole["row"][hit], whole["place"][hit] - most[hit], whole["place"][hit] - least[hit] + WINDOW))
    return pd.concat([ready, pd.DataFrame(found, columns=["doc", "row", "spans"])]).astype({"doc": "int64", "row": "int32"})


def _join_runs(ranges: Ranges):
    """For groups of pieces of one wide range: merged into one run, which is cut at the ranges in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [read_piece(p) for p in pdf["piece"] if p is not None]
        out = [(int(d) % ranges.number, 0, None, d, r, s) for d, r, s in pdf[pdf["piece"].isna()][["doc", "row", "spans"]].itertuples(index=False)]
        if pieces:
            order, _ = merge_runs([p["suffixes"] for p in pieces], [p["shared"] for p in pieces])
            heads = [records_of(p) for p in pieces]
            merged = [next(heads[k]) for k in order]
            rows = [r for _, same in itertools.groupby(merged, key=lambda r: r[0]) for r in sorted(same)]
            kept, spans = _first_of_equals(rows)
            out += [(doc % ranges.number, 0, None, doc, row, own) for doc, row, own in spans]
            out += [(k, 0, write_piece(own), 0, 0, None) for k, own in ranges.cut(*ranges.split(kept), wide=False)]
        return pd.DataFrame(out, columns=NAMES).astype({"range": "int32", "part": "int32", "doc": "int64", "row": "int32"})

    return run


def _ranges(docs: DataFrame, size: int, number: int) -> Ranges:
    """Where the table is cut into even ranges, and the hot beginnings, from a sample of documents that grows with the table.

    Equal windows share at least `SEED` bytes from their anchor, so ranges are cut between such beginnings.
    A beginning with more than two ranges' worth of records is hot: it is in no range. The sample stays in
    Spark, whose own range partitioning cuts it; the driver gets one splitter for each range and the hot
    beginnings, which are fewer than half as many.
    """
    share = min(1.0, max(SPLITTER_DOCS / max(1, docs.count()), SPLITTER_SHARE))
    sample = docs.where(F.col("doc").isNotNull() & (F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(1_000_000 * share)))
    step = max(1, int(size * share / 20 / (SPLITTER_ROWS * number)))

    def begin(batches):
        for batch in text_slices(batches, limit=STEP_BYTES):
            rows = records([(0, 0, (t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r[0][:SEED] for r in rows[::step]], pa.binary())], names=["suffix"])

    found = checkpointed(sample.mapInArrow(begin, "suffix binary"))
    most = max(HOT_ROWS, 2 * found.count() / number)
    hot = frozenset(bytes(r[0]) for r in found.groupBy("suffix").count().where(F.col("count") > most).select("suffix").collect())

    def least(batches):
        first = None
        for batch in batches:
            own = [s for s in batch.column(0).to_pylist() if s not in hot]
            first = min([first, *own] if first is not None else own, default=None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], names=["suffix"])

    def cold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for s in batch.column(0).to_pylist() if s not in hot], pa.binary())], names=["suffix"])

    firsts = sorted(bytes(r[0]) for r in found.mapInArrow(cold, "suffix binary").repartitionByRange(number, "suffix").mapInArrow(least, "suffix binary").collect())
    splitters = tuple(firsts[1:])
    return Ranges(splitters, hot, 1 if len(splitters) < FANOUT else math.isqrt(len(splitters)) + 1)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, row, spans) of documents (doc, row, text): lists of start and end bytes, as packed integers, that are repeats."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = _ranges(docs, size, max(32, -(-size // RANGE_BYTES)))
    # A group of the first level holds as many runs as there are wide ranges, so about the text of one run.
    parts = 1 if ranges.width == 1 else max(1, -(-size // (RUN_BYTES * ranges.width)))
    sent = docs.mapInArrow(_send_runs(ranges, parts), OUT)
    if ranges.width > 1:
        sent = sent.groupBy("range", "part").applyInPandas(_join_runs(ranges), OUT)
    return sent.groupBy("range").applyInPandas(_merge_range, "doc bigint, row int, spans binary")


def _row_number(docs: DataFrame, key: str, text: str) -> Column:
    """Tells rows apart that share an id but not the text; a constant, without a shuffle, where there are none."""
    ids = docs.groupBy(key).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    if ids.where("a <> b").isEmpty():
        return F.lit(0)
    return F.dense_rank().over(Window.partitionBy(key).orderBy(text))


def cut(raw: bytes, blobs: list[bytes] | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and spans removed."""
    if not blobs:
        return raw, 0, 0
    spans = np.frombuffer(b"".join(blobs), dtype="<u4").reshape(-1, 2).astype(np.int64)
    spans = joined(spans[:, 0], spans[:, 1])
    left, at = [], 0
    for s, e in spans.tolist():
        left.append(raw[at:s])
        at = e
    left.append(raw[at:])
    return b"".join(left), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = docs.select(F.col(key).alias("doc"), _row_number(docs, key, text).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(rows).groupBy("doc", "row").agg(F.collect_list("spans").alias("spans"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in text_slices(batches, limit=STEP_BYTES):
            out = [[], [], [], []]
            for packed, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = unpack(packed) if packed is not None else b""
                left, removed, n = cut(raw, blobs)
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined_rows = packed_texts(rows, "text").join(spans, ["doc", "row"], "left").select("doc", "text", "spans")
    return joined_rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with repeated bytes cut from the texts and the length in code points renewed.

    Characters that lose a part of their bytes are dropped. A null text stays null.
    """
    number, doc, of, cuts = spare_names(docs, "row", "doc", "of", "spans")
    rows = docs.withColumn(number, _row_number(docs, key, text))
    spans = repeated_spans(rows.select(F.col(key).alias("doc"), F.col(number).alias("row"), F.col(text).alias("text")))
    spans = spans.groupBy(F.col("doc").alias(doc), F.col("row").alias(of)).agg(F.collect_list("spans").alias(cuts))
    met = packed_texts(rows, text).join(spans, (F.col(key) == F.col(doc)) & (F.col(number) == F.col(of)), "left").select(*docs.columns, cuts)
    at_text = docs.columns.index(text)
    at_length = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in text_slices(batches, limit=STEP_BYTES, text=text):
            spans_of = batch.column(batch.num_columns - 1).to_pylist()
            columns = list(batch.columns[:-1])
            texts = [None if packed is None else cut(unpack(packed), blobs)[0].decode("utf-8", "ignore") for packed, blobs in zip(columns[at_text].to_pylist(), spans_of, strict=True)]
            columns[at_text] = pa.array(texts, pa.string())
            if at_length is not None:
                old = columns[at_length].to_pylist()
                columns[at_length] = pa.array([len(t) if t is not None and b else n for t, b, n in zip(texts, spans_of, old, strict=True)], columns[at_length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return met.mapInArrow(run, docs.schema)
