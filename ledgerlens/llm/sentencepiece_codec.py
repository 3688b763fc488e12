"""SentencePiece encoding with byte spans of the original text, and decoding.

The normaliser walks the compiled character map by longest prefix and records, for every byte it
writes, the byte of the source it came from. The library's own BPE then segments the normalised
text, and each piece is projected through that record to a byte span of the original.

Defined cases: a null text is an empty text; an empty text has no ids, no spans and decodes to "";
repeated rows are encoded each on their own; an empty table gives an empty result; columns other
than the key and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ChunkCache, text_slices

#: What sentencepiece writes for a space, and for bytes that are not UTF-8.
SPACE, BAD_BYTE = "▁", "�"
#: Field numbers of the model's protocol buffer (sentencepiece_model.proto).
PIECES, NORMALIZER = 1, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, BYTE = 1, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _to_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def fields(data: bytes) -> Iterator[tuple[int, int, bytes | int, bytes]]:
    """(field number, wire type, value, the field's own bytes) of a protocol buffer message."""
    at = 0
    while at < len(data):
        began = at
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[wire]
            value, at = data[at : at + size], at + size
        yield number, wire, value, data[began:at]


class CharsMap:
    """A compiled character map: a double-array trie whose values are offsets of replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest key that starts at `at`, and its replacement; (0, None) without one."""
        if not self.units:
            return 0, None
        units = self.units
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node, found, value = offset(units[0]), 0, None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found, value = k + 1 - at, units[node] & 0x7FFFFFFF
        if value is None:
            return 0, None
        return found, self.strings[value : self.strings.index(b"\0", value)]


def _char_length(text: bytes, at: int) -> int:
    """Bytes of the valid UTF-8 character at `at`; 0 if it is not valid."""
    lead = text[at]
    n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    try:
        text[at : at + n].decode("utf-8")
    except UnicodeDecodeError:
        return 0
    return n if at + n <= len(text) else 0


@dataclass
class Normalizer:
    charsmap: CharsMap
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it comes from."""
        if not self.charsmap.units and not self.remove_extra:
            return self._without_map(text)
        symbol = SPACE.encode() if self.escape else b" "
        out, origin = bytearray(), []
        at, space_before = 0, self.remove_extra
        units = []
        while at < len(text):
            used, new = self.charsmap.longest(text, at)
            if new is None:
                used = _char_length(text, at)
                new = text[at : at + used] if used else BAD_BYTE.encode()
                used = used or 1
            units.append((at, new))
            at += used
        if self.remove_extra:  # spaces that open the text go before the prefix is written
            while units and units[0][1] == b" ":
                units.pop(0)
        if not units:
            return b"", np.array([len(text)], dtype=np.int64)
        if self.dummy_prefix:
            out += symbol
            origin += [units[0][0]] * len(symbol)
        for start, new in units:
            while space_before and new.startswith(b" "):
                new = new[1:]
            if new:
                written = new.replace(b" ", symbol)
                out += written
                origin += [start] * len(written)
                space_before = new.endswith(b" ")
            if not self.remove_extra:
                space_before = False
        end = len(text)
        if self.remove_extra:
            while out.endswith(symbol):
                end = origin[len(out) - len(symbol)]
                del out[-len(symbol) :], origin[-len(symbol) :]
        return bytes(out), np.array([*origin, end], dtype=np.int64)

    def _without_map(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map that keeps spaces: every byte stands for itself, a space for the symbol's three."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        symbol = SPACE.encode() if self.escape else b" "
        widths = np.ones(len(text), dtype=np.int64)
        widths[np.frombuffer(text, dtype=np.uint8) == 0x20] = len(symbol)
        lead = len(symbol) if self.dummy_prefix else 0
        origin = np.concatenate([np.zeros(lead, dtype=np.int64), np.repeat(np.arange(len(text)), widths), [len(text)]])
        return symbol * bool(lead) + text.replace(b" ", symbol), origin


@dataclass(frozen=True)
class Encoded:
    """What one text became: ids as bytes of int32, their decimal form, what they decode to, and spans."""

    ids: np.ndarray
    decimal: bytes
    decoded: bytes
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """Encodes with one model file; build one for each Python worker through `codec(path)`."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            data = f.read()
        pieces, spec, kept = [], {}, bytearray()
        for number, wire, value, raw in fields(data):
            if number == NORMALIZER:
                spec = {k: v for k, _, v, _ in fields(value)}
                continue
            if number == PIECES:
                own = {k: v for k, _, v, _ in fields(value)}
                pieces.append((own[PIECE_TEXT].decode(), own.get(PIECE_TYPE, NORMAL)))
            kept += raw
        self.normalize = Normalizer(CharsMap(spec.get(CHARSMAP, b"")), bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(REMOVE_EXTRA, 1)), bool(spec.get(ESCAPE, 1)))
        # The same pieces behind a normaliser that changes nothing: it segments text that is normalised already.
        bare = b"".join(_to_varint(k << 3) + b"\0" for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        bare = _to_varint(1 << 3 | 2) + b"\x08identity" + bare
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bytes(kept) + _to_varint(NORMALIZER << 3 | 2) + _to_varint(len(bare)) + bare)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [p for p, kind in pieces if kind == NORMAL]
        # Chunks can be segmented apart only where no piece reaches over their border.
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        line = "\n" if not any("\n" in p for p in normal) else ""
        self.chunk = re.compile(f"{line}|{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.width = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in pieces], dtype=np.int64)
        self.is_byte = np.array([kind == BYTE for _, kind in pieces])
        self.decimal = [str(i).encode() for i in range(len(pieces))]
        alone = self.segmenter.encode("\n") if line else []
        self.line = alone[0] if len(alone) == 1 and alone[0] != self.segmenter.unk_id() else 0
        self.unknown = self.segmenter.unk_id()
        self.cache = ChunkCache(self._segment)

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Where a line feed is a piece of its own, one call segments all, with it in between."""
        if not self.line or "\n" in chunks:
            return [array("i", x).tobytes() for x in self.segmenter.encode(chunks, num_threads=1)]
        ids = np.array(self.segmenter.encode("\n".join(chunks)), dtype="<i4")
        borders = (np.flatnonzero(ids == self.line) * 4).tolist()
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip([0, *(b + 4 for b in borders)], [*borders, len(raw)], strict=True)]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids, the alignment and the normalised text."""
        raw = text.encode("utf-8", "surrogatepass")
        normal, origin = self.normalize(raw)
        written = normal.decode("utf-8", "replace")
        chunks = self.chunk.findall(written) if self.separable else [written] * bool(written)
        return np.frombuffer(b"".join(self.cache.lookup(chunks)), dtype="<i4"), origin, normal

    def encode(self, text: str | None) -> Encoded:
        ids, origin, normal = self.ids(text or "")
        plain = ids.tolist()
        widths = self.width[ids]
        if self.unknown in ids:  # without byte fallback the unknown piece covers what was left: find its width in the text
            widths = self._unknown_widths(ids, normal)
        ends = np.cumsum(widths)
        decoded = self.library.decode(plain) if plain else ""
        return Encoded(ids, b",".join(map(self.decimal.__getitem__, plain)), decoded.encode("utf-8", "surrogatepass"), origin[ends - widths], origin[ends])

    def _unknown_widths(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        pieces = self.segmenter.encode(normal.decode("utf-8", "replace"), out_type=str)
        return np.array([1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], dtype=np.int64)


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, ids, starts and ends (original byte spans), decoded text."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string"

    def run(batches):
        own = codec(model_file)
        for batch in text_slices(batches):
            found = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.ids for x in found], pa.list_(pa.int32())), pa.array([x.starts for x in found], pa.list_(pa.int64())), pa.array([x.ends for x in found], pa.list_(pa.int64())), pa.array([x.decoded.decode("utf-8", "replace") for x in found], pa.string())], names=[key, "ids", "starts", "ends", "decoded"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same encoding reduced in the task to counts and digests; spans_crc32 covers starts then ends."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"

    def run(batches):
        own = codec(model_file)
        for batch in text_slices(batches):
            rows = [[], [], [], []]
            for value in batch.column(1).to_pylist():
                x = own.encode(value)
                rows[0].append(len(x.ids))
                rows[1].append(hashlib.sha256(x.decimal).hexdigest())
                rows[2].append(hashlib.sha256(x.decoded).hexdigest())
                rows[3].append(zlib.crc32(x.ends.astype("<i8").tobytes(), zlib.crc32(x.starts.astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists; a null list is an empty one."""

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            texts = [own.library.decode([int(i) for i in x or []]) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")
