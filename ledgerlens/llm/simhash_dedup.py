"""SimHash near-duplicates: fingerprints that differ in few bits, found through Golay codewords.

A 64-bit fingerprint is cut into three segments. The (23, 12) Golay code gives each segment the
codewords within four bits of it, which are one or six; two segments that differ in at most two bits
share one of them, as the codeword nearest to a word between them is near enough to both. Among three
segments that differ in four bits together, some two differ in two bits together. So the keys made of
the codewords of two segments bring every pair of linked fingerprints together, and the exact
distance is then checked.

Documents with equal fingerprints are one node from the start. A key's fingerprints are compared where
they meet; only a spanning forest of the links that a task finds leaves it. Keys that more than
`BLOCK` fingerprints share are told by a count before, and dealt in pairs of blocks, so that no task ever gets
all of such a key.

Defined cases: a null or empty text has no words and the fingerprint zero, which links like any other;
rows that repeat a doc_id each get a row; an empty table gives an empty result; ties do not arise, as
the smallest doc_id names a component, and null names one only where all its ids are null; other columns are
ignored. `keep_first` leaves one row of each component: of rows that share the smallest id that with the
smallest hash of its text, and one of equal rows.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, packed_texts, spare_names, text_slices, unpacked_texts
from ledgerlens.llm.components import connected_components

SEED, MOST_BITS = 42, 4
#: Bits of the three segments, lowest first: start and length.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared in one task, and those compared by shifting sorted rows.
BLOCK, SHORT = 8192, 64
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):  # long texts in parts, so memory is bounded
        part = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint as a signed 64-bit integer) and hash, the XXH64 of the text."""

    def run(batches):
        for batch in text_slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=[key, "fp", "hash"])

    return docs.select(key, F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp bigint, hash bigint")


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each single bit; by syndrome, the error of three bits at most and the codewords that, added to the nearest one, lie at four bits."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([syndrome(1 << b) for b in range(23)], dtype=np.int64)
    error = np.zeros(2048, dtype=np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            error[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    near = np.zeros((2048, 5), dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    info = np.arange(4096, dtype=np.int64) << 11
    words = info ^ _syndromes(info, single)
    for word in words[np.bitwise_count(words) == 7].tolist():
        for bits in combinations([b for b in range(23) if word >> b & 1], 3):
            at = np.bitwise_xor.reduce(single[list(bits)])
            near[at, used[at]] = word
            used[at] += 1
    return single, error, near


def _syndromes(words: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for bit in range(23):
        out ^= np.where(words >> bit & 1, single[bit], 0)
    return out


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each word of 23 bits the numbers of the codewords within four bits: six columns, -1 where there is only one."""
    single, error, near = golay_tables()
    at = _syndromes(words, single)
    nearest = words ^ error[at]
    more = np.where(near[at] > 0, (nearest[:, None] ^ near[at]) >> 11, -1)
    return np.column_stack([nearest >> 11, more])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each the index of its fingerprint."""
    found = [codeword_indices((fps >> start) & ((1 << length) - 1)) for start, length in SEGMENTS]
    keys, rows = [], []
    for pair, (a, b) in enumerate(combinations(found, 2)):
        both = (pair << 24) | (a[:, :, None] << 12) | b[:, None, :]
        valid = (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
        row, i, j = np.nonzero(valid)
        keys.append(both[row, i, j])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to edges of a spanning forest: (node, smallest node of its component)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _absorb(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one group, breadth first: each fingerprint reached is compared with those not reached yet."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            pivot = queue.pop()
            near = np.bitwise_count((left ^ pivot).view(np.uint64)) <= MOST_BITS
            if near.any():
                hit = left[near]
                a.append(hit)
                b.append(np.full(len(hit), pivot))
                queue.extend(hit)
                left = left[~near]
    return a, b


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; runs of one key have `BLOCK` rows at most or come from a pair of blocks."""
    a, b = [], []
    border = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], border])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        more = _absorb(np.unique(fps[s : s + n]))
        a += more[0]
        b += more[1]
    short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
    k, f = keys[short], fps[short]
    for shift in range(1, min(SHORT, len(k))):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count((f[same] ^ f[same + shift]).view(np.uint64)) <= MOST_BITS]
        a.append(f[near])
        b.append(f[near + shift])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return forest(a[a != b], b[a != b])


def _link_rows(batches):
    """For mapInArrow over rows (key, fp) sorted by key within the partition: links (a, b)."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(keys, fps):
        nonlocal a, b
        more = _links(keys, fps)
        a, b = forest(np.concatenate([a, more[0]]), np.concatenate([b, more[1]]))

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        held.append((keys, fps))
        if keys[0] == keys[-1] and held[0][0][0] == keys[0]:
            continue  # the key may go on
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        held = [(keys[last:], fps[last:])]
        if last:
            add(keys[:last], fps[:last])
        if len(a) > 1 << 20:  # what a task holds is bounded; the components are joined later
            yield out(a, b)
            a, b = a[:0], b[:0]
    if held:
        add(*(np.concatenate(x) for x in zip(*held, strict=True)))
    if len(a):
        yield out(a, b)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of all pairs within four bits."""

    def emit(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(part, 4096).to_numpy(zero_copy_only=False)
                keys, rows = golay_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])

    rows = fps.select("fp").mapInArrow(emit, "key bigint, fp bigint")
    large = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    if not large.isEmpty():
        blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
        dealt = rows.join(large, "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = dealt.select(F.when(F.col("blocks") > 1, cell).otherwise(F.col("key")).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_rows, "a bigint, b bigint")


#: Parts into which the fingerprints of one component are dealt when they are told its name.
SALTS = 8


def _members(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """key, fp, hash and best, the first (id missing, id, hash) of the component, of every row."""
    own = checkpointed(fingerprints(docs, width, key, text))
    place = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"), F.col("hash"))
    first = own.groupBy("fp").agg(F.min(place).alias("first"))
    roots = checkpointed(connected_components(fingerprint_links(first)))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = linked.groupBy("root").agg(F.min("first").alias("best")).withColumn("salt", salts)
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("fp", "best")
    alone = first.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("first").alias("best"))
    return own.join(named.union(alone), "fp").withColumn("place", place)


def near_duplicate_groups(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id of every document."""
    return _members(docs, width, key, text).select(key, "fp", F.col("best.id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that which gives it its name."""
    hash_name, to, of, place = spare_names(docs, "hash", "to", "of", "place")
    members = _members(docs, width, key, text)
    stay = checkpointed(members.where(F.col("place").eqNullSafe(F.col("best"))).groupBy(F.col(key).alias(to), F.col("hash").alias(of)).agg(F.count(F.lit(1)).alias("n")))
    rows = docs.withColumn(hash_name, F.xxhash64(text))
    met = packed_texts(rows, text).join(stay, F.col(key).eqNullSafe(F.col(to)) & (F.col(hash_name) == F.col(of)), "left_semi")
    if not stay.where("n > 1").isEmpty():
        order = Window.partitionBy(key, hash_name).orderBy(*[c for c in docs.columns if c not in (key, text)] or [hash_name])
        met = met.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return unpacked_texts(met.select(docs.columns), text)
