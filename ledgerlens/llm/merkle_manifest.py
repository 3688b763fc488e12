"""Merkle dataset manifest: a postorder log of digests for each group of rows, with proofs taken from it by position.

A row is a leaf; a group's leaves ascend by their key. Every 16 consecutive nodes of a level, the last run
with fewer, become a node of the next, until one is left, the group's subroot; the subroots, in the order
of the groups, become the root in the same way. H is SHA-256 as lowercase hex, over digests as hex text.

Aligned builders: 256 consecutive leaves of a group are a block, built by one task that appends each node
to the block's segment of the log when it is complete: a leaf, and after the last leaf of a run its
parent. The tops of 256 blocks are the leaves of a block one tier up, and so on, so a group of any size
is built by tasks of 256 digests each, in log_256(rows) tiers, and the largest group is spread like any
other. Where a node stands in the log follows from the sizes of the subtrees completed before it
(`postorder`), so siblings are read by position, without a search or a join on nodes.

Going down, each block receives the siblings of its top from the tier above, by a join of one row for
each block, and gives its leaves theirs.

Defined cases: a null group is a group of its own and comes first, null keys come first in their group,
equal keys go by their leaf digest, and equal rows are leaves each. A null text or other field is hashed
as `-`, an empty one as `0:`. Long texts are hashed by Spark's own functions and never enter Python. An
empty table has no root and gives an empty result. Other columns of the table are not part of a leaf and
take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import checkpointed

FAN = 16
#: Levels of a block above its leaves.
HEIGHT = 2
BLOCK = FAN**HEIGHT
DIGEST = 32
#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Log:
    """`segments[t]` holds tier t: (grp, block, n, rows, nodes), n being the leaves of its group in that tier; `roots`: (grp, tier, root)."""

    segments: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    groups: Log
    top: Log
    root: str | None


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def group_key(group: Column) -> Column:
    """A text that is never null, in the order of the groups, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def levels_of(leaves: int, whole: bool) -> int:
    """Levels above the leaves of a block: as many as leave one node, or HEIGHT where the group goes on above it."""
    if not whole:
        return HEIGHT
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def postorder(level: int, index: int, leaves: int, height: int) -> int:
    """Place from 0, in completion order, of node `index` of `level` in a tree of `leaves` and `height`.

    Before it stand all nodes of its own and lower levels up to its last leaf, and of the levels above it
    those completed before its first leaf.
    """
    first, end = index * FAN**level, min((index + 1) * FAN**level, leaves)
    return sum(-(-end // FAN**m) for m in range(level + 1)) + sum(first // FAN**m for m in range(level + 1, height + 1)) - 1


def append_nodes(leaves: Sequence[bytes], height: int) -> bytes:
    """The segment of a block: its nodes in the order in which they are complete."""
    log, open_runs = bytearray(), [[] for _ in range(height + 1)]

    def append(level: int, digest: bytes) -> None:
        log.extend(digest)
        open_runs[level].append(digest)
        if level < height and len(open_runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, sha256(b"".join(d.hex().encode() for d in run)))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return bytes(log)


def step(run: Sequence[bytes], own: int) -> bytes:
    """One level of a proof: the place in the run, then the other digests from left to right."""
    return bytes([own]) + b"".join(run[:own]) + b"".join(run[own + 1 :])


def proof_steps(nodes: bytes, leaves: int, height: int) -> Iterator[list[bytes]]:
    """For each leaf of a segment its steps up to the segment's top; siblings are read at their postorder places."""
    runs = []
    for level in range(height):
        count = -(-leaves // FAN**level)
        places = [postorder(level, i, leaves, height) * DIGEST for i in range(count)]
        level_nodes = [nodes[p : p + DIGEST] for p in places]
        runs.append([level_nodes[i : i + FAN] for i in range(0, count, FAN)])
    above: dict[tuple[int, int], bytes] = {}
    for leaf in range(leaves):
        steps = []
        for level in range(height):
            index = leaf // FAN**level
            if level == 0:
                steps.append(step(runs[0][index // FAN], index % FAN))
            else:
                if (level, index) not in above:
                    above[level, index] = step(runs[level][index // FAN], index % FAN)
                steps.append(above[level, index])
        yield steps


def fold(digest: bytes, path: Sequence[bytes]) -> bytes:
    """The top that the digest and the siblings of its path give."""
    for s in path:
        cut = 1 + s[0] * DIGEST
        digest = sha256((s[1:cut].hex() + digest.hex() + s[cut:].hex()).encode())
    return digest


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """The rows of (grp, ...) with `pos` from 0 in their group, in the given total order, and `n`, the group's rows.

    The table is cut into ranges of (group, order), so a large group lies in many ranges.
    """
    ranged = checkpointed(leaves.repartitionByRange("grp", *order).withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy("grp")
    counts = ranged.groupBy("grp", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("grp", "_range", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("n"))
    own = F.row_number().over(Window.partitionBy("grp", "_range").orderBy(*order))
    met = ranged.withColumn("_own", own).join(starts, ["grp", "_range"])
    return met.withColumn("pos", F.col("_start") + F.col("_own") - 1).drop("_range", "_own", "_start")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _with_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks (grp, block, n, rows) with their segments of the log."""

    def run(batches):
        for batch in _slices(batches):
            segments = []
            for n, rows in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                segments.append(append_nodes([r["leaf"] for r in rows], levels_of(len(rows), n <= BLOCK)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segments, pa.binary())], names=[*batch.schema.names, "nodes"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("nodes", T.BinaryType())]))


def build_log(leaves: DataFrame, payload: Sequence[str] = ()) -> Log:
    """The log of leaves (grp, pos, n, leaf, payload...): tiers of blocks up to one block for each group."""
    segments, roots = [], None
    rows, names = leaves, ["pos", "leaf", *payload]
    while True:
        blocks = rows.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
        tier = checkpointed(_with_nodes(blocks))
        segments.append(tier)
        tops = tier.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})").alias("leaf"), (F.col("n") <= BLOCK).alias("_done"))
        done = tops.where("_done").select("grp", F.lit(len(segments) - 1).alias("tier"), F.col("leaf").alias("root"))
        roots = done if roots is None else roots.union(done)
        rows, names = tops.where("not _done"), ["pos", "leaf"]
        if rows.isEmpty():
            return Log(segments, roots)


def log_rows(log: Log) -> DataFrame:
    """The log as a table (grp, position, level, digest): positions run from 0 without gaps in each group."""
    out = None
    for tier, segment in enumerate(log.segments):
        base = tier * HEIGHT

        def run(batches, tier=tier, base=base):
            for batch in _slices(batches):
                found = []
                for grp, block, n, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # n counts this tier's leaves; as leaves of the whole tree the last may be incomplete, which changes no place before it.
                    size, held = min(BLOCK, n - block * BLOCK), levels_of(min(BLOCK, n - block * BLOCK), n <= BLOCK)
                    for level in range(1 if tier else 0, held + 1):
                        for i in range(-(-size // FAN**level)):
                            p = postorder(level, i, size, held) * DIGEST
                            found.append((grp, base + level, block * FAN ** (HEIGHT - level) + i, nodes[p : p + DIGEST].hex()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["grp", "level", "index", "digest"])

        part = segment.select("grp", "block", "n", "nodes").mapInArrow(run, "grp string, level bigint, index bigint, digest string")
        out = part if out is None else out.union(part)
    leaves = log.segments[0].select("grp", "n").groupBy("grp").agg(F.max("n").alias("leaves"))
    # The closed form again, as a Spark expression over the whole tree.
    top = HEIGHT * len(log.segments)
    first, end = F.col("index") * F.pow(F.lit(FAN), F.col("level")), F.least((F.col("index") + 1) * F.pow(F.lit(FAN), F.col("level")), F.col("leaves"))
    place = F.lit(-1.0)
    for m in range(top + 1):
        place += F.when(F.col("level") >= m, F.ceil(end / FAN**m)).otherwise(F.floor(first / FAN**m))
    return out.join(leaves, "grp").select("grp", place.cast("long").alias("position"), "level", "digest")


def hand_down(log: Log, start: DataFrame) -> DataFrame:
    """Blocks of the lowest tier with the steps above their tops: (grp, block, n, rows, nodes, path, subroot).

    `start` holds (grp, path, subroot) for each group: the steps from its root on.
    """
    above = None
    for tier in range(len(log.segments) - 1, -1, -1):
        ends = log.roots.where(F.col("tier") == tier).select("grp").join(start, "grp").select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot")
        above = ends if above is None else above.union(ends)
        met = log.segments[tier].join(above, ["grp", "block"])
        if tier == 0:
            return met

        def run(batches):
            for batch in _slices(batches):
                out = []
                for grp, n, rows, nodes, path, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for row, steps in zip(rows, proof_steps(nodes, len(rows), levels_of(len(rows), n <= BLOCK)), strict=True):
                        out.append((grp, row["pos"], [*steps, *path], subroot))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary()), strict=True)], names=["grp", "block", "path", "subroot"])

        above = met.select("grp", "n", "rows", "nodes", "path", "subroot").mapInArrow(run, "grp string, block bigint, path array<binary>, subroot binary")
    raise AssertionError("a log has a tier")


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", extra: Callable[[], Column] | None = None) -> Manifest:
    """Logs of all groups and of their subroots. `extra` gives a digest that is kept beside each leaf (`other`)."""
    other = extra() if extra is not None else F.lit(None).cast("binary")
    leaves = docs.select(group_key(F.col(group)).alias("grp"), F.col(key).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("copy"))
    # Written once: ranges are chosen from digests, not from texts read anew.
    leaves = checkpointed(leaves)
    groups = build_log(placed(leaves, "id", "leaf", "copy").select("grp", "pos", "n", "leaf", "id", "other"), ["id", "other"])
    subroots = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"))
    top = build_log(placed(subroots, "id"), ["id"])
    root = top.roots.select(F.hex("root")).first()
    return Manifest(groups, top, root and root[0].lower())


def prove(manifest: Manifest) -> DataFrame:
    """(id, leaf, other, path, subroot) of every leaf; the path holds one step for each level that has a run, up to the root."""

    def run(batches):
        for batch in _slices(batches, 8):
            out = []
            for n, rows, nodes, path, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row, steps in zip(rows, proof_steps(nodes, len(rows), levels_of(len(rows), n <= BLOCK)), strict=True):
                    out.append((row["id"], row["leaf"], row["other"], [*steps, *path], subroot))
            if out:
                ids, leaf, other, paths, subroots = zip(*out, strict=True)
                id_type = batch.column(1).type.value_type.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(leaf, pa.binary()), pa.array(other, pa.binary()), pa.array(paths, pa.list_(pa.binary())), pa.array(subroots, pa.binary())], names=["id", "leaf", "other", "path", "subroot"])

    nothing = F.array().cast("array<binary>")
    start = manifest.top.roots.select("grp", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"))
    sources = hand_down(manifest.top, start).select("n", "rows", "nodes", "path", "subroot")
    sources = sources.withColumn("rows", F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["leaf"].alias("leaf"), r["id"].alias("id"), F.lit(None).cast("binary").alias("other"))))
    upper = sources.mapInArrow(run, "id string, leaf binary, other binary, path array<binary>, subroot binary").select(F.col("id").alias("grp"), "path", F.col("leaf").alias("subroot"))
    blocks = hand_down(manifest.groups, checkpointed(upper)).select("n", "rows", "nodes", "path", "subroot")
    kind = blocks.schema["rows"].dataType.elementType["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.BinaryType()) for c in ("leaf", "other")), T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("subroot", T.BinaryType())])
    return blocks.mapInArrow(run, schema)


def verify(proofs: DataFrame, digest: Column) -> DataFrame:
    """The proofs with `proof_sha256`, H of all siblings, and `folded_root`, the root that the digest and its siblings give."""

    def run(batches):
        for batch in _slices(batches, 1024):
            siblings = [sha256("".join(s[1:].hex() for s in path).encode()).hex() for path in batch.column(batch.num_columns - 2).to_pylist()]
            roots = [fold(d, path).hex() for d, path in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(siblings, pa.string()), pa.array(roots, pa.string())], names=[*batch.schema.names[:-2], "proof_sha256", "folded_root"])

    kept = [f for f in proofs.schema.fields if f.name != "path"]
    schema = T.StructType([*kept, T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())])
    return proofs.select(*[f.name for f in kept], "path", digest.alias("_digest")).mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampering_report(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and the root that it folds to once every fifth (by CRC-32 of the id) has its text lower-cased."""
    docs = docs.select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit & F.col("text").isNotNull(), leaf_digest([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    manifest = build_manifest(docs, extra=lambda: tampered)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    checked = verify(prove(manifest), F.coalesce("other", "leaf"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    root = F.lit(manifest.root)
    return checked.select(F.col("id").alias("doc_id"), text("leaf"), text("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
