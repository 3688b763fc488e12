"""The manifest against a plain version that holds whole levels, the positions of the log, and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle_manifest as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level):
    """All levels of a tree, and for each leaf its siblings before and after it, level by level."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(level)):
        path = []
        for nodes in levels[:-1]:
            start = i // 16 * 16
            path.append((nodes[start:i], nodes[i + 1 : start + 16]))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def plainly(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        found[s] = climb([leaf_of(r) for r in groups[s]])
    root, upper = climb([found[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        subroot, paths = found[s]
        for r, path in zip(groups[s], paths, strict=True):
            steps = path + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if hit else None
            digest = leaf_of(r, lowered)
            for before, after in steps:
                digest = h(*before, digest, *after)
            out.append((r["doc_id"], leaf_of(r), subroot, root, h(*[d for b, a in steps for d in b + a]), digest, digest == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def report(df):
    return sorted(map(tuple, m.tampering_report(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 16, "b": 17}, {"a": 257, "": 1, None: 33, "é": 255, "z": 256}, {"hot": 4097, "c": 18}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_equals_the_plain_version(spark, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for i in range(size):
            n += 1
            rows.append({"doc_id": n * 7 % 10_007, "text": f"Text Ä {n}" if i % 3 else None if i % 2 else "plain", "lang": None if i % 5 == 0 else "en", "source": source, "n_chars": None if i % 7 == 0 else i})
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert report(df) == plainly(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    values = [(None, None, None, None, None), (None, "X", "en", None, 1), (5, "A", "en", "s", 1), (5, "A", "en", "s", 1), (5, "B", "en", "s", 1), (10, "", "", "", 0), (10, "Long " * 400_000, "de", "s", None)]
    df = spark.createDataFrame(values, SCHEMA)
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), v, strict=True)) for v in values]
    assert report(df) == plainly(rows)
    clash = df.withColumns({c: F.lit("x") for c in ("grp", "leaf", "pos", "n", "id", "other", "_range", "Block", "path", "subroot")})
    assert report(clash) == plainly(rows)
    assert report(df.limit(0)) == []


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097])
def test_positions_of_the_log(spark, leaves):
    """The tiers' segments, put at their closed-form places, are the log that one builder would write over the whole table."""
    df = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(leaves)], SCHEMA)
    log = m.log_rows(m.build_manifest(df).groups).orderBy("position").collect()
    assert [r["position"] for r in log] == list(range(len(log)))
    height = m.levels_of(leaves, True)
    digests = [bytes.fromhex(leaf_of({"doc_id": i, "text": f"t{i}", "lang": "en", "source": "s", "n_chars": i})) for i in range(leaves)]
    assert b"".join(bytes.fromhex(r["digest"]) for r in log) == m.append_nodes(digests, height)


def test_a_changed_row_is_told_from_the_others(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(700)], SCHEMA)
    for r in m.tampering_report(df).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)
        assert (r["folded_root"] == r["root"]) == r["verified"]
