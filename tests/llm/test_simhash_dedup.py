"""SimHash groups against all pairs, and the codeword keys against every word at a small distance."""

import random

import numpy as np
import xxhash

from ledgerlens.llm import components as C
from ledgerlens.llm import simhash_dedup as S


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Smallest id reachable over all pairs within four bits."""
    parent = {i: i for i in fps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_codewords_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flips = np.array([np.bitwise_or.reduce(1 << rng.choice(23, rng.integers(0, 3), replace=False), initial=0) for _ in words])
    for a, b in zip(S.codeword_indices(words), S.codeword_indices(words ^ flips), strict=True):
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(2)
    fps = rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in fps], dtype=np.uint64).view(np.int64)
    keys, rows = S.golay_keys(np.concatenate([fps, fps ^ flips]))
    own = [set() for _ in range(1000)]
    for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
        own[r].add(k)
    assert all(own[i] & own[500 + i] for i in range(500))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ß", "the"]
    texts = {}
    for i in range(160):
        if i > 20 and rng.random() < 0.5:
            words = (texts[rng.randrange(i)] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[i] = " ".join(words)
        else:
            texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 30, 200])))
    texts |= {160: None, 161: "", 162: " \n\t", 163: "THE the", 164: "the the", 165: texts[30], 166: "x " * 70000}
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in texts.items()], "doc_id bigint, text string, fp string, key int")
    rows = S.near_duplicate_groups(docs).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_groups(fps)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(fps).values()))


def test_crowded_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "SHORT", 8)
    rng = np.random.default_rng(4)
    center = 0x0123456789ABCDEF
    fps = {i: center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for i in range(120)}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in set(fps.values())]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp bigint"))
    found = {r["node"]: r["root"] for r in S.connected_components(links).collect()}
    want = brute_groups(fps)
    groups = {}
    for i, f in fps.items():
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[i], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_empty_table_and_repeated_rows(spark):
    assert S.near_duplicate_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id bigint, text string")
    assert [r["component_id"] for r in S.near_duplicate_groups(twice).collect()] == [1, 1]


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    same, other, near = "a b c d e f", "quite another text with many words in it", " ".join(f"w{k}" for k in range(400))
    rows = [(None, same, "p"), (5, same, "q"), (5, same, "r"), (None, other, "s"), (7, near, "t"), (7, "unlike the rest of all texts here", "u"), (9, near + " end", "v"), (9, "this one stands alone in the table", "w"), (None, None, "x"), (None, "", "y")]
    kept = sorted(r["tag"] for r in S.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, tag string")).collect())
    assert len(kept) == 6
    assert set(kept) >= {"s", "t", "u", "w"}
    assert len(set(kept) & {"q", "r"}) == len(set(kept) & {"x", "y"}) == 1
    assert "p" not in kept and "v" not in kept


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_EDGES", 4)
    rng = random.Random(6)
    edges = [(rng.choice([100, 200, 300]), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)] + [(300, 520)]
    parent = {n: n for e in edges for n in e}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in C.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}
