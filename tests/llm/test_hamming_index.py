"""Recall and order against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import hamming_index as H


def brute(rows, query, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if query(i):
            scored = sorted((-(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("other"))


def test_recall_on_isotropic_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6000, 64)).astype(np.float32))]
    got = {}
    for r in H.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    hits = 0
    exact = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        for _, j, s in found:
            a, b = np.array(exact[q], np.float64), np.array(exact[j], np.float64)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        hits += len({j for _, j, _ in found} & {j for j, _ in want[q]})
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (50, [2.0, 0.0]), (7, [float("inf"), 1.0]), (1, [1.0, 0.0])]
    got = sorted(tuple(r) for r in H.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (0, 4, 2), (50, 1, 0), (50, 2, 1), (50, 3, 1), (50, 4, 2)]
    assert H.search(frame(spark, rows[3:5]), F.col("vec_id") % 50 == 0).count() == 0
    assert H.search(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 8)).astype(np.float32))]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = H.search(frame(spark, [*rows, rows[0], rows[0]]), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(n + 1, j) for n, (j, _) in enumerate(want[0])]
    other = rng.standard_normal(8).astype(np.float32).tolist()  # the id once more, with another vector: its own query
    got = H.search(frame(spark, [*rows, (0, other)]), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 2)


def test_common_length_takes_part(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (50, [0.0, 1.0])]
    got = sorted(tuple(r)[:3] for r in H.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 2), (50, 2, 1)]


def test_far_queries_get_all_their_neighbours(spark):
    """One query lies far from all others, beyond any learned radius."""
    rng = np.random.default_rng(4)
    near = rng.standard_normal(16)
    rows = [(i, (near + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1, 400) if i % 50] + [(50, (-near).tolist())]
    want = brute([(i, np.float32(v).tolist()) for i, v in rows], lambda i: i % 50 == 0, 5)
    got = sorted((r["rank"], r["vec_id"]) for r in H.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == [(n + 1, j) for n, (j, _) in enumerate(want[50])]


def test_probing_finds_all_within_radius():
    rng = np.random.default_rng(2)
    for substrings in (4, 16):
        codes = rng.integers(0, 1 << 16, (3000, substrings), dtype=np.uint16)
        codes[:200] = codes[200] ^ np.where(rng.random((200, substrings)) < 0.5, 1 << rng.integers(0, 16, (200, substrings)), 0).astype(np.uint16)
        chunk = H.Chunk(np.arange(3000), np.ones((3000, 2)), codes)
        for radius in (0, 2, 5, 9, 13, 20, 60):
            bits = H.thresholds(radius, substrings)
            assert sum(b + 1 for b in bits) == radius + 1
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[200]).sum(axis=1) <= radius)
            assert chunk.within(codes[200], radius).tolist() == want.tolist()
