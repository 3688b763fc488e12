"""Codes, errors and codebooks against plain Python integers; the search against all entries; edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import product_codes as p


def plainly(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    length = len(kept[0][1]) // parts
    vectors = [[[math.floor(4096 * x) for x in r[1][q * length : (q + 1) * length]] for q in range(parts)] for r in kept]
    books = [[list(v[q]) for v in vectors[:entries]] for q in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for q in range(parts):
            fallen = {}
            for v in vectors:
                fallen.setdefault(best(v[q], books[q])[1], []).append(v[q])
            for i, own in fallen.items():
                books[q][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, vectors, strict=True):
        found = [best(v[q], books[q]) for q in range(parts)]
        out.append([r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]])
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    return sorted(((a, b, c, by_label[label], digest) for a, b, c, label in out), key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def digests(df):
    return sorted(map(tuple, p.code_digests(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 5, 16, 17, 400])
def test_equals_the_plain_version(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % 401, [float(x) for x in np.float32(rng.normal(size=24))], None if i % 4 == 0 else i % 7) for i in range(n)]
    assert digests(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


def test_ties_repeats_nulls_and_clashing_names(spark):
    grid = [[float((i >> b) % 3 - 1) / 4096 for b in range(16)] for i in range(60)]
    rows = [(i // 2, v, i % 2) for i, v in enumerate(grid)] * 2 + [(None, grid[3], None), (1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, 1), (5, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(df) == plainly(rows)
    assert digests(df.withColumns({c: F.lit("x") for c in ("code", "Error", "_label", "_n", "label_error", "part", "n", "s0")})) == plainly(rows)
    assert digests(df.limit(0)) == []
    coded = p.encode(df.withColumn("CODE", F.lit("mine")), p.fit_codebooks(df))
    assert coded.columns == ["vec_id", "label", "CODE", "code_", "error"]
    assert coded.where("CODE = 'mine'").count() == len(rows) - 5


def test_another_length_takes_no_part_and_odd_lengths_are_filled_up(spark):
    rows = [(i, [float(i % 5), 1.0, 0.25 * i], 0) for i in range(20)] + [(-1, [1.0] * 64, 0)]
    found = digests(spark.createDataFrame(rows, SCHEMA))
    assert found == plainly([(i, v + [0.0] * 5, label) for i, v, label in rows[:-1]])


def test_far_components_are_an_error():
    import pyarrow as pa

    with pytest.raises(OverflowError):
        p.integer_parts(pa.array([[1e30] * 8]), 8)


@pytest.mark.parametrize("spread", [1, 3, 5000])
def test_search_equals_all_entries(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 16):
        book, points = rng.integers(-spread, spread + 1, (k, 8)), rng.integers(-spread, spread + 1, (3000, 8))
        all_of_them = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = p.nearest_entries(points, book)
        assert (index == all_of_them.argmin(axis=1)).all() and (best == all_of_them.min(axis=1)).all()


def test_a_hot_label_and_rare_ones(spark):
    rows = spark.createDataFrame([(0 if i % 3 else None if i % 2 else i, i) for i in range(5000)], "label int, error bigint")
    want = {}
    for r in rows.collect():
        want[r[0]] = want.get(r[0], 0) + r[1]
    found = p.with_group_sum(rows, "label", "error", "total").collect()
    assert len(found) == 5000 and all(r["total"] == want[r["label"]] for r in found)
