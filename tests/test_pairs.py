"""Pairs counted in shards against plain counting."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph, ranking


@pytest.mark.parametrize(("shards", "size"), [(64, 64 << 20), (3, 64 << 20), (1, 500)])
def test_pairs_equal_plain_counting(spark, monkeypatch, shards, size):
    monkeypatch.setattr(ranking, "SHARDS", shards)
    monkeypatch.setattr(ranking, "SHARD_BYTES", size)
    draw = np.random.default_rng(7)
    baskets = {c: {f"i{int(x)}" for x in draw.zipf(1.4, draw.integers(1, 30)) if x < 200} for c in range(80)}
    baskets[80] = {f"i{n}" for n in range(200)}  # one that has everything
    rows = [(c, i) for c, own in baskets.items() for i in own]
    least = 3
    want = {p: n for p, n in Counter(p for own in baskets.values() for p in permutations(own, 2)).items() if n >= least}
    df = spark.createDataFrame([*rows, *rows[:50], (5, None)], "customer_id bigint, item string")
    found = ranking.pair_rules(df, least).collect()
    assert {(r["i"], r["j"]): r["n_both"] for r in found} == want
    single = Counter(i for own in baskets.values() for i in own)
    total = sum(1 for own in baskets.values() if own)
    for r in found[:20]:
        assert r["confidence"] == pytest.approx(r["n_both"] / single[r["i"]])
        assert r["lift"] == pytest.approx(r["n_both"] * total / single[r["i"]] / single[r["j"]]) and r["support"] == pytest.approx(r["n_both"] / total)


def test_no_frequent_item(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id bigint, item string")
    assert ranking.pair_rules(df, 2).collect() == [] and ranking.pair_rules(df.limit(0), 1).collect() == []


def test_pairs_of_a_cluster_are_dealt(spark, monkeypatch):
    """One large cluster, repeated rows, nulls: the pairs of a join, over several tasks."""
    monkeypatch.setattr(graph, "MEMBERS", 10)
    rows = [(n, 1) for n in range(90)] + [(5, 1), (None, 1), (100, 2), (101, None), (102, None)]
    df = spark.createDataFrame(rows, "customer_id bigint, cluster int")
    found = graph.same_cluster(df)
    want = Counter((a, b) for a, x in rows for b, y in rows if x is not None and x == y)
    assert Counter((r["i"], r["j"]) for r in found.collect()) == want
    assert found.select(F.spark_partition_id()).distinct().count() > 4
    assert graph.same_cluster(df.limit(0)).isEmpty()


def test_counting_some_at_a_time(monkeypatch):
    """Pairs are counted as they come, in room for those that occur: no table of all items."""
    monkeypatch.setattr(ranking, "SHARD_BYTES", 800)
    numbers = np.random.default_rng(2).integers(0, 1 << 50, 300)[np.random.default_rng(3).integers(0, 300, 20_000)]
    held = ranking.Counted()
    for part in np.array_split(numbers, 90):
        held.add(part)
    keys, counts = held.done()
    want = Counter(numbers.tolist())
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
