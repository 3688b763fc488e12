"""Neighbours by pivots against all distances, the share of blocks that meet, and silhouettes of several labelings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clustering, graph, neighbours


def clustered(n, groups, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 20, (groups, 6))
    return centres[draw.integers(0, groups, n)] + draw.normal(0, spread, (n, 6))


def brute(x, ids, most, with_self):
    out = set()
    for i, a in zip(ids, x, strict=True):
        d = np.round(np.sqrt(((x - a) ** 2).sum(axis=1)), 9)
        order = sorted(range(len(ids)), key=lambda n: (ids[n] != i if with_self else 0, d[n], ids[n]))
        order = [n for n in order if with_self or ids[n] != i][:most]
        out |= {(i, ids[n], d[n]) for n in order}
    return out


def best(found, most, with_self):
    rows = {}
    for r in found.collect():
        rows.setdefault(r["i"], []).append((r["j"] != r["i"] if with_self else 0, r["d"], r["j"]))
    return {(i, j, d) for i, own in rows.items() for _, d, j in sorted(own)[:most]}


@pytest.mark.parametrize(("spread", "with_self", "ids"), [(0.3, True, int), (0.3, False, "n{:04d}".format), (30.0, False, int)])
def test_neighbours_equal_all_distances(spark, spread, with_self, ids):
    x = clustered(1500, 12, spread, 1)
    x[700:720] = x[3]  # copies, all at distance 0
    names = [ids(i) for i in range(len(x))]
    rows = spark.createDataFrame(list(zip(names, x.tolist(), strict=True)), f"id {'bigint' if ids is int else 'string'}, vector array<double>")
    met = neighbours.meetings(rows, 5, with_self, 9, size=60)
    assert best(met.found, 5, with_self) == brute(x, names, 5, with_self)
    assert met.met < 0.3 * met.every if spread < 1 else met.met <= met.every


def test_fewer_rows_than_neighbours_and_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id bigint, v array<double>")
    assert {(r["i"], r["j"], r["d"], r["rank"]) for r in graph.nearest(rows, 5).collect()} == {(1, 1, 0.0, 1), (1, 2, 5.0, 2), (2, 2, 0.0, 1), (2, 1, 5.0, 2)}
    wild = rows.union(spark.createDataFrame([(4, [float("nan"), 0.0])], rows.schema))
    assert {(r["i"], r["j"]) for r in graph.nearest(wild, 1, include_self=False).where("i < 4").collect()} == {(1, 2), (2, 1)}
    assert graph.nearest(rows.limit(0), 2).collect() == []


def test_silhouettes_in_one_pass_equal_single_ones(spark):
    x = clustered(300, 4, 3.0, 2)
    labels = [[i % k for k in (2, 3, 4, 5)] + [i if i < 3 else -1] for i in range(len(x))]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id bigint, v array<double>")
    several = spark.createDataFrame(list(enumerate(labels)), "id bigint, clusters array<int>")
    together = {r["labeling"]: r["silhouette"] for r in clustering.silhouettes(v, several).collect()}
    for n in range(5):
        assert clustering.silhouette(v, several.select("id", F.col("clusters")[n].alias("cluster"))).first()[0] == pytest.approx(together[n], abs=1e-12)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_blocks_pass_by_groups_and_only_the_best_leave(spark, monkeypatch, offset):
    """Blocks in few groups; far from the origin single precision tells nothing, and what leaves is the best of each vector alone."""
    monkeypatch.setattr(neighbours, "GROUPS", 3)
    x = np.round(clustered(600, 5, 8.0, 3), 3) + offset
    x[100:110] = x[3]
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "id bigint, vector array<double>")
    found = neighbours.meetings(rows, 5, True, 9, size=50).found
    assert {(r["i"], r["j"], r["d"]) for r in found.collect()} == brute(x, list(range(600)), 5, True)


def test_silhouettes_shuffle_blocks_once_for_each_group(spark, monkeypatch):
    """Blocks in few groups, copies, a cluster of one, and vectors far from the origin."""
    from ledgerlens.operators import pairwise

    monkeypatch.setattr(pairwise, "BLOCK", 40)
    monkeypatch.setattr(pairwise, "GROUPS", 3)
    x = clustered(300, 4, 3.0, 2) + 1e5
    x[50:60] = x[3]
    label = np.array([i % 3 for i in range(299)] + [9])
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id bigint, v array<double>")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id bigint, cluster int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = []
    for i in range(300):
        others = np.arange(300) != i
        means = {c: d[i, others & (label == c)].mean() for c in set(label[others].tolist())}
        own = means.pop(int(label[i]), None)
        want.append(0.0 if own is None else (min(means.values()) - own) / max(min(means.values()), own))
    assert clustering.silhouette(v, labels).first()[0] == pytest.approx(np.mean(want), abs=1e-10)
    rows = v.join(labels, "id").select(F.col("id").cast("string").alias("id"), F.array(F.col("cluster").cast("long")).alias("tag"), F.col("v").alias("vector"))
    # One row for each row and cluster: blocks add up before anything leaves.
    sums = pairwise.cluster_sums(rows)
    assert sums.count() == 300 * 4 - 1
