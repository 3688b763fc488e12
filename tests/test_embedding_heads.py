"""Training in one barrier stage, heads by variant, and labels of clusters against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clustering, embedding, features

NAMES = ["activity__invoices", "bucket_1_5_total_count", "bucketshare__bucket_1_5__a", "bucketshare__bucket_1_5__b", "share__grp__a", "share__grp__b"]


def test_the_number_of_tasks_changes_nothing(spark):
    rows = spark.range(500).select("id", F.array((F.col("id") % 7) / 7, F.lit(1.0), (F.col("id") % 3) / 3).alias("v"))
    one, three = (embedding.train_on_rows(rows, 2, (4,), beta=0.01, epochs=3, batches=4, rate=1e-2, tasks=n) for n in (1, 3))
    assert [h["rows"] for h in three.history] == [500] * 3
    for name, w in one.weights.items():
        np.testing.assert_allclose(w, three.weights[name], rtol=1e-6, atol=1e-9)


def test_targets_of_each_variant():
    raw = np.array([[3.0, 10.0, 0.25, 0.75, 0.5, 0.0], [1.0, 5.0, 0.0, 0.0, 0.0, 1.0]])
    means, scales, largest = raw.mean(axis=0), raw.std(axis=0) + 0.5, np.abs(raw).max(axis=0)
    x = (raw - means) / scales
    want = {"groups": raw[:, 4:], "local": raw[:, 2:4], "sizes": raw[:, 1:2] / 10}
    for variant, kinds in {"product_group": ["groups"], "bucketed": ["local", "sizes"], "hybrid": ["groups", "local", "sizes"]}.items():
        heads, targets = embedding.recommendation_heads(NAMES, means, scales, largest, variant, weight=0.5, share_weight=2.0)
        assert [h.name for h in heads] == kinds and [h.weight for h in heads] == [1.0 if k == "local" else 0.5 for k in kinds]
        found = targets(x)
        assert all(np.allclose(found[k], want[k]) for k in kinds)
    heads, targets = embedding.recommendation_heads(NAMES, means, scales, largest, "cross_sell")
    assert heads[0].binary and targets(x)["groups"].tolist() == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError, match="local, sizes"):
        embedding.recommendation_heads(NAMES[4:], means, scales, largest, "bucketed")
    with pytest.raises(ValueError, match="unknown"):
        embedding.recommendation_heads(NAMES, means, scales, largest, "other")


def plain_report(z, families, n):
    scores = {}
    for family, begins in families.items():
        own = [v for f, v in z.items() if f.startswith(tuple(begins))]
        if own:
            scores[family] = sum(max(v, 0) for v in own)
    best = sorted(scores.items(), key=lambda item: -round(item[1], 9))[:2]
    listed = lambda order: ", ".join(f"{f} ({z[f]:.2f})" for f in order[:n])
    said = "Highest decoded positive deviations fall in " + " and ".join(f"{f} ({s:.2f})" for f, s in best) + "."
    return best[0][0], said, listed(sorted(z, key=lambda f: (-z[f], f))), listed(sorted(z, key=lambda f: (z[f], f)))


def test_labels_of_clusters_equal_plain_python(spark):
    draw = np.random.default_rng(6)
    names = [*NAMES, "activity__unique_items", "time__tenure_days", "agg__margin_value__sum", "other"]
    rows, want = [], {}
    for cluster in range(5):
        z = dict(zip(names, draw.normal(0, 1.5, len(names)).tolist(), strict=True))
        if cluster == 4:
            z = dict.fromkeys(names, 0.0)  # all families tie
        rows += [(cluster, f, v) for f, v in z.items()]
        want[cluster] = plain_report(z, clustering.FAMILIES, 6)
    found = clustering.interpret(spark.createDataFrame(rows, "cluster int, feature string, z double").repartition(4)).collect()
    assert {r["cluster"]: tuple(r[1:]) for r in found} == want
    assert want[4][0] == "high activity / long-tenure buyers"


def test_rows_taken_in_parts_train_the_same(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(n, [float(x) for x in draw.standard_normal(5)]) for n in range(60)], "id bigint, v array<double>")
    whole = embedding.train_on_rows(rows, 2, (4,), beta=0.01, epochs=2, batches=2, rate=1e-2, tasks=2)
    monkeypatch.setattr(embedding, "TOGETHER", 3)
    parts = embedding.train_on_rows(rows, 2, (4,), beta=0.01, epochs=2, batches=2, rate=1e-2, tasks=2)
    assert all(np.allclose(whole.weights[k], parts.weights[k], atol=1e-9) for k in whole.weights)


def test_blocks_of_features_are_made_once(spark):
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            met.add(len(b))
            yield b

    rows = spark.createDataFrame([(c, f"f{n}", float(c + n)) for c in range(6) for n in range(3)], "customer_id bigint, feature string, value double")
    shares = rows.where("customer_id > 0 and (customer_id + value) % 2 = 0 and not (customer_id = 2 and feature = 'f2')").mapInPandas(seen, rows.schema)
    matrix = features.feature_matrix([rows], [shares.withColumn("feature", F.concat(F.lit("s"), "feature"))])
    values = {(r["customer_id"], r["feature"]): r["value"] for r in matrix.collect()}
    assert met.value == 9
    # Absent pairs of a known customer are zeros; a customer that the block doesn't know gets the median.
    assert len(values) == 30 and values[2, "sf2"] == 0.0 and values[0, "sf0"] == 3.0 and values[2, "sf0"] == 2.0
