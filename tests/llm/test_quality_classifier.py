"""Context sums against plain counting, pooling in pieces, calibration, held-out labels, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_classifier as q
from ledgerlens.llm.queries import op12_quality_classifier

SCHEMA = "doc_id bigint, text string"


def test_context_sums_are_those_of_plain_counting(spark):
    texts = ["the cat sat on the mat.", "The CAT\tsat!! on", "", None, "a", "ünïcode 12 words_and | | | more words " * 40]
    index, buckets = q.index_vectors().astype(int), q.Buckets()
    assert (np.abs(index).sum(axis=1) == q.NONZERO).all()
    sums, counts = {}, {}
    for t in texts * 3:
        ids = buckets.of(t).tolist()
        for i, w in enumerate(ids):
            counts[w] = counts.get(w, 0) + 1
            near = [ids[k] for k in range(max(0, i - q.WINDOW), min(len(ids), i + q.WINDOW + 1)) if k != i]
            sums[w] = sums.get(w, 0) + sum((index[c] for c in near), np.zeros(q.DIMENSIONS, int))
    docs = spark.createDataFrame(list(enumerate(texts * 3)), SCHEMA).repartition(5)
    found = q.context_sums(docs).collect()
    assert {r["bucket"]: r["n"] for r in found} == counts
    assert all(list(r[2:]) == sums[r["bucket"]].tolist() for r in found)


def test_long_texts_add_up_over_pieces(monkeypatch):
    draw = np.random.default_rng(1)
    ids, vectors = draw.integers(0, q.BUCKETS, 1000).astype(np.int32), draw.normal(size=(q.BUCKETS, q.DIMENSIONS)).astype(np.float32)
    index = q.index_vectors()
    whole, sums = q.pooled(ids, vectors), np.zeros((q.BUCKETS, q.DIMENSIONS), np.int64)
    q.add_contexts([ids], index, sums)
    monkeypatch.setattr(q, "PIECE", 37)
    again = np.zeros_like(sums)
    q.add_contexts([ids], index, again)
    assert np.allclose(q.pooled(ids, vectors), whole) and (sums == again).all()


def test_temperature_is_that_of_least_loss():
    draw = np.random.default_rng(2)
    true = draw.normal(0, 2, 20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert q.fit_temperature(true * 3, y) == pytest.approx(3, rel=0.05)
    assert q.fit_temperature(true / 2, y) == pytest.approx(0.5, rel=0.05)


def held_out_rows(spark, folder, labels):
    scored = op12_quality_classifier(spark, folder).collect()
    return scored, [(r["score"], labels[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in labels]


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored, pairs = held_out_rows(spark, folder, labels)
    assert len(scored) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s >= 0.7 for s in bad]) < 0.25
    assert np.mean([(s - y) ** 2 for s, y in pairs]) < 0.06


def test_labels_held_out_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"good words number {i}" if i % 2 else f"### $$$ {i}") for i in range(200)], SCHEMA)
    even = F.col("doc_id") % 3 == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    turned = labels.withColumn("quality", F.when(even, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (q.fit_quality(docs, x, ~even).network for x in (labels, turned))
    assert (one.w1 == two.w1).all() and one.temperature == two.temperature


def test_edge_cases(spark):
    rows = [(1, "plain words in a row"), (1, "plain words in a row"), (2, None), (None, ""), (3, "long words " * 300_000), (4, "😀 \x00 #")]
    docs = spark.createDataFrame([(i, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t) for i, t in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = q.fit_quality(docs, none)
    assert model.network is None and {r["score"] for r in q.score_quality(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None), (4, 7), (None, 1), (9, 0)], "doc_id bigint, quality int")
    model = q.fit_quality(docs.withColumns({c: F.lit("x") for c in ("n", "bucket", "d0", "features", "good", "score", "quality")}), labels)
    found = q.score_quality(docs, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    empty = docs.limit(0)
    assert q.score_quality(empty, q.fit_quality(empty, labels)).collect() == []
