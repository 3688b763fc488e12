import random
"""Toy cases with values worked out by hand, invariants, and the chain as a pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clustering, embedding, evaluation, features, graph, impute, prep, ranking, sparse
from ledgerlens.plans import cohort_export, pipeline, stages  # noqa: F401
from ledgerlens.sources import files, service
from ledgerlens.sources.transactions import transactions


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


@pytest.fixture(scope="module")
def toy(spark):
    tx = table(spark, [(1, "A", 0), (1, "B", 1), (2, "A", 0), (3, "C", 2), (3, "A", 0)], "customer bigint, item string, idx int")
    emb = table(spark, [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [5.0, 5.0])], "id bigint, v array<double>")
    return tx, emb


def test_similarity_graph(toy):
    got = edges(graph.similarity_graph(toy[1], 1, "inverse"))
    assert all(got[i, i] == 1 for i in (1, 2, 3))
    assert got[1, 2] == pytest.approx(0.909091, abs=1e-6) == got[2, 1]
    assert got[2, 3] == pytest.approx(0.124989, abs=1e-6)
    assert (1, 3) not in got
    rbf = edges(graph.similarity_graph(toy[1], 1, "rbf"))
    assert rbf[1, 2] == pytest.approx(0.606531, abs=1e-6)


def test_combined_rows_sum_to_weights(toy):
    tx, emb = toy
    users = graph.similarity_graph(emb, 2, "inverse")
    got = graph.combined(users, graph.incidence(tx, "customer", "item"), 2.0, 3.0, normalise=True)
    block = got.where(F.col("i").startswith("customer:")).groupBy("i", F.col("j").startswith("item:").alias("item")).agg(F.sum("v").alias("s")).collect()
    assert all(r["s"] == pytest.approx(3.0 if r["item"] else 2.0) for r in block)
    assert len(block) == 6


def test_neighbours_without_self(toy):
    assert graph.nearest(toy[1], 2, include_self=False, drop_first=True).groupBy("i").count().where("count <> 1").isEmpty()
    assert graph.nearest(toy[1], 2, include_self=False).groupBy("i").count().where("count <> 2").isEmpty()


KATZ = [("c1", "i1"), ("c1", "i2"), ("c2", "i2"), ("c2", "i3")]


@pytest.mark.parametrize(("steps", "normalise", "c1"), [(2, False, (1.5, 1.75, 0.25)), (4, False, (1.8125, 2.3125, 0.5)), (2, True, (0.839689, 0.625, 0.044194))])
def test_katz(spark, steps, normalise, c1):
    one = table(spark, [(a, b, 1.0) for a, b in KATZ], "i string, j string, v double")
    both = one.union(graph.transpose(one))
    full = edges(ranking.katz(both, 0.5, steps, normalise=normalise))
    rows = edges(ranking.katz(both, 0.5, steps, normalise=normalise, rows=table(spark, [("c1",)], "i string")))
    for item, want in zip(("i1", "i2", "i3"), c1, strict=True):
        assert full["c1", item] == pytest.approx(want, abs=1e-6)
        assert rows["c1", item] == pytest.approx(full["c1", item])
    assert {i for i, _ in rows} == {"c1"}
    columns = edges(ranking.katz(both, 0.5, steps, normalise=normalise, columns=table(spark, [("i2",)], "j string")))
    assert {j for _, j in columns} == {"i2"}
    assert columns["c1", "i2"] == pytest.approx(full["c1", "i2"])


def test_katz_steps():
    assert ranking.katz_steps(0.001) == 4
    assert ranking.katz_steps(0.5, 10) == 10
    assert ranking.katz_steps(0.9) == 100


def test_group_share_popularity(spark):
    rows = [(1, "a", "G1"), (1, "a", "G1"), (1, "c", "G2"), (2, "a", "G1"), (2, "b", "G1"), (2, "d", "G2"), (3, "b", "G1"), (3, "d", "G2"), (3, "e", "G2"), (3, "f", "G3")]
    got = {}
    for r in ranking.group_share_recommend(table(spark, rows, "customer_id int, item string, grp string"), 5, places=15).collect():
        got.setdefault(r["customer_id"], {})[r["item"]] = (r["rank"], r["score"])
    assert [i for i, _ in sorted(got[1].items(), key=lambda x: x[1])] == ["b", "d", "e", "f"]
    assert got[1]["b"][1] == pytest.approx(2 / 3)
    assert got[1]["f"][1] == pytest.approx(1.111111e-07, rel=1e-5)
    assert [i for i, _ in sorted(got[2].items(), key=lambda x: x[1])] == ["c", "e", "f"]
    assert got[2]["f"][1] == pytest.approx(5.555556e-08, rel=1e-5)
    assert [i for i, _ in sorted(got[3].items(), key=lambda x: x[1])] == ["c", "a"]


def plain_group_share(rows, k):
    """Every unseen item scored in full, as the definition says."""
    shares, seen, popular, total = {}, {}, {}, {}
    for c, i, g in rows:
        shares.setdefault(c, {}).setdefault(g, []).append(i)
        seen.setdefault(c, set()).add(i)
        popular.setdefault(g, {}).setdefault(i, []).append(c)
        total[i] = total.get(i, 0) + 1
    out = {}
    for c, groups in shares.items():
        n, scores = sum(map(len, groups.values())), {}
        for g, own in groups.items():
            left = {i: len(x) for i, x in popular[g].items() if i not in seen[c]}
            for i, x in left.items():
                scores[i] = scores.get(i, 0) + len(own) / n * x / sum(left.values())
        ranked = [(-round(s, 12), -10**9, i, s) for i, s in scores.items()]
        if len(scores) < k:
            rest = sum(x for i, x in total.items() if i not in seen[c])
            scale = max(scores.values()) * 1e-6 if scores else 1e-12
            ranked += [(-round(scale * x / rest, 12), -x, i, scale * x / rest) for i, x in total.items() if i not in seen[c] and i not in scores]
        out[c] = [(i, s) for _, _, i, s in sorted(ranked)[:k]]
    return out


@pytest.mark.parametrize("groups_of_item", [1, 3])
def test_group_share_equals_scoring_every_item(spark, groups_of_item):
    draw = random.Random(groups_of_item)
    rows = []
    for _ in range(700):
        item = min(int(draw.expovariate(0.05)), 79)
        rows.append((min(int(draw.expovariate(0.2)), 30), f"i{item:02d}", f"g{(item + draw.randrange(groups_of_item)) % 6}"))
    rows.append((99, "i00", "lonely"))
    got = {}
    for r in ranking.group_share_recommend(table(spark, rows, "customer_id int, item string, grp string"), 9).orderBy("customer_id", "rank").collect():
        got.setdefault(r["customer_id"], []).append((r["item"], pytest.approx(r["score"], rel=1e-9)))
    want = {c: x for c, x in plain_group_share(rows, 9).items() if x}
    assert got == want


def test_novel_tail(spark):
    rows = [(u, i, n) for u, items in (("u1", "ababc"), ("u2", "abcaa"), ("u3", "a"), ("u4", "ab")) for n, i in enumerate(items)]
    df = table(spark, rows, "customer_id string, item string, ts int")
    s = evaluation.novel_tail(df, 0.2, 2, order=("ts",))
    assert {(r["customer_id"], r["item"]) for r in s.truth.collect()} == {("u4", "b")}
    left = {r["customer_id"]: r["count"] for r in s.train.groupBy("customer_id").count().collect()}
    assert left == {"u1": 4, "u2": 5, "u3": 1, "u4": 1}
    assert {(r["customer_id"], r["item"]) for r in evaluation.novel_tail(df, 0.2, 0, order=("ts",)).truth.collect()} == {("u1", "c"), ("u4", "b")}
    last = evaluation.last_purchase(df, ("ts",))
    assert {(r["customer_id"], r["item"]) for r in last.truth.collect()} == {("u1", "c"), ("u2", "a"), ("u4", "b")}


def test_metrics(spark):
    truth = table(spark, [(1, "a"), (2, "b"), (3, "c")], "customer_id int, item string")
    rec = table(spark, [(1, "a", 1), (2, "x", 1), (2, "b", 2), (3, "y", 1)], "customer_id int, item string, rank int")
    r = evaluation.ranking_metrics(rec, truth, 10).first()
    assert (r["recall"], r["mrr"]) == (pytest.approx(2 / 3), pytest.approx(0.5))
    assert r["ndcg"] == pytest.approx(0.543643, abs=1e-6)
    assert evaluation.ranking_metrics(rec, truth.limit(0), 10).first()["recall"] == 0


def test_entropy_and_share(spark):
    df = table(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "c"), (4, None)], "customer_id int, x string")
    got = {r["customer_id"]: r["entropy"] for r in features.entropy(df, "x").collect()}
    assert got[1] == pytest.approx(0.918296, abs=1e-6)
    assert abs(got[2]) < 1e-9
    assert got[3] == pytest.approx(1)
    assert 4 not in got
    assert {r["customer_id"]: r["top_share"] for r in features.top_share(df, "x").collect()}[1] == pytest.approx(2 / 3)


def test_prep_edges(spark):
    df = table(spark, [(1, "a", 5.0, 5.0, "x"), (1, "b", 6.0, 5.0, None), (2, "a", None, 5.0, "x"), (None, "a", 1.0, 2.0, "x"), (2, None, 1.0, 2.0, "x")], "customer_id int, item string, price double, price_tx double, c string")
    kept = prep.drop_price_above(prep.drop_missing_ids(df)).collect()
    assert len(kept) == 2  # equal prices stay, a missing one stays
    assert prep.apply_null_rules(df.where("customer_id = 1"), [prep.NullRule(("c",), 0.5)]).count() == 2  # the rule is strict
    assert prep.apply_null_rules(df.where("customer_id = 1"), [prep.NullRule(("c",), 0.49)]).count() == 0
    dates = table(spark, [("9999-12-31",), ("junk",), ("",), ("2024-01-02",), (None,)], "d string")
    assert prep.parse_dates(dates, ["d"]).where("d is not null").count() == 1


def test_impute(spark):
    df = table(spark, [(1, 2.0, "a"), (1, None, None), (2, None, "b"), (2, None, "b")], "customer_id int, x double, c string")
    got = sorted((r["customer_id"], r["x"]) for r in impute.impute_numeric(df, ["x"]).collect())
    assert got == [(1, 2.0), (1, 2.0), (2, 2.0), (2, 2.0)]
    empty = impute.impute_numeric(df.withColumn("x", F.lit(None).cast("double")), ["x"]).collect()
    assert {r["x"] for r in empty} == {0.0}
    assert {r["c"] for r in impute.impute_mode(df, ["c"]).where("customer_id = 1").collect()} == {"a"}


def test_correlation_of_constants_is_null(spark):
    df = table(spark, [(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0)], "k int, x double, y double")
    assert df.agg(features.safe_correlation("x", "y").alias("r")).first()["r"] is None


def test_katz_lists_are_whole(spark):
    """No candidate is cut: all customers get ten items, as nearly all items can be reached."""
    from ledgerlens.catalog import queries

    d = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey").distinct().count()
    lists = queries()["katz_recommend"](spark, d).groupBy("customer_id").count().collect()
    assert len(lists) == customers and {r["count"] for r in lists} == {10}


def test_item_katz_ranks_items(spark):
    from ledgerlens.catalog import queries

    d = "/root/testdata/sf0.001"
    ranked = {r["item"] for r in queries()["katz_items_recommend"](spark, d).select("item").distinct().collect()}
    items = {str(r[0]) for r in transactions(spark, d).select("item").distinct().collect()}
    assert ranked and ranked <= items
    kinds = queries()["katz_whole"](spark, d).select(F.substring_index("i", ":", 1).alias("i"), F.substring_index("j", ":", 1).alias("j")).distinct()
    assert {tuple(r) for r in kinds.collect()} == {(a, b) for a in ("customer", "item") for b in ("customer", "item")}


@pytest.mark.parametrize(("tail", "name"), [("Šimić".encode("cp1250"), "Šimić"), (b"a\x81\xe9", "a\x81é"), ("Šimić".encode(), "Šimić")])
def test_late_bytes_tell_the_encoding(spark, tmp_path, tail, name):
    path = tmp_path / "late.csv"
    path.write_bytes(b"id,name\n" + b"1,plain\n" * 20_000 + b"2," + tail + b"\n")
    assert [r["name"] for r in files.read_csv(spark, str(path)).where("id = '2'").collect()] == [name]


def test_communities_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{k} {k + 1}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = files.read_communities(spark, str(path))
        assert rows.rdd.getNumPartitions() > 1
        assert sorted((r["community"], r["member"]) for r in rows.collect()) == sorted((k, m) for k in range(5000) for m in (k, k + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_autoencoder_gradients():
    rng = np.random.default_rng(0)
    x, noise = rng.standard_normal((6, 5)), rng.standard_normal((6, 2))
    heads = (embedding.Head("a", 3, 0.7), embedding.Head("b", 4, 0.5, binary=True, ranking_weight=0.3))
    model = embedding.Autoencoder((5, 4), 2, heads, seed=3)
    y = {"a": rng.standard_normal((6, 3)), "b": (rng.random((6, 4)) < 0.5).astype(float)}
    pairs = {"b": embedding._pairs(y["b"], rng)}
    _, grads = model.loss_and_gradients(x, y, 0.6, noise, pairs)
    for name in model.weights:
        at = tuple(rng.integers(0, n) for n in model.weights[name].shape)
        values = []
        for step in (1e-6, -1e-6):
            model.weights[name][at] += step
            values.append(model.loss_and_gradients(x, y, 0.6, noise, pairs)[0]["total"])
            model.weights[name][at] -= step
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-3, abs=1e-5), name


def test_autoencoder_trains_on_all_rows(spark):
    rows = spark.range(60_000).select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0), (F.col("id") % 3).cast("double")).alias("v"))
    model = embedding.train_on_rows(rows, 2, (4,), beta=0.01, epochs=2, batches=3, rate=5e-2)
    again = embedding.train_on_rows(rows.repartition(3), 2, (4,), beta=0.01, epochs=2, batches=3, rate=5e-2)
    assert [h["rows"] for h in model.history] == [60_000, 60_000]
    assert model.history[1]["reconstruction"] < model.history[0]["reconstruction"]
    for name, w in model.weights.items():
        np.testing.assert_allclose(w, again.weights[name], rtol=1e-6, atol=1e-9)


def test_autoencoder_learns_and_repeats():
    x = np.random.default_rng(1).standard_normal((200, 3)) @ np.random.default_rng(2).standard_normal((3, 8))
    a = embedding.train_autoencoder(x, 3, (16,), beta=0.01, epochs=20, rate=5e-3)
    b = embedding.train_autoencoder(x, 3, (16,), beta=0.01, epochs=20, rate=5e-3)
    assert a.history[-1]["reconstruction"] < 0.5 * a.history[0]["reconstruction"]
    assert np.isfinite(a.encode(x)).all()
    assert np.allclose(a.encode(x), b.encode(x))


def test_clusters_have_the_least_size(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (60, 2)), [[50.0, 50.0], [51.0, 50.0]]])
    df = table(spark, [(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<double>")
    for out in (clustering.adjusted_kmeans(df, 2, 20), clustering.merge_kmeans(df, 2, 20)):
        rows = out.collect()
        assert len(rows) == 122
        sizes = [r["count"] for r in out.groupBy("cluster").count().collect()]
        assert min(sizes) >= 20


def test_csv_encodings(spark, tmp_path):
    cases = {"utf-8": ("a,b\nč,1\n", "utf-8"), "bom": ("a,b\nč,1\n", "utf-8-sig"), "utf-16": ('a|b\n"č|x"|1\n', "utf-16"), "cp1250": ("a,b\nč,1\n", "cp1250")}
    for name, (text, encoding) in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode(encoding))
        rows = files.read_csv(spark, str(path)).collect()
        assert [tuple(r) for r in rows] == [("č|x" if name == "utf-16" else "č", "1")], name


def test_score_table(spark, tmp_path):
    wide = table(spark, [("12.0", "1.5", "inf", "3", 0), ("", "1", "1", "1", 1), ("7", "x", "-1", "0", 2), ("12", "2", "2", "junk", 3)], "customer_id string, p string, q string, r string, n int")
    ranked = files.load_wide_scores(wide, order="n")
    assert sorted((r["customer"], r["rank"], r["item"]) for r in ranked.collect()) == [("12", 1, "p"), ("12", 2, "q")]
    model = files.ScoreTable(ranked)
    assert service.answer(model, "12", 1) == (200, {"customer_id": "12", "items": [{"item_id": "p", "score": 2.0}]})
    assert service.answer(model, "99")[0] == 404
    assert service.answer(None, "1")[0] == 503
    assert service.answer(model, "12", 101)[0] == 422
    files.write_wide_scores(table(spark, [(1, "b", 0.5), (2, "a", 1.0)], "customer_id int, item string, score double"), str(tmp_path / "wide"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "wide")).collect()]
    assert sorted(lines) == ["1,0.0,0.5", "2,1.0,0.0", "customer_id,a,b"]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# comment\n1\t2\n2 3\n")
    (tmp_path / "c.txt").write_text("1\t2\t3\n4 5\n")
    assert [(r["i"], r["j"]) for r in files.read_edges(spark, str(tmp_path / "e.txt")).collect()] == [(1, 2), (2, 3)]
    assert [(r["community"], r["member"]) for r in files.read_communities(spark, str(tmp_path / "c.txt")).collect()] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]


def test_pipeline_contracts():
    bad = {"stage1": {"use": "katz"}}
    with pytest.raises(ValueError, match="not produced"):
        pipeline.Pipeline(bad).validate({"transactions": "dataframe"})
    with pytest.raises(ValueError, match="missing stage2"):
        pipeline.ordered_stages({"stage1": {}, "stage3": {}})
    assert pipeline.resolved({"a": {"b": 3}, "c": "${a.b}", "d": "x${a.b}"}) == {"a": {"b": 3}, "c": 3, "d": "x3"}
    with pytest.raises(KeyError):
        pipeline.resolved({"c": "${a.b}"})
    assert len(list(pipeline.grid({"x": [1, 2, 3], "y": [1, 2]}))) == 6
    assert len(list(pipeline.grid({"x": [1, 2, 3], "y": [1, 2]}, 4))) == 4


def test_chain_ranks_rows_of_customers_alone(spark, monkeypatch):
    """The lists of all rows and columns, from the rows of customers; weights of 0 take the longer way."""
    from ledgerlens.operators import ranking
    from ledgerlens.plans import stages

    bought = [(c, f"p{(c * k) % 11}") for c in range(1, 13) for k in (1, 2, 5)]
    clean = table(spark, bought, "customer_id bigint, item string").distinct()
    for low in (0.5, 0.0):
        users = table(spark, [(a, a % 12 + 1, low if a == 3 else 0.5 + a / 7) for a in range(1, 13)], "i bigint, j bigint, v double")
        both = graph.combined(users, graph.incidence(clean, "customer_id", "item"), 0.3)
        columns = both.where("j like 'item:%'").select("j").distinct()
        scores = ranking.item_scores(ranking.katz(both, 0.1, 2, normalise=True, columns=columns, places=9))
        seen = clean.withColumn("customer_id", F.col("customer_id").cast("string"))
        want = {(r["customer_id"], r["rank"], r["item"]) for r in ranking.recommend(scores, seen, 3).collect()}
        if low:
            monkeypatch.setattr(ranking, "recommend", None)
        got = {(r["customer_id"], r["rank"], r["item"]) for r in stages.rank(both, clean, k=3)["recommendations"].collect()}
        monkeypatch.undo()
        assert got == want and len(want) > 20


def test_random_graph_is_drawn_by_all_tasks(spark):
    """The same pairs as by the number drawn, also at the ends of its range, and of one file's nodes many tasks take some."""
    nodes = spark.range(60).coalesce(1)
    pairs = nodes.join(nodes.withColumnRenamed("id", "j"), F.col("id") < F.col("j"))
    for share in (0.0, 0.3, 1.0):
        want = {(r["id"], r["j"]) for r in pairs.where(graph.draw("id", "j", 1) < share).collect()}
        found = graph.random_symmetric(nodes, share)
        got = {(r["i"], r["j"]) for r in found.collect()}
        assert got == want | {(j, i) for i, j in want}
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_masked_edges(spark):
    g = graph.random_symmetric(spark.range(40), 0.3)
    left, removed = graph.mask_edges(g, g.select("i").distinct().where("i < 5"), 0.2, 3)
    per_row = [r["count"] for r in removed.groupBy("i").count().collect()]
    assert per_row and max(per_row) <= 3
    assert math.isclose(g.count() - left.count(), 2 * removed.select(F.least("i", "j"), F.greatest("i", "j")).distinct().count())


def test_labels_must_fit(spark):
    customers = table(spark, [(1,), (2,)], "customer_id int")
    good = table(spark, [(1, 0), (2, 1), (3, 1)], "customer_id int, cluster int")
    assert graph.aligned_labels(customers, good).count() == 2
    with pytest.raises(KeyError):
        graph.aligned_labels(customers, good.where("customer_id <> 2"))
    with pytest.raises(ValueError, match="several"):
        graph.aligned_labels(customers, good.union(good))


def test_wide_scores_come_back(spark, tmp_path):
    rows = [("1", 'a "b", c', 0.5), ("1", "d", 1e-9), ("x, y", "d", 2.0), ("z", "d", 0.0)]
    scores = table(spark, rows, "customer_id string, item string, score double")
    files.write_wide_scores(scores, str(tmp_path / "w"), items=table(spark, [('a "b", c',), ("d",), ("never",)], "item string"))
    found = sorted(tuple(r) for r in files.read_wide_scores(spark, str(tmp_path / "w")).collect())
    assert found == sorted(rows[:3])
    files.write_wide_scores(scores.limit(0), str(tmp_path / "none"))
    assert files.read_wide_scores(spark, str(tmp_path / "none")).count() == 0


def test_wide_scores_of_many_columns_are_found_among_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 100_000)
    assert list(files.line_entries(b'"a,0.0",0.0,0.5,1e-09,-1.0,junk,NaN,0.0,7.0', 8))[:2] == [(('"a,0.0"', 2), 0.5), (('"a,0.0"', 3), 1e-09)]
    assert [n for (_, n), _ in files.line_entries(b'"a,0.0",0.0,0.5,1e-09,-1.0,junk,NaN,0.0,7.0', 8)] == [2, 3, 6, 8]
    rows = [(c, f"P{(c * 37 + n * 101) % 5000}", (n + 1) / 7) for c in range(40) for n in range(3)]
    scores = table(spark, rows, "customer_id int, item string, score double")
    files.write_wide_scores(scores, str(tmp_path / "w"), items=spark.range(5000).selectExpr("concat('P', id) AS item"))
    found = files.read_wide_scores(spark, str(tmp_path / "w")).collect()
    assert sorted((int(r["customer"]), r["item"], r["score"]) for r in found) == sorted(rows)
    # 800,000 bytes of zeros are no bytes of the files, and lie in several parts.
    parts = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(parts) > 3 and sum(p.stat().st_size for p in parts) < 200_000
    with pytest.raises(Exception, match="several scores"):
        files.write_wide_scores(scores.union(scores), str(tmp_path / "twice"))


def test_artifacts_and_leaderboard_come_back(spark, tmp_path):
    made = {"a": table(spark, [(1, "x"), (2, None)], "n int, s string"), "b": table(spark, [(1.5, [1, 2])], "v double, l array<int>"), "c": table(spark, [(3,)], "n int")}
    files.write_artifacts(str(tmp_path), made, {"seed": 1}, spark, {"a": "csv", "b": "json"})
    found = files.read_artifacts(str(tmp_path), ["a", "b", "c"], spark)
    assert {n: sorted(map(str, f.collect())) for n, f in found.items()} == {n: sorted(map(str, f.collect())) for n, f in made.items()}
    assert files.read_manifest(str(tmp_path), spark)["notes"] == {"seed": 1}
    with pytest.raises(KeyError):
        files.read_artifacts(str(tmp_path), ["lacking"], spark)
    files.write_leaderboard(table(spark, [("b", 0.1, 0.2, 0.3), ("a", 0.1, 0.2, 0.3), ("c", 0.5, 0.2, 0.1)], "run_id string, ndcg double, recall double, mrr double"), str(tmp_path))
    assert [r["run_id"] for r in spark.read.json(str(tmp_path / "results.jsonl")).collect()] == ["c", "a", "b"]


def test_cohorts_export_each_customer_once(spark, tmp_path):
    def bought(items, customer):
        return [(customer, item, "g", n, n, n, n, 1, 1.0, 1.0) for n, item in enumerate(items)]

    schema = "customer_id int, item string, grp string, order_date int, invoice_no int, line_no int, item_idx int, supplier int, qty double, price double"
    small = table(spark, bought("aaaab", 1) + bought("aab", 2) + bought("b", 3), schema)
    raw = table(spark, bought("aaaab", 1) + bought("aabc", 2) + bought("bd", 3) + bought("e", 4) + [(None, *bought("z", 0)[0][1:])], schema)
    lists = cohort_export.write(str(tmp_path), [small, raw.where("customer_id < 3")], raw, support=1, k=2)
    got = {(r["customer_id"], r["dataset"], r["rank"], r["item"]) for r in lists.collect()}
    assert {(c, d) for c, d, _, _ in got if c in (3, 4)} == {(3, 3), (4, 3)}
    # The first table evaluates 1 and 2, but has nothing new for them.
    assert not any(c in (1, 2) for c, *_ in got)
    assert {i for c, _, _, i in got if c == 4} == {"a", "b"}
    notes = files.read_manifest(str(tmp_path), spark)["notes"]
    assert (notes["items"], notes["cohort_customers"], notes["fallback_customers"]) == (6, 0, 2)
    sizes = cohort_export.definitions(cohort_export.memberships([small, raw], support=1)).orderBy("dataset").collect()
    assert sizes[0]["cohort_size"] == sizes[0]["evaluated"] == 2 and sizes[1]["cumulative"] == sum(r["cohort_size"] for r in sizes)


def test_last_row_of_a_single_purchase(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01")]
    tx = table(spark, rows, "customer_id int, item string, day string")
    assert {r["customer_id"]: r["item"] for r in evaluation.last_rows(tx, ("day",)).collect()} == {1: "b", 2: "c"}
    assert [r["item"] for r in evaluation.last_purchase(tx, ("day",)).truth.collect()] == ["b"]


def test_outer_alignment_keeps_nulls(spark):
    one = table(spark, [(1, "a", 1.0), (2, "a", None)], "customer_id int, feature string, value double")
    two = table(spark, [(1, "s", 0.5), (1, "t", 0.5), (3, "t", 1.0)], "customer_id int, feature string, value double")
    got = features.outer_aligned([one], [two]).groupBy("customer_id").agg(F.count("value").alias("set"), F.count("*").alias("n")).collect()
    assert {r["customer_id"]: (r["set"], r["n"]) for r in got} == {1: (3, 3), 2: (0, 3), 3: (2, 3)}
    assert features.feature_matrix([one], [two]).where("value is null").isEmpty()


def test_mean_times_are_whole_numbers(spark):
    # 999 sums of 2**50 - 1 lie far beyond the whole numbers of a double.
    micros = 2**50 - 1
    rows = spark.range(999).select(F.lit(1).alias("customer_id"), F.timestamp_micros(F.lit(micros)).alias("day")).union(spark.sql("select 1, cast(null as timestamp)")).union(spark.sql("select 2, cast(null as timestamp)"))
    got = impute.impute_timestamps(rows, ["day"]).select(F.unix_micros("day").alias("m")).distinct().collect()
    assert [r["m"] for r in got] == [micros]


def test_group_share_lists_are_not_shuffled(spark):
    rows = [(c, f"P{(c * 7 + n * n) % 40}", f"G{(c * 7 + n * n) % 40 % 3}") for c in range(30) for n in range(6)]
    lists = ranking.group_share_recommend(table(spark, rows, "customer_id int, item string, grp string"), 4, fallback=False)
    assert "Window" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert lists.groupBy("customer_id").count().where("count <> 4").isEmpty()


def test_decimals_round_as_spark_does(spark):
    values = [0.0000005, 0.1234565, 0.1234564999999999, 2.5e-7, 1.0000005, 0.3, 1234.5678905]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert list(sparse.decimals(np.array(values), 6) / 1e6) == want


def test_onehot_features_join_the_lines_once(spark):
    from __spark_entry__ import queries

    made = queries()["agg_10_features_onehot"](spark, "/root/testdata/sf0.001")
    assert not [f for f in made.inputFiles() if "lineitem" in f or "orders" in f]
    assert made.select("customer_id").distinct().count() == made.count() > 0
