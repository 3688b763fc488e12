"""Searches share stages: by key in a session, and by manifest in a folder."""

import json

import pytest

from ledgerlens.plans import pipeline, stages
from ledgerlens.sources.transactions import transactions

CALLS = []


@pytest.fixture
def toy(monkeypatch):
    """Three stages that count their runs; the last one recommends what the parameter says."""
    CALLS.clear()
    monkeypatch.setattr(pipeline, "STAGES", dict(pipeline.STAGES))
    table, scores = pipeline.ArtifactSpec("features", "matrix"), pipeline.ArtifactSpec("recommendations", "scores")

    @pipeline.stage("toy_features", [pipeline.ArtifactSpec("transactions", "dataframe")], [table])
    def one(transactions, seed=0):
        CALLS.append("features")
        return {"features": transactions.selectExpr("customer_id", f"{seed} AS seed").distinct()}

    @pipeline.stage("toy_rank", [table], [scores])
    def two(features, k=1):
        CALLS.append("rank")
        return {"recommendations": features.selectExpr("customer_id", f"{k} AS k", "seed")}

    return lambda seed=0, k=1: {"stage1": {"use": "toy_features", "params": {"seed": seed}}, "stage2": {"use": "toy_rank", "params": {"k": k}}}


def test_runs_share_what_they_agree_on(spark, toy, tmp_path):
    rows = spark.createDataFrame([(1,), (2,), (1,)], "customer_id bigint")
    cache = pipeline.StageCache()
    found = [pipeline.Pipeline(toy(k=k)).run(cache, transactions=rows)["recommendations"].first()["k"] for k in (1, 2, 3, 1)]
    assert found == [1, 2, 3, 1] and CALLS == ["features", "rank", "rank", "rank"]
    pipeline.Pipeline(toy(seed=5)).run(cache, transactions=rows)
    pipeline.Pipeline(toy()).run(cache, transactions=spark.createDataFrame([(9,)], "customer_id bigint"))
    assert CALLS.count("features") == 3
    pipeline.Pipeline(toy()).run(transactions=rows)
    assert CALLS.count("features") == 4

    for _ in range(2):  # the second cache knows only the folder
        kept = pipeline.StageCache(tmp_path)
        out = pipeline.Pipeline(toy(k=7)).run(kept, {"transactions": "rows of the first day"}, transactions=rows)
        assert out["recommendations"].count() == 2
    assert CALLS.count("features") == 5
    (part,) = [p for p in tmp_path.iterdir() if json.loads((p / "manifest.json").read_text()) == ["features"]]
    (part / "manifest.json").unlink()  # as if the run had died before the end
    pipeline.Pipeline(toy(k=7)).run(pipeline.StageCache(tmp_path), {"transactions": "rows of the first day"}, transactions=rows)
    assert CALLS.count("features") == 6 and (part / "manifest.json").exists()


def test_a_search_makes_features_once(spark, monkeypatch):
    """Four points of the space of twenty, on a few customers, with one Katz step of ten entries a row."""
    tx = transactions(spark, "/root/testdata/sf0.001").where("customer_id <= 30")
    ran = []
    for name, stage in list(pipeline.STAGES.items()):
        counted = pipeline.Stage(stage.name, lambda _f=stage.run, _n=name, **more: (ran.append(_n), _f(**more))[1], stage.inputs, stage.outputs)
        monkeypatch.setitem(pipeline.STAGES, name, counted)
    space = {"weight_customers": stages.KATZ_SPACE["weight_customers"][:2], "beta": stages.KATZ_SPACE["beta"][:2]}
    found = stages.search(lambda **v: stages.katz_config(**v, neighbours=3, components=4, max_iter=1, most_per_row=10), space, tx)
    assert len(found) == 4 and {(r["weight_customers"], r["beta"]) for r in found} == {(w, b) for w in space["weight_customers"] for b in space["beta"]}
    assert [ran.count(n) for n in ("prepare", "group_share_features", "pca", "similarity_graph", "katz")] == [1, 1, 1, 2, 4]
    assert found == pipeline.leaderboard(found)
    assert len(list(pipeline.grid(stages.KATZ_SPACE))) == 20


def test_validation_makes_lists_for_drawn_users_alone(spark, monkeypatch):
    from ledgerlens.catalog import queries
    from ledgerlens.operators import ranking

    asked, real = [], ranking.group_share_recommend
    monkeypatch.setattr(ranking, "group_share_recommend", lambda rows, k, **options: asked.append(options["wanted"].count()) or real(rows, k, **options))
    assert len(queries()["validation_run"](spark, "/root/testdata/sf0.001").collect()) == 3
    assert len(asked) == 3 and max(asked) <= 200
