"""Runs are read back whole, or not at all."""

import shutil

import pytest
from pyspark.errors import AnalysisException

from ledgerlens.sources import runs


def test_runs_are_whole_or_not_there(spark, tmp_path):
    folder = str(tmp_path)
    table = spark.createDataFrame([(1, [0.5, 1.5])], "id bigint, v array<double>")
    one = runs.log_run(spark, folder, {"beta": 0.7, "k": 10}, [{"recall": 0.5, "mrr": 0.25}, {"recall": 1.0, "mrr": 0.75}], {"embedding": table}, {"mode": "validation"})
    two = runs.log_run(spark, folder, {"beta": 0.9}, [], run="second")
    notes, metrics, tables = runs.read_run(spark, folder, one)
    assert notes == {"params": {"beta": 0.7, "k": 10}, "tags": {"mode": "validation"}}
    assert {tuple(r) for r in metrics.collect()} == {(0, "recall", 0.5), (0, "mrr", 0.25), (1, "recall", 1.0), (1, "mrr", 0.75)}
    assert [tuple(r) for r in tables["embedding"].collect()] == [(1, [0.5, 1.5])]
    assert {tuple(r) for r in runs.summarised(metrics).collect()} == {("recall", 0.75, 0.25, 0.5, 1.0), ("mrr", 0.5, 0.25, 0.25, 0.75)}
    assert {r["run"] for r in runs.list_runs(spark, folder).collect()} == {one, two}
    shutil.rmtree(tmp_path / one / "manifest")  # as if the run had died before its end
    assert [(r["run"], r["params"]) for r in runs.list_runs(spark, folder).collect()] == [(two, '{"beta":0.9}')]
    with pytest.raises(AnalysisException):
        runs.read_run(spark, folder, one)
    with pytest.raises(ValueError, match="metrics"):
        runs.log_run(spark, folder, {}, [], {"metrics": table})
