"""Arrays of NumPy read by ranges and written in parts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import arrays


@pytest.fixture(scope="module")
def source(spark):
    arrays.register(spark)
    return spark.read.format("npy")


def matrix_of(df):
    return np.array([r["values"] for r in df.orderBy("row").collect()])


@pytest.mark.parametrize("dtype", ["<f8", "<f4", ">i4"])
def test_a_matrix_larger_than_a_task(spark, source, tmp_path, dtype):
    x = np.random.default_rng(1).normal(0, 100, (5000, 7)).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    df = spark.read.format("npy").option("range", 10_000).load(str(tmp_path / "x.npy"))
    assert df.rdd.getNumPartitions() >= 10 and (matrix_of(df) == x).all()
    assert df.where("row = 4321").first()["values"] == x[4321].tolist()
    df.repartition(3).write.format("npy").mode("append").save(str(tmp_path / "copy"))
    assert (matrix_of(spark.read.format("npy").option("range", 10_000).load(str(tmp_path / "copy"))) == x).all()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_of_archives_and_sparse_matrices(spark, source, tmp_path, save):
    draw = np.random.default_rng(2)
    m = (draw.random((300, 40)) < 0.1) * draw.normal(size=(300, 40))
    m[5:9] = 0
    i, j = np.nonzero(m)
    save(tmp_path / "m.npz", data=m[i, j], indices=j.astype(np.int32), indptr=np.searchsorted(i, np.arange(301)).astype(np.int32), shape=np.array(m.shape), format=np.array(b"csr"), ids=np.arange(9))
    path = str(tmp_path / "m.npz")
    found = spark.read.format("npy").option("sparse", "true").option("range", 100).load(path)
    assert found.rdd.getNumPartitions() > 5
    assert {(r["row"], r["col"]): r["value"] for r in found.collect()} == {(a, b): m[a, b] for a, b in zip(i, j, strict=True)}
    assert matrix_of(spark.read.format("npy").option("member", "ids").load(path)).ravel().tolist() == list(range(9))


def test_a_write_is_whole_or_not_there(spark, source, tmp_path):
    path = tmp_path / "a"
    good = spark.range(100).select(F.col("id").alias("row"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("values"))
    bad = good.withColumn("values", F.when(F.col("row") == 60, F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4, "row").write.format("npy").mode("append").save(str(path))
    assert not (path / "manifest.json").exists()
    good.write.format("npy").mode("append").save(str(path))
    with pytest.raises(Exception, match="there already"):
        good.write.format("npy").mode("append").save(str(path))
    good.limit(3).write.format("npy").mode("overwrite").save(str(path))
    assert spark.read.format("npy").load(str(path)).count() == 3
    assert len(list(path.glob("*.rows.npy"))) == len(json.loads((path / "manifest.json").read_text())["parts"])


def test_what_is_no_matrix(spark, source, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "e.npy", np.zeros((0, 4)))
    (tmp_path / "t.npy").write_text("text and nothing else")
    assert spark.read.format("npy").load(str(tmp_path / "e.npy")).count() == 0
    for name, why in (("f", "columns"), ("t", "not an npy")):
        with pytest.raises(Exception, match=why):
            spark.read.format("npy").load(str(tmp_path / f"{name}.npy")).collect()
