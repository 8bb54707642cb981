import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import cluster, diagnostics, frames, linalg, prep
from lodestat.plans import penalties, selection, updaters
from lodestat.plans.fit import batch_ids, optimize
from lodestat.sources import tables
from lodestat.streaming import scoring


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame([(0, 0, 2.0), (1, 2, 4.0)], "i long, j long, v double")


def test_sparse_algebra_is_dense_algebra(spark, sparse):
    a = np.array([[2.0, 0, 0], [0, 0, 4]])
    x = linalg.vector([1, 2, 3], spark)
    assert {(r.i, r.v) for r in linalg.mv(sparse, x).collect()} == {(0, 2.0), (1, 12.0)}
    assert np.allclose(linalg.to_numpy(linalg.gram(sparse), 3, 3), a.T @ a)
    assert np.allclose(linalg.to_numpy(linalg.outer(sparse), 2, 2), a @ a.T)
    assert np.allclose(linalg.to_numpy(linalg.tmm(sparse, sparse), 3, 3), a.T @ a)
    assert linalg.cell(sparse, 1, 2, 2, 3) == 4 and linalg.cell(sparse, 1, 1, 2, 3) == 0
    with pytest.raises(IndexError):
        linalg.cell(sparse, 2, 0, 2, 3)


def test_svd_reconstructs(spark):
    a = np.array([[1.0, 3, 5], [2, 4, 6]])
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(2) for j in range(3)], "i long, j long, v double")
    s, v, u = linalg.svd(m, 3, 2)
    got = linalg.to_numpy(u, 2, 2)
    assert np.allclose(got * s @ v.T, a)
    assert np.allclose(np.abs(got[:, 0]), [0.6196295, 0.7848945], atol=1e-6)


def test_eigen():
    a = np.array([[1.0, 3], [3, 1]])
    assert np.allclose(linalg.eigen_symmetric(a)[0], [4, -2])
    assert linalg.power_iteration(lambda x: a @ x, 2)[0] == pytest.approx(4)
    assert np.allclose(linalg.invert(a) @ a, np.eye(2)) and linalg.log_determinant(np.eye(2) * 2) == pytest.approx(np.log(4))


def test_pca_is_consistent(spark):
    u = np.random.default_rng(0).random(50)
    x = np.c_[u, u + 2, 100 * np.random.default_rng(1).random(50)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    p = cluster.pca(df, ["a", "b", "c"])
    assert len(p.sigma) == 2
    d = x - x.mean(0)
    assert np.allclose(p.sigma, cluster.pca_from_covariance(d @ d.T, 2)[0], rtol=1e-4)
    s = p.scores(df).orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    assert np.allclose(np.linalg.norm(s, axis=0), p.sigma)


def test_prep(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "NA", "n/a"), (3, "y", "3"), (4, "x", "oops")], "id int, c string, v string")
    assert prep.categorical_columns(df, ["c", "v"]) == ["c", "v"]
    p = prep.prep(df.where("id < 4"), "id")
    rows = {r["id"]: r for r in p.frame.collect()}
    assert p.levels == {"c": ["x", "y"]} and rows[2]["c_y"] == 0.0 and rows[2]["v"] == 2.0
    assert prep.prep(df.where("id < 4"), "id", prep.MissingMode.DROP_SAMPLE).frame.count() == 2


def test_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert selection.k_fold(df, "k", 5).select("fold").distinct().count() == 4
    b = batch_ids(spark.range(103).withColumnRenamed("id", "k"), "k", 5, 1, 0).groupBy("batch").count().toPandas()
    assert b["count"].sum() == 103 and b["count"].max() - b["count"].min() <= 1
    s = selection.split(spark.range(101).withColumnRenamed("id", "k"), "k", 0.7)
    assert s.where("is_train").count() == 70
    n = selection.bootstrap(spark.range(2000).withColumnRenamed("id", "k"), "k", 3).count()
    assert 1800 < n < 2200


def test_nested_cv_and_empty_search(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(3 * a + rng.normal() * 0.1)) for i, a in enumerate(rng.normal(size=80))], "id long, x double, y double")
    train = lambda d, c, warm: optimize(d, "y", ["x"], penalty=penalties.L2(c), updater=updaters.Newton(), tail=1, start=warm)
    e, r, scored = selection.fit_with_cv(df, "y", "id", train, [0.01, 1000.0], inner=3, bags=2)
    assert e["r2"] > 0.95 and scored[0].score > scored[1].score
    with pytest.raises(ValueError):
        selection.search([], "y", [1], train)


def test_kmeans_drops_empty_clusters(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (5.0,)], "x double")
    r = cluster.kmeans(df, ["x"], np.array([[0.0], [5.0], [99.0]]), 3)
    assert len(r.centres) == 2 and r.cost == pytest.approx(0.02)


def test_kmedoid_and_linkage(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 10, 11, 12])], "id long, x double")
    r = cluster.kmedoid(cluster.distances(df, "id", ["x"]), [0, 3])
    assert r.medoids == [1, 4] and r.cost == 4
    d = np.abs(np.subtract.outer([0.0, 1, 5, 6.5], [0.0, 1, 5, 6.5]))
    assert cluster.complete_linkage(d) == [(0, 1, 1.0), (2, 3, 1.5), (4, 5, 6.5)]
    assert sorted(cluster.leaf_order(cluster.complete_linkage(d), 4)) == [0, 1, 2, 3]


def test_qq(spark):
    df = spark.createDataFrame([(i, (i + 0.5) / 200) for i in range(200)], "k long, p double")
    assert diagnostics.qq_error(df, "p", "k").first()[0] < 1e-4
    assert diagnostics.qq_normal(df, "p", "k").count() == 199
    u = diagnostics.qq_uniform(df, "p", "k").orderBy("rank").first()
    assert u["low"] < u["expected"] + 1 and u["high"] > u["low"]


def test_libsvm_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:0.5 3:2\n0 2:1\n\n")
    df = tables.read_libsvm(spark, str(tmp_path / "a.txt"))
    assert [r["features"] for r in tables.libsvm_dense(df, 3).orderBy("row_id").collect()] == [[0.5, 0, 2], [0, 1, 0]]
    assert tables.read_libsvm(spark, str(tmp_path / "a.txt"), constant=True).orderBy("row_id").first()["indices"] == [0, 1, 3]
    assert tables.libsvm_coo(df).count() == 3
    (tmp_path / "b.csv").write_text("k,x\na,1\nb,zz\n")
    got = tables.doubles(tables.read_csv(spark, str(tmp_path / "b.csv")), ["x"]).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [("a", 1.0), ("b", None)]
    tables.write_predictions(spark.createDataFrame([(1, 2.0)], "id int, p double"), "id", tables.from_log10_plus_1(F.col("p")), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["prediction"] == "99.0"


def test_json_codecs():
    assert np.isnan(tables.vector_from_json(tables.vector_json([1.0, float("nan")]))[1])
    names, v = tables.series_from_json(tables.series_json(["a", "b"], [1, 2]))
    assert names == ["a", "b"] and list(v) == [1, 2]


def test_stream_scoring(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").parquet(str(tmp_path / "in"))
    scoring.score(stream, lambda d: d.withColumn("p", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("p")).first()[0] == 90


def test_windowed_moments_of_a_stream(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:30", float(m), 3.0 * m + 1) for m in range(20)]
    spark.createDataFrame(rows, "t string, x double, y double").select(F.col("t").cast("timestamp").alias("t"), "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x double, y double").parquet(str(tmp_path / "in"))
    out = scoring.windowed_moments(stream, "t", "x", "y", "10 minutes", "1 minute")
    out.writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("moments").orderBy("window").collect()
    assert [(r.n, r.mean_x, round(r.slope, 9), round(r.r, 9)) for r in got] == [(10, 4.5, 3.0, 1.0), (10, 14.5, 3.0, 1.0)]


def test_wide_and_long(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "id int, a double, b double")
    t = frames.transposed(df, "id", ["a", "b"], [1, 2]).orderBy("j").collect()
    assert [tuple(r) for r in t] == [("a", 2.0, 4.0), ("b", 3.0, 5.0)]
    assert frames.column_difference(df, df.drop("a")) == ["a"]
    assert frames.fill(spark.createDataFrame([(float("nan"),), (2.0,)], "x double"), ["x"], "mean").agg(F.sum("x")).first()[0] == 4.0
