"""Fits take many groups at a time, and a group that two batches share is fitted whole."""

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF

from terralith.operators import gcpcamera, groups, pose
from terralith.plans import catalog

K = pose.Interior(500 / 3, 500 / 3, 97.5, 78.5)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["fit_exterior", "gcp_camera"])
def test_no_call_a_group(spark, name):
    assert "FlatMapGroups" not in plan(catalog.queries()[name](spark, SF))


def test_groups_stay_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500).selectExpr("if(id < 300, 'big', if(id < 310, null, concat('k', id % 50))) as k", "id")
        fit = lambda t, s: pa.table({"k": t.column("k").take(pa.array(s)), "n": np.add.reduceat(t.column("id").to_numpy(), s)})
        got = {r["k"]: r["n"] for r in groups.in_batches(rows, "k", fit, "k string, n long", least=20).collect()}
        want = {r["k"]: r["n"] for r in rows.groupBy("k").agg({"id": "sum"}).toDF("k", "n").collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_poses_side_by_side():
    rng = np.random.default_rng(5)
    true = np.column_stack([20000 + rng.uniform(-9, 9, 9), 30000 + rng.uniform(-9, 9, 9), np.full(9, 1000.0), rng.uniform(-0.08, 0.08, (9, 2)), rng.uniform(-3, 3, 9)])
    xyz = [np.column_stack([20000 + rng.uniform(-300, 300, n), 30000 + rng.uniform(-250, 250, n), rng.uniform(0, 90, n)]) for n in range(4, 13)]
    px = [pose.project(p, x, K) for p, x in zip(true, xyz, strict=True)]
    found, rmse = pose.solve_all(np.concatenate(xyz), np.concatenate(px), np.r_[0, np.cumsum([len(x) for x in xyz])[:-1]], K)
    alone = np.array([pose.solve(a, b, K)[0] for a, b in zip(xyz, px, strict=True)])
    assert found == pytest.approx(alone, abs=1e-6) and rmse.max() < 1e-4


def test_polynomials_of_unlike_images(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, n in enumerate((2, 3, 5, 6, 9, 10, 17, 40)):
        lon, lat = rng.uniform(24, 25, n), rng.uniform(-34, -33, n)
        j, i = 5000 * (lon - 24) + 300 * (lat + 33), 200 * (lon - 24) - 4000 * (lat + 33)
        rows += [(f"a{k}", *map(float, r)) for r in zip(j, i, lon, lat, strict=True)]
        if n > 2:
            want[f"a{k}"] = (n, gcpcamera.order_for(n))
    fitted = gcpcamera.fit(spark.createDataFrame(rows, "filename string, j double, i double, lon double, lat double"))
    from pyspark.sql import functions as F

    j, i = gcpcamera.to_pixel(F.lit(24.5), F.lit(-33.5))
    got = fitted.select("filename", "points", "order", j.alias("j"), i.alias("i")).collect()
    assert {r["filename"]: (r["points"], r["order"]) for r in got} == want
    assert all(r["j"] == pytest.approx(2350, abs=1e-5) and r["i"] == pytest.approx(2100, abs=1e-5) for r in got)
