"""Poses are found again from the points they project."""

import numpy as np
import pytest

from conftest import SF

from terralith.operators import pose
from terralith.plans import catalog

K = pose.Interior(500 / 3, 500 / 3, 97.5, 78.5)


@pytest.mark.parametrize("seed", range(4))
def test_pose(seed):
    rng = np.random.default_rng(seed)
    true = np.array([20000.0, 30000.0, 1000.0, *rng.uniform(-0.08, 0.08, 2), rng.uniform(-3, 3)])
    xyz = np.column_stack([20000 + rng.uniform(-300, 300, 12), 30000 + rng.uniform(-250, 250, 12), rng.uniform(0, 90, 12)])
    found, rmse = pose.solve(xyz, pose.project(true, xyz, K), K)
    assert rmse < 1e-4 and found[:3] == pytest.approx(true[:3], abs=0.01)


def test_every_image_with_enough_points_is_fitted(spark):
    points = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey").count().where("count >= 4")
    got = catalog.queries()["fit_exterior"](spark, SF).toPandas()
    assert sorted(got["filename"]) == sorted(str(r["o_custkey"]) for r in points.collect())
    assert (got["x"] - 20000).abs().max() < 0.01 and (got["z"] - 1000).abs().max() < 0.01
