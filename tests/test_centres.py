"""Many centres: the nearest one against brute force, sizes, and the driver's part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haptrace.operators import centres
from haptrace.operators.clusters import cluster
import haptrace.operators.models  # noqa: F401  registers the clusterer


def test_index_finds_the_nearest():
    rng = np.random.default_rng(1)
    for k, d in ((1, 2), (40, 1), (900, 3)):
        c, x = rng.normal(size=(k, d)), rng.normal(size=(3000, d)) * 2
        at, gap = centres.Index(c).nearest(x, step=700)
        all_gaps = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert np.allclose(gap, all_gaps.min(axis=1)) and np.allclose(all_gaps[np.arange(3000), at], gap)


@pytest.mark.parametrize("held", [10_000, 5])
def test_assignment_on_both_paths(spark, held, monkeypatch):
    monkeypatch.setattr(centres, "PIVOTS", 12)
    monkeypatch.setattr(centres, "DEALT_ROWS", 300)
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(1500, 2)), rng.normal(size=(200, 2))
    points = spark.createDataFrame([(*map(float, p), 1, i) for i, p in enumerate(x)], "a double, b double, w long, row long")
    table = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(c)], "c long, x array<double>")
    found = {r["row"]: (r["c"], r["gap"]) for r in centres.assign(points, ["a", "b"], table, 200, held).collect()}
    gaps = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert [found[i][0] for i in range(1500)] == gaps.argmin(axis=1).tolist()
    assert np.allclose([found[i][1] for i in range(1500)], gaps.min(axis=1))


@pytest.mark.parametrize("held", [20_000, 30])
def test_sizes_reach_the_minimum(spark, held):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 2)), np.zeros((600, 2)) + 3, rng.normal(size=(20, 2)) + 40])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(-1, None, 0.0)], "id long, a double, b double")
    out, meta = cluster("kmeans", df, ["a", "b"], {"min_touches_per_cluster": 20, "held_centres": held})
    rows = out.collect()
    sizes = np.bincount([r["cluster_label"] for r in rows if r["id"] >= 0])
    assert len(rows) == len(x) + 1 and sizes.min() >= 20 and len(sizes) == meta["k"] > 15 and meta["smallest"] == sizes.min()
    assert [r["cluster_label"] for r in rows if r["id"] == -1] == [-1]
    # Every row lies in the cluster whose centre is nearest.
    told = {r["cluster_label"]: r["x"] for r in meta["centers_table"].collect()}
    c = np.array([told[i] for i in range(meta["k"])])
    own = {r["id"]: r["cluster_label"] for r in rows}
    gaps = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    mean = np.mean(gaps[np.arange(len(x)), [own[i] for i in range(len(x))]] - gaps.min(axis=1))
    assert mean < 1e-2 * gaps.min(axis=1).mean() + 1e-9
