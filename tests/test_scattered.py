"""Points with a cell for nearly each of them, and values on the edges of even bins."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from haptrace.operators import bins as B
from haptrace.operators import density as D


def test_scattered_points_meet_in_blocks(spark, monkeypatch):
    """Several blocks give the labels of brute force; no table of neighbouring cells is made (F2)."""
    rng = np.random.default_rng(3)
    centres = rng.uniform(-3, 3, (6, 5))
    x = np.concatenate([centres[rng.integers(6, size=260)] + rng.normal(0, 0.35, (260, 5)), rng.uniform(-4, 4, (60, 5))])
    x, eps, least = np.concatenate([x, x[:20]]), 0.6, 5
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    cells = [tuple(c) for c in np.floor(x / (eps / math.sqrt(5))).astype(int)]
    root = np.arange(len(x))
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            root[i] = root[near[i] & core].min()
    lowest = {r: min(cells[i] for i in np.flatnonzero(core & (root == r))) for r in set(root[core])}
    number = {r: n for n, r in enumerate(sorted(lowest, key=lowest.get))}
    expected = [min((number[root[j]] for j in (np.flatnonzero(core & near[i]) if not core[i] else [i])), default=-1) for i in range(len(x))]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(pid=range(len(x))))
    monkeypatch.setattr(D, "BLOCK", 64)

    def no_cells(*_):
        raise AssertionError("neighbouring cells were listed")
    monkeypatch.setattr(D, "_near_cells", no_cells)
    got = [r["cluster_label"] for r in D.dbscan_labels(df, [], list("abcde"), eps, least).orderBy("pid").collect()]
    assert got == expected and max(got) >= 2 and -1 in got and (~core & (np.array(got) >= 0)).any()


def test_values_on_rounded_edges(spark):
    """An edge may be rounded above the value it stands for; the value still lies in the bin above (F8)."""
    edges = B._linspace(0.1, 2.1, 20)
    on = [round(0.1 + i / 10, 1) for i in range(20)]
    assert any(v < e for v, e in zip(on, edges))
    df = spark.createDataFrame([("a", v, v) for v in on], "k string, x double, y double")
    got = {(r["bx"], r["by"]) for r in B.histogram_2d(df, ["k"], "x", "y", edges, edges).filter("n > 0").collect()}
    assert got == {(i, i) for i in range(20)}
