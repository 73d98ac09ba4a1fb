"""Starts of k-means and mixtures are chosen in tasks, the rows they are chosen from stay there."""

import numpy as np
import pandas as pd
import pytest

from haptrace.operators import models as M
from haptrace.operators import starts as SS
from haptrace.operators.clusters import cluster


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, (2000, 2)) for c in ((0, 0), (60, -40), (120, -80))])
    return spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"])).persist()


@pytest.mark.parametrize("name, least", [("kmeans", "min_touches_per_cluster"), ("gmm", "min_touches_per_component")])
def test_the_driver_gets_no_rows(blobs, monkeypatch, name, least):
    """Of 6,000 different rows the driver sees starts and clusters only (F1, F2)."""
    got, collect = [], type(blobs).collect

    def counted(df):
        rows = collect(df)
        got.append(len(rows))
        return rows
    monkeypatch.setattr(type(blobs), "collect", counted)
    out, meta = cluster(name, blobs, ["x", "y"], {least: 1320, "n_init": 3})
    assert got and max(got) <= 40  # 3 starts of 2 to 4, or 1 to 4 clusters
    monkeypatch.undo()
    assert meta["k"] == 3 and sorted(r["count"] for r in out.groupBy("cluster_label").count().collect()) == [2000] * 3


def test_starts_are_those_of_the_drawn_rows(blobs):
    """A start found in a task is the one found from the collected rows."""
    rows, weights, values = SS.seed_rows(blobs, ["x", "y"], 6000)
    drawn, counted = SS.drawn_rows(blobs, ["x", "y"], 6000)
    assert values == counted == 6000 and len(rows) == drawn.count()
    tried = [(3, 42), (5, 43), (1, 44)]
    for made in (SS.spread_centres, M._first_moments):
        for table, (k, seed) in zip(SS.begun(drawn, ["x", "y"], tried, made), tried):
            assert np.array_equal(table, made(rows, weights, k, seed))
