"""Strata of the Ward tree against merging the cheapest pair first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import haptrace.operators.models  # noqa: F401  registers the clusterer
from haptrace.operators import ward
from haptrace.operators.clusters import cluster


def plain_strata(points, sensors, rows, least):
    """Sets of row numbers; merges the cheapest of all pairs until one is left, then cuts from the root."""
    clusters = {i: ([i], np.array(p), 1) for i, p in enumerate(points)}
    tree, n = {}, len(points)
    keys = list(clusters)
    while len(keys) > 1:
        c = np.array([clusters[k][1] for k in keys])
        w = np.array([clusters[k][2] for k in keys], dtype=float)
        cost = ((c[:, None] - c[None]) ** 2).sum(axis=2) * (w[:, None] * w[None]) / (w[:, None] + w[None])
        cost[np.tril_indices(len(keys))] = np.inf
        a, b = (keys[i] for i in np.unravel_index(cost.argmin(), cost.shape))
        (ra, ca, wa), (rb, cb, wb) = clusters[a], clusters[b]
        clusters[n] = (ra + rb, (ca * wa + cb * wb) / (wa + wb), wa + wb)
        tree[n] = (a, b)
        keys = [k for k in keys if k not in (a, b)] + [n]
        n += 1
    covered = lambda k: (np.unique([sensors[i] for i in clusters[k][0]], return_counts=True)[1] >= rows).sum() >= least
    found, stack = set(), [keys[0]] if covered(keys[0]) else []
    while stack:
        k = stack.pop()
        if k in tree and all(map(covered, tree[k])):
            stack += tree[k]
        else:
            found.add(frozenset(clusters[k][0]))
    return found


def table(spark, points, sensors):
    rows = [(i, *map(float, p), s) for i, (p, s) in enumerate(zip(points, sensors))]
    names = [f"x{i}" for i in range(len(points[0]))]
    return spark.createDataFrame(rows, f"id long, {', '.join(f'{n} double' for n in names)}, session_id string").repartition(4), names


def found_strata(df, names, cover, **layout):
    held = {}
    for r in ward.ward_strata(df, names, cover, **layout).collect():
        held.setdefault((r["_leaf"], r["_n"]), set()).add(r["id"])
    assert all(k == (None, None) or len(v) == k[1] for k, v in held.items())
    return {frozenset(v) for k, v in held.items() if k != (None, None)}


@pytest.mark.parametrize("layout", [{}, {"cell_target": 4, "cell_rows": 12}, {"cell_target": 1000}])
@pytest.mark.parametrize("shape", ["even", "bunches", "wide"])
def test_equals_the_cheapest_pair_first(spark, layout, shape):
    rng = np.random.default_rng(8)
    size = 6 if shape == "wide" else 2
    points = rng.normal(size=(300, size))
    if shape == "bunches":
        points = points * 0.1 + rng.normal(size=(9, size))[rng.integers(9, size=300)] * 5
        points[:40] *= 30
    sensors = [f"s{i}" for i in rng.integers(4, size=300)]
    df, names = table(spark, points, sensors)
    for rows, least in ((3, 3), (1, 1)):
        assert found_strata(df, names, ward.Cover("session_id", rows, least), **layout) == plain_strata(points, sensors, rows, least)


def test_equal_rows_nulls_and_tables_that_are_not_covered(spark):
    points = [(1.0, 1.0)] * 30 + [(9.0, 1.0)] * 30
    sensors = [f"s{i % 2}" for i in range(60)]
    df, names = table(spark, points, sensors)
    out, meta = cluster("hierarchical", df.union(spark.createDataFrame([(99, None, 1.0, "s0")], df.schema)), names, {})
    labels = {r["id"]: r["cluster_label"] for r in out.collect()}
    assert labels.pop(99) == -1 and meta["dispersion"] == {0: 0.0, 1: 0.0}
    assert [labels[i] for i in range(60)] == [0] * 30 + [1] * 30
    for lost, options in ((df, {"min_sensor_types": 3}), (df.filter("false"), {})):
        out, meta = cluster("hierarchical", lost, names, options)
        assert meta["dispersion"] == {} and {r["cluster_label"] for r in out.collect()} <= {-1}
    out, meta = cluster("hierarchical", df.limit(1), names, {"min_instances_per_sensor": 1, "min_sensor_types": 1})
    assert [r["cluster_label"] for r in out.collect()] == [0]


def test_a_large_table(spark):
    """No task needs all rows: far bunches are merged in their own cells."""
    g = F.col("id") % 5
    noise = lambda s: F.rand(s) - 0.5
    df = spark.range(20_000).select("id", (g * 10 + noise(1)).alias("a"), (g * g + noise(2)).alias("b"), (F.col("id") % 3).cast("string").alias("session_id"))
    df = spark.createDataFrame(df.toPandas())
    out, _ = cluster("hierarchical", df, ["a", "b"], {"min_instances_per_sensor": 1000, "min_sensor_types": 3})
    sizes = {(r["cluster_label"], r["g"]): r["count"] for r in out.withColumn("g", F.col("id") % 5).groupBy("cluster_label", "g").count().collect()}
    assert sorted(sizes.values()) == [4000] * 5 and len({k for k, _ in sizes}) == 5
