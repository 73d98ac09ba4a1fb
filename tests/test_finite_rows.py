"""Rows without finite features don't stop a clusterer."""

import pytest
from pyspark.sql import functions as F

from haptrace.operators import models  # noqa: F401
from haptrace.operators.clusters import cluster


@pytest.mark.parametrize("name, least", [("kmeans", "min_touches_per_cluster"), ("gmm", "min_touches_per_component")])
def test_rows_without_finite_features_are_noise(spark, name, least):
    df = spark.range(240).selectExpr("id", "CAST(id % 2 * 50 + id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    odd = spark.sql("SELECT 1000L AS id, CAST(NULL AS DOUBLE) AS x, 1D AS y UNION ALL SELECT 1001L, 1D, CAST('NaN' AS DOUBLE) UNION ALL SELECT 1002L, CAST('Infinity' AS DOUBLE), 1D")
    out, meta = cluster(name, df.unionByName(odd), ["x", "y"], {least: 100, "n_init": 2})
    got = {r["id"]: r["cluster_label"] for r in out.collect()}
    assert len(got) == 243 and {i for i, c in got.items() if c == -1} == {1000, 1001, 1002}
    assert meta["k"] == 2 and len({got[i] for i in range(0, 240, 2)}) == len({got[i] for i in range(1, 240, 2)}) == 1
