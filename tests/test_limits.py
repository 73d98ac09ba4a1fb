"""Registered queries give the same rows when no group fits a task."""

import pytest
from pyspark.sql import functions as F

from haptrace.plans import registry
from haptrace.session import CHUNK_ROWS_CONF, GROUP_ROWS_CONF

SF = "/root/testdata/sf0.001"
NAMES = ["session_forward_fill", "touch_gap_fill", "equal_frequency_bins", "outlier_bounds", "normalised_quartiles", "ks_pairs", "mann_whitney", "kruskal_wallis", "spearman"]


def rows(spark, name):
    return sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_small_limits_change_nothing(spark, name):
    registry.load_all()
    expected = rows(spark, name)
    spark.conf.set(GROUP_ROWS_CONF, "20")
    spark.conf.set(CHUNK_ROWS_CONF, "64")
    try:
        assert expected and rows(spark, name) == expected
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
        spark.conf.unset(CHUNK_ROWS_CONF)


def test_percentiles_of_small_and_large_groups_are_joined_back(spark):
    """Both paths in one table, joined by shuffle: the union must not pass for hashed on its keys (F5, F6, F7)."""
    from haptrace.operators.quantiles import percentiles

    df = spark.range(4000).selectExpr("CAST(sqrt(id) AS INT) % 9 % 5 AS g", "CAST(id * 7919 % 1000 AS DOUBLE) AS v")
    expected = sorted(map(tuple, df.groupBy("g").agg(F.percentile("v", F.lit(0.5)), F.count("*")).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = df.join(percentiles(df, ["g"], {"m": ("v", 0.5)}, limit=600), "g")
        plan = [line.strip(" :+-") for line in back._jdf.queryExecution().executedPlan().toString().splitlines()]
        above = [plan[i - 1] for i, line in enumerate(plan) if line.startswith("Union")]
        assert above and all(line.startswith("Exchange") for line in above)
        assert sorted(map(tuple, back.groupBy("g", "m").agg(F.count("*")).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
