"""Percentiles of large groups: no join brings a whole group into one task."""

from pyspark.sql import functions as F

from haptrace.operators.quantiles import percentiles


def test_large_groups_are_not_shuffled_by_their_keys(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5000 * 1.0).alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = percentiles(df, ["g"], {"m": ("x", 0.5)}, limit=500)
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
        assert {r.g: r.m for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
