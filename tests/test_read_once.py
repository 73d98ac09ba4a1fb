"""Rows that several parts of an operator read are worked out once; labels don't pass through the driver."""

from pyspark.sql import functions as F

from haptrace.operators import metrics as MT
from haptrace.operators import models as M
from haptrace.operators import stats as ST
from haptrace.operators.clusters import cluster


def _counted(spark, df, column):
    """``df`` with a column that counts how often its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(count, "double").asNondeterministic()(column)), seen


def test_gestures_share_the_rows(spark):
    kind = F.element_at(F.array(F.lit("tap"), F.lit("stroke_proximal"), F.lit("stroke_distal")), (F.col("id") % 3 + 1).cast("int"))
    df, seen = _counted(spark, spark.range(90).select("id", kind.alias("gesture_type"), (F.col("id") * 1.0).alias("x")), "x")
    out, _ = cluster("type_stratified", df, ["x"], {"base": "binning", "n_bins": 3})
    assert out.select("id", "cluster_label").distinct().count() == 90
    assert seen.value == 90


def test_comparators_share_the_rows(spark):
    df = spark.range(120).select((F.col("id") % 2).cast("int").alias("cluster_label"), (F.col("id") % 3).cast("string").alias("s"), (F.col("id") % 17 * 1.0).alias("v"))
    df, seen = _counted(spark, df, "v")
    out = ST.compare(df, ["bias", "distribution"], ["cluster_label"], "s", "v").collect()
    assert sorted((r.cluster_label, r.strategy, r.n_observations) for r in out) == [
        (0, "bias", 60), (0, "distribution", 60), (1, "bias", 60), (1, "distribution", 60)]
    assert seen.value == 120


def test_rounds_are_compared_without_a_broadcast(spark, monkeypatch):
    plans, own = [], ST.adjusted_rand

    def held(df, *args):
        plans.append(df._jdf.queryExecution().sparkPlan().toString().split("InMemoryTableScan")[0])
        return own(df, *args)

    monkeypatch.setattr(M.ST, "adjusted_rand", held)
    df = spark.range(60).select("id", (F.floor(F.col("id") / 20) * 10.0 + F.col("id") % 2).alias("x"))
    assert M.stability(df, ["x"], "cartesian_binning", {"n_bins": 3}, rounds=3, keys=["id"]) == 1.0
    assert [p for p in plans if "SortMergeJoin" in p] == plans and len(plans) == 2


def test_top_share_works_out_its_rows_once(spark):
    """Counted, ranked and kept rows are the same ones; F17 worked out every hit three times."""
    df = spark.range(100).select((F.col("id") % 2).alias("s"), F.col("id").alias("vertex_id"), (F.col("id") % 10 * 1.0).alias("value"))
    df, seen = _counted(spark, df, "value")
    out = MT.top_share(df, ["s"], "value", "vertex_id").collect()
    assert sorted(r.vertex_id for r in out if r.s == 1) == [9, 19, 29, 39, 49, 59, 69, 79, 89, 99]
    assert sorted(r.vertex_id for r in out if r.s == 0) == [8, 18, 28, 38, 48, 58, 68, 78, 88, 98]
    assert seen.value == 100


def test_spatial_tuning_sums_the_touches_once(spark):
    """Rasters read the maps several times, and each reader summed all touches anew (F19)."""
    from haptrace.plans import fields
    from haptrace.schema import KEYS

    key = [F.lit("s0").alias("session_id"), F.lit("b").alias("block_order_id"), F.lit(1).alias("trial_id")]
    touches = spark.range(4).select(*key, F.col("id").alias("single_touch_id"), F.lit("tap").alias("gesture_type"), F.lit(1.0).alias("iff_max"))
    place = spark.range(25).select(F.col("id").alias("vertex_id"), (F.col("id") % 5 * 1.0).alias("u"), F.floor(F.col("id") / 5).cast("double").alias("v"))
    rf = touches.crossJoin(place).select(*KEYS, "vertex_id", F.exp(-(F.col("u") - 2) * (F.col("u") - 2) - (F.col("v") - 2) * (F.col("v") - 2)).alias("rf_mean"))
    rf, seen = _counted(spark, rf, "rf_mean")
    rf = rf.filter("rf_mean >= 0")  # so that a reader of places alone works the rows out too
    out = fields.spatial_tuning(rf, touches, place, "iff_max", [(0.0, 2.0)], 0.2, rows=20, cols=20).collect()
    assert sorted((r.subset, r.n_touches) for r in out) == [("all", 4), ("tap", 4)]
    assert seen.value == 100
