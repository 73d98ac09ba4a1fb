"""Nearest vertices: points that are worked out anew between rounds, and dense surfaces."""

import random

from pyspark.sql import functions as F

from haptrace.operators import surface as S


def _rows_of_joins(df):
    """Rows that the largest join of an executed frame gave out."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_points_that_drift_in_the_last_bit_are_found_once(spark):
    """A sum of shuffled doubles may differ each time it is worked out; F9 gave such points twice."""
    drift = F.udf(lambda z: z + random.random() * 1e-9, "double").asNondeterministic()
    points = spark.range(200).select((F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), drift(F.lit(0.5)).alias("z"))
    vertices = spark.range(40).select(F.col("id").alias("vertex_id"), (F.col("id") * F.col("id") / 8).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    found = S.nearest(points, vertices, [], None).select("x").toPandas()["x"]
    assert sorted(found) == [float(i) for i in range(200)]


def test_dense_surface_gives_no_row_per_pair(spark):
    """Points and vertices of a cell meet in lists; F15 to F24 sorted every pair in one task."""
    points = spark.range(300).select((F.col("id") / 300).alias("x"), F.lit(0.25).alias("y"), F.lit(0.0).alias("z"))
    vertices = spark.range(500).select(F.col("id").alias("vertex_id"), (F.col("id") / 500).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = S.nearest(points, vertices, [], 15.0)
    rows = out.collect()
    assert len(rows) == 300 and _rows_of_joins(out) <= 27 * 300
    for r in rows:
        best = min(range(500), key=lambda i: ((r.x - i / 500) ** 2 + 0.0625, i))
        assert r.vertex_id == best


def test_nothing_is_summed_by_touch_before_rows_are_dealt(spark):
    """Sums where the rows are read held all rows of a task's input (F11 to F28)."""
    hits = spark.range(400).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("session_id"), (F.col("id") % 5).cast("string").alias("block_order_id"), F.lit(1).alias("trial_id"),
        (F.col("id") % 40).alias("single_touch_id"), F.when(F.col("id") % 40 < 50, "tap").alias("gesture_type"), (F.col("id") % 7).alias("vertex_id"), (F.col("id") * 1.0).alias("iff"))
    rf = S.touch_rf(hits, "iff", [*S.KEYS, "gesture_type"])
    touches = S.touches_together(hits).select(*S.KEYS, "vertex_id").distinct()
    for df in (rf, touches, rf.select(*S.KEYS).distinct()):
        above, below = df._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
        assert "HashAggregate" in above and "Aggregate" not in below
    got = {(r.single_touch_id, r.vertex_id): r.rf_mean for r in rf.collect()}
    rows = {}
    for i in range(400):
        rows.setdefault((i % 40, i % 7), []).append(i)
    assert got == {k: sum(v) / len(v) for k, v in rows.items()}
    every = {(r.session_id, r.vertex_id): (r.n_unique, r.n_touches) for r in S.population_heatmap(hits, "iff", 0.2).filter("subset = 'all'").collect()}
    assert every == {(f"s{k}", v): (len({t for t, w in rows if w == v and t % 2 == k}), 20) for k in (0, 1) for v in range(7)}


def test_tasks_follow_the_rows_and_not_the_sessions_partitions(spark):
    """With partitions as before, a task held more rows the larger the input was (F19 to F22)."""
    from haptrace.plans import registry
    from haptrace.session import GROUP_ROWS_CONF

    registry.load_all()
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    spark.conf.set(GROUP_ROWS_CONF, "500")
    try:
        for name in ("touch_response_maps", "touches_with_response_maps", "population_heatmap"):
            plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "single_touch_id" in line]
            assert dealt and all(f", {-(-rows // 500)})" in line for line in dealt)
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_no_task_holds_a_touch_once_per_subset(spark):
    """Touches were repeated for each subset and then grouped (F20); a touch of several gestures still counts once per subset."""
    rows = [("s0", "b", 1, t, g, v, i) for t, g, v, i in (
        (1, "tap", 1, 2.0), (1, "stroke_distal", 1, 4.0), (1, "stroke_proximal", 1, 9.0), (2, "tap", 1, 6.0), (2, "tap", 1, 8.0),
        (3, "stroke_distal", 1, None), (3, "stroke_distal", 2, 5.0), (4, "tap", 2, None), (5, "rest", 2, 1.0))]
    hits = spark.createDataFrame(rows, "session_id string, block_order_id string, trial_id int, single_touch_id int, gesture_type string, vertex_id long, iff double")
    out = S.population_heatmap(hits, "iff", 0.2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "subset" in line and "single_touch_id" in line]
    got = {(r.subset, r.vertex_id): (r.value, r.n_unique, r.n_touches) for r in out.collect()}
    assert got == {("all", 1): (5.5, 3, 4), ("tap", 1): (4.5, 2, 2), ("stroke", 1): (6.5, 2, 2), ("stroke_distal", 1): (4.0, 2, 2), ("stroke_proximal", 1): (9.0, 1, 1),
                   ("all", 2): (3.0, 3, 4), ("stroke", 2): (5.0, 1, 2), ("stroke_distal", 2): (5.0, 1, 2)}
