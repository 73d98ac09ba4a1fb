"""Edges of boxes, labels, shared limits, worst rows and the unfolding of points."""

from haptrace.operators import reports as R
from haptrace.operators import selection as E
from haptrace.operators import surface as S
from haptrace.operators import tuning as U


def test_box_is_closed_and_drops_nulls(spark):
    t = spark.createDataFrame([(1, 1.0, "tap"), (2, 3.0, "tap"), (3, 3.5, "tap"), (4, None, "tap"), (5, 2.0, "stroke_distal"), (6, 2.0, None)],
                              "t int, x double, gesture_type string")
    assert sorted(r["t"] for r in E.feature_box(t, {"x": (1.0, 3.0)}, ["tap"]).collect()) == [1, 2]
    assert sorted(r["t"] for r in E.feature_box(t, {"x": (1.0, 3.0)}).collect()) == [1, 2, 5, 6]


def test_labels_reach_frames_of_labelled_touches_only(spark):
    t = spark.createDataFrame([(i, float(i), "a" if i % 2 else "b") for i in range(8)] + [(8, None, "a"), (9, 1.0, None)], "t int, x double, kind string")
    frames = spark.createDataFrame([(i, n) for i in range(10) for n in range(2)], "t int, n int")
    labels = E.group_labels(t, {"x": 2}, ["kind"], ["t"])
    got = {(r["t"], r["n"]): r["group_label"] for r in E.with_group_labels(frames, labels, ["t"]).collect()}
    assert len(got) == 16 and got[0, 0] == "0_b" and got[7, 1] == "1_a"
    assert not [k for k in got if k[0] > 7]


def test_limits_over_all_sessions_and_subsets(spark):
    schema = "session_id string, gesture_type string, x double, y double"
    rows = [("s", "tap", 0.5, 2.0), ("s", "tap", 0.6, 3.0), ("s", "stroke_distal", 0.7, 4.0), ("q", "tap", 1.0, 1.0), ("q", "tap", 2.0, 1.5), ("q", "tap", 0.2, None)]
    windows = {"x": [(0.0, 1.0), (1.0, 2.0)]}
    got = U.bin_limits(spark.createDataFrame(rows, schema), ["x"], "y", windows).first()
    assert (got["sum_high"], got["count_high"]) == (9.0, 3)
    none = U.bin_limits(spark.createDataFrame([], schema), ["x"], "y", windows).first()
    assert (none["sum_high"], none["count_high"]) == (None, None)


def test_worst_rows_rank_by_farthest_point_with_ties_by_row(spark):
    points = spark.createDataFrame([("s", 1, 5.0, 0.0), ("s", 1, 1.0, 2.0), ("s", 3, 9.0, 1.0), ("s", 2, 5.0, 4.0), ("s", 4, None, 4.0), ("q", 1, 0.5, 0.0)],
                                   "s string, t int, d double, x double")
    got = R.worst_rows(points, ["s"], ["t"], "d", ["x"], 2)
    assert sorted((r["s"], r["rank"], r["t"], r["max_distance"], r["n_points"], r["centroid_x"]) for r in got.collect()) == [
        ("q", 1, 1, 0.5, 1, 0.0), ("s", 1, 3, 9.0, 1, 1.0), ("s", 2, 1, 5.0, 2, 1.0)]


def test_points_are_unfolded_and_flat_faces_give_their_centroid(spark):
    v = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("s", 1, 3.0, 0.0, 0.0, 30.0, 0.0), ("s", 2, 0.0, 3.0, 0.0, 0.0, 60.0),
                               ("s", 3, 90.0, 0.0, 0.0, 6.0, 0.0), ("s", 4, 91.0, 0.0, 0.0, 0.0, 6.0), ("s", 5, 92.0, 0.0, 0.0, 0.0, 0.0)],
                              "s string, vertex_id int, x double, y double, z double, u double, v double")
    f = spark.createDataFrame([("s", 0, 1, 2), ("s", 3, 4, 5)], "s string, i int, j int, k int")
    p = spark.createDataFrame([("s", 1.0, 1.0, 7.0), ("s", 3.0, -1.0, 0.0), ("s", 91.0, 0.5, 0.0), ("s", None, 0.0, 0.0), ("q", 1.0, 1.0, 0.0)],
                              "s string, x double, y double, z double")
    got = {(r["x"], r["y"]): (round(r["u"], 9), round(r["v"], 9)) for r in S.xyz_to_uv(p, f, v, ["s"]).collect()}
    assert got == {(1.0, 1.0): (10.0, 20.0), (3.0, -1.0): (30.0, -20.0), (91.0, 0.5): (2.0, 2.0)}
