"""Operators on small hand-made frames, against closed forms or brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haptrace.functions import columns as C
from haptrace.functions import special as P
from haptrace.operators import bins as B
from haptrace.operators import density as D
from haptrace.operators import features as FT
from haptrace.operators import fits as J
from haptrace.operators import metrics as M
from haptrace.operators import models as MO
from haptrace.operators import prepare as PR
from haptrace.operators import raster as R
from haptrace.operators import starts as SS
from haptrace.operators import stats as ST
from haptrace.operators import surface as S
from haptrace.operators import tuning as U
from haptrace.operators.clusters import cluster
from haptrace.schema import KEYS


def frames(spark, rows, **extra):
    base = {"session_id": "s", "block_order_id": "1", "trial_id": 1, "single_touch_id": 1}
    pdf = pd.DataFrame([{**base, "frame_idx": i, **r} for i, r in enumerate(rows)])
    df = spark.createDataFrame(pdf)
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema.fields if f.dataType.typeName() == "double"})


NAN = float("nan")


@pytest.mark.parametrize("kind,x,want", [
    ("tap", [0.0, 1.0], "tap"), ("stroke", [0.0, 5.0], "stroke_proximal"), ("stroke", [5.0, 0.0], "stroke_distal"),
    ("stroke", [2.0, 2.0], "stroke_distal"), ("stroke", [NAN, 1.0, NAN, 3.0], "stroke_proximal"), ("stroke", [NAN, 1.0, NAN], "stroke_unknown"),
])
def test_gesture_labels(spark, kind, x, want):
    df = frames(spark, [{"type_metadata": kind, "contact_location_x": v} for v in x])
    assert PR.gesture_labels(df).first()["gesture_type"] == want


def test_unknown_touch_type_is_an_error(spark):
    df = frames(spark, [{"type_metadata": "poke", "contact_location_x": 1.0}] * 2)
    with pytest.raises(Exception, match="unknown type_metadata"):
        PR.gesture_labels(df).collect()


@pytest.mark.parametrize("split", [False, True])
def test_gap_fill(spark, split):
    rows = [{"contact_depth": d, "contact_area": a} for d, a in zip([NAN, 1, NAN, NAN, 4, NAN], [NAN, NAN, 7.0, NAN, NAN, NAN])]
    spark.conf.set("haptrace.chunk.rows", "2")
    got = PR.touch_fill(frames(spark, rows), split=split).orderBy("frame_idx").toPandas()
    spark.conf.unset("haptrace.chunk.rows")
    assert np.allclose(got.contact_depth.astype(float), [NAN, 1, 2, 3, 4, NAN], equal_nan=True)
    assert (got.contact_area == 7.0).all()


def test_activity_windows(spark):
    n = 40
    rows = [{"Nerve_freq": 5.0 if 20 <= i < 25 else 0.0, "contact_detected": 1, "pressure": float(i), "type_metadata": "tap"} for i in range(n)]
    df = frames(spark, rows)
    assert FT.mean_during_activity(df, ["pressure"]).first()["pressure_mean_during_iff"] == 22.0
    assert FT.mean_before_activity(df, ["pressure"], 10).first()["pressure_mean_before_iff"] == 14.5
    quiet = frames(spark, [{"Nerve_freq": 0.0, "contact_detected": int(i == 0), "pressure": 3.0, "type_metadata": "tap"} for i in range(4)])
    assert FT.mean_before_activity(quiet, ["pressure"]).first()["pressure_mean_before_iff"] is None
    assert FT.mean_during_activity(quiet, ["pressure"]).first()["pressure_mean_during_iff"] == 3.0


def test_extractor_registry(spark):
    df = frames(spark, [{"Nerve_spike": 1, "type_metadata": "tap", "pressure": float(i)} for i in range(3)])
    FT.register_aggregates("sum_of_pressure", lambda d: [F.sum("pressure").alias("pressure_sum")])
    assert FT.extract_feature("sum_of_pressure", df).first()["pressure_sum"] == 3.0
    with pytest.raises(ValueError, match="unknown feature"):
        FT.extract_feature("nope", df)


def test_contact_points_skip_malformed_brackets(spark):
    text = "[[1 2 3] [4 5] [6 x 7] [ -1e1  .5  2. ]]"
    got = spark.range(1).select(C.contact_points(F.lit(text)).alias("p")).first()["p"]
    assert [tuple(p) for p in got] == [(1.0, 2.0, 3.0), (-10.0, 0.5, 2.0)]


# --- bins ------------------------------------------------------------------------------


def test_bins_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": range(200), "A": rng.gamma(2, 3, 200).round(2), "B": rng.integers(0, 9, 200).astype(float), "K": 1.0})
    df = spark.createDataFrame(pdf)
    out, meta = B.binning_labels(df, ["A", "B", "K"], 4)
    got = out.orderBy("i").toPandas()
    assert meta["binned_features"] == ["A", "B"] and "bin_K" not in got
    assert (got.bin_A.values == pd.cut(pdf.A, 4, labels=False).values).all()
    out, _ = B.binning_labels(df, ["A", "B"], 4, "equal_frequency")
    assert (out.orderBy("i").toPandas().bin_B.values == pd.qcut(pdf.B, 4, labels=False, duplicates="drop").values).all()


def test_cartesian_labels_are_dense_and_ordered(spark):
    pdf = pd.DataFrame({"i": range(8), "A": [0, 0, 1, 1, 9, 9, 9, 5.0], "B": [0, 9, 0, 9, 0, 0, 9, 5.0]})
    out, meta = B.cartesian_labels(spark.createDataFrame(pdf), ["A", "B"], 3)
    got = out.orderBy("i").toPandas()
    combos = list(zip(got.bin_A, got.bin_B))
    order = {c: n for n, c in enumerate(sorted(set(combos)))}
    assert list(got.cluster_label) == [order[c] for c in combos]
    with pytest.raises(ValueError):
        B.cartesian_labels(out, ["A"], 1)


def test_outlier_bounds(spark):
    v = np.array([*range(1, 21), 200, 300], dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    q1, q3 = np.percentile(v, [25, 75])
    got = B.outlier_bounds(df, ["x"], "iqr").first()
    assert [got.lower, got.upper] == pytest.approx([q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)])
    med = np.median(v)
    cut = 3.5 * np.median(abs(v - med)) / 0.6745
    got = B.outlier_bounds(df, ["x"], "mad").first()
    assert [got.lower, got.upper] == pytest.approx([med - cut, med + cut])
    assert B.outlier_bounds(df.limit(3), ["x"], "tukey").first().upper == math.inf
    with pytest.raises(ValueError):
        B.outlier_bounds(df, ["x"], "tukey", {"k": 1})


def test_value_windows():
    assert B.value_windows(0, 10, 5, 0) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    w = B.value_windows(0, 10, 5, 0.5)
    assert w[1] == (1.0, 3.0) and w[-1] == (4.0, 10)
    with pytest.raises(ValueError):
        B.value_windows(0, 1, 2, 0.6)


def test_empty_bins_and_levels_are_kept(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.0, 1.0, 9.0, 10.0], "y": [1.0, 3.0, 5.0, 7.0], "g": ["a", "b", None, "a"]}))
    got = U.bin_statistics(df, [], "x", "y", [(0, 2), (2, 8), (8, 10)], "g", ["a"]).orderBy("bin").toPandas()
    assert list(got.n) == [2, 0, 2] and got.response[0] == 2.0 and np.isnan(got.response[1])
    assert list(got.n_a) == [1, 0, 1] and list(got.n_unassigned) == [1, 0, 1]


# --- distance joins --------------------------------------------------------------------


@pytest.mark.parametrize("cut", [3.0, None])
@pytest.mark.parametrize("load", [4, 512])
def test_nearest_matches_brute_force(spark, monkeypatch, cut, load):
    monkeypatch.setattr(S, "CELL_LOAD", load)
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(0, 0.3, (60, 3)), rng.normal(10, 4, (40, 3))])
    p = rng.normal(4, 6, (80, 3))
    vd = spark.createDataFrame(pd.DataFrame(v, columns=list("xyz")).assign(vertex_id=range(100)))
    pd_ = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")))
    got = S.nearest(pd_, vd, [], cut).toPandas().set_index("x")
    d = np.linalg.norm(p[:, None] - v[None], axis=2)
    keep = d.min(axis=1) <= (cut or 1e9)
    assert len(got) == keep.sum()
    for i in np.nonzero(keep)[0]:
        assert got.loc[p[i, 0], "vertex_id"] == d[i].argmin()


def test_grid_cells_are_closed_and_overlap(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": range(4), "vel": [5.0, 10.0, 26.0, NAN]})).withColumn("vel", F.nanvl("vel", F.lit(None)))
    got = S.cell_members(df, {"vel": (0.0, 30.0, 10.0, 10.0)}).toPandas()
    assert sorted(zip(got.t, got.i_vel)) == [(0, 0), (0, 1), (1, 1)]
    got = S.cell_members(df, {"vel": (0.0, 30.0, 10.0, 14.0)}).toPandas()
    assert sorted(zip(got.t, got.i_vel)) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_touch_rf_mean_and_gaps(spark):
    rows = [(0, 1, 10.0), (0, 1, 30.0), (0, 2, 5.0), (1, 1, None), (1, 1, 4.0)]
    df = spark.createDataFrame(rows, "touch int, vertex_id int, iff double")
    got = {(r.touch, r.vertex_id): (r.rf_mean, r.rf_max) for r in S.touch_rf(df, "iff", ["touch"]).collect()}
    assert got == {(0, 1): (20.0, 30.0), (0, 2): (5.0, 5.0)}


def test_hulls(spark):
    rng = np.random.default_rng(2)
    inner = rng.uniform(0.1, 0.9, (500, 2))
    square = np.vstack([inner, [[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0]]])
    line = np.column_stack([np.arange(5.0), np.arange(5.0)])
    pdf = pd.concat([pd.DataFrame(square, columns=["u", "v"]).assign(k="sq"), pd.DataFrame(line, columns=["u", "v"]).assign(k="line")])
    got = M.convex_hulls(spark.createDataFrame(pdf), ["k"]).toPandas().set_index("k")
    assert got.loc["sq", "hull_area"] == pytest.approx(1.0) and got.loc["sq", "hull_perimeter"] == pytest.approx(4.0)
    assert got.loc["sq", "hull_corners"] == 4 and got.loc["line", "hull_area"] == 0.0


def test_distribution_metrics_closed_forms(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["u"] * 8 + ["o"] * 4, "value": [2.0] * 8 + [0.0, 0.0, 0.0, 1.0]}))
    got = M.distribution(df, ["k"]).toPandas().set_index("k")
    assert got.loc["u", "gini_coefficient"] == pytest.approx(0) and got.loc["u", "shannon_entropy"] == pytest.approx(3)
    assert got.loc["o", "gini_coefficient"] == pytest.approx(0.75) and got.loc["o", "shannon_entropy"] == pytest.approx(0)


# --- clusters --------------------------------------------------------------------------


def brute_dbscan(x, eps, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = d.sum(axis=1) >= k
    labels = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and labels[i] < 0:
            stack = [i]
            labels[i] = n
            while stack:
                for j in np.nonzero(d[stack.pop()] & core)[0]:
                    if labels[j] < 0:
                        labels[j] = n
                        stack.append(j)
            n += 1
    return core, labels, d


@pytest.mark.parametrize("eps,k", [(0.5, 5), (0.9, 12), (0.3, 1)])
def test_dbscan_matches_brute_force(spark, eps, k):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.4, (70, 2)) for c in (-3, 0, 3)] + [rng.uniform(-6, 6, (25, 2)), np.zeros((40, 2))])
    got = D.dbscan_labels(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(i=range(len(x)))), [], ["a", "b"], eps, k)
    mine = got.orderBy("i").toPandas().cluster_label.to_numpy()
    core, labels, d = brute_dbscan(x, eps, k)
    pairs = set(zip(mine[core], labels[core]))
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    for i in np.nonzero(~core)[0]:
        near = mine[d[i] & core]
        assert mine[i] == (near.min() if len(near) else -1)


def test_auto_eps_matches_sorted_distances(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.uniform(-15, 15, (8, 2)), np.zeros((5, 2))])
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 3]
    s = np.sort(d)
    want = s[int(np.argmax(np.diff(s, n=2))) + 1]
    got = D.auto_eps(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"], 4)
    assert got == pytest.approx(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 205), (205, 203)]
    got = {r.node: r.root for r in D.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[203] == 200


@pytest.fixture(scope="module")
def three_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(c, 0.4, (100, 2)) for c in (-4, 0, 4)])
    return spark.createDataFrame(pd.DataFrame(x, columns=["f0", "f1"]).assign(i=range(300), truth=np.repeat([0, 1, 2], 100)))


def _same_partition(labelled):
    return ST.adjusted_rand(labelled, "cluster_label", "truth").first()["ari"]


@pytest.mark.parametrize("kind", ["full", "diag", "tied", "spherical"])
def test_gmm_finds_three_blobs(three_blobs, kind):
    out, meta = cluster("gmm", three_blobs, ["f0", "f1"], {"min_touches_per_component": 30, "max_components": 4, "covariance_type": kind})
    assert meta["k"] == 3 and _same_partition(out) == pytest.approx(1.0)
    probs = out.select(sum(F.col(f"gmm_prob_{i}") for i in range(3)).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert probs[0] == pytest.approx(1) and probs[1] == pytest.approx(1)
    part = MO.marginal(meta, "f1", "f0", unit={"f0": 2.0})
    assert part[0]["covariance"][1][1] == pytest.approx(meta["covariances"][0][0][0] * 4)


def test_kmeans_respects_minimum_size(three_blobs):
    out, meta = cluster("kmeans", three_blobs, ["f0", "f1"], {"min_touches_per_cluster": 90})
    assert meta["k"] == 3 and _same_partition(out) == pytest.approx(1.0)
    _, meta = cluster("kmeans", three_blobs, ["f0", "f1"], {"min_touches_per_cluster": 200})
    assert meta["k"] == 1


def test_starts_of_a_large_table_with_few_different_rows(spark):
    values = F.col("id") % 4
    df = spark.range(400_000).select((values % 2 * 10).cast("double").alias("a"), F.floor(values / 2).cast("double").alias("b"))
    rows, weights, count = SS.seed_rows(df, ["a", "b"], 400_000)
    assert rows.tolist() == [[0, 0], [0, 1], [10, 0], [10, 1]] and weights.tolist() == [100_000] * 4 and count == 4
    _, meta = cluster("kmeans", df, ["a", "b"], {"min_touches_per_cluster": 100_000, "n_init": 2})
    assert meta["k"] == 4 and meta["sizes"] == [100_000] * 4
    fits = MO.fit_gmms(df, ["a", "b"], [(2, 42)])
    assert sorted(round(m[0]) for m in fits[0][0][1]) == [0, 10]


def test_seeds_are_different_rows_and_grow_with_k(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 20_000, 0.5).otherwise(F.col("id")).cast("double").alias("a"))
    rows, weights, count = SS.seed_rows(df, ["a"], 60_000)
    assert count == 40_001 and 3500 < len(rows) <= 8000 and len(np.unique(rows)) == len(rows)
    assert weights[rows[:, 0] == 0.5].tolist() == [20_000] and weights.sum() == pytest.approx(60_000, rel=0.1)
    assert len(SS.seed_rows(df, ["a"], 60_000, 5000)[0]) > 5000


# --- fits ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def curves(spark):
    x = np.linspace(0.5, 10, 60)
    y = {"power": 2 * x ** 1.5 + 1, "naka_rushton": 10 * x ** 2 / (x ** 2 + 3.0 ** 2) + 0.5, "sigmoid": 8 / (1 + np.exp(-1.2 * (x - 5))) + 2,
         "exp_sat": 6 * (1 - np.exp(-0.7 * x)) + 1, "cubic": 0.3 * x ** 3 - 2 * x + 4}
    return spark.createDataFrame(pd.concat([pd.DataFrame({"m": k, "x": x, "y": v}) for k, v in y.items()]))


@pytest.mark.parametrize("model,want", [("power", [2, 1.5, 1]), ("naka_rushton", [10, 2, 3, 0.5]), ("sigmoid", [8, 1.2, 5, 2]), ("exp_sat", [6, 0.7, 1])])
def test_models_recover_parameters(curves, model, want):
    got = J.model_fit(curves.filter(F.col("m") == model), ["m"], "x", "y", model).first()
    assert got.r_squared > 0.99999
    assert [got[p] for p in J.MODELS[model].parameters] == pytest.approx(want, rel=1e-2)


def test_polynomials_match_polyfit(curves):
    pdf = curves.filter("m = 'sigmoid'").toPandas()
    for degree in (1, 3, 7):
        got = J.polynomial_fit(curves, ["m"], "x", "y", degree).filter("m = 'sigmoid'").first()
        want = np.polyfit(pdf.x, pdf.y, degree)
        assert np.allclose(np.polyval(got.coefficients, pdf.x), np.polyval(want, pdf.x), rtol=1e-5)
        res = ((pdf.y - np.polyval(want, pdf.x)) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum()
        assert got.r_squared == pytest.approx(1 - res, abs=1e-8)
    assert J.polynomial_fit(curves.limit(3), ["m"], "x", "y", 4).first().coefficients is None


def test_fit_config():
    assert J.fit_config({"fit_degrees": [1, 3]}) == ["poly1", "poly3"]
    assert "sigmoid" in J.fit_config({"fit_models": "all"})
    with pytest.raises(ValueError):
        J.fit_config({"fit_models": ["spline"]})


# --- statistics ------------------------------------------------------------------------


def test_tail_probabilities_against_known_values():
    assert P.f_sf(4.0, 2, 10) == pytest.approx(1.8 ** -5)
    assert P.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert P.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert P.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert P.binomial_two_sided(1, 10) == pytest.approx(22 / 1024)
    assert P.clopper_pearson(8, 10) == pytest.approx((0.4439, 0.9748), abs=1e-4)
    assert P.ks_p(1.0, 3, 3) == pytest.approx(0.1)
    assert P.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1)
    assert P.wilcoxon_p(15, 5, 0, 0) == pytest.approx(0.0625)


def test_anova_of_equal_groups_has_no_effect(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": 0, "s": list("aaabbb"), "v": [1.0, 2, 3, 1, 2, 3]}))
    got = ST.bias(df, ["c"], "s", "v").first()
    assert got.test_statistic == 0 and got.p_value == 1.0 and got.effect_size == 0


# --- rasters ---------------------------------------------------------------------------


def gaussian_raster(spark, n=60, sigma=9.0, ratio=1.0):
    r, c = np.mgrid[0:n, 0:n]
    z = 100 * np.exp(-((r - n / 2) ** 2 / (2 * sigma ** 2) + (c - n / 2) ** 2 / (2 * (sigma * ratio) ** 2)))
    return spark.createDataFrame(pd.DataFrame({"k": "g", "r": r.ravel(), "c": c.ravel(), "u": r.ravel() * 0.1, "v": c.ravel() * 0.1, "z": z.ravel()}).astype({"r": "int32", "c": "int32"}))


@pytest.mark.parametrize("method", ["inflection", "gradient"])
def test_circular_boundary(spark, method):
    n, sigma, smoothing = 60, 9.0, 2.0
    got = R.boundaries(gaussian_raster(spark, n, sigma), ["k"], n, n, method, smoothing).first()
    # Smoothing widens the bump; its Laplacian changes sign at sqrt(2) sigma, its slope peaks at sigma.
    wide = math.hypot(sigma, smoothing)
    radius = 0.1 * wide * (math.sqrt(2) if method == "inflection" else 1.0)
    assert got.area == pytest.approx(math.pi * radius ** 2, rel=0.06)
    assert (got.centroid_u, got.centroid_v) == pytest.approx((3.0, 3.0), abs=0.05)
    assert got.circularity > (0.6 if method == "inflection" else 0.95)
    assert (got.peak_u, got.peak_v) == pytest.approx((3.0, 3.0))


def test_peak_at_border_has_no_boundary(spark):
    df = gaussian_raster(spark, 40).withColumn("z", F.col("r") * 1.0)
    assert R.inflection_contours(df, ["k"], 40, 40, 2.0).isEmpty()


def test_trace_outline_of_a_block():
    m = np.zeros((6, 6))
    m[2:4, 2:5] = 1
    path = R.trace_outline(m)
    assert tuple(path[0]) == tuple(path[-1])
    x, y = path[:-1, 0], path[:-1, 1]
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    assert area == pytest.approx(6 - 0.5)


def test_gaussian_fit_recovers_ellipse(spark):
    df = gaussian_raster(spark, 40, 5.0, 1.6)
    got = J.gaussian_fit(df, ["k"], "u", "v", "z").first()
    assert got.r_squared > 0.999 and got.sigma_major == pytest.approx(0.8, rel=0.02) and got.sigma_minor == pytest.approx(0.5, rel=0.02)


def test_keys_are_complete():
    assert KEYS == ["session_id", "block_order_id", "trial_id", "single_touch_id"]
