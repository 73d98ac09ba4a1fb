"""Queries on touches: bins, outliers, matrices, histograms, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from haptrace.functions import columns as C
from haptrace.operators import bins as B
from haptrace.operators import selection as E
from haptrace.operators import tuning as U
from haptrace.operators.clusters import cluster
from haptrace.operators.reports import feature_ranges
from haptrace.plans.inputs import ctes, view
from haptrace.plans.registry import query, r, rounded
from haptrace.schema import GESTURES, KEYS

T = ctes("touches")
ID = ["session_id", "single_touch_id"]


def _touches(spark, sf):
    return view(spark, sf, "touches")


@query("equal_frequency_bins", T + """, e AS (SELECT quantile_cont(velocity_max, [0, 0.25, 0.5, 0.75, 1]) AS q FROM touches)
SELECT session_id, single_touch_id, CASE WHEN velocity_max <= q[2] THEN 0 WHEN velocity_max <= q[3] THEN 1 WHEN velocity_max <= q[4] THEN 2 ELSE 3 END AS bin
FROM touches, e""")
def _(spark, sf):
    t = _touches(spark, sf)
    code, _ = B.quantile_bin(t, "velocity_max", 4)
    return t.select(*ID, code.alias("bin"))


@query("binning_labels", T + """, e AS (SELECT min(velocity_max) lo, max(velocity_max) hi, (max(velocity_max) - min(velocity_max)) / 5 AS s, min(depth_max) dlo, (max(depth_max) - min(depth_max)) / 5 AS ds FROM touches)
SELECT session_id, single_touch_id,
 (CASE WHEN velocity_max > lo + s THEN 1 ELSE 0 END + CASE WHEN velocity_max > lo + 2 * s THEN 1 ELSE 0 END + CASE WHEN velocity_max > lo + 3 * s THEN 1 ELSE 0 END + CASE WHEN velocity_max > lo + 4 * s THEN 1 ELSE 0 END) AS cluster_label,
 (CASE WHEN depth_max > dlo + ds THEN 1 ELSE 0 END + CASE WHEN depth_max > dlo + 2 * ds THEN 1 ELSE 0 END + CASE WHEN depth_max > dlo + 3 * ds THEN 1 ELSE 0 END + CASE WHEN depth_max > dlo + 4 * ds THEN 1 ELSE 0 END) AS bin_depth_max
FROM touches, e""")
def _(spark, sf):
    out, _ = B.binning_labels(_touches(spark, sf), ["depth_max", "velocity_max"], 5)
    return out.select(*ID, "cluster_label", "bin_depth_max")


_IQR = T + """, q AS (SELECT quantile_cont(velocity_max, 0.25) a, quantile_cont(velocity_max, 0.75) b, quantile_cont(depth_max, 0.25) da, quantile_cont(depth_max, 0.75) db FROM touches),
k AS (SELECT a - 0.3 * (b - a) AS vlo, b + 0.3 * (b - a) AS vhi, da - 0.3 * (db - da) AS dlo, db + 0.3 * (db - da) AS dhi FROM q),
i AS (SELECT t.*, k.*, CASE WHEN velocity_max BETWEEN vlo AND vhi THEN velocity_max END AS v, CASE WHEN depth_max BETWEEN dlo AND dhi THEN depth_max END AS d FROM touches t, k),
e AS (SELECT min(v) v0, max(v) v1, min(d) d0, max(d) d1 FROM i),
b AS (SELECT i.*, CASE WHEN velocity_max < vlo THEN -2 WHEN velocity_max > vhi THEN 3 WHEN v > v0 + 2 * ((v1 - v0) / 3) THEN 2 WHEN v > v0 + (v1 - v0) / 3 THEN 1 ELSE 0 END AS bv,
 CASE WHEN depth_max < dlo THEN -2 WHEN depth_max > dhi THEN 3 WHEN d > d0 + 2 * ((d1 - d0) / 3) THEN 2 WHEN d > d0 + (d1 - d0) / 3 THEN 1 ELSE 0 END AS bd FROM i, e)
"""


@query("cartesian_labels", _IQR + """SELECT session_id, single_touch_id, bd AS bin_depth_max, bv AS bin_velocity_max,
 CAST(dense_rank() OVER (ORDER BY bd, bv) - 1 AS INT) AS cluster_label FROM b""")
def _(spark, sf):
    out, _ = B.cartesian_labels(_touches(spark, sf), ["depth_max", "velocity_max"], 3, outlier_method="iqr", outlier_params={"k": 0.3})
    return out.select(*ID, "bin_depth_max", "bin_velocity_max", "cluster_label")


@query("type_stratified_labels", T + """, e AS (SELECT gesture_type, min(depth_max) lo, (max(depth_max) - min(depth_max)) / 3 s FROM touches GROUP BY 1)
SELECT session_id, single_touch_id, gesture_type || '_' || CASE WHEN depth_max > lo + 2 * s THEN '02' WHEN depth_max > lo + s THEN '01' ELSE '00' END AS cluster_label
FROM touches JOIN e USING (gesture_type)""")
def _(spark, sf):
    out, _ = cluster("type_stratified", _touches(spark, sf), ["depth_max"], {"base": "binning", "n_bins": 3})
    return out.select(*ID, "cluster_label")


_BOUNDS = {
    "iqr": ("quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))", "quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))"),
    "tukey": ("quantile_cont(v, 0.25) - 3.0 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))", "quantile_cont(v, 0.75) + 3.0 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))"),
    "percentile": ("quantile_cont(v, 0.01)", "quantile_cont(v, 0.99)"),
    "mad": ("median(v) - 3.5 * mad(v) / 0.6745", "median(v) + 3.5 * mad(v) / 0.6745"),
}


@query("outlier_bounds", T + """, l AS (SELECT 'depth_max' AS feature, depth_max AS v FROM touches UNION ALL SELECT 'velocity_max', velocity_max FROM touches) """
       + " UNION ALL ".join(f"SELECT '{m}' AS method, feature, {r(a, 'lower')}, {r(b, 'upper')} FROM l GROUP BY feature" for m, (a, b) in _BOUNDS.items()))
def _(spark, sf):
    t = _touches(spark, sf)
    parts = [B.outlier_bounds(t, ["depth_max", "velocity_max"], m).select(F.lit(m).alias("method"), "feature", "lower", "upper") for m in _BOUNDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query("highest_variance_feature", T + f"""SELECT feature, {r('variance', 'variance', 4)} FROM (SELECT 'depth_max' AS feature, var_samp(depth_max) AS variance FROM touches
 UNION ALL SELECT 'velocity_max', var_samp(velocity_max) FROM touches UNION ALL SELECT 'iff_max', var_samp(iff_max) FROM touches) ORDER BY variance DESC LIMIT 1""")
def _(spark, sf):
    return rounded(B.highest_variance(_touches(spark, sf), ["depth_max", "velocity_max", "iff_max"]), 4)


_CODES = T + """, q AS (SELECT quantile_cont(depth_max, [1/3, 2/3]) d, quantile_cont(velocity_max, [1/3, 2/3]) v FROM touches),
c AS (SELECT session_id, CASE WHEN type_metadata = 'stroke' THEN 0 ELSE 1 END AS type_metadata_code,
 CASE WHEN velocity_max <= v[1] THEN 0 WHEN velocity_max <= v[2] THEN 1 ELSE 2 END AS velocity_max_code,
 CASE WHEN depth_max <= d[1] THEN 0 WHEN depth_max <= d[2] THEN 1 ELSE 2 END AS depth_max_code, spike_elicited FROM touches, q),
g AS (SELECT * FROM (SELECT DISTINCT session_id FROM c) CROSS JOIN (SELECT DISTINCT type_metadata_code, velocity_max_code, depth_max_code FROM c))
"""
_CODE_COLS = ["type_metadata_code", "velocity_max_code", "depth_max_code"]


def _coded(spark, sf):
    conf = B.discretization_config("max")
    coded, _ = B.encode(_touches(spark, sf), {k: q for k, q in conf["continuous"].items() if k[:5] in ("depth", "veloc")}, ["type_metadata"])
    return coded


@query("touch_count_matrix", _CODES + f"""SELECT session_id, {", ".join(_CODE_COLS)}, CAST(count(c.spike_elicited) AS DOUBLE) AS value
FROM g LEFT JOIN c USING (session_id, {", ".join(_CODE_COLS)}) GROUP BY ALL""")
def _(spark, sf):
    return B.touch_matrix(_coded(spark, sf), "session_id", _CODE_COLS)


@query("efficacy_matrix", _CODES + f"""SELECT session_id, {", ".join(_CODE_COLS)}, {r("coalesce(avg(c.spike_elicited), 0)", "value")}
FROM g LEFT JOIN c USING (session_id, {", ".join(_CODE_COLS)}) GROUP BY session_id, {", ".join(_CODE_COLS)}""")
def _(spark, sf):
    return rounded(B.touch_matrix(_coded(spark, sf), "session_id", _CODE_COLS, "spike_elicited"))


@query("histogram_2d", T + f""", e AS (SELECT min(depth_max) x0, (max(depth_max) - min(depth_max)) / 20 xs, min(velocity_max) y0, (max(velocity_max) - min(velocity_max)) / 20 ys FROM touches),
p AS (SELECT gesture_type, least(19, CAST(floor((depth_max - x0) / xs + 1e-12) AS INT)) AS bx, least(19, CAST(floor((velocity_max - y0) / ys + 1e-12) AS INT)) AS "by", spike_elicited FROM touches, e),
g AS (SELECT gesture_type, CAST(bx AS INT) AS bx, CAST("by" AS INT) AS "by" FROM (SELECT DISTINCT gesture_type FROM touches), range(20) a(bx), range(20) b("by"))
SELECT gesture_type, bx, "by", count(spike_elicited) AS n, {r("avg(spike_elicited)", "mean_efficacy")} FROM g LEFT JOIN p USING (gesture_type, bx, "by") GROUP BY 1, 2, 3""")
def _(spark, sf):
    t = _touches(spark, sf)
    xe, ye = B.histogram_edges(t, "depth_max"), B.histogram_edges(t, "velocity_max")
    return rounded(B.histogram_2d(t, ["gesture_type"], "depth_max", "velocity_max", xe, ye, "spike_elicited"))


@query("log_histogram_edges", T + f""", e AS (SELECT min(velocity_max) FILTER (velocity_max > 0) lo, max(velocity_max) hi FROM touches)
SELECT CAST(i AS INT) AS i, {r("exp(ln(lo) + i * (ln(hi) - ln(lo)) / 20)", "edge")} FROM e, range(21) t(i)""")
def _(spark, sf):
    edges = B.histogram_edges(_touches(spark, sf), "velocity_max", 20, log=True)
    return rounded(spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in edges])).alias("i", "edge")))


_WIN = T + """, e AS (SELECT quantile_cont(velocity_max, 0.02) lo, quantile_cont(velocity_max, 0.98) hi FROM touches),
w AS (SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 8) * 0.75 AS a, CASE WHEN i = 7 THEN hi ELSE lo + i * ((hi - lo) / 8) * 0.75 + (hi - lo) / 8 END AS b FROM e, range(8) t(i))
"""
_INWIN = "velocity_max >= a AND (velocity_max < b OR (bin = 7 AND velocity_max <= b))"


def _windows(t):
    edges = B.linear_edges(t, "velocity_max", 1, 2, 98)
    return B.value_windows(edges[0], edges[-1], 8, 0.25)


@query("tuning_bins", _WIN + f"""SELECT session_id, bin, {r("(a + b) / 2", "bin_center", 4)}, {r("avg(iff_max)", "response", 4)}, {r("CASE WHEN count(iff_max) >= 2 THEN stddev_samp(iff_max) END", "std", 4)}, count(iff_max) AS n,
 count(*) FILTER (gesture_type = 'tap') AS n_tap, count(*) FILTER (gesture_type = 'stroke_distal') AS n_stroke_distal, count(*) FILTER (gesture_type = 'stroke_proximal') AS n_unassigned,
 {r("CASE WHEN count(iff_max) > 0 THEN count(*) FILTER (gesture_type = 'tap') / count(iff_max) ELSE 0 END", "share_tap")}
FROM (SELECT s.session_id, w.* FROM (SELECT DISTINCT session_id FROM touches) s, w) g LEFT JOIN touches t ON g.session_id = t.session_id AND {_INWIN} GROUP BY g.session_id, bin, a, b""".replace("SELECT session_id, bin, round(CAST((a", "SELECT g.session_id, bin, round(CAST((a"))
def _(spark, sf):
    t = _touches(spark, sf)
    out = U.bin_statistics(t, ["session_id"], "velocity_max", "iff_max", _windows(t), "gesture_type", ["tap", "stroke_distal"])
    return rounded(out.select("session_id", "bin", "bin_center", "response", "std", "n", "n_tap", "n_stroke_distal", "n_unassigned", "share_tap"), 4, share_tap=6)


@query("smoothed_bins", _WIN + f""", b AS (SELECT bin, CASE WHEN bin <> 3 THEN avg(iff_max) END AS response FROM w JOIN touches ON {_INWIN} GROUP BY bin),
k AS (SELECT CAST(d AS INT) AS d, exp(-0.5 * d * d) AS w FROM range(-4, 5) t(d)),
s AS (SELECT b.bin, k.w, CASE WHEN (b.bin + d + 16) % 16 >= 8 THEN 15 - (b.bin + d + 16) % 16 ELSE (b.bin + d + 16) % 16 END AS src FROM b, k)
SELECT s.bin, {r("sum(s.w * x.response) / sum(CASE WHEN x.response IS NOT NULL THEN s.w END)", "smoothed")} FROM s JOIN b x ON x.bin = s.src GROUP BY 1""")
def _(spark, sf):
    t = _touches(spark, sf)
    b = U.bin_statistics(t, [], "velocity_max", "iff_max", _windows(t)).withColumn("response", F.when(F.col("bin") != 3, F.col("response")))
    return rounded(U.smooth_bins(b.select("bin", "response"), [], "bin", "response", 1.0, 8).select("bin", "smoothed"))


@query("response_tuning", T + f""", s AS (SELECT *, unnest(CASE WHEN gesture_type = 'tap' THEN ['all', 'tap'] ELSE ['all', 'stroke', gesture_type] END) AS subset FROM touches),
l AS (SELECT session_id, subset, 'velocity_max' AS feature, velocity_max AS x, iff_max FROM s UNION ALL SELECT session_id, subset, 'depth_max', depth_max, iff_max FROM s),
e AS (SELECT feature, min(x) lo, max(x) hi FROM l GROUP BY 1),
w AS (SELECT feature, CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 6) AS a, CASE WHEN i = 5 THEN hi ELSE lo + i * ((hi - lo) / 6) + (hi - lo) / 6 END AS b FROM e, range(6) t(i)),
z AS (SELECT session_id, subset, feature, count(x) AS n_rows FROM l GROUP BY 1, 2, 3)
SELECT l.session_id, l.subset, l.feature, bin, {r("avg(iff_max)", "response", 4)}, {r("stddev_samp(iff_max)", "std", 4)}, count(*) AS n, min(n_rows) AS n_rows
FROM l JOIN w ON l.feature = w.feature AND x >= a AND (x < b OR (bin = 5 AND x <= b)) JOIN z ON l.session_id = z.session_id AND l.subset = z.subset AND l.feature = z.feature
WHERE n_rows >= 5 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return rounded(U.tuning(_touches(spark, sf), ["velocity_max", "depth_max"], "iff_max", 6), 4)


@query("category_tuning", T + f""", c AS (SELECT *, CAST(depth_min % 12 AS INT) AS lvl FROM touches),
g AS (SELECT * FROM (SELECT DISTINCT session_id FROM c), (SELECT DISTINCT CAST(lvl AS VARCHAR) AS level FROM c))
SELECT g.session_id, g.level, {r("avg(iff_max)", "response", 4)}, {r("CASE WHEN count(iff_max) >= 2 THEN stddev_samp(iff_max) END", "std", 4)}, count(iff_max) AS n
FROM g LEFT JOIN c ON g.session_id = c.session_id AND g.level = CAST(lvl AS VARCHAR) GROUP BY 1, 2""")
def _(spark, sf):
    t = _touches(spark, sf).withColumn("lvl", (F.col("depth_min") % 12).cast("int"))
    return rounded(U.category_statistics(t, ["session_id"], "lvl", "iff_max"), 4)


@query("category_level_order", T + """, l AS (SELECT DISTINCT CAST(CAST(depth_min % 12 AS INT) AS VARCHAR) AS level FROM touches)
SELECT level, CAST(row_number() OVER (ORDER BY CAST(level AS DOUBLE)) - 1 AS INT) AS place FROM l""")
def _(spark, sf):
    t = _touches(spark, sf).withColumn("lvl", (F.col("depth_min") % 12).cast("int"))
    levels = U.ordered_levels(t, "lvl")
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("place", "level"))


@query("designed_metadata", ctes("frames") + f""", f AS (SELECT {", ".join(KEYS)}, max(contact_depth) AS depth_max, first(contact_area ORDER BY frame_idx) AS force_metadata FROM frames GROUP BY ALL)
SELECT force_metadata, count(*) AS n, {r("avg(depth_max)", "depth_mean", 4)} FROM f GROUP BY 1""")
def _(spark, sf):
    f = view(spark, sf, "frames").withColumn("force_metadata", F.col("contact_area"))
    feats = f.groupBy(*KEYS).agg(F.max("contact_depth").alias("depth_max"))
    out = U.designed_metadata(feats, f, ["force_metadata"])
    return rounded(out.groupBy("force_metadata").agg(F.count("*").alias("n"), F.avg("depth_max").alias("depth_mean")), 4)


@query("axis_limits", T + f""", s AS (SELECT session_id, min(velocity_max) low, quantile_cont(velocity_max, 0.95) high FROM touches GROUP BY 1)
SELECT session_id, {r("low", "low", 4)}, {r("high", "high", 4)}, {r("low - (high - low) * 0.05", "axis_low", 4)}, {r("high + (high - low) * 0.05", "axis_high", 4)} FROM s""")
def _(spark, sf):
    return rounded(U.axis_limits(_touches(spark, sf), ["session_id"], "velocity_max", 0.95), 4)


@query("axis_limits_of_bins", T + """, s AS (SELECT *, unnest(CASE WHEN gesture_type = 'tap' THEN ['all', 'tap'] ELSE ['all', 'stroke', gesture_type] END) AS subset FROM touches),
l AS (SELECT session_id, subset, 'v' AS f, least(floor(velocity_max / 20), 4) AS bin, iff_max FROM s WHERE velocity_max BETWEEN 0 AND 100
 UNION ALL SELECT session_id, subset, 'd', least(floor(depth_max / 10), 4), iff_max FROM s WHERE depth_max BETWEEN 0 AND 50),
b AS (SELECT sum(iff_max) AS s, count(*) AS n FROM l WHERE iff_max IS NOT NULL GROUP BY session_id, subset, f, bin)
""" + f"""SELECT {r("max(s)", "sum_high", 4)}, max(n) AS count_high FROM b""")
def _(spark, sf):
    windows = {"velocity_max": B.value_windows(0.0, 100.0, 5), "depth_max": B.value_windows(0.0, 50.0, 5)}
    return rounded(U.bin_limits(_touches(spark, sf), ["velocity_max", "depth_max"], "iff_max", windows), 4)


@query("normalised_quartiles", T + f""", n AS (SELECT gesture_type, session_id, (velocity_max - min(velocity_max) OVER w) / (max(velocity_max) OVER w - min(velocity_max) OVER w) AS v FROM touches WINDOW w AS (PARTITION BY session_id))
SELECT session_id, gesture_type, {r("quantile_cont(v, 0.25)", "velocity_max_norm_q25")}, {r("median(v)", "velocity_max_norm_median")}, {r("quantile_cont(v, 0.75)", "velocity_max_norm_q75")}, count(*) AS n FROM n GROUP BY 1, 2""")
def _(spark, sf):
    n = U.normalised(_touches(spark, sf), ["velocity_max"], ["session_id"])
    return rounded(U.quartiles(n, ["session_id", "gesture_type"], ["velocity_max_norm"]))


@query("session_type_means", T + f""", p AS (SELECT gesture_type, session_id, avg(velocity_max) v, avg(iff_max) i FROM touches GROUP BY 1, 2)
SELECT gesture_type, {r("avg(v)", "velocity_max_mean", 4)}, {r("stddev_samp(v) / sqrt(count(v))", "velocity_max_sem", 4)}, {r("avg(i)", "iff_max_mean", 4)}, {r("stddev_samp(i) / sqrt(count(i))", "iff_max_sem", 4)}, count(*) AS n_sessions
FROM p GROUP BY 1""")
def _(spark, sf):
    return rounded(U.type_means(_touches(spark, sf), "session_id", "gesture_type", ["velocity_max", "iff_max"]), 4)


@query("feature_range_report", T + f""", l AS (SELECT 'depth_max' AS feature, depth_max v FROM touches UNION ALL SELECT 'velocity_max', velocity_max FROM touches)
SELECT feature, {r("min(v)", "minimum", 4)}, {r("quantile_cont(v, 0.05)", "p05", 4)}, {r("median(v)", "p50", 4)}, {r("quantile_cont(v, 0.95)", "p95", 4)}, {r("max(v)", "maximum", 4)} FROM l GROUP BY 1""")
def _(spark, sf):
    return rounded(feature_ranges(_touches(spark, sf), ["depth_max", "velocity_max"]), 4)


@query("feature_box_filter", T + f"""SELECT gesture_type, count(*) AS n, {r("avg(iff_max)", "iff_mean")} FROM touches
WHERE depth_max BETWEEN 20 AND 45 AND velocity_max BETWEEN 30 AND 80 AND gesture_type IN ('tap', 'stroke_distal') GROUP BY 1""")
def _(spark, sf):
    t = E.feature_box(_touches(spark, sf), {"depth_max": (20, 45), "velocity_max": (30, 80)}, ["tap", "stroke_distal"])
    return rounded(t.groupBy("gesture_type").agg(F.count("*").alias("n"), F.avg("iff_max").alias("iff_mean")))


@query("group_label_lookup", T + """, q AS (SELECT quantile_cont(velocity_max, [1/3, 2/3]) v FROM touches)
SELECT concat_ws('_', CASE WHEN velocity_max <= v[1] THEN '0' WHEN velocity_max <= v[2] THEN '1' ELSE '2' END, gesture_type) AS group_label, count(*) AS n_touches, CAST(sum(spike_count) AS BIGINT) AS n_spikes FROM touches, q GROUP BY 1""")
def _(spark, sf):
    t = _touches(spark, sf)
    code, _ = B.quantile_bin(t, "velocity_max", 3)
    t = t.withColumn("group_label", F.concat_ws("_", code.cast("string"), "gesture_type"))
    return t.groupBy("group_label").agg(F.count("*").alias("n_touches"), F.sum("spike_count").cast("long").alias("n_spikes"))


@query("gesture_matrix", T + f"""SELECT session_id, {", ".join(r(f"avg(velocity_max) FILTER (gesture_type = '{g}')", g, 4) for g in GESTURES)} FROM touches GROUP BY 1""")
def _(spark, sf):
    return rounded(_touches(spark, sf).groupBy("session_id").pivot("gesture_type", GESTURES).agg(F.avg("velocity_max")), 4)


@query("count_thresholds", T + """SELECT session_id, gesture_type, count(*) AS n, greatest(1, CAST(round_even(0.015 * count(*), 0) AS BIGINT)) AS threshold FROM touches GROUP BY 1, 2""")
def _(spark, sf):
    g = _touches(spark, sf).groupBy("session_id", "gesture_type").agg(F.count("*").alias("n"))
    return g.withColumn("threshold", C.count_threshold(1.5, "n"))
