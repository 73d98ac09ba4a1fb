"""Queries on reduction, clustering, quality and curve fits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from haptrace.operators import density as D
from haptrace.operators import fits as J
from haptrace.operators import models as M
from haptrace.operators import surface as S
from haptrace.operators.clusters import cluster
from haptrace.plans.inputs import ctes, view
from haptrace.plans.registry import query, r, rounded
from haptrace.schema import KEYS
from haptrace.session import cut_lineage

V = ctes("vertices")
T = ctes("touches")
XYZ = ["x", "y", "z"]


def _std(c):
    return f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


@query("standard_scaling", V + f"SELECT vertex_id, {', '.join(r(_std(c), c) for c in XYZ)} FROM vertices")
def _(spark, sf):
    return rounded(M.scale(view(spark, sf, "vertices"), XYZ).select("vertex_id", *XYZ))


@query("robust_scaling", V + f"""SELECT vertex_id, {', '.join(r(f"({c} - (SELECT median({c}) FROM vertices)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM vertices)", c) for c in XYZ)} FROM vertices""")
def _(spark, sf):
    return rounded(M.scale(view(spark, sf, "vertices"), XYZ, "robust").select("vertex_id", *XYZ))


# Principal axes of the correlations of three features: eigenvalues by the cosine form, axes as cross products.
_AXES = V + """, s AS (SELECT vertex_id, """ + ", ".join(f"{_std(c)} AS {c}" for c in XYZ) + """ FROM vertices),
c AS (SELECT corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS d FROM s), e AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS p FROM c),
f AS (SELECT *, acos(a * b * d / (p * p * p)) / 3 AS t FROM e), l AS (SELECT a, b, d, unnest([1 + 2 * p * cos(t), 1 - 2 * p * (cos(t) + cos(t + 2 * pi() / 3))]) AS v, unnest([0, 1]) AS i FROM f),
u AS (SELECT i, a * d - b * (1 - v) AS u0, b * a - (1 - v) * d AS u1, (1 - v) * (1 - v) - a * a AS u2 FROM l), n AS (SELECT *, sqrt(u0 * u0 + u1 * u1 + u2 * u2) AS w FROM u),
pc AS (SELECT vertex_id, i, abs((x * u0 + y * u1 + z * u2) / w) AS v FROM s, n)
"""


@query("reduced_features", _AXES + f"SELECT vertex_id, {r('max(v) FILTER (i = 0)', 'pc_0', 4)}, {r('max(v) FILTER (i = 1)', 'pc_1', 4)} FROM pc GROUP BY 1")
def _(spark, sf):
    out, names, _ = M.reduce_features(view(spark, sf, "vertices"), XYZ, 0.0, "standard", 2)
    return rounded(out.select("vertex_id", *[F.abs(n).alias(n) for n in names]), 4)


# Three well separated groups of vertices: what a sound clusterer must find again.
_GROUPS = V + f""", gp AS (SELECT label % 3 AS g, x / 20 + (label % 3) * 60 AS x, y / 20 - (label % 3) * 40 AS y FROM vertices)
SELECT count(*) AS n, {r("avg(x)", "x", 4)}, {r("avg(y)", "y", 4)} FROM gp GROUP BY g"""


def _grouped(spark, sf):
    v = view(spark, sf, "vertices").withColumn("session_id", F.concat(F.lit("s"), (F.floor(F.col("vertex_id") / 3) % 4).cast("string")))
    g = (F.col("label") % 3).cast("double")
    return v.withColumns({"x": F.col("x") / 20 + g * 60, "y": F.col("y") / 20 - g * 40})


def _clusters(name, spark, sf, **options):
    """Options given as fractions are shares of the rows."""
    data = _grouped(spark, sf)
    n = data.count()
    options = {k: max(2, int(n * v)) if isinstance(v, float) else v for k, v in options.items()}
    out, _ = cluster(name, data, ["x", "y"], options)
    return rounded(out.filter("cluster_label >= 0").groupBy("cluster_label").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).drop("cluster_label"), 4)


@query("kmeans_clusters", _GROUPS)
def _(spark, sf):
    return _clusters("kmeans", spark, sf, min_touches_per_cluster=0.22)


@query("gmm_clusters", _GROUPS)
def _(spark, sf):
    return _clusters("gmm", spark, sf, min_touches_per_component=0.22)


@query("hierarchical_strata", _GROUPS)
def _(spark, sf):
    return _clusters("hierarchical", spark, sf, min_instances_per_sensor=0.055, min_sensor_types=3)


def dbscan_sql(points: str, columns: list[str], eps: float, least: int) -> str:
    """Tables dn (labelled clusters) and dl (point, label) over a table with ``pid`` and the columns: neighbours by brute force, components by recursion."""
    d = len(columns)
    away = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns)
    cell = "[" + ", ".join(f"floor({c} / {eps / math.sqrt(d)!r})" for c in columns) + "]"
    return f"""dp AS (SELECT pid, {cell} AS cell, {', '.join(columns)} FROM {points}),
nb AS (SELECT a.pid AS a, b.pid AS b FROM dp a JOIN dp b ON {away} <= {eps * eps!r}), core AS (SELECT a AS pid FROM nb GROUP BY 1 HAVING count(*) >= {least}),
ce AS (SELECT a, b FROM nb SEMI JOIN core x ON x.pid = a SEMI JOIN core y ON y.pid = b),
reach AS (SELECT pid, pid AS seen FROM core UNION SELECT reach.pid, ce.b FROM reach JOIN ce ON ce.a = reach.seen),
own AS (SELECT reach.pid, min(cell) AS root FROM reach JOIN dp ON dp.pid = seen GROUP BY 1),
lab AS (SELECT pid, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS k FROM own),
dl AS (SELECT dp.pid, coalesce(min(l.k), min(n.k), -1) AS cluster_label FROM dp LEFT JOIN lab l ON l.pid = dp.pid LEFT JOIN nb ON nb.a = dp.pid LEFT JOIN lab n ON n.pid = nb.b GROUP BY 1)
"""


VR = V.replace("WITH", "WITH RECURSIVE", 1)
_V_POINTS = VR + ", vp AS (SELECT vertex_id AS pid, x, y, z FROM vertices), "


@query("dbscan_clusters", _V_POINTS + dbscan_sql("vp", XYZ, 6.0, 6) + "SELECT pid AS vertex_id, cluster_label FROM dl")
def _(spark, sf):
    v = view(spark, sf, "vertices")
    return D.dbscan_labels(v.select("vertex_id", *XYZ), [], XYZ, 6.0, 6).select("vertex_id", "cluster_label")


TEN = [f"f{i}" for i in range(10)]


def _ten(spark, sf):
    """Ten dimensions of the embeddings, as points."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("pid"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(TEN)])


@query("dbscan_ten_dimensions", "WITH RECURSIVE tp AS (SELECT vec_id AS pid, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(TEN)) + " FROM embeddings), "
       + dbscan_sql("tp", TEN, 0.33, 4) + "SELECT pid, cluster_label FROM dl")
def _(spark, sf):
    return D.dbscan_labels(_ten(spark, sf), [], TEN, 0.33, 4).select("pid", "cluster_label")


@query("dbscan_k_distances", V + f"""SELECT x, y, _w, {r("ds[5]", "k_distance")} FROM (SELECT a.x, a.y, count(DISTINCT a.vertex_id) AS _w, list(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS ds
 FROM vertices a, vertices b GROUP BY 1, 2)""".replace("SELECT x, y,", f"SELECT {r('x', 'x')}, {r('y', 'y')},"))
def _(spark, sf):
    return rounded(D.k_distances(view(spark, sf, "vertices"), ["x", "y"], 5), 6)


@query("dbscan_auto_eps", V + f""", kd AS (SELECT a.vertex_id, list_sort(list(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)))[5] AS d FROM vertices a, vertices b GROUP BY 1),
o AS (SELECT d, lag(d) OVER w AS p, lead(d) OVER w AS n, row_number() OVER w AS i FROM kd WINDOW w AS (ORDER BY d))
SELECT {r("arg_max(d, struct_pack(bend := n - 2 * d + p, i := -i))", "eps")} FROM o WHERE p IS NOT NULL AND n IS NOT NULL""")
def _(spark, sf):
    v = view(spark, sf, "vertices")
    eps = D.auto_eps(v, ["x", "y"], 5)
    return rounded(v.agg(F.lit(eps).alias("eps")))


_SEL = ctes("contacts").replace("WITH", "WITH RECURSIVE", 1) + """, sp AS (SELECT x, y, z, avg(spike) AS selectivity FROM contacts GROUP BY 1, 2, 3 HAVING avg(spike) >= 0.75),
vp AS (SELECT row_number() OVER (ORDER BY x, y, z) AS pid, * FROM sp), """


@query("selective_point_clusters", _SEL + dbscan_sql("vp", XYZ, 2.5, 4) + f"""SELECT cluster_label, count(*) AS n_points, {r("avg(selectivity)", "mean_selectivity", 4)}, {', '.join(r(f"avg({c})", f"center_{c}", 4) for c in XYZ)}
FROM dl JOIN vp USING (pid) WHERE cluster_label >= 0 GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, sf):
    p = S.selectivity(view(spark, sf, "contacts"), [], XYZ)
    return rounded(D.cluster_points(p, XYZ, "selectivity", 0.75, 2.5, 4, 3), 4)


@query("point_blobs", VR + ", vp AS (SELECT vertex_id AS pid, x, y FROM vertices), " + dbscan_sql("vp", ["x", "y"], 2.0, 1) + "SELECT pid AS vertex_id, cluster_label FROM dl")
def _(spark, sf):
    return D.blobs(view(spark, sf, "vertices").select("vertex_id", "x", "y"), ["x", "y"], 2.0).select("vertex_id", "cluster_label")


@query("centroid_quality", V + f""", m AS (SELECT label, count(*) n, avg(x) mx, avg(y) my, avg(z) mz, var_pop(x) + var_pop(y) + var_pop(z) AS v FROM vertices GROUP BY 1),
s AS (SELECT label, avg(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) AS s FROM vertices JOIN m USING (label) GROUP BY 1), ms AS (SELECT * FROM m JOIN s USING (label)),
db AS (SELECT avg(w) AS db FROM (SELECT a.label, max((a.s + b.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 + (a.mz - b.mz) ** 2)) AS w FROM ms a JOIN ms b ON a.label <> b.label GROUP BY 1)),
g AS (SELECT avg(x) gx, avg(y) gy, avg(z) gz, count(*) AS n FROM vertices)
SELECT count(*) AS n_clusters, {r("min(db)", "davies_bouldin_score")}, {r("(sum(m.n * ((mx - gx) ** 2 + (my - gy) ** 2 + (mz - gz) ** 2)) / (count(*) - 1)) / (sum(m.n * v) / (min(g.n) - count(*)))", "calinski_harabasz_score")} FROM m, g, db""")
def _(spark, sf):
    return rounded(M.centroid_quality(view(spark, sf, "vertices"), XYZ, "label"))


@query("cluster_description", T + f""", c AS (SELECT *, CAST(floor(depth_max / 10) AS INT) AS cluster_label FROM touches)
SELECT session_id, cluster_label, count(*) AS n_touches, round_even(min(iff_max), 2) AS iff_max_min, round_even(max(iff_max), 2) AS iff_max_max, {r("round_even(avg(iff_max), 2)", "iff_max_mean", 1)},
 {r("round_even(count(*) FILTER (gesture_type = 'tap') / count(*), 3)", "tap_share", 3)} FROM c GROUP BY 1, 2""")
def _(spark, sf):
    c = view(spark, sf, "touches").withColumn("cluster_label", F.floor(F.col("depth_max") / 10).cast("int"))
    out = M.describe_clusters(c, ["iff_max"], ["session_id", "cluster_label"])
    out = out.withColumn("tap_share", F.coalesce(F.col("gesture_share")["tap"], F.lit(0.0))).drop("gesture_share")
    return rounded(out, 6, iff_max_mean=1, tap_share=3)


@query("bootstrap_stability", V + " SELECT count(*) AS n, 1.0::DOUBLE AS bootstrap_ari FROM vertices")
def _(spark, sf):
    # Separated groups keep their bins on every subsample.
    v = _grouped(spark, sf)
    value = M.stability(v, ["x", "y"], "cartesian_binning", {"n_bins": 3}, keys=["vertex_id"])
    return rounded(v.agg(F.count("*").alias("n"), F.lit(value).alias("bootstrap_ari")))


# --- fits ------------------------------------------------------------------------------

_XY = T + ", d AS (SELECT session_id, gesture_type, velocity_max AS x, depth_max + iff_max AS y FROM touches)"


def _d(spark, sf):
    return view(spark, sf, "touches").select("session_id", "gesture_type", F.col("velocity_max").alias("x"), (F.col("depth_max") + F.col("iff_max")).alias("y"))


@query("line_fit", _XY + f"SELECT session_id, gesture_type, count(*) AS n, {r('regr_slope(y, x)', 'a')}, {r('regr_intercept(y, x)', 'b')}, {r('regr_r2(y, x)', 'r_squared')} FROM d GROUP BY 1, 2")
def _(spark, sf):
    return rounded(J.line_fit(_d(spark, sf), ["session_id", "gesture_type"], "x", "y"))


@query("log_fit", _XY + f"SELECT session_id, count(*) AS n, {r('regr_slope(y, ln(greatest(x, 1e-12)))', 'a')}, {r('regr_intercept(y, ln(greatest(x, 1e-12)))', 'b')}, {r('regr_r2(y, ln(greatest(x, 1e-12)))', 'r_squared')} FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(J.line_fit(_d(spark, sf), ["session_id"], "x", "y", log=True))


@query("quadratic_fit", _XY + f""", m AS (SELECT session_id, avg(x) mx, avg(y) my FROM d GROUP BY 1), c AS (SELECT session_id, x - mx AS u, y - my AS w, mx, my FROM d JOIN m USING (session_id)),
s AS (SELECT session_id, count(*) n, sum(u * u) s2, sum(u * u * u) s3, sum(u * u * u * u) s4, sum(u * w) b1, sum(u * u * w) b2, sum(w * w) yy, min(mx) mx, min(my) my FROM c GROUP BY 1),
q AS (SELECT *, (b2 * s2 - b1 * s3) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS a FROM s)
SELECT session_id, n, {r("a", "a2", 7)}, {r("(b1 - a * s3) / s2 - 2 * a * mx", "a1", 5)} FROM q""")
def _(spark, sf):
    p = J.polynomial_fit(_d(spark, sf), ["session_id"], "x", "y", 2)
    return rounded(p.select("session_id", "n", F.get("coefficients", F.lit(0)).alias("a2"), F.get("coefficients", F.lit(1)).alias("a1")), 5, a2=7)


def _orthogonal(top: int) -> str:
    """R-squared of each degree by polynomials that are orthogonal over a session's own x, one recursion step a table."""
    text = _XY + """, o AS (SELECT session_id, y - avg(y) OVER (PARTITION BY session_id) AS y, 2 * (x - min(x) OVER (PARTITION BY session_id)) / (max(x) OVER (PARTITION BY session_id) - min(x) OVER (PARTITION BY session_id)) - 1 AS x FROM d),
q0 AS (SELECT *, 0.0::DOUBLE AS pp, 1.0::DOUBLE AS p, 0.0::DOUBLE AS fit, 1.0::DOUBLE AS nn FROM o)"""
    for k in range(1, top + 1):
        text += f""",
m{k} AS (SELECT session_id, sum(x * p * p) / sum(p * p) AS a, sum(p * p) / min(nn) AS b, sum(p * p) AS own FROM q{k - 1} GROUP BY 1),
t{k} AS (SELECT session_id, y, x, p AS pp, (x - a) * p - {'b' if k > 1 else '0'} * pp AS p, fit, own AS nn FROM q{k - 1} JOIN m{k} USING (session_id)),
c{k} AS (SELECT session_id, sum(y * p) / sum(p * p) AS c FROM t{k} GROUP BY 1),
q{k} AS (SELECT t{k}.session_id, y, x, pp, p, fit + c * p AS fit, nn FROM t{k} JOIN c{k} USING (session_id))"""
    return text + "\n"


@query("polynomial_fit", _orthogonal(9) + " UNION ALL ".join(
    f"SELECT session_id, {k} AS degree, count(*) AS n, {r('sum(fit * fit) / sum(y * y)', 'r_squared')} FROM q{k} GROUP BY 1" for k in (3, 5, 7, 9)))
def _(spark, sf):
    d = _d(spark, sf)
    fits = [J.polynomial_fit(d, ["session_id"], "x", "y", k).select("session_id", F.lit(k).alias("degree"), "n", "r_squared") for k in (3, 5, 7, 9)]
    return rounded(reduce(DataFrame.unionByName, fits), 6)


@query("r_squared", _XY + f"""SELECT session_id, {r("1 - sum((y - (0.2 * x + 10)) ** 2) / (count(*) * var_pop(y))", "r_squared")} FROM d GROUP BY 1""")
def _(spark, sf):
    return rounded(J.r_squared(_d(spark, sf), ["session_id"], "y", F.col("x") * 0.2 + 10.0))


@query("saturating_fit", _XY + "SELECT gesture_type, count(*) AS n_rows, true AS converged, true AS stationary FROM d GROUP BY 1")
def _(spark, sf):
    """Noisy rows: at the parameters found, the residual is orthogonal to the curve's derivatives."""
    d = _d(spark, sf).withColumn("y", F.col("y") / 10 + F.lit(8.0) * (1 - F.exp(F.col("x") * -0.05)))
    fit = J.model_fit(d, ["gesture_type"], "x", "y", "exp_sat")
    e = F.exp(-F.col("b") * F.col("x"))
    res = F.col("y") - (F.col("a") * (1 - e) + F.col("c"))
    slopes = [1 - e, F.col("a") * F.col("x") * e, F.lit(1.0)]
    tilt = [F.abs(F.sum(res * g)) / F.sqrt(F.sum(res * res) * F.sum(g * g)) < 1e-3 for g in slopes]
    return d.join(fit, "gesture_type").groupBy("gesture_type").agg(
        F.count("*").alias("n_rows"), F.min("converged").alias("converged"), (tilt[0] & tilt[1] & tilt[2]).alias("stationary"))


# Exact curves over the touches' velocities: parameters that must come back.
_CURVES = {
    "power": [3.0, 0.7, 2.0], "naka_rushton": [40.0, 2.0, 5.0, 1.0], "sigmoid": [20.0, 0.9, 5.0, 2.0], "exp_sat": [8.0, 0.5, 3.0],
}


@query("curve_fits", _XY + " UNION ALL ".join(
    f"SELECT '{m}' AS model, gesture_type, count(*) AS n_rows, {', '.join(f'{v!r}::DOUBLE AS p{i}' for i, v in enumerate([*p, *[0.0] * (4 - len(p))]))}, 1.0::DOUBLE AS r_squared, true AS converged FROM d GROUP BY 2"
    for m, p in _CURVES.items()))
def _(spark, sf):
    d = cut_lineage(_d(spark, sf).withColumn("x", F.col("x") / 10))
    fits = []
    for name, p in _CURVES.items():
        spec = J.MODELS[name]
        fit = J.model_fit(d.withColumn("y", spec.value([F.col("x")], [F.lit(v) for v in p], F)), ["gesture_type"], "x", "y", name)
        values = [F.col(c) for c in spec.parameters] + [F.lit(0.0)] * (4 - len(p))
        fits.append(fit.select(F.lit(name).alias("model"), "gesture_type", "n_rows", *[v.alias(f"p{i}") for i, v in enumerate(values)], "r_squared", "converged"))
    return rounded(reduce(DataFrame.unionByName, fits), 3)


@query("gaussian_map_fit", ctes("raster") + """ SELECT session_id, count(*) AS n, 24.0::DOUBLE AS x0, 5.2::DOUBLE AS y0, 9.0::DOUBLE AS sigma_major, 2.2::DOUBLE AS sigma_minor,
 5.0::DOUBLE AS amplitude, 1.0::DOUBLE AS "offset", 1.0::DOUBLE AS r_squared, true AS converged FROM (SELECT DISTINCT session_id, r, c FROM raster) GROUP BY 1""")
def _(spark, sf):
    """An exact turned bump over the cells that a session's touches cover."""
    u, v = F.col("r").cast("double"), F.col("c").cast("double")
    a, b = (u - 24) * math.cos(0.1) + (v - 5.2) * math.sin(0.1), (v - 5.2) * math.cos(0.1) - (u - 24) * math.sin(0.1)
    x = view(spark, sf, "raster").select("session_id", "r", "c").distinct().select(
        "session_id", u.alias("u"), v.alias("v"), (F.exp((a * a / 81.0 + b * b / 4.84) * -0.5) * 5 + 1).alias("w"))
    return rounded(J.gaussian_fit(x, ["session_id"], "u", "v", "w").drop("theta_deg"), 2)
