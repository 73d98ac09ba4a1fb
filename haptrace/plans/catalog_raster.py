"""Queries on rasters: smoothing, derivatives, boundaries, polygons, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from haptrace.operators import raster as R
from haptrace.plans import fields
from haptrace.plans.catalog_surface import _hits, _rows
from haptrace.plans.inputs import RASTER, ctes, view
from haptrace.plans.registry import query, r, rounded
from haptrace.operators import surface as S
from haptrace.schema import KEYS

BY = ["session_id", "gesture_type"]
B = "session_id, gesture_type"
ROWS, COLS = 50, 11
# Every third lattice diagonal is unknown, so that gaps are exercised.
RAS = ctes("raster") + """, ras AS (SELECT * REPLACE (CASE WHEN (r + 2 * c) % 7 <> 3 THEN z / n END AS z) FROM raster),
"""


def _ras(spark, sf):
    return view(spark, sf, "raster").withColumn("z", F.when((F.col("r") + 2 * F.col("c")) % 7 != 3, F.col("z") / F.col("n")))


def _kern(name, n, axis):
    return f"""{name}w AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-4, 5) q(e)) AS w FROM range(-4, 5) p(d)),
{name} AS (SELECT CAST(i AS INT) AS dst, CAST(CASE WHEN (i + d + {2 * n}) % {2 * n} >= {n} THEN {2 * n} - 1 - (i + d + {2 * n}) % {2 * n} ELSE (i + d + {2 * n}) % {2 * n} END AS INT) AS src, sum(w) AS w FROM range({n}) g(i), {name}w GROUP BY 1, 2),
"""


SMOOTH = RAS + _kern("kr", ROWS, "r") + _kern("kc", COLS, "c") + f"""
p1 AS (SELECT {B}, dst AS r, c, sum(z * w) AS s, sum(w) AS k FROM ras JOIN kr ON r = src WHERE z IS NOT NULL GROUP BY {B}, dst, c),
p2 AS (SELECT {B}, r, dst AS c, sum(s * w) / sum(k * w) AS smooth FROM p1 JOIN kc ON c = src GROUP BY {B}, r, dst),
lat AS (SELECT {B}, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM (SELECT DISTINCT {B} FROM ras), range({ROWS}) x(a), range({COLS}) y(b)),
sm AS (SELECT lat.*, z, smooth FROM lat LEFT JOIN (SELECT {B}, r, c, z FROM ras) q USING ({B}, r, c) LEFT JOIN p2 USING ({B}, r, c)),
wr AS (SELECT *, lag(smooth) OVER a AS up, lead(smooth) OVER a AS dn, lag(smooth) OVER b AS lf, lead(smooth) OVER b AS rt,
  lag(CASE WHEN z IS NULL THEN 0 ELSE smooth END) OVER a AS gup, lead(CASE WHEN z IS NULL THEN 0 ELSE smooth END) OVER a AS gdn,
  lag(CASE WHEN z IS NULL THEN 0 ELSE smooth END) OVER b AS glf, lead(CASE WHEN z IS NULL THEN 0 ELSE smooth END) OVER b AS grt FROM sm
  WINDOW a AS (PARTITION BY {B}, c ORDER BY r), b AS (PARTITION BY {B}, r ORDER BY c)),
dv AS (SELECT {B}, r, c, z, smooth, CASE WHEN z IS NOT NULL THEN coalesce(up, smooth) + coalesce(dn, smooth) + coalesce(lf, smooth) + coalesce(rt, smooth) - 4 * smooth END AS laplacian,
 CASE WHEN z IS NOT NULL THEN sqrt(pow(CASE WHEN gup IS NULL THEN gdn - smooth WHEN gdn IS NULL THEN smooth - gup ELSE (gdn - gup) / 2 END, 2) + pow(CASE WHEN glf IS NULL THEN grt - smooth WHEN grt IS NULL THEN smooth - glf ELSE (grt - glf) / 2 END, 2)) END AS gradient FROM wr)
"""


@query("raster_smoothing", SMOOTH + f"SELECT {B}, r, c, {r('smooth', 'smooth')} FROM sm")
def _(spark, sf):
    return rounded(R.smooth(_ras(spark, sf), BY, ROWS, COLS, 1.0).select(*BY, "r", "c", "smooth"))


@query("raster_derivatives", SMOOTH + f"SELECT {B}, r, c, {r('laplacian', 'laplacian')}, {r('gradient', 'gradient')} FROM dv")
def _(spark, sf):
    s = R.smooth(_ras(spark, sf), BY, ROWS, COLS, 1.0)
    return rounded(R.gradient(R.laplacian(s, BY), BY).select(*BY, "r", "c", "laplacian", "gradient"))


@query("raster_peaks", RAS + f"""q AS (SELECT *, row_number() OVER (PARTITION BY {B} ORDER BY z DESC NULLS LAST, r, c) AS k FROM ras)
SELECT {B}, r AS peak_r, c AS peak_c, {r("z", "peak_value")} FROM q WHERE k = 1""")
def _(spark, sf):
    return rounded(R.peaks(_ras(spark, sf), BY))


@query("rasterised_points", ctes("vertices") + f""", v AS (SELECT label % 3 AS g, x AS u, y AS v, z + 100 AS val FROM vertices),
e AS (SELECT g, min(u) - 0.05 * (max(u) - min(u)) u0, max(u) + 0.05 * (max(u) - min(u)) u1, min(v) - 0.05 * (max(v) - min(v)) v0, max(v) + 0.05 * (max(v) - min(v)) v1 FROM v GROUP BY 1)
SELECT v.g, CAST(round((u - u0) / (u1 - u0) * 19) AS INT) AS r, CAST(round((v.v - v0) / (v1 - v0) * 19) AS INT) AS c, {r("avg(val)", "z")} FROM v JOIN e USING (g) GROUP BY 1, 2, 3""")
def _(spark, sf):
    v = view(spark, sf, "vertices").select((F.col("label") % 3).alias("g"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("z") + 100).alias("val"))
    return rounded(R.rasterise(v, ["g"], "val", 20, 20, reach=0).select("g", "r", "c", "z"))


@query("filled_raster", ctes("vertices") + f""", v AS (SELECT label % 3 AS g, x AS u, y AS v, z + 100 AS val FROM vertices),
e AS (SELECT g, min(u) - 0.05 * (max(u) - min(u)) u0, max(u) + 0.05 * (max(u) - min(u)) u1, min(v) - 0.05 * (max(v) - min(v)) v0, max(v) + 0.05 * (max(v) - min(v)) v1 FROM v GROUP BY 1),
k AS (SELECT v.g, CAST(round((u - u0) / (u1 - u0) * 19) AS INT) AS r, CAST(round((v.v - v0) / (v1 - v0) * 19) AS INT) AS c, avg(val) AS z FROM v JOIN e USING (g) GROUP BY 1, 2, 3),
f AS (SELECT g, CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c, coalesce(max(z) FILTER (i = 0 AND j = 0), sum(z / (i * i + j * j)) FILTER (i <> 0 OR j <> 0) / sum(1 / (i * i + j * j)) FILTER (i <> 0 OR j <> 0)) AS z
  FROM k, range(-2, 3) p(i), range(-2, 3) q(j) WHERE r + i BETWEEN 0 AND 19 AND c + j BETWEEN 0 AND 19 GROUP BY 1, 2, 3),
m AS (SELECT a.g, a.r, a.c, median(b.z) AS z FROM f a JOIN f b ON a.g = b.g AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3)
SELECT m.g, r, c, {r("u0 + r * (u1 - u0) / 19", "u")}, {r("v0 + c * (v1 - v0) / 19", "v")}, {r("greatest(z, 0)", "z")} FROM m JOIN e USING (g)""")
def _(spark, sf):
    v = view(spark, sf, "vertices").select((F.col("label") % 3).alias("g"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("z") + 100).alias("val"))
    return rounded(R.rasterise(v, ["g"], "val", 20, 20, reach=2, median=3))


@query("distance_masked_raster", ctes("vertices") + f""", e AS (SELECT min(x) - 0.05 * (max(x) - min(x)) u0, max(x) + 0.05 * (max(x) - min(x)) u1, min(y) - 0.05 * (max(y) - min(y)) v0, max(y) + 0.05 * (max(y) - min(y)) v1 FROM vertices),
g AS (SELECT CAST(a AS INT) r, CAST(b AS INT) c, u0 + a * (u1 - u0) / 29 AS u, v0 + b * (v1 - v0) / 29 AS v FROM e, range(30) x(a), range(30) y(b)),
d AS (SELECT r, c, min(sqrt((u - x) * (u - x) + (g.v - y) * (g.v - y))) AS d FROM g, vertices GROUP BY 1, 2)
SELECT r, c, {r("CASE WHEN d <= 3 THEN d END", "distance")} FROM d""")
def _(spark, sf):
    p = view(spark, sf, "vertices").select(F.lit(1).alias("g"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("vertex_id").alias("point_id"))
    return rounded(R.masked_lattice(p, ["g"], 30, 30, 3.0).select("r", "c", "distance"))


# A closed polygon of each session and gesture: 24 directions, radius from the mean response of a direction.
POLY = ctes("contacts") + f""", pd AS (SELECT {B}, CAST(single_touch_id % 24 AS INT) AS k, avg(iff) AS rad FROM contacts GROUP BY 1, 2, 3),
pt AS (SELECT {B}, k, rad * cos(k * 0.2617993877991494) AS u, rad * sin(k * 0.2617993877991494) AS v FROM pd),
ed AS (SELECT {B}, k, u AS u1, v AS v1, coalesce(lead(u) OVER w, first(u) OVER (PARTITION BY {B} ORDER BY k)) AS u2, coalesce(lead(v) OVER w, first(v) OVER (PARTITION BY {B} ORDER BY k)) AS v2 FROM pt WINDOW w AS (PARTITION BY {B} ORDER BY k)),
"""


def _poly(spark, sf):
    d = view(spark, sf, "contacts").groupBy(*BY, (F.col("single_touch_id") % 24).cast("int").alias("k")).agg(F.avg("iff").alias("rad"))
    p = F.struct("k", (F.col("rad") * F.cos(F.col("k") * 0.2617993877991494)).alias("u"), (F.col("rad") * F.sin(F.col("k") * 0.2617993877991494)).alias("v"))
    return d.groupBy(*BY).agg(F.array_sort(F.collect_list(p)).alias("contour"))  # 24 points each


@query("polygon_metrics", POLY + f"""a AS (SELECT {B}, count(*) AS n_points, sum(u1 * v2 - u2 * v1) / 2 AS s, sum(sqrt((u1 - u2) * (u1 - u2) + (v1 - v2) * (v1 - v2))) AS per,
 sum((u1 + u2) * (u1 * v2 - u2 * v1)) su, sum((v1 + v2) * (u1 * v2 - u2 * v1)) sv, covar_pop(u1, u1) a, covar_pop(u1, v1) b, covar_pop(v1, v1) d FROM ed GROUP BY 1, 2)
SELECT {B}, n_points, {r("abs(s)", "area", 4)}, {r("per", "perimeter", 4)}, {r("4 * pi() * abs(s) / (per * per)", "circularity")}, {r("su / (6 * s)", "centroid_u")}, {r("sv / (6 * s)", "centroid_v")},
 {r("2 * sqrt((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b))", "pca_major", 4)}, {r("2 * sqrt((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b))", "pca_minor", 4)}, {r("degrees(atan2(2 * b, a - d) / 2)", "pca_orientation_deg", 3)} FROM a""")
def _(spark, sf):
    return rounded(R.polygon_metrics(_poly(spark, sf), BY), 4, circularity=6, centroid_u=6, centroid_v=6, pca_orientation_deg=3)


_X = "ed JOIN ln USING (session_id, gesture_type) WHERE line >= least(v1, v2) AND line < greatest(v1, v2)"


@query("scan_line_crossings", POLY + f"""ln AS (SELECT DISTINCT {B}, round(v / 5) * 5 + 0.25 AS line FROM pt)
SELECT {B}, line, count(*) AS n, {r("min(u1 + (line - v1) * (u2 - u1) / (v2 - v1))", "first_u")}, {r("max(u1 + (line - v1) * (u2 - u1) / (v2 - v1))", "last_u")} FROM {_X} GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = _poly(spark, sf)
    lines = p.select(*BY, F.explode("contour").alias("p")).select(*BY, (F.round(F.col("p.v") / 5) * 5 + 0.25).alias("line")).distinct()
    x = R.crossings(p, lines, BY)
    return rounded(x.select(*BY, "line", F.size("crossings").cast("long").alias("n"), F.get("crossings", F.lit(0)).alias("first_u"),
                            F.get("crossings", F.size("crossings") - 1).alias("last_u")))


_PTS = f"cp AS (SELECT DISTINCT {B}, x AS u, y AS v, CAST(x + 25 AS INT) AS r, CAST(y + 20 AS INT) AS c FROM contacts), "


@query("contour_overlap", POLY + _PTS + f"""ins AS (SELECT cp.*, count(*) FILTER (u < u1 + (cp.v - v1) * (u2 - u1) / (v2 - v1)) % 2 AS odd FROM cp JOIN ed USING ({B}) WHERE (v1 > cp.v) <> (v2 > cp.v) GROUP BY ALL),
q AS (SELECT session_id, gesture_type, r, c FROM ins WHERE odd = 1), a AS (SELECT session_id, r, c FROM q WHERE gesture_type = 'tap'), b AS (SELECT session_id, r, c FROM q WHERE gesture_type = 'stroke_distal'),
f AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, count(a.r) AS na, count(b.r) AS nb, count(*) AS u, count(a.r + b.r) AS i FROM a FULL JOIN b ON a.session_id = b.session_id AND a.r = b.r AND a.c = b.c GROUP BY 1)
SELECT session_id, {r("i / u", "iou")}, {r("2 * i / (na + nb)", "dice")}, {r("i / na", "containment_a")}, {r("i / nb", "containment_b")} FROM f""")
def _(spark, sf):
    cells = view(spark, sf, "contacts").select(*BY, F.col("x").alias("u"), F.col("y").alias("v"), (F.col("x") + 25).cast("int").alias("r"), (F.col("y") + 20).cast("int").alias("c")).distinct()
    q = R.inside_polygon(cells, _poly(spark, sf), BY)
    return rounded(R.mask_overlap(q.filter("gesture_type = 'tap'"), q.filter("gesture_type = 'stroke_distal'"), ["session_id"]))


@query("map_similarity", RAS + f"""j AS (SELECT a.session_id, a.z AS za, b.z AS zb FROM ras a JOIN ras b ON a.session_id = b.session_id AND a.r = b.r AND a.c = b.c WHERE a.gesture_type = 'tap' AND b.gesture_type = 'stroke_distal' AND a.z IS NOT NULL AND b.z IS NOT NULL)
SELECT session_id, count(*) AS n, {r("corr(za, zb)", "pearson_r")} FROM j GROUP BY 1""")
def _(spark, sf):
    x = _ras(spark, sf)
    return rounded(R.map_similarity(x.filter("gesture_type = 'tap'"), x.filter("gesture_type = 'stroke_distal'"), ["session_id"]))


@query("highest_level_center", RAS + f"""e AS (SELECT {B}, min(z) lo, max(z) hi FROM ras GROUP BY 1, 2)
SELECT {B}, {r("avg(u)", "center_u")}, {r("avg(v)", "center_v")} FROM ras JOIN e USING ({B}) WHERE z >= lo + (hi - lo) * 6 / 7 GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(R.highest_center(_ras(spark, sf), BY))


@query("bilinear_samples", RAS + f"""m AS (SELECT {B}, avg(z) AS mean FROM ras GROUP BY 1, 2), p AS (SELECT {B}, r + 25e-2 AS row, c + 6e-1 AS col, r, c FROM ras WHERE r < {ROWS - 1} AND c < {COLS - 1}),
lt AS (SELECT {B}, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM (SELECT DISTINCT {B} FROM ras), range({ROWS}) x(a), range({COLS}) y(b)),
f AS (SELECT {B}, r, c, coalesce(z, mean) AS z FROM lt LEFT JOIN (SELECT {B}, r, c, z FROM ras) q USING ({B}, r, c) JOIN m USING ({B}))
SELECT p.session_id, p.gesture_type, row, col, {r("0.75 * 0.4 * a.z + 0.75 * 0.6 * b.z + 0.25 * 0.4 * d.z + 0.25 * 0.6 * e.z", "sampled")} FROM p
 JOIN f a ON a.session_id = p.session_id AND a.gesture_type = p.gesture_type AND a.r = p.r AND a.c = p.c JOIN f b ON b.session_id = p.session_id AND b.gesture_type = p.gesture_type AND b.r = p.r AND b.c = p.c + 1
 JOIN f d ON d.session_id = p.session_id AND d.gesture_type = p.gesture_type AND d.r = p.r + 1 AND d.c = p.c JOIN f e ON e.session_id = p.session_id AND e.gesture_type = p.gesture_type AND e.r = p.r + 1 AND e.c = p.c + 1""")
def _(spark, sf):
    x = _ras(spark, sf)
    p = x.filter(f"r < {ROWS - 1} AND c < {COLS - 1}").select(*BY, (F.col("r") + 0.25).cast("double").alias("row"), (F.col("c") + 0.6).cast("double").alias("col"))
    return rounded(R.sample(p, x, BY, ROWS, COLS).select(*BY, "row", "col", "sampled"))


@query("nearest_profile_line", RAS + f"""w AS (SELECT session_id, sum(v * z) / sum(z) AS center FROM ras WHERE z IS NOT NULL GROUP BY 1)
SELECT session_id, arg_min(c, struct_pack(d := abs(v - center), c := c)) AS line_index FROM ras JOIN w USING (session_id) GROUP BY 1""")
def _(spark, sf):
    x = _ras(spark, sf)
    w = x.filter("z IS NOT NULL").groupBy("session_id").agg((F.sum(F.col("v") * F.col("z")) / F.sum("z")).alias("center"))
    return R.nearest_line(x.join(w, "session_id"), ["session_id"], "v", "center")


# Rays from inner peaks; the gradient (0 where unknown) between four cells, the first largest along a ray.
_RIDGE = SMOOTH + f""", pk AS (SELECT {B}, r AS peak_r, c AS peak_c FROM (SELECT *, row_number() OVER (PARTITION BY {B} ORDER BY z DESC NULLS LAST, r, c) AS k FROM ras)
  WHERE k = 1 AND r BETWEEN 2 AND {ROWS - 3} AND c BETWEEN 2 AND {COLS - 3}),
st AS (SELECT {B}, peak_r, peak_c, CAST(a AS INT) AS angle_index, CAST(d AS INT) AS d, peak_r + d * cos(a * 2 * pi() / 360) AS y, peak_c + d * sin(a * 2 * pi() / 360) AS x
  FROM pk, range(360) p(a), range(1, {math.ceil(math.hypot(ROWS, COLS))}) q(d)),
si AS (SELECT *, CAST(floor(y) AS INT) AS r0, CAST(floor(x) AS INT) AS c0 FROM st WHERE y >= 0 AND y < {ROWS - 1} AND x >= 0 AND x < {COLS - 1}),
gg AS (SELECT {B}, r, c, coalesce(gradient, 0) AS g FROM dv),
sv AS (SELECT si.*, (1 - (y - r0)) * (1 - (x - c0)) * e.g + (1 - (y - r0)) * (x - c0) * f.g + (y - r0) * (1 - (x - c0)) * h.g + (y - r0) * (x - c0) * i.g AS s FROM si
  JOIN gg e ON e.session_id = si.session_id AND e.gesture_type = si.gesture_type AND e.r = r0 AND e.c = c0 JOIN gg f ON f.session_id = si.session_id AND f.gesture_type = si.gesture_type AND f.r = r0 AND f.c = c0 + 1
  JOIN gg h ON h.session_id = si.session_id AND h.gesture_type = si.gesture_type AND h.r = r0 + 1 AND h.c = c0 JOIN gg i ON i.session_id = si.session_id AND i.gesture_type = si.gesture_type AND i.r = r0 + 1 AND i.c = c0 + 1),
sb AS (SELECT {B}, angle_index, max(round(s, 9)) AS top, arg_max(d, struct_pack(s := round(s, 9), n := -d)) AS d FROM sv GROUP BY 1, 2, 3)
"""


@query("gradient_ridge_radii", _RIDGE + f"""SELECT {B}, peak_r, peak_c, angle_index, {r("angle_index * 2 * pi() / 360", "angle")}, CAST(CASE WHEN top >= 1e-9 THEN coalesce(d, 1) ELSE 1 END AS DOUBLE) AS radius
FROM (SELECT pk.*, CAST(a AS INT) AS angle_index FROM pk, range(360) p(a)) LEFT JOIN sb USING ({B}, angle_index)""")
def _(spark, sf):
    return rounded(R.ridge_radii(R.smooth(_ras(spark, sf), BY, ROWS, COLS, 1.0), BY, ROWS, COLS))


def _boundaries(spark, sf, method="inflection"):
    x = view(spark, sf, "raster").withColumn("z", F.col("z") / F.col("n"))
    x = x.withColumn("subset", F.explode(F.when(F.col("gesture_type") == "tap", F.array(F.lit("all"), F.lit("tap"))).otherwise(
        F.array(F.lit("all"), F.lit("stroke"), F.col("gesture_type")))))
    x = x.groupBy("session_id", "subset", "r", "c", "u", "v").agg(F.avg("z").alias("z"))
    # A hump over the lattice gives every raster an inner peak.
    hump = F.exp(-((F.col("r") - 25) * (F.col("r") - 25) / 150.0 + (F.col("c") - 5) * (F.col("c") - 5) / 12.0))
    x = x.withColumn("z", F.col("z") * hump)
    return R.with_derived(R.boundaries(x, ["session_id", "subset"], ROWS, COLS, method, 1.0)), x


@query("inflection_boundaries")
def _(spark, sf):
    return rounded(_boundaries(spark, sf)[0].drop("contour"), 4)


@query("gradient_boundaries")
def _(spark, sf):
    return rounded(_boundaries(spark, sf, "gradient")[0].drop("contour"), 4)


@query("boundary_profiles")
def _(spark, sf):
    b, x = _boundaries(spark, sf)
    return rounded(R.profiles(x, b.select("session_id", "subset", "contour"), ["session_id", "subset"]).drop("crossings"), 4)


@query("tap_stroke_comparison")
def _(spark, sf):
    b, x = _boundaries(spark, sf)
    return rounded(R.tap_stroke(b, raster=x, size=(ROWS, COLS)), 4)


@query("proximal_distal_comparison")
def _(spark, sf):
    b, x = _boundaries(spark, sf)
    return rounded(R.proximal_distal(b, raster=x, size=(ROWS, COLS)), 4)


# Maps and 24-cornered outlines of two gestures, the outlines in the maps' coordinates; the whole map is the proximal stroke's here.
_OUT = POLY + f"""raster AS ({RASTER}), ras AS (SELECT * REPLACE (CASE WHEN (r + 2 * c) % 7 <> 3 THEN z / n END AS z) FROM raster),
lt AS (SELECT session_id, a / 49.0 AS u, b / 10.0 AS v, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM (SELECT DISTINCT session_id FROM ras), range({ROWS}) x(a), range({COLS}) y(b)),
oe AS (SELECT session_id, gesture_type, 0.5 + u1 / 130 AS u1, 0.5 + v1 / 130 AS v1, 0.5 + u2 / 130 AS u2, 0.5 + v2 / 130 AS v2 FROM ed),
ins AS (SELECT lt.session_id, gesture_type, r, c FROM lt JOIN oe USING (session_id) WHERE (v1 > lt.v) <> (v2 > lt.v) GROUP BY ALL HAVING count(*) FILTER (lt.u < u1 + (lt.v - v1) * (u2 - u1) / (v2 - v1)) % 2 = 1),
ma AS (SELECT * FROM ins WHERE gesture_type = 'tap'), mb AS (SELECT * FROM ins WHERE gesture_type = 'stroke_distal'),
ov AS (SELECT coalesce(ma.session_id, mb.session_id) AS session_id, count(ma.r) AS na, count(mb.r) AS nb, count(*) AS un, count(ma.r + mb.r) AS it FROM ma FULL JOIN mb ON ma.session_id = mb.session_id AND ma.r = mb.r AND ma.c = mb.c GROUP BY 1),
co AS (SELECT a.session_id, corr(a.z, b.z) AS pr FROM ras a JOIN ras b ON a.session_id = b.session_id AND a.r = b.r AND a.c = b.c WHERE a.gesture_type = 'tap' AND b.gesture_type = 'stroke_distal' AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1),
lv AS (SELECT {B}, min(z) lo, max(z) hi FROM ras GROUP BY 1, 2), hc AS (SELECT {B}, avg(u) AS u, avg(v) AS v FROM ras JOIN lv USING ({B}) WHERE z >= lo + (hi - lo) * 6 / 7 GROUP BY 1, 2),
hs AS (SELECT session_id, {", ".join(f"max({x}) FILTER (gesture_type = '{g}') AS {x}{m}" for m, g in (("a", "tap"), ("b", "stroke_distal"), ("w", "stroke_proximal")) for x in "uv")} FROM hc GROUP BY 1)
"""


@query("gesture_map_comparison", _OUT + f"""SELECT session_id, {r("it / un", "iou")}, {r("2 * it / (na + nb)", "dice")}, {r("it / na", "containment_a")}, {r("it / nb", "containment_b")}, {r("pr", "pearson_r")},
 {r("80 * (ua - ub)", "contour_center_shift_along")}, {r("80 * (va - vb)", "contour_center_shift_across")}, {", ".join(r(f"80 * ({x}{m} - {x}w)", f"contour_center_offset_{x}_{m}") for m in "ab" for x in "uv")}
FROM ov JOIN co USING (session_id) JOIN hs USING (session_id)""")
def _(spark, sf):
    subset = F.when(F.col("gesture_type") == "stroke_proximal", "all").otherwise(F.col("gesture_type"))
    x = _ras(spark, sf).withColumn("subset", subset)
    moved = F.transform("contour", lambda p: F.struct((p.u / 130 + 0.5).alias("u"), (p.v / 130 + 0.5).alias("v")))
    outlines = _poly(spark, sf).withColumn("subset", subset).select("session_id", "subset", moved.alias("contour"))
    return rounded(R.compare_maps(x.drop("gesture_type"), outlines, "session_id", "subset", "tap", "stroke_distal", ROWS, COLS, 80.0))


_PAIRED = ctes("touches") + f""", q AS (SELECT *, CAST(single_touch_id % 5 AS INT) AS k FROM touches),
m AS (SELECT session_id, unnest(CASE WHEN gesture_type = 'tap' THEN ['all', 'tap'] ELSE ['all', 'stroke', gesture_type] END) AS subset, depth_max, velocity_max, iff_max, pressure_max FROM q),
b AS (SELECT session_id, subset, sum(depth_max) AS area, avg(velocity_max) AS centroid_u, avg(pressure_max) AS centroid_v, avg(iff_max) AS w FROM m GROUP BY 1, 2)
"""


@query("paired_gesture_deltas", _PAIRED + f"""SELECT a.session_id, {r("a.area - c.area", "delta_area", 4)}, {r("a.area / c.area", "area_ratio")}, {r("(a.area - c.area) / r.area * 100", "delta_area_pct", 4)},
 {r("(a.w * 40 - c.w * 40 + 90) - floor((a.w * 40 - c.w * 40 + 90) / 180) * 180 - 90", "delta_orientation_deg", 4)}, {r("sqrt((a.centroid_u - c.centroid_u) ** 2 + (a.centroid_v - c.centroid_v) ** 2)", "centroid_distance")}, {r("a.centroid_u - r.centroid_u", "offset_u_a")}
FROM b a JOIN b c USING (session_id) JOIN b r USING (session_id) WHERE a.subset = 'tap' AND c.subset = 'stroke' AND r.subset = 'all'""")
def _(spark, sf):
    t = S.subset_exploded(view(spark, sf, "touches"))
    b = t.groupBy("session_id", "subset").agg(F.sum("depth_max").alias("area"), F.avg("velocity_max").alias("centroid_u"), F.avg("pressure_max").alias("centroid_v"), F.avg("iff_max").alias("w"))
    b = b.withColumns({**{c: F.col("w") for c in R.PAIR_COLUMNS if c != "area"}, "pca_orientation_deg": F.col("w") * 40, "peak_u": F.col("w"), "peak_v": F.col("w")})
    out = R.tap_stroke(b)
    return rounded(out.select("session_id", "delta_area", "area_ratio", "delta_area_pct", "delta_orientation_deg", "centroid_distance", "offset_u_a"), 4, area_ratio=6, centroid_distance=6, offset_u_a=6)


@query("centroid_shifts", _PAIRED + f""", s AS (SELECT session_id, {", ".join(f"max({c}) FILTER (subset = '{g}') AS {c}_{i}" for i, g in enumerate(("tap", "stroke", "stroke_proximal", "stroke_distal")) for c in ("centroid_u", "centroid_v", "w"))} FROM b GROUP BY 1)
SELECT b.session_id, subset, {r("sqrt((centroid_u_0 - centroid_u_1) ** 2 + (centroid_v_0 - centroid_v_1) ** 2 + (w_0 - w_1) ** 2)", "centroid_shift_tap_vs_stroke")}, {r("sqrt((centroid_u_2 - centroid_u_3) ** 2 + (centroid_v_2 - centroid_v_3) ** 2 + (w_2 - w_3) ** 2)", "centroid_shift_proximal_vs_distal")}
FROM b JOIN s USING (session_id)""")
def _(spark, sf):
    t = S.subset_exploded(view(spark, sf, "touches"))
    b = t.groupBy("session_id", "subset").agg(F.avg("velocity_max").alias("centroid_u"), F.avg("pressure_max").alias("centroid_v"), F.avg("iff_max").alias("w"))
    out = R.centroid_shifts(b, "session_id", "subset", ["centroid_u", "centroid_v", "w"])
    return rounded(out.select("session_id", "subset", "centroid_shift_tap_vs_stroke", "centroid_shift_proximal_vs_distal"))


def _uv(spark, sf):
    return view(spark, sf, "vertices").select("vertex_id", F.col("x").alias("u"), F.col("y").alias("v"))


@query("response_fields")
def _(spark, sf):
    rows = _rows(spark, sf)
    hits = S.touches_together(_hits(spark, sf), rows=rows)
    rf = S.touch_rf(hits, "iff", [*KEYS, "gesture_type"], rows)
    out = fields.response_fields(rf, hits, _uv(spark, sf), 0.2)
    return rounded(out["boundary"].drop("contour"), 4)


@query("spatial_tuning")
def _(spark, sf):
    rows = _rows(spark, sf)
    hits = S.touches_together(_hits(spark, sf), rows=rows)
    rf = S.touch_rf(hits, "iff", rows=rows)
    feat = hits.groupBy(*KEYS).agg(F.max("iff").alias("iff_max"), F.min("gesture_type").alias("gesture_type"))
    return rounded(fields.spatial_tuning(rf, feat, _uv(spark, sf), "iff_max", [(0.0, 40.0), (40.0, 70.0), (70.0, 110.0)], 0.2), 4)
