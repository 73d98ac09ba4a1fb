"""Queries on contacts and surfaces: distance joins, response maps, grids, map metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from haptrace.functions import columns as C
from haptrace.operators import grid as G
from haptrace.operators import metrics as M
from haptrace.operators import reports as R
from haptrace.operators import selection as E
from haptrace.operators import surface as S
from haptrace.plans.inputs import ctes, view
from haptrace.plans.registry import query, r, rounded
from haptrace.schema import KEYS

K = ", ".join(KEYS)
CUT = 5.0
# Nearest vertex of each distinct contact point by brute force.
NEAR = ctes("contacts", "vertices") + f""",
pts AS (SELECT DISTINCT x, y, z FROM contacts),
dist AS (SELECT p.x, p.y, p.z, vertex_id, (p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y) + (p.z - v.z) * (p.z - v.z) AS d2 FROM pts p CROSS JOIN vertices v),
near AS (SELECT x, y, z, arg_min(vertex_id, struct_pack(d := d2, i := vertex_id)) AS vertex_id, sqrt(min(d2)) AS distance FROM dist GROUP BY 1, 2, 3),
hits AS (SELECT c.*, vertex_id, distance FROM contacts c JOIN near USING (x, y, z) WHERE distance <= {CUT}),
rf AS (SELECT {K}, gesture_type, vertex_id, avg(iff) AS rf_mean, max(iff) AS rf_max FROM hits GROUP BY {K}, gesture_type, vertex_id),
"""
SUB = "unnest(CASE WHEN gesture_type = 'tap' THEN ['all', 'tap'] ELSE ['all', 'stroke', gesture_type] END) AS subset"


def _hits(spark, sf):
    return S.contacts_on_surface(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], CUT)


def _rows(spark, sf):
    """Contact rows, which are never fewer than the hits; counted from the files alone."""
    return view(spark, sf, "contacts").count()


def _rf(spark, sf, keys=(*KEYS, "gesture_type")):
    return S.touch_rf(_hits(spark, sf), "iff", list(keys), _rows(spark, sf))


@query("nearest_vertex", NEAR + f"q AS (SELECT * FROM near) SELECT x, y, z, vertex_id, {r('distance', 'distance')} FROM q WHERE distance <= {CUT}")
def _(spark, sf):
    return rounded(S.nearest(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], CUT).select("x", "y", "z", "vertex_id", "distance"))


@query("nearest_vertex_without_cutoff", NEAR + f"q AS (SELECT * FROM near) SELECT x, y, z, vertex_id, {r('distance', 'distance')} FROM q")
def _(spark, sf):
    return rounded(S.nearest(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], None).select("x", "y", "z", "vertex_id", "distance"))


@query("vertex_set_mapping", ctes("vertices") + f""", n AS (SELECT DISTINCT round_even(x / 2, 0) * 2 AS x, round_even(y / 2, 0) * 2 AS y, round_even(z / 2, 0) * 2 AS z FROM vertices),
d AS (SELECT n.*, vertex_id, (n.x - v.x) * (n.x - v.x) + (n.y - v.y) * (n.y - v.y) + (n.z - v.z) * (n.z - v.z) AS d2 FROM n, vertices v)
SELECT x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z, arg_min(vertex_id, struct_pack(d := d2, i := vertex_id)) AS vertex_id, {r("sqrt(min(d2))", "distance")} FROM d GROUP BY 1, 2, 3""")
def _(spark, sf):
    v = view(spark, sf, "vertices")
    new = S.unique_points(v, [], 2.0).select(*[(F.col(a) + 0.0).alias(a) for a in "xyz"])
    out = S.map_vertices(new, v, [])
    return out.select("x", "y", "z", "vertex_id", (F.round(F.col("distance") + 3.37e-8, 6) + 0.0).alias("distance"))


@query("radius_max", ctes("contacts", "vertices") + """
SELECT v.vertex_id, max(c.iff) AS iff FROM vertices v LEFT JOIN (SELECT x, y, z, max(iff) AS iff FROM contacts GROUP BY 1, 2, 3) c
ON (c.x - v.x) * (c.x - v.x) + (c.y - v.y) * (c.y - v.y) + (c.z - v.z) * (c.z - v.z) <= 25 GROUP BY 1""")
def _(spark, sf):
    return S.radius_max(view(spark, sf, "vertices"), view(spark, sf, "contacts"), "iff", 5.0, [])


@query("contact_strings_parsed_once", ctes("raw") + r""",
b AS (SELECT DISTINCT contact_points, unnest(regexp_extract_all(contact_points, '\[([^\[\]]+)\]', 1)) AS s FROM raw),
t AS (SELECT contact_points, string_split_regex(trim(s), '\s+') AS p FROM b),
k AS (SELECT contact_points, TRY_CAST(p[1] AS DOUBLE) AS x, TRY_CAST(p[2] AS DOUBLE) AS y, TRY_CAST(p[3] AS DOUBLE) AS z FROM t WHERE len(p) = 3)
SELECT session_id, x, y, z, count(*) AS n FROM raw JOIN k USING (contact_points) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return S.contact_rows(view(spark, sf, "raw")).groupBy("session_id", "x", "y", "z").agg(F.count("*").alias("n"))


@query("touch_response_maps", NEAR + f"q AS (SELECT * FROM rf) SELECT {K}, gesture_type, vertex_id, {r('rf_mean', 'rf_mean')}, {r('rf_max', 'rf_max')} FROM q")
def _(spark, sf):
    return rounded(_rf(spark, sf))


@query("population_heatmap", NEAR + f"""s AS (SELECT *, {SUB} FROM rf), h AS (SELECT *, {SUB} FROM hits),
n AS (SELECT session_id, subset, count(DISTINCT ({K})) AS n_touches FROM s GROUP BY 1, 2),
u AS (SELECT session_id, subset, vertex_id, count(DISTINCT ({K})) AS n_unique FROM h GROUP BY 1, 2, 3),
a AS (SELECT session_id, subset, vertex_id, avg(rf_mean) AS value FROM s GROUP BY 1, 2, 3)
SELECT session_id, subset, vertex_id, {r("value", "value")}, n_unique, n_touches, greatest(1, CAST(round_even(0.002 * n_touches, 0) AS BIGINT)) AS threshold,
  {r("CASE WHEN n_unique < greatest(1, CAST(round_even(0.002 * n_touches, 0) AS BIGINT)) THEN -1.0 ELSE value END", "marked")}
FROM a JOIN u USING (session_id, subset, vertex_id) JOIN n USING (session_id, subset)""")
def _(spark, sf):
    return rounded(S.population_heatmap(_hits(spark, sf), "iff", 0.2, rows=_rows(spark, sf)))


@query("vertex_modes", NEAR + f"""q AS (SELECT * FROM hits) SELECT session_id, vertex_id, {r("avg(iff)", "mean_iff")}, {r("sum(iff)", "cumulative_iff", 4)}, {r("avg(spike)", "spike_density")} FROM q GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(S.vertex_modes(_hits(spark, sf), ["session_id"]), 6, cumulative_iff=4)


@query("vertex_spikes", NEAR + f"""q AS (SELECT * FROM hits) SELECT session_id, vertex_id, count(*) AS spike_count, count(DISTINCT ({K})) AS unique_touch_spike_count FROM q WHERE spike = 1 GROUP BY 1, 2""")
def _(spark, sf):
    return S.point_spikes(_hits(spark, sf), ["session_id"], ["vertex_id"])


@query("pooled_point_spikes", ctes("contacts") + f"SELECT x, y, z, count(*) AS spike_count, count(DISTINCT ({K})) AS unique_touch_spike_count FROM contacts WHERE spike = 1 GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.point_spikes(view(spark, sf, "contacts"), [], ["x", "y", "z"]).orderBy(F.desc("spike_count"))


@query("point_selectivity", ctes("contacts") + f"SELECT x, y, z, CAST(sum(spike) AS BIGINT) AS spike_count, count(*) AS total_count, {r('avg(spike)', 'selectivity')} FROM contacts GROUP BY 1, 2, 3 HAVING avg(spike) >= 0.5")
def _(spark, sf):
    return rounded(S.selectivity(view(spark, sf, "contacts"), [], ["x", "y", "z"], 0.5))


@query("spike_ratio", ctes("contacts") + f""", n AS (SELECT session_id, count(DISTINCT ({K})) AS n_touches FROM contacts GROUP BY 1),
s AS (SELECT session_id, x, y, z, count(*) AS spike_count, count(DISTINCT ({K})) AS unique_touch_spike_count FROM contacts WHERE spike = 1 GROUP BY 1, 2, 3, 4)
SELECT s.*, n_touches, {r("unique_touch_spike_count / n_touches", "spike_ratio", 9)} FROM s JOIN n USING (session_id)""")
def _(spark, sf):
    return rounded(S.spike_ratio(view(spark, sf, "contacts"), ["session_id"], ["x", "y", "z"]), 9)


@query("unique_millimetre_points", ctes("contacts") + "SELECT DISTINCT session_id, round_even(x / 4, 0) * 4 + 0.0 AS x, round_even(y / 4, 0) * 4 + 0.0 AS y, round_even(z / 4, 0) * 4 + 0.0 AS z FROM contacts")
def _(spark, sf):
    return S.unique_points(view(spark, sf, "contacts"), ["session_id"], 4.0).select("session_id", *[(F.col(a) + 0.0).alias(a) for a in "xyz"])


@query("spike_cells_outside_touches", ctes("contacts") + "SELECT DISTINCT x, y, z FROM contacts WHERE spike = 1 EXCEPT SELECT x, y, z FROM contacts WHERE gesture_type = 'tap'")
def _(spark, sf):
    c = view(spark, sf, "contacts")
    return S.not_contained(c.filter("spike = 1"), c.filter("gesture_type = 'tap'"), ["x", "y", "z"])


@query("touch_key_semi_join", ctes("contacts", "touches") + f"""SELECT session_id, count(*) AS n, {r("avg(iff)", "iff_mean")} FROM contacts c
WHERE EXISTS (SELECT 1 FROM touches t WHERE t.single_touch_id = c.single_touch_id AND depth_max > 48) GROUP BY 1""")
def _(spark, sf):
    t = view(spark, sf, "touches").filter("depth_max > 48").select("single_touch_id")
    c = view(spark, sf, "contacts").join(t, "single_touch_id", "left_semi")
    return rounded(c.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("iff").alias("iff_mean")))


@query("touches_with_response_maps", NEAR + f"t AS (SELECT DISTINCT {K} FROM rf WHERE gesture_type = 'tap') SELECT session_id, count(*) AS n FROM rf JOIN t USING ({K}) GROUP BY 1")
def _(spark, sf):
    rf = _rf(spark, sf)
    touches = rf.filter("gesture_type = 'tap'").select(*KEYS).distinct()
    return S.require_rf(touches, rf).groupBy("session_id").agg(F.count("*").alias("n"))


@query("neuron_types", ctes("touches") + """SELECT t.session_id, n_name AS unit, r_name AS neuron_type, count(*) AS n FROM touches t JOIN nation ON n_nationkey = CAST(substr(t.session_id, 2) AS INT)
JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def _(spark, sf):
    nation, region = view(spark, sf, "nation"), view(spark, sf, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias(" Unit "), F.col("r_name").alias("Neuron Type"))
    t = view(spark, sf, "touches").withColumn("n_nationkey", F.substring("session_id", 2, 9).cast("int"))
    t = t.groupBy("session_id", "n_nationkey").agg(F.count("*").alias("n")).join(nation, "n_nationkey").select("session_id", F.col("n_name").alias("unit"), "n")
    return S.with_neuron_type(t, dim)


AXES = {"depth_max": (5.0, 50.0, 5.0, 12.0), "velocity_max": (10.0, 100.0, 15.0, 30.0)}
GRID = NEAR + """d AS (SELECT CAST(i AS INT) AS i_depth_max, 5 + i * 5.0 AS cd FROM range(9) t(i)), e AS (SELECT CAST(j AS INT) AS i_velocity_max, 10 + j * 15.0 AS cv FROM range(6) t(j)),
feat AS (SELECT {K}, max(x) + 25 AS depth_max, max(iff) AS velocity_max FROM contacts GROUP BY {K}),
mem AS (SELECT {K}, i_depth_max, i_velocity_max FROM feat, d, e WHERE depth_max BETWEEN cd - 6 AND cd + 6 AND velocity_max BETWEEN cv - 15 AND cv + 15),
""".replace("{K}", K)


def _peaks(spark, sf):
    c = S.touches_together(view(spark, sf, "contacts"), rows=_rows(spark, sf))
    return c.groupBy(*KEYS).agg((F.max("x") + 25).alias("depth_max"), F.max("iff").alias("velocity_max"))


def _members(spark, sf):
    return S.cell_members(_peaks(spark, sf), AXES)


CELL = ["session_id", "i_depth_max", "i_velocity_max"]


@query("feature_grid", """SELECT CAST(i AS INT) AS i_depth_max, 5 + i * 5.0 AS center_depth_max, CAST(j AS INT) AS i_velocity_max, 10 + j * 15.0 AS center_velocity_max, n
FROM range(9) a(i), range(6) b(j), (SELECT count(*) AS n FROM lineitem) WHERE 5 + i * 5.0 <= (SELECT max(l_quantity) FROM lineitem)""")
def _(spark, sf):
    top = view(spark, sf, "lineitem").agg(F.max("l_quantity").alias("top"), F.count("*").alias("n"))
    grid = S.feature_grid(spark, {k: v[:3] for k, v in AXES.items()})
    return grid.join(F.broadcast(top)).filter("center_depth_max <= top").drop("top").select(  # top is one row
        "i_depth_max", F.col("center_depth_max").cast("double"), "i_velocity_max", F.col("center_velocity_max").cast("double"), "n")


@query("grid_membership", GRID + "q AS (SELECT * FROM mem) SELECT session_id, i_depth_max, i_velocity_max, count(*) AS n FROM q GROUP BY 1, 2, 3")
def _(spark, sf):
    return _members(spark, sf).groupBy(*CELL).agg(F.count("*").alias("n"))


_CELLMAP = GRID + f"""n AS (SELECT session_id, i_depth_max, i_velocity_max, count(*) AS n_touches FROM mem GROUP BY 1, 2, 3),
r1 AS (SELECT {K}, vertex_id, avg(iff) AS rf_mean FROM hits GROUP BY {K}, vertex_id),
maps AS (SELECT m.session_id, i_depth_max, i_velocity_max, vertex_id, avg(rf_mean) AS value, count(DISTINCT ({", ".join("m." + k for k in KEYS)})) AS n_unique FROM mem m JOIN r1 USING ({K}) GROUP BY 1, 2, 3, 4),
cellmap AS (SELECT maps.*, n_touches FROM maps JOIN n USING (session_id, i_depth_max, i_velocity_max) WHERE n_unique >= greatest(1, CAST(round_even(0.003 * n_touches, 0) AS BIGINT)))
"""


def _cellmap(spark, sf):
    return G.grid_maps(_peaks(spark, sf), _rf(spark, sf, KEYS), AXES, 0.003)


@query("grid_response_maps", _CELLMAP + f"SELECT session_id, i_depth_max, i_velocity_max, vertex_id, {r('value', 'value')}, n_unique, n_touches FROM cellmap")
def _(spark, sf):
    return rounded(_cellmap(spark, sf))


_C = "session_id, i_depth_max, i_velocity_max"


@query("cell_intensity", _CELLMAP + f"""SELECT {_C}, {r("max(value)", "max_iff")}, {r("avg(value)", "mean_iff")}, {r("stddev_pop(value)", "std_iff")}, {r("max(value) - min(value)", "iff_range")}, count(*) AS n_vertices, {r("median(value)", "median_iff")},
{r("CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN (avg(value) - min(value)) / (max(value) - min(value)) END", "hypsometric_integral")}, {r("CASE WHEN count(*) >= 2 THEN stddev_pop(value) / avg(value) END", "coefficient_of_variation")}
FROM cellmap GROUP BY {_C}""")
def _(spark, sf):
    return rounded(M.intensity(_cellmap(spark, sf), CELL))


@query("cell_distribution", _CELLMAP + f""", k AS (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY value) AS rk, avg(value) OVER (PARTITION BY {_C}) AS mu, sum(value) OVER (PARTITION BY {_C}) AS tot FROM cellmap)
SELECT {_C}, {r("CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) END", "iff_skewness")},
{r("CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 END", "iff_kurtosis")},
{r("CASE WHEN count(*) = 1 THEN 0 ELSE 2 * sum(rk * value) / (count(*) * min(tot)) - (count(*) + 1) / count(*) END", "gini_coefficient")}, {r("CASE WHEN count(*) = 1 THEN 0 ELSE -sum(value / tot * log2(value / tot)) END", "shannon_entropy")}
FROM k GROUP BY {_C}""")
def _(spark, sf):
    return rounded(M.distribution(_cellmap(spark, sf), CELL))


_PLACED = _CELLMAP + ", placed AS (SELECT cellmap.*, x, y, z, x AS u, y AS v FROM cellmap JOIN vertices USING (vertex_id))"


def _placed(spark, sf):
    v = view(spark, sf, "vertices").select("vertex_id", "x", "y", "z", F.col("x").alias("u"), F.col("y").alias("v"))
    return _cellmap(spark, sf).join(v, "vertex_id")


@query("cell_centroids", _PLACED + f""" SELECT {_C}, {", ".join(r(f"sum(value * {a}) / sum(value)", f"weighted_centroid_{a}") for a in "xyz")} FROM placed GROUP BY {_C}""")
def _(spark, sf):
    return rounded(M.weighted_centroid(_placed(spark, sf), CELL, ["x", "y", "z"], "value"))


_COV = "cov AS (SELECT {by}, count(*) AS n, avg(u) AS mu, avg(v) AS mv, covar_pop(u, u) AS a, covar_pop(u, v) AS b, covar_pop(v, v) AS d FROM {src} GROUP BY {by})"
_E1, _E2 = "((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b))", "greatest(0, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b))"


@query("heat_alignment", NEAR + f"""h AS (SELECT session_id, vertex_id, avg(rf_mean) AS value FROM rf GROUP BY 1, 2), p AS (SELECT h.*, x AS u, y AS v FROM h JOIN vertices USING (vertex_id) WHERE value > 0),
{_COV.format(by="session_id", src="p")}, t AS (SELECT *, atan2(2 * b, a - d) / 2 AS w FROM cov)
SELECT session_id, {r("mu", "center_u")}, {r("mv", "center_v")}, {r("degrees(w)", "angle_deg", 4)}, {r("cos(w)", "major_u")}, {r("sin(w)", "major_v")}, {r("-sin(w)", "minor_u")}, {r("cos(w)", "minor_v")} FROM t""")
def _(spark, sf):
    v = view(spark, sf, "vertices").select("vertex_id", F.col("x").alias("u"), F.col("y").alias("v"))
    h = S.heatmap(_rf(spark, sf), ["session_id"]).join(v, "vertex_id")
    return rounded(M.pca_alignment(h, ["session_id"]), 6, angle_deg=4)


@query("contact_ellipse", ctes("contacts") + f""", q AS (SELECT session_id, gesture_type, x AS u, y AS v FROM contacts), {_COV.format(by="session_id, gesture_type", src="q")}
SELECT session_id, gesture_type, {r("mu", "center_u", 4)}, {r("mv", "center_v", 4)}, n AS n_points, {r(f"2 * sqrt({_E1})", "ellipse_major", 4)}, {r(f"2 * sqrt({_E2})", "ellipse_minor", 4)},
{r("degrees(atan2(2 * b, a - d) / 2)", "orientation_deg", 3)}, {r(f"sqrt({_E1}) / sqrt({_E2})", "aspect_ratio", 4)}, {r(f"sqrt(1 - {_E2} / {_E1})", "eccentricity", 4)} FROM cov""")
def _(spark, sf):
    c = view(spark, sf, "contacts").withColumns({"u": F.col("x"), "v": F.col("y")})
    return rounded(M.ellipse(c, ["session_id", "gesture_type"]), 4, orientation_deg=3)


@query("hotspot_vertices", NEAR + """h AS (SELECT session_id, vertex_id, avg(rf_mean) AS value FROM rf GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, vertex_id) AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM h)
SELECT session_id, vertex_id FROM k WHERE rk <= ceil(0.2 * n)""")
def _(spark, sf):
    h = S.heatmap(_rf(spark, sf), ["session_id"])
    return M.top_share(h, ["session_id"], "value", "vertex_id").select("session_id", "vertex_id")


@query("half_peak_vertices", NEAR + """h AS (SELECT session_id, vertex_id, avg(rf_mean) AS value FROM rf GROUP BY 1, 2)
SELECT session_id, count(*) AS n FROM (SELECT *, max(value) OVER (PARTITION BY session_id) AS peak FROM h) WHERE value >= 0.5 * peak GROUP BY 1""")
def _(spark, sf):
    h = S.heatmap(_rf(spark, sf), ["session_id"])
    return M.above_peak_share(h, ["session_id"], "value").groupBy("session_id").agg(F.count("*").alias("n"))


def hull_sql(name: str, points: str, by: list[str]) -> str:
    """Table ``name`` (by, area, perimeter, corners): edges of the hull are the pairs with no point to their right nor beyond them on their line."""
    on = " AND ".join(f"p.{k} = a.{k}" for k in by)
    keys = ", ".join(by)
    cross = "((b.u - a.u) * (p.v - a.v) - (b.v - a.v) * (p.u - a.u))"
    dot = "((b.u - a.u) * (p.u - a.u) + (b.v - a.v) * (p.v - a.v))"
    return f"""{name}_p AS (SELECT DISTINCT {keys}, u, v FROM {points}),
{name}_e AS (SELECT a.*, b.u AS u2, b.v AS v2 FROM {name}_p a JOIN {name}_p b USING ({keys}) WHERE (a.u <> b.u OR a.v <> b.v)
  AND NOT EXISTS (SELECT 1 FROM {name}_p p WHERE {on} AND ({cross} < 0 OR ({cross} = 0 AND ({dot} < 0 OR {dot} > (b.u - a.u) * (b.u - a.u) + (b.v - a.v) * (b.v - a.v)))))),
{name} AS (SELECT {keys}, coalesce(abs(sum(e.u * e.v2 - e.u2 * e.v)) / 2, 0) AS area, CASE WHEN abs(sum(e.u * e.v2 - e.u2 * e.v)) > 0 THEN sum(sqrt((e.u - e.u2) ** 2 + (e.v - e.v2) ** 2)) END AS perimeter,
  greatest(count(e.u), 1) AS corners FROM (SELECT DISTINCT {keys} FROM {name}_p) LEFT JOIN {name}_e e USING ({keys}) GROUP BY {keys})"""


@query("contact_hulls", ctes("contacts") + ", ends AS (SELECT session_id, gesture_type, x AS u, unnest([min(y), max(y)]) AS v FROM contacts GROUP BY 1, 2, 3), "
       + hull_sql("h", "ends", ["session_id", "gesture_type"]) + f" SELECT session_id, gesture_type, {r('area', 'hull_area')}, {r('perimeter', 'hull_perimeter')}, corners AS hull_corners FROM h")
def _(spark, sf):
    return rounded(M.convex_hulls(view(spark, sf, "contacts"), ["session_id", "gesture_type"], "x", "y"))


def metrics_sql(points: str, by: str, name: str) -> str:
    """Table ``name`` with all metrics but the fitted bump of the maps in ``points``."""
    keys = [k.strip() for k in by.split(",")]
    hulls = ", ".join(hull_sql(f"{name}_{h}", f"{name}_{src}", keys) for h, src in (("ch", "w"), ("hh", "half"), ("sh", "spot")))
    return f"""{name}_w AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value DESC, vertex_id) AS place, row_number() OVER (PARTITION BY {by} ORDER BY value) AS rk, count(*) OVER q AS n, max(value) OVER q AS peak, avg(value) OVER q AS mu, sum(value) OVER q AS tot,
  sum(value * u) OVER q / sum(value) OVER q AS cu, sum(value * v) OVER q / sum(value) OVER q AS cv FROM {points} WINDOW q AS (PARTITION BY {by})),
{name}_half AS (SELECT * FROM {name}_w WHERE value >= 0.5 * peak), {name}_spot AS (SELECT * FROM {name}_w WHERE place <= greatest(1, ceil(n * 0.2))), {hulls},
{name}_a AS (SELECT {by}, max(value) AS max_iff, avg(value) AS mean_iff, stddev_pop(value) AS std_iff, max(value) - min(value) AS iff_range, count(*) AS n_vertices, median(value) AS median_iff,
  CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN (avg(value) - min(value)) / (max(value) - min(value)) END AS hypsometric_integral, CASE WHEN count(*) >= 2 THEN stddev_pop(value) / avg(value) END AS coefficient_of_variation,
  CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) END AS iff_skewness, CASE WHEN count(*) >= 2 AND max(value) > min(value) THEN avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 END AS iff_kurtosis,
  CASE WHEN count(*) = 1 THEN 0 ELSE 2 * sum(rk * value) / (count(*) * min(tot)) - (count(*) + 1) / count(*) END AS gini_coefficient, CASE WHEN count(*) = 1 THEN 0 ELSE -sum(value / tot * log2(value / tot)) END AS shannon_entropy,
  {", ".join(f"sum(value * {c}) / sum(value) AS weighted_centroid_{c}" for c in ("x", "y", "z", "u", "v"))}, sum(value) AS total_iff, 1 - avg(value) / max(value) AS sparsity_index, count(*) FILTER (value >= 0.5 * peak) AS half_peak_count,
  sum(value * (u - cu) * (u - cu)) / sum(value) AS ea, sum(value * (u - cu) * (v - cv)) / sum(value) AS eb, sum(value * (v - cv) * (v - cv)) / sum(value) AS ed FROM {name}_w GROUP BY {by}),
{name}_l AS (SELECT *, (ea + ed) / 2 + sqrt((ea - ed) * (ea - ed) / 4 + eb * eb) AS l1, greatest(0, (ea + ed) / 2 - sqrt((ea - ed) * (ea - ed) / 4 + eb * eb)) AS l2 FROM {name}_a),
{name} AS (SELECT l.* EXCLUDE (ea, eb, ed, l1, l2), CASE WHEN n_vertices >= 2 THEN 2 * sqrt(l1) END AS ellipse_major, CASE WHEN n_vertices >= 2 THEN 2 * sqrt(l2) END AS ellipse_minor,
  CASE WHEN n_vertices >= 2 THEN degrees(atan2(2 * eb, ea - ed) / 2) END AS orientation_deg, c.area AS convex_hull_area, c.perimeter AS convex_hull_perimeter, c.corners AS convex_hull_corners, h.area AS half_peak_area, s.area AS hotspot_area,
  CASE WHEN c.area > 0 THEN s.area / c.area END AS hotspot_fraction, sqrt(4 * c.area / pi()) AS equivalent_diameter, CASE WHEN c.area > 0 THEN 4 * pi() * c.area / (c.perimeter * c.perimeter) END AS circularity
  FROM {name}_l l JOIN {name}_ch c USING ({by}) JOIN {name}_hh h USING ({by}) JOIN {name}_sh s USING ({by}))"""


_METRICS = ["max_iff", "mean_iff", "std_iff", "iff_range", "median_iff", "hypsometric_integral", "coefficient_of_variation", "iff_skewness", "iff_kurtosis", "gini_coefficient", "shannon_entropy",
            *[f"weighted_centroid_{c}" for c in ("x", "y", "z", "u", "v")], "total_iff", "sparsity_index", "ellipse_major", "ellipse_minor", "orientation_deg", "convex_hull_area",
            "convex_hull_perimeter", "half_peak_area", "hotspot_area", "hotspot_fraction", "equivalent_diameter", "circularity"]


@query("cell_metrics", _PLACED + ", " + metrics_sql("placed", _C, "mt") + f", cells AS (SELECT DISTINCT {_C} FROM mem) SELECT {_C}, coalesce(n_vertices, 0) AS n_vertices, coalesce(half_peak_count, 0) AS half_peak_count, convex_hull_corners, "
       + ", ".join(r("coalesce(total_iff, 0)" if c == "total_iff" else c, c, 3 if c == "orientation_deg" else 4) for c in _METRICS) + f" FROM cells LEFT JOIN mt USING ({_C})")
def _(spark, sf):
    out = M.map_metrics(_placed(spark, sf), CELL, cells=_members(spark, sf), gaussian=False)
    return rounded(out.select(*CELL, "n_vertices", "half_peak_count", "convex_hull_corners", *_METRICS), 4, orientation_deg=3)


@query("session_bump_fits", NEAR + """q AS (SELECT session_id, vertex_id FROM rf GROUP BY 1, 2) SELECT session_id, count(*) AS n_vertices, true AS gaussian_converged, 1.0::DOUBLE AS gaussian_r_squared, 5.0::DOUBLE AS gaussian_amplitude,
 2.0::DOUBLE AS gaussian_x0, -1.0::DOUBLE AS gaussian_y0, 14.0::DOUBLE AS gaussian_sigma_major, 9.0::DOUBLE AS gaussian_sigma_minor FROM q GROUP BY 1""")
def _(spark, sf):
    """The bump of the metric bundle, on maps whose values are an exact bump over the vertices reached."""
    u, v = F.col("u") - 2, F.col("v") + 1
    where = view(spark, sf, "vertices").select("vertex_id", "x", "y", "z", F.col("x").alias("u"), F.col("y").alias("v"))
    maps = S.heatmap(_rf(spark, sf), ["session_id"]).drop("value").join(where, "vertex_id").withColumn("value", F.exp(-(u * u / 196 + v * v / 81) / 2) * 5 + 1)
    out = M.map_metrics(maps, ["session_id"])
    return rounded(out.select("session_id", "n_vertices", *[f"gaussian_{c}" for c in M.GAUSSIAN if c != "theta_deg"]), 2)


@query("cell_baseline_overlap", _CELLMAP + f""", base AS (SELECT session_id, vertex_id FROM rf GROUP BY 1, 2), nb AS (SELECT session_id, count(*) AS nb FROM base GROUP BY 1),
b AS (SELECT c.session_id, i_depth_max, i_velocity_max, count(*) AS na, count(base.vertex_id) AS bo FROM cellmap c LEFT JOIN base ON base.session_id = c.session_id AND base.vertex_id = c.vertex_id GROUP BY 1, 2, 3)
SELECT {_C}, {r("bo / (na + nb - bo)", "jaccard")}, {r("bo / nb", "containment")} FROM b JOIN nb USING (session_id)""")
def _(spark, sf):
    return rounded(M.vertex_overlap(_cellmap(spark, sf), _rf(spark, sf), CELL, ["session_id"]))


@query("cell_baseline_deviation", _PLACED + ", " + metrics_sql("placed", _C, "mt") + """, hb AS (SELECT session_id, vertex_id, avg(rf_mean) AS value FROM rf GROUP BY 1, 2), pb AS (SELECT hb.*, x, y, z, x AS u, y AS v FROM hb JOIN vertices USING (vertex_id)), """
       + metrics_sql("pb", "session_id", "bs") + f""", dev AS (SELECT m.*, {", ".join(f"b.{c} AS b_{c}" for c in ("convex_hull_area", "hotspot_area", "mean_iff", "max_iff", "equivalent_diameter"))},
 sqrt({" + ".join(f"(m.weighted_centroid_{a} - b.weighted_centroid_{a}) ** 2" for a in "xyz")}) AS sh FROM mt m JOIN bs b USING (session_id))
SELECT {_C}, {r("CASE WHEN b_convex_hull_area <> 0 THEN convex_hull_area / b_convex_hull_area END", "deviation_area_ratio", 5)}, {r("CASE WHEN b_hotspot_area <> 0 THEN hotspot_area / b_hotspot_area END", "deviation_hotspot_area_ratio", 5)},
 {r("sh", "deviation_centroid_shift_mm", 5)}, {r("CASE WHEN b_equivalent_diameter <> 0 THEN sh / b_equivalent_diameter END", "deviation_centroid_shift_normalized", 5)}, {r("mean_iff / b_mean_iff", "deviation_mean_iff_ratio", 5)}, {r("max_iff / b_max_iff", "deviation_peak_iff_ratio", 5)} FROM dev""")
def _(spark, sf):
    cells = M.map_metrics(_placed(spark, sf), CELL, gaussian=False)
    v = view(spark, sf, "vertices").select("vertex_id", "x", "y", "z", F.col("x").alias("u"), F.col("y").alias("v"))
    base = S.heatmap(_rf(spark, sf), ["session_id"]).join(v, "vertex_id")
    out = M.baseline_deviation(cells, M.map_metrics(base, ["session_id"], gaussian=False), ["session_id"])
    return rounded(out.select(*CELL, *[c for c in out.columns if c.startswith("deviation_")]), 5)


@query("grid_metric_pivot", _CELLMAP + f""", q AS (SELECT i_velocity_max, i_depth_max, max(nullif(n_touches, 0)) AS m FROM cellmap GROUP BY 1, 2)
SELECT i_velocity_max, {", ".join(f'max(m) FILTER (i_depth_max = {i}) AS "{i}"' for i in range(9))} FROM q GROUP BY 1""")
def _(spark, sf):
    q = _cellmap(spark, sf).groupBy("i_velocity_max", "i_depth_max").agg(F.max(F.nullif("n_touches", F.lit(0))).alias("m"))
    return q.groupBy("i_velocity_max").pivot("i_depth_max", list(range(9))).agg(F.max("m"))


_R30 = [[0.8660254037844387, -0.5, 0.0], [0.5, 0.8660254037844387, 0.0], [0.0, 0.0, 1.0]]


@query("tangent_projection", ctes("vertices") + f"""SELECT vertex_id, {r("(x - 1) * 0.8660254037844387 - 0.5 * (y - 2)", "u")}, {r("(x - 1) * 0.5 + 0.8660254037844387 * (y - 2)", "v")} FROM vertices""")
def _(spark, sf):
    rot = [[F.lit(x) for x in row] for row in _R30]
    out = S.project(view(spark, sf, "vertices"), "tangent_plane", {"center": [1.0, 2.0, 0.0], "rotation": rot})
    return rounded(out.select("vertex_id", "u", "v"))


@query("cylinder_projection", ctes("vertices") + f"""SELECT vertex_id, {r("40 * atan2(y, x)", "u")}, {r("z", "v")} FROM vertices""")
def _(spark, sf):
    out = S.project(view(spark, sf, "vertices"), "cylindrical_unwrap", {"axis": [0.0, 0.0, 1.0], "center": [0.0, 0.0, 0.0], "radius": 40.0})
    return rounded(out.select("vertex_id", "u", "v"))


# The axis is the main axis of the 500 vertices nearest to the origin: the largest eigenvalue by the cosine form, the axis as a cross product.
_CYL = ctes("vertices") + """, n AS (SELECT * FROM vertices ORDER BY x * x + y * y + z * z, vertex_id LIMIT 500),
m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz, var_pop(x) a, var_pop(y) b, var_pop(z) c, covar_pop(x, y) d, covar_pop(x, z) e, covar_pop(y, z) f FROM n),
q AS (SELECT *, (a + b + c) / 3 AS t, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
w AS (SELECT *, t + 2 * p * cos(acos(((a - t) * ((b - t) * (c - t) - f * f) - d * (d * (c - t) - f * e) + e * (d * f - (b - t) * e)) / (2 * p * p * p)) / 3) AS l FROM q),
u AS (SELECT *, d * f - e * (b - l) AS u0, e * d - (a - l) * f AS u1, (a - l) * (b - l) - d * d AS u2 FROM w),
x AS (SELECT mx, my, mz, u0 / k AS u0, u1 / k AS u1, u2 / k AS u2 FROM (SELECT *, sqrt(u0 * u0 + u1 * u1 + u2 * u2) AS k FROM u)),
r AS (SELECT avg(sqrt(pow(n.x - mx, 2) + pow(n.y - my, 2) + pow(n.z - mz, 2) - pow((n.x - mx) * u0 + (n.y - my) * u1 + (n.z - mz) * u2, 2))) AS radius FROM n, x),
z AS (SELECT *, (0 - mx) - ((0 - mx) * u0 + (0 - my) * u1 + (0 - mz) * u2) * u0 AS z0, (0 - my) - ((0 - mx) * u0 + (0 - my) * u1 + (0 - mz) * u2) * u1 AS z1,
  (0 - mz) - ((0 - mx) * u0 + (0 - my) * u1 + (0 - mz) * u2) * u2 AS z2 FROM x),
g AS (SELECT vertex_id, (vertices.x - mx) * z0 + (vertices.y - my) * z1 + (vertices.z - mz) * z2 AS c0, sqrt(z0 * z0 + z1 * z1 + z2 * z2) AS zn,
  (vertices.x - mx) * u0 + (vertices.y - my) * u1 + (vertices.z - mz) * u2 AS v, pow(vertices.x - mx, 2) + pow(vertices.y - my, 2) + pow(vertices.z - mz, 2) AS d2 FROM vertices, z)
"""


@query("fitted_cylinder_projection", _CYL + f"""SELECT vertex_id, {r("radius * acos(greatest(-1, least(1, c0 / zn / sqrt(d2 - v * v))))", "u", 3)}, {r("abs(v)", "v", 3)} FROM g, r""")
def _(spark, sf):
    """Angle 0 lies toward the origin; signs are left out, as an axis has two directions."""
    v = view(spark, sf, "vertices")
    axis, point, radius = S.cylinder_axis(v, [0.0, 0.0, 0.0])
    out = S.project(v, "cylindrical_unwrap", {"axis": axis, "center": point, "radius": radius, "toward": [0.0, 0.0, 0.0]})
    return rounded(out.select("vertex_id", F.abs("u").alias("u"), F.abs("v").alias("v")), 3)


@query("camera_cylinder_projection", ctes("vertices") + f"""SELECT vertex_id, {r("30 * atan2(x - 1, z - 2)", "u")}, {r("y + 3", "v")} FROM vertices""")
def _(spark, sf):
    camera = [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, -1.0]]
    out = S.project(view(spark, sf, "vertices"), "cylindrical_unwrap", {"rotation": camera, "center": [1.0, -3.0, 2.0], "radius": 30.0})
    return rounded(out.select("vertex_id", "u", "v"))


@query("view_rotation", ctes("vertices") + f""", c AS (SELECT vertex_id, x AS px, y AS py, 100 AS pz FROM vertices),
b AS (SELECT vertex_id, px / sqrt(px * px + py * py + 10000) AS bx, py / sqrt(px * px + py * py + 10000) AS by_, 100 / sqrt(px * px + py * py + 10000) AS bz FROM c)
SELECT vertex_id, {r("bz / sqrt(bz * bz + bx * bx)", "right_x")}, {r("-bx / sqrt(bz * bz + bx * bx)", "right_z")}, {r("bx", "back_x")}, {r("by_", "back_y")}, {r("bz", "back_z")} FROM b""")
def _(spark, sf):
    v = view(spark, sf, "vertices")
    right, up, back = C.view_rotation([F.col("x"), F.col("y"), F.lit(100.0)], [F.lit(0.0)] * 3, [F.lit(0.0), F.lit(1.0), F.lit(0.0)])
    return rounded(v.select("vertex_id", right[0].alias("right_x"), right[2].alias("right_z"), back[0].alias("back_x"), back[1].alias("back_y"), back[2].alias("back_z")))


# A mesh over the quantity x discount lattice of each session, bent along its mean price.
MESH = ctes("raster") + """,
mv AS (SELECT session_id, r * 100 + c AS vertex_id, CAST(r AS DOUBLE) AS u, CAST(c AS DOUBLE) AS v, r * 2.0 AS x, c * 3.0 AS y, sum(z) / sum(n) * 0.01 AS z FROM raster GROUP BY session_id, r, c),
mf AS (SELECT session_id, vertex_id AS i, vertex_id + 1 AS j, vertex_id + 100 AS k FROM mv WHERE vertex_id // 100 < 49 AND vertex_id % 100 < 10
  UNION ALL SELECT session_id, vertex_id + 1, vertex_id + 100, vertex_id + 101 FROM mv WHERE vertex_id // 100 < 49 AND vertex_id % 100 < 10)
"""


def _mesh(spark, sf):
    ras = view(spark, sf, "raster")
    v = ras.groupBy("session_id", "r", "c").agg((F.sum("z") / F.sum("n") * 0.01).alias("z")).select(
        "session_id", (F.col("r") * 100 + F.col("c")).alias("vertex_id"), F.col("r").cast("double").alias("u"), F.col("c").cast("double").alias("v"),
        (F.col("r") * 2.0).alias("x"), (F.col("c") * 3.0).alias("y"), "z")
    b = v.filter("vertex_id div 100 < 49 AND vertex_id % 100 < 10")
    f = b.selectExpr("session_id", "vertex_id AS i", "vertex_id + 1 AS j", "vertex_id + 100 AS k").unionByName(
        b.selectExpr("session_id", "vertex_id + 1 AS i", "vertex_id + 100 AS j", "vertex_id + 101 AS k"))
    return v, f


@query("mesh_scale", MESH + f""", e AS (SELECT DISTINCT session_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT session_id, i AS a, j AS b FROM mf UNION ALL SELECT session_id, j, k FROM mf UNION ALL SELECT session_id, i, k FROM mf))
SELECT session_id, {r("median(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) / sqrt((p.u - q.u) ** 2 + (p.v - q.v) ** 2))", "uv_to_mm")}
FROM e JOIN mv p ON p.session_id = e.session_id AND p.vertex_id = e.a JOIN mv q ON q.session_id = e.session_id AND q.vertex_id = e.b GROUP BY e.session_id""".replace("SELECT session_id, round(CAST(median", "SELECT e.session_id, round(CAST(median"))
def _(spark, sf):
    v, f = _mesh(spark, sf)
    return rounded(S.mesh_scale(f, v, ["session_id"]))


@query("surface_lookup", MESH + f""", p AS (SELECT DISTINCT session_id, l_quantity * 0.97 AS u, round(l_tax * 100) * 1.1 + 0.05 AS v FROM (SELECT *, concat('s', CAST(l_suppkey % 4 AS STRING)) AS session_id FROM lineitem)),
t AS (SELECT p.*, CAST(floor(u) AS INT) AS r0, CAST(floor(v) AS INT) AS c0, u - floor(u) AS fu, v - floor(v) AS fv FROM p),
q AS (SELECT t.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, d.x AS dx, d.y AS dy, d.z AS dz FROM t
 JOIN mv a ON a.session_id = t.session_id AND a.vertex_id = r0 * 100 + c0 JOIN mv b ON b.session_id = t.session_id AND b.vertex_id = r0 * 100 + c0 + 1
 JOIN mv c ON c.session_id = t.session_id AND c.vertex_id = r0 * 100 + c0 + 100 JOIN mv d ON d.session_id = t.session_id AND d.vertex_id = r0 * 100 + c0 + 101)
SELECT session_id, {r("u", "u")}, {r("v", "v")}, {r("CASE WHEN fu + fv <= 1 THEN ax + fu * (cx - ax) + fv * (bx - ax) ELSE dx + (1 - fu) * (bx - dx) + (1 - fv) * (cx - dx) END", "x")},
 {r("CASE WHEN fu + fv <= 1 THEN az + fu * (cz - az) + fv * (bz - az) ELSE dz + (1 - fu) * (bz - dz) + (1 - fv) * (cz - dz) END", "z")}, true AS inside FROM q
UNION ALL SELECT session_id, {r("w.u", "u")}, {r("w.v", "v")}, {r("w.b.x", "x")}, {r("w.b.z", "z")}, false FROM (
 SELECT o.session_id, o.u, o.v, min(struct_pack(d := (o.u - mv.u) * (o.u - mv.u) + (o.v - mv.v) * (o.v - mv.v), i := mv.vertex_id, x := mv.x, z := mv.z)) AS b
 FROM (SELECT session_id, u, v FROM p EXCEPT SELECT session_id, u, v FROM q) o JOIN mv USING (session_id) GROUP BY 1, 2, 3) w""")
def _(spark, sf):
    v, f = _mesh(spark, sf)
    p = view(spark, sf, "lineitem").selectExpr("concat('s', CAST(l_suppkey % 4 AS STRING)) AS session_id", "l_quantity * 0.97D AS u", "round(l_tax * 100) * 1.1D + 0.05D AS v")
    return rounded(S.uv_to_xyz(p, f, v, ["session_id"], 1.0).select("session_id", "u", "v", "x", "z", "inside"))


@query("stroke_report", ctes("raw") + f"""SELECT {K}, {r("last(contact_location_x ORDER BY frame_idx) FILTER (contact_location_x IS NOT NULL) - first(contact_location_x ORDER BY frame_idx) FILTER (contact_location_x IS NOT NULL)", "delta_x")},
 {r("max(contact_location_x) - min(contact_location_x)", "range_x")}, {r("max(contact_location_y) - min(contact_location_y)", "range_y")}, count(contact_location_x) AS n_known, count(*) AS n_frames,
 min(frame_idx) < min(frame_idx) FILTER (contact_location_x IS NOT NULL) AS gap_at_start, max(frame_idx) > max(frame_idx) FILTER (contact_location_x IS NOT NULL) AS gap_at_end
FROM raw WHERE single_touch_id <> 0 AND type_metadata = 'stroke' GROUP BY {K}""")
def _(spark, sf):
    return rounded(R.stroke_report(view(spark, sf, "raw")))


@query("contact_distance_report", NEAR + f"""j AS (SELECT session_id, distance FROM contacts JOIN near USING (x, y, z))
SELECT session_id, {", ".join(r(f"quantile_cont(distance, {p})", f"p{int(p * 100)}", 5) for p in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0))}, count(*) AS n, {r("avg(CASE WHEN distance > 6 THEN 1.0 ELSE 0.0 END) * 100", "percent_beyond", 5)} FROM j GROUP BY 1""")
def _(spark, sf):
    near = S.contacts_on_surface(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], None)
    return rounded(R.distance_report(near, ["session_id"], "distance", 6.0), 5)


@query("bounding_box_overlap", ctes("contacts", "vertices") + f""", a AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM contacts), b AS (SELECT min(x) p0, max(x) p1, min(y) q0, max(y) q1, min(z) s0, max(z) s1 FROM vertices)
SELECT {r("greatest(least(x1, p1) - greatest(x0, p0), 0) / (x1 - x0) * 100", "x_overlap")}, {r("greatest(least(y1, q1) - greatest(y0, q0), 0) / (y1 - y0) * 100", "y_overlap")}, {r("greatest(least(z1, s1) - greatest(z0, s0), 0) / (z1 - z0) * 100", "z_overlap")} FROM a, b""")
def _(spark, sf):
    return rounded(R.overlap_percent(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], ["x", "y", "z"]))


@query("worst_contact_rows", NEAR + f"""p AS (SELECT {K}, max(distance) AS d, count(*) AS n_points, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM contacts JOIN near USING (x, y, z) GROUP BY {K}),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY d DESC, block_order_id, trial_id, single_touch_id) AS rk FROM p)
SELECT {K}, CAST(rk AS INT) AS rank, {r("d", "max_distance", 5)}, n_points, {r("cx", "centroid_x", 5)}, {r("cy", "centroid_y", 5)}, {r("cz", "centroid_z", 5)} FROM k WHERE rk <= 10""")
def _(spark, sf):
    near = S.contacts_on_surface(view(spark, sf, "contacts"), view(spark, sf, "vertices"), [], None)
    return rounded(R.worst_rows(near, ["session_id"], [k for k in KEYS if k != "session_id"], "distance", ["x", "y", "z"]), 5)


_BOX = f"""f AS (SELECT {K}, max(x) + 25 AS depth_max, max(iff) AS velocity_max FROM contacts GROUP BY {K}),
"""


@query("feature_box_heatmap", NEAR + _BOX + f"""w AS (SELECT {K} FROM f WHERE depth_max BETWEEN 10 AND 40 AND velocity_max BETWEEN 20 AND 70),
s AS (SELECT *, {SUB} FROM rf SEMI JOIN w USING ({K})), h AS (SELECT *, {SUB} FROM hits SEMI JOIN w USING ({K})),
n AS (SELECT session_id, subset, count(DISTINCT ({K})) AS n_touches FROM s GROUP BY 1, 2),
u AS (SELECT session_id, subset, vertex_id, count(DISTINCT ({K})) AS n_unique FROM h GROUP BY 1, 2, 3),
a AS (SELECT session_id, subset, vertex_id, avg(rf_mean) AS value FROM s GROUP BY 1, 2, 3)
SELECT session_id, subset, vertex_id, {r("value", "value")}, n_unique, n_touches FROM a JOIN u USING (session_id, subset, vertex_id) JOIN n USING (session_id, subset)""")
def _(spark, sf):
    out = E.box_heatmap(_peaks(spark, sf), _hits(spark, sf), {"depth_max": (10, 40), "velocity_max": (20, 70)}, "iff", 0.2, rows=_rows(spark, sf))
    return rounded(out.select("session_id", "subset", "vertex_id", "value", "n_unique", "n_touches"))


@query("grouped_contacts", ctes("contacts") + f""", f AS (SELECT {K}, max(x) + 25 AS depth_max, max(iff) AS velocity_max, min(gesture_type) AS kind FROM contacts GROUP BY {K}),
q AS (SELECT quantile_cont(velocity_max, [1/3, 2/3]) AS v, quantile_cont(depth_max, 0.5) AS d FROM f),
l AS (SELECT {K}, concat_ws('_', CASE WHEN velocity_max <= v[1] THEN '0' WHEN velocity_max <= v[2] THEN '1' ELSE '2' END, CASE WHEN depth_max <= d THEN '0' ELSE '1' END, kind) AS group_label FROM f, q)
SELECT group_label, session_id, count(*) AS n_rows, CAST(sum(spike) AS BIGINT) AS n_spikes, {r("avg(iff)", "iff_mean")} FROM contacts JOIN l USING ({K}) GROUP BY 1, 2""")
def _(spark, sf):
    c = view(spark, sf, "contacts")
    t = c.groupBy(*KEYS).agg((F.max("x") + 25).alias("depth_max"), F.max("iff").alias("velocity_max"), F.min("gesture_type").alias("kind"))
    labels = E.group_labels(t, {"velocity_max": 3, "depth_max": 2}, ["kind"])
    return rounded(E.with_group_labels(c, labels).groupBy("group_label", "session_id").agg(
        F.count("*").alias("n_rows"), F.sum("spike").cast("long").alias("n_spikes"), F.avg("iff").alias("iff_mean")))


# Vertices lifted off the mesh; the nearest centroid by brute force, weights from the normal equations of the face.
@query("surface_unfolding", MESH + f""", p AS (SELECT DISTINCT session_id, x + 0.25 AS x, y + 0.5 AS y, z + 0.125 AS z FROM mv),
t AS (SELECT mf.session_id, mf.i, mf.j, mf.k, a.x AS ax, a.y AS ay, a.z AS az, a.u AS au, a.v AS av, b.x - a.x AS bx, b.y - a.y AS by_, b.z - a.z AS bz, b.u - a.u AS bu, b.v - a.v AS bv,
 c.x - a.x AS cx, c.y - a.y AS cy, c.z - a.z AS cz, c.u - a.u AS cu, c.v - a.v AS cv, (a.x + b.x + c.x) / 3 AS mx, (a.y + b.y + c.y) / 3 AS my, (a.z + b.z + c.z) / 3 AS mz
 FROM mf JOIN mv a ON a.session_id = mf.session_id AND a.vertex_id = mf.i JOIN mv b ON b.session_id = mf.session_id AND b.vertex_id = mf.j JOIN mv c ON c.session_id = mf.session_id AND c.vertex_id = mf.k),
n AS (SELECT p.session_id, p.x, p.y, p.z, min(struct_pack(d := (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), i := i, j := j, k := k)) AS f FROM p JOIN t USING (session_id) GROUP BY 1, 2, 3, 4),
w AS (SELECT n.session_id, x, y, z, au, av, bu, bv, cu, cv, bx * bx + by_ * by_ + bz * bz AS d00, bx * cx + by_ * cy + bz * cz AS d01, cx * cx + cy * cy + cz * cz AS d11,
 (x - ax) * bx + (y - ay) * by_ + (z - az) * bz AS d20, (x - ax) * cx + (y - ay) * cy + (z - az) * cz AS d21
 FROM n JOIN t ON t.session_id = n.session_id AND t.i = n.f.i AND t.j = n.f.j AND t.k = n.f.k)
SELECT session_id, {r("x", "x")}, {r("y", "y")}, {r("au + ((d11 * d20 - d01 * d21) * bu + (d00 * d21 - d01 * d20) * cu) / (d00 * d11 - d01 * d01)", "u")},
 {r("av + ((d11 * d20 - d01 * d21) * bv + (d00 * d21 - d01 * d20) * cv) / (d00 * d11 - d01 * d01)", "v")} FROM w""")
def _(spark, sf):
    v, f = _mesh(spark, sf)
    p = v.select("session_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), (F.col("z") + 0.125).alias("z"))
    return rounded(S.xyz_to_uv(p, f, v, ["session_id"]).select("session_id", "x", "y", "u", "v"))
