"""Distance joins between contact points and surface vertices, and response maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haptrace.functions import columns as C
from haptrace.schema import KEYS, SUBSETS
from haptrace.session import cut_lineage, group_limit

CUTOFF_MM = 15.0
# Vertices per grid cell above which the cells are made smaller.
CELL_LOAD = 512


def _cell(axes: list[str], size: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{a}") / size).alias(f"_c{i}") for i, a in enumerate(axes)]


def _neighbourhood(rows: DataFrame, axes: list[str], size: float) -> DataFrame:
    """Each row in its own and all adjacent cells."""
    out = rows.select("*", *_cell(axes, size))
    for i in range(len(axes)):
        out = out.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + d for d in (-1, 0, 1)])))
    return out


def _d2(axes: list[str], site: Column | None = None) -> Column:
    def place(a):
        return F.col(f"_v_{a}") if site is None else site[f"_v_{a}"]
    parts = [(F.col(a) - place(a)) * (F.col(a) - place(a)) for a in axes]
    return sum(parts[1:], parts[0])


def nearest(points: DataFrame, vertices: DataFrame, keys: list[str], max_distance: float | None = CUTOFF_MM,
            axes: list[str] = ["x", "y", "z"], vertex: str = "vertex_id") -> DataFrame:
    """Distinct points with their nearest vertex and its distance; farther ones drop out.

    A grid turns the search into an equi-join: all vertices within one cell size of a
    point lie in the adjacent cells, so a hit closer than the cell size is final.  Cells
    start small where vertices are dense and double until the cut-off is reached; without
    a cut-off they double until every point has a vertex.  Ties go to the lowest id.

    A cell's vertices are one list, so a point meets at most one row per adjacent cell and
    no pair of a point and a vertex is sorted or shuffled.
    """
    points = points.select(*keys, *axes).na.drop(subset=axes).distinct()
    # Copies of a vertex position count once, under their lowest id.
    sites = vertices.groupBy(*keys, *axes).agg(F.min(vertex).alias(vertex))
    named = sites.select(*keys, vertex, *[F.col(a).cast("double").alias(f"_v_{a}") for a in axes])
    vaxes = [f"_v_{a}" for a in axes]

    def load(size: float) -> int:
        return named.groupBy(*keys, *_cell(vaxes, size)).count().agg(F.max("count")).first()[0] or 0

    if max_distance is None:
        ends = named.agg(F.count("*"), *[f(a) for a in vaxes for f in (F.min, F.max)]).first()
        if not ends[0]:
            return points.limit(0).select("*", F.lit(None).cast("long").alias(vertex), F.lit(0.0).alias("distance"))
        extent = max(ends[i + 1] - ends[i] for i in range(1, 2 * len(axes), 2)) or 1.0
        size = extent / max(1.0, ends[0] ** (1 / len(axes)))
    else:
        size = float(max_distance)
    smallest = size / 1024
    while size > smallest and load(size) > CELL_LOAD:
        size /= 2

    cells = [f"_c{i}" for i in range(len(axes))]
    # A number of one's own: small inputs would be put into one task, which then does all comparisons.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, left = None, points
    while True:
        last = max_distance is not None and size >= max_distance
        if found is None and not last:
            # The rounds tell points by their coordinates, which must not be worked out anew: sums may differ in the last bit.
            left = cut_lineage(left)
        listed = named.groupBy(*keys, *_cell(vaxes, size)).agg(F.collect_list(F.struct(*vaxes, vertex)).alias("_sites"))
        around = _neighbourhood(left, axes, size).repartition(tasks, *keys, *cells)
        nearest_of = F.array_min(F.transform("_sites", lambda s: F.struct(_d2(axes, s).alias("_d2"), s[vertex].alias(vertex))))
        best = (
            around.join(listed, [*keys, *cells]).select(*keys, *axes, nearest_of.alias("_b"))
            .groupBy(*keys, *axes).agg(F.min("_b").alias("_b"))
            .select(*keys, *axes, F.col(f"_b.{vertex}").alias(vertex), F.sqrt("_b._d2").alias("distance"))
            .filter(F.col("distance") <= (max_distance if last else size))
        )
        if last:
            return best if found is None else found.unionByName(best)
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(best, [*keys, *axes], "left_anti"))
        if left.isEmpty():
            return found
        size *= 2
        if max_distance is not None:
            size = min(size, float(max_distance))


def map_vertices(new: DataFrame, original: DataFrame, keys: list[str], error_mm: float = 5.0) -> DataFrame:
    """Nearest original vertex of every new vertex; one farther than the limit is an error."""
    out = nearest(new, original, keys, max_distance=None)
    too_far = F.raise_error(F.concat(F.lit("vertex farther than the limit: "), F.col("distance").cast("string")))
    return out.withColumn("distance", F.when(F.col("distance") > error_mm, too_far).otherwise(F.col("distance")))


def radius_max(vertices: DataFrame, points: DataFrame, value: str, radius: float, keys: list[str],
               axes: list[str] = ["x", "y", "z"]) -> DataFrame:
    """Largest value of the points within ``radius`` of each vertex."""
    sites = points.groupBy(*keys, *axes).agg(F.max(value).alias("_value"))
    spread = _neighbourhood(vertices.select(*keys, "vertex_id", *[F.col(a).alias(f"_v_{a}") for a in axes]),
                            [f"_v_{a}" for a in axes], radius)
    pairs = sites.select("*", *_cell(axes, radius)).join(spread, [*keys, *[f"_c{i}" for i in range(len(axes))]])
    hit = pairs.filter(_d2(axes) <= radius * radius).groupBy(*keys, "vertex_id").agg(F.max("_value").alias(value))
    return vertices.select(*keys, "vertex_id").join(hit, [*keys, "vertex_id"], "left")


def contacts_on_surface(contacts: DataFrame, vertices: DataFrame, surface_keys: list[str],
                        max_distance: float | None = CUTOFF_MM) -> DataFrame:
    """Contact rows with ``vertex_id``; each distinct point is searched once."""
    axes = ["x", "y", "z"]
    return contacts.join(nearest(contacts, vertices, surface_keys, max_distance), [*surface_keys, *axes])


def contact_rows(frames: DataFrame) -> DataFrame:
    """Frames exploded into one row per contact point, each contact string parsed once."""
    strings = frames.select("contact_points").distinct()
    parsed = strings.select("contact_points", F.inline(C.contact_points("contact_points")))
    return frames.join(parsed, "contact_points")


def touches_together(contacts: DataFrame, keys: list[str] = KEYS, rows: int | None = None) -> DataFrame:
    """Rows dealt by touch, before anything is summed by touch.

    ``rows``, if known, is a number that the rows don't exceed: tasks are then so many that none holds much more than the row
    limit of a task, whatever the session's partitions.

    Nearly every touch and vertex is a group of its own, so sums taken where the rows are read save nothing and hold
    all rows of a task's input, which grows with the files. Dealt rows need no other shuffle to be grouped by touch and any
    further column. Trials are left out: a constant one is no grouping key to Spark, which then wouldn't know the rows as dealt.
    """
    # A number of one's own: adaptive execution would join the parts by their bytes, but it is groups that take memory.
    tasks = max(int(contacts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // group_limit(contacts)))
    return contacts.repartition(tasks, *[k for k in keys if k in KEYS and k != "trial_id"] or keys)


def touch_rf(contacts: DataFrame, value: str, keys: list[str] = KEYS, rows: int | None = None) -> DataFrame:
    """Mean and maximum response of each vertex in each touch; a missing value drops the vertex."""
    return touches_together(contacts, keys, rows).groupBy(*keys, "vertex_id").agg(
        F.avg(value).alias("rf_mean"), F.max(value).alias("rf_max"), F.count_if(F.col(value).isNull()).alias("_gap")
    ).filter("_gap = 0").drop("_gap")


def subset_exploded(df: DataFrame) -> DataFrame:
    return df.withColumn("subset", F.explode(C.subset_members("gesture_type")))


def heatmap(rf: DataFrame, by: list[str], value: str = "rf_mean") -> DataFrame:
    """Mean over touches of the per-touch vertex value."""
    return rf.groupBy(*by, "vertex_id").agg(F.avg(value).alias("value"))


def unique_touches(contacts: DataFrame, by: list[str], keys: list[str] = KEYS) -> DataFrame:
    pairs = contacts.select(*dict.fromkeys([*by, "vertex_id", *keys])).distinct()
    return pairs.groupBy(*by, "vertex_id").agg(F.count("*").alias("n_unique"))


def population_heatmap(hits: DataFrame, value: str, percent: float, keys: list[str] = KEYS, rows: int | None = None) -> DataFrame:
    """The heat map of every session and gesture subset from the hits, as one chain of aggregates.

    One row per touch and vertex carries the mean and whether a value is missing; a touch that has
    several gestures counts once per subset as a visitor, and with each gesture's mean as a value.
    Subsets are columns as long as rows are as many as touches, so no task holds a touch once per subset.
    """
    by = ["session_id", "subset"]
    touch = touches_together(hits, keys, rows).groupBy(*keys, "gesture_type", "vertex_id").agg(F.avg(value).alias("_m"), F.count_if(F.col(value).isNull()).alias("_gap"))
    touch = touch.withColumn("_m", F.when(F.col("_gap") == 0, F.col("_m"))).withColumn("_in", C.subset_members("gesture_type"))
    inside = {s: F.array_contains("_in", s) for s in SUBSETS}
    sums = {"_s": lambda s: F.sum(F.when(inside[s], F.col("_m"))), "_k": lambda s: F.count(F.when(inside[s], F.col("_m"))), "_any": lambda s: F.max(inside[s])}

    def per_subset(df: DataFrame, group: list[str], kept: list[str], names: list[str]) -> DataFrame:
        """One row per group and subset that has rows in it."""
        wide = df.groupBy(*dict.fromkeys(["session_id", *group])).agg(*[sums[n](s).alias(f"{n}_{s}") for s in SUBSETS for n in names])
        rows_ = F.array(*[F.struct(F.lit(s).alias("subset"), *[F.col(f"{n}_{s}").alias(n) for n in names]) for s in SUBSETS])
        return wide.select(*kept, F.inline(rows_)).filter("_any")

    known = per_subset(touch.filter("_m is not null"), keys, ["session_id"], ["_any"])
    n = known.groupBy(*by).agg(F.count("*").alias("n_touches"))
    each = per_subset(touch, [*keys, "vertex_id"], ["session_id", "vertex_id"], ["_s", "_k", "_any"])
    maps = each.groupBy(*by, "vertex_id").agg((F.sum("_s") / F.sum("_k")).alias("value"), F.count("*").alias("n_unique"), F.sum("_k").alias("_k"))
    out = maps.filter("_k > 0").drop("_k").join(n, by)
    return out.withColumn("threshold", C.count_threshold(percent, "n_touches")).withColumn("marked", C.mark_below("value", "n_unique", "threshold"))


def thresholded_heatmap(rf: DataFrame, contacts: DataFrame, by: list[str], percent: float, keys: list[str] = KEYS) -> DataFrame:
    """Heat map with -1 at vertices that too few of the touches reach."""
    n = rf.select(*by, *keys).distinct().groupBy(*by).agg(F.count("*").alias("n_touches"))
    joined = heatmap(rf, by).join(unique_touches(contacts, by, keys), [*by, "vertex_id"]).join(n, by)
    return joined.withColumn("threshold", C.count_threshold(percent, "n_touches")).withColumn(
        "marked", C.mark_below("value", "n_unique", "threshold"))


def vertex_modes(contacts: DataFrame, by: list[str]) -> DataFrame:
    return contacts.groupBy(*by, "vertex_id").agg(
        F.avg("iff").alias("mean_iff"), F.sum("iff").alias("cumulative_iff"), F.avg("spike").alias("spike_density"))


def point_spikes(contacts: DataFrame, by: list[str], place: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Spikes and distinct spiking touches per place; the session is part of the touch key."""
    return contacts.filter("spike = 1").groupBy(*by, *place).agg(
        F.count("*").alias("spike_count"), F.count_distinct(*keys).alias("unique_touch_spike_count"))


def selectivity(contacts: DataFrame, by: list[str], place: list[str], minimum: float = 0.0) -> DataFrame:
    return contacts.groupBy(*by, *place).agg(
        F.sum("spike").alias("spike_count"), F.count("*").alias("total_count"), F.avg("spike").alias("selectivity")
    ).filter(F.col("selectivity") >= minimum)


def spike_ratio(contacts: DataFrame, by: list[str], place: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Share of the touches of the group that fired at the place."""
    n = contacts.select(*by, *keys).distinct().groupBy(*by).agg(F.count("*").alias("n_touches"))
    return point_spikes(contacts, by, place, keys).join(n, by).withColumn(
        "spike_ratio", F.try_divide("unique_touch_spike_count", "n_touches"))


def unique_points(points: DataFrame, keys: list[str], mm: float, axes: list[str] = ["x", "y", "z"]) -> DataFrame:
    return points.select(*keys, *[C.round_to(a, mm).alias(a) for a in axes]).distinct()


def not_contained(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``inner`` that ``outer`` lacks; empty when the sets are nested."""
    return inner.select(*on).distinct().join(outer.select(*on).distinct(), on, "left_anti")


def require_rf(touches: DataFrame, rf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """RF rows of the touches; a touch without any is an error."""
    if not touches.join(rf, keys, "left_anti").isEmpty():
        raise ValueError("some touches have no response map")
    return rf.join(touches.select(*keys).distinct(), keys, "left_semi")


def with_neuron_type(df: DataFrame, units: DataFrame, session: str = "unit") -> DataFrame:
    """Neuron type by unit name, trimmed and case-blind in the header; unknown units are an error."""
    cols = {c.strip().lower(): c for c in units.columns}
    unit = cols.get("unit", units.columns[0])
    kind = cols.get("neuron type", cols.get("neuron_type", units.columns[-1]))
    dim = units.select(F.trim(F.col(f"`{unit}`").cast("string")).alias(session), F.trim(F.col(f"`{kind}`")).alias("neuron_type"))
    dim = dim.filter(F.col(session).isNotNull()).dropDuplicates([session])
    if not df.select(session).distinct().join(dim, session, "left_anti").isEmpty():
        raise ValueError("unknown unit in the session table")
    return df.join(dim, session)


# --- feature grid ----------------------------------------------------------------------


def feature_grid(spark, axes: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Cartesian grid of centers ``min + i * step`` below ``max``."""
    out = spark.range(1).select()
    for name, (lo, hi, step) in axes.items():
        n = axis_size(lo, hi, step)
        cells = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
        out = out.select("*", cells.alias(f"i_{name}")).withColumn(f"center_{name}", F.lit(lo) + F.col(f"i_{name}") * step)
    return out


def axis_size(lo: float, hi: float, step: float) -> int:
    import math

    return max(0, math.ceil((hi - lo) / step - 1e-9))


def cell_members(touches: DataFrame, axes: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """Touches repeated for every cell they fall into; ``axes``: min, max, step, span.

    Cells overlap and are closed at both ends.  The reachable index range follows from
    the value by arithmetic, so no touch meets a cell it cannot belong to.
    """
    out = touches
    for name, (lo, hi, step, span) in axes.items():
        x, n = F.col(name), axis_size(lo, hi, step)
        first = F.greatest(F.lit(0), F.floor((x - span / 2 - lo) / step) - 0).cast("int")
        last = F.least(F.lit(n - 1), F.ceil((x + span / 2 - lo) / step)).cast("int")
        reach = F.when(x.isNotNull() & (first <= last), F.sequence(first, last))
        out = out.withColumn(f"i_{name}", F.explode(reach))
        center = F.lit(lo) + F.col(f"i_{name}") * step
        out = out.filter((F.col(name) >= center - span / 2) & (F.col(name) <= center + span / 2))
    return out


# --- mesh ------------------------------------------------------------------------------


def mesh_scale(faces: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Median ratio of the 3-D to the UV length over the distinct edges of a mesh."""
    from haptrace.operators.quantiles import percentiles

    pairs = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("i", "j"), ("j", "k"), ("i", "k"))])
    edges = faces.select(*keys, F.inline(pairs)).distinct()
    def side(s):
        return vertices.select(*keys, F.col("vertex_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("u", "v", "x", "y", "z")])
    both = edges.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    flat = C.distance(["u_a", "v_a"], ["u_b", "v_b"])
    full = C.distance(["x_a", "y_a", "z_a"], ["x_b", "y_b", "z_b"])
    ratio = both.withColumn("_ratio", F.when(flat > 1e-12, full / flat))
    return percentiles(ratio, keys, {"uv_to_mm": ("_ratio", 0.5)})


def uv_to_xyz(points: DataFrame, faces: DataFrame, vertices: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Barycentric position of UV points on a mesh; points outside snap to a vertex.

    Triangles are spread over the grid cells of their bounding box, points join by cell.
    ``cell`` should be near the size of a triangle.
    """
    def corner(s):
        return vertices.select(*keys, F.col("vertex_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("u", "v", "x", "y", "z")])
    tri = faces
    for s in ("i", "j", "k"):
        tri = tri.join(corner(s), [*keys, s])
    for n, a in enumerate(("u", "v")):
        ends = [F.floor(f(*[F.col(f"{a}_{s}") for s in "ijk"]) / cell) for f in (F.least, F.greatest)]
        tri = tri.withColumn(f"_c{n}", F.explode(F.sequence(*ends)))
    placed = points.select(*keys, "u", "v").distinct()
    hits = placed.select("*", *_cell(["u", "v"], cell)).join(tri, [*keys, "_c0", "_c1"])
    u, v = F.col("u"), F.col("v")
    det = (F.col("v_j") - F.col("v_k")) * (F.col("u_i") - F.col("u_k")) + (F.col("u_k") - F.col("u_j")) * (F.col("v_i") - F.col("v_k"))
    wi = ((F.col("v_j") - F.col("v_k")) * (u - F.col("u_k")) + (F.col("u_k") - F.col("u_j")) * (v - F.col("v_k"))) / det
    wj = ((F.col("v_k") - F.col("v_i")) * (u - F.col("u_k")) + (F.col("u_i") - F.col("u_k")) * (v - F.col("v_k"))) / det
    hits = hits.filter(det != 0).withColumns({"_wi": wi, "_wj": wj}).withColumn("_wk", 1 - F.col("_wi") - F.col("_wj"))
    inside = hits.filter((F.col("_wi") >= -1e-9) & (F.col("_wj") >= -1e-9) & (F.col("_wk") >= -1e-9))
    xyz = [(F.col("_wi") * F.col(f"{c}_i") + F.col("_wj") * F.col(f"{c}_j") + F.col("_wk") * F.col(f"{c}_k")).alias(c) for c in "xyz"]
    on = inside.groupBy(*keys, "u", "v").agg(F.min(F.struct("i", "j", "k", *xyz)).alias("_t")).select(
        *keys, "u", "v", *[F.col(f"_t.{c}").alias(c) for c in "xyz"], F.lit(True).alias("inside"))
    outside = placed.join(on, [*keys, "u", "v"], "left_anti")
    snapped = nearest(outside, vertices, keys, None, ["u", "v"]).join(
        vertices.select(*keys, "vertex_id", "x", "y", "z"), [*keys, "vertex_id"])
    return on.unionByName(snapped.select(*keys, "u", "v", "x", "y", "z", F.lit(False).alias("inside")))


def xyz_to_uv(points: DataFrame, faces: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """UV of 3-D points: barycentric weights of the foot of each point on the face with the nearest centroid.

    The foot may lie outside that face, then the weights go on linearly.  A face without area gives the UV of
    its centroid; of equally near centroids the one with the smallest (i, j, k) counts.  Points with a null
    coordinate drop out; a key without faces gives no rows.
    """
    tri = faces.select(*keys, "i", "j", "k").distinct()
    for s in ("i", "j", "k"):
        corner = vertices.select(*keys, F.col("vertex_id").alias(s), F.array("x", "y", "z").alias(f"_p{s}"), F.col("u").alias(f"_u{s}"), F.col("v").alias(f"_v{s}"))
        tri = tri.join(corner, [*keys, s])
    middle = [((F.col("_pi")[n] + F.col("_pj")[n] + F.col("_pk")[n]) / 3).alias(a) for n, a in enumerate("xyz")]
    centers = tri.select(*keys, *middle, F.struct("i", "j", "k").alias("face"))
    placed = points.join(centers.select(*keys).distinct(), keys, "left_semi") if keys else points
    near = nearest(placed, centers, keys, None, vertex="face").select(*keys, "x", "y", "z", *[F.col(f"face.{s}").alias(s) for s in "ijk"])
    at = near.join(tri, [*keys, "i", "j", "k"])

    def minus(a, b):
        return F.zip_with(a, b, lambda p, q: p - q)

    def dot(a, b):
        return sum((F.col(a)[n] * F.col(b)[n] for n in (1, 2)), F.col(a)[0] * F.col(b)[0])

    # The part of a point across the face has no share in these products, so its foot needs no computing.
    at = at.withColumns({"_0": minus("_pj", "_pi"), "_1": minus("_pk", "_pi"), "_2": minus(F.array("x", "y", "z"), "_pi")})
    at = at.withColumns({f"_d{a}{b}": dot(f"_{a}", f"_{b}") for a, b in ("00", "01", "11", "20", "21")})
    det = F.col("_d00") * F.col("_d11") - F.col("_d01") * F.col("_d01")
    third = F.lit(1 / 3)
    wj = F.when(det >= 1e-20, (F.col("_d11") * F.col("_d20") - F.col("_d01") * F.col("_d21")) / det).otherwise(third)
    wk = F.when(det >= 1e-20, (F.col("_d00") * F.col("_d21") - F.col("_d01") * F.col("_d20")) / det).otherwise(third)
    at = at.withColumns({"_wj": wj, "_wk": wk}).withColumn("_wi", 1 - F.col("_wj") - F.col("_wk"))
    return at.select(*keys, "x", "y", "z", *[
        sum((F.col(f"_w{s}") * F.col(f"_{a}{s}") for s in "jk"), F.col("_wi") * F.col(f"_{a}i")).alias(a) for a in "uv"])


def cylinder_axis(vertices: DataFrame, center: list[float], k: int = 500, axis: list[float] | None = None) -> tuple[list[float], list[float], float]:
    """Axis direction, a point on it and the mean radius from the ``k`` vertices nearest to ``center``; a known ``axis`` stays."""
    d2 = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip("yz", center[1:])), (F.col("x") - center[0]) * (F.col("x") - center[0]))
    near = vertices.orderBy(d2, "vertex_id").limit(k)
    m = near.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], *[F.covar_pop(a, b).alias(n) for n, a, b in (
        ("xx", "x", "x"), ("xy", "x", "y"), ("xz", "x", "z"), ("yy", "y", "y"), ("yz", "y", "z"), ("zz", "z", "z"))])
    row = C.with_principal_axis(m, {n: n for n in ("xx", "xy", "xz", "yy", "yz", "zz")}).first()
    axis, mean = axis or [row[f"_u{i}"] for i in range(3)], [row[f"m{a}"] for a in "xyz"]
    rel = [F.col(a) - c for a, c in zip("xyz", mean)]
    along = rel[0] * axis[0] + rel[1] * axis[1] + rel[2] * axis[2]
    off = C.norm(*[r - along * a for r, a in zip(rel, axis)])
    return axis, mean, near.agg(F.avg(off)).first()[0]


PROJECTIONS = {
    "tangent_plane": lambda p: tuple(C.rotate([F.col(a) - c for a, c in zip("xyz", p["center"])], p["rotation"])[:2]),
    # By a camera's rotation the axis is its right, angle 0 faces it and angles grow upwards; else ``toward`` lies at angle 0.
    "cylindrical_unwrap": lambda p: C.cylinder_uv("x", "y", "z", p["rotation"][0], p["center"], p.get("radius"), zero=[-w for w in p["rotation"][2]], up=p["rotation"][1])
    if "rotation" in p else C.cylinder_uv("x", "y", "z", p["axis"], p["center"], p.get("radius"), toward=p.get("toward")),
}


def project(df: DataFrame, method: str, parameters: dict, keys: list[str] | None = None) -> DataFrame:
    """Add ``u`` and ``v``; ``slim`` looks up a precomputed (vertex_id, u, v) table."""
    if method == "slim":
        return df.join(parameters["table"].select(*(keys or []), "vertex_id", "u", "v"), [*(keys or []), "vertex_id"])
    if method not in PROJECTIONS:
        raise ValueError(f"unknown projection {method!r}; known: {sorted([*PROJECTIONS, 'slim'])}")
    u, v = PROJECTIONS[method](parameters)
    return df.withColumns({"u": u, "v": v})
