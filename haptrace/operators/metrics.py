"""Metrics of response maps per group: intensity, distribution, shape, hulls, deviations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from haptrace.functions import columns as C
from haptrace.operators import fits
from haptrace.operators.ordered import has_large_groups
from haptrace.operators.quantiles import percentile_aggregates, percentiles, ranked_values
from haptrace.session import group_limit


def intensity(df: DataFrame, keys: list[str], value: str = "value", split: bool | None = None) -> DataFrame:
    """Max, mean, median, population deviation, range and count; one aggregate where the groups fit a task."""
    v = F.col(value)
    df = df.select(*keys, value)
    if split is None:
        df = df.persist()  # counted here, summed by the result
        split = has_large_groups(df.select(*keys), keys, group_limit(df))
    median = {"median_iff": (value, 0.5)}
    two = df.groupBy(*keys).agg(
        F.max(v).alias("max_iff"), F.avg(v).alias("mean_iff"), F.stddev_pop(v).alias("std_iff"),
        (F.max(v) - F.min(v)).alias("iff_range"), F.count(v).alias("n_vertices"), F.min(v).alias("_min"),
        *([] if split else percentile_aggregates(median)))
    if split:
        two = two.join(percentiles(df, keys, median, split=True), keys)
    span = F.col("max_iff") - F.col("_min")
    many = F.col("n_vertices") >= 2
    return two.withColumns({
        "hypsometric_integral": F.when(many & (span != 0), (F.col("mean_iff") - F.col("_min")) / span),
        "coefficient_of_variation": F.when(many & (F.col("mean_iff") != 0), F.col("std_iff") / F.col("mean_iff")),
    }).drop("_min")


def distribution(df: DataFrame, keys: list[str], value: str = "value", split: bool | None = None) -> DataFrame:
    """Biased skewness, excess kurtosis, Gini coefficient and entropy in bits."""
    v = F.col(value)
    df = df.select(*keys, value)
    if split is None:
        df = df.persist()  # counted here, summed and ranked by the result
        split = has_large_groups(df.select(*keys), keys, group_limit(df))
    base = df.groupBy(*keys).agg(
        F.count(v).alias("_n"), F.sum(v).alias("_total"), F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"),
        F.sum(F.when(v > 0, v * F.log2(v)).otherwise(0.0)).alias("_vlog"))
    # Copies of a value at places before+1 .. before+cnt: their ranks sum to cnt * average rank.
    ranks = ranked_values(df, keys, value, split=split)
    weighted = ranks.groupBy(*keys).agg(F.sum(v * F.col("cnt") * (F.col("before") + (F.col("cnt") + 1) / 2)).alias("_rv"))
    n, total = F.col("_n"), F.col("_total")
    gini = F.when(total != 0, F.col("_rv") * 2 / (n * total) - (n + 1) / n)
    return base.join(weighted, keys).select(
        *keys, F.when(n >= 2, F.col("_skew")).alias("iff_skewness"), F.when(n >= 2, F.col("_kurt")).alias("iff_kurtosis"),
        F.when(n == 1, 0.0).otherwise(gini).alias("gini_coefficient"),
        F.when(n == 1, 0.0).when(total != 0, F.log2(total) - F.col("_vlog") / total).alias("shannon_entropy"),
    )


def weighted_centroid(df: DataFrame, keys: list[str], axes: list[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[
        F.when(F.sum(w) == 0, F.avg(a)).otherwise(F.sum(w * F.col(a)) / F.sum(w)).alias(f"weighted_centroid_{a}") for a in axes])


def ellipse(df: DataFrame, keys: list[str], u: str = "u", v: str = "v", weight: str | None = None) -> DataFrame:
    """Two-sigma axes, direction and aspect ratio of the (weighted) point cloud.

    Sums are taken about the group mean, which keeps them stable far from the origin.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    total = df.groupBy(*keys).agg(F.sum(w).alias("_t"), F.avg(u).alias("_u0"), F.avg(v).alias("_v0"))
    away = df.join(total, keys).withColumns({
        "_w": F.when(F.col("_t") == 0, 1.0).otherwise(w), "_du": F.col(u) - F.col("_u0"), "_dv": F.col(v) - F.col("_v0")})
    sw, du, dv = F.sum("_w"), F.col("_du"), F.col("_dv")
    m = away.groupBy(*keys).agg(
        F.count("*").alias("_n"), (F.sum(F.col("_w") * du) / sw).alias("_mu"), (F.sum(F.col("_w") * dv) / sw).alias("_mv"),
        (F.sum(F.col("_w") * du * du) / sw).alias("_uu"), (F.sum(F.col("_w") * du * dv) / sw).alias("_uv"),
        (F.sum(F.col("_w") * dv * dv) / sw).alias("_vv"), F.first("_u0").alias("_u0"), F.first("_v0").alias("_v0"))
    a = F.col("_uu") - F.col("_mu") * F.col("_mu")
    b = F.col("_uv") - F.col("_mu") * F.col("_mv")
    d = F.col("_vv") - F.col("_mv") * F.col("_mv")
    e = C.eigen_2x2(a, b, d)
    ok = F.col("_n") >= 2
    major = F.when(ok, F.sqrt(F.greatest(e["l1"], F.lit(0.0))) * 2)
    minor = F.when(ok, F.sqrt(F.greatest(e["l2"], F.lit(0.0))) * 2)
    out = m.select(
        *keys, (F.col("_u0") + F.col("_mu")).alias("center_u"), (F.col("_v0") + F.col("_mv")).alias("center_v"), F.col("_n").alias("n_points"),
        major.alias("ellipse_major"), minor.alias("ellipse_minor"), F.when(ok, F.degrees(e["angle"])).alias("orientation_deg"))
    ratio = F.col("ellipse_minor") / F.col("ellipse_major")
    return out.withColumns({
        "aspect_ratio": F.when(F.col("ellipse_minor") > 0, F.col("ellipse_major") / F.col("ellipse_minor")),
        "eccentricity": F.when((F.col("ellipse_major") > 0) & (ratio <= 1), F.sqrt(1 - ratio * ratio))})


def pca_alignment(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Center and rotation rows of the vertices with a positive value; below three is an error."""
    e = ellipse(df.filter(F.col(value) > 0), keys)
    few = F.raise_error(F.lit("fewer than 3 vertices above the threshold"))
    angle = F.radians(F.when(F.col("n_points") < 3, few).otherwise(F.col("orientation_deg")))
    return e.select(
        *keys, "center_u", "center_v", F.degrees(angle).alias("angle_deg"), F.cos(angle).alias("major_u"), F.sin(angle).alias("major_v"),
        (-F.sin(angle)).alias("minor_u"), F.cos(angle).alias("minor_v"))


# --- convex hulls ----------------------------------------------------------------------


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of 2-D points in turn order."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hulls(df: DataFrame, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """Hull area, perimeter and corner count per group; area 0 for degenerate groups.

    Hulls are merged like partial sums: every batch keeps only its own corners, once
    before and once after a salted shuffle, so the last step sees a few corners per group.
    """
    points = df.select(*keys, F.col(u).cast("double").alias("_u"), F.col(v).cast("double").alias("_v")).na.drop(subset=["_u", "_v"])
    schema = points.schema

    def corners(batches):
        for batch in batches:
            kept = []
            for _, g in batch.groupby(keys, sort=False, dropna=False):
                u, v = hull_points(g[["_u", "_v"]].drop_duplicates().to_numpy()).T
                kept.append(g[keys].head(len(u)).assign(_u=u, _v=v))
            if kept:
                yield pd.concat(kept)

    part = points.mapInPandas(corners, schema)
    salted = part.repartition(*keys, F.pmod(F.xxhash64("_u", "_v"), F.lit(32))).mapInPandas(corners, schema)

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        h = hull_points(g[["_u", "_v"]].drop_duplicates().to_numpy())
        x, y = h[:, 0], h[:, 1]
        area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(h) >= 3 else 0.0
        edge = float(np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)).sum()) if area > 0 else float("nan")
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "hull_area": [area], "hull_perimeter": [edge], "hull_corners": [len(h)]})

    out = T.StructType([*[f for f in schema.fields if f.name in keys], T.StructField("hull_area", T.DoubleType()),
                        T.StructField("hull_perimeter", T.DoubleType()), T.StructField("hull_corners", T.LongType())])
    return salted.groupBy(*keys).applyInPandas(measure, out).withColumn("hull_perimeter", C.nan_to_null("hull_perimeter"))


def above_peak_share(df: DataFrame, keys: list[str], weight: str, fraction: float = 0.5) -> DataFrame:
    peak = df.groupBy(*keys).agg(F.max(weight).alias("_peak"))
    return df.join(peak, keys).filter(F.col(weight) >= F.col("_peak") * fraction).drop("_peak")


def top_share(df: DataFrame, keys: list[str], weight: str, tie: str, fraction: float = 0.2, split: bool | None = None) -> DataFrame:
    """The top ``ceil(fraction * n)`` rows of each group by weight, lowest ``tie`` first among equals."""
    if split is None:
        df = df.persist()  # counted here, ranked and kept by the result
        split = has_large_groups(df.select(*keys), keys, group_limit(df))
    n = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(fraction))).alias("_take"))
    order = F.struct((-F.col(weight)).alias("w"), F.col(tie).alias("t"))
    ranks = ranked_values(df.withColumn("_order", order), keys, "_order", split=split).select(*keys, "_order", "before")
    keep = ranks.join(n, keys).filter(F.col("before") < F.col("_take")).select(*keys, F.col("_order.t").alias(tie))
    return df.join(keep, [*keys, tie], "left_semi")


GAUSSIAN = ["converged", "r_squared", "amplitude", "x0", "y0", "theta_deg", "sigma_major", "sigma_minor"]


def map_metrics(df: DataFrame, keys: list[str], weight: str = "value", tie: str = "vertex_id", cells: DataFrame | None = None,
                gaussian: bool = True) -> DataFrame:
    """All metrics of response maps given as (keys, vertex, u, v, x, y, z, weight) rows.

    ``cells`` (keys) adds a row for every map without a vertex: no vertices, no total, nothing else
    known. ``gaussian`` adds a turned Gaussian bump fitted to each map, the one iterative part.
    """
    def hull(rows, name):
        return convex_hulls(rows, keys).select(*keys, *[F.col(f"hull_{c}").alias(f"{name}_{c}") for c in ("area", "perimeter", "corners")])
    # Kept by Spark from the counting job on (and rebuilt from its lineage where lost): every family reads the maps once more.
    df = df.select(*dict.fromkeys([*keys, tie, weight, "x", "y", "z", "u", "v"])).persist()
    split = has_large_groups(df.select(*keys), keys, group_limit(df))
    half = above_peak_share(df, keys, weight)
    out = (
        intensity(df, keys, weight, split).join(distribution(df, keys, weight, split), keys)
        .join(weighted_centroid(df, keys, ["x", "y", "z", "u", "v"], weight), keys)
        .join(ellipse(df, keys, weight=weight).drop("center_u", "center_v", "n_points"), keys)
        .join(hull(df, "convex_hull"), keys)
        .join(hull(half, "half_peak").drop("half_peak_perimeter", "half_peak_corners"), keys)
        .join(half.groupBy(*keys).agg(F.count("*").alias("half_peak_count")), keys)
        .join(hull(top_share(df, keys, weight, tie, split=split), "hotspot").drop("hotspot_perimeter", "hotspot_corners"), keys)
    )
    total = df.groupBy(*keys).agg(F.sum(weight).alias("total_iff"))
    out = out.join(total, keys).withColumn("sparsity_index", F.when(F.col("max_iff") > 0, 1 - F.col("mean_iff") / F.col("max_iff")))
    if gaussian:
        fit = fits.gaussian_fit(df, keys, "u", "v", weight)
        out = out.join(fit.select(*keys, *[F.col(c).alias(f"gaussian_{c}") for c in GAUSSIAN]), keys, "left").na.fill(False, ["gaussian_converged"])
    if cells is not None:
        out = cells.select(*keys).distinct().join(out, keys, "left").na.fill(0, ["n_vertices", "half_peak_count"]).na.fill(0.0, ["total_iff"])
        if gaussian:
            out = out.na.fill(False, ["gaussian_converged"])
    area = F.col("convex_hull_area")
    return out.withColumns({
        "hotspot_fraction": F.when(area > 0, F.col("hotspot_area") / area),
        "equivalent_diameter": F.sqrt(area * 4 / math.pi),
        "circularity": F.when((area != 0) & (F.col("convex_hull_perimeter") > 0), area * 4 * math.pi / F.pow("convex_hull_perimeter", F.lit(2))),
    })


def vertex_overlap(cells: DataFrame, base: DataFrame, cell: list[str], match: list[str]) -> DataFrame:
    """Jaccard similarity and containment of the vertex sets of cells in a baseline."""
    n_base = base.groupBy(*match).agg(F.count_distinct("vertex_id").alias("_nb"))
    mine = cells.select(*dict.fromkeys([*match, *cell]), "vertex_id").distinct()
    marked = base.select(*match, "vertex_id").distinct().withColumn("_hit", F.lit(1))
    both = mine.join(marked, [*match, "vertex_id"], "left").groupBy(*dict.fromkeys([*match, *cell])).agg(
        F.count("*").alias("_na"), F.count("_hit").alias("_both"))
    return both.join(n_base, match, "left").select(
        *dict.fromkeys([*match, *cell]), F.try_divide("_both", F.col("_na") + F.coalesce("_nb", F.lit(0)) - F.col("_both")).alias("jaccard"),
        F.try_divide("_both", F.col("_nb")).alias("containment"))


def baseline_deviation(metrics: DataFrame, base: DataFrame, match: list[str]) -> DataFrame:
    """Ratios and shifts of cell metrics to the baseline of the same session and gesture."""
    cols = ["convex_hull_area", "hotspot_area", "mean_iff", "max_iff", "equivalent_diameter",
            *[f"weighted_centroid_{a}" for a in "xyz"]]
    b = base.select(*match, *[F.col(c).alias(f"_b_{c}") for c in cols])
    shift = C.distance([f"weighted_centroid_{a}" for a in "xyz"], [f"_b_weighted_centroid_{a}" for a in "xyz"])
    return metrics.join(b, match, "left").withColumns({
        "deviation_area_ratio": C.safe_ratio("convex_hull_area", "_b_convex_hull_area"),
        "deviation_hotspot_area_ratio": C.safe_ratio("hotspot_area", "_b_hotspot_area"),
        "deviation_centroid_shift_mm": shift,
        "deviation_centroid_shift_normalized": C.safe_ratio(shift, "_b_equivalent_diameter"),
        "deviation_mean_iff_ratio": C.safe_ratio("mean_iff", "_b_mean_iff"),
        "deviation_peak_iff_ratio": C.safe_ratio("max_iff", "_b_max_iff"),
    }).drop(*[f"_b_{c}" for c in cols])
