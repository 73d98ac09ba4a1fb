"""Raster analytics: smoothing, derivatives, boundaries, polygons, profiles.

A raster is a set of rows (keys, r, c, u, v, z) with a fixed number of rows and columns;
row index follows u and column index follows v.  All rasters go through one grouped pass.
Only the tracing of a contour sees a raster as a whole, which its resolution bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from haptrace.functions import columns as C
from haptrace.operators.surface import nearest
from haptrace.operators.tuning import gaussian_kernel
from haptrace.session import cut_lineage

MARGIN = 0.05
BORDER = 2


def rasterise(points: DataFrame, keys: list[str], value: str, rows: int = 150, cols: int = 150, reach: int = 2,
              median: int | None = None) -> DataFrame:
    """Cell means of UV points; empty cells near filled ones take inverse-distance means.

    The bounds of each raster carry a 5 % margin; values are clipped at 0.
    """
    ends = points.groupBy(*keys).agg(*[f(a).alias(f"_{a}{n}") for a in ("u", "v") for n, f in (("0", F.min), ("1", F.max))])
    for a in ("u", "v"):
        pad = F.greatest((F.col(f"_{a}1") - F.col(f"_{a}0")) * MARGIN, F.lit(1e-9))
        ends = ends.withColumns({f"_{a}0": F.col(f"_{a}0") - pad, f"_{a}1": F.col(f"_{a}1") + pad})
    def index(a, n):
        return F.round((F.col(a) - F.col(f"_{a}0")) / (F.col(f"_{a}1") - F.col(f"_{a}0")) * (n - 1)).cast("int")
    cells = points.join(ends, keys).withColumns({"r": index("u", rows), "c": index("v", cols)}).groupBy(*keys, "r", "c").agg(
        F.avg(value).alias("z"))
    if reach:
        near = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
        sent = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(1.0 / (i * i + j * j) if i or j else -1.0).alias("w")) for i, j in near])
        spread = cells.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "z", F.inline(sent)).select(
            *keys, (F.col("_r") + F.col("dr")).alias("r"), (F.col("_c") + F.col("dc")).alias("c"), "z", "w")
        own = F.max(F.when(F.col("w") < 0, F.col("z")))
        away = F.when(F.col("w") > 0, F.col("w"))
        cells = spread.filter(f"r BETWEEN 0 AND {rows - 1} AND c BETWEEN 0 AND {cols - 1}").groupBy(*keys, "r", "c").agg(
            F.coalesce(own, F.sum(F.col("z") * away) / F.sum(away)).alias("z"))
    if median:
        half = median // 2
        offsets = F.array(*[F.lit(i) for i in range(-half, half + 1)])
        spread = cells.select(*keys, "r", "c", "z", F.explode(offsets).alias("dr")).select("*", F.explode(offsets).alias("dc"))
        # At most median x median values meet in a cell.
        middle = spread.groupBy(*keys, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(
            F.percentile("z", F.lit(0.5)).alias("_m"))
        cells = cells.join(middle, [*keys, "r", "c"]).select(*keys, "r", "c", F.col("_m").alias("z"))
    at = {a: F.col(f"_{a}0") + F.col(i) * (F.col(f"_{a}1") - F.col(f"_{a}0")) / (n - 1) for a, i, n in (("u", "r", rows), ("v", "c", cols))}
    return cells.join(ends, keys).select(*keys, "r", "c", at["u"].alias("u"), at["v"].alias("v"), F.greatest(F.col("z"), F.lit(0.0)).alias("z"))


def masked_lattice(points: DataFrame, keys: list[str], rows: int = 100, cols: int = 100, cut: float = 8.0) -> DataFrame:
    """Lattice over the points whose cells know their nearest point; null beyond the cut-off."""
    ends = points.groupBy(*keys).agg(*[f(a).alias(f"_{a}{n}") for a in ("u", "v") for n, f in (("0", F.min), ("1", F.max))])
    for a in ("u", "v"):
        pad = (F.col(f"_{a}1") - F.col(f"_{a}0")) * MARGIN
        ends = ends.withColumns({f"_{a}0": F.col(f"_{a}0") - pad, f"_{a}1": F.col(f"_{a}1") + pad})
    grid = ends.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    at = {a: F.col(f"_{a}0") + F.col(i) * (F.col(f"_{a}1") - F.col(f"_{a}0")) / (n - 1) for a, i, n in (("u", "r", rows), ("v", "c", cols))}
    grid = grid.select(*keys, "r", "c", at["u"].alias("u"), at["v"].alias("v"))
    sites = points.select(*keys, "u", "v", "point_id")
    hit = nearest(grid, sites, keys, cut, ["u", "v"], "point_id")
    return grid.join(hit, [*keys, "u", "v"], "left")


def complete(df: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """All cells of every raster; cells without data have a null ``z``."""
    lattice = df.select(*keys).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return lattice.join(df.select(*keys, "r", "c", "z"), [*keys, "r", "c"], "left")


def _kernel_matrix(n: int, sigma: float) -> np.ndarray:
    """Weight with which position ``i`` enters position ``j`` under reflected edges."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    out = np.zeros((n, n))
    for j in range(n):
        for k, w in enumerate(kernel):
            p = (j + k - radius) % (2 * n)
            out[2 * n - 1 - p if p >= n else p, j] += w
    return out


def smooth(df: DataFrame, keys: list[str], rows: int, cols: int, sigma: float = 4.0) -> DataFrame:
    """All cells with the Gaussian mean of the known ones around.

    The two one-dimensional passes are products with the kernel's band matrices, one raster at a time, which its
    resolution bounds; a known cell is shuffled once, whatever the kernel's width.
    """
    down, across = _kernel_matrix(rows, sigma), _kernel_matrix(cols, sigma)
    r, c = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij"))

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        z = np.full((rows, cols), np.nan)
        known = g[g["z"].notna()]
        z[known["r"].to_numpy(), known["c"].to_numpy()] = known["z"].to_numpy()
        held = ~np.isnan(z)
        weight = down.T @ held @ across
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(weight > 0, down.T @ np.where(held, z, 0.0) @ across / weight, np.nan)
        out = pd.DataFrame({k: [g[k].iloc[0]] * len(r) for k in keys})
        out["r"], out["c"] = r, c
        for name, cells in (("z", z), ("smooth", mean)):
            out[name] = pd.array(cells.ravel(), dtype="Float64")
            out.loc[np.isnan(cells.ravel()), name] = pd.NA
        return out

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    cells = df.select(*keys, "r", "c", F.col("z").cast("double").alias("z"))
    return cells.groupBy(*keys).applyInPandas(whole, f"{kinds}r int, c int, z double, smooth double")


def _stencil(df: DataFrame, keys: list[str], values: dict[str, Column], made) -> DataFrame:
    """Adds the columns that ``made(line, above, below, i)`` gives for each cell of a whole raster, a line at a time.

    ``values`` are columns that the stencil reads beside those of ``df``; lines know their neighbours by one window over lines.
    """
    kept = [c for c in df.columns if c not in (*keys, "r", "c")]
    entry = F.struct("c", *kept, *[v.alias(n) for n, v in values.items()])
    lines = df.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(entry)).alias("_l"))  # a line has as many cells as the raster is wide
    order = W.partitionBy(*keys).orderBy("r")
    lines = lines.withColumns({"_up": F.lag("_l").over(order), "_down": F.lead("_l").over(order)})
    cells = F.transform("_l", lambda x, i: F.struct(x["c"].alias("c"), *[x[k].alias(k) for k in kept], *made(F.col("_l"), F.col("_up"), F.col("_down"), i)))
    return lines.select(*keys, "r", F.inline(cells))


def _beside(keys: list[str], column: Column, axis: str, step: int) -> Column:
    over = W.partitionBy(*keys, "c" if axis == "r" else "r").orderBy(axis)  # one line of the raster
    return F.lag(column, -step).over(over)


def laplacian(df: DataFrame, keys: list[str]) -> DataFrame:
    """Five-point Laplacian of ``smooth`` at the known cells of a whole raster, edges repeated."""
    def made(line, up, down, i):
        s = F.get(line, i)["smooth"]
        around = [F.coalesce(F.get(a, n)["smooth"], s) for a, n in ((up, i), (down, i), (line, i - 1), (line, i + 1))]
        return [F.when(F.get(line, i)["z"].isNotNull(), sum(around[1:], around[0]) - s * 4).alias("laplacian")]

    return _stencil(df, keys, {}, made)


def gradient(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gradient magnitude of ``smooth`` over a whole raster with unknown cells taken as 0; one-sided at the edges."""
    def made(line, up, down, i):
        s = F.get(line, i)["_s"]

        def slope(before, after):
            lo, hi = before["_s"], after["_s"]
            return F.when(lo.isNull(), hi - s).when(hi.isNull(), s - lo).otherwise((hi - lo) / 2)

        parts = [slope(F.get(up, i), F.get(down, i)), slope(F.get(line, i - 1), F.get(line, i + 1))]
        return [F.when(F.get(line, i)["z"].isNotNull(), F.sqrt(parts[0] * parts[0] + parts[1] * parts[1])).alias("gradient")]

    return _stencil(df, keys, {"_s": F.when(F.col("z").isNotNull(), F.col("smooth")).otherwise(0.0)}, made)


def peaks(df: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Cell of the largest value, the first in row order among equals."""
    best = F.max_by(F.struct("r", "c"), F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col("r"), -F.col("c"))))
    return df.groupBy(*keys).agg(best.alias("_b"), F.max(value).alias("peak_value")).select(
        *keys, F.col("_b.r").alias("peak_r"), F.col("_b.c").alias("peak_c"), "peak_value")


def inner_peaks(df: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Peaks that keep two cells distance from the border."""
    p = peaks(df, keys)
    return p.filter(F.col("peak_r").between(BORDER, rows - 1 - BORDER) & F.col("peak_c").between(BORDER, cols - 1 - BORDER))


# --- contours --------------------------------------------------------------------------

# Contour pieces of a 2x2 square by its inside corners (upper left 1, upper
# right 2, lower left 4, lower right 8); sides are Top, Left, Right, Bottom.
SQUARE_PIECES = {1: ["TL"], 2: ["TR"], 3: ["LR"], 4: ["LB"], 5: ["TB"], 6: ["TR", "LB"], 7: ["RB"], 8: ["RB"],
                 9: ["TL", "RB"], 10: ["TB"], 11: ["LB"], 12: ["LR"], 13: ["TR"], 14: ["TL"]}


def trace_outline(mask: np.ndarray) -> np.ndarray:
    """Longest outline of a 0/1 mask, half way between its inside and outside cells."""
    m = mask.astype(int)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
    links: dict[tuple, list] = {}
    for r, c in zip(*np.nonzero((code > 0) & (code < 15))):
        side = {"T": (r, c + 0.5), "B": (r + 1, c + 0.5), "L": (r + 0.5, c), "R": (r + 0.5, c + 1)}
        for a, b in SQUARE_PIECES[int(code[r, c])]:
            links.setdefault(side[a], []).append(side[b])
            links.setdefault(side[b], []).append(side[a])
    best: list[tuple] = []
    ends = [p for p, n in links.items() if len(n) == 1]
    for start in [*ends, *links]:
        if not links.get(start):
            continue
        path = [start]
        while links[path[-1]]:
            nxt = links[path[-1]].pop()
            links[nxt].remove(path[-1])
            path.append(nxt)
        best = max(best, path, key=len)
    return np.array(best, dtype=float).reshape(-1, 2)


def basin_of_peak(negative: np.ndarray, peak: tuple[int, int]) -> np.ndarray:
    """Cells reached from the peak through its four-neighbours inside the mask."""
    reached = np.zeros_like(negative)
    reached[peak] = negative[peak]
    while True:
        grown = reached.copy()
        grown[1:] |= reached[:-1]
        grown[:-1] |= reached[1:]
        grown[:, 1:] |= reached[:, :-1]
        grown[:, :-1] |= reached[:, 1:]
        grown &= negative
        if (grown == reached).all():
            return reached
        reached = grown


def inflection_contours(df: DataFrame, keys: list[str], rows: int, cols: int, sigma: float = 4.0) -> DataFrame:
    """Outline of the negative-Laplacian basin around the peak, in cell coordinates.

    Rasters with a peak at the border, a flat Laplacian or a peak outside any basin have
    no row.  Each group is one raster of rows x cols cells.
    """
    lap = laplacian(smooth(df, keys, rows, cols, sigma), keys)
    # One pass over the derivative: its range, and only the cells that can be part of a basin.
    held = lap.groupBy(*keys).agg((F.max("laplacian") - F.min("laplacian")).alias("_ptp"),
                                  F.collect_list(F.when(F.col("laplacian") < 0, F.struct("r", "c"))).alias("_cells"))
    fit = held.filter(F.col("_ptp") >= 1e-12).join(inner_peaks(df, keys, rows, cols), keys).select(*keys, "_cells", "peak_r", "peak_c")
    point = T.ArrayType(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("c", T.DoubleType())]))
    schema = T.StructType([*[f for f in fit.schema.fields if f.name in keys], T.StructField("contour", point),
                           T.StructField("basin_cells", T.LongType())])

    def outlines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for i in range(len(frame)):
                negative = np.zeros((rows, cols), dtype=bool)
                cells = frame["_cells"].iloc[i]
                negative[[x["r"] for x in cells], [x["c"] for x in cells]] = True
                basin = basin_of_peak(negative, (int(frame["peak_r"].iloc[i]), int(frame["peak_c"].iloc[i])))
                path = trace_outline(basin) if basin.any() else np.empty((0, 2))
                if len(path) >= 4:
                    found.append((i, [{"r": r, "c": c} for r, c in path.tolist()], int(basin.sum())))
            out = frame[keys].iloc[[i for i, _, _ in found]].copy()
            out["contour"], out["basin_cells"] = pd.Series([p for _, p, _ in found], index=out.index, dtype=object), [n for _, _, n in found]
            yield out

    return fit.mapInPandas(outlines, schema)


def bounds(df: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Origin and cell size of each raster, from any two known rows and columns."""
    ends = df.groupBy(*keys).agg(*[f(x).alias(f"_{x}{n}") for x in ("r", "c", "u", "v") for n, f in (("0", F.min), ("1", F.max))])
    def step(a, i):
        return F.coalesce(F.try_divide(F.col(f"_{a}1") - F.col(f"_{a}0"), F.col(f"_{i}1") - F.col(f"_{i}0")), F.lit(1.0))
    return ends.select(*keys, (F.col("_u0") - F.col("_r0") * step("u", "r")).alias("u0"), step("u", "r").alias("du"),
                       (F.col("_v0") - F.col("_c0") * step("v", "c")).alias("v0"), step("v", "c").alias("dv"))


def contour_uv(contours: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """Contours in UV coordinates."""
    moved = F.transform("contour", lambda p: F.struct((F.col("u0") + p.r * F.col("du")).alias("u"), (F.col("v0") + p.c * F.col("dv")).alias("v")))
    return contours.join(frame, keys).withColumn("contour_rc", F.col("contour")).withColumn("contour", moved).drop("u0", "du", "v0", "dv")


def contour_edges(contours: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edge of each closed contour."""
    nxt = F.transform("contour", lambda p, i: F.struct(
        i.alias("i"), p.u.alias("u1"), p.v.alias("v1"),
        F.get("contour", F.pmod(i + 1, F.size("contour"))).u.alias("u2"), F.get("contour", F.pmod(i + 1, F.size("contour"))).v.alias("v2")))
    return contours.select(*keys, F.inline(nxt))


def polygon_metrics(contours: DataFrame, keys: list[str]) -> DataFrame:
    """Shoelace area, closed perimeter, area centroid, circularity and main axes."""
    cross = F.col("u1") * F.col("v2") - F.col("u2") * F.col("v1")
    e = contour_edges(contours, keys).groupBy(*keys).agg(
        F.count("*").alias("n_points"), (F.sum(cross) / 2).alias("_a"),
        F.sum(C.distance(["u1", "v1"], ["u2", "v2"])).alias("perimeter"),
        F.sum((F.col("u1") + F.col("u2")) * cross).alias("_su"), F.sum((F.col("v1") + F.col("v2")) * cross).alias("_sv"),
        F.avg("u1").alias("_mu"), F.avg("v1").alias("_mv"),
        F.covar_pop("u1", "u1").alias("_uu"), F.covar_pop("u1", "v1").alias("_uv"), F.covar_pop("v1", "v1").alias("_vv"))
    thin = F.abs("_a") < 1e-12
    eig = C.eigen_2x2("_uu", "_uv", "_vv")
    area = F.abs("_a")
    return e.select(
        *keys, "n_points", area.alias("area"), "perimeter",
        F.when(F.col("perimeter") > 0, area * 4 * math.pi / (F.col("perimeter") * F.col("perimeter"))).alias("circularity"),
        F.when(thin, F.col("_mu")).otherwise(F.col("_su") / (F.col("_a") * 6)).alias("centroid_u"),
        F.when(thin, F.col("_mv")).otherwise(F.col("_sv") / (F.col("_a") * 6)).alias("centroid_v"),
        (F.sqrt(F.greatest(eig["l1"], F.lit(0.0))) * 2).alias("pca_major"), (F.sqrt(F.greatest(eig["l2"], F.lit(0.0))) * 2).alias("pca_minor"),
        F.degrees(eig["angle"]).alias("pca_orientation_deg"))


def _quads(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each cell with the values of its right, lower and diagonal neighbours."""
    z = F.col(value)
    df = df.withColumn("_right", F.coalesce(_beside(keys, z, "c", 1), z))
    for name, col in (("_down", z), ("_diag", F.col("_right"))):
        df = df.withColumn(name, F.coalesce(_beside(keys, col, "r", 1), col))
    return df.select(*keys, F.col("r").alias("_r0"), F.col("c").alias("_c0"), z.alias("_z"), "_right", "_down", "_diag")


def sample(points: DataFrame, raster: DataFrame, keys: list[str], rows: int, cols: int, value: str = "z",
           fill_mean: bool = True) -> DataFrame:
    """Bilinear value at fractional (row, column) points; unknown cells count as the raster mean."""
    whole = complete(raster.select(*keys, "r", "c", F.col(value).alias("z")), keys, rows, cols)
    mean = raster.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    filled = whole.join(mean, keys).withColumn("_zf", F.coalesce("z", "_mean" if fill_mean else F.lit(0.0)))
    pr = F.greatest(F.lit(0.0), F.least(F.col("row"), F.lit(float(rows - 1))))
    pc = F.greatest(F.lit(0.0), F.least(F.col("col"), F.lit(float(cols - 1))))
    placed = points.withColumns({"_r0": F.floor(pr).cast("int"), "_c0": F.floor(pc).cast("int"), "_fr": pr - F.floor(pr), "_fc": pc - F.floor(pc)})
    hit = placed.join(_quads(filled, keys, "_zf"), [*keys, "_r0", "_c0"])
    fr, fc = F.col("_fr"), F.col("_fc")
    value_at = (F.col("_z") * (1 - fr) * (1 - fc) + F.col("_right") * (1 - fr) * fc + F.col("_down") * fr * (1 - fc) + F.col("_diag") * fr * fc)
    return hit.withColumn("sampled", value_at).drop("_r0", "_c0", "_fr", "_fc", "_z", "_right", "_down", "_diag")


def savgol_weights(window: int = 31, order: int = 3) -> list[float]:
    """Weights of the centre value of a least-squares polynomial over the window."""
    x = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


def ridge_radii(df: DataFrame, keys: list[str], rows: int, cols: int, n_angles: int = 360) -> DataFrame:
    """Along rays from the peak, the first radius with the largest gradient (1 where flat)."""
    longest = math.ceil(math.hypot(rows, cols))
    grad = gradient(df, keys)
    rays = inner_peaks(df, keys, rows, cols).withColumn("angle_index", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1)))).withColumn(
        "angle", F.col("angle_index") * (2 * math.pi / n_angles))
    steps = rays.withColumn("radius", F.explode(F.sequence(F.lit(1), F.lit(longest - 1)))).withColumns({
        "row": F.col("peak_r") + F.col("radius") * F.cos("angle"), "col": F.col("peak_c") + F.col("radius") * F.sin("angle")})
    inside = (F.col("row") >= 0) & (F.col("row") < rows - 1) & (F.col("col") >= 0) & (F.col("col") < cols - 1)
    seen = sample(steps.filter(inside), grad, keys, rows, cols, "gradient", fill_mean=False)
    best = seen.groupBy(*keys, "angle_index").agg(
        F.max(F.struct(F.round("sampled", 12).alias("s"), (-F.col("radius")).alias("n"))).alias("_b"))
    radius = F.when(F.col("_b.s") >= 1e-12, -F.col("_b.n")).otherwise(1)
    return rays.join(best, [*keys, "angle_index"], "left").select(
        *keys, "peak_r", "peak_c", "angle_index", "angle", F.coalesce(radius, F.lit(1)).cast("double").alias("radius"))


def smooth_circle(df: DataFrame, keys: list[str], n_angles: int = 360, window: int = 31, order: int = 3) -> DataFrame:
    """Savitzky-Golay smoothing of the radii around the circle."""
    half = window // 2
    weights = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(savgol_weights(window, order))])
    sent = df.select(*keys, "angle_index", "radius", F.inline(weights)).groupBy(
        *keys, F.pmod(F.col("angle_index") - F.col("d"), F.lit(n_angles)).alias("angle_index")).agg(
        F.sum(F.col("radius") * F.col("w")).alias("smooth_radius"))
    return df.join(sent, [*keys, "angle_index"])


def gradient_contours(df: DataFrame, keys: list[str], rows: int, cols: int, sigma: float = 4.0, n_angles: int = 360,
                      window: int | None = 31) -> DataFrame:
    """Closed ridge of the gradient around the peak, in cell coordinates; none where flat."""
    radii = ridge_radii(smooth(df, keys, rows, cols, sigma), keys, rows, cols, n_angles)
    if window is None or n_angles < window:
        radii = radii.withColumn("smooth_radius", F.col("radius"))
    else:
        radii = smooth_circle(radii, keys, n_angles, window)
    point = F.struct("angle_index", (F.col("peak_r") + F.col("smooth_radius") * F.cos("angle")).alias("r"),
                     (F.col("peak_c") + F.col("smooth_radius") * F.sin("angle")).alias("c"))
    # One entry per ray: n_angles points per raster.
    rings = radii.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_p"), F.max("smooth_radius").alias("_max")).filter("_max > 1.0")
    return rings.select(*keys, F.transform("_p", lambda p: F.struct(p.r.alias("r"), p.c.alias("c"))).alias("contour"))


def boundary_metrics(contours: DataFrame, raster: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Polygon metrics of cell-coordinate contours with peak, mean on the contour and value at the centroid."""
    frame = bounds(raster, keys, rows, cols)
    uv = contour_uv(contours, frame, keys)
    poly = polygon_metrics(uv, keys).join(frame, keys)
    line = contours.select(*keys, F.inline(F.transform("contour", lambda p: F.struct(p.r.alias("row"), p.c.alias("col")))))
    on = sample(line, raster, keys, rows, cols).groupBy(*keys).agg(F.avg("sampled").alias("mean_iff_on_contour"))
    middle = poly.select(*keys, ((F.col("centroid_u") - F.col("u0")) / F.col("du")).alias("row"), ((F.col("centroid_v") - F.col("v0")) / F.col("dv")).alias("col"))
    at = sample(middle, raster, keys, rows, cols).select(*keys, F.col("sampled").alias("iff_at_centroid"))
    p = peaks(raster, keys)
    out = poly.join(on, keys).join(at, keys).join(p, keys)
    return out.withColumns({"peak_u": F.col("u0") + F.col("peak_r") * F.col("du"), "peak_v": F.col("v0") + F.col("peak_c") * F.col("dv")}).drop(
        "u0", "du", "v0", "dv", "peak_r", "peak_c").join(uv.select(*keys, "contour"), keys)


BOUNDARIES = {"inflection": inflection_contours, "gradient": gradient_contours}


def boundaries(raster: DataFrame, keys: list[str], rows: int, cols: int, method: str = "inflection", sigma: float = 4.0) -> DataFrame:
    if method not in BOUNDARIES:
        raise ValueError(f"unknown boundary method {method!r}; known: {sorted(BOUNDARIES)}")
    raster = cut_lineage(raster)  # read by every step below
    contours = cut_lineage(BOUNDARIES[method](raster, keys, rows, cols, sigma))
    return boundary_metrics(contours, raster, keys, rows, cols)


# --- profiles and comparisons ----------------------------------------------------------


def _below(sorted_values: Column, value: Column) -> Column:
    """How many entries of a sorted array lie below ``value``, by halving; arrays of up to 2^20 entries."""
    steps = F.array(*[F.lit(1 << i) for i in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_values, at + step - 1) < value, at + step).otherwise(at))


def line_crossings(contours: DataFrame, lines: DataFrame, keys: list[str], along: str = "u") -> DataFrame:
    """(keys, line, at): where each edge of the contours meets the scan lines that it spans.

    The lines of a key are those of a raster, as many as its resolution has; an edge looks up
    its first and last one and is exploded onto those between, the upper end left out.
    """
    other = "v" if along == "u" else "u"
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_set("line")).alias("_lines"))
    lo, hi = F.least(f"{other}1", f"{other}2"), F.greatest(f"{other}1", f"{other}2")
    e = contour_edges(contours, keys).join(held, keys)
    e = e.withColumns({"_from": _below(F.col("_lines"), lo), "_to": _below(F.col("_lines"), hi)}).filter("_to > _from")
    e = e.withColumn("line", F.explode(F.slice("_lines", F.col("_from") + 1, F.col("_to") - F.col("_from"))))
    at = F.col(f"{along}1") + (F.col("line") - F.col(f"{other}1")) * (F.col(f"{along}2") - F.col(f"{along}1")) / (F.col(f"{other}2") - F.col(f"{other}1"))
    return e.select(*keys, "line", at.alias("at"))


def crossings(contours: DataFrame, lines: DataFrame, keys: list[str], along: str = "u") -> DataFrame:
    """Sorted intercepts of closed contours with scan lines of constant v (or u)."""
    return line_crossings(contours, lines, keys, along).groupBy(*keys, "line").agg(F.array_sort(F.collect_list("at")).alias("crossings"))


def profiles(raster: DataFrame, contours: DataFrame, keys: list[str]) -> DataFrame:
    """Per grid column: known cells, maximum, mean, first and last boundary crossing and width."""
    cols = raster.groupBy(*keys, "c", F.col("v").alias("line")).agg(
        F.count("z").alias("n_valid"), F.max("z").alias("profile_max"), F.avg("z").alias("profile_mean"))
    x = crossings(contours, cols.select(*keys, "line").distinct(), keys)
    n = F.coalesce(F.size("crossings"), F.lit(0))
    first, last = F.get("crossings", F.lit(0)), F.get("crossings", F.size("crossings") - 1)
    return cols.join(x, [*keys, "line"], "left").withColumn("crossings", F.coalesce("crossings", F.array().cast("array<double>"))).withColumns({
        "n_crossings": n, "boundary_left": first, "boundary_right": last, "boundary_width": F.when(n >= 2, last - first)})


def nearest_line(raster: DataFrame, keys: list[str], axis: str, center: str) -> DataFrame:
    """Index of the grid line nearest to the ``center`` column."""
    i = "c" if axis == "v" else "r"
    return raster.groupBy(*keys).agg(F.min_by(i, F.struct(F.abs(F.col(axis) - F.col(center)), F.col(i))).alias("line_index"))


def inside_polygon(cells: DataFrame, contours: DataFrame, keys: list[str]) -> DataFrame:
    """Cells inside the contour of their key, by scan-line parity.

    Cells and crossings of a line are put in one order; a cell is inside if the running count of
    the crossings to its right is odd. Cells meet crossings of their own line alone, never edges.
    """
    at = line_crossings(contours, cells.select(*keys, F.col("v").alias("line")), keys)
    marks = at.select(*keys, F.col("line").alias("v"), F.col("at").alias("u"), F.lit(1).alias("_crossing"))
    both = cells.withColumn("_crossing", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # A crossing at the cell itself doesn't lie to its right, so cells come first among equals.
    right = W.partitionBy(*keys, "v").orderBy(F.desc("u"), "_crossing").rowsBetween(W.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.sum("_crossing").over(right))
    return counted.filter("_crossing = 0 AND _n % 2 = 1").select(*cells.columns)


def mask_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """IoU and Dice of two sets of cells (keys, r, c); 0 where both are empty."""
    both = a.select(*keys, "r", "c").distinct().withColumn("_a", F.lit(1)).join(
        b.select(*keys, "r", "c").distinct().withColumn("_b", F.lit(1)), [*keys, "r", "c"], "full_outer")
    n = both.groupBy(*keys).agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.count("*").alias("_u"), F.count_if(
        F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_i"))
    return n.select(*keys, F.coalesce(F.try_divide("_i", "_u"), F.lit(0.0)).alias("iou"),
                    F.coalesce(F.try_divide(F.col("_i") * 2, F.col("_na") + F.col("_nb")), F.lit(0.0)).alias("dice"),
                    F.try_divide("_i", "_na").alias("containment_a"), F.try_divide("_i", "_nb").alias("containment_b"))


def map_similarity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson r over cells known in both rasters; null below 3 cells or without variance."""
    both = a.select(*keys, "r", "c", F.col("z").alias("za")).join(b.select(*keys, "r", "c", F.col("z").alias("zb")), [*keys, "r", "c"])
    both = both.filter(F.col("za").isNotNull() & F.col("zb").isNotNull())
    n = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("za", "zb").alias("_r"), F.stddev_pop("za").alias("_sa"), F.stddev_pop("zb").alias("_sb"))
    return n.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_r")).alias("pearson_r"))


def highest_center(raster: DataFrame, keys: list[str], levels: int = 6) -> DataFrame:
    """Mean position of the cells at or above the highest of the inner contour levels."""
    ends = raster.groupBy(*keys).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi")).filter("_lo < _hi")
    level = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * levels / (levels + 1)
    return raster.join(ends, keys).filter(F.col("z") >= level).groupBy(*keys).agg(F.avg("u").alias("center_u"), F.avg("v").alias("center_v"))


PAIR_COLUMNS = ["area", "perimeter", "circularity", "aspect_ratio", "mean_iff_on_contour", "peak_to_centroid", "peak_value",
                "equivalent_diameter", "sharpness", "iff_at_centroid"]


def with_derived(b: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Boundary metrics scaled to mm with aspect ratio, diameter, sharpness and peak distance."""
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    b = b.withColumns({"area": F.col("area") * s * s, "perimeter": F.col("perimeter") * s,
                       "pca_major": F.col("pca_major") * s, "pca_minor": F.col("pca_minor") * s})
    return b.withColumns({
        "aspect_ratio": F.when(F.col("pca_minor") != 0, F.col("pca_major") / F.col("pca_minor")),
        "peak_to_centroid": C.distance(["peak_u", "peak_v"], ["centroid_u", "centroid_v"]) * s,
        "equivalent_diameter": F.when(F.col("area") > 0, F.sqrt(F.col("area") * 4 / math.pi)),
        "sharpness": F.when(F.col("mean_iff_on_contour") > 0, F.col("peak_value") / F.col("mean_iff_on_contour")),
    })


def compare_pair(b: DataFrame, key: str, subset: str, first: str, second: str, hotspot_reference: str = "all",
                 area_reference: str = "all", scale: float = 1.0) -> DataFrame:
    """Deltas (first minus second), shifts and offsets of two gestures of each session.

    Sessions need a boundary for both gestures and the whole.  ``b`` holds boundary metrics per
    session and subset as made by ``with_derived``.
    """
    cols = [*PAIR_COLUMNS, "pca_orientation_deg", "centroid_u", "centroid_v", "peak_u", "peak_v"]
    sides = {"a": first, "b": second, "all": "all", "hot": hotspot_reference, "ref": area_reference}
    present = [F.count_if(F.col(subset) == sides[m]).alias(f"_has_{m}") for m in ("a", "b", "all")]
    w = b.groupBy(key).agg(*present, *[
        F.max(F.when(F.col(subset) == name, F.col(c))).alias(f"{c}_{m}") for m, name in sides.items() for c in cols
    ]).filter("_has_a > 0 AND _has_b > 0 AND _has_all > 0")
    out = {f"delta_{c}": F.col(f"{c}_a") - F.col(f"{c}_b") for c in PAIR_COLUMNS}
    out["area_ratio"] = C.safe_ratio("area_a", "area_b")
    out["delta_area_pct"] = F.when(F.col("area_ref") > 0, (F.col("area_a") - F.col("area_b")) / F.col("area_ref") * 100)
    out["delta_orientation_deg"] = C.wrap_angle(F.col("pca_orientation_deg_a") - F.col("pca_orientation_deg_b"))
    out["centroid_distance"] = C.distance(["centroid_u_a", "centroid_v_a"], ["centroid_u_b", "centroid_v_b"]) * scale
    out["hotspot_distance"] = C.distance(["peak_u_a", "peak_v_a"], ["peak_u_b", "peak_v_b"]) * scale
    out["centroid_hotspot_distance"] = C.distance(["centroid_u_all", "centroid_v_all"], ["peak_u_hot", "peak_v_hot"]) * scale
    # Shifts split along the arm (u) and across it (v).
    for kind in ("centroid", "peak"):
        for part, x in (("along", "u"), ("across", "v")):
            out[f"{kind}_shift_{part}"] = (F.col(f"{kind}_{x}_a") - F.col(f"{kind}_{x}_b")) * scale
    for m in "ab":
        for x in "uv":
            out[f"offset_{x}_{m}"] = (F.col(f"centroid_{x}_{m}") - F.col(f"centroid_{x}_all")) * scale
            out[f"hotspot_offset_{x}_{m}"] = (F.col(f"peak_{x}_{m}") - F.col(f"peak_{x}_hot")) * scale
    return w.select(key, *[c.alias(n) for n, c in out.items()])


def compare_maps(raster: DataFrame, contours: DataFrame, key: str, subset: str, first: str, second: str, rows: int, cols: int,
                 scale: float = 1.0) -> DataFrame:
    """Overlap of two gestures' outlines on the first one's lattice, correlation of their maps, and the
    shift of their highest levels' centres with the offsets from that of the whole map."""
    def of(df, name):
        return df.filter(F.col(subset) == name).drop(subset)

    by = [key]
    own = of(raster, first)
    frame = bounds(own, by, rows, cols)
    lattice = complete(own, by, rows, cols).join(frame, by).select(
        key, "r", "c", (F.col("u0") + F.col("r") * F.col("du")).alias("u"), (F.col("v0") + F.col("c") * F.col("dv")).alias("v"))
    masks = [inside_polygon(lattice, of(contours, name), by) for name in (first, second)]
    both = of(contours, first).select(key).join(of(contours, second).select(key), by).distinct()
    overlap = mask_overlap(*masks, by).join(both, by, "right").na.fill(0.0, ["iou", "dice"])
    similar = map_similarity(own, of(raster, second), by).drop("n")
    centers = [highest_center(of(raster, name), by).select(key, *[F.col(f"center_{x}").alias(f"_{x}{m}") for x in "uv"])
               for m, name in (("a", first), ("b", second), ("all", "all"))]
    placed = centers[0].join(centers[1], by).join(centers[2], by, "left")
    shifts = placed.select(
        key, *[((F.col(f"_{x}a") - F.col(f"_{x}b")) * scale).alias(f"contour_center_shift_{part}") for part, x in (("along", "u"), ("across", "v"))],
        *[((F.col(f"_{x}{m}") - F.col(f"_{x}all")) * scale).alias(f"contour_center_offset_{x}_{m}") for m in "ab" for x in "uv"])
    return overlap.join(similar, by, "full_outer").join(shifts, by, "full_outer")


def _with_maps(out: DataFrame, raster: DataFrame | None, b: DataFrame, key: str, subset: str, first: str, second: str, size: tuple[int, int] | None,
               scale: float) -> DataFrame:
    if raster is None:
        return out
    return out.join(compare_maps(raster, b.select(key, subset, "contour"), key, subset, first, second, *size, scale), key, "left")


def tap_stroke(b: DataFrame, key: str = "session_id", subset: str = "subset", scale: float = 1.0, raster: DataFrame | None = None,
               size: tuple[int, int] | None = None) -> DataFrame:
    """Tap against stroke; with the rasters (and their size) also overlaps, correlation and contour centres."""
    return _with_maps(compare_pair(b, key, subset, "tap", "stroke", scale=scale), raster, b, key, subset, "tap", "stroke", size, scale)


def proximal_distal(b: DataFrame, key: str = "session_id", subset: str = "subset", scale: float = 1.0, raster: DataFrame | None = None,
                    size: tuple[int, int] | None = None) -> DataFrame:
    out = compare_pair(b, key, subset, "stroke_proximal", "stroke_distal", "stroke", "stroke", scale)
    return _with_maps(out, raster, b, key, subset, "stroke_proximal", "stroke_distal", size, scale)


def centroid_shifts(b: DataFrame, key: str, subset: str, axes: list[str]) -> DataFrame:
    """Distance of tap to stroke and proximal to distal centroids, on every row of the session."""
    def at(name, mark):
        return [F.max(F.when(F.col(subset) == name, F.col(a))).alias(f"_{mark}{i}") for i, a in enumerate(axes)]
    per = b.groupBy(key).agg(*at("tap", "t"), *at("stroke", "s"), *at("stroke_proximal", "p"), *at("stroke_distal", "d"))
    n = range(len(axes))
    per = per.select(key, C.distance([f"_t{i}" for i in n], [f"_s{i}" for i in n]).alias("centroid_shift_tap_vs_stroke"),
                     C.distance([f"_p{i}" for i in n], [f"_d{i}" for i in n]).alias("centroid_shift_proximal_vs_distal"))
    return b.join(per, key)
