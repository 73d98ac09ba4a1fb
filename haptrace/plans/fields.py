"""Response-field plans: from per-touch maps to rasters and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.functions import columns as C
from haptrace.operators import metrics as M
from haptrace.operators import raster as R
from haptrace.operators import surface as S
from haptrace.operators.tuning import _in_windows
from haptrace.schema import KEYS
from haptrace.session import cut_lineage


def response_fields(rf: DataFrame, contacts: DataFrame, uv: DataFrame, percent: float, rows: int = 150, cols: int = 150,
                    method: str = "inflection", sigma: float = 4.0, align: bool = True) -> dict[str, DataFrame]:
    """Heat maps, aligned rasters and boundaries of every session and gesture subset."""
    by = ["session_id", "subset"]
    heat = S.thresholded_heatmap(S.subset_exploded(rf), S.subset_exploded(contacts), by, percent)
    placed = heat.filter("marked >= 0").join(uv, "vertex_id")
    if align:
        a = M.pca_alignment(placed.filter("subset = 'all'"), ["session_id"], "marked")
        u, v = C.align_uv("u", "v", "center_u", "center_v", [[F.col("major_u"), F.col("major_v")], [F.col("minor_u"), F.col("minor_v")]])
        placed = placed.join(a, "session_id").withColumns({"_u": u, "_v": v}).withColumns({"u": F.col("_u"), "v": F.col("_v")})
    grid = R.rasterise(placed, by, "marked", rows, cols)
    return {"heatmap": heat, "raster": grid, "boundary": R.boundaries(grid, by, rows, cols, method, sigma)}


def spatial_tuning(rf: DataFrame, touches: DataFrame, uv: DataFrame, feature: str, windows: list[tuple[float, float]],
                   percent: float, rows: int = 150, cols: int = 150, method: str = "inflection", sigma: float = 4.0,
                   per_touch: bool = False) -> DataFrame:
    """Boundary area, circularity, aspect and orientation per session, subset and feature bin.

    All rasters of all bins go through one grouped pass; with ``per_touch`` the sample
    deviation over single-touch boundaries is added where two or more exist.
    """
    by = ["session_id", "subset", "bin"]
    binned = touches.withColumn("bin", F.explode(_in_windows(feature, windows))).withColumn(
        "subset", F.explode(C.subset_members("gesture_type"))).select(*KEYS, "subset", "bin")
    n = binned.groupBy(*by).agg(F.count("*").alias("n_touches"))
    maps = binned.join(rf.select(*KEYS, "vertex_id", "rf_mean"), KEYS)

    def measured(rows_, keys):
        grid = R.rasterise(rows_.join(uv, "vertex_id"), keys, "value", rows, cols)
        return R.with_derived(R.boundaries(grid, keys, rows, cols, method, sigma))

    heat = maps.groupBy(*by, "vertex_id").agg(F.avg("rf_mean").alias("value"), F.count("*").alias("n_unique")).join(n, by)
    # Held, as rasters read it several times: each reader would sum all touches anew, and sums may differ in the last bit.
    heat = cut_lineage(heat.filter(F.col("n_unique") >= C.count_threshold(percent, "n_touches")).select(*by, "vertex_id", "value"))
    wanted = ["area", "circularity", "aspect_ratio", "pca_orientation_deg"]
    out = n.join(measured(heat, by).select(*by, *wanted), by, "left")
    if per_touch:
        each = measured(rf.select(*KEYS, "vertex_id", F.col("rf_mean").alias("value")), KEYS).select(*KEYS, *wanted)
        spread = binned.join(each, KEYS).groupBy(*by).agg(*[
            F.when(F.count(c) >= 2, F.stddev_samp(c)).alias(f"{c}_std") for c in wanted])
        out = out.join(spread, by, "left")
    return out
