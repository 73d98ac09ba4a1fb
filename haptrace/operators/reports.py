"""Quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from haptrace.operators.prepare import touch_rows
from haptrace.operators.quantiles import percentiles
from haptrace.schema import KEYS


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, 5th, 50th and 95th percentile and maximum of each feature."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))
    return percentiles(long, ["feature"], {"minimum": ("v", 0.0), "p05": ("v", 0.05), "p50": ("v", 0.5), "p95": ("v", 0.95), "maximum": ("v", 1.0)})


def stroke_report(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per stroke: net move and range of x, range of y, and gaps at the ends."""
    df = touch_rows(df, keys).filter("single_touch_id <> 0 AND type_metadata = 'stroke'")
    x, y, at = F.col("contact_location_x"), F.col("contact_location_y"), F.col("frame_idx")
    known = F.when(x.isNotNull(), at)
    return df.groupBy(*keys).agg(
        (F.max_by(x, known) - F.min_by(x, known)).alias("delta_x"), (F.max(x) - F.min(x)).alias("range_x"),
        (F.max(y) - F.min(y)).alias("range_y"), F.count(x).alias("n_known"), F.count("*").alias("n_frames"),
        (F.min(at) < F.min(known)).alias("gap_at_start"), (F.max(at) > F.max(known)).alias("gap_at_end"),
    )


def bounding_boxes(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def overlap_percent(a: DataFrame, b: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Share of the range of ``a`` on each axis that lies inside the range of ``b``."""
    left, right = bounding_boxes(a, keys, axes), bounding_boxes(b, keys, axes)
    right = right.select(*keys, *[F.col(f"{x}_{n}").alias(f"_{x}_{n}") for x in axes for n in ("min", "max")])
    both = left.join(right, keys) if keys else left.join(F.broadcast(right))  # one row without keys
    def share(x):
        lo, hi = F.greatest(f"{x}_min", f"_{x}_min"), F.least(f"{x}_max", f"_{x}_max")
        span = F.col(f"{x}_max") - F.col(f"{x}_min")
        return F.when(span > 0, F.greatest(hi - lo, F.lit(0.0)) / span * 100).otherwise(0.0)
    return both.select(*keys, *[share(x).alias(f"{x}_overlap") for x in axes])


def distance_report(df: DataFrame, keys: list[str], distance: str, cut: float = 15.0) -> DataFrame:
    """Distance percentiles and the share of points beyond the cut-off."""
    wanted = {f"p{int(p * 100)}": (distance, p) for p in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)}
    share = df.groupBy(*keys).agg(F.count(distance).alias("n"), (F.avg((F.col(distance) > cut).cast("double")) * 100).alias("percent_beyond"))
    stats = percentiles(df, keys, wanted)
    return stats.join(share, keys) if keys else stats.join(F.broadcast(share))


def worst_rows(points: DataFrame, keys: list[str], row: list[str], distance: str, axes: list[str], n: int = 10) -> DataFrame:
    """The ``n`` rows of each key with the farthest point: its distance, number of points and centroid.

    Points without a distance don't count. Ties go to the smallest row; ranks are cut before the shuffle.
    """
    per = points.filter(F.col(distance).isNotNull()).groupBy(*keys, *row).agg(
        F.max(distance).alias("max_distance"), F.count("*").alias("n_points"), *[F.avg(a).alias(f"centroid_{a}") for a in axes])
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("max_distance"), *row))
    return per.withColumn("rank", place).filter(F.col("rank") <= n)
