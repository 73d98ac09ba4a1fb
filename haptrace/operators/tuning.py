"""Response tuning: bins, categories, limits, smoothing and comparisons of sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from haptrace.functions import columns as C
from haptrace.operators import bins as B
from haptrace.operators.quantiles import percentiles
from haptrace.schema import KEYS

# Response metric names and where they come from.
RESPONSE_METRICS = {"iff_mean": "Nerve_freq_mean", "iff_max": "Nerve_freq_max", "spike_count_mean": "spike_count"}
MIN_ROWS = 5


def response_metric(name: str) -> str:
    if name not in RESPONSE_METRICS:
        raise ValueError(f"unknown response metric {name!r}; valid: {sorted(RESPONSE_METRICS)}")
    return RESPONSE_METRICS[name]


def _in_windows(x, windows: list[tuple[float, float]]):
    """Indices of the windows that hold the value; only the last one is closed above."""
    x = F.col(x) if isinstance(x, str) else x
    last = len(windows) - 1
    hits = [F.when((x >= lo) & ((x <= hi) if i == last else (x < hi)), F.lit(i)) for i, (lo, hi) in enumerate(windows)]
    return F.array_compact(F.array(*hits))


def bin_statistics(df: DataFrame, keys: list[str], feature: str, response: str, windows: list[tuple[float, float]],
                   category: str | None = None, levels: list[str] | None = None, agg: str = "mean") -> DataFrame:
    """Mean (with sample deviation) or sum of the response per window, empty ones kept."""
    if agg not in ("mean", "sum"):
        raise ValueError(f"unknown bin aggregation {agg!r}")
    rows = df.filter(F.col(feature).isNotNull() & F.col(response).isNotNull())
    placed = rows.withColumn("bin", F.explode(_in_windows(feature, windows)))
    value = F.avg(response) if agg == "mean" else F.sum(response)
    aggs = [value.alias("response"), F.count("*").alias("n")]
    if agg == "mean":
        aggs.append(F.when(F.count("*") >= 2, F.stddev_samp(response)).alias("std"))
    counted = [*(levels or [])] if category else []
    aggs += [F.count_if(F.col(category) == v).alias(f"n_{v}") for v in counted]
    cells = placed.groupBy(*keys, "bin").agg(*aggs)
    table = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit((lo + hi) / 2).alias("bin_center"), F.lit(lo).alias("bin_low"),
                               F.lit(hi).alias("bin_high")) for i, (lo, hi) in enumerate(windows)])
    frame = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).select(*keys, F.inline(table))
    out = frame.join(cells, [*keys, "bin"], "left").na.fill(0, ["n", *[f"n_{v}" for v in counted]])
    if agg == "sum":
        out = out.withColumn("std", F.lit(None).cast("double"))
    if counted:
        known = sum((F.col(f"n_{v}") for v in counted[1:]), F.col(f"n_{counted[0]}"))
        out = out.withColumn("n_unassigned", F.col("n") - known).withColumns(
            {f"share_{v}": F.when(F.col("n") > 0, F.col(f"n_{v}") / F.col("n")).otherwise(0.0) for v in counted})
    return out


def category_levels(df: DataFrame, category: str) -> DataFrame:
    """Distinct levels in numeric order where they parse as numbers, else by text."""
    level = F.col(category).cast("string")
    found = df.filter(level.isNotNull()).select(level.alias("level")).distinct()
    return found.select("level", F.col("level").try_cast("double").alias("number"))


def ordered_levels(df: DataFrame, category: str) -> list[str]:
    rows = category_levels(df, category).collect()  # one row per level of a designed category
    if all(r["number"] is not None for r in rows):
        return [r["level"] for r in sorted(rows, key=lambda r: (r["number"], r["level"]))]
    return sorted(r["level"] for r in rows)


def category_statistics(df: DataFrame, keys: list[str], category: str, response: str, levels: DataFrame | None = None) -> DataFrame:
    """Mean, deviation and count per level for every key, levels without rows kept."""
    df = df.withColumn("level", F.col(category).cast("string"))
    levels = (levels if levels is not None else category_levels(df, category)).select("level")
    cells = df.filter(F.col(response).isNotNull()).groupBy(*keys, "level").agg(
        F.avg(response).alias("response"), F.when(F.count("*") >= 2, F.stddev_samp(response)).alias("std"), F.count("*").alias("n"))
    # Keys times levels is the wanted report: one row per session and designed level.
    frame = df.select(*keys).distinct().join(levels.distinct(), how="cross") if keys else levels.distinct()
    return frame.join(cells, [*keys, "level"], "left").na.fill(0, ["n"])


def designed_metadata(features: DataFrame, frames: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Feature rows with the first known value of metadata columns; losing rows is an error."""
    meta = frames.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("frame_idx"))).alias(c) for c in columns])
    if not features.join(meta, keys, "left_anti").isEmpty():
        raise ValueError("some touches have no designed metadata")
    return features.join(meta, keys)


def tuning(df: DataFrame, features: list[str], response: str, n_bins: int, clip: float = 0.0, overlap: float = 0.0,
           min_rows: int = MIN_ROWS) -> DataFrame:
    """All features x sessions x gesture subsets in one grouped pass on pooled windows."""
    named = {}
    df = df.select("session_id", "gesture_type", response, *features)
    wanted = {f"{f}|{k}": (f, p) for f in features for k, p in (("lo", clip / 100), ("hi", 1 - clip / 100))}
    row = percentiles(df, [], wanted).first()
    for f in features:
        lo, hi = row[f"{f}|lo"], row[f"{f}|hi"]
        if lo is None or not lo < hi:
            raise ValueError(f"the range of {f!r} is empty or collapsed")
        named[f] = B.value_windows(lo, hi, n_bins, overlap)
    def window_structs(f):
        return F.transform(_in_windows(f, named[f]), lambda i: F.struct(F.lit(f).alias("feature"), i.alias("bin")))

    long = (
        df.filter(F.col(response).isNotNull())
        .withColumn("subset", F.explode(C.subset_members("gesture_type")))
        .select("session_id", "subset", response, F.inline(F.flatten(F.array(*[window_structs(f) for f in features]))))
    )
    sizes = df.filter(F.col(response).isNotNull()).withColumn("subset", F.explode(C.subset_members("gesture_type"))).groupBy(
        "session_id", "subset").agg(*[F.count(f).alias(f) for f in features])
    enough = sizes.select("session_id", "subset", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("n_rows")) for f in features]))).filter(F.col("n_rows") >= min_rows)
    stats = long.groupBy("session_id", "subset", "feature", "bin").agg(
        F.avg(response).alias("response"), F.stddev_samp(response).alias("std"), F.count("*").alias("n"))
    return stats.join(enough, ["session_id", "subset", "feature"])


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth_bins(df: DataFrame, keys: list[str], index: str, value: str, sigma: float, n_bins: int) -> DataFrame:
    """Kernel-weighted mean over known bins with reflected edges; needs two known bins.

    Every bin is sent to the bins its kernel reaches, so the work is bins x kernel width.
    """
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    # Position -1 is a copy of 0, -2 of 1, n of n - 1: fold the offsets back into the range.
    reach = F.array(*[F.struct(F.lit(i - radius).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)])
    folded = F.pmod(F.col(index) + F.col("d"), F.lit(2 * n_bins))
    source = F.when(folded >= n_bins, F.lit(2 * n_bins - 1) - folded).otherwise(folded)
    asked = df.select(*keys, index, F.inline(reach)).withColumn("_src", source)
    given = df.select(*keys, F.col(index).alias("_src"), F.col(value).alias("_v"))
    known = df.groupBy(*keys).agg(F.count(value).alias("_known"))
    sums = asked.join(given, [*keys, "_src"]).groupBy(*keys, index).agg(
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_v") * F.col("w"))).alias("_s"),
        F.sum(F.when(F.col("_v").isNotNull(), F.col("w"))).alias("_w"))
    out = df.join(sums, [*keys, index], "left")
    out = out.join(known, keys) if keys else out.join(F.broadcast(known))  # one row without keys
    return out.withColumn("smoothed", F.when(F.col("_known") < 2, F.col(value)).when(
        F.col("_w") > 0, F.col("_s") / F.col("_w"))).drop("_s", "_w", "_known")


def axis_limits(df: DataFrame, keys: list[str], column: str, top: float = 1.0, pad: float = 0.05) -> DataFrame:
    """Shared limits: minimum and a top percentile, padded by a part of the range."""
    stats = percentiles(df, keys, {"low": (column, 0.0), "high": (column, top)})
    span = F.col("high") - F.col("low")
    room = F.when(span == 0, F.when(F.col("high") == 0, 1.0).otherwise(F.abs("high") * pad)).otherwise(span * pad)
    return stats.withColumns({"axis_low": F.col("low") - room, "axis_high": F.col("high") + room})


def bin_limits(df: DataFrame, features: list[str], response: str, windows: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Upper limits that all sessions, gesture subsets and features share on axes of sums and counts.

    ``sum_high`` is the largest sum of responses in a bin (0 at least), ``count_high`` the largest number of
    rows with a response in a bin; axes start at 0.  Null where no bin has a row.
    """
    def placed(f):
        return F.transform(_in_windows(f, windows[f]), lambda i: F.struct(F.lit(f).alias("feature"), i.alias("bin")))

    long = df.filter(F.col(response).isNotNull()).withColumn("subset", F.explode(C.subset_members("gesture_type"))).select(
        "session_id", "subset", response, F.inline(F.flatten(F.array(*[placed(f) for f in features]))))
    per = long.groupBy("session_id", "subset", "feature", "bin").agg(F.sum(response).alias("_s"), F.count("*").alias("_n"))
    return per.agg(F.greatest(F.max("_s"), F.when(F.max("_n").isNotNull(), F.lit(0.0))).alias("sum_high"), F.max("_n").alias("count_high"))


def normalised(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Min-max scaled columns, per key or pooled (no keys)."""
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(ends, keys) if keys else df.join(F.broadcast(ends))  # one row without keys
    return out.withColumns({f"{c}_norm": C.min_max(c, f"_lo_{c}", f"_hi_{c}") for c in columns}).drop(
        *[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def quartiles(df: DataFrame, keys: list[str], columns: list[str], min_rows: int = 2) -> DataFrame:
    """Median and quartiles per key, null where fewer than ``min_rows`` values are known."""
    wanted = {f"{c}_{n}": (c, p) for c in columns for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))}
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in columns], F.count("*").alias("n"))
    out = percentiles(df, keys, wanted).join(counts, keys)
    return out.withColumns({
        n: F.when(F.col(f"_n_{c}") >= min_rows, F.col(n)) for n, (c, _) in wanted.items()
    }).drop(*[f"_n_{c}" for c in columns])


def type_means(df: DataFrame, session: str, kind: str, columns: list[str]) -> DataFrame:
    """Per type mean of session means, with the standard error over sessions."""
    per = df.groupBy(kind, session).agg(*[F.avg(c).alias(c) for c in columns])
    aggs = []
    for c in columns:
        n = F.count(c)
        aggs += [F.avg(c).alias(f"{c}_mean"),
                 F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).when(n == 1, 0.0).alias(f"{c}_sem")]
    return per.groupBy(kind).agg(*aggs, F.count("*").alias("n_sessions"))
