"""Per-touch features and session summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from haptrace.functions import columns as C
from haptrace.operators.ordered import has_large_groups, ordered
from haptrace.operators.prepare import gesture_labels, touch_rows
from haptrace.operators.quantiles import percentile_aggregates, percentiles
from haptrace.operators.series import ACCELERATION, AMPLITUDE, VELOCITY
from haptrace.schema import GESTURES, KEYS, LOCATION, NOT_AGGREGATED

AGGREGATIONS = ["mean", "median", "std", "min", "max", "range", "skewness"]


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that take part in discovery-style summaries."""
    return [f.name for f in df.schema.fields
            if f.name not in NOT_AGGREGATED and isinstance(f.dataType, T.NumericType)]


def skewness_corrected(c) -> Column:
    """Bias-corrected sample skewness: null below 3 values, 0 on constant input."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.count(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)))


_SIMPLE = {
    "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"), "range": lambda c: (F.max(c) - F.min(c)).cast("double"),
    "skewness": skewness_corrected,
}


def shared_columns(df: DataFrame) -> list[Column]:
    """Columns every feature row carries: labels, mean location, spike flag."""
    have = set(df.columns)
    kind = F.min_by(F.struct("type_metadata"), "frame_idx")["type_metadata"] if "type_metadata" in have else F.lit("unknown")
    out = [kind.alias("type_metadata")]
    if "gesture_type" in have:
        out.append(F.min_by("gesture_type", F.when(F.col("gesture_type").isNotNull(), F.col("frame_idx"))).alias("gesture_type"))
    out += [F.avg(c).alias(f"mean_contact_{c[-1]}") for c in LOCATION if c in have]
    spike = F.coalesce(F.greatest(F.least(F.max("Nerve_spike"), F.lit(1)), F.lit(0)), F.lit(0)) if "Nerve_spike" in have else F.lit(0)
    return [*out, spike.cast("int").alias("spike_elicited")]


def statistical(df: DataFrame, aggregations: list[str] = AGGREGATIONS, columns: list[str] | None = None,
                keys: list[str] = KEYS, split: bool | None = None) -> DataFrame:
    """All aggregations of all numeric columns per touch, in one wide row.

    One partial aggregation does it all.  Only where a touch is too long for one task,
    the median is taken apart and joined.
    """
    bad = set(aggregations) - set(AGGREGATIONS)
    if bad:
        raise ValueError(f"unknown aggregations {sorted(bad)}")
    columns = columns if columns is not None else numeric_columns(df)
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    aggs = [_SIMPLE[a](c).alias(f"{c}_{a}") for c in columns for a in aggregations if a in _SIMPLE]
    medians = {f"{c}_median": (c, 0.5) for c in columns} if "median" in aggregations else {}
    if medians and split is None:
        split = has_large_groups(df.select(*keys), keys)
    if medians and not split:
        aggs += percentile_aggregates(medians)
    wide = df.groupBy(*keys).agg(*shared_columns(df), *aggs)
    return wide.join(percentiles(df, keys, medians, split=True), keys) if medians and split else wide


def _active(df: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with an ``_active`` flag: firing frames, else contact frames of silent touches."""
    silent = df.groupBy(*keys).agg((F.max(F.coalesce(F.col("Nerve_freq"), F.lit(0.0))) > 0).alias("_fires"))
    return df.join(silent, keys).withColumn(
        "_active",
        F.coalesce(F.when(F.col("_fires"), F.col("Nerve_freq") > 0).otherwise(F.col("contact_detected") == 1), F.lit(False)),
    ).drop("_fires")


def mean_during_activity(df: DataFrame, columns: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    columns = columns if columns is not None else numeric_columns(df)
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    return _active(df, keys).groupBy(*keys).agg(
        *shared_columns(df), *[F.avg(F.when(F.col("_active"), F.col(c))).alias(f"{c}_mean_during_iff") for c in columns]
    )


def mean_before_activity(df: DataFrame, columns: list[str] | None = None, window: int = 250,
                         keys: list[str] = KEYS) -> DataFrame:
    """Means over the ``window`` rows before the first active row of the touch."""
    columns = columns if columns is not None else numeric_columns(df)
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    placed = ordered(_active(df, keys), keys, position="_i")
    onset = placed.groupBy(*keys).agg(F.min(F.when(F.col("_active"), F.col("_i"))).alias("_on"))
    use = (F.col("_i") >= F.col("_on") - window) & (F.col("_i") < F.col("_on"))
    return placed.join(onset, keys).groupBy(*keys).agg(
        *shared_columns(df), *[F.avg(F.when(use, F.col(c))).alias(f"{c}_mean_before_iff") for c in columns]
    )


def spike_count(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    return df.groupBy(*keys).agg(
        *shared_columns(df), F.coalesce(F.sum("Nerve_spike"), F.lit(0)).cast("long").alias("spike_count"))


def mechanics_features(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max("mos_strain").alias("strain_max"), F.avg("mos_strain").alias("strain_mean"),
        F.max("mos_stress_kpa").alias("stress_max_kpa"), F.avg("mos_stress_kpa").alias("stress_mean_kpa"),
        F.max("mos_strain_rate").alias("strain_rate_max"),
        F.max("mos_elastic_energy_mj").alias("elastic_energy_max_mj"),
        F.sum("mos_elastic_energy_mj").alias("elastic_energy_total_mj"),
        F.sum("mos_impulse_mns").alias("impulse_total_mns"),
    )


def pressure_features(df: DataFrame, aggregation: str = "mean", keys: list[str] = KEYS) -> DataFrame:
    if aggregation not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {aggregation!r}; expected mean or max")
    fold = F.avg if aggregation == "mean" else F.max
    return df.groupBy(*keys).agg(fold("pressure").alias(f"pressure_{aggregation}"),
                                 fold(AMPLITUDE).alias(f"geo_velocity_{aggregation}"))


def touch_categories(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One-hot gesture columns of the first frame; ``type_metadata`` where no gesture column exists."""
    column, strokes = ("gesture_type", GESTURES[1:]) if "gesture_type" in df.columns else ("type_metadata", ["stroke"])
    kind = F.coalesce(F.min_by(F.struct(column), "frame_idx")[column], F.lit(""))
    return df.groupBy(*keys).agg(kind.alias("_k")).select(
        *keys, (F.col("_k") == "tap").cast("int").alias("is_tap"), F.col("_k").isin(strokes).cast("int").alias("is_stroke"),
        (F.col("_k") == "stroke_proximal").cast("int").alias("dir_proximal"),
        (F.col("_k") == "stroke_distal").cast("int").alias("dir_distal"),
    )


def touch_summary(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Peak depth, area, speed and acceleration of each touch with its labels.

    ``df`` holds frames with velocity and acceleration.
    """
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    peaks = df.drop("gesture_type").groupBy(*keys).agg(
        *shared_columns(df.drop("gesture_type")),
        F.max("contact_depth").alias("depth_max"), F.max("contact_area").alias("area_max"),
        F.max(C.norm(*VELOCITY)).alias("velocity_max"), F.max(C.norm(*ACCELERATION)).alias("acceleration_max"),
    )
    return peaks.join(gesture_labels(df, keys), keys)


def session_summary(df: DataFrame) -> DataFrame:
    """Trials above 0 of each block of each session, counted and listed in order."""
    block = F.coalesce(F.col("block_order_id"), F.lit("unknown"))
    trials = df.select("session_id", block.alias("block_id"), F.when(F.col("trial_id") > 0, F.col("trial_id")).alias("t")).distinct()
    # One entry per distinct trial of a block, not per frame.
    return trials.groupBy("session_id", "block_id").agg(
        F.count("t").alias("num_trials"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("t")), lambda t: t.cast("string"))).alias("trial_ids"),
    )


# name -> function(frames) -> one row per touch
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    **{a: (lambda df, _a=a, **kw: statistical(df, [_a], **kw)) for a in AGGREGATIONS},
    "mean_during_iff": mean_during_activity,
    "mean_before_iff": mean_before_activity,
    "spike_count": spike_count,
}


def register_extractor(name: str, build: Callable[..., DataFrame]) -> None:
    """Add a user feature: a function of the frames that returns one row per touch."""
    EXTRACTORS[name] = build


def register_aggregates(name: str, build: Callable[[DataFrame], list[Column]], keys: list[str] = KEYS) -> None:
    """Add a user feature given as aggregate columns, built-in or pandas grouped ones."""
    def extract(df: DataFrame) -> DataFrame:
        df = touch_rows(df, keys).filter("single_touch_id <> 0")
        return df.groupBy(*keys).agg(*shared_columns(df), *build(df))

    register_extractor(name, extract)


def extract_feature(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown feature {name!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[name](df, **options)


def merge_features(tables: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Inner join of feature tables on the touch, for sessions present in all of them."""
    sessions = tables[0].select("session_id").distinct()
    for t in tables[1:]:
        sessions = sessions.intersect(t.select("session_id"))
    merged = tables[0].join(sessions, "session_id", "left_semi")
    for t in tables[1:]:
        fresh = [c for c in t.columns if c not in merged.columns]
        merged = merged.join(t.select(*keys, *fresh), keys)
    return merged


def incomplete_sessions(tables: list[DataFrame]) -> DataFrame:
    """Sessions that miss at least one of the feature tables."""
    every = tables[0].select("session_id").distinct()
    shared = every
    for t in tables[1:]:
        every = every.union(t.select("session_id").distinct()).distinct()
        shared = shared.intersect(t.select("session_id"))
    return every.exceptAll(shared)


def attach_features(touches: DataFrame, tables: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Outer merge of feature tables, one row per key, looked up for ``touches``."""
    merged = tables[0].dropDuplicates(keys)
    for t in tables[1:]:
        fresh = [c for c in t.columns if c not in merged.columns]
        merged = merged.join(t.dropDuplicates(keys).select(*keys, *fresh), keys, "full_outer")
    return touches.select(*keys).join(merged, keys, "left")


LOCATION_FEATURES = ["mean_contact_x", "mean_contact_y", "mean_contact_z"]


def feature_columns(available: list[str], spec: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Columns for ``{signal: [aggregations]}`` and the ones that are missing.

    ``location`` with ``mean`` stands for the mean contact position; a signal without a
    column of its own name is expanded to its x, y and z parts.
    """
    found, missing = [], []
    for signal, aggs in spec.items():
        for agg in aggs:
            if signal == "location":
                parts = LOCATION_FEATURES if agg == "mean" else [f"{c}_{agg}" for c in LOCATION]
            else:
                name = f"{signal}_{agg}"
                parts = [name] if name in available else [f"{signal}_{a}_{agg}" for a in "xyz"]
            hit = [p for p in parts if p in available]
            found += hit
            missing += [p for p in parts if p not in available] if hit or signal == "location" else [f"{signal}_{agg}"]
    return list(dict.fromkeys(found)), missing
