"""Preparation of raw frames: ids, gap filling, gesture labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.functions import columns as C
from haptrace.operators.ordered import forward_fill, has_large_groups, ordered
from haptrace.schema import GESTURES, INTERPOLATED, KEYS, PREPARED_DROP, SESSION_FFILL, TOUCH_FFILL


def ensure_block_id(df: DataFrame) -> DataFrame:
    """Block id as a string; where none is recorded it comes from the source file name."""
    recorded = F.col("block_order_id").cast("string") if "block_order_id" in df.columns else F.lit(None).cast("string")
    named = C.block_id("source_block_file") if "source_block_file" in df.columns else F.lit(None).cast("string")
    return df.withColumn("block_order_id", F.coalesce(recorded, named))


def touch_rows(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows that belong to a group: a key with a missing part forms no group."""
    return df.na.drop(subset=keys)


def session_fill(df: DataFrame, columns: list[str] = SESSION_FFILL) -> DataFrame:
    return forward_fill(df, ["session_id"], [c for c in columns if c in df.columns])


def touch_fill(df: DataFrame, keys: list[str] = KEYS, interpolated: list[str] = INTERPOLATED,
               filled: list[str] = TOUCH_FFILL, split: bool | None = None) -> DataFrame:
    """Inside-only linear interpolation and forward fill within each touch.

    A column with a single known value becomes constant; touch 0 is left as it is.
    """
    interpolated = [c for c in interpolated if c in df.columns]
    filled = [c for c in filled if c in df.columns]
    df = touch_rows(df, keys)
    split = has_large_groups(df, keys) if split is None else split
    df = ordered(df, keys, position="_i", split=split)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
             for c in interpolated}
    df = ordered(
        df, keys,
        last_known={f"_b_{c}": k for c, k in known.items()} | {f"_f_{c}": F.col(c) for c in filled},
        next_known={f"_a_{c}": k for c, k in known.items()},
        total={f"_k_{c}": F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in interpolated},
        split=split,
    )

    def value(c: str):
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        between = b.v + (a.v - b.v) * (F.col("_i") - b.i) / (a.i - b.i)
        return (F.when(F.col("single_touch_id") == 0, F.col(c))
                .when(F.col(c).isNotNull(), F.col(c))
                .when(F.col(f"_k_{c}") == 1, F.coalesce(b.v, a.v))
                .otherwise(between))

    out = {c: value(c) for c in interpolated}
    out |= {c: F.when(F.col("single_touch_id") == 0, F.col(c)).otherwise(F.col(f"_f_{c}")) for c in filled}
    extra = [f"_{k}_{c}" for c in interpolated for k in "bak"] + [f"_f_{c}" for c in filled] + ["_i"]
    return df.withColumns(out).drop(*extra)


def clamp_joint(df: DataFrame, columns: tuple[str, ...] = ("contact_depth", "contact_area")) -> DataFrame:
    """Where one of the columns is negative, all become 0."""
    present = [F.col(c) for c in columns if c in df.columns]
    if not present:
        return df
    low = F.coalesce(F.least(*present) if len(present) > 1 else present[0], F.lit(0.0)) < 0
    return df.withColumns({c: F.when(low, F.lit(0.0)).otherwise(F.col(c)) for c in columns if c in df.columns})


def gesture_labels(df: DataFrame, keys: list[str] = KEYS, split: bool | None = None) -> DataFrame:
    """One row per touch with ``gesture_type``.

    A stroke is proximal when the least-squares slope of its known x positions is
    positive.  The slope needs only sums, so no task sees a whole touch.
    """
    df = touch_rows(df, keys).filter("single_touch_id <> 0").select(
        *keys, "frame_idx", "type_metadata", "contact_location_x")
    known = F.when(F.col("contact_location_x").isNotNull(), 1).otherwise(0)
    placed = ordered(df, keys, running={"_i": known}, split=split)
    kind = F.col("_kind")
    label = (
        F.when(kind == "tap", F.lit("tap"))
        .when(kind == "stroke", F.when(F.col("_n") < 2, "stroke_unknown")
              .when(F.col("_slope") > 0, "stroke_proximal").otherwise("stroke_distal"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown type_metadata "), F.coalesce(kind, F.lit("null")))))
    )
    return placed.groupBy(*keys).agg(
        F.min_by(F.struct("type_metadata"), "frame_idx")["type_metadata"].alias("_kind"),
        F.count("contact_location_x").alias("_n"),
        F.regr_slope("contact_location_x", F.when(F.col("contact_location_x").isNotNull(), F.col("_i"))).alias("_slope"),
    ).select(*keys, label.alias("gesture_type"))


def assign_gestures(df: DataFrame, keys: list[str] = KEYS, split: bool | None = None) -> DataFrame:
    """Gesture label of each touch on all of its frames; touch 0 gets none."""
    labelled = df.drop("gesture_type").join(gesture_labels(df, keys, split), keys, "left")
    return labelled.withColumn("gesture_broad_type", C.broad_type("gesture_type"))


def direction_by_endpoints(df: DataFrame, column: str = "sticker_blue_position_y", keys: list[str] = KEYS) -> DataFrame:
    """Older direction rule: last against first known y of a stroke, else static."""
    known = F.when(F.col(column).isNotNull(), F.col("frame_idx"))
    ends = touch_rows(df, keys).groupBy(*keys).agg(
        F.min_by(F.struct("type_metadata"), "frame_idx")["type_metadata"].alias("_kind"),
        F.min_by(column, known).alias("first_value"), F.max_by(column, known).alias("last_value"),
    )
    stroke = (F.col("_kind") == "stroke") & F.col("first_value").isNotNull()
    direction = F.when(stroke, F.when(F.col("last_value") > F.col("first_value"), "proximal").otherwise("distal"))
    return ends.select(*keys, F.coalesce(direction, F.lit("static")).alias("direction"))


def prepare(raw: DataFrame, split: bool | None = None) -> DataFrame:
    """Raw frames to prepared frames, one plan for all sessions."""
    df = session_fill(ensure_block_id(raw))
    split = has_large_groups(touch_rows(df).select(*KEYS), KEYS) if split is None else split
    df = clamp_joint(touch_fill(df, split=split))
    df = assign_gestures(df, split=split)
    return df.filter("single_touch_id <> 0").drop(*PREPARED_DROP)


def gesture_counts(df: DataFrame) -> DataFrame:
    """Distinct touches of each gesture class per session, zero where none."""
    touches = df.select(*KEYS, "gesture_type").dropDuplicates(KEYS)
    return touches.groupBy("session_id").agg(
        *[F.count_if(F.col("gesture_type") == g).alias(g) for g in GESTURES]
    )


def touch_numbers(df: DataFrame) -> DataFrame:
    """0-based id of each touch of a session in (block, trial, touch) order."""
    from haptrace.operators.quantiles import ranked_values

    touches = df.select(*KEYS).distinct().withColumn(
        "_order", F.struct(F.col("block_order_id").cast("long").alias("b"), "trial_id", "single_touch_id",
                           "block_order_id"))
    ranked = ranked_values(touches, ["session_id"], "_order")
    return ranked.select("session_id", F.col("_order.block_order_id"), F.col("_order.trial_id"),
                         F.col("_order.single_touch_id"), F.col("before").alias("touch_number"))
