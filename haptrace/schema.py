"""Column names and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TOUCH = ["block_order_id", "trial_id", "single_touch_id"]
KEYS = ["session_id", *TOUCH]
GESTURES = ["tap", "stroke_proximal", "stroke_distal"]
SUBSETS = ["all", "tap", "stroke", "stroke_proximal", "stroke_distal"]

# Sampling rate and column families of the recordings.
DATA_RATE_HZ = 1000.0
STICKERS = [f"sticker_{s}_position_{a}" for s in ("blue", "green", "yellow") for a in "xyz"]
LOCATION = [f"contact_location_{a}" for a in "xyz"]
INTERPOLATED = ["contact_depth", "contact_area", *STICKERS, *LOCATION]
TOUCH_FFILL = ["led_on", "contact_detected", "contact_points"]
SESSION_FFILL = ["trial_id", "single_touch_id", "type_metadata", "speed_metadata",
                 "contact_area_metadata", "force_metadata"]
# Bookkeeping columns dropped after preparation.
PREPARED_DROP = ["frame_index", "green_levels", "time_nerve", "time_kinect", "trial_on"]
# Columns that are never summarised by the statistical features.
NOT_AGGREGATED = {
    *TOUCH, "session_id", "frame_idx", "type_metadata", "gesture_type", "gesture_broad_type",
    "mean_contact_x", "mean_contact_y", "mean_contact_z", "spike_elicited",
    "frame", "frame_id", "Unnamed: 0", "source_block_file", "contact_area_metadata",
    "Nerve_spike", *STICKERS,
}

FRAME_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("block_order_id", "source_block_file")]
    + [T.StructField(n, T.IntegerType()) for n in ("trial_id", "single_touch_id")]
    + [T.StructField("time", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in SESSION_FFILL[2:]]
    + [T.StructField(n, T.DoubleType()) for n in INTERPOLATED]
    + [T.StructField("contact_points", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("contact_detected", "led_on", "Nerve_spike")]
    + [T.StructField(n, T.DoubleType()) for n in ("Nerve_freq", "Nerve_TTL")]
)
