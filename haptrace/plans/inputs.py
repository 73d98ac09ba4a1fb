"""The given tables seen as recordings.

Each view is one SELECT that Spark and DuckDB both run over the whole source tables,
so that the Spark operators and their SQL twins start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"


def _stickers() -> str:
    out = []
    for i, s in enumerate(("blue", "green", "yellow")):
        for j, a in enumerate("xyz"):
            out.append(f"CASE WHEN event_id % 3 <> {i} THEN value * {i + 1} + k * {j + 1} / 8 END AS sticker_{s}_position_{a}")
    return ",\n  ".join(out)


# Raw frames: gaps in all sampled columns, one row per event.
RAW = f"""
SELECT concat('s', CAST(user_id % 8 AS STRING)) AS session_id, CAST(user_id AS STRING) AS block_order_id,
  1 AS trial_id, CAST(floor(hour(ts) / 4) AS INT) AS single_touch_id, event_id AS frame_idx,
  CASE WHEN user_id % 2 = 0 THEN 'tap' ELSE 'stroke' END AS type_metadata,
  CASE WHEN user_id % 3 = 0 THEN 'Whole hand' ELSE 'one finger tip' END AS contact_area_metadata,
  CASE WHEN event_id % 3 = 0 THEN value END AS contact_depth,
  CASE WHEN event_id % 4 <> 1 THEN k END AS contact_area,
  {_stickers()},
  CASE WHEN event_id % 2 = 0 THEN value / 4 + k / 4 END AS contact_location_x,
  CASE WHEN event_id % 2 = 0 THEN value / 4 - k / 8 END AS contact_location_y,
  CASE WHEN event_id % 2 = 0 THEN k / 16 END AS contact_location_z,
  CASE WHEN event_id % 4 = 0 THEN concat('[[', CAST(event_id % 40 AS STRING), ' ', CAST(event_id % 7 AS STRING), '.5 -1e0] [',
    CAST(event_id % 11 AS STRING), ' x 3] [1 2] [2 ', CAST(event_id % 5 AS STRING), ' 0.25]]') END AS contact_points,
  CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS contact_detected,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Nerve_spike,
  CASE WHEN event_type = 'error' THEN value ELSE 0e0 END AS Nerve_freq
FROM (SELECT *, {_K} AS k FROM events) e
"""

# Labelled frames without gaps: what the operators after preparation start from.
FRAMES = f"""
SELECT concat('s', CAST(user_id % 8 AS STRING)) AS session_id, CAST(user_id AS STRING) AS block_order_id,
  1 AS trial_id, CAST(floor(hour(ts) / 4) AS INT) AS single_touch_id, event_id AS frame_idx,
  CASE WHEN user_id % 2 = 0 THEN 'tap' ELSE 'stroke' END AS type_metadata,
  CASE WHEN user_id % 2 = 0 THEN 'tap' WHEN user_id % 3 = 0 THEN 'stroke_proximal' ELSE 'stroke_distal' END AS gesture_type,
  value AS contact_depth, k AS contact_area, value / 4 + k / 4 AS contact_location_x, value / 4 - k / 8 AS contact_location_y,
  k / 16 AS contact_location_z,
  value * 2 - k / 8 AS hand_position_x, value + k / 4 AS hand_position_y, k / 2 - value / 8 AS hand_position_z,
  CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS contact_detected,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Nerve_spike,
  CASE WHEN event_type = 'error' THEN value ELSE 0e0 END AS Nerve_freq
FROM (SELECT *, {_K} AS k FROM events) e WHERE hour(ts) >= 4
"""

# One feature row per touch; all features are exact (no averages), so bins have no rounding.
TOUCHES = """
SELECT concat('s', CAST(l_orderkey % 8 AS STRING)) AS session_id, CAST(l_orderkey % 30 AS STRING) AS block_order_id,
  1 AS trial_id, l_orderkey AS single_touch_id,
  CASE min(l_returnflag) WHEN 'A' THEN 'stroke_proximal' WHEN 'N' THEN 'tap' ELSE 'stroke_distal' END AS gesture_type,
  CASE WHEN min(l_returnflag) = 'N' THEN 'tap' ELSE 'stroke' END AS type_metadata,
  max(l_quantity) AS depth_max, min(l_quantity) AS depth_min, max(l_extendedprice) / 1000 AS velocity_max,
  max(l_discount) * 100 AS pressure_max, max(l_tax) * 50 AS iff_max,
  sum(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END) AS spike_count,
  max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS spike_elicited,
  max(l_quantity) - 25 AS mean_contact_x, max(l_discount) * 400 - 20 AS mean_contact_y, max(l_tax) * 400 - 16 AS mean_contact_z
FROM lineitem GROUP BY l_orderkey
"""

# One contact sample per line: a touch is an order, the point lies near the surface below.
CONTACTS = """
SELECT concat('s', CAST(l_suppkey % 4 AS STRING)) AS session_id, CAST(l_partkey % 30 AS STRING) AS block_order_id,
  1 AS trial_id, l_orderkey AS single_touch_id,
  CASE l_returnflag WHEN 'A' THEN 'stroke_proximal' WHEN 'N' THEN 'tap' ELSE 'stroke_distal' END AS gesture_type,
  l_quantity - 25 AS x, round(l_discount * 400) - 20 AS y, round(l_tax * 400) - 16 AS z,
  l_extendedprice / 1000 AS iff, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS spike
FROM lineitem
"""

# The surface: one vertex per embedding.
VERTICES = """
SELECT vec_id AS vertex_id, {0} * 100 AS x, {1} * 100 AS y, {2} * 100 AS z, label
FROM embeddings
"""

# Response map of each session and gesture: mean iff per (quantity, discount) cell.
RASTER = """
SELECT concat('s', CAST(l_suppkey % 4 AS STRING)) AS session_id,
  CASE l_returnflag WHEN 'A' THEN 'stroke_proximal' WHEN 'N' THEN 'tap' ELSE 'stroke_distal' END AS gesture_type,
  CAST(l_quantity AS INT) - 1 AS r, CAST(round(l_discount * 100) AS INT) AS c,
  (l_quantity - 1) / 49 AS u, round(l_discount * 100) / 10 AS v,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e5 AS z, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6
"""

_VIEWS = {"raw": RAW, "frames": FRAMES, "touches": TOUCHES, "contacts": CONTACTS, "raster": RASTER}


def _vertices(get) -> str:
    return VERTICES.format(*[f"CAST({get(i)} AS DOUBLE)" for i in range(3)])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a given table) as a DataFrame."""
    text = _vertices(lambda i: f"embedding[{i}]") if name == "vertices" else _VIEWS.get(name)
    if text is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in ("events", "lineitem", "embeddings"):
        if f"FROM {table}" in text:
            return spark.sql(
                text.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    raise ValueError(name)


def ctes(*names: str) -> str:
    """``WITH`` prefix that states the same views for DuckDB."""
    texts = dict(_VIEWS, vertices=_vertices(lambda i: f"embedding[{i + 1}]"))
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in names)
