"""Queries on frames: preparation, series, per-touch features, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from haptrace.functions import columns as C
from haptrace.operators import features as FT
from haptrace.operators import prepare as P
from haptrace.operators import series as S
from haptrace.operators.ordered import has_large_groups, run_lengths
from haptrace.plans.inputs import ctes, view
from haptrace.plans.registry import query, r, rounded
from haptrace.schema import KEYS, STICKERS

K = ", ".join(KEYS)
_LABELS = ["trial_id", "single_touch_id", "type_metadata", "contact_area_metadata"]
_FILL = ["contact_depth", "contact_area", *STICKERS, "contact_location_x", "contact_location_y", "contact_location_z"]
_OVER = f"PARTITION BY {K} ORDER BY frame_idx"
_BACK = f"({_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = f"({_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _interp(c: str) -> str:
    b, a = f"b_{c}", f"a_{c}"
    return (f"CASE WHEN single_touch_id = 0 THEN {c} WHEN {c} IS NOT NULL THEN {c} WHEN k_{c} = 1 THEN coalesce({b}.v, {a}.v) "
            f"ELSE {b}.v + ({a}.v - {b}.v) * (i - {b}.i) / ({a}.i - {b}.i) END AS {c}")


def _known(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN struct_pack(i := i, v := {c}) END"


_KEEP = "type_metadata, contact_area_metadata, Nerve_spike, Nerve_freq"
# Gap filling, clamping and labels of raw frames in SQL.
PREPARED_CTES = ctes("raw") + f""",
numbered AS (SELECT *, row_number() OVER ({_OVER}) - 1 AS i FROM raw),
seen AS (SELECT *, {", ".join(
    f"last_value({_known(c)} IGNORE NULLS) OVER {_BACK} AS b_{c}, first_value({_known(c)} IGNORE NULLS) OVER {_AHEAD} AS a_{c}, "
    f"count({c}) OVER (PARTITION BY {K}) AS k_{c}" for c in _FILL)} FROM numbered),
filled AS (SELECT {K}, frame_idx, {_KEEP}, {", ".join(_interp(c) for c in _FILL)},
  CASE WHEN single_touch_id = 0 THEN contact_points ELSE last_value(contact_points IGNORE NULLS) OVER {_BACK} END AS contact_points,
  contact_detected FROM seen),
clamped AS (SELECT * REPLACE (CASE WHEN contact_depth < 0 OR contact_area < 0 THEN 0.0 ELSE contact_depth END AS contact_depth,
  CASE WHEN contact_depth < 0 OR contact_area < 0 THEN 0.0 ELSE contact_area END AS contact_area) FROM filled),
placed AS (SELECT *, row_number() OVER (PARTITION BY {K}, contact_location_x IS NOT NULL ORDER BY frame_idx) AS j
  FROM clamped WHERE single_touch_id <> 0),
gestures AS (SELECT {K}, CASE WHEN first(type_metadata ORDER BY frame_idx) = 'tap' THEN 'tap'
    WHEN count(contact_location_x) < 2 THEN 'stroke_unknown' WHEN regr_slope(contact_location_x, j) > 0 THEN 'stroke_proximal'
    ELSE 'stroke_distal' END AS gesture_type FROM placed GROUP BY {K}),
prepared AS (SELECT c.*, gesture_type, CASE WHEN gesture_type = 'tap' THEN 'tap' WHEN gesture_type LIKE 'stroke_%imal'
    OR gesture_type = 'stroke_distal' THEN 'stroke' END AS gesture_broad_type
  FROM clamped c JOIN gestures USING ({K}) WHERE single_touch_id <> 0)
"""
# Velocity and acceleration of labelled frames in SQL.
MOVING_CTES = ctes("frames") + f""",
v AS (SELECT *, {", ".join(f"coalesce(hand_position_{a} - lag(hand_position_{a}) OVER w, 0) * 1000 AS hand_velocity_{a}" for a in "xyz")}
  FROM frames WINDOW w AS ({_OVER})),
moving AS (SELECT *, {", ".join(f"coalesce(hand_velocity_{a} - lag(hand_velocity_{a}) OVER w, 0) * 1000 AS hand_acceleration_{a}" for a in "xyz")},
  sqrt(hand_velocity_x * hand_velocity_x + hand_velocity_y * hand_velocity_y + hand_velocity_z * hand_velocity_z) AS hand_velocity_amplitude
  FROM v WINDOW w AS ({_OVER}))
"""


def _moving(spark, sf):
    df = view(spark, sf, "frames")
    split = has_large_groups(df.select(*KEYS), KEYS)
    df = S.velocity(df, split=split)
    return S.acceleration(df.withColumn(S.AMPLITUDE, C.norm(*S.VELOCITY)), split=split)


_gappy = f"CASE WHEN frame_idx % 5 <> 2 THEN {{0}} END AS {{0}}"


@query("session_forward_fill", ctes("raw") + f""",
g AS (SELECT session_id, frame_idx, {", ".join(_gappy.format(c) for c in _LABELS)} FROM raw)
SELECT session_id, frame_idx, {", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS {c}" for c in _LABELS)}
FROM g""")
def _(spark, sf):
    raw = view(spark, sf, "raw").selectExpr("session_id", "frame_idx", *[_gappy.format(c) for c in _LABELS])
    return P.session_fill(raw, _LABELS)


@query("touch_gap_fill", PREPARED_CTES + f"""
SELECT {K}, frame_idx, {", ".join(r(c, c) for c in _FILL)}, contact_points FROM clamped""")
def _(spark, sf):
    df = P.clamp_joint(P.touch_fill(view(spark, sf, "raw")))
    return rounded(df.select(*KEYS, "frame_idx", *_FILL, "contact_points"))


@query("gesture_labels", PREPARED_CTES + f"SELECT {K}, gesture_type FROM gestures")
def _(spark, sf):
    return P.gesture_labels(P.clamp_joint(P.touch_fill(view(spark, sf, "raw"))))


@query("gesture_counts", PREPARED_CTES + """
SELECT session_id, count(*) FILTER (gesture_type = 'tap') AS tap, count(*) FILTER (gesture_type = 'stroke_proximal') AS stroke_proximal,
  count(*) FILTER (gesture_type = 'stroke_distal') AS stroke_distal FROM gestures GROUP BY 1""")
def _(spark, sf):
    return P.gesture_counts(P.prepare(view(spark, sf, "raw")))


@query("prepared_frames", PREPARED_CTES + f"""
SELECT {K}, frame_idx, {r('contact_depth', 'contact_depth')}, {r('contact_area', 'contact_area')}, contact_points, gesture_type,
  gesture_broad_type FROM prepared""")
def _(spark, sf):
    df = P.prepare(view(spark, sf, "raw"))
    return rounded(df.select(*KEYS, "frame_idx", "contact_depth", "contact_area", "contact_points", "gesture_type", "gesture_broad_type"))


@query("touch_features_end_to_end", PREPARED_CTES + f""",
area AS (SELECT {K}, first(contact_area_metadata ORDER BY frame_idx) AS a FROM prepared GROUP BY {K}),
hand AS (SELECT p.*, {", ".join(f"CASE WHEN lower(a) LIKE '%hand%' THEN (sticker_green_position_{x} + sticker_yellow_position_{x}) / 2 ELSE sticker_blue_position_{x} END AS hand_position_{x}" for x in "xyz")}
  FROM prepared p JOIN area USING ({K})),
vel AS (SELECT *, {", ".join(f"coalesce(hand_position_{x} - lag(hand_position_{x}) OVER w, 0) * 1000 AS v{x}" for x in "xyz")} FROM hand WINDOW w AS ({_OVER})),
amp AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS hand_velocity_amplitude FROM vel)
SELECT {K}, min(type_metadata) AS type_metadata, min(gesture_type) AS gesture_type, {", ".join(r(f"avg(contact_location_{a})", f"mean_contact_{a}", 4) for a in "xyz")},
  max(Nerve_spike) AS spike_elicited, {", ".join(f"{r(f'avg({c})', c + '_mean', 4)}, {r(f'max({c})', c + '_max', 4)}, {r(f'median({c})', c + '_median', 4)}" for c in ("contact_depth", "hand_velocity_amplitude"))}
FROM amp GROUP BY {K}""")
def touch_features(spark, sf):
    raw = view(spark, sf, "raw")
    split = has_large_groups(raw.select(*KEYS), KEYS)
    frames = S.series(P.prepare(raw, split), ["hand_position", "velocity_amplitude"], split=split)
    return rounded(FT.statistical(frames, ["mean", "median", "max"], ["contact_depth", S.AMPLITUDE], split=split), 4)


@query("direction_by_endpoints", ctes("raw") + f"""
SELECT {K}, CASE WHEN first(type_metadata ORDER BY frame_idx) = 'stroke' AND count(sticker_blue_position_y) > 0 THEN
  CASE WHEN last(sticker_blue_position_y ORDER BY frame_idx) FILTER (sticker_blue_position_y IS NOT NULL) >
    first(sticker_blue_position_y ORDER BY frame_idx) FILTER (sticker_blue_position_y IS NOT NULL) THEN 'proximal' ELSE 'distal' END
  ELSE 'static' END AS direction FROM raw GROUP BY {K}""")
def _(spark, sf):
    return P.direction_by_endpoints(view(spark, sf, "raw"))


@query("touch_numbers", ctes("raw") + f"""
SELECT {K}, row_number() OVER (PARTITION BY session_id ORDER BY CAST(block_order_id AS BIGINT), trial_id, single_touch_id) - 1 AS touch_number
FROM (SELECT DISTINCT {K} FROM raw)""")
def _(spark, sf):
    return P.touch_numbers(view(spark, sf, "raw"))


@query("contact_string_runs", PREPARED_CTES + f""",
m AS (SELECT {K}, frame_idx, contact_points, CASE WHEN row_number() OVER w = 1 OR contact_points IS DISTINCT FROM lag(contact_points) OVER w THEN 1 ELSE 0 END AS ch
  FROM prepared WINDOW w AS ({_OVER})),
n AS (SELECT *, sum(ch) OVER ({_OVER}) - 1 AS run FROM m)
SELECT {K}, CAST(run AS BIGINT) AS run_id, min(frame_idx) AS first_row, count(*) AS run_length, min(contact_points) AS contact_points FROM n GROUP BY {K}, run""")
def _(spark, sf):
    return run_lengths(P.touch_fill(view(spark, sf, "raw").filter("single_touch_id <> 0")), KEYS, "contact_points")


@query("velocity_and_acceleration", MOVING_CTES + f"""
SELECT {K}, frame_idx, {", ".join(r(c, c, 4) for c in (*S.VELOCITY, *S.ACCELERATION, S.AMPLITUDE))} FROM moving""")
def _(spark, sf):
    return rounded(_moving(spark, sf).select(*KEYS, "frame_idx", *S.VELOCITY, *S.ACCELERATION, S.AMPLITUDE), 4)


@query("hand_position", ctes("raw") + f""", a AS (SELECT {K}, first(contact_area_metadata ORDER BY frame_idx) AS a FROM raw GROUP BY {K})
SELECT {K}, frame_idx, {", ".join(r(f"CASE WHEN lower(a) LIKE '%hand%' THEN (sticker_green_position_{x} + sticker_yellow_position_{x}) / 2 ELSE sticker_blue_position_{x} END", f"hand_position_{x}") for x in "xyz")}
FROM raw JOIN a USING ({K})""")
def _(spark, sf):
    return rounded(S.hand_position(view(spark, sf, "raw")).select(*KEYS, "frame_idx", *S.POSITION))


# Main axis of a touch's velocities: the largest eigenvalue by the cosine form, the longest of the cross products as axis, along the mean velocity.
_AXIS = MOVING_CTES + f""", mo AS (SELECT {K}, {", ".join(f"avg(hand_velocity_{a}) AS m{a}" for a in "xyz")},
 {", ".join(f"covar_pop(hand_velocity_{a}, hand_velocity_{b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))}, count(*) AS n FROM moving GROUP BY {K}),
mq AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mo), mp AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mq),
ml AS (SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3) ELSE q END AS l FROM mp),
mc AS (SELECT *, unnest([[xy * yz - xz * (yy - l), xz * xy - (xx - l) * yz, (xx - l) * (yy - l) - xy * xy], [xy * (zz - l) - xz * yz, xz * xz - (xx - l) * (zz - l), (xx - l) * yz - xy * xz],
 [(yy - l) * (zz - l) - yz * yz, yz * xz - xy * (zz - l), xy * yz - (yy - l) * xz]]) AS w FROM ml),
mx AS (SELECT {K}, max(l * n) AS top, max(struct_pack(s := w[1] * w[1] + w[2] * w[2] + w[3] * w[3], w := w)) AS best, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz FROM mc GROUP BY {K}),
mu AS (SELECT {K}, top, CASE WHEN best.s > 0 THEN best.w[1] / sqrt(best.s) ELSE 1 END AS u0, CASE WHEN best.s > 0 THEN best.w[2] / sqrt(best.s) ELSE 0 END AS u1, CASE WHEN best.s > 0 THEN best.w[3] / sqrt(best.s) ELSE 0 END AS u2, mx, my, mz FROM mx),
sg AS (SELECT *, CASE WHEN mx * u0 + my * u1 + mz * u2 < 0 THEN -1 ELSE 1 END AS sg FROM mu)
"""


@query("signed_velocity", _AXIS + f"""SELECT {K}, frame_idx, {r("CASE WHEN top < 1e-24 THEN 0 ELSE sg * (hand_velocity_x * u0 + hand_velocity_y * u1 + hand_velocity_z * u2) / 1000 END", S.SIGNED, 3)} FROM moving JOIN sg USING ({K})""")
def _(spark, sf):
    out = S.signed_velocity(S.velocity(view(spark, sf, "frames")))
    return rounded(out.select(*KEYS, "frame_idx", (F.col(S.SIGNED) / 1000).alias(S.SIGNED)), 3)


_MOS = {"mos_strain": "contact_depth / 1.5", "mos_stress_kpa": "contact_depth / 1.5 * 100",
        "mos_strain_rate": "hand_velocity_amplitude / 1.5",
        "mos_elastic_energy_mj": "0.5 * 100 * (contact_depth / 1.5) * (contact_depth / 1.5) * contact_area * 1e-6 * 1.5e-3 * 1e6",
        "mos_impulse_mns": "contact_depth / 1.5 * 100 * contact_area * 1e-6 * 0.001 * 1e6"}


@query("pressure_and_mechanics", MOVING_CTES + f"""
SELECT {K}, frame_idx, {r("CASE WHEN contact_area > 0 THEN contact_depth / contact_area END", "pressure")},
  {", ".join(r(e, n, 4) for n, e in _MOS.items())} FROM moving""")
def _(spark, sf):
    df = _moving(spark, sf).withColumn("pressure", C.pressure()).withColumns(C.mechanics())
    return rounded(df.select(*KEYS, "frame_idx", "pressure", *_MOS), 4, pressure=6)


_STAT = ["contact_depth", "contact_area", "Nerve_freq"]


def _stat_sql(c):
    skew = f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END"
    parts = {"mean": f"avg({c})", "median": f"median({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
             "range": f"max({c}) - min({c})", "skewness": skew}
    return ", ".join(r(e, f"{c}_{n}", 4) for n, e in parts.items())


_SHARED = (f"min(type_metadata) AS type_metadata, min(gesture_type) AS gesture_type, "
           + ", ".join(r(f"avg(contact_location_{a})", f"mean_contact_{a}", 4) for a in "xyz") + ", max(Nerve_spike) AS spike_elicited")


@query("statistical_features", ctes("frames") + f"""
SELECT {K}, {_SHARED}, {", ".join(_stat_sql(c) for c in _STAT)} FROM frames GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.statistical(view(spark, sf, "frames"), columns=_STAT), 4)


_ACT = ctes("frames") + f""",
f AS (SELECT *, max(Nerve_freq) OVER (PARTITION BY {K}) > 0 AS fires, row_number() OVER ({_OVER}) - 1 AS i FROM frames),
a AS (SELECT *, CASE WHEN fires THEN Nerve_freq > 0 ELSE contact_detected = 1 END AS act FROM f)"""


@query("mean_during_activity", _ACT + f"""
SELECT {K}, {_SHARED}, {", ".join(r(f"avg(CASE WHEN act THEN {c} END)", f"{c}_mean_during_iff", 4) for c in _STAT)} FROM a GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.extract_feature("mean_during_iff", view(spark, sf, "frames"), columns=_STAT), 4)


@query("mean_before_activity", _ACT + f""", o AS (SELECT *, min(CASE WHEN act THEN i END) OVER (PARTITION BY {K}) AS f0 FROM a)
SELECT {K}, {_SHARED}, {", ".join(r(f"avg(CASE WHEN i >= f0 - 4 AND i < f0 THEN {c} END)", f"{c}_mean_before_iff", 4) for c in _STAT)} FROM o GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.extract_feature("mean_before_iff", view(spark, sf, "frames"), columns=_STAT, window=4), 4)


@query("mean_before_activity_default", _ACT + f""", o AS (SELECT *, min(CASE WHEN act THEN i END) OVER (PARTITION BY {K}) AS f0 FROM a)
SELECT {K}, {_SHARED}, {", ".join(r(f"avg(CASE WHEN i >= f0 - 250 AND i < f0 THEN {c} END)", f"{c}_mean_before_iff", 4) for c in _STAT)} FROM o GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.extract_feature("mean_before_iff", view(spark, sf, "frames"), columns=_STAT), 4)


@query("spike_counts", ctes("frames") + f"SELECT {K}, {_SHARED}, CAST(sum(Nerve_spike) AS BIGINT) AS spike_count FROM frames GROUP BY {K}")
def _(spark, sf):
    return rounded(FT.extract_feature("spike_count", view(spark, sf, "frames")), 4)


@query("mechanics_features", MOVING_CTES + f""", m AS (SELECT {K}, {", ".join(f"{e} AS {n}" for n, e in _MOS.items())} FROM moving)
SELECT {K}, {r("max(mos_strain)", "strain_max", 4)}, {r("avg(mos_strain)", "strain_mean", 4)}, {r("max(mos_stress_kpa)", "stress_max_kpa", 4)},
 {r("avg(mos_stress_kpa)", "stress_mean_kpa", 4)}, {r("max(mos_strain_rate)", "strain_rate_max", 4)}, {r("max(mos_elastic_energy_mj)", "elastic_energy_max_mj", 4)},
 {r("sum(mos_elastic_energy_mj)", "elastic_energy_total_mj", 4)}, {r("sum(mos_impulse_mns)", "impulse_total_mns", 4)} FROM m GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.mechanics_features(_moving(spark, sf).withColumns(C.mechanics())), 4)


@query("pressure_features", MOVING_CTES + f"""
SELECT {K}, {r("max(CASE WHEN contact_area > 0 THEN contact_depth / contact_area END)", "pressure_max", 4)},
  {r("max(hand_velocity_amplitude)", "geo_velocity_max", 4)} FROM moving GROUP BY {K}""")
def _(spark, sf):
    return rounded(FT.pressure_features(_moving(spark, sf).withColumn("pressure", C.pressure()), "max"), 4)


@query("touch_categories", ctes("frames") + f"""
SELECT {K}, CAST(min(gesture_type) = 'tap' AS INT) AS is_tap, CAST(min(gesture_type) IN ('stroke_proximal', 'stroke_distal') AS INT) AS is_stroke,
  CAST(min(gesture_type) = 'stroke_proximal' AS INT) AS dir_proximal, CAST(min(gesture_type) = 'stroke_distal' AS INT) AS dir_distal
FROM frames GROUP BY {K}""")
def _(spark, sf):
    return FT.touch_categories(view(spark, sf, "frames"))


@query("touch_summary", MOVING_CTES + f""",
g AS (SELECT {K}, CASE WHEN min(type_metadata) = 'tap' THEN 'tap' WHEN count(*) < 2 THEN 'stroke_unknown'
  WHEN regr_slope(contact_location_x, i) > 0 THEN 'stroke_proximal' ELSE 'stroke_distal' END AS gesture_type
  FROM (SELECT *, row_number() OVER ({_OVER}) AS i FROM frames) GROUP BY {K})
SELECT {K}, type_metadata, gesture_type, spike_elicited, mean_contact_x, mean_contact_y, mean_contact_z, depth_max, area_max, velocity_max, acceleration_max
FROM (SELECT {K}, min(type_metadata) AS type_metadata, {", ".join(r(f"avg(contact_location_{a})", f"mean_contact_{a}", 4) for a in "xyz")},
  max(Nerve_spike) AS spike_elicited, {r("max(contact_depth)", "depth_max", 4)}, {r("max(contact_area)", "area_max", 4)}, {r("max(hand_velocity_amplitude)", "velocity_max", 4)},
  {r("max(sqrt(hand_acceleration_x * hand_acceleration_x + hand_acceleration_y * hand_acceleration_y + hand_acceleration_z * hand_acceleration_z))", "acceleration_max", 2)}
  FROM moving GROUP BY {K}) JOIN g USING ({K})""")
def _(spark, sf):
    return rounded(FT.touch_summary(_moving(spark, sf)), 4, acceleration_max=2)


@query("session_summary", ctes("raw") + """, t AS (SELECT DISTINCT session_id, block_order_id AS block_id, single_touch_id AS t FROM raw)
SELECT session_id, block_id, count(*) FILTER (t > 0) AS num_trials, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (t > 0), '') AS trial_ids
FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return FT.session_summary(view(spark, sf, "raw").withColumn("trial_id", F.col("single_touch_id")))


_IDS = "concat('/data/', session_id, '_ST', CAST(trial_id + 12 AS STRING), '-', block_order_id, '_semicontrolled_aggregated_block-order-', block_order_id, '_x.csv')"


@query("ids_from_file_names", ctes("raw") + f""", p AS (SELECT DISTINCT {_IDS} AS path FROM raw)
SELECT path, split_part(split_part(path, '/data/', 2), '_semicontrolled_', 1) AS session_id, regexp_extract(path, '_block-order-([0-9]+)_', 1) AS block_order_id,
  regexp_extract(path, '(ST[0-9]+-[0-9]+)', 1) AS unit FROM p""")
def _(spark, sf):
    p = view(spark, sf, "raw").selectExpr(f"{_IDS} AS path").distinct()
    return p.select("path", C.session_id("path").alias("session_id"), C.block_id("path").alias("block_order_id"), C.unit_name("path").alias("unit"))


@query("contact_point_parse", ctes("raw") + r""",
b AS (SELECT frame_idx, unnest(regexp_extract_all(contact_points, '\[([^\[\]]+)\]', 1)) AS s FROM raw),
t AS (SELECT frame_idx, string_split_regex(trim(s), '\s+') AS p FROM b)
SELECT frame_idx, TRY_CAST(p[1] AS DOUBLE) AS x, TRY_CAST(p[2] AS DOUBLE) AS y, TRY_CAST(p[3] AS DOUBLE) AS z FROM t
WHERE len(p) = 3 AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL""")
def _(spark, sf):
    return view(spark, sf, "raw").select("frame_idx", F.inline(C.contact_points("contact_points")))


@query("gesture_subsets", ctes("frames") + f""", s AS (SELECT *, unnest(CASE WHEN gesture_type = 'tap' THEN ['all', 'tap'] ELSE ['all', 'stroke', gesture_type] END) AS subset FROM frames)
SELECT session_id, subset, count(*) AS n_frames, {r("avg(contact_depth)", "depth_mean", 4)} FROM s GROUP BY 1, 2""")
def _(spark, sf):
    df = view(spark, sf, "frames").withColumn("subset", F.explode(C.subset_members("gesture_type")))
    return rounded(df.groupBy("session_id", "subset").agg(F.count("*").alias("n_frames"), F.avg("contact_depth").alias("depth_mean")), 4)


@query("merged_features", ctes("frames") + f"""
SELECT {K}, {r("avg(contact_depth)", "contact_depth_mean", 4)}, {r("max(contact_depth)", "contact_depth_max", 4)}, CAST(sum(Nerve_spike) AS BIGINT) AS spike_count
FROM frames GROUP BY {K}""")
def _(spark, sf):
    f = view(spark, sf, "frames")
    tables = [FT.extract_feature(a, f, columns=["contact_depth"]) for a in ("mean", "max")] + [FT.spike_count(f)]
    return rounded(FT.merge_features(tables).select(*KEYS, "contact_depth_mean", "contact_depth_max", "spike_count"), 4)


_HALF = "CAST(block_order_id AS BIGINT) % 3 <> 0"


@query("attached_features", ctes("frames") + f""", a AS (SELECT {K}, max(contact_depth) AS depth_max FROM frames WHERE {_HALF} GROUP BY {K}),
b AS (SELECT {K}, max(contact_area) AS area_max FROM frames WHERE single_touch_id <> 2 GROUP BY {K})
SELECT t.*, depth_max, area_max FROM (SELECT DISTINCT {K} FROM frames) t LEFT JOIN a USING ({K}) LEFT JOIN b USING ({K})""")
def _(spark, sf):
    f = view(spark, sf, "frames")
    a = f.filter(_HALF).groupBy(*KEYS).agg(F.max("contact_depth").alias("depth_max"))
    b = f.filter("single_touch_id <> 2").groupBy(*KEYS).agg(F.max("contact_area").alias("area_max"))
    return FT.attach_features(f.select(*KEYS).distinct(), [a, b])


@query("sessions_without_a_feature", ctes("frames") + """
SELECT session_id FROM frames EXCEPT SELECT session_id FROM frames WHERE session_id <> 's3'""")
def _(spark, sf):
    s = view(spark, sf, "frames").select("session_id")
    return FT.incomplete_sessions([s.distinct(), s.filter("session_id <> 's3'").distinct()])
