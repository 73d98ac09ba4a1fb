"""Per-frame series inside touches: position, velocity, acceleration, pressure, mechanics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.functions import columns as C
from haptrace.operators.ordered import has_large_groups, ordered
from haptrace.operators.prepare import touch_rows
from haptrace.schema import DATA_RATE_HZ, KEYS, STICKERS

POSITION = [f"hand_position_{a}" for a in "xyz"]
VELOCITY = [f"hand_velocity_{a}" for a in "xyz"]
ACCELERATION = [f"hand_acceleration_{a}" for a in "xyz"]
AMPLITUDE, SIGNED = "hand_velocity_amplitude", "hand_velocity_signed"
MECHANICS = ["mos_strain", "mos_stress_kpa", "mos_strain_rate", "mos_elastic_energy_mj", "mos_impulse_mns"]


def hand_position(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the green and yellow sticker for hand contacts, else the blue sticker.

    The first ``contact_area_metadata`` of the touch decides for all of its frames.
    """
    first = touch_rows(df, keys).groupBy(*keys).agg(
        F.min_by(F.struct("contact_area_metadata"), "frame_idx")["contact_area_metadata"].alias("_area")
    )
    hand = F.coalesce(F.lower("_area").contains("hand"), F.lit(False))
    return df.join(first, keys).withColumns({
        f"hand_position_{a}": F.when(
            hand, (F.col(f"sticker_green_position_{a}") + F.col(f"sticker_yellow_position_{a}")) / 2
        ).otherwise(F.col(f"sticker_blue_position_{a}"))
        for a in "xyz"
    }).drop("_area")


def differences(df: DataFrame, columns: dict[str, str], keys: list[str] = KEYS,
                split: bool | None = None) -> DataFrame:
    """First difference per second of each input; 0 on the first row and next to gaps."""
    prev = {f"_d_{o}": F.col(i) for o, i in columns.items()}
    stepped = ordered(df, keys, previous=prev, split=split)
    return stepped.withColumns({
        o: F.coalesce(F.col(i) - F.col(f"_d_{o}"), F.lit(0.0)) * DATA_RATE_HZ for o, i in columns.items()
    }).drop(*prev)


def velocity(df: DataFrame, keys: list[str] = KEYS, split: bool | None = None) -> DataFrame:
    return differences(df, dict(zip(VELOCITY, POSITION)), keys, split)


def acceleration(df: DataFrame, keys: list[str] = KEYS, split: bool | None = None) -> DataFrame:
    return differences(df, dict(zip(ACCELERATION, VELOCITY)), keys, split)


def signed_velocity(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Velocity along the principal axis of motion of the touch.

    The axis comes from ten sums per touch and a closed form; it points along the mean
    velocity.  Touches without velocity variance get 0.
    """
    x, y, z = (F.col(c) for c in VELOCITY)
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    moments = touch_rows(df, keys).groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate((x, y, z))],
        *[F.covar_pop(a, b).alias(f"_{n}") for n, (a, b) in pairs.items()],
        F.count("*").alias("_n"),
    )
    axes = C.with_principal_axis(moments, {n: f"_{n}" for n in pairs})
    axes = axes.withColumn("_top", F.col("_u_top") * F.col("_n"))
    facing = sum((F.col(f"_m{i}") * F.col(f"_u{i}") for i in (1, 2)), F.col("_m0") * F.col("_u0"))
    sign = F.when(facing < 0, -1.0).otherwise(1.0)
    axes = axes.select(*keys, "_top", *[(F.col(f"_u{i}") * sign).alias(f"_u{i}") for i in range(3)])
    along = x * F.col("_u0") + y * F.col("_u1") + z * F.col("_u2")
    return df.join(axes, keys).withColumn(
        SIGNED, F.when(F.col("_top") < 1e-24, F.lit(0.0)).otherwise(along)
    ).drop("_top", "_u0", "_u1", "_u2")


TRANSFORMS = ["hand_position", "hand_velocity", "hand_acceleration", "pressure", "mechanics",
              "velocity_amplitude", "velocity_signed"]
# Inputs that may be dropped once a transform has used them.
CONSUMED = {
    "hand_position": STICKERS, "hand_velocity": POSITION, "hand_acceleration": VELOCITY,
    "pressure": ["contact_depth", "contact_area"], "mechanics": ["contact_depth", "contact_area"],
    "velocity_amplitude": VELOCITY, "velocity_signed": VELOCITY,
}


def series(df: DataFrame, transforms: dict[str, dict] | list[str] | None = None, keys: list[str] = KEYS,
           split: bool | None = None) -> DataFrame:
    """Chain the enabled transforms; ``{"drop_inputs": True}`` drops what one consumed."""
    chosen = {t: {} for t in TRANSFORMS} if transforms is None else (
        {t: {} for t in transforms} if isinstance(transforms, list) else transforms)
    unknown = set(chosen) - set(TRANSFORMS)
    if unknown:
        raise ValueError(f"unknown series transforms {sorted(unknown)}")
    had = set(df.columns)
    df = touch_rows(df, keys).filter("single_touch_id <> 0")
    split = has_large_groups(df.select(*keys), keys) if split is None else split
    df = hand_position(df, keys)
    moving = {"hand_velocity", "hand_acceleration", "mechanics", "velocity_amplitude", "velocity_signed"}
    if moving & set(chosen):
        df = velocity(df, keys, split).withColumn(AMPLITUDE, C.norm(*VELOCITY))
    if "hand_acceleration" in chosen:
        df = acceleration(df, keys, split)
    if "velocity_signed" in chosen:
        df = signed_velocity(df, keys)
    if "pressure" in chosen:
        df = df.withColumn("pressure", C.pressure())
    if "mechanics" in chosen:
        opts = {k: v for k, v in chosen["mechanics"].items() if k in ("modulus_kpa", "thickness_mm")}
        df = df.withColumns(C.mechanics(**opts))
    made = {"hand_position": POSITION, "hand_velocity": VELOCITY, "velocity_amplitude": [AMPLITUDE]}
    drop = {c for t, cols in made.items() if t not in chosen for c in cols if c not in had}
    drop |= {c for t, o in chosen.items() if o.get("drop_inputs") for c in CONSUMED[t]}
    return df.drop(*drop)
