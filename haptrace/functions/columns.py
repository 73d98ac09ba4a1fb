"""Column expressions: ids, contact strings, mechanics, ratios and view geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from haptrace.schema import DATA_RATE_HZ, SUBSETS

# Formats of file names, unit names and contact strings.
SESSION_PATTERN = r"^(.*?)_semicontrolled_"
BLOCK_PATTERN = r"_block-order-(\d+)_"
UNIT_PATTERN = r"(ST\d+-\d+)"
BRACKET_PATTERN = r"\[([^\[\]]+)\]"
# Skin model defaults.
YOUNGS_MODULUS_KPA = 100.0
SKIN_THICKNESS_MM = 1.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    return F.nanvl(_c(x).cast("double"), F.lit(None).cast("double"))


def session_id(path) -> Column:
    """Text before ``_semicontrolled_`` in the file name, else the file stem."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    hit = F.regexp_extract(name, SESSION_PATTERN, 1)
    return F.when(hit != "", hit).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def block_id(source) -> Column:
    hit = F.regexp_extract(_c(source), BLOCK_PATTERN, 1)
    return F.when(hit != "", hit)


def unit_name(session) -> Column:
    hit = F.regexp_extract(_c(session), UNIT_PATTERN, 1)
    return F.when(hit != "", hit).otherwise(
        F.raise_error(F.concat(F.lit("no unit name in session id "), F.coalesce(_c(session), F.lit("null"))))
    )


def broad_type(gesture) -> Column:
    g = _c(gesture)
    return F.when(g == "tap", "tap").when(g.isin("stroke_proximal", "stroke_distal"), "stroke")


def subset_members(gesture) -> Column:
    """Names of the subsets a gesture belongs to, to be exploded before one group-by."""
    g = _c(gesture)
    broad = broad_type(g)
    return F.array_compact(F.array_distinct(F.array(
        F.lit("all"), F.when(broad.isNotNull(), broad), F.when(g.isin(*SUBSETS), g)
    )))


def in_subset(gesture, subset: str) -> Column:
    if subset not in SUBSETS:
        raise ValueError(f"unknown gesture subset {subset!r}; expected one of {SUBSETS}")
    return F.array_contains(subset_members(gesture), subset)


def contact_points(text) -> Column:
    """``[[x y z] [x y z]]`` as an array of points; malformed brackets are skipped."""
    cells = F.regexp_extract_all(_c(text), F.lit(BRACKET_PATTERN), 1)
    parts = F.transform(cells, lambda s: F.split(F.trim(s), r"\s+"))
    full = F.filter(parts, lambda p: F.size(p) == 3)
    points = F.transform(full, lambda p: F.struct(
        *[F.get(p, i).try_cast("double").alias(a) for i, a in enumerate("xyz")]
    ))
    return F.filter(points, lambda p: p.x.isNotNull() & p.y.isNotNull() & p.z.isNotNull())


def pressure(depth="contact_depth", area="contact_area") -> Column:
    return F.when(_c(area) > 0, _c(depth) / _c(area))


def mechanics(depth="contact_depth", area="contact_area", speed="hand_velocity_amplitude",
              modulus_kpa: float = YOUNGS_MODULUS_KPA, thickness_mm: float = SKIN_THICKNESS_MM) -> dict[str, Column]:
    """Uniaxial elastic skin: strain, stress, strain rate, energy and impulse per frame."""
    h = thickness_mm * 1e-3
    area_m2 = _c(area) * 1e-6
    strain = _c(depth) * 1e-3 / h
    stress = strain * modulus_kpa
    return {
        "mos_strain": strain,
        "mos_stress_kpa": stress,
        "mos_strain_rate": _c(speed) * 1e-3 / h,
        "mos_elastic_energy_mj": strain * strain * (0.5 * modulus_kpa) * area_m2 * h * 1e6,
        "mos_impulse_mns": stress * area_m2 * (1e6 / DATA_RATE_HZ),
    }


def norm(*parts) -> Column:
    squares = [_c(p) * _c(p) for p in parts]
    return F.sqrt(sum(squares[1:], squares[0]))


def round_to(x, step: float) -> Column:
    return F.bround(_c(x) / step) * step


def safe_ratio(a, b) -> Column:
    return F.when(_c(b) != 0, _c(a) / _c(b))


def distance(a: list, b: list) -> Column:
    return norm(*[_c(p) - _c(q) for p, q in zip(a, b)])


def count_threshold(percent, n) -> Column:
    """``max(1, round(percent / 100 * n))`` with half-to-even rounding."""
    p = _c(percent) if not isinstance(percent, (int, float)) else F.lit(float(percent))
    return F.greatest(F.lit(1), F.bround(p / 100 * _c(n)).cast("long"))


def mark_below(value, n_unique, threshold) -> Column:
    return F.when((_c(n_unique) > 0) & (_c(n_unique) < _c(threshold)), F.lit(-1.0)).otherwise(_c(value))


def min_max(x, low, high) -> Column:
    span = _c(high) - _c(low)
    return F.when(span == 0, F.lit(0.0)).otherwise((_c(x) - _c(low)) / span)


def wrap_angle(degrees) -> Column:
    """Difference of axis directions folded into [-90, 90)."""
    return F.pmod(_c(degrees) + 90.0, F.lit(180.0)) - 90.0


def align_uv(u, v, cu, cv, rotation: list[list]) -> tuple[Column, Column]:
    du, dv = _c(u) - _c(cu), _c(v) - _c(cv)
    return tuple(du * r[0] + dv * r[1] for r in rotation)


def rotate(points: list, rotation: list[list]) -> list[Column]:
    """``p @ R.T`` for three coordinates."""
    return [sum((_c(p) * r for p, r in zip(points[1:], row[1:])), _c(points[0]) * row[0]) for row in rotation]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(v, what: str):
    n = norm(*v)
    n = F.when(n > 1e-12, n).otherwise(F.raise_error(F.lit(f"degenerate camera: {what}")))
    return [x / n for x in v]


def view_rotation(position: list, focal: list, up: list) -> list[list[Column]]:
    """Rows right, up and back of a camera as column expressions."""
    position, focal, up = ([_c(x) for x in v] for v in (position, focal, up))
    back = _unit([p - f for p, f in zip(position, focal)], "position equals focal point")
    right = _unit(_cross(up, back), "up is parallel to the view")
    return [right, _cross(back, right), back]


def cylinder_uv(x, y, z, axis: list[float], center: list[float], radius=None, toward: list[float] | None = None,
                zero: list[float] | None = None, up: list[float] | None = None) -> tuple[Column, Column]:
    """Unrolled coordinates about an axis: ``u = r * angle``, ``v`` along the axis.

    Angle 0 is the direction ``zero`` (with ``up`` at a right angle), or lies toward a point off the axis.
    """
    a = axis
    pick = [1.0, 0.0, 0.0] if abs(a[0]) < 0.9 else [0.0, 1.0, 0.0]
    if zero is not None:
        pick = zero
    elif toward is not None:
        off = [p - q for p, q in zip(toward, center)]
        along = sum(p * q for p, q in zip(off, a))
        if math.sqrt(sum((p - along * q) ** 2 for p, q in zip(off, a))) >= 1e-8:
            pick = off
    dot = sum(p * q for p, q in zip(pick, a))
    e1 = [p - dot * q for p, q in zip(pick, a)]
    size = math.sqrt(sum(p * p for p in e1))
    e1 = [p / size for p in e1]
    e2 = [a[1] * e1[2] - a[2] * e1[1], a[2] * e1[0] - a[0] * e1[2], a[0] * e1[1] - a[1] * e1[0]]
    if up is not None:
        e2 = up
    rel = [_c(p) - q for p, q in zip((x, y, z), center)]
    along = [sum((r * w for r, w in zip(rel[1:], v[1:])), rel[0] * v[0]) for v in (a, e1, e2)]
    r = F.lit(float(radius)) if radius is not None else norm(along[1], along[2])
    return r * F.atan2(along[2], along[1]), along[0]


def eigen_2x2(a, b, d) -> dict[str, Column]:
    """Eigenvalues (descending) and direction of the major axis of [[a, b], [b, d]]."""
    a, b, d = _c(a), _c(b), _c(d)
    half = (a + d) / 2
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    return {"l1": half + root, "l2": half - root, "angle": F.atan2(b * 2, a - d) / 2}


def with_principal_axis(df: DataFrame, moments: dict[str, str], prefix: str = "_u") -> DataFrame:
    """Add the largest eigenvalue and a unit eigenvector of symmetric 3x3 matrices.

    ``moments`` names the columns of xx, xy, xz, yy, yz and zz.  The closed form is laid
    out in steps, since each step is used several times by the next.
    """
    xx, xy, xz, yy, yz, zz = (F.col(moments[m]) for m in ("xx", "xy", "xz", "yy", "yz", "zz"))
    q, p, top = F.col("_q"), F.col("_p"), F.col(f"{prefix}_top")
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    spread = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + (xy * xy + xz * xz + yz * yz) * 2
    df = df.withColumn("_p", F.sqrt(spread / 6))
    df = df.withColumns({n: F.when(p > 0, m / p).otherwise(0.0) for n, m in
                         {"_a": xx - q, "_b": xy, "_c": xz, "_d": yy - q, "_e": yz, "_f": zz - q}.items()})
    a, b, c, d, e, f = (F.col(f"_{n}") for n in "abcdef")
    df = df.withColumn("_det", a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_det") / 2))) / 3
    df = df.withColumn(f"{prefix}_top", q + p * 2 * F.cos(angle))
    rows = [[xx - top, xy, xz], [xy, yy - top, yz], [xz, yz, zz - top]]
    crosses = [F.array(*_cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))]
    df = df.withColumn("_x", F.array(*crosses))
    size = F.transform("_x", lambda v: F.struct(
        F.aggregate(v, F.lit(0.0), lambda s, k: s + k * k).alias("s"), v.alias("v")))
    df = df.withColumn("_best", F.array_max(size))
    best = F.col("_best")
    unit = {f"{prefix}{i}": F.when(best.s > 0, F.get(best.v, i) / F.sqrt(best.s)).otherwise(F.lit(1.0 if i == 0 else 0.0))
            for i in range(3)}
    return df.withColumns(unit).drop("_q", "_p", "_a", "_b", "_c", "_d", "_e", "_f", "_det", "_x", "_best")
