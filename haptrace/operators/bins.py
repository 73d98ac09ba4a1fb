"""Bin edges, bin assignment, outlier bounds, matrices and histograms.

Edges are small per-column lists found by one aggregate; they go to the driver only as
such (a handful of numbers) and come back as literals, so that assignment is a map.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from haptrace.operators.ordered import has_large_groups
from haptrace.operators.quantiles import percentiles
from haptrace.session import group_limit

OUTLIER_LOW = -2
# Outlier methods with their parameter and default.
OUTLIER_METHODS = {"iqr": ("k", 1.5), "mad": ("threshold", 3.5), "percentile": ("p", 1.0), "tukey": ("k_outer", 3.0)}
MIN_SAMPLES = 4


def _linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / n
    return [lo + i * step for i in range(n)] + [hi]


def equal_frequency_edges(df: DataFrame, columns: list[str], q: int | dict[str, int]) -> dict[str, list[float]]:
    """Linear quantile edges per column, duplicates dropped."""
    parts = {c: q[c] if isinstance(q, dict) else q for c in columns}
    wanted = {f"{c}|{i}": (c, i / n) for c, n in parts.items() for i in range(n + 1)}
    row = percentiles(df, [], wanted).first()
    return {c: sorted({row[f"{c}|{i}"] for i in range(n + 1)} - {None}) for c, n in parts.items()}


def equal_width_edges(df: DataFrame, columns: list[str], bins: int | dict[str, int]) -> dict[str, list[float]]:
    """Edges that split the range evenly; the lowest is widened by 0.1 % of the range."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        n, lo, hi = bins[c] if isinstance(bins, dict) else bins, row[f"lo_{c}"], row[f"hi_{c}"]
        if lo == hi:
            pad = 0.001 * abs(lo) if lo != 0 else 0.001
            out[c] = _linspace(lo - pad, hi + pad, n)
        else:
            edges = _linspace(lo, hi, n)
            out[c] = [lo - (hi - lo) * 0.001, *edges[1:]]
    return out


def right_closed(x: str | Column, edges: list[float], include_lowest: bool = False) -> Column:
    """0-based bin with ``lo < x <= hi``; null outside."""
    c = F.col(x) if isinstance(x, str) else x
    above = sum((F.when(c > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    low = (c >= edges[0]) if include_lowest else (c > edges[0])
    return F.when(low & (c <= edges[-1]), above)


def left_closed(x: str | Column, edges: list[float]) -> Column:
    """0-based bin with ``lo <= x < hi``, the last bin closed; null outside."""
    c = F.col(x) if isinstance(x, str) else x
    above = sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((c >= edges[0]) & (c <= edges[-1]), above)


def _lattice_bin(x: str, edges: list[float]) -> Column:
    """``left_closed``; among even edges by index arithmetic, so a value on an edge lies above it though the edge was rounded up."""
    n = len(edges) - 1
    if edges != _linspace(edges[0], edges[-1], n) or edges[0] == edges[-1]:
        return left_closed(x, edges)
    at = F.least(F.lit(n - 1), F.floor((F.col(x) - edges[0]) / F.lit((edges[-1] - edges[0]) / n) + 1e-12).cast("int"))
    return F.when(F.col(x).between(edges[0], edges[-1]), at)


def quantile_bin(df: DataFrame, column: str, q: int) -> tuple[Column, list[float]]:
    edges = equal_frequency_edges(df, [column], q)[column]
    return right_closed(column, edges, include_lowest=True), edges


def outlier_bounds(df: DataFrame, columns: list[str], method: str, params: dict | None = None) -> DataFrame:
    """One row (column, lower, upper); unbounded below 4 values or without spread."""
    params = params or {}
    if method not in OUTLIER_METHODS:
        raise ValueError(f"unknown outlier method {method!r}; valid: {sorted(OUTLIER_METHODS)}")
    name, default = OUTLIER_METHODS[method]
    if set(params) - {name}:
        raise ValueError(f"unknown outlier parameters {sorted(set(params) - {name})}; valid: {[name]}")
    k = float(params.get(name, default))
    # One pass for the counts and percentiles of all columns; the deviation from the median needs a second.
    split = has_large_groups(df.select(columns[0]), [], group_limit(df))
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if method == "mad":
        med = percentiles(numbers, [], {f"m{i}": (c, 0.5) for i, c in enumerate(columns)}, split=split)
        away = numbers.join(F.broadcast(med)).select(*[F.abs(F.col(c) - F.col(f"m{i}")).alias(c) for i, c in enumerate(columns)])
        mad = percentiles(away, [], {f"d{i}": (c, 0.5) for i, c in enumerate(columns)}, split=split)
        stats = med.join(F.broadcast(mad))

        def ends(i):
            cut = F.when(F.col(f"d{i}") >= 1e-12, F.col(f"d{i}") * k / 0.6745)
            return F.col(f"m{i}") - cut, F.col(f"m{i}") + cut
    else:
        tail = k / 100 if method == "percentile" else 0.25
        wanted = {f"{n}{i}": (c, q) for i, c in enumerate(columns) for n, q in (("a", tail), ("b", 1 - tail))}
        stats = percentiles(numbers, [], wanted, split=split)

        def ends(i):
            pad = F.lit(0.0) if method == "percentile" else (F.col(f"b{i}") - F.col(f"a{i}")) * k
            return F.col(f"a{i}") - pad, F.col(f"b{i}") + pad

    inf = F.lit(float("inf"))
    rows = []
    for i, c in enumerate(columns):
        few, (low, high) = F.col(f"n{i}") < MIN_SAMPLES, ends(i)
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.when(few, -inf).otherwise(F.coalesce(low, -inf)).alias("lower"),
            F.when(few, inf).otherwise(F.coalesce(high, inf)).alias("upper")))
    return stats.join(F.broadcast(counts)).select(F.inline(F.array(*rows))).filter("n > 0").drop("n")


def highest_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the column with the largest sample variance."""
    long = df.agg(*[F.var_samp(c).alias(c) for c in columns]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])))
    return long.agg(F.max_by("feature", "variance").alias("feature"), F.max("variance").alias("variance"))


def _edges(df, columns, bins, method):
    if method not in ("equal_width", "equal_frequency"):
        raise ValueError(f"unknown bin method {method!r}")
    return (equal_frequency_edges if method == "equal_frequency" else equal_width_edges)(df, columns, bins)


def _varying(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def binning_labels(df: DataFrame, columns: list[str], n_bins: int = 5, method: str = "equal_width") -> tuple[DataFrame, dict]:
    """Bin every varying column; the label is the bin of the highest-variance one."""
    use = _varying(df, columns)
    if not use:
        return df.withColumn("cluster_label", F.lit(0)), {"binned_features": [], "primary_feature": None, "bin_edges": {}}
    edges = _edges(df, use, n_bins, method)
    primary = highest_variance(df, use).first()["feature"]
    low = method == "equal_frequency"
    out = df.withColumns({f"bin_{c}": F.coalesce(right_closed(c, edges[c], low), F.lit(-1)) for c in use})
    return out.withColumn("cluster_label", F.col(f"bin_{primary}")), {
        "binned_features": use, "primary_feature": primary, "bin_edges": edges, "n_bins": n_bins}


def cartesian_labels(
    df: DataFrame, columns: list[str], n_bins: int = 3, n_bins_per_feature: dict[str, int] | None = None,
    method: str = "equal_width", outlier_method: str | None = None, outlier_params: dict | None = None,
) -> tuple[DataFrame, dict]:
    """Label = place of the row's bin combination among the occupied ones, in order.

    Low outliers take bin -2, missing values -1, high outliers the bin above the last.
    """
    per = n_bins_per_feature or {}
    if n_bins < 2:
        raise ValueError(f"n_bins must be >= 2, got {n_bins}")
    if set(per) - set(columns):
        raise ValueError(f"n_bins_per_feature has unknown features {sorted(set(per) - set(columns))}")
    use = _varying(df, columns)
    binned, bounds = df, {}
    if use and outlier_method is not None:
        bounds = {b["feature"]: (b["lower"], b["upper"]) for b in outlier_bounds(df, use, outlier_method, outlier_params).collect()}
        binned = df.withColumns({f"_in_{c}": F.when(F.col(c).between(*bounds[c]), F.col(c)) for c in use})
    source = {c: f"_in_{c}" if bounds else c for c in use}
    inner = binned.select(*[F.col(source[c]).alias(c) for c in use])
    edges = _edges(inner, use, {c: per.get(c, n_bins) for c in use}, method) if use else {}
    low = method == "equal_frequency"
    inside = {c: right_closed(source[c], edges[c], low) for c in use}
    top = binned.agg(*[F.coalesce(F.max(inside[c]) + 1, F.lit(per.get(c, n_bins))).alias(c) for c in use]).first() if bounds else {}
    for c in use:
        b = F.coalesce(inside[c], F.lit(-1))
        if bounds:
            b = (F.when(F.col(c).isNull(), -1).when(F.col(c) < bounds[c][0], OUTLIER_LOW)
                 .when(F.col(c) > bounds[c][1], top[c]).otherwise(b))
        binned = binned.withColumn(f"bin_{c}", b.cast("int"))
    kept = _varying(binned, [f"bin_{c}" for c in use]) if use else []
    out = binned.drop(*[f"_in_{c}" for c in use], *[f"bin_{c}" for c in use if f"bin_{c}" not in kept])
    meta = {"binned_features": [k[4:] for k in kept], "bin_edges": {k[4:]: edges[k[4:]] for k in kept}, "outlier_bounds": bounds}
    if not kept:
        return out.withColumn("cluster_label", F.lit(0)), {**meta, "n_clusters": 1}
    # Occupied combinations: at most the product of the bin numbers, so one ordered pass over them is small.
    from pyspark.sql import Window as W

    combos = out.select(*kept).distinct().withColumn(
        "cluster_label", (F.row_number().over(W.orderBy(*kept)) - 1).cast("int"))
    return out.join(combos, kept), meta


def linear_edges(df: DataFrame, column: str, n: int, low_pct: float = 0.0, high_pct: float = 100.0) -> list[float]:
    """``n`` even bins between two percentiles of the pooled values."""
    row = percentiles(df, [], {"lo": (column, low_pct / 100), "hi": (column, high_pct / 100)}).first()
    if row["lo"] is None or not row["lo"] < row["hi"]:
        raise ValueError(f"the range of {column!r} is empty or collapsed")
    return _linspace(row["lo"], row["hi"], n)


def value_windows(lo: float, hi: float, n: int, overlap: float = 0.0) -> list[tuple[float, float]]:
    """``n`` windows of width (hi - lo) / n whose starts move by the part not shared.

    The last window always ends at ``hi``.
    """
    if not 0 <= overlap <= 0.5:
        raise ValueError(f"overlap must lie in [0, 0.5], got {overlap}")
    width = (hi - lo) / n
    starts = [lo + i * width * (1 - overlap) for i in range(n)]
    return [(a, hi if i == n - 1 else a + width) for i, a in enumerate(starts)]


def histogram_edges(df: DataFrame, column: str, n: int = 20, log: bool = False) -> list[float]:
    """Even edges, or geometric ones over the positive values."""
    x = F.col(column)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.min(F.when(x > 0, x)).alias("pos")).first()
    if row["lo"] is None:
        return _linspace(0.0, 1.0, n)
    lo, hi = float(row["lo"]), float(row["hi"])
    if log and row["pos"] is not None:
        first = float(row["pos"])
        last = hi if first < hi else first * 10
        return [math.exp(e) for e in _linspace(math.log(first), math.log(last), n)]
    return _linspace(0.0, 1.0, n) if lo == hi else _linspace(lo, hi, n)


def histogram_2d(df: DataFrame, keys: list[str], x: str, y: str, x_edges: list[float], y_edges: list[float],
                 efficacy: str | None = None) -> DataFrame:
    """Counts (and mean of ``efficacy``) on the full lattice of bins for every key."""
    placed = df.withColumns({"bx": _lattice_bin(x, x_edges), "by": _lattice_bin(y, y_edges)}).filter("bx IS NOT NULL AND by IS NOT NULL")
    aggs = [F.count("*").alias("n")] + ([F.avg(efficacy).alias("mean_efficacy")] if efficacy else [])
    cells = placed.groupBy(*keys, "bx", "by").agg(*aggs)
    lattice = df.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(len(x_edges) - 2))).alias("bx")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(y_edges) - 2))).alias("by"))
    return lattice.join(cells, [*keys, "bx", "by"], "left").na.fill(0, ["n"])


# Signals that the matrices discretise.
KINEMATIC_SIGNALS = ["depth", "area", "velocity", "acceleration", "contact_location_x", "contact_location_y", "contact_location_z"]


def discretization_config(aggregation: str, q: int = 3) -> dict:
    return {"continuous": {f"{s}_{aggregation}": q for s in KINEMATIC_SIGNALS}, "categorical": ["type_metadata", "direction"]}


def encode(df: DataFrame, continuous: dict[str, int], categorical: list[str]) -> tuple[DataFrame, list[dict]]:
    """``<column>_code`` for quantile bins and sorted category levels, with a legend."""
    legend = []
    present = [c for c in continuous if c in df.columns]
    edges = equal_frequency_edges(df, present, {c: continuous[c] for c in present}) if present else {}
    out = df
    for c in present:
        out = out.withColumn(f"{c}_code", F.coalesce(right_closed(c, edges[c], include_lowest=True), F.lit(-1)))
        legend += [{"dimension": c, "code": i, "low": a, "high": b} for i, (a, b) in enumerate(zip(edges[c], edges[c][1:]))]
    from pyspark.sql import Window as W

    for c in [c for c in categorical if c in df.columns]:
        level = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
        levels = df.select(level.alias(c)).distinct().withColumn(f"{c}_code", (F.row_number().over(W.orderBy(c)) - 1).cast("int"))
        out = out.withColumn(c, level).join(levels, c)
    return out, legend


def touch_matrix(df: DataFrame, source: str, codes: list[str], efficacy: str | None = None) -> DataFrame:
    """Long form of the source x code matrix over the occupied code combinations.

    Every source gets a row for every combination; cells without touches are 0.
    """
    agg = F.avg(efficacy).alias("value") if efficacy else F.count("*").cast("double").alias("value")
    cells = df.groupBy(source, *codes).agg(agg)
    # Sources and combinations are small dimension lists; their product is the matrix itself.
    combos = df.select(*codes).distinct().select(F.struct(*codes).alias("_c"))
    lattice = df.select(source).distinct().join(combos, how="cross").select(source, "_c.*")
    return lattice.join(cells, [source, *codes], "left").na.fill(0.0, ["value"])
