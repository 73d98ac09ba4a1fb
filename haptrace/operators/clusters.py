"""Clusterers: ``function(df, columns, options) -> (labelled df, metadata)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.operators import bins as B
from haptrace.schema import GESTURES

CLUSTERERS = {
    "binning": lambda df, cols, o: B.binning_labels(df, cols, o.get("n_bins", 5), o.get("bin_method", "equal_width")),
    "cartesian_binning": lambda df, cols, o: B.cartesian_labels(
        df, cols, o.get("n_bins", 3), o.get("n_bins_per_feature"), o.get("bin_method", "equal_width"),
        o.get("outlier_method"), o.get("outlier_params")),
}


def register_clusterer(name: str, fit) -> None:
    CLUSTERERS[name] = fit


def cluster(name: str, df: DataFrame, columns: list[str], options: dict | None = None) -> tuple[DataFrame, dict]:
    """Fit a registered clusterer and label every row with ``cluster_label``."""
    if name not in CLUSTERERS:
        raise ValueError(f"unknown clusterer {name!r}; known: {sorted(CLUSTERERS)}")
    return CLUSTERERS[name](df, columns, options or {})


def type_stratified(df: DataFrame, columns: list[str], options: dict) -> tuple[DataFrame, dict]:
    """A base clusterer per gesture; labels read ``<gesture>_<nn>``, noise stays -1."""
    base = options.get("base", "binning")
    if base == "type_stratified":
        raise ValueError("the base of a stratified clusterer cannot be stratified itself")
    inner = {k: v for k, v in options.items() if k != "base"}
    # Kept by Spark: every gesture reads all rows, and the parts of a union that are hashed alike meet in the same tasks.
    df = df.persist()
    if not df.filter(~F.col("gesture_type").isin(GESTURES) | F.col("gesture_type").isNull()).isEmpty():
        raise ValueError(f"gesture_type must be one of {GESTURES}")
    parts, meta = None, {}
    for g in GESTURES:
        rows = df.filter(F.col("gesture_type") == g)
        if rows.isEmpty():
            continue
        labelled, meta[g] = cluster(base, rows, columns, inner)
        label = F.when(F.col("cluster_label") >= 0, F.format_string(f"{g}_%02d", F.col("cluster_label"))).otherwise("-1")
        labelled = labelled.select(*df.columns, label.alias("cluster_label"))
        parts = labelled if parts is None else parts.unionByName(labelled)
    return parts, {"base": base, "per_gesture": meta}


register_clusterer("type_stratified", type_stratified)
