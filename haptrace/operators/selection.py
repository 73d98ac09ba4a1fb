"""Selections of touches: feature boxes with their heat maps, group labels on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haptrace.operators import bins as B
from haptrace.operators import surface as S
from haptrace.schema import KEYS


def feature_box(touches: DataFrame, box: dict[str, tuple[float, float]], gestures: list[str] | None = None) -> DataFrame:
    """Touches whose features lie in the closed ranges of ``box``, of the named gestures if any are named."""
    out = touches
    for column, (low, high) in box.items():
        out = out.filter(F.col(column).between(low, high))
    return out if gestures is None else out.filter(F.col("gesture_type").isin(gestures))


def box_heatmap(touches: DataFrame, hits: DataFrame, box: dict[str, tuple[float, float]], value: str, percent: float,
                gestures: list[str] | None = None, keys: list[str] = KEYS, rows: int | None = None) -> DataFrame:
    """Population heat maps made again from the touches in the box alone."""
    chosen = feature_box(touches, box, gestures).select(*keys).distinct()
    return S.population_heatmap(hits.join(chosen, keys, "left_semi"), value, percent, keys, rows)


def group_labels(touches: DataFrame, continuous: dict[str, int], categorical: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One label per touch: quantile bins over all touches, then categories, joined by ``_``.

    A touch without one of the features has no label and no row; edges come from all known values.
    """
    parts = [B.quantile_bin(touches, c, q)[0] for c, q in continuous.items()] + [F.col(c) for c in categorical]
    known = touches.select(*keys, *[p.cast("string").alias(f"_part_{i}") for i, p in enumerate(parts)]).na.drop(
        subset=[f"_part_{i}" for i in range(len(parts))])
    return known.select(*keys, F.concat_ws("_", *[f"_part_{i}" for i in range(len(parts))]).alias("group_label")).distinct()


def with_group_labels(frames: DataFrame, labels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Frames of the labelled touches with their label; frames of other touches drop out."""
    return frames.join(labels.select(*keys, "group_label"), keys)
