"""Buckets that a task can hold: hot buckets are cut into blocks, whose pairs are met in different tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 1024


def paired_blocks(rows: DataFrame, keys: list[str], spread: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of every bucket with two rows or more, laid out so that each pair of a bucket meets in one (keys, lo, hi).

    A bucket of at most ``block_rows`` rows is one block. A larger one is dealt by ``spread`` into g
    blocks, and a row goes to the g cells that hold its block; so no task needs the whole bucket.
    Adds ``lo``, ``hi`` and ``side``; in a cell with lo < hi only rows of different sides are to be paired.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    blocks = F.ceil(F.col("__n") / F.lit(float(block_rows))).cast("int")
    dealt = (
        rows.join(sizes, keys)
        .withColumn("__g", blocks)
        .withColumn("side", F.pmod(F.xxhash64(spread), F.col("__g")).cast("int"))
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__g") - 1)))
    )
    return dealt.withColumns({"lo": F.least("side", "__o"), "hi": F.greatest("side", "__o")}).drop("__n", "__g", "__o")


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a sorted partition, cut only between groups of ``keys``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[keys].iloc[-1]
        new = np.flatnonzero((frame[keys] != last).any(axis=1).to_numpy())
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and (cut or (held[-1][keys].iloc[-1] != last).any()):
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def run_pairs(frame: pd.DataFrame, keys: list[str], near: np.ndarray | None = None, reach: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows to be compared, by growing distance inside the runs of equal ``keys``.

    If the runs are sorted by ``near``, only pairs within ``reach`` of each other there are met.
    """
    n = len(frame)
    new = np.ones(n + 1, dtype=bool)
    values = [frame[k].to_numpy() for k in keys]
    new[1:n] = np.logical_or.reduce([v[1:] != v[:-1] for v in values]) if n > 1 else False
    starts = np.flatnonzero(new)
    ends = np.repeat(starts[1:], np.diff(starts))
    lo, hi, side = (frame[c].to_numpy() for c in ("lo", "hi", "side"))
    left = np.arange(n)
    step = 1
    while True:
        left = left[left + step < ends[left]]
        if near is not None:
            left = left[near[left + step] - near[left] <= reach]
        if not len(left):
            return
        right = left + step
        meant = (lo[left] == hi[left]) | (side[left] != side[right])
        if meant.any():
            yield left[meant], right[meant]
        step += 1


def merged(n: int, left: np.ndarray, right: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest name that its links reach."""
    label = name.copy()
    while len(left):
        low = np.minimum(label[left], label[right])
        changed = (label[left] != low) | (label[right] != low)
        if not changed.any():
            break
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
    return label
