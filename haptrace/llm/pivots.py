"""Near copies of vectors by a pivot-permutation index.

A vector is described by its ``order`` nearest reference points in the order of their nearness. It stands in
the inverted lists of all its pivots; vectors are to share ``shared`` of them, so the lists are kept by
``shared``-subsets (three single lists already intersected), and a pair is met in the list of its
smallest common pivots alone. There the shared pivots are counted by their places: a pivot at places r
and s counts ``order`` - max(r, s), which is the footrule distance of the two permutations turned
around. Pairs below ``MIN_AGREEMENT`` are discarded, the others verified by the cosine in
double precision. Long lists are cut into blocks that meet pairwise in different tasks; a task gives
back sums and one link per vector, no pairs. Equal vectors of a label are one class with a count and a number of its own.

References are ``pivot_count(rows)`` vectors out of a bounded sample of about ``SAMPLE_PIVOTS`` times as
many rows, drawn by a hash of the vector; one within ``SPACING`` of an earlier one is passed over, so a
crowd of near copies gives one reference and not an unstable order of many. Random directions
fill up a dimension that has too few. Every row is indexed.

Defined results
* A null, empty or zero vector, one with a null or non-finite component, and one with a null label link with nothing.
* Vectors of different lengths never link.
* Links count rows: equal rows link with each other. Rows that repeat an id are rows of their own, with
  the links of their own vector and label.
* The smallest id names a component; its name is null if no id reaches it. A null id is kept only there.
* An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from haptrace.llm.blocks import BLOCK_ROWS, merged, paired_blocks, run_pairs, whole_groups
from haptrace.llm.components import components
from haptrace.session import cut_lineage

MIN_COSINE = 0.98
ORDER = 6
SHARED = 3
MIN_PIVOTS, MAX_PIVOTS = 128, 1024
SAMPLE_PIVOTS = 4
SPACING = 0.6
# Least agreement of two permutations, of at most order * (order + 1) / 2.
MIN_AGREEMENT = 6


def pivot_count(rows: int) -> int:
    """Grows with the square root of the table, from 128 at 100,000 rows to 1024 at most."""
    return int(np.clip(MIN_PIVOTS * (rows / 1e5) ** 0.5, MIN_PIVOTS, MAX_PIVOTS))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    size = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.coalesce(vector.isNotNull() & ~bad & (size > 0), F.lit(False))


def references(classes: DataFrame, count: int, rows: int) -> dict[int, np.ndarray]:
    """Unit reference vectors by dimension, at most ``count`` of each, spaced out."""
    chance = F.pmod(F.xxhash64("vector", F.lit("pivot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = classes.filter(chance < min(1.0, SAMPLE_PIVOTS * count / max(1, rows))).select("vector", chance.alias("c")).collect()
    found: dict[int, list[list[float]]] = {}
    for row in sorted(drawn, key=lambda r: (r["c"], r["vector"])):
        found.setdefault(len(row["vector"]), []).append(row["vector"])
    return {size: _spaced(_unit(np.array(vectors, dtype=np.float64)), count) for size, vectors in found.items()}


def _spaced(unit: np.ndarray, count: int) -> np.ndarray:
    kept = unit[:0]
    for vector in unit:
        if len(kept) < count and (kept @ vector < SPACING).all():
            kept = np.concatenate([kept, vector[None]])
    return kept


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _filled(sampled: dict[int, np.ndarray], size: int, count: int) -> np.ndarray:
    have = sampled.get(size, np.zeros((0, size)))
    more = np.random.default_rng(size).normal(size=(count - len(have), size))
    return np.concatenate([have, _unit(more)]) if len(more) else have


def describe(classes: DataFrame, sampled: dict[int, np.ndarray], count: int, order: int = ORDER) -> DataFrame:
    """(label, cls, n, size, pivots, vector): the ``order`` nearest pivots, the nearest first."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[int, np.ndarray] = {}
        for frame in frames:
            sizes = frame["vector"].map(len)
            for size, part in frame.groupby(sizes):
                if size not in whole:
                    whole[size] = _filled(sampled, size, count)
                unit = _unit(np.array(part["vector"].tolist(), dtype=np.float64))
                near = np.argsort(-(unit @ whole[size].T), axis=1, kind="stable")[:, :order]
                yield pd.DataFrame({
                    "label": part["label"].to_numpy(), "cls": part["cls"].to_numpy(), "n": part["n"].to_numpy(), "size": np.int32(size),
                    "pivots": list(near.astype(np.int32)), "vector": [v.tobytes() for v in unit]})

    schema = f"label {kind}, cls bigint, n bigint, size int, pivots array<int>, vector binary"
    return classes.select("label", "cls", "n", "vector").mapInPandas(run, schema)


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over the pivots that two descriptions share of order - max(place, place), row by row."""
    order = left.shape[1]
    places = np.arange(order)
    weight = order - np.maximum(places[:, None], places[None, :])
    return ((left[:, :, None] == right[:, None, :]) * weight).sum(axis=(1, 2))


def _count_links(min_cosine: float, count: int, least: int = MIN_AGREEMENT):
    keys = ["label", "size", "code", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            pivots = np.array(frame["pivots"].tolist(), dtype=np.int64)
            last = frame["code"].to_numpy() % count
            # Pivots below the largest of the list's choice; those a pair shares must be the choice's own.
            low = np.where(pivots < last[:, None], pivots, -1)
            n, names = frame["n"].to_numpy(), frame["cls"].to_numpy()
            sizes = frame["size"].to_numpy()
            links = np.zeros(len(frame), dtype=np.int64)
            left, right = [], []
            vectors = {s: np.frombuffer(b"".join(frame["vector"][sizes == s]), dtype=np.float64).reshape(-1, s) for s in np.unique(sizes)}
            place = np.zeros(len(frame), dtype=np.int64)
            for s in vectors:
                place[sizes == s] = np.arange((sizes == s).sum())
            for i, j in run_pairs(frame, keys):
                both = ((low[i][:, :, None] == low[j][:, None, :]) & (low[i][:, :, None] >= 0)).sum(axis=(1, 2))
                own = both == SHARED - 1
                i, j = i[own], j[own]
                alike = agreement(pivots[i], pivots[j]) >= least
                i, j = i[alike], j[alike]
                for s in np.unique(sizes[i]):
                    same = sizes[i] == s
                    a, b = i[same], j[same]
                    cosine = np.einsum("ij,ij->i", vectors[s][place[a]], vectors[s][place[b]])
                    a, b = a[cosine >= min_cosine], b[cosine >= min_cosine]
                    np.add.at(links, a, n[b])
                    np.add.at(links, b, n[a])
                    left.append(a)
                    right.append(b)
            if left:
                reached = merged(len(names), np.concatenate(left), np.concatenate(right), names)
                hit = links > 0
                out = pd.DataFrame({"cls": names[hit], "n_links": links[hit], "to": reached[hit]})
                yield out.groupby(["cls", "to"], as_index=False)["n_links"].sum()[["cls", "n_links", "to"]]

    return run


def class_links(described: DataFrame, count: int, min_cosine: float = MIN_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cls, n_links, to): partial sums of linked rows, and the smallest class reached in a block."""
    choices = list(combinations(range(ORDER), SHARED))
    ascending = F.array_sort("pivots")
    code = [sum((ascending[p].cast("long") * count ** (SHARED - 1 - k) for k, p in enumerate(c)), F.lit(0).cast("long")) for c in choices]
    listed = described.select("label", "size", "cls", F.explode(F.array(*code)).alias("code"))
    cells = paired_blocks(listed, ["label", "size", "code"], "cls", block_rows)
    rows = cells.join(described.select("cls", "n", "pivots", "vector"), "cls")
    keys = ["label", "size", "code", "lo", "hi"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(_count_links(min_cosine, count), "cls bigint, n_links bigint, to bigint")


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                min_cosine: float = MIN_COSINE, block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    meant = rows.filter("ok").select("id", "label", "vector")
    classes = meant.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # The number is fixed by the checkpoint, and no other class has it.
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    count = pivots or pivot_count(n)
    described = cut_lineage(describe(classes, references(classes, count, n), count))
    found = cut_lineage(class_links(described, count, min_cosine, block_rows))
    sums = found.groupBy("cls").agg(F.sum("n_links").alias("links"))
    joined = components(found.select(F.col("cls").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "cls")
    told = classes.join(sums, "cls", "left").join(joined, "cls", "left").select(
        "label", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    named = told.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = meant.join(told.join(named, "component").select("label", "vector", "n_links", "component_id"), ["label", "vector"])
    linked = linked.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.filter(~F.col("ok")).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)
