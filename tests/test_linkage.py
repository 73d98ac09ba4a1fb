"""Leaf order of average linkage against merging the least pair first."""

import random

from haptrace.operators import linkage


def _greedy(names, gap):
    groups = [[n] for n in sorted(names)]
    while len(groups) > 1:
        _, i, j = min((sum(gap[min(x, y), max(x, y)] for x in groups[i] for y in groups[j]) / len(groups[i]) / len(groups[j]), i, j)
                      for i in range(len(groups)) for j in range(i + 1, len(groups)))
        merged = groups[i] + groups[j]
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [merged]
    return groups[0]


def _order(df, name="name"):
    rows = sorted(df.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(len(rows)))
    return [r[name] for r in rows]


def test_leaf_order_equals_greedy_merging(spark):
    rng = random.Random(11)
    names = [f"n{i:02d}" for i in range(18)]
    gap = {(a, b): rng.uniform(0, 2) for a in names for b in names if a < b}
    pairs = spark.createDataFrame([(b, a, d) if i % 2 else (a, b, d) for i, ((a, b), d) in enumerate(gap.items())], "a string, b string, distance double")
    got = _order(linkage.leaf_order(pairs, spark.createDataFrame([(n,) for n in names], "name string")))
    assert got == _greedy(names, gap)


def test_equal_distances_end_and_go_by_name(spark):
    names = ["d", "a", "c", "b"]
    pairs = spark.createDataFrame([(a, b, 1.0) for a in names for b in names if a < b], "a string, b string, distance double")
    assert sorted(_order(linkage.leaf_order(pairs, spark.createDataFrame([(n,) for n in names], "name string")))) == sorted(names)


def test_rows_without_values_come_last_and_single_rows_stay(spark):
    schema = "s string, bin int, v double"
    rows = [("b", 0, 1.0), ("b", 1, 2.0), ("z", 0, None), ("a", 0, None), ("a", 1, None), ("c", 0, 2.0), ("c", 1, 1.0)]
    assert _order(linkage.row_order(spark.createDataFrame(rows, schema), "s", "bin", "v"), "s") == ["b", "c", "a", "z"]
    assert _order(linkage.row_order(spark.createDataFrame(rows[:2], schema), "s", "bin", "v"), "s") == ["b"]
    assert _order(linkage.row_order(spark.createDataFrame([], schema), "s", "bin", "v"), "s") == []
