"""Scan-line crossings and parity against a loop over all edges."""

import math

import numpy as np
from pyspark.sql import functions as F

from haptrace.operators import raster as R


def shapes():
    rng = np.random.default_rng(2)
    star = [(float(math.cos(t) * r), float(math.sin(t) * r)) for t, r in zip(np.linspace(0, 2 * math.pi, 40, endpoint=False), rng.uniform(1, 4, 40))]
    square = [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]  # edges and corners on lattice lines
    knot = [(-3.0, -3.0), (3.0, 3.0), (3.0, -3.0), (-3.0, 3.0)]
    return {"star": star, "square": square, "knot": knot, "far": [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)]}


def edges(points):
    return list(zip(points, points[1:] + points[:1]))


def test_parity_matches_all_edges(spark):
    contours = spark.createDataFrame([(k, p) for k, p in shapes().items()], "k string, contour array<struct<u double, v double>>")
    lattice = [(k, i / 2, j / 2, i) for k in (*shapes(), "none") for i in range(-9, 10) for j in range(-9, 10)]
    cells = spark.createDataFrame(lattice, "k string, u double, v double, r int")
    expected = set()
    for k, u, v, r in lattice:
        hits = [u < a[0] + (v - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges(shapes().get(k, [(0.0, 0.0)])) if (a[1] > v) != (b[1] > v)]
        if sum(hits) % 2:
            expected.add((k, u, v, r))
    inside = R.inside_polygon(cells, contours, ["k"])
    assert inside.columns == cells.columns
    found = [tuple(r) for r in inside.collect()]
    assert len(found) == len(set(found)) and set(found) == expected and {k for k, *_ in found} == {"star", "square", "knot"}
    assert R.inside_polygon(cells.filter("false"), contours, ["k"]).collect() == []


def test_crossings_of_both_axes(spark):
    contours = spark.createDataFrame([(k, p) for k, p in shapes().items()], "k string, contour array<struct<u double, v double>>")
    lines = spark.createDataFrame([(k, j / 4) for k in shapes() for j in range(-20, 21)], "k string, line double")
    for along, (i, o) in (("u", (0, 1)), ("v", (1, 0))):
        got = {(r["k"], r["line"]): r["crossings"] for r in R.crossings(contours, lines.union(lines), ["k"], along).collect()}
        expected = {}
        for k, p in shapes().items():
            for j in range(-20, 21):
                at = [a[i] + (j / 4 - a[o]) * (b[i] - a[i]) / (b[o] - a[o]) for a, b in edges(p) if min(a[o], b[o]) <= j / 4 < max(a[o], b[o])]
                if at:
                    expected[k, j / 4] = sorted(at)
        assert got == expected


def test_no_cell_is_joined_with_edges(spark):
    contours = spark.createDataFrame([(1, [(0.0, 0.0)])], "k int, contour array<struct<u double, v double>>")
    cells = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("u"), F.rand(1).alias("v"))
    plan = R.inside_polygon(cells, contours, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the edges of a key with the one row of its lines
