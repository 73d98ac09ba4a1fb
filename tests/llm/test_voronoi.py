"""Top-k lists against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haptrace.llm import catalog, voronoi

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, k=5):
    ok = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % 50 == 0:
            score = lambda w: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w))))
            found = sorted((-score(w), j is None, j or 0, m) for m, j, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, place + 1, None if null else j, -s) for place, (s, null, j, _) in enumerate(found)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd_rows():
    """Ties, repeated ids and rows, nulls, other lengths, and components beyond 64 bits."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=3).round(1)]) for i in range(400)]
    rows += [(50, [1.0, 2.0, 3.0])] * 4 + [(None, [1.0, 2.0, 3.0])] * 6 + [(-50, [0.0] * 3)]
    rows += [(100, None), (150, [1.0, None, 2.0]), (200, [math.nan] * 3), (250, [math.inf, 1.0, 1.0]), (300, []), (350, []), (400, [1.0])]
    return rows + [(450, [2e30, 1e30]), (451, [3e30, -1e30]), (452, [2e30, 1e30]), (500, [-2e30, 1e30])]


@pytest.mark.parametrize("layout", [{}, {"block_queries": 3, "slice_rows": 20, "pivots": 20}, {"pivots": 2}])
def test_odd_rows(spark, layout):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert rows_of(voronoi.top_k(table, F.col("id") % 50 == 0, **layout)) == plain(rows)
    assert voronoi.top_k(table.filter("false"), F.col("id") % 50 == 0, **layout).collect() == []
    assert voronoi.top_k(table, F.lit(False), **layout).collect() == []


@pytest.mark.parametrize("layout", [{}, {"block_queries": 2, "pivots": 12}])
def test_query_matches_brute_force(spark, layout):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = plain([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert rows_of(voronoi.top_k(table, F.col("id") % 50 == 0, **layout)) == expected
    assert rows_of(catalog.QUERIES["op11_voronoi"](spark, SF)) == expected


def test_bounds_leave_rows_out(spark):
    """Where vectors lie in far bunches, a block is sent its own bunch and little else."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 20
    rows = [(n, [float(x) for x in centres[n % 8] + rng.normal(size=16) * 0.01]) for n in range(1600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    placed = voronoi.quantised(table, "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    pivots = voronoi.choose_pivots(placed, 1600, 64)
    told = voronoi.assign(placed.select("row", "id", "size", "vector"), pivots, 5).withColumn("query", F.col("id") % 50 == 0)
    found = told.filter("query").groupBy("size", "cell").agg(
        F.count("*").alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("longest"), F.min("floor").alias("floor")).collect()
    groups = voronoi.Groups(found, 1)
    sent = voronoi.replicate(told, pivots, groups, 1).filter("kind = 1").count()
    assert groups.blocks >= 8 and sent < 0.4 * 1600 * groups.blocks
