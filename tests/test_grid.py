"""Maps of overlapping grid cells against loops over cells."""

import itertools
import math
import random

from haptrace.operators import grid

AXES = {"depth": (0.0, 6.0, 1.0, 4.0), "speed": (-1.0, 2.0, 0.5, 0.5)}


def _cells(row):
    out = []
    for name, (lo, hi, step, span) in AXES.items():
        x = row[name]
        n = max(0, math.ceil((hi - lo) / step - 1e-9))
        out.append([i for i in range(n) if x is not None and lo + i * step - span / 2 <= x <= lo + i * step + span / 2])
    return list(itertools.product(*out))


def _sample(spark):
    rng = random.Random(5)
    depth = [*[i / 2 for i in range(-6, 16)], 1e300, -1e300, None, float("nan"), float("inf"), float("-inf")]
    touches = [{"s": f"s{i % 2}", "t": i, "depth": rng.choice(depth) if i % 3 else rng.uniform(-3, 8),
                "speed": rng.choice([-1.25, -1.0, -0.75, 0.0, 0.25, 2.0, 1.75, None, 0.1])} for i in range(300)]
    rf = [{"s": t["s"], "t": t["t"], "vertex_id": v, "rf_mean": None if rng.random() < 0.05 else rng.uniform(0, 9)}
          for t in touches for v in range(6) if rng.random() < 0.5]
    a = spark.createDataFrame([tuple(t.values()) for t in touches], "s string, t int, depth double, speed double")
    b = spark.createDataFrame([tuple(t.values()) for t in rf], "s string, t int, vertex_id int, rf_mean double")
    return touches, rf, a, b


def test_grid_maps_equal_a_loop_over_cells(spark):
    touches, rf, a, b = _sample(spark)
    sizes, maps, cells = {}, {}, {}
    for t in touches:
        cells[t["s"], t["t"]] = _cells(t)
        for c in cells[t["s"], t["t"]]:
            sizes[t["s"], *c] = sizes.get((t["s"], *c), 0) + 1
    for m in rf:
        for c in cells[m["s"], m["t"]]:
            maps.setdefault((m["s"], *c, m["vertex_id"]), []).append(m["rf_mean"])
    want = {}
    for key, values in maps.items():
        known = [v for v in values if v is not None]
        if len(values) >= max(1, round(0.3 * sizes[key[:3]])):
            want[key] = (sum(known) / len(known) if known else None, len(values), sizes[key[:3]])
    got = {(r["s"], r["i_depth"], r["i_speed"], r["vertex_id"]): (r["value"], r["n_unique"], r["n_touches"])
           for r in grid.grid_maps(a, b, AXES, 0.3, ["s"], ["s", "t"]).collect()}
    assert set(got) == set(want) and len(want) > 100
    for key, (value, *counts) in want.items():
        assert list(got[key][1:]) == counts
        assert got[key][0] == value or abs(got[key][0] - value) < 1e-12


def test_pieces_are_bounded_by_the_axis_not_by_the_overlap(spark):
    rows = spark.range(4000).selectExpr("CAST(id AS INT) AS t", "id / 100.0D AS depth")
    for span in (1.0, 39.0):
        axes = {"depth": (0.0, 40.0, 1.0, span)}
        ends = grid.pieces(rows, axes)
        assert ends.count() <= 4000  # one row a touch
        assert ends.select("f_depth", "l_depth").distinct().count() <= 2 * 40 + 1


def test_a_small_cell_beside_a_crowded_one_keeps_its_precision(spark):
    a = spark.createDataFrame([("s", i, 0.0) for i in range(50)] + [("s", 99, 3.0)], "s string, t int, depth double")
    b = spark.createDataFrame([("s", i, 1, 1e17) for i in range(50)] + [("s", 99, 1, 0.1)], "s string, t int, vertex_id int, rf_mean double")
    got = {r["i_depth"]: r["value"] for r in grid.grid_maps(a, b, {"depth": (0.0, 4.0, 1.0, 1.0)}, 0.0, ["s"], ["s", "t"]).collect()}
    assert got == {0: 1e17, 3: 0.1}


def test_no_touch_and_no_map_give_no_cell(spark):
    _, _, a, b = _sample(spark)
    assert grid.grid_maps(a.limit(0), b, AXES, 0.3, ["s"], ["s", "t"]).count() == 0
    assert grid.grid_maps(a, b.limit(0), AXES, 0.3, ["s"], ["s", "t"]).count() == 0
