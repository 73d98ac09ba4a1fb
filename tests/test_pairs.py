"""Two-sample statistics of all pairs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from haptrace.operators import stats
from haptrace.operators.pairs import pair_statistics


def plain(rows):
    out = {}
    groups = {}
    for stratum, sensor, value in rows:
        if None not in (stratum, sensor, value):
            groups.setdefault(stratum, {}).setdefault(sensor, []).append(value)
    for stratum, sensors in groups.items():
        names = sorted(sensors)
        for n, a in enumerate(names):
            for b in names[n + 1:]:
                x, y = sensors[a], sensors[b]
                both = sorted(x + y)
                rank = {v: both.index(v) + (both.count(v) + 1) / 2 for v in set(both)}
                gap = max(abs(sum(u <= v for u in x) / len(x) - sum(u <= v for u in y) / len(y)) for v in both)
                ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
                out[stratum, a, b] = (len(x), len(y), gap, sum(rank[v] for v in x), ties)
    return out


@pytest.mark.parametrize("limit", [200_000, 25])
def test_all_pairs(spark, limit):
    rng = random.Random(3)
    rows = [(stratum, sensor, round(rng.gauss(n, 3), rng.choice([0, 3]))) for stratum in (1, 2) for n, sensor in enumerate("abcde") for _ in range(rng.randrange(1, 60))]
    # A sensor alone in its stratum, one value for all, and rows that don't count.
    rows += [(3, "a", 1.0)] * 3 + [(4, s, 7.0) for s in "ab" for _ in range(40)] + [(None, "a", 1.0), (1, None, 1.0), (1, "a", None)]
    found = pair_statistics(spark.createDataFrame(rows, "stratum int, sensor string, value double"), ["stratum"], "sensor", "value", limit)
    got = {(r["stratum"], r["a"], r["b"]): (r["na"], r["nb"], r["gap"], r["rank_sum"], r["ties"]) for r in found.collect()}
    expected = plain(rows)
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values)


def test_shuffled_rows_do_not_grow_with_the_sensors(spark):
    """No row is sent to pairs: the plan has no join or explode of the counted values over the sensors."""
    df = spark.range(1000).select((F.col("id") % 50).alias("sensor"), (F.col("id") % 7).alias("stratum"), F.rand(1).alias("value"))
    plan = stats.ks_pairs(df, ["stratum"], "sensor", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert stats.mann_whitney_pairs(df, ["stratum"], "sensor", "value").count() == 7 * 50 * 49 / 2
