import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haptrace.operators.ordered import ordered, run_lengths
from haptrace.operators.quantiles import percentiles, ranked_values


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "frame_idx": np.arange(n),
                        "v": np.round(rng.normal(size=n), 1), "w": rng.integers(0, 3, n)})
    pdf.loc[rng.random(n) < 0.5, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return df, pdf


@pytest.mark.parametrize("rows", [1, 7, 1000, None])
def test_ordered_matches_pandas_for_any_chunk(frame, rows):
    df, pdf = frame
    got = ordered(df, ["k"], last_known={"f": F.col("v")}, next_known={"b": F.col("v")},
                  previous={"p": F.col("v")}, running={"s": F.col("w")}, total={"t": F.col("w")}, position="i",
                  **({"rows": rows} if rows else {"split": False})).toPandas().sort_values("frame_idx")
    g = pdf.groupby("k")
    assert np.allclose(got.f, g.v.ffill(), equal_nan=True)
    assert np.allclose(got.b, g.v.bfill(), equal_nan=True)
    assert np.allclose(got.p, g.v.shift(), equal_nan=True)
    assert (got.t.values == g.w.transform("sum").values).all()
    assert (got.s.values == g.w.cumsum().values).all()
    assert (got.i.values == g.cumcount().values).all()


def test_run_lengths(spark, frame):
    df, pdf = frame
    spark.conf.set("haptrace.chunk.rows", "11")
    got = run_lengths(df, ["k"], "w", split=True).orderBy("k", "run_id").toPandas()
    spark.conf.unset("haptrace.chunk.rows")
    for k, g in pdf.groupby("k"):
        run = (g.w != g.w.shift()).cumsum()
        assert list(got[got.k == k].run_length) == list(run.value_counts(sort=False).sort_index())


@pytest.mark.parametrize("limit", [20, 100000])
def test_percentiles_small_and_large_path(frame, limit):
    df, pdf = frame
    wanted = {f"p{int(p * 1000)}": ("v", p) for p in (0, 0.01, 0.25, 0.5, 0.75, 0.977, 1)}
    got = percentiles(df, ["k"], wanted, limit=limit).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, (_, p) in wanted.items():
            assert got.loc[k, name] == pytest.approx(np.nanpercentile(g.v, p * 100))


def test_percentiles_large_group_with_a_hot_value(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.sin(F.col("id"))).alias("v"))
    wanted = {"a": ("v", 0.5), "b": ("v", 0.1), "c": ("v", 0.9)}
    got = percentiles(df, [], wanted, limit=1000).first()
    v = df.toPandas().v
    assert [got.a, got.b, got.c] == pytest.approx(list(np.percentile(v, [50, 10, 90])))


@pytest.mark.parametrize("limit", [5, 100000])
def test_ranked_values(frame, limit):
    df, pdf = frame
    got = ranked_values(df, ["k"], "v", {"s": F.col("w")}, limit=limit).toPandas()
    for k, g in pdf.dropna().groupby("k"):
        mine = got[got.k == k].sort_values("v")
        table = g.groupby("v").agg(cnt=("v", "size"), s=("w", "sum"))
        assert list(mine.cnt) == list(table.cnt)
        assert list(mine.before) == list(table.cnt.cumsum() - table.cnt)
        assert list(mine.s_before) == list(table.s.cumsum() - table.s)
