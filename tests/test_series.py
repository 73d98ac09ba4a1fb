import numpy as np
from pyspark.sql import functions as F

from haptrace.operators import series as S
from haptrace.plans.inputs import view
from haptrace.schema import KEYS

SF = "/root/testdata/sf0.001"


def test_signed_velocity_matches_svd(spark):
    df = S.velocity(view(spark, SF, "frames"))
    got = S.signed_velocity(df).toPandas()
    for _, g in got.groupby(KEYS):
        v = g[S.VELOCITY].to_numpy()
        mean = v.mean(axis=0)
        _, s, vt = np.linalg.svd(v - mean, full_matrices=False)
        u = vt[0] * (-1 if mean @ vt[0] < 0 else 1)
        want = np.zeros(len(v)) if s[0] < 1e-12 else v @ u
        if len(s) > 1 and s[0] - s[1] < 1e-3 * s[0]:
            continue
        assert np.allclose(g[S.SIGNED], want, rtol=1e-5, atol=1e-3 * (1 + abs(want).max()))


def test_chunked_and_plain_velocity_agree(spark):
    df = view(spark, SF, "frames")
    spark.conf.set("haptrace.chunk.rows", "97")
    a = S.acceleration(S.velocity(df, split=True), split=True)
    spark.conf.unset("haptrace.chunk.rows")
    b = S.acceleration(S.velocity(df, split=False), split=False)
    cols = [*KEYS, "frame_idx", *S.VELOCITY, *S.ACCELERATION]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty()
    assert a.count() == b.count()


def test_series_options_drop_inputs(spark):
    df = view(spark, SF, "raw")
    out = S.series(df, {"hand_position": {"drop_inputs": True}, "pressure": {}})
    assert "sticker_blue_position_x" not in out.columns
    assert {"hand_position_x", "pressure"} <= set(out.columns)
    assert not {"hand_velocity_x"} & set(out.columns)
    assert out.filter(F.col("single_touch_id") == 0).count() == 0
