"""Readers, result tables and the chained stages."""

import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haptrace.plans import workflow as WF
from haptrace.sources import frames as SRC
from haptrace.sources import stores

N = 240


@pytest.fixture(scope="module")
def recordings():
    """Two sessions in the file layout of the recordings: 4 touches of 60 frames each."""
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    rng = np.random.default_rng(0)
    for s, session in enumerate(("day_ST12-01", "day_ST13-02")):
        i = np.arange(N)
        touch = i // 60 + 1
        seen = i % 3 == 0
        kind = np.where(touch % 2 == 0, "tap", "stroke")
        pdf = pd.DataFrame({
            "source_block_file": "rec_block-order-07_x.csv", "trial_id": 1, "single_touch_id": np.where(seen, touch, np.nan), "time": i / 1000,
            "type_metadata": np.where(seen, kind, None), "contact_area_metadata": np.where(seen, "whole hand", None),
            "contact_depth": np.where(seen, i % 60 + s, np.nan), "contact_area": np.where(seen, 2.0, np.nan),
            "contact_location_x": np.where(seen, np.where(touch == 1, i, -i), np.nan), "contact_location_y": np.where(seen, 1.0, np.nan),
            "contact_location_z": np.where(seen, 0.0, np.nan), "contact_detected": 1, "Nerve_spike": (rng.random(N) < 0.1).astype(int),
            "Nerve_freq": np.where(i % 60 > 20, 5.0, 0.0)})
        for sticker in ("blue", "green", "yellow"):
            for a in "xyz":
                pdf[f"sticker_{sticker}_position_{a}"] = np.where(seen, i * 0.5, np.nan)
        from haptrace.schema import FRAME_SCHEMA
        folder = root / session
        folder.mkdir()
        pdf = pdf.reindex(columns=FRAME_SCHEMA.fieldNames())
        for c in ("trial_id", "single_touch_id", "contact_detected", "led_on", "Nerve_spike"):
            pdf[c] = pdf[c].astype("Int64")
        pdf.to_csv(folder / f"{session}_semicontrolled_aggregated_session.csv", index=False)
    return root


def test_row_order_survives_split_files(spark, recordings):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    df = SRC.read_sessions(spark, str(recordings), ["time", "contact_depth"])
    assert df.rdd.getNumPartitions() > 4
    got = df.orderBy("session_id", "frame_idx").toPandas()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got.session_id.unique()) == ["day_ST12-01", "day_ST13-02"]
    for _, g in got.groupby("session_id"):
        assert np.allclose(g.time, np.arange(N) / 1000) and g.frame_idx.is_unique
    assert got.contact_depth.isna().sum() == 2 * (N - N // 3)


def test_session_files(spark, recordings):
    got = {r.session_id for r in SRC.session_files(spark, str(recordings)).collect()}
    assert got == {"day_ST12-01", "day_ST13-02"}


def test_headers_decide_the_columns(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    name = "_semicontrolled_aggregated_session.csv"
    files = {
        f"day_ST12-01/a{name}": "time,contact_depth,frame_index,note\n0.0,1.5,7,x\n0.1,,8,y\n",
        f"day_ST12-01/b{name}": "time,contact_depth\n9.0,9.0\n",
        f"day_ST13-02/c{name}": "contact_depth,green_levels,time\n2.5,0.25,0.0\n3.5,0.5,0.1\n",
        f"day_ST14-01/d{name}": "time,contact_depth,time\n",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    df = SRC.read_sessions(spark, str(root))
    got = df.orderBy("contact_depth").toPandas()
    assert dict(df.dtypes)["frame_index"] == "double" and dict(df.dtypes)["note"] == "string" and dict(df.dtypes)["green_levels"] == "double"
    assert got.contact_depth.dropna().tolist() == [1.5, 2.5, 3.5] and len(got) == 4
    assert got.time.tolist().count(9.0) == 0 and got.contact_area.isna().all()
    assert sorted(got.frame_index.dropna()) == [7, 8] and sorted(got.green_levels.dropna()) == [0.25, 0.5]
    assert not df.groupBy("session_id", "frame_idx").count().filter("count > 1").count()
    assert SRC.read_sessions(spark, str(root), ["time", "frame_index", "absent"]).columns == ["session_id", "frame_idx", "time", "frame_index"]


def test_headers_of_many_files_take_one_scan(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    name = "_semicontrolled_aggregated_session.csv"
    for i in range(500):
        folder = root / f"day 1%20b_ST{10 + i}-01"
        folder.mkdir()
        (folder / f"a{name}").write_text("" if i == 7 else f"{'time,contact_depth' if i % 2 else 'contact_depth,extra,extra'}\n" + f"{i},{i}.5,0\n" * 3)
    files = [str(next(f.glob("*.csv"))) for f in sorted(root.iterdir())]
    context = spark.sparkContext
    context.setJobGroup("headers of many files", "")
    try:
        got = SRC.headers(spark, [f"file:{f}" for f in files])
        # Listing the files and reading their first lines.
        assert len(context.statusTracker().getJobIdsForGroup("headers of many files")) <= 2
    finally:
        context._jsc.clearJobGroup()
    assert {k: len(v) for k, v in got.items()} == {("time", "contact_depth"): 249, ("contact_depth", "extra", "extra.1"): 250}
    df = SRC.read_sessions(spark, str(root))
    assert df.count() == 499 * 3 and df.filter("contact_depth IS NULL").count() == 0
    assert SRC.headers(spark, []) == {}


def test_first_line_of_a_long_file(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    Path(root, "a.csv").write_text("time,x\n" + "1.0,2.0\n" * 200_000)
    Path(root, "b.csv").write_text("y\r\n1\r\n")
    assert SRC.headers(spark, [f"file:{root}/{n}.csv" for n in "ab"]) == {
        ("time", "x"): [f"file:{root}/a.csv"], ("y",): [f"file:{root}/b.csv"]}


def test_stages_end_to_end(spark, recordings):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    prepared, counts = WF.run_preparation(spark, str(recordings), out)
    assert {tuple(r)[1:] for r in counts.collect()} == {(2, 1, 1)}
    assert prepared.select("block_order_id").distinct().collect()[0][0] in ("07", "7", 7)
    series = WF.run_series(prepared, {"hand_position": {}, "velocity_amplitude": {}, "pressure": {}})
    tables = WF.run_features(series, {"mean": {}, "max": {}, "spike_count": {}, "median": {"enabled": False}}, out)
    assert set(tables) == {"mean", "max", "spike_count"}
    labelled = WF.run_clustering(tables, ["mean", "max", "spike_count"], {"contact_depth": ["mean", "max"], "pressure": ["max"]},
                                 {"bins": {"method": "cartesian_binning", "n_bins": 2}}, quality=False)
    rows, meta = labelled["bins"]
    assert rows.count() == 8 and meta["missing"] == []
    res = WF.run_comparing(rows.withColumn("cluster_label", F.lit(0)), ["bias", "precision", "distribution"], "spike_count", min_instances=2)
    assert {r.strategy for r in res.collect()} == {"bias", "precision", "distribution"}
    back = stores.read_store(spark, f"{out}/features_max", "features", session_id="day_ST12-01")
    assert back.count() == 4


def test_export_writes_missing_as_null(spark):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "a int, b double")
    stores.export_json(df, out + "/j")
    assert '"b":null' in "".join(r.value for r in spark.read.text(out + "/j").collect())
    stores.export_csv(df.withColumn("s", F.struct(F.lit(1).alias("x"))), out + "/c")
    assert spark.read.option("header", "true").csv(out + "/c").columns == ["a", "b", "s_x"]
