"""Stages of the touch analysis, chained as DataFrames with optional tables in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from haptrace.operators import density, models  # noqa: F401  (register their clusterers)
from haptrace.operators import features as FT
from haptrace.operators import prepare as P
from haptrace.operators import series as S
from haptrace.operators import stats as ST
from haptrace.operators.clusters import cluster
from haptrace.operators.ordered import has_large_groups
from haptrace.sources import frames as SRC
from haptrace.sources import stores
from haptrace.schema import GESTURES, KEYS


def enabled(profiles: dict[str, dict]) -> dict[str, dict]:
    """Profiles that are not switched off, without the switch."""
    return {n: {k: v for k, v in p.items() if k != "enabled"} for n, p in profiles.items() if p.get("enabled", True)}


def combinations(config: dict) -> dict[str, list[str]]:
    """Feature combinations; the older ``extraction_profiles`` become one per profile."""
    if "feature_combinations" in config:
        return {n: list(p.get("features", [])) for n, p in enabled(config["feature_combinations"]).items()}
    return {n: list(p.get("aggregations", [p.get("method", n)])) for n, p in enabled(config.get("extraction_profiles", {})).items()}


def keep(df: DataFrame, root: str | None, name: str) -> DataFrame:
    """Write the stage to its table and go on from there, or pass it through."""
    if root is None:
        return df
    stores.write_store(df, root, name)
    return stores.read_store(df.sparkSession, root, name)


def run_preparation(spark: SparkSession, source: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Prepared frames of all sessions and their gesture counts."""
    prepared = keep(P.prepare(SRC.read_sessions(spark, source)), root, "prepared")
    return prepared, P.gesture_counts(prepared)


def run_series(prepared: DataFrame, transforms: dict[str, dict], root: str | None = None) -> DataFrame:
    return keep(S.series(prepared, enabled(transforms)), root, "series")


def run_features(frames: DataFrame, features: dict[str, dict], root: str | None = None) -> dict[str, DataFrame]:
    """One table per feature; the plain aggregations share a single pass."""
    chosen = enabled(features)
    split = has_large_groups(frames.select(*KEYS), KEYS)
    plain = [f for f in chosen if f in FT.AGGREGATIONS]
    out: dict[str, DataFrame] = {}
    if plain:
        wide = FT.statistical(frames, plain, split=split)
        shared = [c for c in wide.columns if c in (*KEYS, "type_metadata", "gesture_type", "spike_elicited") or c.startswith("mean_contact_")]
        out = {f: wide.select(*shared, *[c for c in wide.columns if c.endswith(f"_{f}")]) for f in plain}
    out |= {f: FT.extract_feature(f, frames, **o) for f, o in chosen.items() if f not in plain}
    if root is not None:
        for name, table in out.items():
            stores.write_store(table.withColumn("feature", F.lit(name)), f"{root}/features_{name}", "features")
    return out


def run_clustering(tables: dict[str, DataFrame], features: list[str], spec: dict[str, list[str]], profiles: dict[str, dict],
                   reduction: dict | None = None, per_gesture: bool = False, quality: bool = True,
                   stability_rounds: int = 20) -> dict[str, tuple[DataFrame, dict]]:
    """Merge, select, drop incomplete rows, reduce, then label with every clusterer."""
    merged = FT.merge_features([tables[f] for f in features])
    columns, missing = FT.feature_columns(merged.columns, spec)
    if not columns:
        raise ValueError(f"no feature column found; missing {missing}")
    rows = merged.na.drop(subset=columns)
    groups = {g: rows.filter(F.col("gesture_type") == g) for g in GESTURES} if per_gesture else {"all": rows}
    out = {}
    for gname, part in groups.items():
        reduced, names, rmeta = models.reduce_features(part, columns, **(reduction or {}))
        for pname, profile in enabled(profiles).items():
            options = {k: v for k, v in profile.items() if k != "method"}
            labelled, meta = cluster(profile["method"], reduced, names, options)
            meta |= {"reduction": rmeta, "missing": missing}
            if quality and dict(labelled.dtypes)["cluster_label"] != "string":
                meta["quality"] = models.centroid_quality(labelled, names)
                meta["silhouette"] = models.silhouette(labelled, names)
                if stability_rounds:
                    meta["bootstrap_ari"] = models.stability(reduced, names, profile["method"], options, stability_rounds)
            out[f"{gname}/{pname}" if per_gesture else pname] = (labelled, meta)
    return out


def run_comparing(labelled: DataFrame, methods: list[str], measurement: str, sensor: str = "session_id",
                  min_instances: int = 5, min_sensors: int = 2, weighting: str = "inverse_dispersion",
                  dispersion: dict[int, float] | None = None) -> DataFrame:
    """Every comparator on every covered stratum, then weights across strata.

    ``dispersion`` is that of the clusterer's metadata, one number per stratum; strata without one have 0.
    """
    stratum = ["gesture_type", "cluster_label"] if dict(labelled.dtypes)["cluster_label"] == "string" else ["cluster_label"]
    results = ST.compare(labelled, methods, stratum, sensor, measurement, min_rows=min_instances, min_sensors=min_sensors)
    known = F.create_map(*[F.lit(x) for k, v in (dispersion or {}).items() for x in (str(k), float(v))]) if dispersion else F.create_map().cast("map<string,double>")
    results = results.withColumn("stratum_dispersion", F.coalesce(known[F.col("cluster_label").cast("string")], F.lit(0.0)))
    return ST.synthesize(results, "stratum_dispersion" if weighting == "inverse_dispersion" else None)


STAGES: dict[str, Callable] = {
    "preparation": run_preparation, "series": run_series, "features": run_features, "clustering": run_clustering, "comparing": run_comparing,
}
