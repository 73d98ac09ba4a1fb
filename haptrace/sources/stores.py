"""Result tables: partitioned parquet, flat CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from haptrace.functions import columns as C

# Result tables and the columns that partition them.
STORES = {
    "prepared": ["session_id"], "series": ["session_id"], "features": ["feature", "session_id"], "touch_rf": ["session_id"],
    "heatmap": ["session_id"], "raster": ["session_id"], "boundary": ["session_id"], "cluster_spikes": ["combination", "clusterer"],
    "cluster_description": ["combination", "clusterer"], "grid_rf": ["session_id"], "grid_cells": ["session_id"], "comparison": ["combination"],
}


def write_store(df: DataFrame, root: str, name: str) -> None:
    """Write a table; a re-run replaces only the partitions it produces."""
    by = STORES[name]
    keys = [F.col(c) for c in by]
    # Rows of a partition are spread by hash, so a large session is written by many tasks.
    spread = df.repartition(*keys, F.pmod(F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(16)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")


def read_store(spark: SparkSession, root: str, name: str, **partitions) -> DataFrame:
    """Read a table; partition values given as keywords prune the scan."""
    df = spark.read.parquet(f"{root}/{name}")
    for column, value in partitions.items():
        df = df.filter(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df


def flat(df: DataFrame) -> DataFrame:
    """Structs spread to columns, NaN to null, arrays and maps to JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            out += [c[g.name].alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(C.nan_to_null(c).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; missing values are written as null."""
    doubles = {f.name: C.nan_to_null(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(doubles).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
