"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Doubles rounded for comparison; whole numbers, strings and flags stay."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            d = per_column.get(f.name, digits)
            # The nudge keeps exact decimal ties from falling either way; + 0.0 clears a -0.0.
            out.append((F.round(F.col(f.name).cast("double") + F.lit(nudge(d)), d) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def nudge(digits: int) -> float:
    return float(f"3.37e-{digits + 2}")


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL text of a rounded, named expression."""
    return f"round(CAST({expr} AS DOUBLE) + {nudge(digits)!r}, {digits}) + 0.0 AS {name}"


def load_all() -> None:
    from haptrace.plans import (  # noqa: F401
        catalog_frames, catalog_bins, catalog_surface, catalog_stats, catalog_raster, catalog_models,
    )
