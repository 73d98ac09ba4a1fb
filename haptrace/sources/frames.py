"""Readers for session recordings and their dimension tables."""

from __future__ import annotations

import csv
import re
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from haptrace.functions import columns as C
from haptrace.schema import FRAME_SCHEMA

SESSION_GLOB = "*_semicontrolled_aggregated_session.csv"


def session_files(spark: SparkSession, root: str | list[str], pattern: str | None = SESSION_GLOB) -> DataFrame:
    """(session_id, path): the first matching file of every session folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load(root).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return listed.groupBy("folder").agg(F.min("path").alias("path")).select(C.session_id("path").alias("session_id"), "path")


# Larger than any file: every file becomes one task that stops after its first line.
WHOLE_FILE = 1 << 40
LONG_FILE = 1000  # lines of a first batch


def _names(line: str) -> tuple[str, ...]:
    """Column names of a header line; a repeated name gets the suffix .1, .2 and so on."""
    seen: Counter = Counter()
    out = []
    for n, name in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = name or f"Unnamed: {n}"
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return tuple(out)


def _same_path(path: str) -> str:
    """A listed path and the one a scan reports differ in the slashes after the scheme."""
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", path)


def headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names, in the order given; one job for all files. Files without a line are left out."""
    if not files:
        return {}

    def first_line(batches):
        """A short file is read to its end, as a worker that stops before it is not used again."""
        first = True
        for batch in batches:
            if batch.num_rows and first:
                yield batch.slice(0, 1)
                first = False
            if batch.num_rows >= LONG_FILE:
                return

    own = spark.newSession()  # the split size holds for this scan alone
    own.conf.set("spark.sql.files.maxPartitionBytes", str(WHOLE_FILE))
    own.conf.set("spark.sql.files.openCostInBytes", str(WHOLE_FILE))
    lines = own.read.text(files).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(first_line, "path string, value string")
    found = {_same_path(unquote(r["path"])): r["value"] for r in lines.collect()}  # one line a file
    out: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        if _same_path(path) in found:
            out.setdefault(_names(found[_same_path(path)]), []).append(path)
    return out


def _with_numbers(df: DataFrame, extra: list[str]) -> DataFrame:
    """Columns outside the schema as doubles where every value is a number, else as strings."""
    if not extra:
        return df
    quoted = {c: F.col(f"`{c}`") for c in extra}
    odd = df.agg(*[F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(str(i)) for i, v in enumerate(quoted.values())]).first()
    return df.withColumns({c: v.try_cast("double") for i, (c, v) in enumerate(quoted.items()) if not odd[str(i)]})


def read_sessions(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None,
                  schema: T.StructType = FRAME_SCHEMA, pattern: str | None = SESSION_GLOB) -> DataFrame:
    """The first session file of every folder, with ``session_id`` and ``frame_idx``.

    Columns are matched by header name: those of ``schema`` get its types and are null where a file
    lacks them, others are kept, as doubles if all their values are numbers. Files with equal
    headers are one scan, so there are as many scans as headers; all headers are found in one job.

    ``frame_idx`` grows with the row position in the file.  A file is read in byte blocks:
    a row's place is the start of its block plus its place in the task, and a block holds
    fewer rows than bytes, so later blocks always come out larger.
    """
    files = [r["path"] for r in session_files(spark, paths, pattern).orderBy("path").collect()]  # names only
    known = {f.name: f for f in schema.fields}
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("session_id", T.StringType()), T.StructField("frame_idx", T.LongType())]))
    for header, group in headers(spark, files).items():
        own = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in header])
        df = spark.read.schema(own).option("header", "true").option("nullValue", "").csv(group)
        df = df.select("*", C.session_id(F.col("_metadata.file_path")).alias("session_id"), place.alias("frame_idx"))
        extra = [n for n in header if n not in known and (columns is None or n in columns)]
        out = out.unionByName(_with_numbers(df, extra), allowMissingColumns=True)
    out = out.withColumns({f.name: C.nan_to_null(f"`{f.name}`") for f in out.schema.fields if isinstance(f.dataType, T.DoubleType)})
    if columns is None:
        return out
    return out.select("session_id", "frame_idx", *[F.col(f"`{c}`") for c in columns if c in out.columns])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


VERTEX_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("vertex_id", T.LongType()),
    *[T.StructField(a, T.DoubleType()) for a in "xyz"], *[T.StructField(a, T.IntegerType()) for a in "rgb"]])


def read_vertices(spark: SparkSession, path: str, sessions: list[str] | None = None) -> DataFrame:
    """Surface vertices (session_id, vertex_id, x, y, z[, r, g, b]) from parquet."""
    df = spark.read.schema(VERTEX_SCHEMA).parquet(path)
    return df.filter(F.col("session_id").isin(sessions)) if sessions else df


def read_neuron_types(spark: SparkSession, path: str) -> DataFrame:
    """Unit to neuron type table from a CSV export; join it with ``surface.with_neuron_type``."""
    return spark.read.option("header", "true").csv(path)
