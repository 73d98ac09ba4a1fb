"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Largest group that one task may hold; larger groups take the split path.
GROUP_ROWS_CONF = "haptrace.group.rows"
GROUP_ROWS_DEFAULT = 200_000
# Rows of the frame index covered by one chunk of an ordered operator.
CHUNK_ROWS_CONF = "haptrace.chunk.rows"
CHUNK_ROWS_DEFAULT = 65_536


def build_session(app: str = "haptrace", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def group_limit(df: DataFrame) -> int:
    return setting(df.sparkSession, GROUP_ROWS_CONF, GROUP_ROWS_DEFAULT)


def chunk_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, CHUNK_ROWS_CONF, CHUNK_ROWS_DEFAULT)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so an iterative plan survives the loss of executors.

    The folder is the shared one the cluster names in ``spark.checkpoint.dir``;
    only a local master may fall back to a scratch folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
