"""Exact copies by a content sort, with DataFrame functions only.

Texts are equal when identical after deleting the six ASCII white-space characters. Sampled
splitters range-partition the sort key, an external sort puts equal contents side by side, and
neighbours are compared over their full contents (the sorted window is keyed by the whole
normalised text). The splitters see a short head of the content and a hash of all of it, so what
the driver holds of them is bounded, and a salt, so that a text with a third of all copies is
sorted by many tasks. The few runs of one text are then merged by its SHA-256.

Defined results
* null text: the empty text. All texts without content are equal.
* Of equal texts the row with the most code points in the original text stays, then the smallest
  id; a null id comes last.
* Repeated rows (same id, same text): exactly one of them stays.
* An empty table gives an empty result. Other columns are carried along by ``keep_one`` untouched;
  a column with the name of a result or work column is replaced in ``find_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haptrace.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
HEAD_CHARS = 24
SALTS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _sorted_runs(docs: DataFrame, carried: list[Column], id_col: str, text_col: str) -> DataFrame:
    """Rows with the place and size of their run: the rows of equal text under one salt."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__norm"), F.length(text).alias("__chars"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("__salt"), *carried,
    ).withColumns({"__head": F.substring("__norm", 1, HEAD_CHARS), "__hash": F.xxhash64("__norm")})
    ranged = keyed.repartitionByRange("__head", "__hash", "__salt")
    run = Window.partitionBy("__head", "__hash", "__salt", "__norm").orderBy(F.desc("__chars"), F.asc_nulls_last("__id"))
    return ranged.withColumn("__place", F.row_number().over(run))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    runs = _sorted_runs(docs, [], id_col, text_col).select(
        "__id", "__chars", "__salt", "__place", F.sha2(F.encode("__norm", "UTF-8"), 256).alias("text_sha256"))
    # Only ids, lengths and digests go on from here; the sorted texts are not needed again.
    runs = cut_lineage(runs)
    salted = runs.groupBy("text_sha256", "__salt").agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("__place") == 1, F.col("__chars"))).alias("__chars"),
        F.max(F.when(F.col("__place") == 1, F.col("__id"))).alias("__id"))
    order = F.struct((-F.col("__chars")).alias("c"), F.col("__id").isNull().alias("z"), F.col("__id").alias("i"))
    best = salted.groupBy("text_sha256").agg(
        F.sum("__n").alias("group_size"), F.min(F.struct(order.alias("o"), F.col("__salt").alias("s"))).alias("__best"))
    # Written, so that both sides of the join are plain shuffles, of which a hot text's can be split.
    best = cut_lineage(best.select("text_sha256", "group_size", F.col("__best.o.i").alias("keep_id"), F.col("__best.s").alias("__best_salt")))
    return runs.join(best, "text_sha256").select(
        F.col("__id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        ((F.col("__salt") == F.col("__best_salt")) & (F.col("__place") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    The first row of every run goes on; the at most ``SALTS`` runs of a text then meet once more.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    firsts = _sorted_runs(docs, [row], id_col, text_col).filter(F.col("__place") == 1)
    firsts = firsts.withColumn("__sha", F.sha2(F.encode("__norm", "UTF-8"), 256)).select("__sha", "__chars", "__id", "__salt", "__row")
    same = Window.partitionBy("__sha").orderBy(F.desc("__chars"), F.asc_nulls_last("__id"), "__salt")
    kept = firsts.withColumn("__place", F.row_number().over(same)).filter(F.col("__place") == 1)
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
