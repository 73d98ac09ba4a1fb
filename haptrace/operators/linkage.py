"""Average linkage by rounds of mutual nearest pairs on a table of distances."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from haptrace.session import cut_lineage


def leaf_order(distances: DataFrame, names: DataFrame) -> DataFrame:
    """(name, place) in the leaf order of the average-linkage tree.

    ``distances`` holds (a, b, distance) once for every pair of ``names`` (name).  A merge never
    brings two clusters nearer to a third than the nearer of them was, so all pairs that are
    nearest to each other may merge in one round; the tree is that of merging the least pair first.
    Equal distances are taken by the least names.  The earlier made cluster lies left: single names
    first, in their order, then clusters by the distance at which they were made.
    """
    members = cut_lineage(names.select("name").distinct().select(
        "name", F.col("name").alias("id"), F.lit(0).cast("long").alias("place"), F.lit(-1.0).alias("height"), F.lit(1).cast("long").alias("size")))
    one = F.lit(1).cast("long")
    pairs = cut_lineage(distances.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("double").alias("d"), one.alias("na"), one.alias("nb")))
    while not pairs.isEmpty():
        merges = _merges(pairs, members)
        into = merges.select(F.inline(F.array(*[
            F.struct(F.col(s).alias("old"), F.col("a").alias("new"), (F.col("na") + F.col("nb")).alias("n")) for s in "ab"])))
        renamed = pairs
        for s in "ab":
            to = into.select(F.col("old").alias(s), F.col("new").alias(f"_{s}"), F.col("n").alias(f"_n{s}"))
            renamed = renamed.join(to, s, "left").withColumns({
                f"_{s}": F.coalesce(f"_{s}", s), f"_n{s}": F.coalesce(f"_n{s}", f"n{s}")})
        # Which side a cluster stands on may change with its name.
        ordered = F.when(F.col("_a") < F.col("_b"), F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_na").alias("na"), F.col("_nb").alias("nb"))).otherwise(
            F.struct(F.col("_b").alias("a"), F.col("_a").alias("b"), F.col("_nb").alias("na"), F.col("_na").alias("nb")))
        weight = F.col("na") * F.col("nb")
        joined = renamed.filter("_a <> _b").select(ordered.alias("_p"), (F.col("d") * weight).alias("_dw"), weight.alias("_w")).groupBy("_p").agg(
            (F.sum("_dw") / F.sum("_w")).alias("d")).select("_p.a", "_p.b", "d", "_p.na", "_p.nb")
        placed = merges.select(F.inline(F.array(*[
            F.struct(F.col(s).alias("id"), F.col("a").alias("_new"), F.when(F.col(s) != F.col("left"), F.col("left_size")).otherwise(0).alias("_shift"),
                     F.col("d").alias("_height"), (F.col("na") + F.col("nb")).alias("_size")) for s in "ab"])))
        members = _fresh(members.join(placed, "id", "left").select(
            "name", F.coalesce("_new", "id").alias("id"), (F.col("place") + F.coalesce("_shift", F.lit(0))).alias("place"),
            F.coalesce("_height", "height").alias("height"), F.coalesce("_size", "size").alias("size")))
        pairs = _fresh(joined)
    return members.select("name", "place")


def _fresh(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read again.

    A checkpoint keeps the size that the optimizer guessed, and the joins of each round multiply the guesses until
    they are numbers of millions of digits; a table read from files has the size of its files.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/linkage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _merges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that are nearest to each other, with the cluster on the left and its size."""
    link = F.struct("d", "a", "b")
    best = pairs.select(F.inline(F.array(*[F.struct(F.col(s).alias("id"), link.alias("link")) for s in "ab"]))).groupBy("id").agg(F.min("link").alias("link"))
    mutual = best.groupBy("link").agg(F.count("*").alias("n")).filter("n = 2").select("link.*")
    made = members.select("id", F.struct("height", "id").alias("_age")).distinct()
    out = mutual.join(pairs.select("a", "b", "na", "nb"), ["a", "b"])
    for s in "ab":
        out = out.join(made.select(F.col("id").alias(s), F.col("_age").alias(f"_age_{s}")), s)
    first = F.col("_age_a") < F.col("_age_b")
    return out.select("a", "b", "d", "na", "nb", F.when(first, F.col("a")).otherwise(F.col("b")).alias("left"),
                      F.when(first, F.col("na")).otherwise(F.col("nb")).alias("left_size"))


def row_order(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, place): rows of a matrix in the leaf order of their correlation distances.

    Rows without any known value come last, by name.
    """
    from haptrace.operators.stats import correlation_distance

    known = df.groupBy(row).agg((F.count(value) > 0).alias("_known")).filter(F.col(row).isNotNull())
    some = df.join(known.filter("_known"), row).drop("_known")
    order = leaf_order(correlation_distance(some, row, column, value), known.filter("_known").select(F.col(row).alias("name")))
    blank = known.filter("NOT _known").select(row)
    # One row per row of the matrix, which has a distance to every other one besides.
    after = blank.withColumn("_at", F.row_number().over(W.orderBy(row)) - 1)
    placed = after.crossJoin(F.broadcast(order.agg(F.count("*").alias("_n")))).select(row, (F.col("_at") + F.col("_n")).cast("long").alias("place"))
    return order.select(F.col("name").alias(row), "place").unionByName(placed)
