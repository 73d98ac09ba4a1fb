"""Exact percentiles and ranks for groups of any size.

Groups are counted first.  Up to a row limit, Spark's exact ``percentile`` or a plain
window does the work.  If any group is larger, a path is taken in which no task sees it:
a mergeable sketch brackets the wanted ranks and only the values inside the brackets
are ranked one by one (percentiles), or a sample cuts the value range into
buckets that are ranked apart and shifted by the totals of the buckets below (ranks).
Both paths return the same, exact numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haptrace.operators.ordered import has_large_groups
from haptrace.session import group_limit

_SKETCH = 100_000  # accuracy of percentile_approx: rank error n / _SKETCH


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def _large(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)


def percentiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], limit: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """One row per group; ``wanted`` maps an output name to (column, probability).

    Linear interpolation between the two neighbouring ranks; nulls are skipped.
    """
    limit = limit or group_limit(df)
    columns = sorted({c for c, _ in wanted.values()})
    if split is None:
        split = has_large_groups(df.select(*keys) if keys else df.select(*columns), keys, limit)
    if not split:
        return df.groupBy(*keys).agg(*percentile_aggregates(wanted))
    given, (df, keys) = keys, _keyed(df, keys)
    df = df.select(*keys, *columns)
    # Few by nature, one row for more than ``limit`` rows: broadcast, as a shuffle by the keys would bring each large group into one task.
    large = F.broadcast(_large(df.select(*keys), keys, limit).select(*keys))
    small = df.join(large, keys, "left_anti").groupBy(*keys).agg(*percentile_aggregates(wanted))
    out = small.unionByName(_large_percentiles(df.join(large, keys, "left_semi"), keys, columns, wanted, limit))
    # Spark takes a union of parts that are hashed alike as hashed too and joins it without a shuffle, while adaptive execution
    # gives the parts partitions of their own; the rows, one a group, are dealt anew.
    out = out.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return out if given else out.drop("_all")


def percentile_aggregates(wanted: dict[str, tuple[str, float]]) -> list[Column]:
    """Exact percentile aggregates, for groups known to fit one task."""
    return [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]


def _large_percentiles(df, keys, columns, wanted, limit):
    probs = sorted({p for _, p in wanted.values()})
    margin = max(1e-4, 5.0 / limit)
    long = df.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(c).alias("_f"), F.col(c).cast("double").alias("_v")) for c in columns])),
    ).filter(F.col("_v").isNotNull())
    by = [*keys, "_f"]
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = long.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", ends, _SKETCH).alias("_e"),
    )
    low = [F.col("_min") if 2 * i == 0 and probs[i] <= margin else F.col("_e")[2 * i] for i in range(len(probs))]
    high = [F.col("_max") if probs[i] >= 1 - margin else F.col("_e")[2 * i + 1] for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(a, b) for a, b in zip(low, high)])
    # Values between two brackets only count: they are moved onto the bracket end below.
    below = F.coalesce(F.array_max(F.array(*[F.when(h < F.col("_v"), h) for h in high])), F.lit(float("-inf")))
    counted = (
        long.join(F.broadcast(sketch), by)
        .withColumn("_w", F.when(inside, F.col("_v")).otherwise(below))
        .groupBy(*by, "_w").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    )
    upto = W.partitionBy(*by).orderBy("_w").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto))

    def at(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))

    aggs = []
    for name, (column, p) in wanted.items():
        rank = F.floor(F.lit(p) * (F.col("_n") - 1))
        part = F.lit(p) * (F.col("_n") - 1) - rank
        nxt = F.least(rank + 1, F.col("_n") - 1)
        of = F.col("_f") == column
        lo = F.max(F.when(of & at(rank), F.col("_w")))
        hi = F.max(F.when(of & at(nxt), F.col("_w")))
        share = F.max(F.when(of, part))
        aggs.append((lo + (hi - lo) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def in_value_buckets(counted: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Adds ``_bucket``, the place of a value among the cuts of its group, and ``_split``, whether the group has more than ``limit`` rows and so cuts."""
    # The sample depends on the values alone, so a recomputed task draws the same one.
    cuts = (
        counted.join(_large(counted, keys, limit), keys)
        .filter(F.pmod(F.xxhash64(value), F.lit(1 << 20)) < F.greatest(F.lit(1), F.lit(4096 << 20) / F.col("_n")))
        .groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_cuts"))
    )
    # Binary search of the value among the sorted cuts, kept as one expression.
    steps = F.array(*[F.lit(1 << i) for i in range(13, -1, -1)])
    bucket = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col(value), at + step).otherwise(at),
    )
    placed = counted.join(cuts, keys, "left").withColumn("_bucket", bucket)
    return placed.withColumn("_split", F.col("_cuts").isNotNull()).drop("_cuts")


def ranked_values(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None, limit: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Distinct values of each group with their place in the order.

    Adds ``cnt`` (copies), ``before`` (rows with a smaller value) and, for each entry
    ``s`` of ``sums``, ``s`` (sum over the copies) and ``s_before``.  The average rank
    of a value is ``before + (cnt + 1) / 2``.  Rows with a null value are left out.
    """
    limit = limit or group_limit(df)
    if split is None:
        split = has_large_groups(df.select(*keys) if keys else df.select(value), keys, limit)
    given, (df, keys) = keys, _keyed(df, keys)
    sums = sums or {}
    tallies = ["cnt", *sums]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    if not split:
        window = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        out = counted.withColumns({
            ("before" if t == "cnt" else f"{t}_before"): F.coalesce(F.sum(t).over(window), F.lit(0)) for t in tallies})
        return out if given else out.drop("_all")
    placed = in_value_buckets(counted, keys, value, limit)
    upto = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        placed.filter("_split").groupBy(*keys, "_bucket").agg(*[F.sum(t).alias(f"_t_{t}") for t in tallies])
        .select(*keys, "_bucket", *[F.sum(f"_t_{t}").over(earlier).alias(f"_o_{t}") for t in tallies])
    )

    def place(t: str) -> Column:
        return F.coalesce(F.sum(t).over(upto), F.lit(0)) + F.coalesce(F.col(f"_o_{t}"), F.lit(0))

    out = placed.join(totals, [*keys, "_bucket"], "left").withColumns(
        {("before" if t == "cnt" else f"{t}_before"): place(t) for t in tallies}
    )
    drop = ["_bucket", "_split", *[f"_o_{t}" for t in tallies]] + ([] if given else ["_all"])
    return out.drop(*drop)


def average_ranks(df: DataFrame, keys: list[str], value: str, limit: int | None = None,
                  split: bool | None = None) -> DataFrame:
    """``df`` with ``avg_rank``, ties sharing their mean rank."""
    ranks = ranked_values(df, keys, value, limit=limit, split=split).select(
        *keys, value, (F.col("before") + (F.col("cnt") + 1) / 2).alias("avg_rank"), F.col("cnt").alias("ties")
    )
    return df.join(ranks, [*keys, value])
