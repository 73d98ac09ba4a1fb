"""Ordered operators over frames, without a task that must hold a whole recording.

Groups are counted first.  When every group fits the row limit of one task, a plain
window over the keys does the work.  Otherwise the frame index is cut into chunks of a
fixed number of frames: the window runs inside ``(keys, chunk)`` and what must cross a
chunk border (last known value, previous row, running sum) is carried by a summary that
holds one row per chunk.  The order column must be unique inside the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haptrace.session import chunk_rows, cut_lineage, group_limit

CHUNK = "_chunk"


def has_large_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether any group has more rows than one task should hold (one counting job)."""
    limit = limit or group_limit(df)
    if not keys:
        return df.limit(limit + 1).count() > limit
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).isEmpty()


def ordered(
    df: DataFrame,
    keys: list[str],
    order: str = "frame_idx",
    *,
    last_known: dict[str, Column] | None = None,
    next_known: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    position: str | None = None,
    split: bool | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``; each dict maps an output name to an input column.

    ``last_known``   last non-null value at or before the row
    ``next_known``   first non-null value at or after the row
    ``previous``     value of the row before, null on the first row
    ``running``      sum up to and including the row
    ``total``        sum over the whole group
    ``position``     0-based row number
    ``split``        take the chunked path; by default the groups are counted to decide
    """
    last_known, next_known, previous = last_known or {}, next_known or {}, previous or {}
    running, total = dict(running or {}), total or {}
    if position:
        running[position] = F.lit(1)
    if rows is None and not (has_large_groups(df, keys) if split is None else split):
        local = _local(keys, order, last_known, next_known, previous, running, total)
        if position:
            local[position] = local[position] - 1
        return df.withColumns(local)

    # The input feeds both the rows and the carried summary: compute it once.
    df = cut_lineage(df.withColumn(CHUNK, F.floor(F.col(order) / (rows or chunk_rows(df)))))
    by = [*keys, CHUNK]
    at = F.col(order)
    parts = [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_l_{n}") for n, c in last_known.items()]
    parts += [F.min_by(c, F.when(c.isNotNull(), at)).alias(f"_n_{n}") for n, c in next_known.items()]
    parts += [F.max_by(F.struct(c.alias("v")), at).alias(f"_p_{n}") for n, c in previous.items()]
    parts += [F.sum(c).alias(f"_r_{n}") for n, c in running.items()]
    parts += [F.sum(c).alias(f"_t_{n}") for n, c in total.items()]
    whole = W.partitionBy(*keys)
    over = whole.orderBy(CHUNK)
    before = over.rowsBetween(W.unboundedPreceding, -1)
    # Frames that end at the last row cost quadratic time: read them backwards instead.
    after = whole.orderBy(F.desc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    carried = [F.last(f"_l_{n}", True).over(before).alias(f"_l_{n}") for n in last_known]
    carried += [F.last(f"_n_{n}", True).over(after).alias(f"_n_{n}") for n in next_known]
    carried += [F.lag(f"_p_{n}").over(over)["v"].alias(f"_p_{n}") for n in previous]
    carried += [F.sum(f"_r_{n}").over(before).alias(f"_r_{n}") for n in running]
    carried += [F.sum(f"_t_{n}").over(whole).alias(f"_t_{n}") for n in total]
    crossing = F.lag(CHUNK).over(over).isNotNull() | F.lead(CHUNK).over(over).isNotNull()
    carry = (
        df.groupBy(*by).agg(*parts)
        .select(*by, *carried, crossing.alias("_crossing"))
        .filter("_crossing").drop("_crossing")
    )
    local = _local(by, order, last_known, next_known, previous, running, total)
    first = F.row_number().over(W.partitionBy(*by).orderBy(order)) == 1
    for n in [*last_known, *next_known, *total]:
        mark = "l" if n in last_known else "n" if n in next_known else "t"
        local[n] = F.coalesce(F.col(f"_t_{n}"), local[n]) if mark == "t" else F.coalesce(local[n], F.col(f"_{mark}_{n}"))
    for n in previous:
        local[n] = F.when(first, F.col(f"_p_{n}")).otherwise(local[n])
    for n in running:
        local[n] = local[n] + F.coalesce(F.col(f"_r_{n}"), F.lit(0))
    if position:
        local[position] = local[position] - 1
    named = zip("lnprt", (last_known, next_known, previous, running, total))
    return df.join(carry, by, "left").withColumns(local).drop(CHUNK, *[f"_{k}_{n}" for k, d in named for n in d])


def _local(by, order, last_known, next_known, previous, running, total) -> dict[str, Column]:
    """The columns as windows inside ``by``."""
    whole = W.partitionBy(*by)
    inside = whole.orderBy(order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    since = whole.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = {n: F.last(c, True).over(upto) for n, c in last_known.items()}
    out |= {n: F.last(c, True).over(since) for n, c in next_known.items()}
    out |= {n: F.lag(c).over(inside) for n, c in previous.items()}
    out |= {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in running.items()}
    return out | {n: F.sum(c).over(whole) for n, c in total.items()}


def forward_fill(df: DataFrame, keys: list[str], columns: list[str], order: str = "frame_idx",
                 split: bool | None = None) -> DataFrame:
    """Last non-null value of each column in row order."""
    fills = {f"_f_{c}": F.col(c) for c in columns}
    filled = ordered(df, keys, order, last_known=fills, split=split)
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*fills)


def run_lengths(df: DataFrame, keys: list[str], column: str, order: str = "frame_idx",
                split: bool | None = None) -> DataFrame:
    """Runs of equal consecutive values: run id, first row, length and the value."""
    split = has_large_groups(df, keys) if split is None else split
    marked = ordered(df, keys, order, previous={"_prev": F.struct(F.col(column).alias("v"))}, split=split)
    change = F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(column)), 1).otherwise(0)
    numbered = ordered(marked.withColumn("_change", change), keys, order, running={"run_id": F.col("_change")}, split=split)
    return numbered.groupBy(*keys, (F.col("run_id") - 1).alias("run_id")).agg(
        F.min(order).alias("first_row"), F.count("*").alias("run_length"), F.first(column).alias(column)
    )
