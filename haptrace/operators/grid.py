"""Maps of overlapping feature-grid cells from the sums of the pieces the cells share.

The cells that hold a value are a run of indices, so the pair (first, last) names the piece of the
axis the value lies in; closed edges are pieces of their own.  Touches are summed by piece, and the
sums of a cell are those of the pieces it covers.  What is shuffled follows from the pieces, whose
number an axis bounds by twice its cells, and doesn't grow with the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haptrace.operators.surface import axis_size
from haptrace.schema import KEYS

Axes = dict[str, tuple[float, float, float, float]]


def pieces(touches: DataFrame, axes: Axes) -> DataFrame:
    """Touches with ``f_<axis>`` and ``l_<axis>``, the first and last cell that holds them.

    ``axes``: min, max, step, span.  Touches outside all cells, null and NaN are dropped.
    """
    out = touches
    for name, (lo, hi, step, span) in axes.items():
        x, n = F.col(name).cast("double"), axis_size(lo, hi, step)

        def guess(edge: float, whole) -> Column:
            at = (x + edge - lo) / step
            return whole(F.least(F.greatest(at, F.lit(-2.0)), F.lit(n + 2.0))).cast("int")

        def center(i: Column) -> Column:
            return F.lit(lo) + i * step

        # Arithmetic may miss by one cell at an edge; the tests are those of the membership itself.
        f, l = guess(-span / 2, F.ceil), guess(span / 2, F.floor)
        first = F.when(center(f - 1) + span / 2 >= x, f - 1).when(center(f) + span / 2 >= x, f).otherwise(f + 1)
        last = F.when(center(l + 1) - span / 2 <= x, l + 1).when(center(l) - span / 2 <= x, l).otherwise(l - 1)
        out = out.filter(x.isNotNull() & ~F.isnan(x)).withColumns({
            f"f_{name}": F.greatest(first, F.lit(0)), f"l_{name}": F.least(last, F.lit(n - 1))}).filter(f"`f_{name}` <= `l_{name}`")
    return out


def _added(entries: Column, field: str, kind: T.DataType) -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(entries, zero, lambda acc, p: acc + F.coalesce(p[field], zero))


def cell_sums(summed: DataFrame, keys: list[str], axes: Axes, sums: list[str], count: str) -> DataFrame:
    """Sums per grid cell (``i_<axis>``) from one row per key and piece; cells with a count of 0 have no row.

    Sums only add, so a cell of few touches keeps its precision beside a crowded one.
    """
    out, open_axes, done = summed, list(axes), []
    for name in axes:
        open_axes.remove(name)
        rest = [*done, *[f"{e}_{a}" for a in open_axes for e in "fl"]]
        # At most two pieces a cell of the axis meet in a line.
        line = out.groupBy(*keys, *rest).agg(F.collect_list(F.struct(
            F.col(f"f_{name}").alias("f"), F.col(f"l_{name}").alias("l"), *sums)).alias("_line"))

        def cell(i: Column) -> Column:
            own = F.filter("_line", lambda p: (p["f"] <= i) & (p["l"] >= i))
            return F.struct(i.alias(f"i_{name}"), *[_added(own, c, kind).alias(c) for c, kind in kinds.items()])

        kinds = {c: summed.schema[c].dataType for c in sums}
        reached = F.sequence(F.array_min(F.transform("_line", lambda p: p["f"])), F.array_max(F.transform("_line", lambda p: p["l"])))
        out = line.select(*keys, *rest, F.inline(F.transform(reached, cell))).filter(F.col(count) > 0)
        done.append(f"i_{name}")
    return out


def grid_maps(touches: DataFrame, rf: DataFrame, axes: Axes, ratio: float, by: list[str] = ["session_id"], keys: list[str] = KEYS,
              value: str = "rf_mean") -> DataFrame:
    """Mean map of the touches in each cell, without vertices that too few of them reach.

    ``touches`` has one row per touch, ``rf`` one per touch and vertex; ``by`` is part of the keys.
    """
    ends = [f"{e}_{a}" for a in axes for e in "fl"]
    placed = pieces(touches, axes).select(*keys, *ends)
    sizes = cell_sums(placed.groupBy(*by, *ends).agg(F.count("*").alias("n_touches")), by, axes, ["n_touches"], "n_touches")
    summed = placed.join(rf.select(*keys, "vertex_id", value), keys).groupBy(*by, "vertex_id", *ends).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_known"), F.count("*").alias("n_unique"))
    maps = cell_sums(summed, [*by, "vertex_id"], axes, ["_sum", "_known", "n_unique"], "n_unique")
    least = F.greatest(F.lit(1), F.bround(F.col("n_touches") * ratio).cast("long"))
    cell = [*by, *[f"i_{a}" for a in axes]]
    return maps.join(sizes, cell).filter(F.col("n_unique") >= least).select(
        *cell, "vertex_id", F.try_divide("_sum", "_known").alias("value"), "n_unique", "n_touches")
