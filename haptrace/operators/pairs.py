"""Two-sample statistics of every pair of sensors, read from count arrays.

Values are counted per sensor and laid into value buckets. A bucket has one row of counts per
value with a slot for each sensor, and a row of running totals of the buckets below; the largest gap
of the distribution functions and the rank sums of all pairs follow from these rows alone. A value is
shuffled once however many sensors there are; what leaves a bucket is one row per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from haptrace.operators.ordered import has_large_groups
from haptrace.operators.quantiles import in_value_buckets
from haptrace.session import group_limit

# Counts of a bucket that are held as a dense table at once.
_CELLS = 2_000_000


def pair_statistics(df: DataFrame, stratum: list[str], sensor: str, value: str, limit: int | None = None) -> DataFrame:
    """(stratum, a, b, na, nb, gap, rank_sum, ties) for every pair a < b of sensors of a stratum.

    ``gap``: largest distance of the distribution functions; ``rank_sum``: sum of the average ranks of
    a's rows among both; ``ties``: sum of t^3 - t over the tied runs of both. Rows without a value, sensor or stratum are left out.
    """
    limit = limit or group_limit(df)
    known = df.dropna(subset=[*stratum, sensor, value]).select(*stratum, F.col(sensor).alias("_s"), F.col(value).cast("double").alias("_v"))
    # Kept by Spark: cuts, totals and buckets all read the counts, else each of them counts anew in the same task.
    counts = known.groupBy(*stratum, "_s", "_v").agg(F.count("*").alias("_w")).persist()
    if has_large_groups(known.select(*stratum), stratum, limit):
        placed = in_value_buckets(counts, stratum, "_v", limit).drop("_split")
    else:
        placed = counts.withColumn("_bucket", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    keys = "".join(f"{k} {kinds[k]}, " for k in stratum)
    held = placed.groupBy(*stratum, "_bucket", "_s").agg(F.sum("_w").alias("_w"))
    below = held.groupBy(*stratum).applyInPandas(
        _running(stratum), f"{keys}_bucket int, _sensors array<{kinds['_s']}>, _n array<bigint>, _below array<bigint>")
    parts = placed.groupBy(*stratum, "_bucket").cogroup(below.groupBy(*stratum, "_bucket")).applyInPandas(
        _bucket(stratum), f"{keys}a {kinds['_s']}, b {kinds['_s']}, na bigint, nb bigint, gap double, rank_sum double, ties double")
    return parts.groupBy(*stratum, "a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("gap").alias("gap"), F.sum("rank_sum").alias("rank_sum"), F.sum("ties").alias("ties"))


def _running(stratum: list[str]):
    def run(held: pd.DataFrame) -> pd.DataFrame:
        """Slots of a stratum's sensors and, per bucket, the totals below it; at most buckets x sensors rows come in."""
        table = held.pivot_table(index="_bucket", columns="_s", values="_w", aggfunc="sum", fill_value=0).astype(np.int64)
        sums = table.to_numpy()
        below = np.cumsum(sums, axis=0) - sums
        out = pd.DataFrame({"_bucket": table.index.to_numpy(dtype=np.int32)})
        for k in reversed(stratum):
            out.insert(0, k, held[k].iloc[0])
        out["_sensors"] = [table.columns.tolist()] * len(out)
        out["_n"] = [sums.sum(axis=0).tolist()] * len(out)
        out["_below"] = below.tolist()
        return out

    return run


def _bucket(stratum: list[str]):
    columns = [*stratum, "a", "b", "na", "nb", "gap", "rank_sum", "ties"]

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or len(known["_sensors"].iloc[0]) < 2:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        sensors = list(known["_sensors"].iloc[0])
        total, below = (np.array(known[c].iloc[0], dtype=np.float64) for c in ("_n", "_below"))
        slot = {s: i for i, s in enumerate(sensors)}
        k = len(sensors)
        values, place = np.unique(rows["_v"].to_numpy(), return_inverse=True)
        slots, weights = rows["_s"].map(slot).to_numpy(), rows["_w"].to_numpy(dtype=np.float64)
        order = np.argsort(place, kind="stable")
        place, slots, weights = place[order], slots[order], weights[order]
        gap, ranks, ties = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        step = max(1, _CELLS // k)
        for start in range(0, len(values), step):
            some = slice(*np.searchsorted(place, [start, start + step]))
            w = np.zeros((min(step, len(values) - start), k))
            w[place[some] - start, slots[some]] = weights[some]
            upto = below + np.cumsum(w, axis=0)
            share = upto / total
            for a in range(k - 1):
                gap[a, a + 1:] = np.maximum(gap[a, a + 1:], np.abs(share[:, a:a + 1] - share[:, a + 1:]).max(axis=0))
            before, own, cubes = w.T @ (upto - w), w.T @ w, (w * w).T @ w
            single = w.sum(axis=0)
            ranks += np.diag(before)[:, None] + before + (np.diag(own)[:, None] + own + single[:, None]) / 2
            ties += np.diag(cubes)[:, None] + 3 * cubes + 3 * cubes.T + np.diag(cubes)[None, :] - single[:, None] - single[None, :]
            below = upto[-1]
        a, b = np.triu_indices(k, 1)
        out = pd.DataFrame({"a": [sensors[i] for i in a], "b": [sensors[i] for i in b], "na": total[a].astype(np.int64), "nb": total[b].astype(np.int64),
                            "gap": gap[a, b], "rank_sum": ranks[a, b], "ties": ties[a, b]})
        for key in stratum:
            out[key] = rows[key].iloc[0]
        return out[columns]

    return run
