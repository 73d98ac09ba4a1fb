"""Group tests in one grouped pass over all strata: sums on Spark, p-values per result row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haptrace.functions import special as P
from haptrace.operators.pairs import pair_statistics
from haptrace.operators.quantiles import average_ranks, percentiles, ranked_values


def coverage(df: DataFrame, stratum: list[str], sensor: str, min_rows: int = 5, min_sensors: int = 2) -> DataFrame:
    """Strata with at least ``min_sensors`` sensors of ``min_rows`` rows each."""
    per = df.groupBy(*stratum, sensor).agg(F.count("*").alias("_n"))
    return per.groupBy(*stratum).agg(F.count_if(F.col("_n") >= min_rows).alias("n_covered")).filter(
        F.col("n_covered") >= min_sensors)


def _anova(df: DataFrame, stratum: list[str], sensor: str, value: str, min_rows: int = 1) -> DataFrame:
    per = df.filter(F.col(value).isNotNull()).groupBy(*stratum, sensor).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")).filter(F.col("n") >= min_rows)
    grand = per.groupBy(*stratum).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_g"))
    d = F.col("mean") - F.col("_g")
    sums = per.join(grand, stratum).groupBy(*stratum).agg(
        F.count("*").alias("n_sensors"), F.sum("n").alias("n_observations"), F.sum(F.col("n") * d * d).alias("ss_between"),
        F.sum(F.col("n") * F.col("var")).alias("ss_within"))
    k, n = F.col("n_sensors"), F.col("n_observations")
    mean_within = F.try_divide(F.col("ss_within"), n - k)
    return sums.withColumns({
        "mean_square": F.when(n > k, mean_within),
        "f": F.when((k >= 2) & (n >= 3) & (n > k), F.try_divide(F.try_divide(F.col("ss_between"), k - 1), mean_within)),
    }).withColumns({"_d1": k - 1, "_d2": n - k})


def bias(df: DataFrame, stratum: list[str], sensor: str, value: str) -> DataFrame:
    """One-way ANOVA of the sensors in each stratum with the share of variance between them."""
    a = _anova(df, stratum, sensor, value)
    total = F.col("ss_between") + F.col("ss_within")
    ok = (F.col("n_sensors") >= 2) & (F.col("n_observations") >= 3)
    return a.select(
        *stratum, F.lit("bias").alias("strategy"), "n_sensors", "n_observations", F.col("f").alias("test_statistic"),
        P.p_value(P.f_sf, "f", "_d1", "_d2").alias("p_value"),
        F.when(ok & (total > 0), F.col("ss_between") / total).alias("effect_size"))


def tukey_pairs(df: DataFrame, stratum: list[str], sensor: str, value: str) -> DataFrame:
    """Mean difference of every pair of sensors with its studentised-range p-value."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*stratum, sensor).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    a = per.select(*stratum, F.col(sensor).alias("a"), F.col("n").alias("na"), F.col("mean").alias("ma"))
    b = per.select(*stratum, F.col(sensor).alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
    pairs = a.join(b, stratum).filter("a < b").join(_anova(df, stratum, sensor, value).select(*stratum, "n_sensors", "_d2", "mean_square"), stratum)
    se = F.sqrt(F.col("mean_square") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    pairs = pairs.withColumns({"mean_diff": F.col("ma") - F.col("mb"), "q": F.try_divide(F.abs(F.col("ma") - F.col("mb")), se)})
    return pairs.select(*stratum, "a", "b", "mean_diff", "q", P.p_value(P.studentized_range_sf, "q", "n_sensors", "_d2").alias("p_value"))


def precision(df: DataFrame, stratum: list[str], sensor: str, value: str) -> DataFrame:
    """Levene test about the sensor medians; effect is the largest to smallest variance."""
    by = [*stratum, sensor]
    df = df.filter(F.col(value).isNotNull()).select(*by, value)
    spread = df.join(percentiles(df, by, {"_med": (value, 0.5)}), by).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    a = _anova(spread, stratum, sensor, "_z", min_rows=2)
    var = df.groupBy(*by).agg(F.var_samp(value).alias("_v"), F.count("*").alias("_n")).filter("_n > 1").groupBy(*stratum).agg(
        F.count_if(F.col("_v") > 0).alias("_k"), (F.max(F.when(F.col("_v") > 0, F.col("_v"))) / F.min(F.when(F.col("_v") > 0, F.col("_v")))).alias("_ratio"))
    return a.join(var, stratum).select(
        *stratum, F.lit("precision").alias("strategy"), "n_sensors", "n_observations", F.col("f").alias("test_statistic"),
        P.p_value(P.f_sf, "f", "_d1", "_d2").alias("p_value"),
        F.when((F.col("n_sensors") >= 2) & (F.col("_k") >= 2), F.col("_ratio")).alias("effect_size"))


def ks_pairs(df: DataFrame, stratum: list[str], sensor: str, value: str) -> DataFrame:
    """Largest gap between the distribution functions of every pair of sensors."""
    best = pair_statistics(df, stratum, sensor, value).select(*stratum, "a", "b", "na", "nb", F.col("gap").alias("ks_statistic"))
    # One row per pair of sensors, but the exact law takes a while for each: spread over the cores.
    best = best.repartition(df.sparkSession.sparkContext.defaultParallelism, *stratum, "a", "b")
    return best.withColumn("p_value", P.p_value(P.ks_p, "ks_statistic", "na", "nb"))


def distribution(df: DataFrame, stratum: list[str], sensor: str, value: str) -> DataFrame:
    pairs = ks_pairs(df, stratum, sensor, value).groupBy(*stratum).agg(
        F.max("ks_statistic").alias("test_statistic"), F.min("p_value").alias("p_value"))
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*stratum).agg(
        F.count_distinct(sensor).alias("n_sensors"), F.count("*").alias("n_observations"))
    return sizes.join(pairs, stratum, "left").select(
        *stratum, F.lit("distribution").alias("strategy"), "n_sensors", "n_observations", "test_statistic", "p_value",
        F.col("test_statistic").alias("effect_size"))


COMPARATORS = {"bias": bias, "precision": precision, "distribution": distribution}


def register_comparator(name: str, compare) -> None:
    COMPARATORS[name] = compare


def compare(df: DataFrame, methods: list[str], stratum: list[str], sensor: str, value: str, label: str = "cluster_label",
            min_rows: int = 5, min_sensors: int = 2) -> DataFrame:
    """Every comparator on every stratum with a label >= 0 and enough coverage, in one pass each."""
    unknown = set(methods) - set(COMPARATORS)
    if unknown:
        raise ValueError(f"unknown comparators {sorted(unknown)}; known: {sorted(COMPARATORS)}")
    df = df.filter(F.col(label) >= 0)
    # Kept by Spark: coverage and every comparator read the rows again, and a task would work them out once per reader.
    df = df.select(*dict.fromkeys([*stratum, sensor, value])).persist()
    df = df.join(coverage(df, stratum, sensor, min_rows, min_sensors).select(*stratum), stratum, "left_semi")
    out = None
    for m in methods:
        part = COMPARATORS[m](df, stratum, sensor, value)
        out = part if out is None else out.unionByName(part)
    return out


def synthesize(results: DataFrame, dispersion: str | None = None) -> DataFrame:
    """Normalised weights per strategy, 1 / dispersion or equal, and weighted p-values."""
    w = 1.0 / (F.col(dispersion) + 1e-9) if dispersion else F.lit(1.0)
    total = F.sum("weight").over(W.partitionBy("strategy"))  # one row per stratum and strategy
    out = results.withColumn("weight", w).withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))
    return out.withColumn("weighted_p", F.col("weight") * F.coalesce("p_value", F.lit(1.0)))


def _sized_groups(df: DataFrame, keys: list[str], group: str, value: str, least: int = 2) -> DataFrame:
    """Rows with a value, of groups that have at least ``least`` of them."""
    df = df.filter(F.col(value).isNotNull())
    big = df.groupBy(*keys, group).agg(F.count("*").alias("_k")).filter(F.col("_k") >= least)
    return df.join(big.select(*keys, group), [*keys, group], "left_semi")


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Tie-corrected rank test over the groups of two rows or more of every key."""
    df = _sized_groups(df, keys, group, value)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count("*").alias("_w"))
    ranks = ranked_values(df, keys, value)
    rank = F.col("before") + (F.col("cnt") + 1) / 2
    per = counts.join(ranks, [*keys, value]).groupBy(*keys, group).agg(F.sum(F.col("_w") * rank).alias("_r"), F.sum("_w").alias("_n"))
    ties = ranks.groupBy(*keys).agg(F.sum(F.pow("cnt", F.lit(3)) - F.col("cnt")).alias("_ties"), F.sum("cnt").alias("n"))
    n = F.col("n")
    h = per.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.count("*").alias("n_groups")).join(ties, keys)
    raw = F.col("_s") * 12 / (n * (n + 1)) - (n + 1) * 3
    fix = 1 - F.col("_ties") / (F.pow(n, F.lit(3)) - n)
    h = h.withColumns({"h": F.when((F.col("n_groups") >= 2) & (fix > 0), raw / fix), "_df": F.col("n_groups") - 1})
    return h.select(*keys, "n_groups", "n", "h", P.p_value(P.chi2_sf, "h", "_df").alias("p_value"))


def mann_whitney_pairs(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """U of the first group and p-value for every pair of groups of two rows or more of every key."""
    df = _sized_groups(df, keys, group, value)
    out = pair_statistics(df, keys, group, value).withColumn("u", F.col("rank_sum") - F.col("na") * (F.col("na") + 1) / 2)
    out = out.withColumn("p_value", P.p_value(P.mann_whitney_p, "u", "na", "nb", "ties"))
    return out.select(*keys, "a", "b", "na", "nb", "u", "p_value", significance("p_value").alias("stars"))


def significance(p) -> Column:
    """Marks of a p-value; none where it is not significant."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def signed_rank(df: DataFrame, keys: list[str], value: str, min_rows: int = 5) -> DataFrame:
    """Wilcoxon signed-rank and sign test of the differences against zero."""
    v = F.col(value)
    moved = df.filter(v.isNotNull() & (v != 0)).withColumn("_abs", F.abs(v))
    ranks = ranked_values(moved, keys, "_abs", {"_pos": F.when(v > 0, 1).otherwise(0)})
    rank = F.col("before") + (F.col("cnt") + 1) / 2
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("_pos") * rank).alias("w_plus"), F.sum("cnt").alias("n_moved"), F.sum("_pos").alias("n_positive"),
        F.sum(F.pow("cnt", F.lit(3)) - F.col("cnt")).alias("_ties"))
    n = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v == 0).alias("_zeros")).filter(F.col("n") >= min_rows)
    out = n.join(sums, keys)
    half = F.col("n_moved") * (F.col("n_moved") + 1) / 2
    return out.select(
        *keys, "n", "n_positive", "w_plus", F.least(F.col("w_plus"), half - F.col("w_plus")).alias("w"),
        P.p_value(P.wilcoxon_p, "w_plus", "n_moved", "_ties", "_zeros").alias("wilcoxon_p"),
        P.p_value(P.binomial_two_sided, "n_positive", "n_moved").alias("sign_p"))


def hotelling(df: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """Two-dimensional mean shift from the origin; null with two or fewer rows or a singular spread."""
    m = df.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(u).alias("_mu"), F.avg(v).alias("_mv"), F.var_samp(u).alias("_a"),
        F.covar_samp(u, v).alias("_b"), F.var_samp(v).alias("_d"))
    det = F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b")
    quad = F.col("_mu") * F.col("_mu") * F.col("_d") - F.col("_mu") * F.col("_mv") * F.col("_b") * 2 + F.col("_mv") * F.col("_mv") * F.col("_a")
    n = F.col("n")
    t2 = F.when((n > 2) & (F.abs(det) > 1e-12), n * quad / det)
    out = m.withColumns({"t2": t2, "f": t2 * (n - 2) / (2 * (n - 1)), "_d1": F.lit(2), "_d2": n - 2})
    return out.select(*keys, "n", "t2", "f", P.p_value(P.f_sf, "f", "_d1", "_d2").alias("p_value"))


def sign_consistency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of differences with the majority sign and its exact binomial interval."""
    v = F.col(value)
    out = df.filter(v.isNotNull() & (v != 0)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v > 0).alias("n_positive"))
    out = out.withColumn("n_same", F.greatest(F.col("n_positive"), F.col("n") - F.col("n_positive")))
    return out.select(
        *keys, "n", "n_same", (F.col("n_same") / F.col("n")).alias("share"),
        P.p_value(lambda k, n: P.clopper_pearson(k, n)[0], "n_same", "n").alias("low"),
        P.p_value(lambda k, n: P.clopper_pearson(k, n)[1], "n_same", "n").alias("high"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks over complete pairs, null below three."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    both = average_ranks(average_ranks(df, keys, x).withColumnsRenamed({"avg_rank": "_rx", "ties": "_tx"}), keys, y)
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "avg_rank").alias("_c")).select(
        *keys, "n", F.when(F.col("n") >= 3, F.col("_c")).alias("rho"))


def correlation_distance(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """1 - r between the rows of a matrix over shared known columns, 1 where undefined.

    The result is itself one entry per pair of rows (sessions), not of data rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(row, column, value)
    a = known.select(F.col(row).alias("a"), column, F.col(value).alias("va"))
    b = known.select(F.col(row).alias("b"), column, F.col(value).alias("vb"))
    names = df.select(row).distinct()
    every = names.select(F.col(row).alias("a")).join(names.select(F.col(row).alias("b"))).filter("a < b")
    c = a.join(b, column).filter("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.corr("va", "vb").alias("c"), F.stddev_pop("va").alias("sa"), F.stddev_pop("vb").alias("sb"))
    flat = (F.col("n") < 2) | (F.col("sa") == 0) | (F.col("sb") == 0) | F.col("c").isNull()
    d = F.when(flat, 1.0).otherwise(F.least(F.greatest(1 - F.col("c"), F.lit(0.0)), F.lit(2.0)))
    return every.join(c.select("a", "b", d.alias("distance")), ["a", "b"], "left").na.fill(1.0, ["distance"])


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency counts."""
    keys = keys or []
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))

    def pairs(c):
        return F.col(c) * (F.col(c) - 1) / 2

    parts = [cells.groupBy(*keys).agg(F.sum(pairs("n")).alias("_ij"), F.sum("n").alias("_n"))]
    for side, name in ((a, "_a"), (b, "_b")):
        parts.append(cells.groupBy(*keys, side).agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pairs("m")).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys) if keys else out.join(F.broadcast(p))  # one row each
    expected = F.col("_a") * F.col("_b") / (F.col("_n") * (F.col("_n") - 1) / 2)
    top = (F.col("_a") + F.col("_b")) / 2
    return out.select(*keys, F.when(top == expected, 1.0).otherwise((F.col("_ij") - expected) / (top - expected)).alias("ari"))
