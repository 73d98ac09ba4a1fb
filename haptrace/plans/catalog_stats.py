"""Queries on group tests and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from haptrace.operators import linkage as L
from haptrace.operators import stats as S
from haptrace.operators import tuning as U
from haptrace.plans.inputs import ctes, view
from haptrace.plans.registry import query, r, rounded

X = ctes("touches") + """,
x AS (SELECT *, CAST(floor(depth_max / 10) AS INT) - 1 AS cluster_label, velocity_max AS val, depth_max / 10 - pressure_max / 2 AS delta, iff_max * 10 AS iv FROM touches),
g AS (SELECT cluster_label, session_id, count(*) n, avg(val) m, var_pop(val) vp, var_samp(val) vs FROM x WHERE cluster_label >= 0 GROUP BY 1, 2),
cov AS (SELECT cluster_label FROM g GROUP BY 1 HAVING count(*) FILTER (n >= 5) >= 2),
gg AS (SELECT g.*, sum(n * m) OVER w / sum(n) OVER w AS grand FROM g SEMI JOIN cov USING (cluster_label) WINDOW w AS (PARTITION BY cluster_label)),
an AS (SELECT cluster_label, count(*) AS k, CAST(sum(n) AS BIGINT) AS nn, sum(n * (m - grand) * (m - grand)) AS ssb, sum(n * vp) AS ssw FROM gg GROUP BY 1),
z AS (SELECT x.cluster_label, x.session_id, abs(val - median(val) OVER (PARTITION BY x.cluster_label, x.session_id)) AS z FROM x SEMI JOIN cov USING (cluster_label)),
zg AS (SELECT cluster_label, session_id, count(*) n, avg(z) m, var_pop(z) vp FROM z GROUP BY 1, 2 HAVING count(*) > 1),
zz AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS grand FROM zg WINDOW w AS (PARTITION BY cluster_label)),
za AS (SELECT cluster_label, count(*) AS k, CAST(sum(n) AS BIGINT) AS nn, sum(n * (m - grand) * (m - grand)) AS ssb, sum(n * vp) AS ssw FROM zz GROUP BY 1),
vr AS (SELECT cluster_label, max(vs) FILTER (vs > 0) / min(vs) FILTER (vs > 0) AS ratio FROM gg WHERE n > 1 GROUP BY 1),
pr AS (SELECT a.cluster_label, a.session_id AS a, b.session_id AS b, a.n AS na, b.n AS nb, a.m - b.m AS diff FROM gg a JOIN gg b ON a.cluster_label = b.cluster_label AND a.session_id < b.session_id),
pv AS (SELECT pr.*, x.val, CASE WHEN x.session_id = a THEN 1.0 ELSE 0 END AS ina FROM pr JOIN x ON x.cluster_label = pr.cluster_label AND x.session_id IN (a, b)),
ks AS (SELECT cluster_label, a, b, max(abs(fa / na - fb / nb)) AS ks_statistic FROM (SELECT *, sum(ina) OVER o AS fa, sum(1 - ina) OVER o AS fb FROM pv WINDOW o AS (PARTITION BY cluster_label, a, b ORDER BY val RANGE UNBOUNDED PRECEDING)) GROUP BY 1, 2, 3)
"""


# Tail probabilities in SQL, by midpoint sums of their integrals.


def _sum(count, body):
    return f"list_sum(list_transform(range({count}), lambda i: {body}))"


def f_tail(f, d1, d2):
    """Upper tail of F: the incomplete beta integral with t = x exp(-s / a), s in steps of 1/500."""
    a, b, x = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    body = f"exp(-(i + 0.5) / 500) * pow(1 - {x} * exp(-(i + 0.5) / 500 / {a}), {b} - 1) / 500"
    return f"exp({a} * ln({x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * {_sum(20000, body)}"


def normal_tail(z):
    return f"({_sum(20000, f'exp(-pow(({z}) + (i + 0.5) / 500, 2) / 2) / 500')} / sqrt(2 * pi()))"


def sign_p(k, n):
    return f"least(1.0, 2 * {_sum(f'CAST(least({k}, ({n}) - ({k})) + 1 AS BIGINT)', f'exp(lgamma(({n}) + 1) - lgamma(i + 1) - lgamma(({n}) - i + 1) - ({n}) * ln(2))')})"


# Share of lattice paths of the two samples that stay inside the gap, one anti-diagonal a step.
KS_P = """,
kn AS (SELECT ks.*, na, nb FROM ks JOIN pr USING (cluster_label, a, b)),
walk AS (
  SELECT cluster_label, a, b, na, nb, ks_statistic, 0 AS s, list_transform(range(na + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w FROM kn
  UNION ALL
  SELECT cluster_label, a, b, na, nb, ks_statistic, s + 1, list_transform(range(na + 1), lambda i: CASE
    WHEN s + 1 - i BETWEEN 0 AND nb AND abs(i * nb - (s + 1 - i) * na) < ks_statistic * na * nb - 0.5
    THEN (CASE WHEN i > 0 THEN w[i] * i / (s + 1) ELSE 0.0::DOUBLE END) + w[i + 1] * (s + 1 - i) / (s + 1) ELSE 0.0::DOUBLE END)
  FROM walk WHERE s < na + nb),
kp AS (SELECT cluster_label, a, b, ks_statistic, 1 - w[na + 1] AS p FROM walk WHERE s = na + nb)
"""
XR = X.replace("WITH", "WITH RECURSIVE", 1)


def _x(spark, sf):
    return view(spark, sf, "touches").withColumns({
        "cluster_label": F.floor(F.col("depth_max") / 10).cast("int") - 1, "val": F.col("velocity_max"),
        "delta": F.col("depth_max") / 10 - F.col("pressure_max") / 2, "iv": F.col("iff_max") * 10})


@query("bias_test", X + f"""SELECT cluster_label, 'bias' AS strategy, k AS n_sensors, nn AS n_observations, {r("(ssb / (k - 1)) / (ssw / (nn - k))", "test_statistic")}, {r(f_tail("(ssb / (k - 1)) / (ssw / (nn - k))", "k - 1", "nn - k"), "p_value")}, {r("ssb / (ssb + ssw)", "effect_size")} FROM an""")
def _(spark, sf):
    return rounded(S.compare(_x(spark, sf), ["bias"], ["cluster_label"], "session_id", "val"))


@query("precision_test", X + f"""SELECT cluster_label, 'precision' AS strategy, k AS n_sensors, nn AS n_observations, {r("(ssb / (k - 1)) / (ssw / (nn - k))", "test_statistic")}, {r(f_tail("(ssb / (k - 1)) / (ssw / (nn - k))", "k - 1", "nn - k"), "p_value")}, {r("ratio", "effect_size")} FROM za JOIN vr USING (cluster_label)""")
def _(spark, sf):
    return rounded(S.compare(_x(spark, sf), ["precision"], ["cluster_label"], "session_id", "val"))


@query("distribution_test", XR + KS_P + f"""SELECT cluster_label, 'distribution' AS strategy, min(k) AS n_sensors, min(nn) AS n_observations, {r("max(ks_statistic)", "test_statistic")}, {r("min(p)", "p_value")}, {r("max(ks_statistic)", "effect_size")} FROM kp JOIN an USING (cluster_label) GROUP BY 1""")
def _(spark, sf):
    return rounded(S.compare(_x(spark, sf), ["distribution"], ["cluster_label"], "session_id", "val"))


@query("ks_pairs", XR + KS_P + f"SELECT cluster_label, a, b, {r('ks_statistic', 'ks_statistic')}, {r('p', 'p_value')} FROM kp")
def _(spark, sf):
    x = _x(spark, sf).filter("cluster_label >= 0")
    return rounded(S.ks_pairs(x, ["cluster_label"], "session_id", "val").select("cluster_label", "a", "b", "ks_statistic", "p_value"))


# Studentised range: the range of k normals on a grid of 1/40, averaged over the deviation's density on 241 points.
TUKEY_P = """,
grid AS (SELECT list(c ORDER BY i) AS cdf FROM (SELECT i, """ + f"1 - {normal_tail('-8.5 + i0 / 40')}".replace("i0", "g.i") + """ AS c FROM range(681) g(i))),
tq AS (SELECT pr.*, k, nn - k AS df, abs(diff) / sqrt(ssw / (nn - k) / 2 * (1 / na + 1 / nb)) AS q FROM pr JOIN an USING (cluster_label)),
ts AS (SELECT *, 1 - 7 / sqrt(2 * df) AS s0 FROM tq),
tw AS (SELECT cluster_label, a, b, diff, q, k, df, sd, q * sd AS w FROM (SELECT ts.*, greatest(0.0001, s0) + j * (1 + 7 / sqrt(2 * df) - greatest(0.0001, s0)) / 240 AS sd FROM ts, range(241) t(j))),
ti AS (SELECT tw.*, exp((df - 1) * ln(sd) - df * (sd * sd - 1) / 2) AS dens,
  k * list_sum(list_transform(range(681), lambda i: exp(-pow(-8.5 + i / 40, 2) / 2) / sqrt(2 * pi()) / 40 * pow(cdf[i + 1] - CASE
    WHEN i - w * 40 <= 0 THEN 0 ELSE cdf[CAST(floor(i - w * 40) AS BIGINT) + 1] + (i - w * 40 - floor(i - w * 40)) * (cdf[CAST(floor(i - w * 40) AS BIGINT) + 2] - cdf[CAST(floor(i - w * 40) AS BIGINT) + 1]) END, k - 1))) AS inside
  FROM tw, grid)
"""


@query("tukey_pairs", X + TUKEY_P + f"""SELECT cluster_label, a, b, {r("min(diff)", "mean_diff")}, {r("min(q)", "q")}, {r("greatest(0, 1 - sum(dens * inside) / sum(dens))", "p_value", 4)} FROM ti GROUP BY 1, 2, 3""")
def _(spark, sf):
    x = _x(spark, sf).filter("cluster_label >= 0")
    return rounded(S.tukey_pairs(x, ["cluster_label"], "session_id", "val"), p_value=4)


@query("comparison_with_p_values", XR + KS_P + f""", res AS (
SELECT cluster_label, 'bias' AS strategy, k AS n_sensors, nn AS n_observations, (ssb / (k - 1)) / (ssw / (nn - k)) AS t, {f_tail("(ssb / (k - 1)) / (ssw / (nn - k))", "k - 1", "nn - k")} AS p, ssb / (ssb + ssw) AS e FROM an
UNION ALL SELECT cluster_label, 'precision', k, nn, (ssb / (k - 1)) / (ssw / (nn - k)), {f_tail("(ssb / (k - 1)) / (ssw / (nn - k))", "k - 1", "nn - k")}, ratio FROM za JOIN vr USING (cluster_label)
UNION ALL SELECT cluster_label, 'distribution', min(k), min(nn), max(ks_statistic), min(kp.p), max(ks_statistic) FROM kp JOIN an USING (cluster_label) GROUP BY 1),
w AS (SELECT *, cluster_label + 1.0 AS dispersion, 1 / (cluster_label + 1 + 1e-9) AS w FROM res), ww AS (SELECT *, w / sum(w) OVER (PARTITION BY strategy) AS weight FROM w)
SELECT cluster_label, strategy, n_sensors, n_observations, {r("t", "test_statistic")}, {r("p", "p_value")}, {r("e", "effect_size")}, {r("dispersion", "dispersion")}, {r("weight", "weight")}, {r("weight * p", "weighted_p")} FROM ww""")
def _(spark, sf):
    out = S.compare(_x(spark, sf), ["bias", "precision", "distribution"], ["cluster_label"], "session_id", "val")
    return rounded(S.synthesize(out.withColumn("dispersion", F.col("cluster_label") + 1.0), "dispersion"))


@query("stratum_synthesis", X + f""", res AS (SELECT cluster_label, 'bias' AS strategy, (ssb / (k - 1)) / (ssw / (nn - k)) / 100 AS p_value FROM an UNION ALL SELECT cluster_label, 'precision', CASE WHEN cluster_label <> 1 THEN ratio / 100 END FROM vr),
w AS (SELECT *, 1 / (cluster_label + 1 + 1e-9) AS w FROM res)
SELECT cluster_label, strategy, {r("w / sum(w) OVER (PARTITION BY strategy)", "weight")}, {r("w / sum(w) OVER (PARTITION BY strategy) * coalesce(p_value, 1)", "weighted_p")} FROM w""")
def _(spark, sf):
    out = S.compare(_x(spark, sf), ["bias", "precision"], ["cluster_label"], "session_id", "val")
    made = F.when(F.col("strategy") == "bias", F.col("test_statistic") / 100).when(F.col("cluster_label") != 1, F.col("effect_size") / 100)
    out = S.synthesize(out.withColumn("p_value", made).withColumn("dispersion", F.col("cluster_label") + 1.0), "dispersion")
    return rounded(out.select("cluster_label", "strategy", "weight", "weighted_p"))


@query("stratum_coverage", ctes("touches") + """, c AS (SELECT block_order_id, session_id, count(*) n FROM touches GROUP BY 1, 2)
SELECT block_order_id, count(*) FILTER (n >= 60) AS n_covered FROM c GROUP BY 1 HAVING count(*) FILTER (n >= 60) >= 2""")
def _(spark, sf):
    return S.coverage(view(spark, sf, "touches"), ["block_order_id"], "session_id", 60, 2)


_RK = ", t AS (SELECT cluster_label, iv, count(*) AS c FROM x GROUP BY 1, 2), rk AS (SELECT *, sum(c) OVER (PARTITION BY cluster_label ORDER BY iv) - c + (c + 1) / 2 AS rank FROM t)"


@query("kruskal_wallis", X + _RK + f""", s AS (SELECT x.cluster_label, gesture_type, sum(rank) AS rs, count(*) AS n FROM x JOIN rk USING (cluster_label, iv) GROUP BY 1, 2),
ti AS (SELECT cluster_label, sum(c * c * c - c) AS ties, sum(c) AS n FROM t GROUP BY 1),
hh AS (SELECT s.cluster_label, count(*) AS n_groups, CAST(min(ti.n) AS BIGINT) AS n, ((12 / (min(ti.n) * (min(ti.n) + 1)) * sum(rs * rs / s.n) - 3 * (min(ti.n) + 1)) / (1 - min(ties) / (min(ti.n) * min(ti.n) * min(ti.n) - min(ti.n)))) AS h
FROM s JOIN ti USING (cluster_label) GROUP BY 1)
SELECT cluster_label, n_groups, n, {r("h", "h")}, {r("exp(-h / 2)", "p_value")} FROM hh""")
def _(spark, sf):
    return rounded(S.kruskal(_x(spark, sf), ["cluster_label"], "gesture_type", "iv"))


@query("mann_whitney", X + f""", gs AS (SELECT cluster_label, gesture_type AS gt, count(*) AS n FROM x GROUP BY 1, 2),
pp AS (SELECT a.cluster_label, a.gt AS a, b.gt AS b, a.n AS na, b.n AS nb FROM gs a JOIN gs b ON a.cluster_label = b.cluster_label AND a.gt < b.gt),
rr AS (SELECT pp.*, gesture_type = a AS ina, rank() OVER o + (count(*) OVER (PARTITION BY pp.cluster_label, a, b, iv) - 1) / 2 AS rk FROM pp JOIN x ON x.cluster_label = pp.cluster_label AND gesture_type IN (a, b) WINDOW o AS (PARTITION BY pp.cluster_label, a, b ORDER BY iv)),
uu AS (SELECT cluster_label, a, b, na, nb, sum(rk) FILTER (ina) - na * (na + 1) / 2 AS u FROM rr GROUP BY 1, 2, 3, 4, 5),
tt AS (SELECT cluster_label, a, b, sum(c * c * c - c) AS ties FROM (SELECT pp.cluster_label, a, b, iv, count(*) AS c FROM pp JOIN x ON x.cluster_label = pp.cluster_label AND gesture_type IN (a, b) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
pz AS (SELECT *, least(1, 2 * {normal_tail("(greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))))")}) AS p FROM uu JOIN tt USING (cluster_label, a, b))
SELECT cluster_label, a, b, na, nb, {r("u", "u", 3)}, {r("p", "p_value", 5)}, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM pz""")
def _(spark, sf):
    return rounded(S.mann_whitney_pairs(_x(spark, sf), ["cluster_label"], "gesture_type", "iv"), 3, p_value=5)


@query("signed_rank", X + f""", d AS (SELECT cluster_label, delta, rank() OVER (PARTITION BY cluster_label ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY cluster_label, abs(delta)) - 1) / 2 AS rk FROM x WHERE delta <> 0),
n AS (SELECT cluster_label, count(*) AS n FROM x GROUP BY 1),
tc AS (SELECT cluster_label, sum(c * c * c - c) AS ties FROM (SELECT cluster_label, abs(delta), count(*) AS c FROM x WHERE delta <> 0 GROUP BY 1, 2) GROUP BY 1),
sr AS (SELECT d.cluster_label, min(n) AS n, count(*) FILTER (delta > 0) AS n_positive, sum(rk) FILTER (delta > 0) AS wp, count(*) AS nm FROM d JOIN n USING (cluster_label) GROUP BY 1)
SELECT cluster_label, n, n_positive, {r("wp", "w_plus", 3)}, {r("least(wp, nm * (nm + 1) / 2 - wp)", "w", 3)},
 {r("least(1, 2 * " + normal_tail("abs(wp - nm * (nm + 1) / 4) / sqrt((nm * (nm + 1) * (2 * nm + 1) - ties / 2) / 24)") + ")", "wilcoxon_p", 5)}, {r(sign_p("n_positive", "nm"), "sign_p", 5)} FROM sr JOIN tc USING (cluster_label)""")
def _(spark, sf):
    return rounded(S.signed_rank(_x(spark, sf).filter("cluster_label IS NOT NULL"), ["cluster_label"], "delta"), 3, wilcoxon_p=5, sign_p=5)


@query("hotelling", X + f""", m AS (SELECT cluster_label, count(*) n, avg(delta) mu, avg(iv) mv, var_samp(delta) a, covar_samp(delta, iv) b, var_samp(iv) d FROM x GROUP BY 1),
t AS (SELECT *, n * (mu * mu * d - 2 * mu * mv * b + mv * mv * a) / (a * d - b * b) AS t2 FROM m)
SELECT cluster_label, n, {r("t2", "t2", 3)}, {r("t2 * (n - 2) / (2 * (n - 1))", "f", 3)}, {r("pow(1 + t2 / (n - 1), -(n - 2) / 2)", "p_value")} FROM t""")
def _(spark, sf):
    return rounded(S.hotelling(_x(spark, sf), ["cluster_label"], "delta", "iv"), 3, p_value=6)


# The interval's ends by halving: the count's tail is 0.025 at either end.
_TAIL = "list_sum(list_transform(range({lo}, {hi}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
_CP = f""", c AS (SELECT cluster_label, count(*) AS n, CAST(greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0)) AS BIGINT) AS k FROM x WHERE delta <> 0 GROUP BY 1),
bi AS (SELECT cluster_label, n, k, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1, 0 AS step FROM c
 UNION ALL SELECT cluster_label, n, k, CASE WHEN {_TAIL.format(lo="k", hi="n + 1", p="((l0 + l1) / 2)")} < 0.025 THEN (l0 + l1) / 2 ELSE l0 END,
  CASE WHEN {_TAIL.format(lo="k", hi="n + 1", p="((l0 + l1) / 2)")} < 0.025 THEN l1 ELSE (l0 + l1) / 2 END,
  CASE WHEN {_TAIL.format(lo="0", hi="k + 1", p="((h0 + h1) / 2)")} > 0.025 THEN (h0 + h1) / 2 ELSE h0 END,
  CASE WHEN {_TAIL.format(lo="0", hi="k + 1", p="((h0 + h1) / 2)")} > 0.025 THEN h1 ELSE (h0 + h1) / 2 END, step + 1 FROM bi WHERE step < 45)
"""


@query("sign_consistency", XR + _CP + f"""SELECT cluster_label, n, k AS n_same, {r("k / n", "share")}, {r("l0", "low")}, {r("CASE WHEN k = n THEN 1 ELSE h0 END", "high")} FROM bi WHERE step = 45""")
def _(spark, sf):
    return rounded(S.sign_consistency(_x(spark, sf), ["cluster_label"], "delta"))


@query("spearman", X + f""", k AS (SELECT cluster_label, rank() OVER (PARTITION BY cluster_label ORDER BY iv) + (count(*) OVER (PARTITION BY cluster_label, iv) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY cluster_label ORDER BY delta) + (count(*) OVER (PARTITION BY cluster_label, delta) - 1) / 2 AS ry FROM x)
SELECT cluster_label, count(*) AS n, {r("corr(rx, ry)", "rho")} FROM k GROUP BY 1""")
def _(spark, sf):
    return rounded(S.spearman(_x(spark, sf), ["cluster_label"], "iv", "delta"))


@query("session_correlation_distance", X + f""", m AS (SELECT session_id, cluster_label, CASE WHEN NOT (session_id = 's2' AND cluster_label > 1) THEN avg(val) END AS v FROM x GROUP BY 1, 2),
p AS (SELECT a.session_id AS a, b.session_id AS b, count(a.v + b.v) AS n, corr(a.v, b.v) AS c FROM m a JOIN m b ON a.cluster_label = b.cluster_label AND a.session_id < b.session_id AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2)
SELECT a, b, {r("CASE WHEN n < 2 OR c IS NULL THEN 1.0 ELSE least(greatest(1 - c, 0), 2) END", "distance")} FROM p""")
def _(spark, sf):
    m = _x(spark, sf).groupBy("session_id", "cluster_label").agg(F.avg("val").alias("v"))
    m = m.withColumn("v", F.when(~((F.col("session_id") == "s2") & (F.col("cluster_label") > 1)), F.col("v")))
    return rounded(S.correlation_distance(m, "session_id", "cluster_label", "v"))


# Leaf order by merging the least mean distance, one merge a step; a row without values comes last.
_ORDER = X.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT session_id, cluster_label, avg(val) AS v FROM x WHERE session_id <> 's5' GROUP BY 1, 2),
p AS (SELECT a.session_id AS a, b.session_id AS b, count(a.v + b.v) AS n, corr(a.v, b.v) AS c FROM m a JOIN m b ON a.cluster_label = b.cluster_label AND a.session_id < b.session_id GROUP BY 1, 2),
dm AS (SELECT map(list(a || ' ' || b), list(CASE WHEN n < 2 OR c IS NULL THEN 1.0 ELSE least(greatest(1 - c, 0), 2) END)) AS dm FROM p),
t AS (SELECT (SELECT list([s] ORDER BY s) FROM (SELECT DISTINCT session_id AS s FROM m)) AS g, dm FROM dm
 UNION ALL SELECT list_append(list_filter(g, lambda k, i: i <> best.i AND i <> best.j), list_concat(g[best.i], g[best.j])), dm FROM (
  SELECT g, dm, list_min(flatten(list_transform(range(1, len(g)), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j: struct_pack(
   d := list_avg(flatten(list_transform(g[i], lambda e: list_transform(g[j], lambda f: dm[least(e, f) || ' ' || greatest(e, f)])))), i := i, j := j))))) AS best
  FROM t WHERE len(g) > 1))
SELECT place - 1 AS place, names[place] AS session_id FROM (SELECT names, unnest(range(1, len(names) + 1)) AS place FROM (SELECT list_append(g[1], 's5') AS names FROM t WHERE len(g) = 1))"""


@query("session_row_order", _ORDER)
def _(spark, sf):
    m = _x(spark, sf).groupBy("session_id", "cluster_label").agg(F.avg("val").alias("v"))
    m = m.withColumn("v", F.when(F.col("session_id") != "s5", F.col("v")))
    return L.row_order(m, "session_id", "cluster_label", "v").select("place", "session_id")


@query("adjusted_rand", X + f""", c AS (SELECT session_id, cluster_label AS a, gesture_type AS b, count(*) AS n FROM x GROUP BY 1, 2, 3),
s AS (SELECT session_id, sum(n * (n - 1) / 2) ij, sum(n) n FROM c GROUP BY 1), sa AS (SELECT session_id, sum(m * (m - 1) / 2) a FROM (SELECT session_id, a, sum(n) m FROM c GROUP BY 1, 2) GROUP BY 1),
sb AS (SELECT session_id, sum(m * (m - 1) / 2) b FROM (SELECT session_id, b, sum(n) m FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT session_id, {r("(ij - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2))", "ari", 9)} FROM s JOIN sa USING (session_id) JOIN sb USING (session_id)""")
def _(spark, sf):
    return rounded(S.adjusted_rand(_x(spark, sf), "cluster_label", "gesture_type", ["session_id"]), 9)


@query("cross_neuron_summary", X + f""", p AS (SELECT gesture_type, cluster_label, session_id, avg(val) v FROM x GROUP BY 1, 2, 3)
SELECT gesture_type, cluster_label, {r("avg(v)", "response_mean")}, {r("CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) ELSE 0 END", "response_sem")}, count(*) AS n_sessions FROM p GROUP BY 1, 2""")
def _(spark, sf):
    x = _x(spark, sf).withColumn("kind", F.struct("gesture_type", "cluster_label")).withColumn("response", F.col("val"))
    return rounded(U.type_means(x, "session_id", "kind", ["response"]).select("kind.*", "response_mean", "response_sem", "n_sessions"))
