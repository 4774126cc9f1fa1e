"""STA, CI, INF: tests, intervals and resampling."""

from pyspark.sql import functions as F

from levelscan.functions.special import erfc_sql
from levelscan.operators import resampling as B
from levelscan.operators import statistics as T
from levelscan.queries.bindings import ALL_LV, EV, LV, all_levels, ev_rows, levels, with_d_star
from levelscan.queries.registry import ORACLES, query, r6, rounded, table

SER = ["task", "model"]
INDICATORS = ["variance", "disagreement_rate", "bimodality_coefficient"]


def unpivot(lv, cols=INDICATORS, keep=("task", "model", "level")):
    pairs = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value")) for c in cols])
    return lv.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def unpivot_sql(src="lvd", cols=INDICATORS):
    return " UNION ALL ".join(f"SELECT task, model, level, d_star, accuracy, '{c}' AS indicator, {c} AS value FROM {src}" for c in cols)


UP = f"up AS ({unpivot_sql()})"


def t_sql(t, df):
    """Two-sided p of Student's t as SQL text, by lgamma sums."""
    th = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    even = f"sin({th}) * list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power(cos({th}), 2 * k)))"
    odd = f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * power(cos({th}), 2 * k + 1))), 0))"
    return f"greatest(1 - CASE WHEN ({df}) % 2 = 1 THEN {odd} ELSE {even} END, 0)"


def norm2_sql(z):
    return erfc_sql(f"abs({z}) / sqrt(2.0)")


# tau of every indicator against level: pairs listed, as a check of the inversion count
TAU = f"""{UP}, pr AS (SELECT a.task, a.model, a.indicator, count(*) AS n0, sum(sign(b.value - a.value) * sign(b.level - a.level)) AS s, count(*) FILTER (WHERE a.value = b.value) AS ty, sum(CASE WHEN sign(b.value - a.value) * sign(b.level - a.level) < 0 THEN 1 ELSE 0 END) AS dis
 FROM up a JOIN up b ON a.task = b.task AND a.model = b.model AND a.indicator = b.indicator AND a.level < b.level GROUP BY ALL),
tn AS (SELECT task, model, indicator, value, count(*) AS t FROM up GROUP BY ALL), tt AS (SELECT task, model, indicator, sum(t) AS n, sum(t*(t-1)*(2*t+5)) AS t1, sum(t*(t-1)*(t-2)) AS t0 FROM tn GROUP BY ALL),
mah AS (WITH RECURSIVE m AS (SELECT 1 AS n, [1.0::DOUBLE] AS f UNION ALL SELECT n + 1, list_transform(range(0, (n * (n + 1)) // 2 + 1), lambda k: list_sum(f[greatest(k - n, 0) + 1 : least(k, (n * (n - 1)) // 2) + 1])) FROM m WHERE n < 33) SELECT n, f, list_sum(f) AS tot FROM m),
tau AS (SELECT pr.task, pr.model, pr.indicator, tt.n::BIGINT AS n, CASE WHEN tt.n >= 3 AND n0 > ty THEN s / sqrt(n0 * (n0 - ty)::DOUBLE) ELSE 0.0 END AS tau,
 CASE WHEN tt.n < 3 OR n0 = ty THEN 1.0 WHEN ty = 0 AND tt.n <= 33 THEN CASE WHEN 4 * least(dis, n0 - dis) = tt.n * (tt.n - 1) THEN 1.0 ELSE least(1.0, 2 * list_sum(mah.f[1 : least(dis, n0 - dis)::BIGINT + 1]) / mah.tot) END
 ELSE {norm2_sql("(s / sqrt((tt.n * (tt.n - 1) * (2 * tt.n + 5) - tt.t1) / 18.0))")} END AS p_value
 FROM pr JOIN tt USING (task, model, indicator) LEFT JOIN mah ON mah.n = tt.n)"""


@query("sta01_kendall_tau", f"WITH {ALL_LV}, {TAU} SELECT task, model, indicator, n, round(tau, 6) + 0.0 AS tau FROM tau")
def _(spark, d):
    return rounded(T.kendall(unpivot(all_levels(spark, d)), [*SER, "indicator"], "level", "value", p_value=False), "tau")


@query("sta01b_kendall_tau_rows", """WITH x AS (SELECT l_returnflag AS g, l_quantity AS a, l_discount AS b, count(*) AS w FROM lineitem GROUP BY ALL),
p AS (SELECT x.g, sum(x.w * y.w * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM x JOIN x y ON x.g = y.g GROUP BY ALL),
ta AS (SELECT g, sum(t * (t - 1) / 2) AS t FROM (SELECT g, a, sum(w) AS t FROM x GROUP BY ALL) GROUP BY ALL), tb AS (SELECT g, sum(t * (t - 1) / 2) AS t FROM (SELECT g, b, sum(w) AS t FROM x GROUP BY ALL) GROUP BY ALL), n AS (SELECT g, sum(w)::BIGINT AS n FROM x GROUP BY ALL)
SELECT p.g, n.n, round(s / sqrt((n.n * (n.n - 1) / 2 - ta.t) * (n.n * (n.n - 1) / 2 - tb.t)), 6) + 0.0 AS tau FROM p JOIN ta USING (g) JOIN tb USING (g) JOIN n USING (g)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_discount")
    return rounded(T.kendall(li, ["g"], "l_quantity", "l_discount", large=True, p_value=False), "tau")


@query("sta02_kendall_pvalue", f"WITH {ALL_LV}, {TAU} SELECT task, model, indicator, n, round(tau, 6) + 0.0 AS tau, round(p_value, 6) + 0.0 AS p_value FROM tau")
def _(spark, d):
    return rounded(T.kendall(unpivot(all_levels(spark, d)), [*SER, "indicator"], "level", "value"), "tau", "p_value")


LR = f"""{UP}, lr AS (SELECT task, model, indicator, count(*) AS n, regr_slope(value, level) AS slope, regr_intercept(value, level) AS intercept, corr(level, value) AS r FROM up GROUP BY ALL)"""


def corr_p_sql(r, n):
    return f"CASE WHEN {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE {t_sql(f'({r} * sqrt(({n} - 2) / (1 - {r} * {r})))', f'({n} - 2)')} END"


@query("sta03_linregress", f"WITH {ALL_LV}, {LR} SELECT task, model, indicator, n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r * r, 6) + 0.0 AS r2, round({corr_p_sql('r', 'n')}, 6) + 0.0 AS p_value FROM lr")
def _(spark, d):
    return rounded(T.linregress(unpivot(all_levels(spark, d)), [*SER, "indicator"], "level", "value").drop("r"), "slope", "intercept", "r2", "p_value")


@query("sta04_spearman", f"""WITH {ALL_LV}, rk AS (SELECT task, model, rank() OVER (PARTITION BY task, model ORDER BY variance) + (count(*) OVER (PARTITION BY task, model, variance) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY task, model ORDER BY accuracy) + (count(*) OVER (PARTITION BY task, model, accuracy) - 1) / 2.0 AS ry FROM lv),
c AS (SELECT task, model, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY ALL) SELECT task, model, n, round(r, 6) + 0.0 AS rho, round({corr_p_sql('r', 'n')}, 6) + 0.0 AS p_value FROM c""")
def _(spark, d):
    return rounded(T.spearman(all_levels(spark, d), SER, "variance", "accuracy"), "rho", "p_value")


@query("sta05_pearson", f"""WITH {ALL_LV}, c AS (SELECT task, model, count(*) AS n, corr(variance, accuracy) AS r FROM lv GROUP BY ALL) SELECT task, model, n, round(r, 6) + 0.0 AS r, round({corr_p_sql('r', 'n')}, 6) + 0.0 AS p_value FROM c""")
def _(spark, d):
    return rounded(T.pearson(all_levels(spark, d), SER, "variance", "accuracy"), "r", "p_value")


@query("sta06_fisher_combine", f"""WITH {ALL_LV}, p AS (SELECT task, model, greatest(0.001::DOUBLE, 1 - disagreement_rate) AS p FROM lv), f AS (SELECT task, model, count(*) AS k, -2 * sum(ln(p)) AS chi2 FROM p GROUP BY ALL)
SELECT task, model, k, round(chi2, 6) + 0.0 AS chi2, round(CASE WHEN k >= 2 THEN exp(-chi2 / 2) * list_sum(list_transform(range(0, k), lambda i: power(chi2 / 2, i) / gamma(i + 1.0))) END, 6) + 0.0 AS p_combined FROM f""")
def _(spark, d):
    p = all_levels(spark, d).withColumn("p", F.greatest(F.lit(0.001), 1 - F.col("disagreement_rate")))
    return rounded(T.fisher_combine(p, SER, "p"), "chi2", "p_combined")


RK = """x AS (SELECT l_linenumber AS g, l_extendedprice AS v, l_returnflag AS side FROM lineitem WHERE l_returnflag IN ('A', 'R')),
rk AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, v) AS t FROM x),
mw AS (SELECT g, count(*) FILTER (WHERE side = 'A') AS n_a, count(*) FILTER (WHERE side = 'R') AS n_b, sum(r) FILTER (WHERE side = 'A') AS ra, sum(t * t - 1.0) AS ties FROM rk GROUP BY ALL),
u AS (SELECT g, n_a, n_b, ra - n_a * (n_a + 1) / 2.0 AS u, ties FROM mw),
z AS (SELECT *, (u - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS z FROM u)"""


def _two(spark, d, value="l_extendedprice"):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.col(value).alias("v"), F.col("l_returnflag").alias("side"))


@query("sta07_mann_whitney", f"""WITH {RK} SELECT g, n_a, n_b, u::DOUBLE AS u, round(CASE WHEN z >= 0 THEN {norm2_sql('z')} / 2 ELSE 1 - {norm2_sql('z')} / 2 END, 6) + 0.0 AS p_greater, round(2 * u / (n_a * n_b) - 1, 6) + 0.0 AS cliffs_delta FROM z""")
def _(spark, d):
    return rounded(T.mann_whitney(_two(spark, d), ["g"], "v", "side", "A", "R"), "p_greater", "cliffs_delta")


@query("sta08_paired_t", f"""WITH {LV}, a AS (SELECT model, accuracy - (1 - disagreement_rate) AS df FROM lv), s AS (SELECT model, count(*) AS n, avg(df) AS mean_diff, stddev_samp(df) AS sd, count(*) FILTER (WHERE df > 0) AS wins FROM a GROUP BY ALL), t AS (SELECT *, mean_diff / (sd / sqrt(n::DOUBLE)) AS t FROM s)
SELECT model, n, round(mean_diff, 6) + 0.0 AS mean_diff, wins, round(t, 6) + 0.0 AS t, round({t_sql('t', '(n - 1)')}, 6) + 0.0 AS p_value FROM t""")
def _(spark, d):
    lv = levels(spark, d).withColumn("b", 1 - F.col("disagreement_rate"))
    return rounded(T.paired_t(lv, ["model"], "accuracy", "b"), "mean_diff", "t", "p_value")


@query("sta09_tails", f"""WITH {LV}, z AS (SELECT model, level, (accuracy - 0.5) * 20 AS z FROM lv) SELECT model, level, round(CASE WHEN z >= 0 THEN 1 - {norm2_sql('z')} / 2 ELSE {norm2_sql('z')} / 2 END, 6) + 0.0 AS cdf, round({t_sql('z', '(level + 1)')}, 6) + 0.0 AS t_p FROM z""")
def _(spark, d):
    from levelscan.functions import special as D
    z = (F.col("accuracy") - 0.5) * 20
    return levels(spark, d).select("model", "level", r6(D.normal_cdf(z)).alias("cdf"), r6(D.t_two_sided(z, F.col("level") + 1)).alias("t_p"))


COHEN = """c AS (SELECT g, count(*) FILTER (WHERE side = 'A') AS n_a, count(*) FILTER (WHERE side = 'R') AS n_b, avg(v) FILTER (WHERE side = 'A') AS mean_a, avg(v) FILTER (WHERE side = 'R') AS mean_b, var_samp(v) FILTER (WHERE side = 'A') AS va, var_samp(v) FILTER (WHERE side = 'R') AS vb,
 stddev_pop(v) FILTER (WHERE side = 'A') AS std_a, stddev_pop(v) FILTER (WHERE side = 'R') AS std_b FROM x GROUP BY ALL), cd AS (SELECT *, CASE WHEN n_a >= 2 AND n_b >= 2 AND sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) > 1e-12 THEN (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) END AS cohens_d FROM c)"""


@query("sta10_cohens_d", f"WITH {RK}, {COHEN} SELECT g, n_a, n_b, round(mean_a, 6) + 0.0 AS mean_a, round(mean_b, 6) + 0.0 AS mean_b, round(std_a, 6) + 0.0 AS std_a, round(std_b, 6) + 0.0 AS std_b, round(cohens_d, 6) + 0.0 AS cohens_d FROM cd")
def _(spark, d):
    return rounded(T.cohens_d(_two(spark, d), ["g"], "v", "side", "A", "R"), "mean_a", "mean_b", "std_a", "std_b", "cohens_d")


@query("sta11_cliffs_delta", """WITH q AS (SELECT l_linenumber AS g, l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL)
SELECT x.g, round(sum(x.a * y.b * sign(x.v - y.v)) / sum(x.a * y.b), 6) + 0.0 AS cliffs_delta FROM q x JOIN q y ON x.g = y.g GROUP BY ALL""")
def _(spark, d):
    return rounded(T.cliffs_delta(_two(spark, d, "l_quantity"), ["g"], "v", "side", "A", "R"), "cliffs_delta")


DIST = """dv AS (SELECT g, v, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'R') AS b FROM x GROUP BY ALL),
dc AS (SELECT g, v, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY g) - sum(b) OVER w / sum(b) OVER (PARTITION BY g)) AS gap, lead(v) OVER w - v AS dx, sum(a) OVER (PARTITION BY g) AS na, sum(b) OVER (PARTITION BY g) AS nb FROM dv WINDOW w AS (PARTITION BY g ORDER BY v)),
ds2 AS (SELECT g, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, coalesce(sum(gap * dx), 0) AS wasserstein, max(gap) AS ks FROM dc GROUP BY ALL),
dk AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) * ks AS kx FROM ds2),
dp AS (SELECT *, CASE WHEN kx < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 51), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * kx * kx))), 0), 1) END AS ks_p FROM dk)"""


@query("sta12_wasserstein", f"WITH {RK}, {DIST} SELECT g, n_a, n_b, round(wasserstein, 6) + 0.0 AS wasserstein FROM dp")
def _(spark, d):
    return rounded(T.distribution_distances(_two(spark, d), ["g"], "v", "side", "A", "R").select("g", "n_a", "n_b", "wasserstein"), "wasserstein")


@query("sta13_ks_2samp", f"WITH {RK}, {DIST} SELECT g, round(ks, 6) + 0.0 AS ks, round(ks_p, 6) + 0.0 AS ks_p FROM dp")
def _(spark, d):
    return rounded(T.distribution_distances(_two(spark, d), ["g"], "v", "side", "A", "R").select("g", "ks", "ks_p"), "ks", "ks_p")


KL = """kr AS (SELECT g, min(v) - 1e-10 AS lo, max(v) + 1e-10 AS hi, count(*) FILTER (WHERE side = 'A') AS na, count(*) FILTER (WHERE side = 'R') AS nb FROM x GROUP BY ALL),
kb AS (SELECT x.g, least(floor((v - lo) / (hi - lo) * 50), 49) AS b, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'R') AS r FROM x JOIN kr USING (g) GROUP BY ALL),
kg AS (SELECT kr.g, i.b, coalesce(kb.a, 0) AS a, coalesce(kb.r, 0) AS r, na, nb FROM kr CROSS JOIN (SELECT unnest(range(0, 50)) AS b) i LEFT JOIN kb ON kb.g = kr.g AND kb.b = i.b),
kl AS (SELECT g, sum((a + 1) / (na + 50) * ln(((a + 1) / (na + 50)) / ((r + 1) / (nb + 50)))) AS kl FROM kg GROUP BY ALL)"""


@query("sta14_kl_binned", f"WITH {RK}, {KL} SELECT g, round(kl, 6) + 0.0 AS kl FROM kl")
def _(spark, d):
    return rounded(T.kl_binned(_two(spark, d), ["g"], "v", "side", "A", "R"), "kl")


KDE = """kq AS (SELECT g, v::DOUBLE AS v, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'R') AS b FROM x GROUP BY ALL),
ks3 AS (SELECT g, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 20 AS bw, count(*) FILTER (WHERE side = 'A') AS na, count(*) FILTER (WHERE side = 'R') AS nb, stddev_samp(v) FILTER (WHERE side = 'A') AS sa, stddev_samp(v) FILTER (WHERE side = 'R') AS sb FROM x GROUP BY ALL),
kp AS (SELECT *, bw / (hi - lo + 1e-8) * sa AS ha, bw / (hi - lo + 1e-8) * sb AS hb FROM ks3),
kx AS (SELECT kp.*, i, lo - 2 * bw + i * (hi - lo + 4 * bw) / 499 AS t FROM kp CROSS JOIN (SELECT unnest(range(0, 500)) AS i) z),
kd AS (SELECT kx.g, kx.i, any_value(hi - lo + 4 * bw) / 499 AS dx, least(sum(a * exp(-power(t - v, 2) / (2 * ha * ha))) / any_value(na * ha * sqrt(2 * pi())), sum(b * exp(-power(t - v, 2) / (2 * hb * hb))) / any_value(nb * hb * sqrt(2 * pi()))) AS m FROM kx JOIN kq ON kx.g = kq.g GROUP BY ALL),
ko AS (SELECT g, sum(m * dx * CASE WHEN i IN (0, 499) THEN 0.5 ELSE 1.0 END) AS overlap FROM kd GROUP BY ALL)"""
XQ = "x AS (SELECT l_linenumber AS g, l_quantity AS v, l_returnflag AS side FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("sta15_kde_overlap", f"WITH {XQ}, {KDE} SELECT g, round(overlap, 6) + 0.0 AS overlap FROM ko")
def _(spark, d):
    return rounded(T.kde_overlap(_two(spark, d, "l_quantity"), ["g"], "v", "side", "A", "R"), "overlap")


FS = """x AS (SELECT 'quantity' AS g, l_quantity AS v, l_returnflag AS side FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT 'discount', l_discount, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT 'tax', l_tax, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""


@query("sta16_feature_shift", f"""WITH {FS}, {COHEN}, {DIST}, {KL}, {KDE}
SELECT g, n_a, n_b, round(mean_a, 6) + 0.0 AS mean_a, round(std_a, 6) + 0.0 AS std_a, round(cohens_d, 6) + 0.0 AS cohens_d, round(wasserstein, 6) + 0.0 AS wasserstein, round(ks, 6) + 0.0 AS ks, round(ks_p, 6) + 0.0 AS ks_p, round(kl, 6) + 0.0 AS kl, round(overlap, 6) + 0.0 AS overlap,
 CAST(row_number() OVER (ORDER BY wasserstein DESC, g) AS INTEGER) AS rank FROM cd JOIN dp USING (g, n_a, n_b) JOIN kl USING (g) JOIN ko USING (g)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    pairs = F.array(*[F.struct(F.lit(n).alias("g"), F.col(c).alias("v")) for n, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax"))])
    x = li.select(F.col("l_returnflag").alias("side"), F.explode(pairs).alias("_p")).select("side", "_p.*")
    out = T.feature_shift(x, ["g"], "v", "side", "A", "R").drop("mean_b", "std_b")
    return rounded(out, "mean_a", "std_a", "cohens_d", "wasserstein", "ks", "ks_p", "kl", "overlap")


RAT = f"""{UP}, rat AS (SELECT task, model, indicator, CASE WHEN corr(level, value) > 0.3 THEN 1 WHEN corr(level, value) < -0.3 THEN -1 ELSE 0 END AS rating FROM up GROUP BY ALL)"""


def _ratings(spark, d):
    up = unpivot(all_levels(spark, d))
    r = T.safe_corr("level", "value")
    return up.groupBy(*SER, "indicator").agg(F.when(r > 0.3, 1).when(r < -0.3, -1).otherwise(0).alias("rating"))


@query("sta17_fleiss_kappa", f"""WITH {ALL_LV}, {RAT}, c AS (SELECT task, model, rating, count(*) AS c FROM rat GROUP BY ALL), s AS (SELECT task, model, sum(c) AS n, sum(c * c) AS q FROM c GROUP BY ALL), pj AS (SELECT sum(c) / (SELECT sum(c) FROM c) AS p FROM c GROUP BY rating)
SELECT (SELECT count(*) FROM s) AS n_subjects, round(((SELECT avg((q - n) / (n * (n - 1))) FROM s) - (SELECT sum(p * p) FROM pj)) / (1 - (SELECT sum(p * p) FROM pj)), 6) + 0.0 AS kappa""")
def _(spark, d):
    return rounded(T.fleiss_kappa(_ratings(spark, d), SER, "rating"), "kappa")


@query("sta18_concordance", f"""WITH {ALL_LV}, {RAT}, m AS (SELECT task, indicator, avg(rating) AS m FROM rat GROUP BY ALL) SELECT a.task AS task1, b.task AS task2, round(avg(CASE WHEN sign(a.m) = sign(b.m) OR (abs(a.m) < 0.1 AND abs(b.m) < 0.1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS concordance FROM m a JOIN m b USING (indicator) WHERE a.task < b.task GROUP BY ALL""")
def _(spark, d):
    return rounded(T.concordance(_ratings(spark, d), "task", "indicator", "rating"), "concordance")


Z = "1.959963984540054::DOUBLE"


@query("ci01_wilson", f"""WITH {LV} SELECT model, level, round(greatest((accuracy + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} / (1 + {Z} * {Z} / n) * sqrt(accuracy * (1 - accuracy) / n + {Z} * {Z} / (4 * n * n)), 0), 6) + 0.0 AS ci_low,
 round(least((accuracy + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} / (1 + {Z} * {Z} / n) * sqrt(accuracy * (1 - accuracy) / n + {Z} * {Z} / (4 * n * n)), 1), 6) + 0.0 AS ci_high FROM lv""")
def _(spark, d):
    lo, hi = T.wilson_ci(F.col("accuracy"), F.col("n"))
    return levels(spark, d).select("model", "level", r6(lo).alias("ci_low"), r6(hi).alias("ci_high"))


def halving_sql(below, lo, hi, steps=60):
    """The place between lo and hi where ``below`` (of the middle, x) turns false, by halving."""
    mid = "((a[1] + a[2]) / 2)"
    at = f"list_reduce(list_prepend([{lo}, {hi}]::DOUBLE[], list_transform(range({steps}), lambda i: [0, 0]::DOUBLE[])), lambda a, b: CASE WHEN {below.replace('{x}', mid)} THEN [{mid}, a[2]] ELSE [a[1], {mid}] END)"
    return f"(list_sum({at}) / 2)"


def binomial_tail_sql(first, last):
    """P(first <= X <= last) of a binomial count of n tries, at the chance {x}."""
    return f"list_sum(list_transform(range({first}, {last} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({{x}}) + (n - j) * ln(1 - {{x}}))))"


@query("ci02_clopper_pearson", f"""WITH {EV}, c AS (SELECT model, level, sum(correct::INTEGER)::BIGINT AS k, count(*) AS n FROM ev GROUP BY ALL)
SELECT model, level, k, n, round(CASE WHEN k = 0 THEN 0.0 ELSE {halving_sql(binomial_tail_sql('k', 'n') + ' < 0.025', 0, 1)} END, 6) + 0.0 AS ci_low,
 round(CASE WHEN k = n THEN 1.0 ELSE {halving_sql(binomial_tail_sql('0', 'k') + ' > 0.025', 0, 1)} END, 6) + 0.0 AS ci_high FROM c""")
def _(spark, d):
    c = ev_rows(spark, d).groupBy("model", "level").agg(F.sum(F.col("correct").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = T.clopper_pearson_ci(F.col("k"), F.col("n"))
    return c.select("model", "level", "k", "n", r6(lo).alias("ci_low"), r6(hi).alias("ci_high"))


@query("ci03_mean_ci95", f"""WITH {EV} SELECT model, count(x) AS n, round(avg(x), 6) + 0.0 AS mean_value, round(1.96 * stddev_samp(x) / sqrt(count(x)), 6) + 0.0 AS ci95, round(1.96 * stddev_pop(x) / sqrt(count(x)), 6) + 0.0 AS ci95_pop FROM ev GROUP BY ALL""")
def _(spark, d):
    e = ev_rows(spark, d)
    pop = T.mean_ci95(e, ["model"], "x", True).select("model", F.col("ci95").alias("ci95_pop"))
    return rounded(T.mean_ci95(e, ["model"], "x").join(pop, "model"), "mean_value", "ci95", "ci95_pop")


def hash_sql(parts, digits=8):
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, {digits}))::UBIGINT"


NREP = 1000
BOOT = f"""bp AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY level) - 1 AS pos, count(*) OVER (PARTITION BY model) AS nn FROM lvd),
bd AS (SELECT model, rep, ({hash_sql("'42', model, rep, pos", 15)} % nn)::BIGINT AS pos FROM bp, (SELECT unnest(range(1, {NREP + 1})) AS rep) r),
br AS (SELECT bd.model, bd.rep, bp.level, bp.d_star, bp.accuracy, bp.variance, bp.disagreement_rate, bp.bimodality_coefficient FROM bd JOIN bp ON bp.model = bd.model AND bp.pos = bd.pos)"""


def _mixed(x, shift, times):
    return f"(((xor({x}, {x} >> {shift}))::UHUGEINT * {times}) % 18446744073709551616)::UBIGINT"


def weights_sql(src, parts, cols):
    """CTE ``bw``: the Poisson(1) weight of every row of ``src`` in replicates 1..NREP, from its key by splitmix64."""
    from levelscan.operators.resampling import POISSON

    return f"""bw AS (SELECT {cols}, rep, len(list_filter({POISSON}::DOUBLE[], lambda t: t <= u)) AS w FROM (SELECT *, ((xor(z3, z3 >> 31)) >> 11)::DOUBLE / 9007199254740992 AS u FROM (SELECT *, {_mixed('z2', 27, 10723151780598845931)} AS z3
 FROM (SELECT *, {_mixed('z1', 30, 13787848793156543929)} AS z2 FROM (SELECT {cols}, rep, (({hash_sql(parts, 15)}::UHUGEINT + rep::UHUGEINT * 11400714819323198485) % 18446744073709551616)::UBIGINT AS z1 FROM {src}, range(1, {NREP + 1}) q(rep))))))"""


@query("inf01_bootstrap_ci", f"""WITH {LV}, {BOOT}, {weights_sql('lv', "'42', model, level", 'model, level, accuracy')}, s AS (SELECT model, rep, m, md FROM (SELECT model, rep, sum(w * accuracy) / sum(w) AS m FROM bw GROUP BY ALL) JOIN (SELECT model, rep, quantile_cont(accuracy, 0.5::DOUBLE) AS md FROM br GROUP BY ALL) USING (model, rep)), p AS (SELECT model, avg(accuracy) AS m, quantile_cont(accuracy, 0.5::DOUBLE) AS md FROM lv GROUP BY ALL)
SELECT 'mean' AS stat, s.model, round(any_value(p.m), 6) + 0.0 AS point, round(quantile_cont(s.m, 0.025::DOUBLE), 6) + 0.0 AS ci_low, round(quantile_cont(s.m, 0.975::DOUBLE), 6) + 0.0 AS ci_high, count(*) AS n_reps FROM s JOIN p USING (model) GROUP BY ALL
UNION ALL SELECT 'median', s.model, round(any_value(p.md), 6) + 0.0, round(quantile_cont(s.md, 0.025::DOUBLE), 6) + 0.0, round(quantile_cont(s.md, 0.975::DOUBLE), 6) + 0.0, count(*) FROM s JOIN p USING (model) GROUP BY ALL""")
def _(spark, d):
    lv = levels(spark, d)
    a = B.bootstrap_ci(lv, ["model"], "accuracy", ["level"], NREP, "mean").withColumn("stat", F.lit("mean"))
    b = B.bootstrap_ci(lv, ["model"], "accuracy", ["level"], NREP, "median").withColumn("stat", F.lit("median"))
    return rounded(a.unionByName(b), "point", "ci_low", "ci_high")


def _cdf(z):
    return f"(CASE WHEN {z} >= 0 THEN 1 - {erfc_sql(f'abs({z}) / sqrt(2.0)')} / 2 ELSE {erfc_sql(f'abs({z}) / sqrt(2.0)')} / 2 END)"


def _bca_end(z):
    return f"least(greatest({_cdf(f'(z0 + (z0 + {z}) / (1 - acc * (z0 + {z})))')}, {0.5 / NREP}), {1 - 0.5 / NREP}) * {NREP - 1}"


@query("inf02_bca_ci", f"""WITH {LV}, {weights_sql('lv', "'42', model, level", 'model, level, accuracy')}, s AS (SELECT model, rep, sum(w * accuracy) / sum(w) AS m FROM bw GROUP BY ALL),
p AS (SELECT model, count(accuracy) AS nn, avg(accuracy) AS point FROM lv GROUP BY ALL),
j AS (SELECT model, sum(((accuracy - point) / (nn - 1)) ** 3) AS d3, sum(((accuracy - point) / (nn - 1)) ** 2) AS d2 FROM lv JOIN p USING (model) WHERE nn >= 2 GROUP BY ALL),
r AS (SELECT model, avg((m < point)::INTEGER) AS share, list(m ORDER BY m) AS reps FROM s JOIN p USING (model) GROUP BY ALL),
z AS (SELECT *, CASE WHEN d2 > 0 THEN d3 / (6 * d2 ** 1.5) ELSE 0.0 END AS acc, {halving_sql(_cdf('{x}') + ' < least(greatest(share, 1e-8), 1 - 1e-8)', -10, 10)} AS z0 FROM p JOIN j USING (model) JOIN r USING (model)),
e AS (SELECT *, {_bca_end('-1.959963984540054')} AS lo_at, {_bca_end('1.959963984540054')} AS hi_at FROM z)
SELECT model, nn AS n, round(point, 6) + 0.0 AS point, {", ".join(f"round(reps[floor({s}_at)::INTEGER + 1] + (reps[least(floor({s}_at)::INTEGER + 2, {NREP})] - reps[floor({s}_at)::INTEGER + 1]) * ({s}_at - floor({s}_at)), 6) + 0.0 AS ci_{n}" for s, n in (("lo", "low"), ("hi", "high")))} FROM e""")
def _(spark, d):
    return rounded(B.bca_ci(levels(spark, d), ["model"], "accuracy", ["level"], NREP), "point", "ci_low", "ci_high")


@query("inf03_bootstrap_effect", f"""WITH {LV}, g AS (SELECT *, CASE WHEN level >= 20 THEN 'near' ELSE 'far' END AS side FROM lvd), {weights_sql('g', "'42', model, side, level", 'model, side, variance')},
m AS (SELECT model, side, rep, sum(w) AS n, sum(w * variance) / sum(w) AS mu FROM bw GROUP BY ALL), v AS (SELECT model, side, rep, any_value(n) AS n, any_value(mu) AS mu, sum(w * (variance - mu) ** 2) AS ss FROM bw JOIN m USING (model, side, rep) GROUP BY ALL),
d AS (SELECT a.model, (a.mu - b.mu) / sqrt((a.ss + b.ss) / (a.n + b.n - 2)) AS d FROM v a JOIN v b ON a.model = b.model AND a.rep = b.rep AND a.side = 'near' AND b.side = 'far' WHERE a.n >= 2 AND b.n >= 2)
SELECT model, round(quantile_cont(d, 0.025::DOUBLE), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975::DOUBLE), 6) + 0.0 AS ci_high, count(d) AS n_reps FROM d GROUP BY ALL""")
def _(spark, d):
    lv = levels(spark, d).withColumn("side", F.when(F.col("level") >= 20, "near").otherwise("far"))
    return rounded(B.bootstrap_effect(lv, ["model"], "variance", "side", "near", "far", ["level"], NREP), "ci_low", "ci_high")


@query("inf04_bootstrap_lead_time", f"""WITH {LV}, pre AS (SELECT * FROM lvd WHERE level <= d_star), {weights_sql('pre', "'42', concat_ws('|', task, model), level", 'task, model, level, d_star, bimodality_coefficient')},
s AS (SELECT task, model, rep, max(d_star) - min(level) FILTER (WHERE bimodality_coefficient > 0.7 AND w > 0) AS stat FROM bw GROUP BY ALL), q AS (SELECT task, model, quantile_cont(stat, 0.025::DOUBLE) AS lo, quantile_cont(stat, 0.975::DOUBLE) AS hi, count(stat) AS n_reps, avg(stat) AS mean_lead FROM s GROUP BY ALL), n AS (SELECT task, model, count(*) AS n_levels FROM pre GROUP BY ALL)
SELECT task, model, n_reps, n_levels, round(CASE WHEN n_levels >= 4 AND n_reps >= 20 THEN lo END, 6) + 0.0 AS ci_low, round(CASE WHEN n_levels >= 4 AND n_reps >= 20 THEN hi END, 6) + 0.0 AS ci_high, round(CASE WHEN n_levels >= 4 AND n_reps >= 20 THEN mean_lead END, 6) + 0.0 AS mean_lead FROM q JOIN n USING (task, model)""")
def _(spark, d):
    out = B.bootstrap_lead_time(with_d_star(levels(spark, d)), F.col("bimodality_coefficient") > 0.7, NREP)
    return rounded(out, "ci_low", "ci_high", "mean_lead")


@query("inf05_paired_permutation_f1", f"""WITH b AS (SELECT event_type AS model, event_id AS id, CAST(value > 60 AS INT) AS y, CAST(value > 40 AS INT) AS a, CAST(value + user_id > 110 AS INT) AS b FROM events),
r AS (SELECT b.*, rep, rep > 0 AND {hash_sql("'7', model, rep, id")} % 2 = 1 AS sw FROM b, (SELECT unnest(range(0, 1001)) AS rep) q), t AS (SELECT model, rep, y, CASE WHEN sw THEN b ELSE a END AS l, CASE WHEN sw THEN a ELSE b END AS r FROM r),
f AS (SELECT model, rep, 2.0 * sum(l * y) / (sum(l) + sum(y)) - 2.0 * sum(r * y) / (sum(r) + sum(y)) AS gap FROM t GROUP BY ALL)
SELECT p.model, round(any_value(o.gap), 6) + 0.0 AS observed, round(avg(CASE WHEN abs(p.gap) >= abs(o.gap) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p_value FROM f p JOIN f o ON o.model = p.model AND o.rep = 0 WHERE p.rep > 0 GROUP BY ALL""")
def _(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), "event_id", (v > 60).cast("int").alias("y"), (v > 40).cast("int").alias("a"), (v + F.col("user_id") > 110).cast("int").alias("b"))
    return rounded(B.paired_permutation_f1(e, ["model"], "event_id", "y", "a", "b", 1000, 7), "observed", "p_value")


def _perm_sql(c):
    return f"SELECT model, {c}, row_number() OVER (PARTITION BY model ORDER BY {hash_sql(f"'42', '{c}', level")}, level) AS r FROM lv"


@query("inf06_permute_within", f"""WITH {LV}, b AS (SELECT model, level, n, row_number() OVER (PARTITION BY model ORDER BY level) AS r FROM lv), v AS ({_perm_sql('variance')}), a AS ({_perm_sql('accuracy')})
SELECT b.model, b.level, b.n, round(v.variance, 6) + 0.0 AS variance, round(a.accuracy, 6) + 0.0 AS accuracy FROM b JOIN v ON v.model = b.model AND v.r = b.r JOIN a ON a.model = b.model AND a.r = b.r""")
def _(spark, d):
    lv = levels(spark, d).select("model", "level", "n", "variance", "accuracy")
    return rounded(B.permute_within(lv, ["variance", "accuracy"], ["model"], "level"), "variance", "accuracy")
