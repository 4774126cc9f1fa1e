"""FIT: model fits per series."""

from pyspark.sql import functions as F

from levelscan.operators import fits as M
from levelscan.queries.bindings import ALL_LV, LV, all_levels, levels, with_d_star
from levelscan.queries.registry import query, rounded

SER = ["task", "model"]


def _all(spark, d):
    # variances in thousands, so that all fits work on numbers near one
    return with_d_star(all_levels(spark, d)).withColumn("variance", F.col("variance") / 1000)


SV = "sv AS (SELECT * REPLACE (variance / 1000 AS variance) FROM lvd)"


def info_sql(n, k, sse):
    ll = f"(-{n} / 2.0 * (ln(2 * pi() * {sse} / {n}) + 1))"
    return f"CASE WHEN {sse} > 0 THEN 2.0 * {k} - 2 * {ll} END", f"CASE WHEN {sse} > 0 THEN {k} * ln({n}) - 2 * {ll} END"


def line_sql(src, keys, u, y="variance", where=""):
    """Non-negative a, b of y = a u + b, written out case by case."""
    a = "((n * suv - su * sv) / (n * suu - su * su))"
    b = f"((sv - {a} * su) / n)"
    def sse(x, c):
        return f"(svv - 2 * {x} * suv - 2 * {c} * sv + {x} * {x} * suu + 2 * {x} * {c} * su + n * {c} * {c})"
    return f"""q0 AS (SELECT {keys}, count(*) AS n, sum({u}) AS su, sum({y}) AS sv, sum(({u}) * ({u})) AS suu, sum(({u}) * {y}) AS suv, sum({y} * {y}) AS svv, regr_syy({y}, {y}) AS sst FROM {src} {where} GROUP BY ALL),
q1 AS (SELECT *, CASE WHEN abs(n * suu - su * su) > 1e-14 THEN {a} END AS a1, CASE WHEN abs(n * suu - su * su) > 1e-14 THEN {b} END AS b1, suv / suu AS a2, sv / n AS b3 FROM q0),
q2 AS (SELECT *, CASE WHEN a1 >= 0 AND b1 >= 0 THEN greatest({sse('a1', 'b1')}, 0) END AS s1, CASE WHEN a2 >= 0 THEN greatest({sse('a2', '0')}, 0) END AS s2, CASE WHEN b3 >= 0 THEN greatest({sse('0', 'b3')}, 0) END AS s3 FROM q1),
q3 AS (SELECT *, least(s1, s2, s3) AS sse FROM q2), q AS (SELECT *, CASE WHEN sse = s1 THEN a1 WHEN sse = s2 THEN a2 ELSE 0 END AS a, CASE WHEN sse = s1 THEN b1 WHEN sse = s2 THEN 0 ELSE b3 END AS b FROM q3)"""


A2, B2 = info_sql("n", "2", "sse")


@query("fit01_mixture2", f"WITH {ALL_LV}, {SV}, {line_sql('sv', 'task, model', 'accuracy * (1 - accuracy)')} SELECT task, model, n, round(a, 4) + 0.0 AS d_sq, round(b, 4) + 0.0 AS c, round(sse, 6) + 0.0 AS sse, round(1 - sse / sst, 6) + 0.0 AS r2, round({A2}, 4) + 0.0 AS aic, round({B2}, 4) + 0.0 AS bic FROM q")
def _(spark, d):
    f = rounded(M.fit_mixture2(_all(spark, d)), "sse", "r2")
    return rounded(f, "d_sq", "c", "aic", "bic", digits=4)


def _nnls_sql():
    """Every set of active columns of (p, 1-p, p(1-p)) solved by elimination."""
    x = ["p", "1 - p", "p * (1 - p)"]
    cross = ", ".join(f"sum(({x[i]}) * ({x[j]})) AS g{i}{j}" for i in range(3) for j in range(i, 3))
    rhs = ", ".join(f"sum(({x[i]}) * v) AS t{i}" for i in range(3))
    def g(i, j):
        return f"g{min(i, j)}{max(i, j)}"
    opts = []
    for i in range(3):
        opts.append(({i: f"t{i} / {g(i, i)}"}, "true"))
    for i in range(3):
        for j in range(i + 1, 3):
            dt = f"({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)})"
            opts.append(({i: f"(t{i} * {g(j, j)} - t{j} * {g(i, j)}) / {dt}", j: f"(t{j} * {g(i, i)} - t{i} * {g(i, j)}) / {dt}"}, f"abs({dt}) > 1e-14"))
    d3 = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
    opts.append(({0: f"(t0 * (g11 * g22 - g12 * g12) - g01 * (t1 * g22 - g12 * t2) + g02 * (t1 * g12 - g11 * t2)) / {d3}",
                  1: f"(g00 * (t1 * g22 - g12 * t2) - t0 * (g01 * g22 - g12 * g02) + g02 * (g01 * t2 - t1 * g02)) / {d3}",
                  2: f"(g00 * (g11 * t2 - t1 * g12) - g01 * (g01 * t2 - t1 * g02) + t0 * (g01 * g12 - g11 * g02)) / {d3}"}, f"abs({d3}) > 1e-14"))
    rows = [f"SELECT task, model, n, yy, sst, {', '.join(f'{c.get(k, 0)} AS c{k}' for k in range(3))}, g00, g01, g02, g11, g12, g22, t0, t1, t2 FROM s WHERE {w}" for c, w in opts]
    return f"""s AS (SELECT task, model, count(*) AS n, sum(v * v) AS yy, regr_syy(v, v) AS sst, {cross}, {rhs} FROM (SELECT task, model, accuracy AS p, variance AS v FROM sv) GROUP BY ALL), o AS ({' UNION ALL '.join(rows)}),
e AS (SELECT *, greatest(yy - 2 * (c0 * t0 + c1 * t1 + c2 * t2) + c0 * c0 * g00 + c1 * c1 * g11 + c2 * c2 * g22 + 2 * (c0 * c1 * g01 + c0 * c2 * g02 + c1 * c2 * g12), 0) AS sse FROM o WHERE c0 >= 0 AND c1 >= 0 AND c2 >= 0)
SELECT task, model, n, round(sse, 5) + 0.0 AS sse, round(1 - sse / sst, 5) + 0.0 AS r2 FROM e QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY sse) = 1"""


@query("fit02_mixture3", f"WITH {ALL_LV}, {SV}, {_nnls_sql()}")
def _(spark, d):
    return rounded(M.fit_mixture3(_all(spark, d)).select(*SER, "n", "sse", "r2"), "sse", "r2", digits=5)


FOLD = f"""fp AS (SELECT task, model, level, d_star, variance, gamma, power((d_star - level)::DOUBLE, gamma) AS u FROM sv, (SELECT -2.0::DOUBLE + 0.01::DOUBLE * unnest(range(0, 201)) AS gamma UNION ALL SELECT -0.5::DOUBLE + 1e-13::DOUBLE WHERE false) g WHERE level < d_star), {line_sql('fp', 'task, model, gamma', 'u')},
fw AS (SELECT * FROM q WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY round(sse, 9), gamma) = 1), fx AS (SELECT * FROM q WHERE n >= 3 AND abs(gamma + 0.5) < 1e-9),
fb AS (SELECT fw.task, fw.model, fw.n, CASE WHEN round(fw.sse, 9) < round(fx.sse, 9) THEN 3 ELSE 2 END AS k, CASE WHEN round(fw.sse, 9) < round(fx.sse, 9) THEN fw.gamma ELSE -0.5 END AS gamma, CASE WHEN round(fw.sse, 9) < round(fx.sse, 9) THEN fw.a ELSE fx.a END AS a, CASE WHEN round(fw.sse, 9) < round(fx.sse, 9) THEN fw.b ELSE fx.b END AS b, least(fw.sse, fx.sse) AS sse, fw.sst FROM fw JOIN fx USING (task, model)),
fa AS (SELECT sv.task, sv.model, 1 - sum(power(variance - (b + a * CASE WHEN level < d_star THEN power((d_star - level)::DOUBLE, gamma) ELSE 1 END), 2)) / regr_syy(variance, variance) AS r2_all FROM sv JOIN fb ON fb.task = sv.task AND fb.model = sv.model GROUP BY ALL)"""
A3, B3 = info_sql("n", "k", "sse")


@query("fit03_fold", f"WITH {ALL_LV}, {SV}, {FOLD} SELECT fb.task, fb.model, n, k, round(gamma, 4) + 0.0 AS gamma, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(CASE WHEN sst < 1e-15 THEN 0 ELSE 1 - sse / sst END, 4) + 0.0 AS r2_pre, round(r2_all, 4) + 0.0 AS r2_all, round({A3}, 4) + 0.0 AS aic, round({B3}, 4) + 0.0 AS bic FROM fb JOIN fa USING (task, model)")
def _(spark, d):
    f = M.fit_fold(_all(spark, d), refine=False).select(*SER, "n", "k", "gamma", "a", "b", "r2_pre", "r2_all", "aic", "bic")
    return rounded(f, "gamma", "a", "b", "r2_pre", "r2_all", "aic", "bic", digits=4)


@query("fit03b_fold_refined")
def _(spark, d):
    f = M.fit_fold(_all(spark, d)).select(*SER, "n", "k", "gamma", "a", "b", "r2_pre", "r2_all", "aic", "bic")
    return rounded(f, "gamma", "a", "b", "r2_pre", "r2_all", "aic", "bic", digits=4)


@query("fit04_logistic_ddm")
def _(spark, d):
    f = M.fit_logistic_ddm(_all(spark, d)).select(*SER, "n", "c0", "c1", "implied_d_star", "d_sq", "c", "r2_accuracy", "r2", "aic", "bic")
    return rounded(f, "c0", "c1", "implied_d_star", "d_sq", "c", "r2_accuracy", "r2", "aic", "bic", digits=3)


@query("fit05_cusp")
def _(spark, d):
    s = with_d_star(levels(spark, d)).withColumn("variance", F.col("variance") / 1000)
    return rounded(M.fit_cusp(s), "loss", "sse", "r2_accuracy", "r2", "aic", "bic", digits=4)


@query("fit06_compare_models")
def _(spark, d):
    s = with_d_star(levels(spark, d)).withColumn("variance", F.col("variance") / 1000)
    return rounded(M.compare_models(M.model_scores(s)), "mean_r2", "median_r2", digits=4)


@query("fit06b_compare_table", f"""WITH {ALL_LV}, s AS (SELECT task, level, model AS fit, round(accuracy, 4) AS r2, round(variance, 3) AS aic FROM lv WHERE task = 'events'), a AS (SELECT *, row_number() OVER (PARTITION BY task, level ORDER BY aic, fit) AS ra, row_number() OVER (PARTITION BY task, level ORDER BY r2 DESC, fit) AS rr FROM s)
SELECT fit, count(*) AS n_series, round(avg(r2), 6) + 0.0 AS mean_r2, round(quantile_cont(r2, 0.5::DOUBLE), 6) + 0.0 AS median_r2, count(*) FILTER (WHERE ra = 1) AS aic_wins, count(*) FILTER (WHERE rr = 1) AS r2_wins FROM a GROUP BY ALL""")
def _(spark, d):
    s = levels(spark, d).select("task", "level", F.col("model").alias("fit"), F.round("accuracy", 4).alias("r2"), F.round("variance", 3).alias("aic"), F.lit(0.0).alias("bic"))
    return rounded(M.compare_models(s, ["task", "level"]), "mean_r2", "median_r2")


@query("fit07_variance_shapes", f"""WITH {ALL_LV}, {SV}, pre AS (SELECT *, count(*) OVER (PARTITION BY task, model) AS nn FROM sv WHERE level <= d_star), pr AS (SELECT task, model, variance, alpha, power(greatest(d_star - level, 0.01)::DOUBLE, alpha) AS u FROM pre, (SELECT -5 + 10.0::DOUBLE * unnest(range(0, 165)) / 164 AS alpha) g WHERE nn >= 4),
o AS (SELECT task, model, alpha, count(*) AS n, regr_syy(variance, u) AS sst, regr_syy(variance, u) - CASE WHEN regr_sxx(variance, u) > 1e-14 THEN power(regr_sxy(variance, u), 2) / regr_sxx(variance, u) ELSE 0 END AS sse FROM pr GROUP BY ALL), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY round(sse, 9), alpha) = 1)
SELECT task, model, round(alpha, 4) + 0.0 AS alpha, round(1 - sse / sst, 4) + 0.0 AS power_r2, round(CASE WHEN n > 3 THEN n * ln(sse / n) + 6 END, 4) + 0.0 AS aic_power, round(n * ln(sst / n) + 2, 4) + 0.0 AS aic_null FROM b""")
def _(spark, d):
    f = M.variance_shapes(_all(spark, d)).select(*SER, "alpha", "power_r2", "aic_power", "aic_null")
    return rounded(f, "alpha", "power_r2", "aic_power", "aic_null", digits=4)
