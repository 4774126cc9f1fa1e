"""Model fits per series as grouped least squares.

The linear part of every model is solved in closed form from sums per series; nonlinear parameters are a
literal grid inside each row, and the best grid point per series is an aggregate.  Rows are levels,
so a fit is (levels x grid points) small rows however large the response table was.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.operators.statistics import safe_corr
from levelscan.plans.session import cut_lineage

SERIES = ("task", "model")


def _sse(syy, terms, gram):
    """sum (y - sum a_i x_i)^2 from cross sums; terms: [(coef, sum x_i y)], gram: {(i, j): sum x_i x_j}."""
    out = syy
    for i, (a, t) in enumerate(terms):
        out = out - 2 * a * t
        for j, (b, _t) in enumerate(terms):
            out = out + a * b * gram[min(i, j), max(i, j)]
    return out


def _solve(gram, rhs):
    """Coefficients of the normal equations for up to three columns (Cramer's rule)."""
    n = len(rhs)
    g = [[gram[min(i, j), max(i, j)] for j in range(n)] for i in range(n)]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        minors = [det([r[:c] + r[c + 1 :] for r in m[1:]]) for c in range(3)]
        return m[0][0] * minors[0] - m[0][1] * minors[1] + m[0][2] * minors[2]

    d = det(g)
    cols = []
    for k in range(n):
        m = [[rhs[i] if j == k else g[i][j] for j in range(n)] for i in range(n)]
        cols.append(F.when(F.abs(d) > 1e-14, det(m) / d))
    return cols


def nonneg_fit(sums: DataFrame, names: Sequence[str], prefix: str = "") -> DataFrame:
    """Non-negative least squares from sums, exact by trying every set of active columns.

    ``sums`` has ``_g_i_j`` (cross sums), ``_t_i`` (sums with y) and ``_yy``.  Adds the coefficients and ``sse``.
    """
    k = len(names)
    options = []
    for size in range(1, k + 1):
        for act in itertools.combinations(range(k), size):
            gram = {(a, b): F.col(f"_g_{act[a]}_{act[b]}") for a in range(size) for b in range(a, size)}
            rhs = [F.col(f"_t_{i}") for i in act]
            tag = "".join(map(str, act))
            coef = _solve(gram, rhs)
            sums = sums.withColumns({f"_c{tag}_{i}": c for i, c in zip(act, coef)})
            cs = [F.col(f"_c{tag}_{i}") for i in act]
            ok = reduce(lambda x, y: x & y, [c >= 0 for c in cs])
            sums = sums.withColumn(f"_s{tag}", F.when(ok, F.greatest(_sse(F.col("_yy"), list(zip(cs, rhs)), gram), F.lit(0.0))))
            values = [F.coalesce(F.col(f"_c{tag}_{i}"), F.lit(0.0)) if i in act else F.lit(0.0) for i in range(k)]
            options.append(F.struct(F.col(f"_s{tag}").alias("sse"), *[v.alias(n) for v, n in zip(values, names)]))
    zero = F.struct(F.col("_yy").alias("sse"), *[F.lit(0.0).alias(n) for n in names])
    best = F.array_min(F.filter(F.array(zero, *options), lambda o: o["sse"].isNotNull()))
    keep = [c for c in sums.columns if not c.startswith(("_c", "_s", "_g", "_t"))]
    return sums.withColumn("_best", best).select(*keep, *[F.col(f"_best.{n}").alias(prefix + n) for n in names], F.col("_best.sse").alias("sse"))


def cross_sums(rows: DataFrame, keys: Sequence[str], basis: Sequence[Column], y: str) -> DataFrame:
    k = len(basis)
    v = F.col(y).cast("double")
    rows = rows.select(*keys, v.alias("_y"), *[b.cast("double").alias(f"_b{i}") for i, b in enumerate(basis)])
    b = [F.col(f"_b{i}") for i in range(k)]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.regr_syy("_y", "_y").alias("sst"),
        *[F.sum(b[i] * b[j]).alias(f"_g_{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(b[i] * F.col("_y")).alias(f"_t_{i}") for i in range(k)])


def r2_of(sse: Column, sst: Column) -> Column:
    return F.when(sst < 1e-15, 0.0).otherwise(1 - sse / sst)


def information(n: Column, k, sse: Column) -> tuple[Column, Column]:
    """AIC and BIC under Gaussian errors."""
    ll = -n / 2.0 * (F.ln(2 * np.pi * sse / n) + 1)
    ok = (n > 0) & (sse > 0)
    return F.when(ok, 2.0 * k - 2 * ll), F.when(ok, k * F.ln(n.cast("double")) - 2 * ll)


def _scored(df: DataFrame, k) -> DataFrame:
    aic, bic = information(F.col("n"), k, F.col("sse"))
    return df.withColumns({"r2": r2_of(F.col("sse"), F.col("sst")), "aic": aic, "bic": bic}).drop("sst", "_yy")


def fit_mixture2(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """variance = d_sq * p(1-p) + c, both non-negative."""
    p = F.col("accuracy")
    return _scored(nonneg_fit(cross_sums(series, keys, [p * (1 - p), F.lit(1.0)], "variance"), ["d_sq", "c"]), 2)


def fit_mixture3(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """variance = s_c p + s_i (1-p) + d_sq p(1-p), all non-negative."""
    p = F.col("accuracy")
    return _scored(nonneg_fit(cross_sums(series, keys, [p, 1 - p, p * (1 - p)], "variance"), ["s_c", "s_i", "d_sq"]), 3)


def grid_fit(rows: DataFrame, keys: Sequence[str], grid: Mapping[str, Sequence[float] | Column], basis: Callable[..., Column], y: str) -> DataFrame:
    """y = a * basis(level, grid point) + b by ordinary least squares at every grid point; the best point per series.

    ``grid``: lists of values, or array columns of the row (series-dependent grids).
    """
    keys, names = list(keys), list(grid)
    for name, values in grid.items():
        arr = values if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])
        rows = rows.withColumn(name, F.explode(arr))
    u = basis(*[F.col(n) for n in names])
    work = rows.select(*keys, *names, u.cast("double").alias("_u"), F.col(y).cast("double").alias("_v")).where(F.col("_u").isNotNull() & ~F.isnan("_u"))
    g = work.groupBy(*keys, *names).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("_v", "_u").alias("_sxx"), F.regr_sxy("_v", "_u").alias("_sxy"), F.regr_syy("_v", "_u").alias("sst"),
        F.avg("_u").alias("_mu"), F.avg("_v").alias("_mv"))
    a = F.when(F.col("_sxx") > 1e-14, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    g = g.withColumn("a", a).withColumns({"b": F.col("_mv") - F.col("a") * F.col("_mu"), "sse": F.greatest(F.col("sst") - F.col("a") * F.col("_sxy"), F.lit(0.0))})
    best = F.min_by(F.struct("n", *names, "a", "b", "sse", "sst"), F.struct(F.round("sse", 9), *names))
    return g.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def fit_fold(series: DataFrame, keys: Sequence[str] = SERIES, points: int = 201, refine: bool = True) -> DataFrame:
    """variance = a (d* - level)^gamma + b below d*, a, b >= 0, gamma = -0.5 or free in [-2, 0]; needs three points."""
    keys = list(keys)
    series = cut_lineage(series)
    pre = series.where(F.col("level") < F.col("d_star")).withColumn("_dist", (F.col("d_star") - F.col("level")).cast("double"))

    def at(rows: DataFrame, gammas: Column) -> DataFrame:
        rows = rows.withColumn("gamma", F.explode(gammas))
        sums = cross_sums(rows, [*keys, "gamma"], [F.pow("_dist", F.col("gamma")), F.lit(1.0)], "variance")
        fit = nonneg_fit(sums, ["a", "b"]).where("n >= 3")
        return fit.groupBy(*keys).agg(F.min_by(F.struct("n", "gamma", "a", "b", "sse", "sst"), F.struct(F.round("sse", 9), "gamma")).alias("_f"))

    step = 2.0 / (points - 1)
    grid = F.array(*[F.lit(-2.0 + step * i) for i in range(points)])
    free = at(pre, grid)
    if refine:
        near = free.select(*keys, F.col("_f.gamma").alias("_g0"))
        fine = F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda i: F.least(F.greatest(F.col("_g0") + i * (step / 20), F.lit(-2.0)), F.lit(0.0)))
        free = at(pre.join(near, keys), F.array_distinct(fine))
    fixed = at(pre, F.array(F.lit(-0.5))).withColumnRenamed("_f", "_x")
    both = free.join(fixed, keys)
    better = F.round(F.col("_f.sse"), 9) < F.round(F.col("_x.sse"), 9)
    out = both.withColumns({"_b": F.when(better, F.col("_f")).otherwise(F.col("_x")), "k": F.when(better, 3).otherwise(2)}).select(*keys, "k", "_b.*")
    scored = _scored(out, F.col("k")).withColumnsRenamed({"r2": "r2_pre"})
    everything = series.select(*keys, "level", "d_star", "variance").join(scored.select(*keys, "a", "b", "gamma"), keys)
    pred = F.when(F.col("level") < F.col("d_star"), F.col("a") * F.pow((F.col("d_star") - F.col("level")).cast("double"), F.col("gamma"))).otherwise(F.col("a")) + F.col("b")
    full = everything.withColumn("_e", F.pow(F.col("variance") - pred, 2)).groupBy(*keys).agg(F.sum("_e").alias("_sse"), F.regr_syy("variance", "variance").alias("_sst"))
    return scored.join(full.select(*keys, r2_of(F.col("_sse"), F.col("_sst")).alias("r2_all")), keys)


def fit_logistic_ddm(series: DataFrame, keys: Sequence[str] = SERIES, rounds: int = 6, width: int = 12) -> DataFrame:
    """Sigmoid accuracy by a zooming grid on (midpoint, slope), then variance = d_sq * p(1-p) + c on the fitted accuracy."""
    keys = list(keys)
    series = cut_lineage(series)
    # logit at the mean level and slope are nearly independent, so a zooming grid does not drift
    box = series.groupBy(*keys).agg(F.avg("level").alias("x0"), F.lit(0.0).alias("u"), F.lit(6.0).alias("uh"), F.lit(0.0).alias("s"), F.lit(2.0).alias("sh"))
    steps = F.sequence(F.lit(-width), F.lit(width))

    def sigmoid(u, s):
        return 1.0 / (1.0 + F.exp(F.least(F.greatest(-(u + s * (F.col("level") - F.col("x0"))), F.lit(-500.0)), F.lit(500.0))))

    for _ in range(rounds):
        rows = series.select(*keys, "level", "accuracy").join(box, keys)
        rows = rows.withColumn("_u", F.explode(F.transform(steps, lambda i: F.col("u") + F.col("uh") * i / width))).withColumn(
            "_s", F.explode(F.transform(steps, lambda i: F.col("s") + F.col("sh") * i / width)))
        sse = rows.groupBy(*keys, "x0", "_u", "_s", "uh", "sh").agg(F.sum(F.pow(F.col("accuracy") - sigmoid(F.col("_u"), F.col("_s")), 2)).alias("_e"))
        best = sse.groupBy(*keys).agg(F.min_by(F.struct("x0", "_u", "_s", "uh", "sh"), F.struct("_e", "_u", "_s")).alias("_b"))
        box = cut_lineage(best.select(*keys, "_b.x0", F.col("_b._u").alias("u"), (F.col("_b.uh") * 2.0 / width).alias("uh"), F.col("_b._s").alias("s"), (F.col("_b.sh") * 2.0 / width).alias("sh")))
    rows = series.join(box.select(*keys, "x0", "u", "s"), keys)
    p = sigmoid(F.col("u"), F.col("s"))
    rows = rows.withColumn("_p", p)
    acc = rows.groupBy(*keys).agg(
        F.sum(F.pow(F.col("accuracy") - F.col("_p"), 2)).alias("_sa"), F.regr_syy("accuracy", "accuracy").alias("_ta"), F.max(F.col("u") - F.col("s") * F.col("x0")).alias("c0"), F.max("s").alias("c1"))
    var = _scored(nonneg_fit(cross_sums(rows, keys, [F.col("_p") * (1 - F.col("_p")), F.lit(1.0)], "variance"), ["d_sq", "c"]), 4)
    acc = acc.select(*keys, "c0", "c1", r2_of(F.col("_sa"), F.col("_ta")).alias("r2_accuracy"),
                     F.when(F.abs("c1") > 1e-10, -F.col("c0") / F.col("c1")).alias("implied_d_star"))
    return var.join(acc, keys)


def cusp_moments(spark, alphas: Sequence[float], betas: Sequence[float], sigmas: Sequence[float], reach: float = 5.0, points: int = 500) -> DataFrame:
    """Variance and P(x > 0) of the cusp stationary density for every (alpha, beta, sigma)."""
    x = np.linspace(-reach, reach, points)
    base = spark.range(len(betas) * len(sigmas)).select(
        F.get(F.array(*[F.lit(float(b)) for b in betas]), (F.col("id") / len(sigmas)).cast("int")).alias("beta"),
        F.get(F.array(*[F.lit(float(s)) for s in sigmas]), (F.col("id") % len(sigmas)).cast("int")).alias("sigma"),
        F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("ai", "alpha"))

    def moments(batches):
        for pdf in batches:
            a, b, s = (pdf[c].to_numpy()[:, None] for c in ("alpha", "beta", "sigma"))
            e = 2.0 / s**2 * (a * x + b * x**2 / 2 - x**4 / 4)
            w = np.exp(e - e.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            mean = (w * x).sum(1)
            yield pd.DataFrame({
                "ai": pdf["ai"], "beta": pdf["beta"], "sigma": pdf["sigma"], "var_hat": np.maximum((w * x**2).sum(1) - mean**2, 0.0),
                "acc_hat": np.clip(w[:, x > 0].sum(1), 0.01, 0.99)})

    return base.mapInPandas(moments, "ai int, beta double, sigma double, var_hat double, acc_hat double")


def fit_cusp(
    series: DataFrame, keys: Sequence[str] = SERIES, a0: Sequence[float] = (1, 2, 3, 4, 6), a1: Sequence[float] = (-10, -8, -6, -4, -3, -2, -1),
    betas: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 3.0), sigmas: Sequence[float] = (0.5, 0.8, 1.0, 1.5),
) -> DataFrame:
    """Cusp model with alpha = a0 + a1 * level / max level: joint loss on a parameter grid, then linear rescaling.

    Values differ from a continuous optimiser by the grid; the moments come from one shared lookup table.
    """
    keys = list(keys)
    series = cut_lineage(series)
    step, lo = 0.1, float(min(a0) + min(a1))
    alphas = np.round(np.arange(lo, max(a0) + step, step), 10)
    table = cut_lineage(cusp_moments(series.sparkSession, alphas, betas, sigmas))
    full = W.partitionBy(*keys)
    s = series.withColumns({
        "_x": F.col("level") / F.greatest(F.max("level").over(full), F.lit(1)),
        "_sv": F.stddev_pop("variance").over(full), "_sa": F.stddev_pop("accuracy").over(full)})
    one = F.lit(1.0)
    s = s.withColumns({"_sv": F.when(F.col("_sv") > 1e-10, F.col("_sv")).otherwise(one), "_sa": F.when(F.col("_sa") > 1e-10, F.col("_sa")).otherwise(one)})
    grid = {"a0": a0, "a1": a1, "beta": betas, "sigma": sigmas}
    rows = s
    for n, vals in grid.items():
        rows = rows.withColumn(n, F.explode(F.array(*[F.lit(float(v)) for v in vals])))
    rows = rows.withColumn("ai", F.round((F.col("a0") + F.col("a1") * F.col("_x") - lo) / step).cast("int")).join(table, ["ai", "beta", "sigma"])
    loss = F.pow((F.col("acc_hat") - F.col("accuracy")) / F.col("_sa"), 2) + F.pow((F.col("var_hat") - F.col("variance")) / F.col("_sv"), 2)
    g = rows.groupBy(*keys, *grid).agg(
        F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("n"),
        F.regr_sxx("variance", "var_hat").alias("_xx"), F.regr_sxy("variance", "var_hat").alias("_xy"), F.regr_syy("variance", "var_hat").alias("sst"), safe_corr("accuracy", "acc_hat").alias("_ra"),
        F.min(F.when(27 * F.pow(F.col("a0") + F.col("a1") * F.col("_x"), 2) < 4 * F.pow("beta", 3), F.col("level"))).alias("bimodal_from"),
        F.max(F.when(27 * F.pow(F.col("a0") + F.col("a1") * F.col("_x"), 2) < 4 * F.pow("beta", 3), F.col("level"))).alias("bimodal_to"))
    best = F.min_by(F.struct(*grid, "n", "loss", "_xx", "_xy", "sst", "_ra", "bimodal_from", "bimodal_to"), F.struct(F.round("loss", 9), *grid))
    b = g.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    sse = F.when(F.col("_xx") > 1e-12, F.greatest(F.col("sst") - F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0))).otherwise(F.col("sst"))
    b = b.withColumns({"sse": sse, "r2_accuracy": F.coalesce(F.col("_ra") * F.col("_ra"), F.lit(0.0))}).drop("_xx", "_xy", "_ra")
    return _scored(b, 6)


def model_scores(series: DataFrame, keys: Sequence[str] = SERIES, cusp: bool = True, **fold) -> DataFrame:
    """Long table (series, fit, r2, aic, bic) of the mixture, fold, drift and cusp fits."""
    keys = list(keys)
    series = cut_lineage(series)
    two = fit_mixture2(series, keys).select(*keys, "r2", "aic", "bic")
    three = fit_mixture3(series, keys).select(*keys, F.col("r2").alias("_r"), F.col("aic").alias("_a"), F.col("bic").alias("_b"))
    m = two.join(three, keys)
    better = F.col("_r") > F.col("r2")
    mix = m.select(*keys, *[F.when(better, F.col(x)).otherwise(F.col(c)).alias(c) for x, c in (("_r", "r2"), ("_a", "aic"), ("_b", "bic"))])
    parts = {"mixture": mix, "fold": fit_fold(series, keys, **fold).withColumnRenamed("r2_all", "r2"), "drift": fit_logistic_ddm(series, keys)}
    if cusp:
        parts["cusp"] = fit_cusp(series, keys)
    return reduce(DataFrame.unionByName, [p.select(*keys, F.lit(n).alias("fit"), "r2", "aic", "bic") for n, p in parts.items()])


def compare_models(scores: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean and median r2, and number of series won by AIC and by r2, per fit."""
    w = W.partitionBy(*keys)
    ra = F.row_number().over(w.orderBy(F.col("aic").asc_nulls_last(), "fit"))
    rr = F.row_number().over(w.orderBy(F.col("r2").desc_nulls_last(), "fit"))
    s = scores.withColumns({"_a": ra, "_r": rr})
    return s.groupBy("fit").agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("r2").alias("mean_r2"), F.percentile("r2", 0.5).alias("median_r2"),
        F.sum(((F.col("_a") == 1) & F.col("aic").isNotNull()).cast("long")).alias("aic_wins"), F.sum(((F.col("_r") == 1) & F.col("r2").isNotNull()).cast("long")).alias("r2_wins"))


def variance_shapes(series: DataFrame, keys: Sequence[str] = SERIES, points: int = 41) -> DataFrame:
    """Power law, bump, S-curve and flat fits of variance up to d*, compared by n ln(RSS/n) + 2k; four levels at least.

    ``best_code``: 1 power law, 2 bump, 3 S-curve, 4 flat.
    """
    keys = list(keys)
    pre = cut_lineage(series.where(F.col("level") <= F.col("d_star"))).withColumns({
        "_lo": F.min("level").over(W.partitionBy(*keys)), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))}).where("_n >= 4")
    d, top = F.col("level").cast("double"), F.col("d_star").cast("double")
    half = points // 2

    def span(a: Column, b: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + (b - a) * i / (n - 1))

    centre = span(F.col("_lo") - 5.0, top + 5.0, points)
    fits = {
        "power": (3, grid_fit(pre, keys, {"alpha": [-5 + 10 * i / (4 * points) for i in range(4 * points + 1)]}, lambda a: F.pow(F.greatest(top - d, F.lit(0.01)), a), "variance")),
        "bump": (4, grid_fit(pre, keys, {"mu": centre, "width": span(F.lit(0.1), F.greatest(top * 2, F.lit(1.0)), half)}, lambda m, s: F.exp(-F.pow(d - m, 2) / (2 * s * s + 1e-10)), "variance")),
        "logistic": (4, grid_fit(pre, keys, {"slope": [0.05 * 1.3**i for i in range(20)], "mid": centre}, lambda k, m: 1.0 / (1.0 + F.exp(-k * (d - m))), "variance")),
    }
    flat = pre.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_syy("variance", "variance").alias("sse"))

    def aic(k):
        n = F.col("n")
        return F.when((F.col("sse") > 0) & (n > k), n * F.ln(F.col("sse") / n) + 2.0 * k)

    out = flat.select(*keys, aic(1).alias("aic_null"))
    for name, (k, f) in fits.items():
        extra = [F.col("alpha"), F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("power_r2")] if name == "power" else []
        out = out.join(f.select(*keys, aic(k).alias(f"aic_{name}"), *extra), keys)
    opts = F.array(*[F.struct(F.col(f"aic_{n}").alias("aic"), F.lit(i + 1).alias("code")) for i, n in enumerate((*fits, "null"))])
    best = F.array_min(F.filter(opts, lambda o: o["aic"].isNotNull()))["code"]
    return out.withColumns({"best_code": F.coalesce(best, F.lit(4)), "delta_aic": F.col("aic_power") - F.col("aic_null"), "alpha_in_range": F.col("alpha").between(-0.7, -0.3)})
