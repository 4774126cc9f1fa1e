"""SER: analyses of level series."""

from pyspark.sql import functions as F

from levelscan.operators import series as S
from levelscan.queries.bindings import ALL_LVM, LVM, all_levels, levels, with_d_star
from levelscan.queries.registry import query, rounded
from levelscan.queries.statistics import TAU, corr_p_sql, unpivot_sql, weights_sql

SER = ["task", "model"]
PW = "PARTITION BY task, model ORDER BY level"
COLS = S.TREND_COLUMNS


def tau_cte(src="lvd", cols=COLS, name="up", where=""):
    """TAU over another long table."""
    base = f"{name} AS (SELECT * FROM ({unpivot_sql(src, cols)}) WHERE value IS NOT NULL {where})"
    return base + TAU[TAU.index(", pr AS"):].replace(" up ", f" {name} ").replace("FROM up", f"FROM {name}").replace("JOIN up", f"JOIN {name}")


def _all(spark, d):
    return with_d_star(all_levels(spark, d, True))


SC = f"""pt AS (SELECT task, model, ln(variance) AS y, ln((d_star - level)::DOUBLE) AS x FROM lvd WHERE level < d_star AND variance > 0), sc AS (SELECT task, model, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN regr_slope(y, x) END AS alpha, CASE WHEN count(*) >= 3 THEN regr_r2(y, x) END AS r2 FROM pt GROUP BY ALL)"""


@query("ser01_variance_scaling", f"WITH {ALL_LVM}, {SC} SELECT task, model, n_points, round(alpha, 6) + 0.0 AS alpha, round(r2, 6) + 0.0 AS r2, coalesce(alpha BETWEEN -0.7 AND -0.3, false) AS in_range FROM sc")
def _(spark, d):
    return rounded(S.variance_scaling(_all(spark, d)), "alpha", "r2")


@query("ser02_leading_tests", f"""WITH {ALL_LVM}, f AS (SELECT task, model, level, dip_pvalue < 0.05 AND accuracy > 0.55 AS a, silhouette_k2 > 0.3 AND accuracy > 0.55 AS b, bimodality_coefficient > 0.555 AND accuracy > 0.55 AS c FROM lv),
g AS (SELECT task, model, bool_or(a) AS dip_leading, min(level) FILTER (WHERE a) AS dip_level, bool_or(b) AS silhouette_leading, min(level) FILTER (WHERE b) AS silhouette_level, bool_or(c) AS bimodality_leading, min(level) FILTER (WHERE c) AS bimodality_level FROM f GROUP BY ALL)
SELECT *, (dip_leading::INT + silhouette_leading::INT + bimodality_leading::INT) >= 2 AS consensus, least(dip_level, silhouette_level, bimodality_level) AS first_level FROM g""")
def _(spark, d):
    return S.leading_tests(_all(spark, d), min_accuracy=0.55)


@query("ser03_leading_trend", f"""WITH {ALL_LVM}, {tau_cte(where='AND level < d_star AND accuracy > 0.52')}, ds3 AS (SELECT task, model, indicator, max(d_star) - max(level) AS distance FROM up GROUP BY ALL)
SELECT task, model, indicator, n, round(tau, 6) + 0.0 AS tau, round(p_value, 6) + 0.0 AS p_value, distance, p_value < 0.05 AND tau > 0 AS leading FROM tau JOIN ds3 USING (task, model, indicator) WHERE n >= 3""")
def _(spark, d):
    return rounded(S.leading_trend(_all(spark, d), min_accuracy=0.52), "tau", "p_value")


FLAGS = {"dip": "dip_pvalue < 0.05", "silhouette": "silhouette_k2 > 0.3", "bimodality": "bimodality_coefficient > 0.555", "disagreement": "disagreement_rate > 0.5", "ashman": "ashman_d > 2.0"}
LEAD = "fl AS (" + " UNION ALL ".join(f"SELECT task, model, level, d_star, accuracy, '{n}' AS indicator, coalesce({c}, false) AS hit FROM lvd WHERE level <= d_star" for n, c in FLAGS.items()) + """),
ld AS (SELECT task, model, indicator, max(d_star) AS d_star, min(level) FILTER (WHERE hit) AS d_lead, arg_min(accuracy, level) FILTER (WHERE hit) AS accuracy_at_signal FROM fl GROUP BY ALL),
le AS (SELECT *, d_star - d_lead AS lead_time, coalesce(accuracy_at_signal > 0.6, false) AS is_leading FROM ld)"""


@query("ser04_lead_time_summary", f"WITH {ALL_LVM}, {LEAD} SELECT task, model, indicator, d_star, d_lead, round(accuracy_at_signal, 6) + 0.0 AS accuracy_at_signal, lead_time, is_leading FROM le")
def _(spark, d):
    return rounded(S.lead_time_summary(_all(spark, d), high=0.6), "accuracy_at_signal")


@query("ser04b_earliest_signal", f"""WITH {ALL_LVM}, {LEAD}, m AS (SELECT task, model, max(d_star) AS d_star FROM le GROUP BY ALL), b AS (SELECT * FROM le WHERE d_lead IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY d_lead, indicator) = 1)
SELECT m.task, m.model, m.d_star, b.indicator, b.lead_time, round(b.accuracy_at_signal, 6) + 0.0 AS accuracy_at_signal, b.is_leading FROM m LEFT JOIN b ON b.task = m.task AND b.model = m.model""")
def _(spark, d):
    return rounded(S.earliest_signal(S.lead_time_summary(_all(spark, d), high=0.6)), "accuracy_at_signal")


@query("ser05_cross_level_trends", f"WITH {ALL_LVM}, {tau_cte()} SELECT task, model, indicator, n, round(tau, 6) + 0.0 AS tau, round(p_value, 6) + 0.0 AS p_value FROM tau")
def _(spark, d):
    return rounded(S.cross_level_trends(_all(spark, d)), "tau", "p_value")


# temperatures: the event types stand for five temperatures of one model
TEMPS = {"click": 0.2, "error": 0.5, "purchase": 0.8, "signup": 1.0, "view": 1.3}
TCASE = "CASE model " + " ".join(f"WHEN '{m}' THEN {t}::DOUBLE" for m, t in TEMPS.items()) + " END"
TCOLS = ["max_accuracy", "scaling_exponent", "scaling_r2", "tau_variance", "tau_dip_pvalue", "tau_silhouette_k2", "tau_disagreement_rate"]
PT = f"""lt AS (SELECT lv.*, {TCASE} AS temperature, coalesce(ds.d_star, mx + 1) AS d_star FROM lv JOIN ds USING (task, model) JOIN (SELECT task, model, max(level) AS mx FROM lv GROUP BY ALL) USING (task, model)),
l2 AS (SELECT *, max(accuracy) OVER (PARTITION BY task, model) AS top FROM lt), l3 AS (SELECT *, greatest(0.6, 0.7 * top) AS relax FROM l2),
tp AS (SELECT task, model, temperature, max(d_star) AS d_star, max(accuracy) AS max_accuracy, min(level) FILTER (WHERE dip_pvalue < 0.05 AND accuracy > 0.65) AS d_lead_strict, min(level) FILTER (WHERE dip_pvalue < 0.05 AND accuracy > relax) AS d_lead_relaxed, min(level) FILTER (WHERE silhouette_k2 > 0.3 AND accuracy > relax) AS d_lead_sil,
 count(*) FILTER (WHERE (dip_pvalue < 0.05)::INT + (silhouette_k2 > 0.3)::INT + (bimodality_coefficient > 0.555)::INT >= 2) AS n_bimodal FROM l3 GROUP BY ALL),
tq AS (SELECT *, d_star - d_lead_strict AS lead_time_strict, d_star - d_lead_relaxed AS lead_time_relaxed, d_star - d_lead_sil AS lead_time_sil FROM tp),
ts AS (SELECT model, count(*) AS np, CASE WHEN count(*) >= 3 THEN regr_slope(ln(variance), ln((d_star - level)::DOUBLE)) END AS scaling_exponent, CASE WHEN count(*) >= 3 THEN regr_r2(ln(variance), ln((d_star - level)::DOUBLE)) END AS scaling_r2 FROM lt WHERE level < d_star AND variance > 0 GROUP BY ALL)"""
PTAU = tau_cte("lt", ("variance", "dip_pvalue", "silhouette_k2", "disagreement_rate"))


def _temps(spark, d):
    from levelscan.operators.windows import attach_critical_level
    lv = attach_critical_level(levels(spark, d, True), default="next")
    t = F.lit(None).cast("double")
    for m, v in TEMPS.items():
        t = F.when(F.col("model") == m, v).otherwise(t)
    return lv.withColumn("temperature", t)


@query("ser06_per_temperature", f"""WITH {LVM}, {PT}, {PTAU}, tw AS (SELECT model, max(tau) FILTER (WHERE indicator = 'variance') AS tau_variance, max(tau) FILTER (WHERE indicator = 'dip_pvalue') AS tau_dip_pvalue, max(tau) FILTER (WHERE indicator = 'silhouette_k2') AS tau_silhouette_k2, max(tau) FILTER (WHERE indicator = 'disagreement_rate') AS tau_disagreement_rate FROM tau GROUP BY ALL)
SELECT tq.task, temperature, d_star, d_lead_strict, d_lead_relaxed, d_lead_sil, n_bimodal, lead_time_strict, lead_time_relaxed, lead_time_sil, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in TCOLS)} FROM tq LEFT JOIN ts ON ts.model = tq.model JOIN tw ON tw.model = tq.model""")
def _(spark, d):
    return rounded(S.per_temperature(_temps(spark, d), strict=0.65), *TCOLS)


def _rank(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


DCOLS = ["lead_slope", "lead_p", "share_dip_pvalue", "share_variance", "share_disagreement_rate", "zone_rho", "zone_p", "evidence_score"]


@query("ser07_dose_response", f"""WITH {LVM}, {PT}, li AS (SELECT task, count(*) AS n, regr_slope(lead_time_relaxed, temperature) AS b, corr(temperature, lead_time_relaxed) AS r FROM tq WHERE lead_time_relaxed IS NOT NULL GROUP BY ALL),
u AS (SELECT task, temperature, level, 'dip_pvalue' AS indicator, dip_pvalue AS v FROM lt UNION ALL SELECT task, temperature, level, 'variance', variance FROM lt UNION ALL SELECT task, temperature, level, 'disagreement_rate', disagreement_rate FROM lt),
ur AS (SELECT task, level, indicator, {_rank('temperature', 'task, level, indicator')} AS a, {_rank('v', 'task, level, indicator')} AS b FROM u), rh AS (SELECT task, level, indicator, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rho, count(*) AS n FROM ur GROUP BY ALL),
sh AS (SELECT task, avg(CASE WHEN coalesce(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 0) > 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (WHERE indicator = 'dip_pvalue') AS share_dip_pvalue, avg(CASE WHEN coalesce(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 0) > 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (WHERE indicator = 'variance') AS share_variance, avg(CASE WHEN coalesce(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 0) > 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (WHERE indicator = 'disagreement_rate') AS share_disagreement_rate FROM rh WHERE n >= 3 GROUP BY ALL),
zr AS (SELECT task, {_rank('temperature', 'task')} AS a, {_rank('n_bimodal', 'task')} AS b FROM tq), zz AS (SELECT task, count(*) AS n, corr(a, b) AS r FROM zr GROUP BY ALL), zo AS (SELECT task, coalesce(CASE WHEN isnan(r) THEN NULL ELSE r END, 0.0) AS zone_rho, coalesce(CASE WHEN isnan(r) THEN NULL ELSE {corr_p_sql('r', 'n')} END, 1.0) AS zone_p FROM zz),
st AS (SELECT task, max(d_star) - min(d_star) AS d_star_range FROM tq GROUP BY ALL), al AS (SELECT st.task, d_star_range, CASE WHEN n >= 3 THEN b END AS lead_slope, CASE WHEN n >= 3 THEN {corr_p_sql('r', 'n')} END AS lead_p, sh.* EXCLUDE (task), zone_rho, zone_p FROM st LEFT JOIN li USING (task) LEFT JOIN sh USING (task) LEFT JOIN zo USING (task)),
ev2 AS (SELECT *, (coalesce((d_star_range <= 3)::INT, 0) + coalesce((lead_p < 0.10 AND lead_slope > 0)::INT, 0) + coalesce((share_dip_pvalue > 0.5)::INT, 0) + coalesce((share_variance > 0.5)::INT, 0) + coalesce((share_disagreement_rate > 0.5)::INT, 0) + coalesce((zone_rho > 0 AND zone_p < 0.10)::INT, 0)) / 6.0 AS evidence_score FROM al)
SELECT task, d_star_range, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in DCOLS)} FROM ev2""")
def _(spark, d):
    s = _temps(spark, d)
    return rounded(S.dose_response(s, S.per_temperature(s, strict=0.65)), *DCOLS)


MIX = """mx AS (SELECT task, model, count(*) AS n_levels, CASE WHEN count(*) >= 3 AND stddev_pop(accuracy * (1 - accuracy)) > 1e-10 AND stddev_pop(variance) > 1e-10 THEN corr(accuracy * (1 - accuracy), variance) END AS r FROM lvd {w} GROUP BY ALL)"""


@query("ser08_success_criteria", f"""WITH {ALL_LVM}, {MIX.format(w='WHERE d_star IS NOT NULL')}, dt AS (SELECT task, model, bool_or(accuracy > 0.6 AND (dip_pvalue < 0.05 OR silhouette_k2 > 0.3)) AS hit FROM lvd WHERE d_star IS NOT NULL GROUP BY ALL),
a AS (SELECT count(*) FILTER (WHERE hit) AS n_detected, count(DISTINCT task) FILTER (WHERE hit) AS n_tasks, count(DISTINCT model) FILTER (WHERE hit) AS n_models FROM dt), b AS (SELECT count(*) FILTER (WHERE coalesce(r * r, 0) > 0.5) AS n_mixture, round(avg(coalesce(r * r, 0)), 6) + 0.0 AS mean_r2 FROM mx)
SELECT *, n_tasks >= 2 AND n_models >= 2 AS sc1, n_mixture >= 3 AS sc2, 25.0::DOUBLE AS gain_pct, true AS sc3, CASE (n_tasks >= 2 AND n_models >= 2)::INT + (n_mixture >= 3)::INT + 1 WHEN 3 THEN 'confirmed' WHEN 2 THEN 'partially confirmed' ELSE 'not confirmed' END AS verdict FROM a, b""")
def _(spark, d):
    return rounded(S.success_criteria(_all(spark, d), 0.75, 0.6, high=0.6), "mean_r2", "gain_pct")


EXPECTED = {"variance": 1, "dip_pvalue": -1, "silhouette_k2": 1, "bimodality_coefficient": 1, "disagreement_rate": 1, "ashman_d": 1}
ECASE = "CASE indicator " + " ".join(f"WHEN '{c}' THEN {s}" for c, s in EXPECTED.items()) + " END"
SIG = {"variance": "variance > pv * 1.2", "dip_pvalue": FLAGS["dip"], "silhouette_k2": FLAGS["silhouette"], "bimodality_coefficient": FLAGS["bimodality"], "disagreement_rate": FLAGS["disagreement"], "ashman_d": FLAGS["ashman"]}


@query("ser09_indicator_ranking", f"""WITH {ALL_LVM}, {tau_cte()}, pv AS (SELECT *, lag(variance) OVER ({PW}) AS pv FROM lvd), sg AS ({' UNION ALL '.join(f"SELECT task, model, level, d_star, '{c}' AS indicator, coalesce({e}, false) AS hit FROM pv WHERE level < d_star" for c, e in SIG.items())}),
fs AS (SELECT task, model, indicator, max(d_star) - min(level) FILTER (WHERE hit) AS lead_time FROM sg GROUP BY ALL), fl AS (SELECT task, model, indicator, max(d_star) IS NOT NULL AS pos FROM up GROUP BY ALL HAVING count(*) >= 4 AND stddev_pop(value) >= 1e-10),
j AS (SELECT tau.*, pos, lead_time, p_value < 0.10 AND sign(tau) = {ECASE} AS hit FROM tau JOIN fl USING (task, model, indicator) LEFT JOIN fs USING (task, model, indicator)), ng AS (SELECT count(*) FILTER (WHERE d_star IS NULL) AS nn FROM ds),
g AS (SELECT indicator, count(*) FILTER (WHERE pos AND hit) / greatest(count(*) FILTER (WHERE pos), 1) AS sensitivity, 1.0 - count(*) FILTER (WHERE NOT pos AND hit) / greatest((SELECT nn FROM ng), 1) AS specificity, coalesce(avg(lead_time) FILTER (WHERE pos), 0) AS mean_lead_time, coalesce(avg(abs(tau)) FILTER (WHERE pos), 0) AS mean_effect FROM j GROUP BY ALL)
SELECT indicator, round(sensitivity, 6) + 0.0 AS sensitivity, round(specificity, 6) + 0.0 AS specificity, round(mean_lead_time, 6) + 0.0 AS mean_lead_time, round(mean_effect, 6) + 0.0 AS mean_effect, round(0.3 * sensitivity + 0.2 * specificity + 0.3 * least(greatest(mean_lead_time / 20, 0), 1) + 0.2 * least(mean_effect, 1), 6) + 0.0 AS composite FROM g""")
def _(spark, d):
    return rounded(S.indicator_ranking(_all(spark, d), EXPECTED), "sensitivity", "specificity", "mean_lead_time", "mean_effect", "composite")


@query("ser10a_negative_controls", f"""WITH {ALL_LVM}, {tau_cte(cols=('variance', 'dip_pvalue'), where='AND level < 1000')}, k AS (SELECT task, model, avg(abs(tau)) AS a, count(*) FILTER (WHERE p_value < 0.05) AS sig FROM tau WHERE n >= 3 AND (task, model) IN (SELECT (task, model) FROM ds WHERE d_star IS NULL OR task = 'events') GROUP BY ALL)
SELECT count(*) AS n_series, round(avg(a), 6) + 0.0 AS mean_abs_tau, round(avg((sig > 0)::INT), 6) + 0.0 AS share_significant, round(avg((sig >= 2)::INT), 6) + 0.0 AS false_alarm_rate, coalesce(avg(a) < 0.3 AND avg((sig > 0)::INT) < 0.5, false) AS passed FROM k""")
def _(spark, d):
    # the event series serve as series without a boundary
    s = _all(spark, d).withColumn("d_star", F.when(F.col("task") != "events", F.col("d_star")))
    return rounded(S.negative_controls(s), "mean_abs_tau", "share_significant", "false_alarm_rate")


@query("ser10b_near_far_control")
def _(spark, d):
    return rounded(S.near_far_control(_all(spark, d), ("variance", "disagreement_rate", "bimodality_coefficient")), "rate")


@query("ser11_consistency_matrix", f"""WITH {ALL_LVM}, {tau_cte()}, sd AS (SELECT task, model, indicator, stddev_pop(value) AS s FROM up GROUP BY ALL) SELECT task, model, indicator, round(tau, 6) + 0.0 AS tau, round(p_value, 6) + 0.0 AS p_value, CASE WHEN n >= 4 AND s >= 1e-10 AND p_value < 0.10 THEN sign(tau)::INTEGER ELSE 0 END AS rating FROM tau JOIN sd USING (task, model, indicator)""")
def _(spark, d):
    return rounded(S.consistency_matrix(_all(spark, d)), "tau", "p_value")


EFF = f"""ez AS (SELECT *, CASE WHEN level <= d_star - 5 THEN 'far' WHEN level BETWEEN d_star - 3 AND d_star THEN 'near' END AS z FROM ({unpivot_sql('lvd', COLS)}) WHERE value IS NOT NULL AND d_star >= 5),
ec AS (SELECT task, model, indicator, count(*) FILTER (WHERE z = 'near') AS n_near, count(*) FILTER (WHERE z = 'far') AS n_far, avg(value) FILTER (WHERE z = 'near') AS ma, avg(value) FILTER (WHERE z = 'far') AS mb, var_samp(value) FILTER (WHERE z = 'near') AS va, var_samp(value) FILTER (WHERE z = 'far') AS vb FROM ez WHERE z IS NOT NULL GROUP BY ALL),
ed AS (SELECT a.task, a.model, a.indicator, avg(sign(a.value - b.value)) AS delta FROM ez a JOIN ez b ON a.task = b.task AND a.model = b.model AND a.indicator = b.indicator AND a.z = 'near' AND b.z = 'far' GROUP BY ALL),
ef AS (SELECT ec.*, delta, CASE WHEN n_near >= 2 AND n_far >= 2 AND sqrt(((n_near - 1) * va + (n_far - 1) * vb) / (n_near + n_far - 2)) > 1e-12 THEN (ma - mb) / sqrt(((n_near - 1) * va + (n_far - 1) * vb) / (n_near + n_far - 2)) END AS d FROM ec JOIN ed USING (task, model, indicator) WHERE n_far >= 3 AND n_near >= 1)"""


@query("ser12a_effect_sizes", f"WITH {ALL_LVM}, {EFF} SELECT task, model, indicator, n_near, n_far, round(d, 6) + 0.0 AS cohens_d, round(delta, 6) + 0.0 AS cliffs_delta FROM ef")
def _(spark, d):
    return rounded(S.effect_sizes(_all(spark, d)), "cohens_d", "cliffs_delta")


@query("ser12b_mean_effects", f"WITH {ALL_LVM}, {EFF} SELECT indicator, round(coalesce(avg(d), 0), 6) + 0.0 AS mean_d, round(coalesce(avg(delta), 0), 6) + 0.0 AS mean_delta FROM ef GROUP BY ALL")
def _(spark, d):
    return rounded(S.mean_effects(S.effect_sizes(_all(spark, d))), "mean_d", "mean_delta")


@query("ser12c_effect_intervals", f"""WITH {ALL_LVM}, {EFF}, en AS (SELECT * FROM ez WHERE z IS NOT NULL), {weights_sql('en', "'42', task, model, indicator, z, level", 'task, model, indicator, z, value')},
bm AS (SELECT task, model, indicator, z, rep, sum(w) AS n, sum(w * value) / sum(w) AS mu FROM bw GROUP BY ALL HAVING sum(w) > 0), bv AS (SELECT task, model, indicator, z, rep, any_value(n) AS n, any_value(mu) AS mu, sum(w * (value - mu) ** 2) AS ss FROM bw JOIN bm USING (task, model, indicator, z, rep) GROUP BY ALL),
sp AS (SELECT task, model, indicator, stddev_pop(value) AS sd FROM en GROUP BY ALL), bd AS (SELECT a.task, a.model, a.indicator, CASE WHEN sqrt((a.ss + b.ss) / (a.n + b.n - 2)) > 1e-6 * sp.sd THEN (a.mu - b.mu) / sqrt((a.ss + b.ss) / (a.n + b.n - 2)) END AS d FROM bv a JOIN bv b ON a.task = b.task AND a.model = b.model AND a.indicator = b.indicator AND a.rep = b.rep AND a.z = 'near' AND b.z = 'far' JOIN sp ON sp.task = a.task AND sp.model = a.model AND sp.indicator = a.indicator WHERE a.n >= 2 AND b.n >= 2)
SELECT task, model, indicator, round(quantile_cont(bd.d, 0.025::DOUBLE), 5) + 0.0 AS ci_low, round(quantile_cont(bd.d, 0.975::DOUBLE), 5) + 0.0 AS ci_high, count(bd.d) AS n_reps FROM bd JOIN ef USING (task, model, indicator) GROUP BY ALL""")
def _(spark, d):
    return rounded(S.effect_intervals(_all(spark, d)), "ci_low", "ci_high", digits=5)


@query("ser13_cross_task_consistency", f"""WITH {ALL_LVM}, {tau_cte(cols=('variance',), where='AND level <= d_star')}, {LEAD}, sh AS (SELECT indicator, avg(CASE WHEN lead_time > 0 THEN 1.0 ELSE 0.0 END) AS share_leading FROM le WHERE indicator IN ('dip', 'silhouette', 'bimodality') GROUP BY ALL),
o AS (SELECT task, model, arg_min(dip_pvalue, level) AS a, arg_min(silhouette_k2, level) AS b, arg_min(bimodality_coefficient, level) AS c FROM lvd WHERE d_star IS NOT NULL AND accuracy < 0.6 GROUP BY ALL),
ps AS (SELECT 'dip' AS indicator, a AS p FROM o UNION ALL SELECT 'silhouette', CASE WHEN b > 0 THEN greatest(0.001, 1 - b) ELSE 1.0 END FROM o UNION ALL SELECT 'bimodality', CASE WHEN c > 0 THEN greatest(0.001, 1 - c) ELSE 1.0 END FROM o),
fi AS (SELECT indicator, count(*) AS k, -2 * sum(ln(p)) AS x FROM ps WHERE p > 0 GROUP BY ALL), fp AS (SELECT indicator, CASE WHEN k >= 2 THEN exp(-x / 2) * list_sum(list_transform(range(0, k), lambda i: power(x / 2, i) / gamma(i + 1.0))) END AS p_combined FROM fi)
SELECT indicator, round(share_leading, 6) + 0.0 AS share_leading, round(p_combined, 6) + 0.0 AS p_combined, (SELECT round(avg(tau), 6) + 0.0 FROM tau WHERE n >= 3) AS mean_tau, (SELECT round(avg((tau > 0)::INT), 6) + 0.0 FROM tau WHERE n >= 3) AS share_positive_tau FROM sh LEFT JOIN fp USING (indicator)""")
def _(spark, d):
    return rounded(S.cross_task_consistency(_all(spark, d), high=0.6), "share_leading", "p_combined", "mean_tau", "share_positive_tau")


@query("ser14_mixture_correlation", f"WITH {ALL_LVM}, {MIX.format(w='')} SELECT task, model, n_levels, round(r, 6) + 0.0 AS r, round(coalesce(r * r, 0), 6) + 0.0 AS r2 FROM mx")
def _(spark, d):
    return rounded(S.mixture_r2(_all(spark, d)), "r", "r2")


@query("ser15_detection_power", f"""WITH {ALL_LVM}, r AS (SELECT coalesce(avg((dip_pvalue < 0.05)::INT), 0) AS r FROM lvd WHERE d_star >= 5 AND level BETWEEN d_star - 3 AND d_star), n AS (SELECT unnest([10, 15, 20, 25, 30, 40, 50])::INTEGER AS n) SELECT n, round(least(1.0, r * power(n / 50.0, 0.3::DOUBLE)), 6) + 0.0 AS power FROM r, n""")
def _(spark, d):
    return rounded(S.detection_power(_all(spark, d)), "power")
