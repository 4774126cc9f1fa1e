"""ALM and RT: sequential alarms and routing."""

from pyspark.sql import functions as F

from levelscan.operators import alarms as A
from levelscan.operators import routing as R
from levelscan.queries.bindings import ALL_LVM, LVM, all_levels, levels, with_d_star
from levelscan.queries.registry import query, r6, rounded, table

SER = ["task", "model"]
PW = "PARTITION BY task, model ORDER BY level"
INDS = ("variance", "disagreement_rate")


def _alarm_sql():
    """All protocols over the CTE lvd, as a long table ``al``."""
    cal = ", ".join(f"avg({c}) FILTER (WHERE rn <= 3) OVER s AS mu_{c}, greatest(coalesce(stddev_samp({c}) FILTER (WHERE rn <= 3) OVER s, 0), 1e-10) AS sd_{c}" for c in INDS)
    cum = ", ".join(f"sum(CASE WHEN rn > 3 THEN {c} - mu_{c} - 0.5 * sd_{c} END) OVER r AS c_{c}, list({c}) FILTER (WHERE rn > 3) OVER r AS xs_{c}" for c in INDS)
    st = []
    for c in INDS:
        st.append(f"c_{c} - least(0, min(c_{c}) OVER r) AS s_{c}")
        st += [f"CASE WHEN rn > 3 THEN list_reduce(list_prepend(mu_{c}, xs_{c}), lambda z, x: {l}::DOUBLE * x + (1 - {l}::DOUBLE) * z) END AS z_{c}_{i}" for i, l in enumerate((0.2, 0.3))]
    out = [f"SELECT task, model, level, accuracy, d_star, '{n}' AS protocol, t::DOUBLE AS statistic, {k}::DOUBLE AS \"limit\", t >= {k} AS alarmed FROM s4" for k, n in ((1, "any1"), (2, "any2"), (3, "all3"))]
    for c in INDS:
        out += [f"SELECT task, model, level, accuracy, d_star, 'cusum_{c}_h{h}', s_{c}, {h} * sd_{c}, s_{c} > {h} * sd_{c} FROM s4" for h in (4.0, 5.0)]
        for i, l in enumerate((0.2, 0.3)):
            for w in (2.5, 3.0):
                lim = f"(mu_{c} + {w}::DOUBLE * sd_{c} * sqrt({l}::DOUBLE / (2 - {l}::DOUBLE) * (1 - power(1 - {l}::DOUBLE, 2 * (rn - 3)))))"
                out.append(f"SELECT task, model, level, accuracy, d_star, 'ewma_{c}_l{l}_L{w}', z_{c}_{i}, {lim}, z_{c}_{i} > {lim} FROM s4")
    return f"""s1 AS (SELECT *, row_number() OVER ({PW}) AS rn FROM lvd), s2 AS (SELECT *, {cal} FROM s1 WINDOW s AS (PARTITION BY task, model)),
s3 AS (SELECT *, CAST(variance > mu_variance + 2 * sd_variance AS INT) + CAST(disagreement_rate > 0.30::DOUBLE AS INT) + CAST(dip_pvalue < 0.05::DOUBLE AS INT) AS t, {cum} FROM s2 WINDOW r AS ({PW} ROWS UNBOUNDED PRECEDING)),
s4x AS (SELECT *, {', '.join(st)} FROM s3 WINDOW r AS ({PW} ROWS UNBOUNDED PRECEDING)), s4 AS (SELECT * FROM s4x WHERE rn > 3), al AS ({' UNION ALL '.join(out)})"""


AL = _alarm_sql()
SEL = 'SELECT task, model, level, protocol, round(statistic, 6) + 0.0 AS statistic, round("limit", 6) + 0.0 AS "limit", alarmed FROM al'


def _out(df):
    return rounded(df.select(*SER, "level", "protocol", "statistic", "limit", "alarmed"), "statistic", "limit")


@query("alm01_threshold_alarm", f"WITH {LVM}, {AL} {SEL} WHERE protocol IN ('any1', 'any2', 'all3')")
def _(spark, d):
    return _out(A.threshold_alarm(with_d_star(levels(spark, d, True))))


@query("alm02_cusum_alarm", f"WITH {LVM}, {AL} {SEL} WHERE protocol LIKE 'cusum%'")
def _(spark, d):
    return _out(A.cusum_alarm(with_d_star(levels(spark, d, True)), INDS, (4.0, 5.0)))


@query("alm03_ewma_alarm", f"WITH {LVM}, {AL} {SEL} WHERE protocol LIKE 'ewma%'")
def _(spark, d):
    return _out(A.ewma_alarm(with_d_star(levels(spark, d, True)), INDS, (0.2, 0.3), (2.5, 3.0)))


@query("alm04_plain_cusum", f"""WITH {LVM}, a AS (SELECT *, count(*) OVER (PARTITION BY task, model) AS nn, row_number() OVER ({PW}) AS rn FROM lv), b AS (SELECT *, avg(variance) FILTER (WHERE rn <= greatest(3, nn // 3)) OVER (PARTITION BY task, model) AS mu, stddev_pop(variance) OVER (PARTITION BY task, model) AS sd FROM a),
c AS (SELECT *, sum(variance - mu) OVER ({PW} ROWS UNBOUNDED PRECEDING) AS st, CASE WHEN sd > 0 THEN 2.0 * sd ELSE 0.1 END AS lim FROM b) SELECT task, model, level, round(st, 6) + 0.0 AS statistic, round(lim, 6) + 0.0 AS "limit", nn >= 3 AND st > lim AS alarmed FROM c""")
def _(spark, d):
    return rounded(A.plain_cusum(levels(spark, d, True)), "statistic", "limit")


ANY = ["variance", "bimodality_coefficient", "disagreement_rate"]


@query("alm05_any_indicator_alarm", f"""WITH {LVM}, t AS (SELECT {', '.join(f'avg({c}) + stddev_samp({c}) AS t_{c}' for c in ANY)} FROM lvd WHERE level < d_star - 3) SELECT task, model, level, {' OR '.join(f'{c} >= t_{c}' for c in ANY)} AS alarmed FROM lvd, t""")
def _(spark, d):
    return A.any_indicator_alarm(with_d_star(levels(spark, d, True)), F.col("level") < F.col("d_star") - 3, ANY)


@query("alm06_multi_channel_alarm", f"""WITH {LVM}, a AS (SELECT *, row_number() OVER ({PW}) AS rn FROM lv), b AS (SELECT *, avg(variance) FILTER (WHERE rn <= 3) OVER s AS mv, avg(disagreement_rate) FILTER (WHERE rn <= 3) OVER s AS md, stddev_pop(variance) FILTER (WHERE rn <= 3) OVER s AS sv0, stddev_pop(disagreement_rate) FILTER (WHERE rn <= 3) OVER s AS sd0 FROM a WINDOW s AS (PARTITION BY task, model)),
c AS (SELECT *, greatest(sv0, mv * 0.03) AS sv, greatest(sd0, 0.03) AS sd FROM b), e AS (SELECT *, sum(CASE WHEN rn > 3 THEN variance - mv - 0.5 * sv END) OVER r AS cv, sum(CASE WHEN rn > 3 THEN disagreement_rate - md - 0.5 * sd END) OVER r AS cd FROM c WINDOW r AS ({PW} ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cv - least(0, min(cv) OVER r) AS s1, cd - least(0, min(cd) OVER r) AS s2 FROM e WINDOW r AS ({PW} ROWS UNBOUNDED PRECEDING)), g AS (SELECT *, CASE WHEN rn <= 3 THEN NULL WHEN s1 > 2.5 * sv THEN 'variance' WHEN s2 > 2.5 * sd THEN 'disagreement' WHEN dip_pvalue < 0.05 AND variance > mv * 1.05 THEN 'dip' END AS ch FROM f)
SELECT task, model, min(level) FILTER (WHERE ch IS NOT NULL) AS alarm_level, arg_min(ch, level) FILTER (WHERE ch IS NOT NULL) AS channel FROM g GROUP BY ALL""")
def _(spark, d):
    return A.multi_channel_alarm(levels(spark, d, True))


MET = """mt AS (SELECT task, model, protocol, max(d_star) AS d_star, min(level) FILTER (WHERE alarmed) AS d_alarm, arg_min(accuracy, level) FILTER (WHERE alarmed) AS accuracy_at_alarm, CAST(bool_or(alarmed AND level <= d_star) AS INTEGER) AS sensitivity, coalesce(avg(CAST(alarmed AS INT)) FILTER (WHERE level < d_star - 3), 0) AS false_alarm_rate,
 count(*) FILTER (WHERE alarmed AND level BETWEEN greatest(1, d_star - 2) AND d_star) AS tp, count(*) FILTER (WHERE alarmed AND NOT level BETWEEN greatest(1, d_star - 2) AND d_star) AS fp, count(*) FILTER (WHERE NOT alarmed AND level BETWEEN greatest(1, d_star - 2) AND d_star) AS fn FROM al WHERE d_star IS NOT NULL GROUP BY ALL),
mm AS (SELECT *, d_star - d_alarm AS lead_time, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM mt)"""
MCOLS = ["accuracy_at_alarm", "false_alarm_rate", "precision", "recall", "f1"]


@query("alm07_alarm_metrics", f"WITH {LVM}, {AL}, {MET} SELECT task, model, protocol, d_star, d_alarm, sensitivity, tp, fp, fn, lead_time, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in MCOLS) + " FROM mm")
def _(spark, d):
    return rounded(A.alarm_metrics(A.protocol_grid(with_d_star(levels(spark, d, True)))), *MCOLS)


SCOLS = ["mean_lead_time", "mean_sensitivity", "mean_false_alarm_rate", "mean_precision", "mean_recall", "macro_f1", "lead_positive_share", "retention", "readiness"]
SUMM = """sm AS (SELECT protocol, coalesce(avg(lead_time), 0) AS mean_lead_time, avg(sensitivity) AS mean_sensitivity, avg(false_alarm_rate) AS mean_false_alarm_rate, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS macro_f1, avg(CASE WHEN lead_time > 0 THEN 1.0 ELSE 0.0 END) AS lead_positive_share FROM mm GROUP BY ALL),
sn AS (SELECT *, macro_f1 / 0.949 AS retention, 0.4 * mean_sensitivity + 0.3 * (1 - mean_false_alarm_rate) + 0.3 * lead_positive_share AS readiness FROM sm)"""


@query("alm08_alarm_summary", f"WITH {LVM}, {AL}, {MET}, {SUMM} SELECT protocol, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SCOLS) + " FROM sn")
def _(spark, d):
    m = A.alarm_metrics(A.protocol_grid(with_d_star(levels(spark, d, True))))
    return rounded(A.alarm_summary(m), *SCOLS)


@query("alm09_protocol_grid", f"WITH {ALL_LVM}, {AL} {SEL}")
def _(spark, d):
    return _out(A.protocol_grid(with_d_star(all_levels(spark, d, True))))


# ---- routing: cheap = click, capable = view; a query is an order line with its quantity as difficulty ---------

RTE = """q AS (SELECT 'events' AS task, CAST(l_quantity AS INTEGER) AS difficulty, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
l AS (SELECT a.task, a.level, a.accuracy AS cheap_acc, b.accuracy AS capable_acc FROM lv a JOIN lv b ON a.task = b.task AND a.level = b.level WHERE a.model = 'click' AND b.model = 'view'),
al AS (SELECT task, min(level) FILTER (WHERE disagreement_rate < 0.972) AS alarm_level FROM lv WHERE model = 'click' AND level > 5 GROUP BY ALL),
p AS (SELECT q.*, l.level FROM q JOIN l USING (task) QUALIFY row_number() OVER (PARTITION BY q.task, difficulty ORDER BY abs(l.level - difficulty), l.level) = 1),
j AS (SELECT p.task, p.difficulty, p.level, p.weight, cheap_acc, capable_acc, alarm_level FROM p JOIN l ON l.task = p.task AND l.level = p.level LEFT JOIN al ON al.task = p.task),
ro AS (SELECT *, 'always_cheap' AS policy, false AS use_capable FROM j UNION ALL SELECT *, 'always_capable', true FROM j UNION ALL SELECT *, 'oracle', capable_acc > cheap_acc FROM j UNION ALL SELECT *, 'alarm', coalesce(difficulty >= alarm_level, false) FROM j)"""


def metrics_sql(src="ro", keys="task", lev="l", batch="20", volume="sum(weight)", name="pm"):
    k = keys
    return f"""{name}a AS (SELECT {k}, policy, {volume} AS n_queries, sum(weight * CASE WHEN use_capable THEN capable_acc ELSE cheap_acc END) / sum(weight) AS accuracy, sum(weight * CASE WHEN use_capable THEN 0.010 ELSE 0.001 END) / sum(weight) * {volume} AS base, coalesce(sum(weight) FILTER (WHERE use_capable) / sum(weight), 0) AS capable_share, max(alarm_level) AS alarm_level FROM {src} GROUP BY ALL),
{name}b AS (SELECT a.*, CASE WHEN policy = 'alarm' THEN (SELECT count(*) FROM {lev} l WHERE l.task = a.task AND (a.alarm_level IS NULL OR l.level <= a.alarm_level)) * {batch} * 0.001::DOUBLE ELSE 0.0 END::DOUBLE AS overhead FROM {name}a a),
{name}c AS (SELECT *, base + overhead AS total_cost FROM {name}b),
{name}d AS (SELECT *, max(accuracy) FILTER (WHERE policy = 'always_cheap') OVER w AS ca, max(total_cost) FILTER (WHERE policy = 'always_cheap') OVER w AS cc, max(total_cost) FILTER (WHERE policy = 'always_capable') OVER w AS kc, max(accuracy) FILTER (WHERE policy = 'oracle') OVER w AS oa FROM {name}c WINDOW w AS (PARTITION BY {k})),
{name} AS (SELECT {k}, policy, accuracy, total_cost, overhead, capable_share, n_queries, alarm_level, CASE WHEN 1 - ca > 1e-10 THEN (accuracy - ca) / (1 - ca) * 100 ELSE 0.0 END AS error_reduction, total_cost / kc * 100 AS relative_cost, CASE WHEN total_cost - cc > 1e-6 THEN (accuracy - ca) / (total_cost - cc) ELSE 0.0 END AS efficiency, CASE WHEN abs(oa - ca) < 1e-10 THEN 0.0 ELSE (accuracy - ca) / (oa - ca) * 100 END AS oracle_gap FROM {name}d)"""


PCOLS = ["accuracy", "total_cost", "overhead", "capable_share", "n_queries", "error_reduction", "relative_cost", "efficiency", "oracle_gap"]
PSEL = ", ".join(f"round({c}::DOUBLE, 5) + 0.0 AS {c}" for c in PCOLS)


def _pair(spark, d):
    lv = levels(spark, d, True)
    cheap = lv.where("model = 'click'").select("task", "level", F.col("accuracy").alias("cheap_acc"), "disagreement_rate")
    cap = lv.where("model = 'view'").select("task", "level", F.col("accuracy").alias("capable_acc"))
    alarm = cheap.where("level > 5").groupBy("task").agg(F.min(F.when(F.col("disagreement_rate") < 0.972, F.col("level"))).alias("alarm_level"))
    return cheap.drop("disagreement_rate").join(cap, ["task", "level"]), alarm


def _routed(spark, d):
    lv, al = _pair(spark, d)
    q = table(spark, d, "lineitem").select(F.lit("events").alias("task"), F.col("l_quantity").cast("int").alias("q"))
    return R.route(R.difficulty_counts(q, ["task"], "q"), lv, al), lv, al


@query("rt01_route", f"WITH {LVM}, {RTE} SELECT task, difficulty, level, policy, use_capable, weight, round(CASE WHEN use_capable THEN capable_acc ELSE cheap_acc END, 6) + 0.0 AS expected_accuracy FROM ro")
def _(spark, d):
    r, _lv, _al = _routed(spark, d)
    acc = F.when(F.col("use_capable"), F.col("capable_acc")).otherwise(F.col("cheap_acc"))
    return r.select("task", "difficulty", "level", "policy", "use_capable", "weight", r6(acc).alias("expected_accuracy"))


@query("rt02_policy_metrics", f"WITH {LVM}, {RTE}, {metrics_sql()} SELECT task, policy, alarm_level, {PSEL} FROM pm")
def _(spark, d):
    r, lv, _al = _routed(spark, d)
    return rounded(R.policy_metrics(r, lv), *PCOLS, digits=5)


@query("rt03_pareto_front", f"""WITH {ALL_LVM}, p AS (SELECT task, model, level, round(accuracy, 2) AS accuracy, round(variance, 0) AS cost FROM lv) SELECT task, model, level, accuracy, cost,
 NOT EXISTS (SELECT 1 FROM p b WHERE b.task = a.task AND b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost)) AS pareto FROM p a""")
def _(spark, d):
    p = all_levels(spark, d, True).select("task", "model", "level", r6("accuracy", 2).alias("accuracy"), r6("variance", 0).alias("cost"))
    return R.pareto_front(p, ["task"], "accuracy", "cost")


@query("rt04_break_even", f"""WITH {LVM}, {RTE}, {metrics_sql()} SELECT task, round(max(overhead::DOUBLE) FILTER (WHERE policy = 'alarm'), 6) + 0.0 AS overhead, round(max(total_cost / n_queries) FILTER (WHERE policy = 'always_capable') - max((total_cost - overhead) / n_queries) FILTER (WHERE policy = 'alarm'), 9) + 0.0 AS saving,
 round(greatest(max(overhead) FILTER (WHERE policy = 'alarm') / (max(total_cost / n_queries) FILTER (WHERE policy = 'always_capable') - max((total_cost - overhead) / n_queries) FILTER (WHERE policy = 'alarm')), 1), 4) + 0.0 AS break_even FROM pm GROUP BY ALL""")
def _(spark, d):
    r, lv, _al = _routed(spark, d)
    b = R.break_even(R.policy_metrics(r, lv))
    return b.select("task", r6("overhead").alias("overhead"), r6("saving", 9).alias("saving"), r6("break_even", 4).alias("break_even"))


def _grid_sql():
    x1, x0 = "least(greatest((d + 0.5 - lo) / w, 0), 1)", "least(greatest((d - 0.5 - lo) / w, 0), 1)"
    f = {"uniform": "({x})", "beta_easy": "(1 - power(1 - {x}, 5) * (1 + 5 * {x}))", "beta_hard": "(power({x}, 5) * (6 - 5 * {x}))"}
    cells = " UNION ALL ".join(f"SELECT task, d AS difficulty, '{n}' AS distribution, {e.format(x=x1)} - {e.format(x=x0)} AS weight FROM sp" for n, e in f.items())
    parts = ", ".join(metrics_sql("rg", "task, distribution", "l", str(b), "1000.0::DOUBLE", f"g{b}") for b in (10, 20, 50))
    union = " UNION ALL ".join(f"SELECT *, {b}::INTEGER AS batch FROM g{b}" for b in (10, 20, 50))
    return f"""sp AS (SELECT task, lo, greatest(hi - lo, 1)::DOUBLE AS w, unnest(range(lo, hi + 1))::INTEGER AS d FROM (SELECT task, min(level) AS lo, max(level) AS hi FROM l GROUP BY ALL)), ce AS ({cells}),
jg AS (SELECT ce.task, ce.distribution, ce.difficulty, ce.weight, l.cheap_acc, l.capable_acc, al.alarm_level FROM ce JOIN l ON l.task = ce.task AND l.level = ce.difficulty LEFT JOIN al ON al.task = ce.task),
rg AS (SELECT *, 'always_cheap' AS policy, false AS use_capable FROM jg UNION ALL SELECT *, 'always_capable', true FROM jg UNION ALL SELECT *, 'oracle', capable_acc > cheap_acc FROM jg UNION ALL SELECT *, 'alarm', coalesce(difficulty >= alarm_level, false) FROM jg), {parts}, gu AS ({union})"""


@query("rt05_routing_grid", f"WITH {LVM}, {RTE}, {_grid_sql()} SELECT task, distribution, batch, policy, alarm_level, {PSEL} FROM gu")
def _(spark, d):
    lv, al = _pair(spark, d)
    return rounded(R.routing_grid(lv, al, batches=(10, 20, 50)), *PCOLS, digits=5)


@query("rt06_method_cost_table", f"""WITH {LVM}, u AS (SELECT role AS family, count(*) AS calls, sum(length(text)) * 0.001::DOUBLE AS cost FROM conversations GROUP BY ALL), s AS (SELECT CASE WHEN model = 'click' THEN 'user' WHEN model = 'view' THEN 'assistant' ELSE 'none' END AS family, max(accuracy) AS f1 FROM lv GROUP BY ALL)
SELECT s.family, coalesce(calls, 0) AS calls, round(coalesce(cost, 0), 6)::DOUBLE + 0.0 AS cost, round(f1, 6) + 0.0 AS best_f1 FROM s LEFT JOIN u USING (family)""")
def _(spark, d):
    u = table(spark, d, "conversations").select(F.col("role").alias("family"), (F.length("text") * 0.001).alias("cost"))
    fam = F.when(F.col("model") == "click", "user").when(F.col("model") == "view", "assistant").otherwise("none")
    s = levels(spark, d, True).select(fam.alias("family"), F.col("accuracy").alias("f1"))
    return rounded(R.method_cost_table(u, s), "cost", "best_f1")
