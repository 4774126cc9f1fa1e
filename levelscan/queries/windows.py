"""WN: window features over level series."""

from pyspark.sql import functions as F

from levelscan.operators import windows as N
from levelscan.plans.draws import hash32
from levelscan.queries.bindings import ALL_LV, EV, LV, all_levels, ev_rows, levels, with_d_star
from levelscan.queries.registry import query, rounded, table

K = ["task", "model", "level"]
PW = "PARTITION BY task, model ORDER BY level"


def _f(spark, d, **cols):
    out = levels(spark, d).select(*K, *[c.alias(n) for n, c in cols.items()])
    return rounded(out, *cols)


@query("wn01_delta", f"WITH {LV} SELECT task, model, level, round(coalesce(variance - lag(variance) OVER ({PW}), 0), 6) + 0.0 AS v FROM lv")
def _(spark, d):
    return _f(spark, d, v=N.delta("variance"))


@query("wn02_acceleration", f"""WITH {LV}, t AS (SELECT *, variance - lag(variance) OVER ({PW}) AS dv FROM lv)
SELECT task, model, level, round(coalesce(dv - lag(dv) OVER ({PW}), 0), 6) + 0.0 AS v FROM t""")
def _(spark, d):
    return _f(spark, d, v=N.acceleration("variance"))


@query("wn03_rolling_slope_ordinal", f"""WITH {LV}, t AS (SELECT *, row_number() OVER ({PW}) AS rn FROM lv),
s AS (SELECT *, count(*) OVER w AS c, regr_slope(variance, rn) OVER w AS b FROM t WINDOW w AS ({PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT task, model, level, round(CASE WHEN c < 2 THEN 0.0 ELSE b END, 6) + 0.0 AS v FROM s""")
def _(spark, d):
    return _f(spark, d, v=N.rolling_slope("variance"))


@query("wn04_rolling_slope_level", f"""WITH {LV}, s AS (SELECT *, count(*) OVER w AS c, regr_slope(variance, level) OVER w AS b FROM lv WINDOW w AS ({PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT task, model, level, round(CASE WHEN c < 3 THEN 0.0 ELSE b END, 6) + 0.0 AS v FROM s""")
def _(spark, d):
    return _f(spark, d, v=N.rolling_slope("variance", "level"))


@query("wn05_trailing_tau", f"""WITH {LV}, t AS (SELECT task, model, level, row_number() OVER ({PW}) AS rn, disagreement_rate AS f FROM lv),
w AS (SELECT c.task, c.model, c.level, a.rn AS ra, a.f AS fa FROM t c JOIN t a ON a.task = c.task AND a.model = c.model AND a.rn BETWEEN c.rn - 4 AND c.rn),
p AS (SELECT x.task, x.model, x.level, sum(sign(y.fa - x.fa)) AS s, count(*) AS n0, count(*) FILTER (WHERE x.fa = y.fa) AS t FROM w x JOIN w y ON x.task = y.task AND x.model = y.model AND x.level = y.level AND x.ra < y.ra GROUP BY ALL)
SELECT t.task, t.model, t.level, round(CASE WHEN n0 IS NULL OR n0 < 3 OR n0 = p.t THEN 0.0 ELSE s / sqrt(n0 * (n0 - p.t)) END, 6) + 0.0 AS v FROM t LEFT JOIN p ON t.task = p.task AND t.model = p.model AND t.level = p.level""")
def _(spark, d):
    return _f(spark, d, v=N.trailing_tau("disagreement_rate"))


@query("wn06_running_z", f"""WITH {LV}, s AS (SELECT *, avg(variance) OVER w AS m, stddev_pop(variance) OVER w AS sp, stddev_samp(variance) OVER w AS ss FROM lv WINDOW w AS ({PW} ROWS UNBOUNDED PRECEDING))
SELECT task, model, level, round(CASE WHEN sp < 1e-12 THEN 0.0 ELSE (variance - m) / sp END, 6) + 0.0 AS z0, round((variance - m) / greatest(coalesce(ss, 0), 1e-10), 6) + 0.0 AS z1 FROM s""")
def _(spark, d):
    return _f(spark, d, z0=N.running_z("variance"), z1=N.running_z("variance", 1))


@query("wn07_running_max_ratio", f"WITH {LV} SELECT task, model, level, round(variance / greatest(abs(max(variance) OVER ({PW})), 1e-10), 6) + 0.0 AS v FROM lv")
def _(spark, d):
    return _f(spark, d, v=N.running_max_ratio("variance"))


@query("wn08_ratios", f"""WITH {LV} SELECT task, model, level, round(variance / (abs(first(variance) OVER ({PW})) + 1e-8), 6) + 0.0 AS to_base, round(variance / (abs(max(variance) OVER (PARTITION BY task, model)) + 1e-8), 6) + 0.0 AS to_max FROM lv""")
def _(spark, d):
    return _f(spark, d, to_base=N.ratio_to_baseline("variance"), to_max=N.ratio_to_max("variance"))


@query("wn09_pct_rank_avg", f"""WITH {LV} SELECT task, model, level, round((rank() OVER (PARTITION BY task, model ORDER BY accuracy) + (count(*) OVER (PARTITION BY task, model, accuracy) - 1) / 2.0) / count(*) OVER (PARTITION BY task, model), 6) + 0.0 AS by_pair,
 round((rank() OVER (PARTITION BY task ORDER BY accuracy) + (count(*) OVER (PARTITION BY task, accuracy) - 1) / 2.0) / count(*) OVER (PARTITION BY task), 6) + 0.0 AS by_task FROM lv""")
def _(spark, d):
    return _f(spark, d, by_pair=N.pct_rank_avg("accuracy"), by_task=N.pct_rank_avg("accuracy", ["task"]))


@query("wn10_zscore", f"""WITH {ALL_LV} SELECT task, model, level, round((accuracy - avg(accuracy) OVER (PARTITION BY task)) / (stddev_samp(accuracy) OVER (PARTITION BY task) + 1e-8), 6) + 0.0 AS z_eps,
 round(CASE WHEN stddev_samp(accuracy) OVER p < 1e-10 THEN 0.0 ELSE (accuracy - avg(accuracy) OVER p) / stddev_samp(accuracy) OVER p END, 6) + 0.0 AS z_floor,
 round((accuracy - avg(accuracy) OVER p) / CASE WHEN stddev_pop(accuracy) OVER p < 1e-12 THEN 1.0 ELSE stddev_pop(accuracy) OVER p END, 6) + 0.0 AS z_pop FROM lv WINDOW p AS (PARTITION BY task, model)""")
def _(spark, d):
    pair = ["task", "model"]
    out = all_levels(spark, d).select(*K, N.zscore("accuracy", ["task"]).alias("z_eps"), N.zscore("accuracy", pair, "floor").alias("z_floor"), N.zscore("accuracy", pair, "pop").alias("z_pop"))
    return rounded(out, "z_eps", "z_floor", "z_pop")


@query("wn11_minmax", f"""WITH {ALL_LV}, t AS (SELECT *, min(level) OVER (PARTITION BY task) AS lo, max(level) OVER (PARTITION BY task) AS hi FROM lv)
SELECT task, model, level, round(CASE WHEN hi > lo THEN (level - lo) / (hi - lo) ELSE 0.0 END, 6) + 0.0 AS rel, round((level - lo) / greatest(hi - lo, 1), 6) + 0.0 AS rel2 FROM t""")
def _(spark, d):
    out = all_levels(spark, d).select(*K, N.minmax("level", ["task"]).alias("rel"), N.minmax("level", ["task"], "one").alias("rel2"))
    return rounded(out, "rel", "rel2")


@query("wn12_relative_distance", f"""WITH {ALL_LV} SELECT task, model, level, round((d_star - level) / greatest(d_star - min(level) OVER (PARTITION BY task), 1), 6) + 0.0 AS rel, round(CASE WHEN d_star <> 0 THEN level / d_star END, 6) + 0.0 AS ratio FROM lvd""")
def _(spark, d):
    out = with_d_star(all_levels(spark, d)).select(*K, N.relative_distance().alias("rel"), (F.when(F.col("d_star") != 0, F.col("level") / F.col("d_star"))).alias("ratio"))
    return rounded(out, "rel", "ratio")


@query("wn13_critical_level", f"""WITH {ALL_LV} SELECT task, model, min(level) FILTER (WHERE accuracy < 0.5) AS d_star, coalesce(min(level) FILTER (WHERE accuracy < 0.5), max(level) + 1) AS d_star_next FROM lv GROUP BY ALL""")
def _(spark, d):
    lv = all_levels(spark, d)
    nxt = N.critical_level(lv, default="next").withColumnRenamed("d_star", "d_star_next")
    return N.critical_level(lv).join(nxt, ["task", "model"])


@query("wn14_first_crossing", f"""WITH {ALL_LV}, h AS (SELECT *, CASE WHEN bimodality_coefficient > 0.555 AND accuracy > 0.5 AND level <= d_star THEN level END AS k FROM lvd)
SELECT task, model, max(d_star) AS d_star, min(k) AS d_lead, round(arg_min(accuracy, k), 6) + 0.0 AS accuracy_at_signal, max(d_star) - min(k) AS lead_time FROM h GROUP BY ALL""")
def _(spark, d):
    lv = with_d_star(all_levels(spark, d))
    out = N.first_crossing(lv, F.col("bimodality_coefficient") > 0.555, guard=F.col("accuracy") > 0.5)
    return rounded(out, "accuracy_at_signal")


@query("wn15_next_drop_label", f"""WITH {LV}, t AS (SELECT *, lead(accuracy) OVER ({PW}) AS nx FROM lv) SELECT task, model, level, CAST(accuracy - nx > 0.05 AS INTEGER) AS label FROM t WHERE nx IS NOT NULL""")
def _(spark, d):
    return N.next_drop_label(levels(spark, d), 0.05).select(*K, "label")


@query("wn16_calibration_stats", f"""WITH {LV}, t AS (SELECT *, row_number() OVER ({PW}) AS rn FROM lv) SELECT task, model, round(avg(variance), 6) + 0.0 AS cal_mean, round(coalesce(stddev_samp(variance), 0), 6) + 0.0 AS cal_std FROM t WHERE rn <= 3 GROUP BY ALL""")
def _(spark, d):
    return rounded(N.calibration_stats(levels(spark, d), "variance"), "cal_mean", "cal_std")


@query("wn17a_stratified_pick", f"""WITH {EV} SELECT model, level, item_id, row_number() OVER (PARTITION BY model, level ORDER BY ('0x' || substr(md5('42|' || item_id), 1, 8))::UBIGINT, item_id)::INTEGER AS pick FROM ev QUALIFY pick <= 5""")
def _(spark, d):
    ev = ev_rows(spark, d).select("model", "level", "item_id")
    return N.stratified_pick(ev, 5, ["model", "level"], [hash32(42, F.col("item_id")), F.col("item_id")])


@query("wn17b_balanced_pick", f"""WITH {EV}, o AS (SELECT model, level, item_id, CASE WHEN x > 100 THEN 'TRUE' ELSE 'FALSE' END AS output FROM ev),
h AS (SELECT *, row_number() OVER (PARTITION BY model, level, output ORDER BY item_id) AS r FROM o),
s AS (SELECT *, CAST(r > CASE WHEN (level % 2 = 0) = (output = 'TRUE') THEN 3 ELSE 2 END AS INT) AS spare FROM h)
SELECT model, level, item_id, output, CAST(row_number() OVER (PARTITION BY model, level ORDER BY spare, item_id) AS INTEGER) AS pick FROM s QUALIFY pick <= 5""")
def _(spark, d):
    ev = ev_rows(spark, d).select("model", "level", "item_id", F.when(F.col("x") > 100, "TRUE").otherwise("FALSE").alias("output"))
    return N.balanced_pick(ev, 5, ["model", "level"], "output", [F.col("item_id")], "level")


@query("wn18_section_fill", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(last_value(CASE WHEN length(line) < 30 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'preamble') AS section FROM l""")
def _(spark, d):
    from levelscan.sources.exports import text_lines
    lines = text_lines(table(spark, d, "documents"), "doc_id", "text")
    head = F.when((F.length("line") < 30) & (F.col("line") != ""), F.col("line"))
    return N.section_fill(lines, "doc_id", "line_no", head).select("doc_id", "line_no", "section")


@query("wn19a_variance_jump", f"""WITH {ALL_LV}, t AS (SELECT *, lag(variance) OVER ({PW}) AS pv FROM lvd) SELECT task, model, min(level) FILTER (WHERE variance > pv * 1.2 AND level < d_star) AS d_jump FROM t GROUP BY ALL""")
def _(spark, d):
    return N.variance_jump(with_d_star(all_levels(spark, d)))


@query("wn19b_variance_rise", f"""WITH {ALL_LV}, t AS (SELECT *, row_number() OVER ({PW}) AS rn, count(*) OVER (PARTITION BY task, model) AS nn FROM lvd WHERE level <= d_star),
b AS (SELECT task, model, quantile_cont(variance, 0.5::DOUBLE) AS base FROM t WHERE rn <= greatest(nn // 2, 1) GROUP BY ALL)
SELECT task, model, round(max(base), 6) + 0.0 AS base_variance, min(level) FILTER (WHERE variance > 1.1::DOUBLE * base) AS d_rise FROM t JOIN b USING (task, model) GROUP BY ALL""")
def _(spark, d):
    return rounded(N.variance_rise(with_d_star(all_levels(spark, d))), "base_variance")
