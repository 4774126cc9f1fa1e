"""AG: grouped aggregates over response rows."""

from pyspark.sql import functions as F

from levelscan.functions import predicates as P
from levelscan.operators import aggregates as A
from levelscan.operators.vectors import group_pair_stats, group_vector_moments, vector_norm
from levelscan.queries.bindings import ALL_LV, ALL_LVM, EV, LV, all_levels, ev_rows, levels, with_d_star
from levelscan.queries.registry import query, r6, rounded, table

K = ["task", "model", "level"]
# responses whose answer is unparsed for small values; the truth is 'b' for even levels
R = f"""{EV}, r AS (SELECT task, model, level, item_id, x, correct, CASE WHEN x < 5 THEN NULL WHEN x < 30 THEN 'a' WHEN x < 60 THEN 'b' ELSE ' B ' END AS answer,
 CASE WHEN level % 5 = 4 THEN NULL WHEN level % 2 = 0 THEN 'b' ELSE 'a' END AS truth FROM ev)"""


def _r(spark, d):
    x, lv = F.col("x"), F.col("level")
    return ev_rows(spark, d).withColumns({
        "answer": F.when(x < 5, None).when(x < 30, "a").when(x < 60, "b").otherwise(" B "),
        "truth": F.when(lv % 5 == 4, None).when(lv % 2 == 0, "b").otherwise("a"),
    })


def _tf(rows):
    m = F.when(F.trim(F.lower("answer")) == "a", "TRUE").when(F.col("answer").isNotNull(), "FALSE")
    return rows.withColumn("answer", m)


TF = R + """, tf AS (SELECT task, model, level, item_id, CASE WHEN lower(trim(answer)) = 'a' THEN 'TRUE' WHEN answer IS NOT NULL THEN 'FALSE' END AS answer FROM r)"""


@query("ag00_level_table", f"""WITH {ALL_LVM} SELECT task, model, level, n, round(accuracy, 6) + 0.0 AS accuracy, round(variance, 6) + 0.0 AS variance,
 round(bimodality_coefficient, 6) + 0.0 AS bimodality_coefficient, round(disagreement_rate, 6) + 0.0 AS disagreement_rate, round(ashman_d, 6) + 0.0 AS ashman_d,
 round(dip_pvalue, 6) + 0.0 AS dip_pvalue, round(silhouette_k2, 6) + 0.0 AS silhouette_k2 FROM lv""")
def _(spark, d):
    cols = ["accuracy", "variance", "bimodality_coefficient", "disagreement_rate", "ashman_d", "dip_pvalue", "silhouette_k2"]
    return rounded(all_levels(spark, d, True).select(*K, "n", *cols), *cols)


@query("ag01_accuracy_extracted", f"""WITH {R} SELECT task, model, level, round(count(*) FILTER (WHERE answer = truth) / greatest(count(*) FILTER (WHERE answer IS NOT NULL AND truth IS NOT NULL), 1), 6) + 0.0 AS accuracy FROM r GROUP BY ALL""")
def _(spark, d):
    return rounded(A.accuracy(_r(spark, d), K, "extracted"), "accuracy")


@query("ag02_accuracy_all", f"WITH {EV} SELECT task, model, level, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(A.accuracy(ev_rows(spark, d), K, "all"), "accuracy")


@query("ag03_accuracy_valid", """WITH e AS (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS n2, embedding[1] > 0 AS correct FROM embeddings)
SELECT label, round(avg(CAST(correct AS INTEGER)), 6) + 0.0 AS accuracy FROM e WHERE sqrt(n2) > 1e-8 GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", vector_norm("embedding").alias("norm"), (F.col("embedding")[0] > 0).alias("correct"))
    return rounded(A.accuracy(e, ["label"], "valid"), "accuracy")


@query("ag04a_disagreement_extracted", f"""WITH {R}, c AS (SELECT task, model, level, answer, count(*) AS c FROM r WHERE answer IS NOT NULL GROUP BY ALL),
 g AS (SELECT DISTINCT task, model, level FROM r) SELECT g.task, g.model, g.level, round(coalesce(1 - max(c) / sum(c), 1.0), 6) + 0.0 AS disagreement_rate FROM g LEFT JOIN c USING (task, model, level) GROUP BY ALL""")
def _(spark, d):
    return rounded(A.disagreement(_r(spark, d), K, "extracted"), "disagreement_rate")


@query("ag04b_disagreement_all", f"""WITH {R}, c AS (SELECT task, model, level, answer, count(*) AS c FROM r GROUP BY ALL)
SELECT task, model, level, round(1 - max(c) / sum(c), 6) + 0.0 AS disagreement_rate FROM c GROUP BY ALL""")
def _(spark, d):
    return rounded(A.disagreement(_r(spark, d), K, "all"), "disagreement_rate")


@query("ag04c_disagreement_normalized", f"""WITH {R}, c AS (SELECT task, model, level, lower(trim(answer)) AS a, count(*) AS c FROM r GROUP BY ALL)
SELECT task, model, level, round(1 - coalesce(max(c) FILTER (WHERE a <> ''), 0) / sum(c), 6) + 0.0 AS disagreement_rate FROM c GROUP BY ALL""")
def _(spark, d):
    return rounded(A.disagreement(_r(spark, d), K, "normalized"), "disagreement_rate")


@query("ag04d_disagreement_boolean", f"""WITH {TF}, c AS (SELECT task, model, level, answer, count(*) AS c FROM tf GROUP BY ALL)
SELECT task, model, level, round(coalesce(1 - max(c) FILTER (WHERE answer IN ('TRUE', 'FALSE')) / sum(c) FILTER (WHERE answer IN ('TRUE', 'FALSE')), 1.0), 6) + 0.0 AS disagreement_rate FROM c GROUP BY ALL""")
def _(spark, d):
    return rounded(A.disagreement(_tf(_r(spark, d)), K, "boolean"), "disagreement_rate")


@query("ag05_majority_answer", f"""WITH {TF}, c AS (SELECT task, model, level, answer, count(*) AS c, min(item_id) AS f FROM tf WHERE answer IS NOT NULL GROUP BY ALL)
SELECT task, model, level, answer AS majority_answer, c AS majority_count FROM c QUALIFY row_number() OVER (PARTITION BY task, model, level ORDER BY c DESC, f) = 1""")
def _(spark, d):
    return A.majority_answer(_tf(_r(spark, d)), K, "item_id")


@query("ag06_answer_balance", f"""WITH {TF} SELECT task, model, level, round(least(count(*) FILTER (WHERE answer = 'TRUE'), count(*) FILTER (WHERE answer = 'FALSE')) / greatest(count(answer), 1), 6) + 0.0 AS answer_balance FROM tf GROUP BY ALL""")
def _(spark, d):
    return rounded(A.answer_balance(_tf(_r(spark, d)), K), "answer_balance")


@query("ag07_answer_entropy", f"""WITH {EV}, c AS (SELECT task, model, level, answer, count(*) AS c FROM ev GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY task, model, level) AS p FROM c)
SELECT task, model, level, round(-sum(p * log2(p)), 6) + 0.0 AS answer_entropy FROM p GROUP BY ALL""")
def _(spark, d):
    return rounded(A.answer_entropy(ev_rows(spark, d), K), "answer_entropy")


@query("ag08_answer_quality", f"""WITH {R} SELECT task, model, level, count(DISTINCT answer) AS unique_answers, round(count(answer) / count(*), 6) + 0.0 AS extraction_rate,
 count(answer) AS n_parsed, count(*) - count(answer) AS n_extraction_failures FROM r GROUP BY ALL""")
def _(spark, d):
    return rounded(A.answer_quality(_r(spark, d), K), "extraction_rate")


EMB = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""
PAIRS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.label, 1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS dist FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("ag09_embedding_variance_trace", f"WITH {EMB}, s AS (SELECT label, i, var_samp(v) AS s FROM e GROUP BY ALL) SELECT label, round(sum(s), 6) + 0.0 AS variance_trace FROM s GROUP BY ALL")
def _(spark, d):
    m = group_vector_moments(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", r6("variance_trace").alias("variance_trace"))


@query("ag10_mean_cosine_distance", f"WITH {PAIRS} SELECT label, round(avg(dist), 6) + 0.0 AS mean_cosine_distance FROM p GROUP BY ALL")
def _(spark, d):
    m = group_vector_moments(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", r6("mean_cosine_distance").alias("mean_cosine_distance"))


@query("ag11_std_cosine_distance", f"WITH {PAIRS} SELECT label, count(*) AS n_pairs, round(avg(dist), 6) + 0.0 AS mean_cosine_distance, round(stddev_pop(dist), 6) + 0.0 AS std_cosine_distance FROM p GROUP BY ALL")
def _(spark, d):
    return rounded(group_pair_stats(table(spark, d, "embeddings"), ["label"], "embedding"), "mean_cosine_distance", "std_cosine_distance")


@query("ag12_group_counts", f"""WITH {LV} SELECT task, model, count(*) AS n_rows, count(*) FILTER (WHERE level >= d_star - 2) AS n_near, count(*) FILTER (WHERE NOT level >= d_star - 2) AS n_safe FROM lvd GROUP BY ALL""")
def _(spark, d):
    lv = with_d_star(levels(spark, d))
    return A.group_counts(lv, ["task", "model"], P.label_near("level", "d_star")).withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_near", "n_safe")})


@query("ag13_op_distribution", """WITH o AS (SELECT o_custkey, string_split(o_orderpriority, '-')[1] AS op FROM orders), n AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS level, o_orderstatus AS op FROM orders)
SELECT level, round(avg(CAST(op = 'F' AS INT)), 6) + 0.0 AS share_0, round(avg(CAST(op = 'O' AS INT)), 6) + 0.0 AS share_1, round(avg(CAST(op = 'P' AS INT)), 6) + 0.0 AS share_2 FROM n GROUP BY ALL""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("level"), F.array("o_orderstatus").alias("ops"))
    return rounded(A.op_distribution(o, "level", "ops", ["F", "O", "P"]), "share_0", "share_1", "share_2")


@query("ag14_value_summary", f"""WITH {EMB}, s AS (SELECT label, min(v) AS min_value, max(v) AS max_value, avg(v) AS mean_value FROM e GROUP BY ALL)
SELECT label, round(min_value, 6) + 0.0 AS min_value, round(max_value, 6) + 0.0 AS max_value, round(mean_value, 6) + 0.0 AS mean_value, coalesce(mean_value >= lag(mean_value) OVER (ORDER BY label), true) AS non_decreasing FROM s""")
def _(spark, d):
    from pyspark.sql import Window as W
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    s = A.value_summary(e, ["label"], "embedding")
    nd = F.coalesce(F.col("mean_value") >= F.lag("mean_value").over(W.orderBy("label")), F.lit(True))
    return rounded(s.withColumn("non_decreasing", nd), "min_value", "max_value", "mean_value")


@query("ag15_macro_average", f"""WITH {ALL_LV} SELECT task, round(avg(accuracy), 6) + 0.0 AS macro_accuracy, round(avg(disagreement_rate), 6) + 0.0 AS macro_disagreement_rate FROM lv GROUP BY ALL""")
def _(spark, d):
    return rounded(A.macro_average(all_levels(spark, d), ["task"], ["accuracy", "disagreement_rate"]), "macro_accuracy", "macro_disagreement_rate")


@query("ag16_win_counts", f"""WITH {LV}, w AS (SELECT level, model AS winner FROM lv QUALIFY row_number() OVER (PARTITION BY level ORDER BY variance, model) = 1)
SELECT winner, count(*) AS wins FROM w GROUP BY ALL""")
def _(spark, d):
    return A.win_counts(levels(spark, d), ["level"], "model", "variance")


@query("ag17_significance_summary", f"""WITH {ALL_LVM} SELECT task, model, bool_and(dip_pvalue < 0.05) AS all_significant, round(avg(CASE WHEN accuracy - 0.5 > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_positive FROM lv GROUP BY ALL""")
def _(spark, d):
    lv = all_levels(spark, d, True).withColumn("rho", F.col("accuracy") - 0.5)
    return rounded(A.significance_summary(lv, ["task", "model"], "dip_pvalue", "rho"), "fraction_positive")


@query("ag18_coverage_count", f"""WITH {ALL_LV} SELECT count(DISTINCT task) FILTER (WHERE bimodality_coefficient > 5/9.0) AS n_tasks, count(DISTINCT model) FILTER (WHERE bimodality_coefficient > 5/9.0) AS n_models,
 count(DISTINCT task) FILTER (WHERE bimodality_coefficient > 5/9.0) >= 2 AND count(DISTINCT model) FILTER (WHERE bimodality_coefficient > 5/9.0) >= 2 AS passed FROM lv""")
def _(spark, d):
    return A.coverage_count(all_levels(spark, d), F.col("bimodality_coefficient") > 5.0 / 9.0)


@query("ag19_cv_dispersion", f"""WITH {ALL_LV} SELECT task, model, round(avg(variance), 6) + 0.0 AS mean_value, round(stddev_pop(variance), 6) + 0.0 AS std_value, round(stddev_pop(variance) / avg(variance), 6) + 0.0 AS cv FROM lv GROUP BY ALL""")
def _(spark, d):
    return rounded(A.cv_dispersion(all_levels(spark, d), ["task", "model"], "variance"), "mean_value", "std_value", "cv")


@query("ag20_usage_totals", """SELECT role AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(3 * length(text)) AS BIGINT) AS tokens_out, round(sum(length(text) * 0.25 / 1000), 6) + 0.0 AS cost FROM conversations GROUP BY ROLLUP (role)""")
def _(spark, d):
    n = F.length("text")
    u = table(spark, d, "conversations").select(F.col("role").alias("model"), n.alias("tokens_in"), (n * 3).alias("tokens_out"), (n * 0.25 / 1000).alias("cost"))
    return rounded(A.usage_totals(u, "model"), "cost")


@query("ag21_problem_then_level_mean", """WITH r AS (SELECT l_orderkey AS item, CAST(year(l_shipdate) AS INTEGER) AS level, l_returnflag AS answer, l_quantity > 20 AS correct FROM lineitem),
c AS (SELECT level, item, answer, count(*) AS c, count(*) FILTER (WHERE correct) AS ok FROM r GROUP BY ALL),
i AS (SELECT level, item, CASE WHEN sum(c) >= 2 THEN 1 - max(c) / sum(c) ELSE 1.0 END AS d, sum(ok) / sum(c) AS a FROM c GROUP BY ALL)
SELECT level, round(avg(d), 6) + 0.0 AS mean_disagreement, round(avg(a), 6) + 0.0 AS mean_accuracy, count(*) AS n_items FROM i GROUP BY ALL""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.year("l_shipdate").alias("level"), F.col("l_returnflag").alias("answer"), (F.col("l_quantity") > 20).alias("correct"))
    return rounded(A.problem_then_level_mean(li, ["level"], "item"), "mean_disagreement", "mean_accuracy")
