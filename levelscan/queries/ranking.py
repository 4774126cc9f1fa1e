"""TK and ST: top-k, best per group, sets."""

from pyspark.sql import functions as F

from levelscan.operators import ranking as R
from levelscan.queries.bindings import ALL_LV, LV, all_levels, ev_rows, levels, line_rows, EV
from levelscan.queries.registry import query, r6, rounded, table


@query("tk01_top_k", f"WITH {LV} SELECT model, level, round(variance, 6) + 0.0 AS variance FROM lv ORDER BY variance DESC, model LIMIT 10")
def _(spark, d):
    return rounded(R.top_k(levels(spark, d).select("model", "level", "variance"), "variance", 10, "model"), "variance")


@query("tk02_best_per_group", f"""WITH {ALL_LV}, t AS (SELECT task, level, model, round(accuracy, 6) + 0.0 AS accuracy FROM lv) SELECT task, level, model, accuracy FROM t QUALIFY row_number() OVER (PARTITION BY task, level ORDER BY accuracy DESC, model) = 1""")
def _(spark, d):
    t = rounded(all_levels(spark, d).select("task", "level", "model", "accuracy"), "accuracy")
    return R.best_per_group(t, ["task", "level"], "accuracy", "model")


@query("tk03_rank_methods", f"""WITH {LV}, m AS (SELECT model, avg(accuracy) AS a, avg(disagreement_rate) AS b FROM lv GROUP BY ALL) SELECT model, round(0.7 * a + 0.3 * b, 6) + 0.0 AS composite, CAST(row_number() OVER (ORDER BY 0.7 * a + 0.3 * b DESC, model) AS INTEGER) AS rank FROM m""")
def _(spark, d):
    m = levels(spark, d).groupBy("model").agg(F.avg("accuracy").alias("a"), F.avg("disagreement_rate").alias("b"))
    return rounded(R.rank_methods(m, {"a": 0.7, "b": 0.3}, "model").select("model", "composite", "rank"), "composite")


@query("tk04_peak_level", f"""WITH {ALL_LV}, t AS (SELECT task, model, (SELECT level FROM lv b WHERE b.task = a.task AND b.model = a.model ORDER BY variance DESC, level LIMIT 1) AS peak_level, (SELECT level FROM lv b WHERE b.task = a.task AND b.model = a.model ORDER BY abs(accuracy - 0.5), level LIMIT 1) AS half_level FROM (SELECT DISTINCT task, model FROM lv) a)
SELECT *, abs(peak_level - half_level) <= 1 AS match_within_1, abs(peak_level - half_level) <= 2 AS match_within_2 FROM t""")
def _(spark, d):
    return R.peak_levels(all_levels(spark, d))


@query("st01_dedup_normalized", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(trim(text))")
def _(spark, d):
    return R.dedup_normalized(table(spark, d, "documents"), "text", "doc_id")


@query("st02_dedup_edge_set", """WITH e AS (SELECT DISTINCT l_orderkey AS g, least(l_linenumber, l_linenumber % 7 + 1) AS a, greatest(l_linenumber, l_linenumber % 7 + 1) AS b FROM lineitem), k AS (SELECT g, list((a, b) ORDER BY a, b) AS k FROM e GROUP BY ALL)
SELECT min(g) AS g, count(*) AS copies FROM k GROUP BY k""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.collect_set("l_linenumber").alias("ns"))
    g = g.select("g", F.transform("ns", lambda n: F.array(n % 7 + 1, n)).alias("edges"))
    return R.dedup_edge_set(g, "edges", "g")


@query("st03_key_sets", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 5000) b ON a.k = b.k""")
def _(spark, d):
    a = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return R.key_sets(a, b, "k")


@query("st04_ordered_distinct", """WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL)
SELECT doc_id, count(*)::INTEGER AS n_distinct, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM f GROUP BY ALL""")
def _(spark, d):
    u = F.array_distinct(F.split(F.lower("text"), " "))
    return table(spark, d, "documents").select("doc_id", F.size(u).alias("n_distinct"), F.md5(F.array_join(u, " ")).alias("digest"))


@query("st05_unique_entity_sets", """WITH s AS (SELECT list_sort(string_split(lower(text), ' ')) AS k, count(*) AS c FROM documents GROUP BY ALL) SELECT count(*) AS n_unique, CAST(sum(c) AS BIGINT) AS n_rows, count(*) FILTER (WHERE c > 1) AS n_repeated FROM s""")
def _(spark, d):
    return R.unique_sets(table(spark, d, "documents"), F.split(F.lower("text"), " "))


@query("st06_union_examples", f"""WITH {EV}, u AS (SELECT level FROM ev UNION ALL SELECT l_linenumber FROM lineitem) SELECT level, count(*) AS n FROM u GROUP BY ALL""")
def _(spark, d):
    return R.union_examples(ev_rows(spark, d), line_rows(spark, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
