"""PRJ: labels, zones, flags and costs."""

from pyspark.sql import functions as F

from levelscan.functions import predicates as P
from levelscan.queries.bindings import ALL_LVM, LVM, all_levels, levels, with_d_star
from levelscan.queries.registry import query, r6, table

K = ["task", "model", "level"]


@query("prj01_short_name", """SELECT page_id, CASE WHEN url = 'x' THEN 'y' ELSE regexp_extract(url, '([^/]*)$', 1) END AS short_name FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.short_name("url", {"x": "y"}).alias("short_name"))


@query("prj02_pair_id", "SELECT DISTINCT concat_ws('__', 'events', event_type) AS pair_id FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select(P.pair_id(F.lit("events"), "event_type").alias("pair_id")).distinct()


@query("prj03_label_near", f"""WITH {LVM} SELECT task, model, level, CAST(level >= d_star - 2 AS INTEGER) AS approaching,
 CAST(level >= d_star - 3 AS INTEGER) AS approaching3, CAST(abs(level - d_star) <= 2 AS INTEGER) AS symmetric,
 CAST(d_star - level <= 2 AND level <= d_star AS INTEGER) AS one_sided,
 CASE WHEN level >= d_star - 2 THEN 1 WHEN level <= d_star - 3 THEN 0 END AS gap FROM lvd""")
def _(spark, d):
    lv = with_d_star(levels(spark, d, True))
    return lv.select(
        *K,
        P.label_near("level", "d_star").alias("approaching"),
        P.label_near("level", "d_star", 3).alias("approaching3"),
        P.label_near("level", "d_star", 2, "symmetric").alias("symmetric"),
        P.label_near("level", "d_star", 2, "one_sided").alias("one_sided"),
        P.label_near("level", "d_star", 2, "gap").alias("gap"),
    )


@query("prj04_zones", f"""WITH {LVM} SELECT task, model, level, CASE WHEN level <= d_star - 5 OR level < d_star / 2.0 THEN 'far'
 WHEN level < d_star - 3 THEN 'pre' WHEN level <= d_star THEN 'near' WHEN level > d_star THEN 'beyond' END AS zone,
 level < d_star - 3 AS clearly_safe FROM lvd""")
def _(spark, d):
    lv = with_d_star(levels(spark, d, True))
    return lv.select(*K, P.zone("level", "d_star").alias("zone"), (F.col("level") < F.col("d_star") - 3).alias("clearly_safe"))


@query("prj05_classify_pairs", f"""WITH {ALL_LVM} SELECT task, model, min(level) AS min_level, max(d_star) AS d_star,
 CASE WHEN max(d_star) IS NULL THEN 'negative' WHEN max(d_star) > min(level) THEN 'positive' ELSE 'excluded' END AS pair_class
 FROM lvd GROUP BY ALL""")
def _(spark, d):
    return P.classify_pairs(with_d_star(all_levels(spark, d, True)))


@query("prj06_task_indicators", f"""WITH {ALL_LVM} SELECT task, model, level, CAST(task = 'events' AS DOUBLE) AS is_events,
 CAST(task = 'orders' AS DOUBLE) AS is_orders, CAST(task = 'lineitem' AS DOUBLE) AS is_lineitem FROM lv""")
def _(spark, d):
    flags = P.task_indicators("task", ["events", "orders", "lineitem"])
    return all_levels(spark, d, True).select(*K, *[c.alias(n) for n, c in flags.items()])


@query("prj07_safe_float", """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN CAST(value AS VARCHAR) ELSE NULL END AS s FROM events)
SELECT event_id, CASE WHEN try_cast(s AS DOUBLE) IS NULL OR isnan(try_cast(s AS DOUBLE)) OR isinf(try_cast(s AS DOUBLE)) THEN -1.0::DOUBLE ELSE try_cast(s AS DOUBLE) END AS v FROM t""")
def _(spark, d):
    k = F.col("event_id") % 4
    s = F.when(k == 0, "nan").when(k == 1, "None").when(k == 2, F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", P.safe_float(s, -1.0).alias("v"))


@query("prj08_binary_indicators", f"""WITH {LVM} SELECT task, model, level, CAST(dip_pvalue < 0.05 AS INTEGER) AS b_dip,
 CAST(silhouette_k2 > 0.3 AS INTEGER) AS b_silhouette, CAST(bimodality_coefficient > 0.555 AS INTEGER) AS b_bimodality,
 CAST(disagreement_rate > 0.5 AS INTEGER) AS b_disagreement,
 coalesce(CAST(variance - lag(variance) OVER (PARTITION BY task, model ORDER BY level) > 0 AS INTEGER), 0) AS b_variance_up FROM lv""")
def _(spark, d):
    return levels(spark, d, True).select(*K, *[c.alias(n) for n, c in P.binary_indicators().items()])


@query("prj09_bimodality_consensus", f"""WITH {LVM} SELECT task, model, level,
 (CAST(dip_pvalue < 0.05 AS INT) + CAST(silhouette_k2 > 0.3 AS INT) + CAST(bimodality_coefficient > 5.0/9.0 AS INT)) >= 2 AS bimodal FROM lv""")
def _(spark, d):
    return levels(spark, d, True).select(*K, P.bimodality_consensus().alias("bimodal"))


@query("prj10_short_answer", """SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 5 AND length(text) < 100 AS is_short FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.short_answer("text").alias("is_short"))


@query("prj11_variant_category", """SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'spuq' WHEN contains(p_name, 'blue') THEN 'baseline' ELSE 'csd' END AS category FROM part""")
def _(spark, d):
    name = F.regexp_replace(F.regexp_replace("p_name", "red", "spuq"), "blue", "only")
    return table(spark, d, "part").select("p_partkey", P.variant_category(name).alias("category"))


@query("prj12_token_cost", """SELECT conv_id, turn, round((length(text) * b.nk + 3 * length(text) * 2 * b.nk) / 1e6, 9) + 0.0 AS cost
 FROM conversations JOIN (SELECT 'user' AS role, 0.5 AS nk UNION ALL SELECT 'assistant', 2.0 UNION ALL SELECT 'system', 0.1) b USING (role)""")
def _(spark, d):
    c = table(spark, d, "conversations")
    usage = c.select("conv_id", "turn", F.col("role").alias("model"), F.length("text").alias("tokens_in"), (F.length("text") * 3).alias("tokens_out"))
    prices = spark.createDataFrame([("user", 0.5, 1.0), ("assistant", 2.0, 4.0), ("system", 0.1, 0.2)], "model string, price_in double, price_out double")
    return P.token_cost(usage, prices).select("conv_id", "turn", r6("cost", 9).alias("cost"))
