"""STR and GEN: streams and generators."""

import uuid

from pyspark.sql import functions as F

from levelscan.functions.scalars import chain_check
from levelscan.operators import generators as G
from levelscan.operators.joins import check_colouring
from levelscan.plans.parallel import spread
from levelscan.plans.session import shared_folder
from levelscan.queries.alarms import AL
from levelscan.queries.bindings import EV, LVM, levels
from levelscan.queries.registry import query, rounded, table
from levelscan.queries.statistics import hash_sql
from levelscan.streaming import monitors as S


def _folder(spark):
    return f"{shared_folder(spark)}/levelscan-stream-{uuid.uuid4().hex}"


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _result(spark, stream):
    f = _folder(spark)
    S.run_to_files(stream, f"{f}/out", f"{f}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{f}/out")


@query("str01_stream_level_aggregates", """WITH a AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY ALL)
SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) AS INTEGER) AS level, n, round(m, 6) + 0.0 AS mean_value, round(v, 6) + 0.0 AS variance FROM a WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def _(spark, d):
    out = _result(spark, S.stream_level_aggregates(_events(spark, d), ["event_type"], "ts", "value"))
    level = F.datediff(F.to_date("level_start"), F.lit("2024-01-01").cast("date")).alias("level")
    return rounded(out.select("event_type", level, "n", "mean_value", "variance"), "mean_value", "variance")


@query("str02_stream_alarm_monitor", f"""WITH {LVM}, {AL} SELECT task, model, level, protocol, round(statistic, 6) + 0.0 AS statistic, round("limit", 6) + 0.0 AS "limit", alarmed FROM al WHERE protocol IN ('any1', 'any2', 'all3', 'cusum_variance_h4.0', 'ewma_variance_l0.2_L2.5')""")
def _(spark, d):
    # the level table arrives in three pieces, in level order
    f = _folder(spark)
    lv = levels(spark, d, True).select("task", "model", "level", "variance", "disagreement_rate", "dip_pvalue")
    lv.write.parquet(f"{f}/all")
    for part, cond in enumerate(("level < 7", "level >= 7 and level < 19", "level >= 19")):
        spark.read.parquet(f"{f}/all").where(cond).coalesce(1).write.parquet(f"{f}/in/part={part}")
    src = spark.readStream.schema(lv.schema).option("maxFilesPerTrigger", 1).parquet(f"{f}/in/part=*")
    return rounded(_result(spark, S.stream_alarm_monitor(src)), "statistic", "limit")


@query("str03_stream_dedup", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY ALL")
def _(spark, d):
    twice = _events(spark, d).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = _result(spark, S.stream_dedup(twice, ["event_type", "event_id"], "ts"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("gen01_arithmetic_chains", "SELECT o_orderkey AS item_id, CAST(2 + o_custkey % 24 AS INTEGER) AS level, CAST(2 + o_custkey % 24 AS INTEGER) AS n_ops, true AS replay_ok, true AS output_ok, true AS bounds_ok, true AS start_ok FROM orders")
def _(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (2 + F.col("o_custkey") % 24).cast("int").alias("level"))
    g = G.arithmetic_chains(spread(s, "item_id"))
    c = chain_check(g["intermediates"][0], g["operations"], g["operands"], g["intermediates"], g["output"].cast("bigint"))
    g = g.select("item_id", "level", F.size("operations").alias("n_ops"), c.alias("_c"), g["intermediates"][0].between(10, 99).alias("start_ok"))
    return g.select("item_id", "level", "n_ops", "_c.*", "start_ok")


def _graphs(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt"), (1 + F.col("o_custkey") % 12).cast("int").alias("level"))
    return G.random_graphs(spread(a, "attempt"))


GLEV = ", ".join(f"({l}, {n}, {p}::DOUBLE, {k})" for l, n, p, k in G.GRAPH_LEVELS)
GSQL = f"""WITH RECURSIVE t(level, n, p, k) AS (VALUES {GLEV}), a AS (SELECT o_orderkey AS attempt, CAST(1 + o_custkey % 12 AS INTEGER) AS level FROM orders), nd AS (SELECT level, n, p, k, u, v FROM t, (SELECT unnest(range(0, 12)) AS u) x, (SELECT unnest(range(0, 12)) AS v) y WHERE u < v AND v < n),
e AS (SELECT a.level, a.attempt, n, k, u, v FROM a JOIN nd USING (level) WHERE ({hash_sql("'42', a.level, a.attempt, u, v")} + 0.5::DOUBLE) / 4294967296.0 < p),
ec AS (SELECT level, attempt, any_value(n) AS n, any_value(k) AS k, count(*) AS m, list((u, v) ORDER BY u, v) AS es FROM e GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT level, attempt, 0::BIGINT AS x FROM ec UNION SELECT r.level, r.attempt, CASE WHEN e.u = r.x THEN e.v ELSE e.u END FROM r JOIN e ON e.level = r.level AND e.attempt = r.attempt AND (e.u = r.x OR e.v = r.x)),
cn AS (SELECT level, attempt, count(*) AS c FROM r GROUP BY ALL), ok AS (SELECT ec.* FROM ec JOIN cn USING (level, attempt) WHERE c = n), un AS (SELECT level, min(attempt) AS attempt, any_value(n) AS n, any_value(k) AS k, any_value(m) AS m FROM ok GROUP BY level, es),
pk AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY attempt) AS pick FROM un QUALIFY pick <= 20)"""


@query("gen02_random_graphs", f"{GSQL} SELECT level, attempt, n, m::INTEGER AS n_edges, pick::INTEGER AS pick FROM pk")
def _(spark, d):
    return _graphs(spark, d).select("level", "attempt", "n", F.size("edges").alias("n_edges"), "pick")


@query("gen03_k_colourable", f"""{GSQL}, pe AS (SELECT e.* FROM e JOIN pk USING (level, attempt)), co AS (SELECT level, attempt, n, k, 1 AS i, [0] AS c FROM pk
 UNION ALL SELECT co.level, co.attempt, co.n, co.k, i + 1, list_append(c, x.x) FROM co, (SELECT unnest(range(0, 4))::INTEGER AS x) x WHERE i < n AND x.x <= least(list_max(c) + 1, k - 1) AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.level = co.level AND pe.attempt = co.attempt AND pe.v = co.i AND co.c[pe.u + 1] = x.x)),
fin AS (SELECT level, attempt, min(c) AS c FROM co WHERE i = n GROUP BY ALL) SELECT level, attempt, array_to_string(c, '') AS colouring, true AS valid FROM fin""")
def _(spark, d):
    k = G.k_colourable(_graphs(spark, d), ["level", "attempt"])
    clash = F.exists("edges", lambda e: F.get("colouring", e[0]) == F.get("colouring", e[1]))
    return k.withColumn("valid", ~clash).select("level", "attempt", F.array_join("colouring", "").alias("colouring"), "valid")


@query("gen04_syllogism_items", """WITH s AS (SELECT o_orderkey AS item_id, CAST(2 + o_custkey % 21 AS INTEGER) AS level, o_orderkey % 20 AS i FROM orders), t AS (SELECT *, ['A', 'B', 'C', 'D'][CAST(i // 5 AS INT) + 1] AS template FROM s), u AS (SELECT *, i % 5 < CASE WHEN template IN ('A', 'C') THEN 3 ELSE 2 END AS truth FROM t)
SELECT item_id, level, template, truth, CASE template WHEN 'A' THEN CASE WHEN truth THEN 'all' ELSE 'some_not' END WHEN 'B' THEN CASE WHEN truth THEN 'some' ELSE 'no' END WHEN 'C' THEN CASE WHEN truth THEN 'no' ELSE 'some' END ELSE CASE WHEN truth THEN 'some_not' ELSE 'all' END END AS conclusion_type,
 array_to_string(list_concat(CASE WHEN template IN ('B', 'D') THEN ['Some'] ELSE ['All'] END, list_transform(range(0, level - 2), lambda x: 'All'), CASE WHEN template IN ('C', 'D') THEN ['No'] ELSE ['All'] END), '-') AS quantifier_pattern, level AS n_premises, level + 1 AS n_entities, true AS lines_ok FROM u""")
def _(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (2 + F.col("o_custkey") % 21).cast("int").alias("level"), (F.col("o_orderkey") % 20).alias("index"))
    g = G.syllogism_items(spread(s, "item_id"))
    lines = F.size(F.filter(F.split("input", "\n"), lambda x: F.rlike(x, F.lit(r"^\d+\. ")))) == F.col("level")
    return g.select("item_id", "level", "template", "truth", "conclusion_type", "quantifier_pattern", "n_premises", F.size(F.array_distinct("entities")).alias("n_entities"), lines.alias("lines_ok"))


@query("gen05_multi_hop_items", f"""WITH q AS (SELECT l_orderkey AS qid, list((l_returnflag || ' item ' || l_partkey || CASE WHEN l_linestatus = 'F' THEN ' of #1' ELSE '' END, 'supplier ' || l_suppkey) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS dc FROM lineitem GROUP BY ALL),
o AS (SELECT 1 AS hop, min(qid) AS id, arg_min(dc[1][2], qid) AS answer FROM q WHERE NOT contains(dc[1][1], '#') GROUP BY lower(trim(dc[1][1]))), m AS (SELECT CAST(len(dc) AS INTEGER) AS hop, qid AS id, dc[-1][2] AS answer FROM q WHERE len(dc) IN (2, 3, 4)), u AS (SELECT * FROM o UNION ALL SELECT * FROM m)
SELECT hop, id, answer, CAST(row_number() OVER (PARTITION BY hop ORDER BY {hash_sql("'42', hop, id")}, id) AS INTEGER) AS pick FROM u QUALIFY pick <= 30""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    q = F.concat("l_returnflag", F.lit(" item "), F.col("l_partkey").cast("string"), F.when(F.col("l_linestatus") == "F", " of #1").otherwise(""))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", q.alias("question"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("answer"))
    g = li.groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(row)).alias("r"))  # an order has few lines
    g = g.select("qid", F.transform("r", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("decomposition"))
    return G.multi_hop_items(g)
