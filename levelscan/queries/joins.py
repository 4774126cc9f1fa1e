"""JN: joins."""

from pyspark.sql import functions as F

from levelscan.operators import joins as J
from levelscan.operators.windows import critical_level
from levelscan.queries.aggregates import PAIRS
from levelscan.queries.bindings import ALL_LV, EV, LV, LVM, ev_rows, levels, line_rows
from levelscan.queries.registry import query, rounded, table

K = ["task", "model", "level"]


@query("jn01_attach_baseline", f"""WITH {LV}, b AS (SELECT task, model, level, avg(x) AS spuq FROM ev WHERE x > 200 GROUP BY ALL), j AS (SELECT lv.task, lv.model, lv.level, b.spuq FROM lv LEFT JOIN b USING (task, model, level))
SELECT task, model, level, round(coalesce(spuq, (SELECT quantile_cont(spuq, 0.5::DOUBLE) FROM j), 0.5), 6) + 0.0 AS spuq FROM j""")
def _(spark, d):
    base = ev_rows(spark, d).where("x > 200").groupBy(*K).agg(F.avg("x").alias("spuq"))
    return rounded(J.attach_baseline(levels(spark, d).select(*K), base, ["spuq"]), "spuq")


@query("jn02_attach_d_star", f"WITH {LV} SELECT task, model, level, d_star FROM lvd")
def _(spark, d):
    lv = levels(spark, d)
    return J.attach_d_star(lv, critical_level(lv)).select(*K, "d_star")


@query("jn03_score", """SELECT l_linenumber AS level, count(*) AS n, count(*) FILTER (WHERE l_linestatus = o_orderstatus) AS n_correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("level"), F.col("l_linestatus").alias("answer"))
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("truth"))
    return J.score(r, i, ["item_id"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"))


GRAPH = """col AS (SELECT l_orderkey AS g, l_linenumber AS node, min(l_returnflag) AS colour FROM lineitem GROUP BY ALL),
edg AS (SELECT g, node AS u, node % 7 + 1 AS v FROM col)"""


def _graph(spark, d):
    col = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("node")).agg(F.min("l_returnflag").alias("colour"))
    return col.select("g", F.col("node").alias("u"), (F.col("node") % 7 + 1).alias("v")), col


@query("jn04_violated_edges", f"""WITH {GRAPH}, e AS (SELECT edg.*, a.colour AS ca, b.colour AS cb FROM edg LEFT JOIN col a ON a.g = edg.g AND a.node = u LEFT JOIN col b ON b.g = edg.g AND b.node = v)
SELECT g, count(*) AS n_edges, count(*) FILTER (WHERE ca = cb) AS n_violated, bool_and(ca IS NOT NULL AND cb IS NOT NULL AND ca <> cb) AS valid, count(*) FILTER (WHERE ca = cb) = 0 AS valid_lenient FROM e GROUP BY ALL""")
def _(spark, d):
    e, c = _graph(spark, d)
    return J.check_colouring(e, c, "g").withColumn("valid_lenient", F.col("n_violated") == 0)


CHAIN = """f AS (SELECT o_orderkey AS fact_id, o_custkey % 10 AS source, CAST(o_custkey AS VARCHAR) AS entity, CAST((o_custkey * 7 + o_orderkey) % 1000 AS VARCHAR) AS answer FROM orders),
c1 AS (SELECT fact_id AS chain_id, answer, [fact_id] AS path, [source] AS used FROM f),
c2 AS (SELECT c.chain_id, f.answer, list_append(c.path, f.fact_id) AS path, list_append(c.used, f.source) AS used FROM c1 c JOIN f ON f.entity = c.answer AND NOT list_contains(c.used, f.source) QUALIFY row_number() OVER (PARTITION BY c.chain_id ORDER BY f.fact_id) = 1),
c3 AS (SELECT c.chain_id, f.answer, list_append(c.path, f.fact_id) AS path FROM c2 c JOIN f ON f.entity = c.answer AND NOT list_contains(c.used, f.source) QUALIFY row_number() OVER (PARTITION BY c.chain_id ORDER BY f.fact_id) = 1)"""


def _facts(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") % 10).alias("source"), F.col("o_custkey").cast("string").alias("entity"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1000).cast("string").alias("answer"))


@query("jn05_extend_chains", f"WITH {CHAIN} SELECT chain_id, answer, path[2] AS hop2, path[3] AS hop3 FROM c3")
def _(spark, d):
    f = _facts(spark, d)
    c = f.select(F.col("fact_id").alias("chain_id"), "source", "answer", F.array("fact_id").alias("path"), F.array("source").alias("used"))
    c = J.extend_chains(J.extend_chains(c, f, excluded=2), f, excluded=2)
    return c.select("chain_id", "answer", F.col("path")[1].alias("hop2"), F.col("path")[2].alias("hop3"))


@query("jn06_nearest_level", f"""WITH {EV}, q AS (SELECT 'events' AS task, event_type AS model, event_id AS qid, CAST(floor(value / 8) AS INTEGER) * 3 AS v FROM events), l AS (SELECT DISTINCT task, model, CAST(level // 4 * 4 + 1 AS INTEGER) AS level FROM ev)
SELECT q.qid, q.v, l.level AS nearest_level FROM q JOIN l USING (task, model) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY abs(l.level - q.v), l.level) = 1""")
def _(spark, d):
    e = ev_rows(spark, d)
    q = e.select("task", "model", F.col("item_id").alias("qid"), (F.floor(F.col("x") / 8).cast("int") * 3).alias("v"))
    lv = e.select("task", "model", (F.floor(F.col("level") / 4) * 4 + 1).cast("int").alias("level")).distinct()
    return J.nearest_level(q, lv, "v", ["task", "model"]).select("qid", "v", "nearest_level")


@query("jn07_within_group_pairs", f"WITH {PAIRS} SELECT label, count(*) AS n_pairs, round(avg(dist), 6) + 0.0 AS mean_cosine_distance, round(stddev_pop(dist), 6) + 0.0 AS std_cosine_distance FROM p GROUP BY ALL")
def _(spark, d):
    return rounded(J.within_group_pairs(table(spark, d, "embeddings"), ["label"], "embedding"), "mean_cosine_distance", "std_cosine_distance")


@query("jn08_tolerance_match", """WITH c AS (SELECT s_suppkey AS claim_id, 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, round(s_acctbal) AS value, 0.1 AS tol FROM supplier),
s AS (SELECT CASE WHEN s_nationkey < 15 THEN '' ELSE 'total_' END || 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, s_acctbal AS sv FROM supplier WHERE s_nationkey < 20),
j AS (SELECT c.*, coalesce((SELECT sv FROM s WHERE s.key = c.key), (SELECT arg_min(sv, s.key) FROM s WHERE contains(s.key, c.key))) AS source_value FROM c)
SELECT claim_id, key, value, source_value, round(abs(value - source_value), 6) + 0.0 AS delta, CASE WHEN source_value IS NULL THEN 'UNSOURCED' WHEN abs(value - source_value) <= tol THEN 'VERIFIED' WHEN abs(value - source_value) <= tol * 3 THEN 'ROUNDING' WHEN abs(value - source_value) > 0.05 THEN 'CRITICAL' ELSE 'MINOR' END AS status FROM j""")
def _(spark, d):
    s = table(spark, d, "supplier")
    key = F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    c = s.select(F.col("s_suppkey").alias("claim_id"), key.alias("key"), F.round("s_acctbal").alias("value"), F.lit(0.1).alias("tol"))
    src = s.where("s_nationkey < 20").select(F.concat(F.when(F.col("s_nationkey") < 15, "").otherwise("total_"), key).alias("key"), F.col("s_acctbal").alias("source_value"))
    return rounded(J.tolerance_match(c, src), "delta")


W_SQL = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) = 9))"
CITES = f"""c AS (SELECT DISTINCT doc_id, unnest({W_SQL}) AS key FROM documents), r AS (SELECT DISTINCT unnest({W_SQL}) AS key FROM conversations)"""


def _cites(col="text"):
    return F.array_distinct(F.filter(F.split(F.lower(col), "[^a-z]+"), lambda x: F.length(x) == 9))


@query("jn09a_unresolved_keys", f"WITH {CITES} SELECT key, count(*) AS n_docs FROM c ANTI JOIN r USING (key) GROUP BY ALL")
def _(spark, d):
    refs = table(spark, d, "conversations").select(F.explode(_cites()).alias("key"))
    return J.unresolved_keys(table(spark, d, "documents"), refs, _cites(), "doc_id")


@query("jn09b_resolved_count", f"WITH {CITES} SELECT count(DISTINCT key) AS n_keys, count(DISTINCT key) FILTER (WHERE key IN (SELECT key FROM r)) AS n_resolved FROM c")
def _(spark, d):
    refs = table(spark, d, "conversations").select(F.explode(_cites()).alias("key"))
    return J.resolved_count(table(spark, d, "documents"), refs, _cites())


@query("jn10_grid_cross", f"""WITH {LVM}, g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS cut) SELECT model, cut, count(*) FILTER (WHERE silhouette_k2 >= cut) AS n_hit FROM lv, g GROUP BY ALL""")
def _(spark, d):
    g = J.grid_cross(levels(spark, d, True).select("model", "silhouette_k2"), cut=[0.1, 0.2, 0.3, 0.4])
    return g.groupBy("model", "cut").agg(F.sum((F.col("silhouette_k2") >= F.col("cut")).cast("long")).alias("n_hit"))


@query("jn11_common_levels", f"WITH {ALL_LV} SELECT DISTINCT level FROM lv WHERE task = 'lineitem' AND level IN (SELECT level FROM lv WHERE task = 'events')")
def _(spark, d):
    return J.common_levels(line_rows(spark, d), ev_rows(spark, d))


@query("jn12_model_task_matrix", f"""WITH t AS (SELECT DISTINCT l_returnflag AS model, l_linestatus AS task FROM lineitem UNION SELECT DISTINCT o_orderstatus, 'orders' FROM orders UNION SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)
SELECT model, count(*) AS n_tasks FROM t GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task")).unionByName(
        o.select(F.col("o_orderstatus").alias("model"), F.lit("orders").alias("task"))).unionByName(
        o.select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("task")))
    return J.model_task_matrix(rows)
