"""IND: distribution indicators of vector groups (embeddings, grouped by label)."""

from pyspark.sql import functions as F

from levelscan.functions.special import dip_sf_sql, erfc_sql
from levelscan.operators import indicators as I
from levelscan.queries.bindings import EV, LV, dip_sql, ev_rows, levels
from levelscan.queries.registry import query, r6, rounded, table


def emb(spark, d):
    return table(spark, d, "embeddings")


U = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
# first component by power iteration on each group's covariance
PC = f"""{U}, ix AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), mu AS (SELECT label, i, avg(x) AS m FROM ix GROUP BY ALL),
ce AS (SELECT ix.label, vec_id, ix.i, x - m AS x FROM ix JOIN mu ON mu.label = ix.label AND mu.i = ix.i), nn AS (SELECT label, count(*) AS n FROM u GROUP BY ALL),
cv AS (SELECT a.label, a.i, b.i AS j, sum(a.x * b.x) AS c FROM ce a JOIN ce b ON a.label = b.label AND a.vec_id = b.vec_id GROUP BY ALL),
cr AS (SELECT label, i, list(c / (n - 1) ORDER BY j) AS r FROM cv JOIN nn USING (label) GROUP BY ALL), cm AS (SELECT label, list(r ORDER BY i) AS m, sum(r[i]) AS tr FROM cr GROUP BY ALL),
pw AS (WITH RECURSIVE p AS (SELECT label, 0 AS k, list_transform(m, lambda r: 1.0::DOUBLE + r[1]) AS w FROM cm
 UNION ALL SELECT p.label, k + 1, list_transform(z, lambda x: x / sqrt(list_inner_product(z, z))) FROM (SELECT p.label, p.k, list_transform(cm.m, lambda r: list_inner_product(r, p.w)) AS z FROM p JOIN cm ON cm.label = p.label WHERE p.k < 4000) p) SELECT label, w FROM p WHERE k = 4000),
ax AS (SELECT pw.label, list_transform(w, lambda x: x * CASE WHEN w[list_position(list_transform(w, lambda y: abs(y)), list_max(list_transform(w, lambda y: abs(y))))] > 0 THEN 1 ELSE -1 END) AS a, list_inner_product(w, list_transform(m, lambda r: list_inner_product(r, w))) AS l1, tr FROM pw JOIN cm USING (label)),
mv AS (SELECT label, list(m ORDER BY i) AS m FROM mu GROUP BY ALL), sc AS (SELECT u.label, u.vec_id, list_inner_product(u.v, a) - list_inner_product(mv.m, a) AS pc1 FROM u JOIN ax ON ax.label = u.label JOIN mv ON mv.label = u.label)"""


@query("ind01_pc1_scores", f"WITH {PC} SELECT label, vec_id, round(pc1, 4) + 0.0 AS pc1 FROM sc")
def _(spark, d):
    return I.pc1_scores(emb(spark, d), ["label"], "embedding").select("label", "vec_id", r6("pc1", 4).alias("pc1"))


@query("ind02_pc1_variance", f"WITH {PC} SELECT ax.label, round(l1 * (n - 1) / n, 6) + 0.0 AS pc1_variance, round(l1 / tr, 6) + 0.0 AS pc1_variance_explained FROM ax JOIN nn ON nn.label = ax.label")
def _(spark, d):
    return rounded(I.pc1_variance(I.principal_axes(emb(spark, d), ["label"], "embedding"), ["label"]), "pc1_variance", "pc1_variance_explained")


@query("ind03_bimodality_coefficient", """WITH m AS (SELECT l_returnflag AS g, l_linenumber AS k, avg(l_extendedprice) AS mu FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag AS g, l_linenumber AS k, l_extendedprice - mu AS c FROM lineitem JOIN m ON g = l_returnflag AND k = l_linenumber),
s AS (SELECT g, k, count(*) AS n, avg(power(c, 3)) / power(avg(c * c), 1.5) AS sk, avg(power(c, 4)) / power(avg(c * c), 2) - 3 AS ku FROM t GROUP BY ALL) SELECT g, k, round((sk * sk + 1) / (ku + 3.0 * power(n - 1, 2) / ((n - 2.0) * (n - 3.0))), 6) + 0.0 AS bimodality_coefficient FROM s""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("k"), "l_extendedprice")
    return rounded(I.bimodality_coefficient(li, ["g", "k"], "l_extendedprice"), "bimodality_coefficient")


def _first_split():
    from pyspark.sql import Window as W
    return (F.col("embedding")[0].cast("double") > F.avg(F.col("embedding")[0].cast("double")).over(W.partitionBy("label"))).cast("int")


def _lloyd_sql(rounds=25):
    parts = [f"{U}, k0 AS (SELECT label, vec_id, v, CAST(v[1] > avg(v[1]) OVER (PARTITION BY label) AS INT) AS c FROM u)"]
    for r in range(1, rounds + 1):
        parts.append(f"""x{r} AS MATERIALIZED (SELECT label, c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k{r-1}), a{r} AS (SELECT label, c, i, avg(x) AS m FROM x{r} GROUP BY ALL), l{r} AS (SELECT label, c, list(m ORDER BY i) AS m FROM a{r} GROUP BY ALL),
 w{r} AS (SELECT label, coalesce(max(m) FILTER (WHERE c = 0), max(m) FILTER (WHERE c = 1)) AS c0, coalesce(max(m) FILTER (WHERE c = 1), max(m) FILTER (WHERE c = 0)) AS c1 FROM l{r} GROUP BY ALL),
 k{r} AS MATERIALIZED (SELECT k.label, k.vec_id, k.v, CAST(list_distance(v, c1) < list_distance(v, c0) AS INTEGER) AS c FROM k{r-1} k JOIN w{r} USING (label))""")
    return ", ".join(parts) + f", km AS (SELECT label, vec_id, v, c AS cluster FROM k{rounds})"


@query("ind04_kmeans2", f"WITH {_lloyd_sql()} SELECT label, vec_id, cluster FROM km")
def _(spark, d):
    return I.kmeans2(emb(spark, d), ["label"], "embedding", start=_first_split()).select("label", "vec_id", "cluster")


def _sil_sql(dist):
    return f"""{U}, c AS (SELECT label, vec_id, v, CAST(v[1] > avg(v[1]) OVER (PARTITION BY label) AS INT) AS c FROM u), dd AS (SELECT a.label, a.vec_id, a.c, b.c AS o, sum({dist}) AS t, count(*) AS n FROM c a JOIN c b ON a.label = b.label GROUP BY ALL),
w AS (SELECT label, vec_id, sum(t) FILTER (WHERE c = o) / (sum(n) FILTER (WHERE c = o) - 1) AS a, sum(t) FILTER (WHERE c <> o) / sum(n) FILTER (WHERE c <> o) AS b, sum(n) FILTER (WHERE c = o) AS own, sum(n) FILTER (WHERE c <> o) AS oth FROM dd GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN oth IS NULL OR own <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) + 0.0 AS silhouette_k2 FROM w GROUP BY ALL"""


@query("ind05a_silhouette_k2", f"WITH {_sil_sql('list_distance(a.v, b.v)')}")
def _(spark, d):
    e = emb(spark, d).withColumn("cluster", _first_split())
    return rounded(I.silhouette_k2(e, ["label"], "vec_id", "embedding"), "silhouette_k2")


@query("ind05b_silhouette_squared", f"WITH {_sil_sql('power(list_distance(a.v, b.v), 2)')}")
def _(spark, d):
    e = emb(spark, d).withColumn("cluster", _first_split())
    return rounded(I.silhouette_squared(e, ["label"], "embedding"), "silhouette_k2")


@query("ind06_dip", f"WITH {EV}, {dip_sql('ev', 'model, level', 'x', 11)} SELECT model, level, n, round(dip_statistic, 6) + 0.0 AS dip_statistic, round({dip_sf_sql('dip_statistic', 'n')}, 6) + 0.0 AS dip_pvalue FROM dip")
def _(spark, d):
    e = ev_rows(spark, d)
    dips = I.dip_statistic(e, ["model", "level"], "x")
    return rounded(I.dip_pvalue(dips, ["model", "level"]), "dip_statistic", "dip_pvalue")


@query("ind07_ashman_labels", f"WITH {LV} SELECT model, level, round(ashman_d, 6) + 0.0 AS ashman_d FROM lv")
def _(spark, d):
    return levels(spark, d).select("model", "level", r6("ashman_d").alias("ashman_d"))


def _em_sql(rounds):
    m = """SELECT model, sum(w) AS n, sum(w * r) AS n1, sum(w * x) AS sx, sum(w * r * x) AS sx1, sum(w * x * x) AS sq, sum(w * r * x * x) AS sq1 FROM {s} GROUP BY ALL"""
    p = """SELECT model, (sx - sx1) / (n - n1) AS mu0, sx1 / n1 AS mu1, greatest((sq - sq1) / (n - n1) - power((sx - sx1) / (n - n1), 2), 0) + 1e-6::DOUBLE AS var0, greatest(sq1 / n1 - power(sx1 / n1, 2), 0) + 1e-6::DOUBLE AS var1, (n - n1) / n AS pi0, n1 / n AS pi1 FROM {s}"""
    parts = [f"""b AS (SELECT model, x, count(*)::DOUBLE AS w FROM ev GROUP BY ALL), mu AS (SELECT model, sum(x * w) / sum(w) AS m FROM b GROUP BY ALL), r0 AS (SELECT b.model, x, w, CAST(x > m AS INT)::DOUBLE AS r FROM b JOIN mu USING (model)), m0 AS ({m.format(s='r0')}), p0 AS MATERIALIZED ({p.format(s='m0')})"""]
    for i in range(1, rounds + 1):
        e = "ln(pi{k}) - 0.5 * ln(var{k}) - power(x - mu{k}, 2) / (2 * var{k})"
        parts.append(f"r{i} AS (SELECT b.model, x, w, 1.0 / (1.0 + exp(least(({e.format(k=0)}) - ({e.format(k=1)}), 700))) AS r FROM b JOIN p{i-1} USING (model)), m{i} AS ({m.format(s=f'r{i}')}), p{i} AS MATERIALIZED ({p.format(s=f'm{i}')})")
    return ", ".join(parts) + f" SELECT model, round(mu0, 4) + 0.0 AS mu0, round(mu1, 4) + 0.0 AS mu1, round(pi1, 4) + 0.0 AS pi1, round(sqrt(2.0) * abs(mu0 - mu1) / sqrt(var0 + var1), 4) + 0.0 AS ashman_d FROM p{rounds}"


@query("ind08_ashman_mixture", f"WITH {EV}, {_em_sql(20)}")
def _(spark, d):
    return rounded(I.ashman_mixture(ev_rows(spark, d), ["model"], "x", rounds=20), "mu0", "mu1", "pi1", "ashman_d", digits=4)


@query("ind09_indicator_battery")
def _(spark, d):
    e = emb(spark, d).withColumn("correct", F.col("embedding")[1] > 0).withColumn("answer", F.floor(F.col("embedding")[2] * 4))
    b = I.indicator_battery(e, ["label"], "vec_id", "embedding", "correct", "answer")
    return rounded(b, *[c for c in b.columns if c not in ("label", "n")])


@query("ind10_null_distribution")
def _(spark, d):
    return rounded(I.null_distribution(emb(spark, d).select("label", "vec_id"), ["label"], "vec_id", dim=16, b=5), "dip_proxy_q", "silhouette_q")


@query("ind10b_normal_distance", f"""WITH {EV}, f AS (SELECT model, avg(x) AS m, stddev_pop(x) AS s FROM ev GROUP BY ALL), c AS (SELECT model, x, count(*) AS k FROM ev GROUP BY ALL), q AS (SELECT c.model, sum(k) OVER w AS cu, k, sum(k) OVER (PARTITION BY c.model) AS n, (x - m) / s AS z FROM c JOIN f USING (model) WINDOW w AS (PARTITION BY c.model ORDER BY x)),
g AS (SELECT *, CASE WHEN z >= 0 THEN 1 - {erfc_sql('abs(z) / sqrt(2.0)')} / 2 ELSE {erfc_sql('abs(z) / sqrt(2.0)')} / 2 END AS p FROM q) SELECT model, round(max(greatest(cu / n - p, p - (cu - k) / n)) / 2, 6) + 0.0 AS ks_half FROM g GROUP BY ALL""")
def _(spark, d):
    return rounded(I.normal_distance(ev_rows(spark, d), ["model"], "x"), "ks_half")


@query("ind11_pca2")
def _(spark, d):
    return rounded(I.pca2(emb(spark, d), "embedding", "vec_id"), "pc1", "pc2")
