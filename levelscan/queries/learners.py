"""ML: feature tables, folds, metrics and models."""

from pyspark.sql import functions as F

from levelscan.functions import predicates as P
from levelscan.operators import learners as L
from levelscan.queries.bindings import ALL_LV, LV, all_levels, levels, with_d_star
from levelscan.queries.registry import query, r6, rounded, table
from levelscan.queries.statistics import unpivot_sql

K = ["task", "model", "level"]
PW = "PARTITION BY task, model ORDER BY level"
SETS = L.feature_sets(("variance", "disagreement_rate"))


def labelled(spark, d, every=False):
    lv = with_d_star(all_levels(spark, d) if every else levels(spark, d))
    return lv.where(F.col("d_star").isNotNull()).withColumn("label", P.label_near("level", "d_star"))


LAB = "lb AS (SELECT *, CAST(level >= d_star - 2 AS INTEGER) AS label FROM lvd WHERE d_star IS NOT NULL)"
ML1 = ["variance__z", "variance__delta", "variance__slope", "variance__pct", "variance__runz", "variance__base", "variance__max", "rel_level", "rel_distance"]


@query("ml01_feature_sets", f"""WITH {ALL_LV}, {LAB}, f AS (SELECT task, model, level, label, (variance - avg(variance) OVER t) / (stddev_samp(variance) OVER t + 1e-8) AS variance__z, coalesce(variance - lag(variance) OVER s, 0) AS variance__delta, CASE WHEN count(*) OVER l3 < 2 THEN 0.0 ELSE regr_slope(variance, o) OVER l3 END AS variance__slope,
 (rank() OVER (PARTITION BY task, model ORDER BY variance) + (count(*) OVER (PARTITION BY task, model, variance) - 1) / 2.0) / count(*) OVER p AS variance__pct, CASE WHEN stddev_pop(variance) OVER c < 1e-12 THEN 0.0 ELSE (variance - avg(variance) OVER c) / stddev_pop(variance) OVER c END AS variance__runz,
 variance / (abs(first(variance) OVER s) + 1e-8) AS variance__base, variance / (abs(max(variance) OVER p) + 1e-8) AS variance__max, (level - min(level) OVER t) / greatest(max(level) OVER t - min(level) OVER t, 1) AS rel_level, (d_star - level) / greatest(d_star - min(level) OVER t, 1) AS rel_distance
 FROM (SELECT *, row_number() OVER ({PW}) AS o FROM lb) WINDOW t AS (PARTITION BY task), s AS ({PW}), p AS (PARTITION BY task, model), c AS ({PW} ROWS UNBOUNDED PRECEDING), l3 AS ({PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT task, model, level, label, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ML1)} FROM f""")
def _(spark, d):
    return rounded(L.feature_table(labelled(spark, d, True), ("variance",)).select(*K, "label", *ML1), *ML1)


def _fold_sql(keys, name):
    return f"SELECT '{name}' AS scheme, concat_ws('__', {keys}) AS fold, count(*) AS n_test, sum(label)::BIGINT AS test_pos, (SELECT count(*) FROM lb) - count(*) AS n_train, ((SELECT sum(label) FROM lb) - sum(label))::BIGINT AS train_pos FROM lb GROUP BY {keys}"


@query("ml02_group_folds", f"""WITH {ALL_LV}, {LAB}, f AS ({_fold_sql('task, model', 'pair')} UNION ALL {_fold_sql('task', 'task')} UNION ALL {_fold_sql('model', 'model')})
SELECT *, n_train >= 5 AND n_test >= 2 AND train_pos > 0 AND train_pos < n_train AS usable FROM f""")
def _(spark, d):
    lb = labelled(spark, d, True)
    out = None
    for s in ("pair", "task", "model"):
        f = L.group_folds(lb, s).withColumn("scheme", F.lit(s))
        out = f if out is None else out.unionByName(f)
    return out


FOLD_SQL = {"pair": "concat_ws('__', task, model)", "task": "task", "model": "model"}


def newton_sql(src, variants, schemes, label="label", rep="''", balanced=True, rounds=10, min_test=2):
    """CTEs up to ``pd``: held-out (rep, variant, scheme, fold, rid, y, p) of penalised logistic regressions by Newton's method.

    ``src`` names a CTE with the features; ``variants`` map to (features, C); ``schemes`` map to fold expressions, None for no fold.
    Training sets are listed row by row; each round sums the normal equations and eliminates one column after the other.
    """
    feats = sorted({f for fs, _ in variants.values() for f in fs})
    most = max(len(fs) for fs, _ in variants.values()) + 1
    ctes = [
        f"rw AS MATERIALIZED (SELECT row_number() OVER () AS rid, {rep} AS rep, {label}::DOUBLE AS y, * FROM {src} WHERE {label} IS NOT NULL)",
        "sc AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT rid, rep, y, '{n}' AS scheme, {e or chr(39) * 2} AS own, {'false' if e else 'true'} AS whole FROM rw" for n, e in schemes.items()) + ")",
        f"fo AS MATERIALIZED (SELECT f.rep, f.scheme, f.fold, f.whole, count(*)::DOUBLE AS n, sum(s.y) AS pos FROM (SELECT rep, scheme, own AS fold, whole FROM sc GROUP BY ALL HAVING count(*) >= {min_test}) f JOIN sc s ON s.rep = f.rep AND s.scheme = f.scheme AND (f.whole OR s.own <> f.fold) GROUP BY ALL HAVING count(*) >= 5 AND sum(s.y) > 0 AND sum(s.y) < count(*))",
        "fx AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT rid, '{f}' AS feature, coalesce({f}, 0)::DOUBLE AS v FROM rw" for f in feats) + ")",
        "st AS MATERIALIZED (SELECT f.rep, f.scheme, f.fold, feature, avg(v) AS mean, CASE WHEN stddev_pop(v) > 1e-9 * (1 + abs(avg(v))) THEN stddev_pop(v) ELSE 1.0 END AS sd FROM fo f JOIN sc s ON s.rep = f.rep AND s.scheme = f.scheme AND (f.whole OR s.own <> f.fold) JOIN fx ON fx.rid = s.rid GROUP BY ALL)",
        "vr AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', {i})" for n, (fs, _) in variants.items() for i, f in enumerate(fs)) + ") t(variant, feature, i))",
        "vc AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}::DOUBLE, {len(fs) + 1})" for n, (fs, c) in variants.items()) + ") t(variant, c, d))",
        f"zr AS MATERIALIZED (SELECT f.rep, vr.variant, f.scheme, f.fold, s.rid, s.y, f.whole OR s.own <> f.fold AS train, {'CASE WHEN s.y = 1 THEN f.n / (2 * f.pos) ELSE f.n / (2 * (f.n - f.pos)) END' if balanced else '1.0'} AS w, [1.0] || list((fx.v - st.mean) / st.sd ORDER BY vr.i) AS z FROM fo f JOIN sc s ON s.rep = f.rep AND s.scheme = f.scheme JOIN st ON st.rep = f.rep AND st.scheme = f.scheme AND st.fold = f.fold JOIN vr ON vr.feature = st.feature JOIN fx ON fx.rid = s.rid AND fx.feature = vr.feature GROUP BY ALL)".replace(" GROUP BY ALL)", " GROUP BY f.rep, vr.variant, f.scheme, f.fold, s.rid, s.y, f.whole, s.own, f.n, f.pos)"),
        "b0 AS MATERIALIZED (SELECT rep, variant, scheme, fold, list_transform(range(0, d), lambda i: 0.0::DOUBLE) AS b FROM (SELECT DISTINCT rep, variant, scheme, fold FROM zr) JOIN vc USING (variant))",
        f"ij AS (SELECT i, j FROM range(1, {most + 1}) a(i), range(0, {most + 1}) q(j))",
    ]
    m = "rep, variant, scheme, fold"
    for r in range(rounds):
        ctes.append(f"p{r} AS MATERIALIZED (SELECT {m}, y, w, z, b, 1 / (1 + exp(-list_dot_product(z, b))) AS p FROM zr JOIN b{r} USING ({m}) WHERE train)")
        ctes.append(f"a{r}_0 AS MATERIALIZED (SELECT {m}, i, j, any_value(c) * sum(CASE WHEN j = 0 THEN w * (p - y) * z[i] ELSE w * p * (1 - p) * z[i] * z[j] END) + CASE WHEN i = 1 THEN 0 WHEN j = 0 THEN any_value(b[i]) WHEN i = j THEN 1 ELSE 0 END AS v FROM p{r} JOIN vc USING (variant) JOIN ij ON i <= d AND j <= d GROUP BY {m}, i, j)")
        for k in range(1, most + 1):
            row, col, pivot = (f"max(CASE WHEN {c} THEN v END) OVER (PARTITION BY {m}{extra})" for c, extra in ((f"j = {k}", ", i"), (f"i = {k}", ", j"), (f"i = {k} AND j = {k}", "")))
            ctes.append(f"a{r}_{k} AS MATERIALIZED (SELECT {m}, i, j, CASE WHEN pv IS NULL THEN v WHEN i = {k} THEN v / pv ELSE v - rv * cv / pv END AS v FROM (SELECT *, {row} AS rv, {col} AS cv, {pivot} AS pv FROM a{r}_{k - 1}))")
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT {m}, list(o.b[i] - v ORDER BY i) AS b FROM a{r}_{most} JOIN b{r} o USING ({m}) WHERE j = 0 GROUP BY {m})")
    held = "(NOT train OR (SELECT bool_or(whole) FROM fo f WHERE f.scheme = zr.scheme))"
    ctes.append(f"pd AS MATERIALIZED (SELECT {m}, rid, y::INTEGER AS y, 1 / (1 + exp(-list_dot_product(z, b))) AS p FROM zr JOIN b{rounds} USING ({m}) WHERE {held})")
    return ", ".join(ctes)


def metric_sql(keys, src="pd"):
    """Counts, precision, recall, F1, AUROC and average precision of held-out predictions ``pd``, per key."""
    on = " AND ".join(f"c.{k} = r.{k}" for k in keys)
    k = ", ".join(keys)
    return f"""mc AS (SELECT {k}, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM {src} GROUP BY {k}),
ms AS (SELECT {k}, p, count(*) AS nn, sum(y) AS pp FROM (SELECT {k}, y, round(p, 12) AS p FROM {src}) GROUP BY {k}, p), mw AS (SELECT *, sum(nn) OVER a AS cn, sum(pp) OVER b AS tt, sum(nn) OVER b AS tn, sum(pp) OVER q AS ap, sum(nn) OVER q AS an FROM ms WINDOW q AS (PARTITION BY {k}), a AS (PARTITION BY {k} ORDER BY p), b AS (PARTITION BY {k} ORDER BY p DESC)),
mr AS (SELECT {k}, CASE WHEN max(ap) > 0 AND max(an) > max(ap) THEN (sum((cn - (nn - 1) / 2.0) * pp) - max(ap) * (max(ap) + 1) / 2) / (max(ap) * (max(an) - max(ap))) ELSE 0.5 END AS auroc, CASE WHEN max(ap) > 0 THEN sum(pp * tt / tn) / max(ap) ELSE 0.0 END AS average_precision FROM mw GROUP BY {k}),
mt AS (SELECT c.*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, auroc, average_precision FROM mc c JOIN mr r ON {on})"""


def features_sql(base=("variance", "disagreement_rate")):
    """CTE ``ft``: what L.feature_table makes of ``lb``."""
    pairs = [(i, j) for j in range(5) for i in range(j)]
    lag = lambda c, k: f"lag({c}, {k}) OVER s" if k else c
    def tau(c):
        s = " + ".join(f"coalesce(sign({lag(c, 4 - j)} - {lag(c, 4 - i)}), 0)" for i, j in pairs)
        ties = " + ".join(f"coalesce(({lag(c, 4 - j)} = {lag(c, 4 - i)})::INT, 0)" for i, j in pairs)
        n = " + ".join(f"({lag(c, k)} IS NOT NULL)::INT" for k in range(5))
        return f"CASE WHEN {n} < 3 OR ({n}) * ({n} - 1) / 2 = {ties} THEN 0.0 ELSE ({s}) / sqrt((({n}) * ({n} - 1) / 2) * (({n}) * ({n} - 1) / 2 - ({ties}))) END AS {c}__tau"

    per = ", ".join(f"""{tau(c)}, coalesce({c} - 2 * {lag(c, 1)} + {lag(c, 2)}, 0) AS {c}__accel, ({c} - avg({c}) OVER t) / (stddev_samp({c}) OVER t + 1e-8) AS {c}__z, coalesce({c} - lag({c}) OVER s, 0) AS {c}__delta, CASE WHEN count(*) OVER l3 < 2 THEN 0.0 ELSE regr_slope({c}, o) OVER l3 END AS {c}__slope,
 (rank() OVER (PARTITION BY task, model ORDER BY {c}) + (count(*) OVER (PARTITION BY task, model, {c}) - 1) / 2.0) / count(*) OVER p AS {c}__pct, CASE WHEN stddev_pop({c}) OVER c < 1e-12 THEN 0.0 ELSE ({c} - avg({c}) OVER c) / stddev_pop({c}) OVER c END AS {c}__runz,
 {c} / (abs(first({c}) OVER s) + 1e-8) AS {c}__base, {c} / (abs(max({c}) OVER p) + 1e-8) AS {c}__max""" for c in base)
    return f"""ft AS MATERIALIZED (SELECT *, {per}, (level - min(level) OVER t) / greatest(max(level) OVER t - min(level) OVER t, 1) AS rel_level, (d_star - level) / greatest(d_star - min(level) OVER t, 1) AS rel_distance
 FROM (SELECT *, row_number() OVER ({PW}) AS o FROM lb) WINDOW t AS (PARTITION BY task), s AS ({PW}), p AS (PARTITION BY task, model), c AS ({PW} ROWS UNBOUNDED PRECEDING), l3 AS ({PW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def r_sql(*cols):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def docs(spark, d):
    """Labelled documents: quality against simple text features (a classifier table that grows with the data)."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.length("text")
    return t.select(
        "doc_id", F.col("lang").alias("task"), F.col("source").alias("model"), n.alias("level"), F.col("quality").alias("label"),
        n.cast("double").alias("f_len"), (F.size(F.split("text", " ")) / n).alias("f_words"), (F.size(F.split("text", "\n")) / n).alias("f_lines"))


DOC = """dc AS (SELECT d.doc_id, lang, source, quality AS label, length(text)::DOUBLE AS f_len, len(string_split(text, ' ')) / length(text) AS f_words, len(string_split(text, chr(10))) / length(text) AS f_lines FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
FE = ["f_len", "f_words", "f_lines"]


@query("ml03_fit_predict", f"""WITH {DOC}, {newton_sql('dc', {'all': (FE, 1.0)}, {'split': "CASE WHEN lang = 'en' THEN 'test' ELSE 'train' END"})}
SELECT doc_id, round(p, 4) + 0.0 AS p, (p >= 0.5)::INTEGER AS y_hat, label FROM pd JOIN rw USING (rid) WHERE fold = 'test'""")
def _(spark, d):
    pred = L.fit_predict(docs(spark, d), F.col("task") == "en", FE, carry=["doc_id"])
    return pred.select("doc_id", r6("p", 4).alias("p"), "y_hat", "label")


GRID = (0.01, 0.1, 0.5, 1.0, 5.0, 10.0)


@query("ml04_tune_c", f"""WITH {DOC}, {newton_sql('dc', {str(c): (FE, c) for c in GRID}, {'whole': None})}, ct AS (SELECT i, CASE WHEN i = 80 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE + i * ((0.9::DOUBLE - 0.1::DOUBLE) / 80) END AS t FROM range(0, 81) q(i)),
sw AS (SELECT variant, i, t, 2.0 * count(*) FILTER (WHERE y = 1 AND p >= t) / (count(*) FILTER (WHERE p >= t) + sum(y)) AS f1 FROM pd, ct GROUP BY ALL), bt AS (SELECT variant::DOUBLE AS c, f1, t AS threshold FROM sw QUALIFY row_number() OVER (PARTITION BY variant ORDER BY round(f1, 12) DESC, i) = 1)
SELECT c, round(f1, 6) + 0.0 AS f1, round(threshold, 6) + 0.0 AS threshold, row_number() OVER (ORDER BY round(f1, 12) DESC, c) = 1 AS best FROM bt""")
def _(spark, d):
    return rounded(L.tune_c(docs(spark, d), FE, grid=GRID), "f1", "threshold")


def _cut_sql(src, keys, v, y, n=100):
    """All cut points listed against all rows."""
    return f"""rg AS (SELECT {keys}, min({v}) AS lo, max({v}) AS hi FROM {src} GROUP BY ALL), ct AS (SELECT rg.*, i, CASE WHEN i = {n - 1} THEN hi ELSE lo + i * ((hi - lo) / {n - 1}) END AS t FROM rg, (SELECT unnest(range(0, {n})) AS i) q),
sw AS (SELECT {', '.join(f'ct.{k.strip()}' for k in keys.split(','))}, i, t, dr, 2.0 * count(*) FILTER (WHERE {y} = 1 AND CASE WHEN dr = '>=' THEN {v} >= t ELSE {v} <= t END) / (count(*) FILTER (WHERE CASE WHEN dr = '>=' THEN {v} >= t ELSE {v} <= t END) + count(*) FILTER (WHERE {y} = 1)) AS f1 FROM ct JOIN {src} USING ({keys}), (SELECT unnest(['>=', '<=']) AS dr) z GROUP BY ALL),
bt AS (SELECT {keys}, f1, t AS threshold, dr AS direction FROM sw QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(f1, 12) DESC, dr DESC, i) = 1)"""


FL = """fl AS (SELECT label, 'f_len' AS feature, f_len AS v FROM dc UNION ALL SELECT label, 'f_words', f_words FROM dc UNION ALL SELECT label, 'f_lines', f_lines FROM dc)"""


@query("ml05_best_threshold", f"WITH {DOC}, {FL}, {_cut_sql('fl', 'feature', 'v', 'label')} SELECT feature, round(f1, 6) + 0.0 AS f1, round(threshold, 6) + 0.0 AS threshold, direction FROM bt")
def _(spark, d):
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in FE])
    lng = docs(spark, d).select("label", F.explode(pairs).alias("_p")).select("label", "_p.*")
    return rounded(L.best_threshold(lng, ["feature"], "v"), "f1", "threshold")


@query("ml06_classification_metrics", f"""WITH {DOC}, p AS (SELECT lang AS task, label, CAST(f_len > 1000 AS INT) AS h FROM dc), c AS (SELECT task, count(*) AS n, count(*) FILTER (WHERE label = 1 AND h = 1) AS tp, count(*) FILTER (WHERE label = 0 AND h = 1) AS fp, count(*) FILTER (WHERE label = 1 AND h = 0) AS fn FROM p GROUP BY ALL)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) + 0.0 AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) + 0.0 AS f1 FROM c""")
def _(spark, d):
    p = docs(spark, d).withColumn("y_hat", (F.col("f_len") > 1000).cast("int"))
    return rounded(L.classification_metrics(p, ["task"]), "precision", "recall", "f1")


@query("ml07_ranking_metrics", """WITH x AS (SELECT l_returnflag AS g, l_quantity AS s, CAST(l_linestatus = 'F' AS INT) AS y FROM lineitem), c AS (SELECT g, s, count(*) AS n, sum(y) AS p FROM x GROUP BY ALL),
w AS (SELECT *, sum(n) OVER a AS cn, sum(p) OVER b AS tp, sum(n) OVER b AS tn, sum(p) OVER (PARTITION BY g) AS P, sum(n) OVER (PARTITION BY g) AS N FROM c WINDOW a AS (PARTITION BY g ORDER BY s), b AS (PARTITION BY g ORDER BY s DESC))
SELECT g, round((sum((cn - (n - 1) / 2.0) * w.p) - max(P) * (max(P) + 1) / 2) / (max(P) * (max(N) - max(P))), 6) + 0.0 AS auroc, round(sum(w.p * tp / tn) / max(P), 6) + 0.0 AS average_precision FROM w GROUP BY ALL""".replace("AS P,", "AS pp,").replace("AS N ", "AS nt ").replace("max(P)", "max(pp)").replace("max(N)", "max(nt)"))
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return rounded(L.ranking_metrics(x, ["g"], "s", "y"), "auroc", "average_precision")


def features(spark, d, base=("variance", "disagreement_rate"), every=False):
    return L.feature_table(labelled(spark, d, every), base)


def _variants(sets, c=1.0):
    return {n: (fs, c) for n, fs in sets.items()}


M8 = ["f1", "precision", "recall", "auroc", "average_precision"]


@query("ml08_compare_variants", f"""WITH {ALL_LV}, {LAB}, {features_sql()}, {newton_sql('ft', _variants(SETS), FOLD_SQL)}, {metric_sql(['variant', 'scheme'])}
SELECT variant, 'logistic' AS learner, scheme, n, {r_sql(*M8)} FROM mt""")
def _(spark, d):
    out = L.compare_variants(features(spark, d, every=True), SETS, ("logistic",), tuple(L.SCHEMES))
    return rounded(out.select("variant", "learner", "scheme", "n", *M8), *M8)


@query("ml08c_compare_forests")
def _(spark, d):
    out = L.compare_variants(features(spark, d, every=True), SETS, ("forest",), tuple(L.SCHEMES))
    return rounded(out.select("variant", "learner", "scheme", "n", *M8), *M8)


@query("ml08b_family_gain", f"""WITH {LV}, b AS (SELECT CASE WHEN model IN ('click', 'error') THEN 'spuq' ELSE 'csd' END AS family, model || '_' || level AS variant, round(accuracy, 6) AS f1 FROM lv), g AS (SELECT family, max(f1) AS best FROM b GROUP BY ALL), w AS (SELECT family, variant FROM b QUALIFY row_number() OVER (PARTITION BY family ORDER BY f1 DESC, variant) = 1)
SELECT g.family, best, variant, round((best - (SELECT best FROM g WHERE family = 'spuq')) / (SELECT best FROM g WHERE family = 'spuq') * 100, 4) + 0.0 AS gain_pct FROM g JOIN w USING (family)""")
def _(spark, d):
    t = levels(spark, d).select(F.concat_ws("_", "model", F.col("level").cast("string")).alias("variant"), r6("accuracy").alias("f1"), "model")
    return rounded(L.family_gain(t, F.when(F.col("model").isin("click", "error"), "spuq").otherwise("csd"), "spuq"), "gain_pct", digits=4)


TF = ["variance", "disagreement_rate", "bimodality_coefficient", "accuracy"]


@query("ml09_threshold_baselines", f"""WITH {LV}, {LAB}, up AS (SELECT concat_ws('__', task, model) AS own, model, level, label, indicator AS feature, value AS v FROM ({unpivot_sql('lb', ('variance', 'disagreement_rate', 'bimodality_coefficient'))} UNION ALL SELECT task, model, level, d_star, accuracy, 'accuracy', accuracy FROM lb) JOIN (SELECT model, level, label FROM lb) USING (model, level)),
tr AS (SELECT f.fold, up.* FROM up JOIN (SELECT DISTINCT own AS fold FROM up) f ON f.fold <> up.own), {_cut_sql('tr', 'fold, feature', 'v', 'label')},
te AS (SELECT up.own AS fold, up.feature, up.model, up.level, up.label, CAST(CASE WHEN direction = '>=' THEN v >= threshold ELSE v <= threshold END AS INT) AS h FROM up JOIN bt ON bt.fold = up.own AND bt.feature = up.feature), tp3 AS (SELECT fold, feature FROM bt QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, feature) <= 3),
vo AS (SELECT 'vote' AS feature, label, CAST(sum(h) >= 2 AS INT) AS h FROM te JOIN tp3 USING (fold, feature) GROUP BY fold, model, level, label), al AS (SELECT feature, label, h FROM te UNION ALL SELECT * FROM vo),
c AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE label = 1 AND h = 1) AS tp, count(*) FILTER (WHERE label = 0 AND h = 1) AS fp, count(*) FILTER (WHERE label = 1 AND h = 0) AS fn FROM al GROUP BY ALL)
SELECT feature, n, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM c""")
def _(spark, d):
    m = L.threshold_baselines(labelled(spark, d), TF)
    return rounded(m.select("feature", "n", "tp", "fp", "fn", "f1"), "f1")


A10 = {"base": ["rel_level"], "full": ["rel_level", "variance__z", "disagreement_rate__z"], "plus_variance__z": ["rel_level", "variance__z"], "plus_disagreement_rate__z": ["rel_level", "disagreement_rate__z"],
       "minus_rel_level": ["variance__z", "disagreement_rate__z"], "minus_variance__z": ["rel_level", "disagreement_rate__z"], "minus_disagreement_rate__z": ["rel_level", "variance__z"]}
PAIR = {"pair": FOLD_SQL["pair"]}


@query("ml10_ablation", f"""WITH {LV}, {LAB}, {features_sql()}, {newton_sql('ft', _variants(A10), PAIR)}, {metric_sql(['variant'])} SELECT variant, n, {r_sql('f1', 'auroc')} FROM mt""")
def _(spark, d):
    a = L.ablation(features(spark, d), ["rel_level"], ["variance__z", "disagreement_rate__z"])
    return rounded(a.select("variant", "n", "f1", "auroc"), "f1", "auroc")


F10 = ["rel_level", "variance__z", "disagreement_rate__z"]
S10 = {"_".join(str(i) for i in ix): [F10[i] for i in ix] for ix in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))}


@query("ml10b_forward_select", f"""WITH {LV}, {LAB}, {features_sql()}, {newton_sql('ft', _variants(S10), PAIR)}, {metric_sql(['variant'])}, f AS (SELECT [x::INT FOR x IN string_split(variant, '_')] AS s, round(f1, 12) AS f1 FROM mt),
s1 AS (SELECT 1 AS step, s, s[1] AS added, f1 FROM f WHERE len(s) = 1 ORDER BY f1 DESC, s[1] LIMIT 1), s2 AS (SELECT 2 AS step, f.s, list_filter(f.s, lambda x: NOT list_contains(s1.s, x))[1] AS added, f.f1 FROM f, s1 WHERE len(f.s) = 2 AND list_contains(f.s, s1.added) ORDER BY f.f1 DESC, added LIMIT 1),
s3 AS (SELECT 3 AS step, f.s, list_filter(f.s, lambda x: NOT list_contains(s2.s, x))[1] AS added, f.f1 FROM f, s2 WHERE len(f.s) = 3), p AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), g AS (SELECT f1 AS full_f1 FROM f WHERE len(s) = 3)
SELECT step, ['{F10[0]}', '{F10[1]}', '{F10[2]}'][added + 1] AS feature, round(f1, 6) + 0.0 AS f1, round(full_f1, 6) + 0.0 AS full_f1 FROM p, g WHERE step <= coalesce((SELECT min(step) FROM p, g WHERE f1 >= 0.95 * full_f1), 3)""")
def _(spark, d):
    return rounded(L.forward_select(features(spark, d), F10), "f1", "full_f1")


def _h(*parts):
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT"


Z2 = ["variance__z", "disagreement_rate__z"]


@query("ml11_permutation_control", f"""WITH {LV}, {LAB}, {features_sql()}, e AS (SELECT *, concat_ws('|', task, model, lpad(level::VARCHAR, 9, '0')) AS id FROM ft), s AS (SELECT task, model, level, label, id, r AS rp, row_number() OVER (PARTITION BY r, task ORDER BY id) AS slot FROM e, range(0, 100) q(r)),
{', '.join(f"g{i} AS (SELECT task, r AS rp, {c}, row_number() OVER (PARTITION BY r, task ORDER BY {_h('r', f"'{c}'", 'id')}, id) AS slot FROM e, range(0, 100) q(r))" for i, c in enumerate(Z2))},
u AS (SELECT rp::VARCHAR AS rp, task, model, level, label, {', '.join(Z2)} FROM s JOIN g0 USING (task, rp, slot) JOIN g1 USING (task, rp, slot) UNION ALL SELECT 'observed', task, model, level, label, {', '.join(Z2)} FROM ft), {newton_sql('u', {'all': (Z2, 1.0)}, PAIR, rep='rp')},
k AS (SELECT rep, 2.0 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) / (count(*) FILTER (WHERE p >= 0.5) + sum(y)) AS f1 FROM pd GROUP BY rep), o AS (SELECT f1 AS observed FROM k WHERE rep = 'observed')
SELECT round(max(observed), 6) + 0.0 AS observed, round(avg(f1), 6) + 0.0 AS permuted_mean, round(count(*) FILTER (WHERE round(f1, 12) >= round(observed, 12)) / count(*), 6) + 0.0 AS p_value, round(max(observed) - avg(f1), 6) + 0.0 AS drop, count(*) AS n_perm FROM k, o WHERE rep <> 'observed'""")
def _(spark, d):
    return rounded(L.permutation_control(features(spark, d), Z2, p=100), "observed", "permuted_mean", "p_value", "drop")


@query("ml12_few_shot_curve", f"""WITH {DOC}, e AS (SELECT *, sd, concat_ws('|', source, doc_id::VARCHAR) AS id FROM dc, range(0, 20) q(sd)), o AS (SELECT *, CASE WHEN lang = 'fr' THEN row_number() OVER (PARTITION BY lang, sd ORDER BY {_h('sd', "concat_ws('|', source, doc_id::VARCHAR)")}, id) END AS r FROM e),
u AS (SELECT *, concat_ws('|', sd, k) AS rp, CASE WHEN lang = 'fr' AND r > k THEN 'test' ELSE 'train' END AS split FROM o, (SELECT unnest([0, 2, 5, 10]) AS k) ks), {newton_sql('u', {'all': (FE, 1.0)}, {'split': 'split'}, rep='rp')},
f AS (SELECT split_part(rep, '|', 2)::INTEGER AS k, rep, CASE WHEN 2 * count(*) FILTER (WHERE p >= 0.5 AND y = 1) + count(*) FILTER (WHERE (p >= 0.5) <> (y = 1)) > 0 THEN 2.0 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) / (count(*) FILTER (WHERE p >= 0.5) + sum(y)) ELSE 0.0 END AS f1 FROM pd WHERE fold = 'test' GROUP BY rep),
a AS (SELECT k, avg(f1) AS m, stddev_pop(f1) AS s, count(*) AS n FROM f GROUP BY k)
SELECT k, round(m, 6) + 0.0 AS mean_f1, round(s, 6) + 0.0 AS std_f1, round(1.96 * s / sqrt(n), 6) + 0.0 AS ci95, (SELECT min(k) FROM a WHERE m >= 0.8) AS min_k FROM a""")
def _(spark, d):
    f = L.few_shot_curve(docs(spark, d), FE, "fr", ks=(0, 2, 5, 10), seeds=range(20), row=F.concat_ws("|", "model", F.col("doc_id").cast("string")))
    return rounded(f, "mean_f1", "std_f1", "ci95")


def _normal_sql(*parts):
    u1, u2 = (f"(({_h(*parts, chr(39) + t + chr(39))}) + 0.5) / 4294967296.0" for t in ("u1", "u2"))
    return f"sqrt(-2.0 * ln({u1})) * cos(2 * pi() * ({u2}))"


F13 = ["variance__z", "rel_level"]


@query("ml13_noise_sensitivity", f"""WITH {LV}, {LAB}, {features_sql()}, e AS (SELECT *, concat_ws('|', task, model, level::VARCHAR) AS id FROM ft), z AS (SELECT zn, r, sqrt(1.0::DOUBLE / zn - 1.0::DOUBLE / 50) AS sd FROM (SELECT unnest([10, 15, 20, 25, 30, 40]) AS zn) a, range(0, 50) q(r) UNION ALL SELECT 50, 0, 0.0),
u AS (SELECT e.* EXCLUDE ({', '.join(F13)}), concat_ws('|', zn, r) AS rp, {', '.join(f"CASE WHEN sd = 0 THEN {c} ELSE {c} + sd * {_normal_sql('r', 'zn', f"'{c}'", 'id')} END AS {c}" for c in F13)} FROM e, z), {newton_sql('u', {'all': (F13, 1.0)}, PAIR, rep='rp')},
f AS (SELECT split_part(rep, '|', 1)::INTEGER AS n, 2.0 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) / (count(*) FILTER (WHERE p >= 0.5) + sum(y)) AS f1 FROM pd GROUP BY rep), a AS (SELECT n, avg(f1) AS m, stddev_pop(f1) AS s FROM f GROUP BY n), b AS (SELECT *, m / (SELECT m FROM a WHERE n = 50) AS ratio FROM a)
SELECT n, round(m, 6) + 0.0 AS mean_f1, round(s, 6) + 0.0 AS std_f1, round(ratio, 6) + 0.0 AS ratio, coalesce((SELECT min(n) FROM b WHERE ratio >= 0.9), 50) AS min_n FROM b""")
def _(spark, d):
    return rounded(L.noise_sensitivity(features(spark, d), F13, (10, 15, 20, 25, 30, 40, 50), repeats=50, learner="logistic"), "mean_f1", "std_f1", "ratio")


@query("ml14_feature_importance")
def _(spark, d):
    return rounded(L.feature_importance(docs(spark, d), FE, trees=100), "importance")


def _labels_sql(name, label):
    inner = newton_sql("ft", {"all": (SETS["z_rel_level"], 1.0)}, PAIR, label=label)
    return f"SELECT '{name}' AS definition, * FROM (WITH {inner}, pk AS (SELECT 1 AS one, * FROM pd), {metric_sql(['one'], 'pk')} SELECT n, {r_sql('f1', 'auroc')} FROM mt)"


@query("ml15_alternative_labels", f"""WITH {LV}, {LAB}, {features_sql()} {_labels_sql('approaching', 'label')} UNION ALL {_labels_sql('symmetric', '(abs(level - d_star) <= 2)::INT')}""")
def _(spark, d):
    f = L.cut_lineage(features(spark, d).withColumn("symmetric", P.label_near("level", "d_star", 2, "symmetric")))
    a = L.evaluate(f, SETS["z_rel_level"], "pair", "logistic").withColumn("definition", F.lit("approaching"))
    b = L.evaluate(f, SETS["z_rel_level"], "pair", "logistic", label="symmetric").withColumn("definition", F.lit("symmetric"))
    return rounded(a.unionByName(b).select("definition", "n", "f1", "auroc"), "f1", "auroc")


F16 = ["variance", "bimodality_coefficient", "disagreement_rate"]
M16 = ["precision", "recall", "f1", "auroc", "average_precision"]


@query("ml16_pooled_cv_small", f"""WITH {LV}, {LAB}, u AS (SELECT *, concat_ws('|', task, model, level::VARCHAR) AS id FROM lb), v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h('42', "concat_ws('|', task, model, level::VARCHAR)")}, id) % 3 AS part FROM u),
{newton_sql('v', {'model': (F16, 1.0), 'baseline': (['disagreement_rate'], 1.0)}, {'stratified': 'part::VARCHAR', 'row': 'id'}, min_test=1)}, {metric_sql(['scheme', 'variant'])}
SELECT scheme, variant AS which, n, tp, fp, fn, {r_sql(*M16)} FROM mt""")
def _(spark, d):
    return rounded(L.pooled_cv_small(labelled(spark, d), F16, "disagreement_rate", folds=3), *M16)


@query("ml17_independence_summary", f"""WITH {LV}, s AS (SELECT max(accuracy) FILTER (WHERE model = 'click') AS a, max(accuracy) FILTER (WHERE model = 'view') AS b, min(accuracy) FILTER (WHERE model = 'error') AS c, max(accuracy) FILTER (WHERE model = 'signup') AS e FROM lv)
SELECT round(a, 6) + 0.0 AS f1_ind, round(b, 6) + 0.0 AS f1_level, round(c, 6) + 0.0 AS f1_random, round(e, 6) + 0.0 AS f1_dyn, round(a / b, 6) + 0.0 AS contribution_ratio, round(a - c, 6) + 0.0 AS lift_over_random, round(e - a, 6) + 0.0 AS dynamics_lift, CASE WHEN a / b >= 0.9 AND a - c > 0.1 THEN 'independent' WHEN a - c > 0.1 THEN 'partly independent' ELSE 'not independent' END AS verdict FROM s""")
def _(spark, d):
    g = levels(spark, d).groupBy("model").agg(F.when(F.first("model") == "error", F.min("accuracy")).otherwise(F.max("accuracy")).alias("f1"))
    names = {"click": "indicators", "view": "level_only", "error": "random", "signup": "dynamics"}
    v = F.lit(None).cast("string")
    for m, n in names.items():
        v = F.when(F.col("model") == m, n).otherwise(v)
    s = L.independence_summary(g.withColumn("variant", v))
    return rounded(s, *[c for c in s.columns if c != "verdict"])


@query("ml18_single_feature_signal", f"""WITH {LV}, {LAB}, up AS (SELECT label, 'variance' AS feature, variance AS v FROM lb UNION ALL SELECT label, 'disagreement_rate', disagreement_rate FROM lb UNION ALL SELECT label, 'accuracy', accuracy FROM lb), ix AS (SELECT *, row_number() OVER (PARTITION BY feature) AS i FROM up),
p AS (SELECT a.feature, sum(sign(a.v - b.v) * sign(a.label - b.label)) AS s, count(*) AS n0, count(*) FILTER (WHERE a.v = b.v) AS t1, count(*) FILTER (WHERE a.label = b.label) AS t2 FROM ix a JOIN ix b ON a.feature = b.feature AND a.i < b.i GROUP BY ALL), t AS (SELECT feature, s / sqrt((n0 - t1) * (n0 - t2)::DOUBLE) AS tau FROM p)
SELECT t.feature, (SELECT count(*) FROM lb) AS n, round(tau, 6) + 0.0 AS tau, (SELECT max(abs(tau)) > 0.1 FROM t) AS any_signal FROM t""")
def _(spark, d):
    return rounded(L.single_feature_signal(labelled(spark, d), ["variance", "disagreement_rate", "accuracy"]), "tau")


F19 = ["variance", "disagreement_rate", "bimodality_coefficient"]


@query("ml19_task_scaled_lr", f"""WITH {LV}, {LAB}, u AS (SELECT * EXCLUDE ({', '.join(F19)}), {', '.join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER t) / CASE WHEN stddev_pop(coalesce({c}, 0)) OVER t > 0 THEN stddev_pop(coalesce({c}, 0)) OVER t ELSE 1 END AS {c}" for c in F19)} FROM lb WINDOW t AS (PARTITION BY task)),
{newton_sql('u', {'all': (F19, 1.0)}, PAIR, balanced=False)}, pk AS (SELECT 1 AS one, * FROM pd), {metric_sql(['one'], 'pk')} SELECT n, {r_sql('f1', 'precision', 'recall', 'auroc')} FROM mt""")
def _(spark, d):
    m = L.task_scaled_lr(labelled(spark, d), F19)
    return rounded(m.select("n", "f1", "precision", "recall", "auroc"), "f1", "precision", "recall", "auroc")
