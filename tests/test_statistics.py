"""Statistics against brute force, closed forms against loops, skewed groups, edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.functions import special as D
from levelscan.operators import alarms as A
from levelscan.operators import indicators as I
from levelscan.operators import learners as L
from levelscan.operators import resampling as B
from levelscan.operators import statistics as T
from levelscan.operators import vectors as V
from levelscan.operators import windows as N
from levelscan.plans.prefix import average_ranks, running_sums


def brute_tau(x, y):
    s = t1 = t2 = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s += np.sign(a - c) * np.sign(b - d)
        t1 += a == c
        t2 += b == d
    n0 = len(x) * (len(x) - 1) / 2
    den = math.sqrt((n0 - t1) * (n0 - t2))
    return s / den if den else 0.0


@pytest.mark.parametrize("large", [False, True])
def test_kendall_matches_pairs(spark, large):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(m)), float(rng.randrange(m))) for g, n, m in (("a", 40, 5), ("b", 17, 1000), ("c", 3, 2)) for _ in range(n)]
    rows += [("flat", float(i), 1.0) for i in range(6)]
    got = {r["g"]: r["tau"] for r in T.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", large=large, p_value=False).collect()}
    for g in ("a", "b", "flat"):
        xs, ys = zip(*[(x, y) for k, x, y in rows if k == g])
        assert got[g] == pytest.approx(brute_tau(xs, ys), abs=1e-12)


def test_kendall_exact_p(spark):
    y = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "x int, y double").withColumn("g", F.lit(1))
    r = T.kendall(df, ["g"], "x", "y").first()
    inv = [sum(p[i] > p[j] for i in range(6) for j in range(i + 1, 6)) for p in itertools.permutations(range(6))]
    assert r["p_value"] == pytest.approx(min(1.0, 2 * sum(k <= 2 for k in inv) / len(inv)))


def test_running_sums_with_one_hot_key(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.lognormal(0, 4, 3000), rng.normal(1e6, 1e-3, 1000)])
    rows = [("hot", float(v)) for v in vals] + [("cold", 1.0), ("cold", 1.0), ("cold", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = average_ranks(df, ["k"], "v").collect()
    hot = {r["v"]: r["rank_avg"] for r in got if r["k"] == "hot"}
    order = np.sort(vals)
    assert all(hot[v] == i + 1 for i, v in enumerate(order))
    assert sorted((r["v"], r["rank_avg"]) for r in got if r["k"] == "cold") == [(1.0, 1.5), (2.0, 3.0)]
    nxt = {r["v"]: r["next_value"] for r in got if r["k"] == "hot"}
    assert all(nxt[a] == b for a, b in zip(order, order[1:])) and nxt[order[-1]] is None
    assert len({r["cum_cnt"] for r in got if r["k"] == "hot"}) == len(vals)
    assert running_sums  # the helper under average_ranks


def test_tails(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 4.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(D.normal_two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-9)
    cases = [(2.0, 1), (2.0, 2), (0.7, 5), (3.1, 10), (1.5, 999), (1.5, 1001), (2.5, 100000)]
    got = [r[0] for r in spark.createDataFrame(cases, "t double, df int").select(D.t_two_sided(F.col("t"), F.col("df"))).collect()]
    want = [D.beta_cdf(df / (df + t * t), df / 2, 0.5) for t, df in cases]
    assert got == pytest.approx(want, rel=1e-7)
    assert D.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)


def test_rank_tests_against_pairs(spark):
    rng = random.Random(5)
    a, b = [rng.gauss(0.5, 1) for _ in range(7)], [rng.gauss(0, 1) for _ in range(9)]
    df = spark.createDataFrame([("g", "a", v) for v in a] + [("g", "b", v) for v in b] + [("lone", "a", 1.0)], "g string, s string, v double")
    rows = {r["g"]: r for r in T.mann_whitney(df, ["g"], "v", "s", "a", "b").collect()}
    r = rows["g"]
    u = sum(x > y for x in a for y in b)
    assert r["u"] == u and r["cliffs_delta"] == pytest.approx(sum(np.sign(x - y) for x in a for y in b) / 63)
    pool = a + b
    hits = total = 0
    for comb in itertools.combinations(range(16), 7):
        x = [pool[i] for i in comb]
        y = [pool[i] for i in range(16) if i not in comb]
        hits += sum(p > q for p in x for q in y) >= u
        total += 1
    assert r["p_greater"] == pytest.approx(hits / total)
    assert rows["lone"]["cliffs_delta"] is None


def naive_dip(v):
    """Largest misses left and right of every mode position, written out point by point."""
    v = np.sort(v)
    n = len(v)
    best = 1.0
    for m in range(n):
        left = 0.0
        for i in range(m):  # convex minorant of (v_j, (j)/n), j <= m, at v_i
            low = min(
                [i / n] + [j / n + (k - j) / n * (v[i] - v[j]) / (v[k] - v[j]) for j in range(i + 1) for k in range(i, m + 1) if v[k] > v[j]])
            left = max(left, (i + 1) / n - low)
        right = 0.0
        for i in range(m + 1, n):
            high = max(
                [(i + 1) / n] + [(j + 1) / n + (k - j) / n * (v[i] - v[j]) / (v[k] - v[j]) for j in range(m, i + 1) for k in range(i, n) if v[k] > v[j]])
            right = max(right, high - i / n)
        best = min(best, max(left, right) / 2)
    return best


def test_dip(spark):
    rng = np.random.default_rng(0)
    for sample in (rng.random(12), rng.normal(size=15), np.concatenate([rng.normal(0, 0.1, 8), rng.normal(5, 0.1, 8)])):
        assert I.dip_of(sample) == pytest.approx(naive_dip(sample), abs=1e-12)
    assert I.dip_of(np.arange(20.0)) == pytest.approx(1 / 40)
    two = np.concatenate([rng.normal(0, 0.1, 100), rng.normal(10, 0.1, 100)])
    df = spark.createDataFrame([("two", float(x)) for x in two] + [("one", float(x)) for x in rng.normal(size=200)] + [("tiny", 1.0)], "g string, x double")
    p = {r["g"]: r for r in I.dip_pvalue(I.dip_statistic(df, ["g"], "x"), ["g"]).collect()}
    assert p["two"]["dip_pvalue"] < 1e-4 and p["one"]["dip_pvalue"] > 0.05 and p["tiny"]["dip_pvalue"] == 1.0


def test_dip_of_large_groups_in_blocks(spark):
    rng = np.random.default_rng(7)
    data = {"a": np.round(rng.normal(size=60), 2), "b": np.concatenate([rng.normal(0, 1, 40), rng.normal(4, 1, 50)]), "c": rng.random(9)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double")
    got = {r["g"]: r["dip_statistic"] for r in I.dip_statistic(df, ["g"], "x", limit=20, block=17).collect()}
    for g, xs in data.items():
        assert got[g] == pytest.approx(I.dip_of(xs), abs=1e-12)


def test_vector_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6)) * np.array([3, 1, 1, 1, 1, 1])
    df = spark.createDataFrame([("g", i, [float(t) for t in r]) for i, r in enumerate(x)] + [("one", 99, [1.0] * 6)], "g string, id int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.array([1 - u[i] @ u[j] for i in range(30) for j in range(i + 1, 30)])
    r = {t["g"]: t for t in V.group_pair_stats(df, ["g"], "v").collect()}
    assert r["g"]["mean_cosine_distance"] == pytest.approx(d.mean()) and r["g"]["std_cosine_distance"] == pytest.approx(d.std())
    assert r["one"]["mean_cosine_distance"] == 0.0
    m = {t["g"]: t for t in V.group_vector_moments(df, ["g"], "v").collect()}
    assert m["g"]["variance_trace"] == pytest.approx(np.trace(np.cov(x.T))) and m["g"]["mean_cosine_distance"] == pytest.approx(d.mean())
    val, vec = np.linalg.eigh(np.cov(x.T))
    s = np.abs((x - x.mean(0)) @ vec[:, -1])
    got = {t["id"]: abs(t["pc1"]) for t in I.pc1_scores(df, ["g"], "v").collect()}
    assert [got[i] for i in range(30)] == pytest.approx(list(s))


def test_clusters_and_silhouette(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (20, 3)), rng.normal(4, 0.3, (25, 3))])
    df = spark.createDataFrame([("g", i, [float(t) for t in r]) for i, r in enumerate(x)], "g string, id int, v array<double>")
    rows = I.kmeans2(df, ["g"], "v")
    c = {r["id"]: r["cluster"] for r in rows.collect()}
    assert len({c[i] for i in range(20)}) == 1 and len({c[i] for i in range(20, 45)}) == 1 and c[0] != c[44]
    lab = np.array([c[i] for i in range(45)])
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(45):
        own = dist[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        other = dist[i][lab != lab[i]].mean()
        want.append((other - own) / max(own, other))
    for block in (7, 1024):
        assert I.silhouette_k2(rows, ["g"], "id", "v", block=block).first()["silhouette_k2"] == pytest.approx(np.mean(want))


def series(spark, n=25, seed=4):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(1, 0.1, n // 2), rng.normal(1.6, 0.2, n - n // 2)])
    dis, dip = rng.random(n), rng.random(n)
    rows = [("t", "m", i, float(v[i]), float(dis[i]), float(dip[i]), 0.9 - i * 0.02, 20) for i in range(n)] + [("t", "short", i, 1.0, 0.1, 0.5, 0.9, None) for i in range(2)]
    return spark.createDataFrame(rows, "task string, model string, level int, variance double, disagreement_rate double, dip_pvalue double, accuracy double, d_star int"), v, dis, dip


def test_alarm_windows_equal_the_recursions(spark):
    df, v, dis, dip = series(spark)
    got = {(r["protocol"], r["level"]): r for r in A.protocol_grid(df).where("model = 'm'").collect()}
    mu, sd = v[:3].mean(), v[:3].std(ddof=1)
    s, z = 0.0, mu
    for i in range(3, len(v)):
        s = max(0.0, s + v[i] - mu - 0.5 * sd)
        z = 0.2 * v[i] + 0.8 * z
        lim = mu + 2.5 * sd * math.sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * (i - 2))))
        assert got["cusum_variance_h4.0", i]["statistic"] == pytest.approx(s, abs=1e-9)
        assert got["ewma_variance_l0.2_L2.5", i]["statistic"] == pytest.approx(z)
        assert got["ewma_variance_l0.2_L2.5", i]["limit"] == pytest.approx(lim)
        votes = int(v[i] > mu + 2 * sd) + int(dis[i] > 0.3) + int(dip[i] < 0.05)
        assert got["any2", i]["alarmed"] == (votes >= 2)
    assert A.protocol_grid(df).where("model = 'short'").count() == 0
    m = A.alarm_metrics(A.protocol_grid(df))
    assert m.where("model = 'short'").count() == 0 and A.alarm_summary(m).count() == 15


def test_stream_monitor_ignores_batch_borders(spark, tmp_path):
    from levelscan.streaming import monitors as S

    df, *_ = series(spark)
    df = df.drop("accuracy", "d_star")
    for cuts in ([25], [2, 3, 11, 25]):
        base = tmp_path / f"c{len(cuts)}"
        lo = -1
        for i, hi in enumerate(cuts):
            df.where((F.col("level") > lo) & (F.col("level") <= hi)).coalesce(1).write.parquet(f"{base}/in/p={i}")
            lo = hi
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/p=*")
        S.run_to_files(S.stream_alarm_monitor(src), f"{base}/out", f"{base}/cp").awaitTermination()
        got = {(r["protocol"], r["level"]): (round(r["statistic"], 9), r["alarmed"]) for r in spark.read.parquet(f"{base}/out").where("model = 'm'").collect()}
        want = {(r["protocol"], r["level"]): (round(r["statistic"], 9), r["alarmed"]) for r in A.protocol_grid(df).where("model = 'm'").collect() if (r["protocol"], r["level"]) in got}
        assert got == want and len(got) == 5 * 22


def test_thresholds_metrics_and_folds(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 60)
    v = np.round(rng.normal(y, 1.0), 1)
    df = spark.createDataFrame([("t", f"m{i % 3}", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, v))], "task string, model string, level int, label int, v double")

    def f1(h):
        return 2 * int((h & (y == 1)).sum()) / (int(h.sum()) + int((y == 1).sum()))

    lo, hi = v.min(), v.max()
    cuts = [lo + i * ((hi - lo) / 99) if i < 99 else hi for i in range(100)]
    want = max(max(f1(v >= t) for t in cuts), max(f1(v <= t) for t in cuts))
    got = L.best_threshold(df.withColumn("k", F.lit(0)), ["k"], "v").first()
    assert got["f1"] == pytest.approx(want)
    h = v >= got["threshold"] if got["direction"] == ">=" else v <= got["threshold"]
    assert f1(h) == pytest.approx(want)
    r = L.ranking_metrics(df.withColumn("k", F.lit(0)), ["k"], "v").first()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in v[y == 1] for b in v[y == 0]])
    assert r["auroc"] == pytest.approx(auc)
    folds = L.group_folds(df, "pair").collect()
    assert len(folds) == 3 and sum(x["n_test"] for x in folds) == 60 and all(x["n_test"] + x["n_train"] == 60 for x in folds)
    pred = L.cv_predictions(df, {"v": ["v"]}).withColumnRenamed("y", "label")
    assert pred.count() == 60 and L.ranking_metrics(pred.withColumn("k", F.lit(0)), ["k"]).first()["auroc"] > 0.6


def test_windows_edge_cases(spark):
    df, *_ = series(spark)
    one = df.where("model = 'short' and level = 0").withColumn("f", F.lit(2.0))
    got = one.select(N.delta("f"), N.acceleration("f"), N.rolling_slope("f"), N.trailing_tau("f"), N.running_z("f"), N.pct_rank_avg("f")).first()
    assert list(got) == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert N.critical_level(df.where("model = 'short'")).first()["d_star"] is None
    assert N.critical_level(df.where("model = 'short'"), default="next").first()["d_star"] == 2
    zero = df.where("model = 'm'").withColumn("accuracy", F.lit(0.1))
    assert N.critical_level(zero).first()["d_star"] == 0  # level 0 is a level, not a missing one


def test_resampling_is_keyed(spark):
    df, *_ = series(spark)
    a = B.bootstrap_ci(df, ["model"], "variance", ["level"], 100).orderBy("model").collect()
    b = B.bootstrap_ci(df.repartition(7), ["model"], "variance", ["level"], 100).orderBy("model").collect()
    assert all(
        x["ci_low"] == pytest.approx(y["ci_low"]) and x["ci_high"] == pytest.approx(y["ci_high"]) for x, y in zip(a, b))
    bca = B.bca_ci(df, ["model"], "variance", ["level"], 200).where("model = 'm'").first()
    assert bca["ci_low"] < bca["point"] < bca["ci_high"]
    perm = B.permute_within(df.where("model = 'm'"), ["variance"], ["model"], "level").collect()
    assert sorted(r["variance"] for r in perm) == sorted(r["variance"] for r in df.where("model = 'm'").collect())


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from levelscan.functions.special import normal_ppf

    shares = [1e-8, 0.001, 0.025, 0.3, 0.5, 0.8, 0.999, 1 - 1e-8, None]
    got = [r["z"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(shares)], "i int, p double").withColumn("z", normal_ppf(F.col("p"))).orderBy("i").collect()]
    assert got[-1] is None and all(abs(g - NormalDist().inv_cdf(p)) < 1e-6 for g, p in zip(got, shares[:-1]))
