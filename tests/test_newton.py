"""Batched logistic regressions and forests against one fit at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.operators import forest, learners as L, newton


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    n = 240
    y = rng.integers(0, 2, n)
    a, b = rng.normal(y * 0.8, 1.0), rng.normal(0, 5.0, n) + 1000
    rows = [("t" + str(i % 2), f"m{i % 6}", i // 6, int(y[i]), float(a[i]), None if i % 17 == 0 else float(b[i]), 3.0) for i in range(n)]
    df = spark.createDataFrame(rows, "task string, model string, level int, label int, a double, b double, flat double")
    return df, np.array([r[:2] for r in rows]), y, np.array([[r[4], r[5] or 0.0, r[6]] for r in rows])


def one_fit(x, y, c, balanced=True):
    """One training set by Newton's method; the gradient is zero at the end."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-9 * (1 + abs(mean)), sd, 1.0)
    z = np.c_[np.ones(len(y)), (x - mean) / sd]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    pen, beta = np.r_[0.0, np.ones(x.shape[1])], np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = c * z.T @ (w * (p - y)) + pen * beta
        beta = beta - np.linalg.solve(c * (z.T * (w * p * (1 - p))) @ z + np.diag(pen), grad)
    assert abs(grad).max() < 1e-9
    return lambda t: 1 / (1 + np.exp(-np.c_[np.ones(len(t)), (t - mean) / sd] @ beta))


@pytest.mark.parametrize("balanced", [True, False])
def test_every_fold_equals_its_own_fit(case, balanced):
    df, groups, y, x = case
    sets = {"one": (["a"], 1.0), "all": (["a", "b", "flat"], 0.2)}
    got = newton.cross_validate(df, sets, {"model": F.col("model"), "whole": None}, carry=["model", "level"], balanced=balanced).collect()
    assert len(got) == 2 * 2 * len(y)
    for name, cols, c in (("one", [0], 1.0), ("all", [0, 1, 2], 0.2)):
        for scheme in ("model", "whole"):
            for fold in sorted(set(groups[:, 1])) if scheme == "model" else [""]:
                test = groups[:, 1] == fold if fold else np.ones(len(y), bool)
                train = ~test if fold else test
                want = one_fit(x[train][:, cols], y[train], c, balanced)(x[test][:, cols])
                at = {(f"m{i % 6}", i // 6): p for i, p in zip(np.flatnonzero(test), want)}
                mine = {(r["model"], r["level"]): r["p"] for r in got if (r["variant"], r["scheme"], r["fold"]) == (name, scheme, fold)}
                assert mine.keys() == at.keys() and all(mine[k] == pytest.approx(at[k], abs=1e-6) for k in at)


def test_replicates_are_apart(case):
    df, *_ = case
    both = df.withColumn("r", F.lit("x")).unionByName(df.withColumn("a", -F.col("a") * F.col("level")).withColumn("r", F.lit("y")))
    together = newton.cross_validate(both, {"v": ["a", "b"]}, {"task": F.col("task")}, rep=F.col("r"), carry=["model", "level"])
    for r in ("x", "y"):
        alone = newton.cross_validate(both.where(F.col("r") == r), {"v": ["a", "b"]}, {"task": F.col("task")}, carry=["model", "level"])
        a = {(q["model"], q["level"]): q["p"] for q in together.where(F.col("rep") == r).collect()}
        b = {(q["model"], q["level"]): q["p"] for q in alone.collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-8) for k in a)


def test_folds_that_cannot_be_used(spark):
    rows = [("t", "m0", i, i % 2, float(i)) for i in range(8)] + [("t", "m1", 0, 1, 2.0)] + [("t", "m2", i, 1, 9.0) for i in range(3)]
    df = spark.createDataFrame([*rows, ("t", "m2", 9, None, 1.0)], "task string, model string, level int, label int, a double")
    got = newton.cross_validate(df, {"v": ["a"]}, {"model": F.col("model")}).collect()
    # without m0 only positives remain; m1 has one row; m2 is predicted, its row without a label is not
    assert {r["fold"] for r in got} == {"m2"} and len(got) == 3
    assert newton.cross_validate(df.limit(0), {"v": ["a"]}, {"model": F.col("model")}).count() == 0


def test_separable_rows_converge(spark):
    df = spark.createDataFrame([("t", f"m{i % 3}", i, int(i >= 30), float(i) * 1e6) for i in range(60)], "task string, model string, level int, label int, a double")
    got = newton.cross_validate(df, {"v": (["a"], 1e4)}, {"model": F.col("model")}, carry=["level"]).collect()
    assert all((r["p"] > 0.5) == (r["level"] >= 30) for r in got)


def test_number_of_jobs_does_not_grow(spark, case):
    df, *_ = case
    def jobs(reps):
        group = f"jobs-{reps}"
        spark.sparkContext.setJobGroup(group, group)
        out = L.permutation_control(df, ["a", "b"], p=reps).collect()
        spark.sparkContext.setJobGroup("other", "other")
        return out[0], len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (few, n_few), (many, n_many) = jobs(2), jobs(30)
    assert few["observed"] == many["observed"] and many["n_perm"] == 30 and n_many <= n_few + 12


def test_forest(spark, case):
    df, groups, y, x = case
    sets = {"one": ["a"], "two": ["a", "b"]}
    a = forest.cross_validate_forest(df, sets, {"model": F.col("model")}, carry=["model", "level"], trees=30).collect()
    b = forest.cross_validate_forest(df.repartition(5), sets, {"model": F.col("model")}, carry=["model", "level"], trees=30).collect()
    key = lambda r: (r["variant"], r["model"], r["level"])
    assert {key(r): r["p"] for r in a} == {key(r): r["p"] for r in b} and len(a) == 2 * len(y)
    for v in sets:
        p = {(r["model"], r["level"]): r["p"] for r in a if r["variant"] == v}
        p = np.array([p[f"m{i % 6}", i // 6] for i in range(len(y))])
        assert np.mean([(s > t) + 0.5 * (s == t) for s in p[y == 1] for t in p[y == 0]]) > 0.6


def test_tree_cuts(spark):
    x = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]])
    y = np.array([0.0, 0, 1, 1])
    f, c, leaf = forest.grow(x[:, :1], y, np.ones(4), np.random.default_rng(0))
    assert (f[0], c[0]) == (0, 1.5) and forest.probability((f[None], c[None], leaf[None]), x[:, :1]).tolist() == [0, 0, 1, 1]
    flat = forest.grow(x[:, 1:], y, np.array([1.0, 1, 1, 0]), np.random.default_rng(0))
    assert np.isinf(flat[1]).all() and forest.probability(tuple(a[None] for a in flat), x[:, 1:]).tolist() == pytest.approx([1 / 3] * 4)


def test_forward_select_and_ablation(case):
    df, *_ = case
    path = L.forward_select(df, ["b", "a"], scheme="task", share=1.01).collect()
    assert [r["step"] for r in path] == [1, 2] and {r["feature"] for r in path} == {"a", "b"} and path[1]["f1"] == path[0]["full_f1"]
    assert len(L.forward_select(df, ["b", "a", "flat"], scheme="task", share=0.1).collect()) == 1
    got = {r["variant"]: r["f1"] for r in L.ablation(df, ["b"], ["a"], "task").collect()}
    assert set(got) == {"base", "full", "plus_a", "minus_a", "minus_b"} and got["plus_a"] == got["full"] and got["minus_a"] == got["base"]
