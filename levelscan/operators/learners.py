"""Feature tables, leave-group-out evaluation and exact classification metrics.

Validations fit all their folds, variants and replicates together (``newton``, ``forest``), in a number of jobs that doesn't depend on how
many there are.  All metrics are sums over distinct scores, exact under ties.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelscan.operators import windows as N
from levelscan.operators.forest import cross_validate_forest
from levelscan.operators.newton import cross_validate
from levelscan.operators.resampling import permute_within
from levelscan.operators.statistics import kendall
from levelscan.plans.draws import hash32, normal
from levelscan.plans.prefix import running_sums, value_counts
from levelscan.plans.session import cut_lineage

BASE = ("variance", "dip_pvalue", "silhouette_k2", "bimodality_coefficient", "disagreement_rate")
SCHEMES = {"pair": ("task", "model"), "task": ("task",), "model": ("model",)}


def feature_table(series: DataFrame, base: Sequence[str] = BASE) -> DataFrame:
    """All derived feature columns of a level table with d_star, in window passes over the same partitions."""
    pair, task = ["task", "model"], ["task"]
    cols: dict[str, Column] = {"rel_level": N.minmax("level", task, "one"), "rel_distance": N.relative_distance(task)}
    for c in base:
        cols |= {
            f"{c}__z": N.zscore(c, task, "eps"), f"{c}__delta": N.delta(c), f"{c}__accel": N.acceleration(c), f"{c}__slope": N.rolling_slope(c),
            f"{c}__pct": N.pct_rank_avg(c, pair), f"{c}__runz": N.running_z(c), f"{c}__base": N.ratio_to_baseline(c), f"{c}__max": N.ratio_to_max(c),
            f"{c}__tau": N.trailing_tau(c),
        }
    return series.withColumns(cols)


def feature_sets(base: Sequence[str] = BASE) -> dict[str, list[str]]:
    """Named column lists over ``feature_table``."""
    def d(suffix):
        return [f"{c}__{suffix}" for c in base]

    sets = {
        "raw": list(base), "raw_level": [*base, "rel_level"], "z": d("z"), "z_rel_level": [*d("z"), "rel_level"],
        "z_rel_distance": [*d("z"), "rel_distance"], "z_delta": [*d("z"), *d("delta")], "percentile": d("pct"),
        "percentile_rel_level": [*d("pct"), "rel_level"], "running_z": d("runz"), "ratios": [*d("base"), *d("max")],
        "trend": [*d("delta"), *d("slope"), *d("accel")], "trend_rel_level": [*d("delta"), *d("slope"), *d("accel"), "rel_level"],
        "full": [*d("z"), *d("delta"), *d("tau"), *d("pct"), "rel_level"], "level_only": ["rel_level"],
    }
    return sets | {f"{c}_only": [c] for c in base}


def group_folds(df: DataFrame, scheme: str, label: str = "label", min_train: int = 5, min_test: int = 2) -> DataFrame:
    """One row per fold: sizes, positives, and whether it can be used."""
    keys = SCHEMES[scheme]
    full = W.partitionBy(F.lit(0))
    per = df.groupBy(F.concat_ws("__", *keys).alias("fold")).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col(label).cast("long")).alias("test_pos"))
    per = per.withColumns({"n_train": F.sum("n_test").over(full) - F.col("n_test"), "train_pos": F.sum("test_pos").over(full) - F.col("test_pos")})
    ok = (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test) & (F.col("train_pos") > 0) & (F.col("train_pos") < F.col("n_train"))
    return per.withColumn("usable", ok)


# ---- models -------------------------------------------------------------------------------------

def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 50, seed: int = 42):
    """Forest of ``pyspark.ml`` on all rows: features standardised, classes weighted n/(2 n_class)."""
    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    pos, neg = n["p"], n["n"] - n["p"]
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_f"),
        StandardScaler(inputCol="_f", outputCol="_scaled", withMean=True),
        RandomForestClassifier(featuresCol="_scaled", labelCol="_y", weightCol="_w", numTrees=trees, seed=seed),
    ]
    w = F.when(F.col(label) == 1, n["n"] / (2.0 * pos)).otherwise(n["n"] / (2.0 * neg))
    return Pipeline(stages=stages).fit(train.na.fill(0.0, list(features)).withColumns({"_y": F.col(label).cast("double"), "_w": w}))


def fit_predict(df: DataFrame, test: Column, features: Sequence[str], label: str = "label", carry: Sequence[str] = (), c: float = 1.0, balanced: bool = True) -> DataFrame:
    """Logistic regression on the rows outside ``test``, predictions (p, y_hat) for the rows in it."""
    part = F.when(test, "test").otherwise("train")
    return cross_validate(df, {"all": (list(features), c)}, {"split": part}, label, carry=carry, balanced=balanced).where("fold = 'test'").select(*carry, F.col("y").alias(label), "p", "y_hat")


def fold_of(scheme: str) -> Column:
    return F.concat_ws("__", *SCHEMES[scheme])


def cv_predictions(
    df: DataFrame, variants: Mapping[str, Sequence[str]], schemes: Sequence[str] = ("pair",), label: str = "label", learners: Sequence[str] = ("logistic",), rep: Column | None = None,
    balanced: bool = True, trees: int = 50, carry: Sequence[str] = (),
) -> DataFrame:
    """Held-out predictions of every usable fold: learner, rep, variant, scheme, fold, y, p, y_hat and the carried columns."""
    folds = {s: fold_of(s) for s in schemes}
    parts = []
    for learner in learners:
        if learner == "logistic":
            out = cross_validate(df, variants, folds, label, rep, carry, balanced).drop("c")
        elif learner == "forest":
            out = cross_validate_forest(df, variants, folds, label, rep, carry, trees, balanced=balanced)
        else:
            raise ValueError(learner)
        parts.append(out.withColumn("learner", F.lit(learner)))
    return reduce(DataFrame.unionByName, parts)


def tune_c(train: DataFrame, features: Sequence[str], label: str = "label", grid: Sequence[float] = (0.01, 0.1, 0.5, 1.0, 5.0, 10.0)) -> DataFrame:
    """Training F1 at the best probability cut per C; ``best`` marks the first maximum.  The grid is fitted together."""
    pred = cross_validate(train, {str(c): (list(features), c) for c in grid}, {"whole": None}, label)
    out = best_probability(pred.select("c", "p", F.col("y").alias(label)), ["c"], "p", label)
    top = out.agg(F.max_by(F.col("c"), F.struct(F.round("f1", 12), -F.col("c"))).alias("_top"))
    return out.join(F.broadcast(top)).withColumn("best", F.col("c") == F.col("_top")).drop("_top")


# ---- metrics ------------------------------------------------------------------------------------

def classification_metrics(pred: DataFrame, keys: Sequence[str], y: str = "label", y_hat: str = "y_hat") -> DataFrame:
    def s(c):
        return F.sum(c.cast("long"))

    t, h = F.col(y) == 1, F.col(y_hat) == 1
    out = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), s(t & h).alias("tp"), s(~t & h).alias("fp"), s(t & ~h).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
        "f1": F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0),
    })


def ranking_metrics(pred: DataFrame, keys: Sequence[str], score: str = "p", y: str = "label", one_class: float = 0.5) -> DataFrame:
    """AUROC with ties and average precision with tied scores taken together."""
    keys = list(keys)
    t = (F.col(y) == 1).cast("long")
    run = running_sums(value_counts(pred, keys, score, {"pos": t}), keys, score, ["cnt", "pos"])
    rank = F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0
    above = F.col("total_cnt") - F.col("cum_cnt") + F.col("cnt")
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    out = run.groupBy(*keys).agg(
        F.max("total_pos").alias("_p"), F.max("total_cnt").alias("_n"), F.sum(rank * F.col("pos")).alias("_r"), F.sum(F.col("pos") * tp / above).alias("_ap"))
    p, neg = F.col("_p"), F.col("_n") - F.col("_p")
    ok = (p > 0) & (neg > 0)
    return out.select(
        *keys, F.when(ok, (F.col("_r") - p * (p + 1) / 2) / (p * neg)).otherwise(one_class).alias("auroc"),
        F.when(p > 0, F.col("_ap") / p).otherwise(0.0).alias("average_precision"))


def _best_cut(df: DataFrame, keys: Sequence[str], value: str, y: str, lo: Column, hi: Column, cuts: int, directions: Sequence[str]) -> DataFrame:
    """Best F1 over evenly spaced cuts, from counts per cut interval (rows are never multiplied by the cuts).

    ``df`` carries the range columns behind lo and hi.
    """
    keys = list(keys)
    step = (hi - lo) / (cuts - 1)
    v = F.col(value).cast("double")
    guess = F.when(step > 0, F.floor((v - lo) / step)).otherwise(cuts - 1)
    cut = lambda i: F.when(i >= cuts - 1, hi).otherwise(lo + i * step)
    # largest cut at or below the value, corrected for rounding
    up, down = cut(guess + 1) <= v, cut(guess) > v
    ge = F.least(F.when(up, guess + 1).when(down, guess - 1).otherwise(guess), F.lit(cuts - 1))
    rows = df.withColumns({"_ge": ge.cast("int"), "_lo": lo, "_step": step, "_hi": hi})
    le = F.when((F.col("_ge") >= 0) & (cut(F.col("_ge")) == v), F.col("_ge")).otherwise(F.col("_ge") + 1)
    pairs = F.array(*[F.struct(F.lit(d).alias("direction"), (F.col("_ge") if d == ">=" else le).cast("int").alias("_bin")) for d in directions])
    t = (F.col(y) == 1).cast("long")
    binned = rows.select(*keys, "_lo", "_step", "_hi", t.alias("_t"), F.explode(pairs).alias("_p")).select(*keys, "_lo", "_step", "_hi", "_t", "_p.*")
    per = binned.groupBy(*keys, "direction", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_t").alias("pos"), F.max("_lo").alias("_lo"), F.max("_step").alias("_step"), F.max("_hi").alias("_hi"))
    w = W.partitionBy(*keys, "direction").orderBy("_bin")
    full = W.partitionBy(*keys, "direction")
    n, pos = F.sum("n").over(full), F.sum("pos").over(full)
    run_n, run_p = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum("pos").over(w.rowsBetween(W.unboundedPreceding, 0))
    is_ge = F.col("direction") == ">="
    hit = F.when(is_ge, n - run_n + F.col("n")).otherwise(run_n)
    tp = F.when(is_ge, pos - run_p + F.col("pos")).otherwise(run_p)
    first = F.when(is_ge, F.greatest(F.coalesce(F.lag("_bin").over(w), F.lit(-1)) + 1, F.lit(0))).otherwise(F.col("_bin"))
    per = per.withColumns({"_f1": F.when(hit + pos > 0, 2.0 * tp / (hit + pos)).otherwise(0.0), "_i": first})
    per = per.where((F.col("_bin") >= 0) & (F.col("_i") <= cuts - 1))
    per = per.withColumn("_t", F.when(F.col("_i") >= cuts - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("_i") * F.col("_step")))
    order = F.struct(F.round(-F.col("_f1"), 12), F.when(F.col("direction") == ">=", 0).otherwise(1), F.col("_i"))
    best = F.min_by(F.struct(F.col("_f1").alias("f1"), F.col("_t").alias("threshold"), "direction"), order)
    return per.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_threshold(df: DataFrame, keys: Sequence[str], value: str, y: str = "label", cuts: int = 100) -> DataFrame:
    """Best F1 over ``cuts`` even cut points between min and max, both directions; the first best wins."""
    keys = list(keys)
    rng = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_z"))
    return _best_cut(df.where(F.col(value).isNotNull()).join(rng, keys), keys, value, y, F.col("_a"), F.col("_z"), cuts, (">=", "<="))


def best_probability(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "label") -> DataFrame:
    """Best F1 over cuts 0.10, 0.11, ... 0.90."""
    return _best_cut(df, keys, p, y, F.lit(0.1), F.lit(0.9), 81, (">=",)).drop("direction")


# ---- comparisons --------------------------------------------------------------------------------

def metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classification and ranking metrics of held-out predictions (y, p, y_hat) per key; probabilities that differ past the 12th digit tie."""
    pred = cut_lineage(pred.select(*keys, F.col("y").alias("label"), F.round("p", 12).alias("p"), "y_hat"))  # read twice
    return classification_metrics(pred, keys).join(ranking_metrics(pred, keys), list(keys))


def evaluate(df: DataFrame, features: Sequence[str], scheme: str = "pair", learner: str = "logistic", label: str = "label", **kw) -> DataFrame:
    return metrics(cv_predictions(df, {"all": features}, (scheme,), label, (learner,), **kw), ["scheme", "learner"])


def compare_variants(df: DataFrame, variants: Mapping[str, Sequence[str]], learners: Sequence[str] = ("logistic", "forest"), schemes: Sequence[str] = ("pair",), label: str = "label", **kw) -> DataFrame:
    """Metrics of all variants x learners x schemes."""
    return metrics(cv_predictions(df, variants, schemes, label, learners, **kw), ["variant", "learner", "scheme"])


def family_gain(table: DataFrame, family: Column, base: str, metric: str = "f1") -> DataFrame:
    """Best variant per family and its gain over a base family in percent."""
    best = table.withColumn("family", family).groupBy("family").agg(
        F.max(metric).alias("best"), F.min_by("variant", F.struct(-F.col(metric), F.col("variant"))).alias("variant"))
    b = F.max(F.when(F.col("family") == base, F.col("best"))).over(W.partitionBy(F.lit(0)))
    return best.withColumn("gain_pct", F.when(b > 0, (F.col("best") - b) / b * 100))


def threshold_baselines(df: DataFrame, features: Sequence[str], scheme: str = "pair", label: str = "label", vote: int = 3, needed: int = 2) -> DataFrame:
    """Single-feature rules tuned per fold on the other folds, and the vote of the three best, in one job.

    (fold, feature) are keys; a row joins every fold it trains, and fold tables are small.
    """
    df = cut_lineage(df)
    fold = F.concat_ws("__", *SCHEMES[scheme])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    lng = df.select(fold.alias("own"), "task", "model", "level", F.col(label).alias("y"), F.explode(pairs).alias("_p")).select("own", "task", "model", "level", "y", "_p.*")
    folds = group_folds(df, scheme, label).where("usable").select("fold")
    all_folds = folds.agg(F.collect_list("fold").alias("_fs"))
    train = lng.withColumn("_k", F.lit(0)).join(all_folds.withColumn("_k", F.lit(0)), "_k").withColumn("fold", F.explode("_fs")).where("fold <> own")
    rule = best_threshold(train, ["fold", "feature"], "value", "y")
    test = lng.withColumnRenamed("own", "fold").join(rule.withColumnRenamed("f1", "train_f1"), ["fold", "feature"])
    hit = F.when(F.col("direction") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    test = test.withColumn("y_hat", F.coalesce(hit, F.lit(False)).cast("int"))
    rank = F.row_number().over(W.partitionBy("fold").orderBy(F.col("f1").desc(), "feature"))
    top = rule.withColumn("_r", rank).where(F.col("_r") <= vote).select("fold", "feature")
    voted = test.join(top, ["fold", "feature"]).groupBy("fold", "task", "model", "level", "y").agg((F.sum("y_hat") >= needed).cast("int").alias("y_hat"))
    single = test.select("feature", F.col("y").alias("label"), "y_hat")
    both = single.unionByName(voted.select(F.lit("vote").alias("feature"), F.col("y").alias("label"), "y_hat"))
    return classification_metrics(both, ["feature"])


def ablation(df: DataFrame, base: Sequence[str], extra: Sequence[str], scheme: str = "pair", learner: str = "logistic", label: str = "label", **kw) -> DataFrame:
    """Base set, base plus each extra feature, everything, and everything minus each feature."""
    full = [*base, *extra]
    sets = {"base": list(base), "full": full} | {f"plus_{c}": [*base, c] for c in extra} | {f"minus_{c}": [x for x in full if x != c] for c in full if len(full) > 1}
    return compare_variants(df, sets, (learner,), (scheme,), label, **kw)


def forward_select(df: DataFrame, features: Sequence[str], scheme: str = "pair", learner: str = "logistic", share: float = 0.95, label: str = "label", **kw) -> DataFrame:
    """Greedy feature order until the given share of the full F1 is reached: step, feature, f1, full_f1.

    The candidates of a step are variants of one validation, so a step is as many jobs as one fit.
    """
    df = cut_lineage(df)
    full, chosen, path = None, [], []
    while len(chosen) < len(features):
        sets = {c: [*chosen, c] for c in features if c not in chosen} | ({"": list(features)} if full is None else {})
        got = {r["variant"]: r["f1"] for r in classification_metrics(cv_predictions(df, sets, (scheme,), label, (learner,), **kw).withColumnRenamed("y", "label"), ["variant"]).collect()}  # one number a candidate
        full = got.get("", full)
        name = max((c for c in sets if c), key=lambda c: (round(got[c], 12), -list(features).index(c)))
        chosen.append(name)
        path.append((len(chosen), name, got[name], full))
        if got[name] >= share * full:
            break
    return df.sparkSession.createDataFrame(path, "step int, feature string, f1 double, full_f1 double")


def permutation_control(df: DataFrame, features: Sequence[str], p: int = 100, scheme: str = "pair", learner: str = "logistic", label: str = "label", add_one: bool = False, **kw) -> DataFrame:
    """Shuffle each feature inside its task, evaluate again: p = share of permuted F1 at or above the observed one.

    The replicates are rows of one table and are validated together.
    """
    row = F.concat_ws("|", "task", "model", F.lpad(F.col("level").cast("string"), 9, "0"))
    keep = ["task", "model", "level", label]
    seen = cut_lineage(df.select(*keep, *features, row.alias("_id")))
    each = seen.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    shuffled = permute_within(each, features, ["_rep", "task"], "_id", F.col("_rep")).withColumn("_rep", F.col("_rep").cast("string")).drop("_id")
    both = shuffled.unionByName(seen.select(*keep, *features, F.lit("observed").alias("_rep")))
    runs = classification_metrics(cv_predictions(both, {"all": features}, (scheme,), label, (learner,), rep=F.col("_rep"), **kw).withColumnRenamed("y", "label"), ["rep"])
    observed = F.max(F.when(F.col("rep") == "observed", F.col("f1"))).over(W.partitionBy())
    runs = runs.select("rep", "f1", observed.alias("observed")).where("rep <> 'observed'")  # one row a replicate
    hits = F.sum((F.round("f1", 12) >= F.round("observed", 12)).cast("long"))
    share = (hits + 1) / (F.count(F.lit(1)) + 1) if add_one else hits / F.count(F.lit(1))
    return runs.agg(F.max("observed").alias("observed"), F.avg("f1").alias("permuted_mean"), share.alias("p_value"), (F.max("observed") - F.avg("f1")).alias("drop"), F.count(F.lit(1)).alias("n_perm"))


def few_shot_curve(df: DataFrame, features: Sequence[str], target: str, ks: Sequence[int] = (0, 2, 5, 10), seeds: Iterable[int] = range(3), label: str = "label", goal: float = 0.8, row: Column | None = None) -> DataFrame:
    """k rows of the target task join the training set; mean, std and interval of F1 over seeds, and the smallest k at the goal.

    (seed, k) are schemes of one validation, so a row is stored once; what differs between them are the first rows of the target task in
    each seed's order.
    """
    row, seeds, ks = F.concat_ws("|", "model", F.col("level").cast("string")) if row is None else row, [int(s) for s in seeds], [int(k) for k in ks]
    rows = cut_lineage(df.select("task", label, *features, row.alias("_row"), F.monotonically_increasing_id().alias("_at")))
    is_target = F.coalesce(F.col("task") == target, F.lit(False))
    order = W.partitionBy("_seed").orderBy(hash32(F.col("_seed"), F.col("_row")), "_row", "_at")
    drawn = rows.where(is_target).select("_row", "_at", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("_seed")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(ks))
    places = cut_lineage(drawn.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("_seed", "_r"))).alias("_places")))
    known = rows.join(places, "_at", "left")
    held = {f"{s}|{k}": F.when(is_target & (F.coalesce(F.col("_places")[F.lit(s)], F.lit(2**31 - 1)) > k), "test").otherwise("train") for s in seeds for k in ks}
    pred = cross_validate(known, {"all": list(features)}, held, label, held="test")
    runs = classification_metrics(pred.select("scheme", F.col("y").alias("label"), "y_hat"), ["scheme"]).withColumn("k", F.split("scheme", "\\|")[1].cast("int"))
    n = F.count(F.lit(1)).cast("double")
    out = runs.groupBy("k").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), (1.96 * F.stddev_pop("f1") / F.sqrt(n)).alias("ci95"))
    return out.withColumn("min_k", F.min(F.when(F.col("mean_f1") >= goal, F.col("k"))).over(W.partitionBy()))


def noise_sensitivity(df: DataFrame, features: Sequence[str], sizes: Sequence[int] = (10, 20, 30, 50), base: int = 50, repeats: int = 3, scheme: str = "pair", learner: str = "forest", label: str = "label", **kw) -> DataFrame:
    """F1 when standardised features carry the noise of smaller samples, N(0, sqrt(1/N - 1/base)); smallest N at 90 %.

    (size, repeat) are replicates of one validation; size ``base`` is without noise.
    """
    row = F.concat_ws("|", "task", "model", F.col("level").cast("string"))
    runs = F.array(*[F.struct(F.lit(int(n)).alias("n"), F.lit(r).alias("r"), F.lit((1.0 / n - 1.0 / base) ** 0.5).alias("sd")) for n in sizes if n != base for r in range(repeats)],
                   F.struct(F.lit(base).alias("n"), F.lit(0).alias("r"), F.lit(0.0).alias("sd")))
    seen = df.select("task", "model", "level", label, *features, row.alias("_row"), F.explode(runs).alias("_run"))
    noisy = seen.withColumns({c: F.when(F.col("_run.sd") == 0, F.col(c)).otherwise(F.col(c) + F.col("_run.sd") * normal(F.col("_run.r"), F.col("_run.n"), F.lit(c), F.col("_row"))) for c in features})
    pred = cv_predictions(noisy, {"all": features}, (scheme,), label, (learner,), rep=F.concat_ws("|", "_run.n", "_run.r"), **kw)
    f1 = classification_metrics(pred.withColumnRenamed("y", "label"), ["rep"]).withColumn("n", F.split("rep", "\\|")[0].cast("int"))
    per = f1.groupBy("n").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))
    ref = F.max(F.when(F.col("n") == base, F.col("mean_f1"))).over(W.partitionBy())
    out = per.withColumn("ratio", F.when(ref > 0, F.col("mean_f1") / ref).otherwise(0.0)).where(F.col("n").isin([int(n) for n in sizes]))
    return out.withColumn("min_n", F.coalesce(F.min(F.when(F.col("ratio") >= 0.9, F.col("n"))).over(W.partitionBy()), F.lit(base)))


def feature_importance(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42) -> DataFrame:
    model = fit_forest(cut_lineage(df), features, label, trees, seed).stages[-1]
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def pooled_cv_small(df: DataFrame, features: Sequence[str], baseline: str, label: str = "label", seed: int = 42, folds: int | None = None) -> DataFrame:
    """Stratified k folds (at most five, and no more than the smaller class) of the model against one indicator, and each row left out alone.

    One row per (scheme ``stratified`` or ``row``, model or baseline).
    """
    row = F.concat_ws("|", "task", "model", F.col("level").cast("string"))
    rows = cut_lineage(df.select(label, *dict.fromkeys([*features, baseline]), row.alias("_row")))
    n = rows.agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q")).first()
    k = folds or max(2, min(5, n["p"], n["q"]))
    rank = F.row_number().over(W.partitionBy(label).orderBy(hash32(seed, F.col("_row")), "_row"))
    dealt = cut_lineage(rows.withColumn("_fold", (rank % k).cast("int")))
    sets = {"model": list(features), "baseline": [baseline]}
    parts = cross_validate(dealt, sets, {"stratified": F.col("_fold"), "row": F.col("_row")}, label, min_test=1)
    return metrics(parts.withColumnRenamed("variant", "which"), ["scheme", "which"])


def independence_summary(scores: DataFrame) -> DataFrame:
    """One row from (variant, f1) of indicators, level_only and random sets: contribution ratio, lifts, verdict."""
    def of(n):
        return F.max(F.when(F.col("variant") == n, F.col("f1")))

    out = scores.agg(of("indicators").alias("f1_ind"), of("level_only").alias("f1_level"), of("random").alias("f1_random"), of("dynamics").alias("f1_dyn"))
    ratio = F.when(F.col("f1_level") > 0, F.col("f1_ind") / F.col("f1_level")).otherwise(0.0)
    lift = F.col("f1_ind") - F.col("f1_random")
    return out.withColumns({"contribution_ratio": ratio, "lift_over_random": lift, "dynamics_lift": F.col("f1_dyn") - F.col("f1_ind")}).withColumn(
        "verdict", F.when((ratio >= 0.9) & (lift > 0.1), "independent").when(lift > 0.1, "partly independent").otherwise("not independent"))


def single_feature_signal(df: DataFrame, features: Sequence[str], label: str = "label", limit: float = 0.1) -> DataFrame:
    """Kendall tau of every feature with the label, and whether any exceeds the limit."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    lng = df.select(F.col(label).alias("_y"), F.explode(pairs).alias("_p")).select("_y", "_p.*")
    t = kendall(lng, ["feature"], "value", "_y", p_value=False)
    return t.withColumn("any_signal", F.max((F.abs("tau") > limit).cast("int")).over(W.partitionBy(F.lit(0))) == 1)


def task_scaled_lr(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Standardise inside each task (population std), plain logistic, leave one pair out."""
    z = df.na.fill(0.0, list(features)).withColumns({c: N.zscore(c, ["task"], "pop") for c in features})
    return evaluate(z, features, "pair", "logistic", label, balanced=False)
