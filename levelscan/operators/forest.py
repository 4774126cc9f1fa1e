"""Random forests for every fold, variant and replicate of a validation: one job trains them, one predicts.

Trees are trained on at most ``rows`` rows (a documented bound; level tables are far smaller), dealt to tasks by model; every row is predicted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from levelscan.operators.newton import MIN_TEST, MIN_TRAIN, prepare

ROWS = 50_000  # rows that forests are trained on at most; more are thinned by a hash of the row
DEPTH = 5      # levels of a tree: 31 questions, 32 leaves


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, draw: np.random.Generator, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, leaf value) of one tree in heap order.

    Each node looks at sqrt(features) of them and takes the cut of least weighted Gini impurity; a node that gains nothing sends
    all its rows to the left.
    """
    n_features = x.shape[1]
    tried = max(1, int(np.sqrt(n_features)))
    feature, cut = np.zeros(2**depth - 1, np.int16), np.full(2**depth - 1, np.inf)
    leaf, rows = np.full(2**depth, 0.5), {0: np.flatnonzero(w > 0)}
    for node in range(2**depth - 1):
        at = rows.pop(node, np.zeros(0, np.int64))
        best = None
        pos, total = (w[at] * y[at]).sum(), w[at].sum()
        if len(at) > 1 and 0 < pos < total:
            for f in draw.choice(n_features, tried, replace=False):
                order = at[np.argsort(x[at, f], kind="stable")]
                v = x[order, f]
                ends = np.flatnonzero(v[1:] > v[:-1])
                if not len(ends):
                    continue
                left, left_pos = np.cumsum(w[order])[ends], np.cumsum(w[order] * y[order])[ends]
                right, right_pos = total - left, pos - left_pos
                impurity = left_pos * (left - left_pos) / left + right_pos * (right - right_pos) / np.maximum(right, 1e-300)
                i = int(np.argmin(impurity))
                if best is None or impurity[i] < best[0]:
                    best = (impurity[i], f, (v[ends[i]] + v[ends[i] + 1]) / 2)
        if best is not None and best[0] < pos * (total - pos) / total - 1e-12:
            feature[node], cut[node] = best[1], best[2]
        goes_right = x[at, feature[node]] > cut[node]
        for child, part in ((2 * node + 1, at[~goes_right]), (2 * node + 2, at[goes_right])):
            if child < 2**depth - 1:
                rows[child] = part
            elif len(part):
                leaf[child - 2**depth + 1] = (w[part] * y[part]).sum() / w[part].sum()
    return feature, cut, leaf


def probability(forest: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean leaf value over the trees."""
    feature, cut, leaf = forest
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for f, c, v in zip(feature, cut, leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(f):  # all rows are on one level
            node = 2 * node + 1 + (x[rows, f[node]] > c[node])
        total += v[node - len(f)]
    return total / len(feature)


def _seed(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def cross_validate_forest(
    df: DataFrame, variants: Mapping[str, Sequence[str]], schemes: Mapping[str, Column], label: str = "label", rep: Column | None = None, carry: Sequence[str] = (),
    trees: int = 50, seed: int = 42, balanced: bool = True, rows: int = ROWS,
) -> DataFrame:
    """Held-out predictions of random forests: rep, variant, scheme, fold, y, p, y_hat and the carried columns (see newton.cross_validate).

    A fold is used if it leaves 5 training rows of both classes and has 2 rows itself.  Bootstrap draws are seeded by
    variant, scheme, fold and tree, so retries give the same trees.
    """
    spark = df.sparkSession
    names = list(variants)
    features = sorted({f for v in variants.values() for f in v})
    cols = {n: np.array([features.index(f) for f in variants[n]], np.int64) for n in names}
    data = prepare(df, features, schemes, label, F.lit("") if rep is None else rep, carry)
    n = data.count()
    at = F.xxhash64("_rep", "_own", "_y", "_x")
    few = data if n <= rows else data.where(at <= int(2**64 * 0.9 * rows / n) - 2**63).limit(rows)
    got = few.select("_rep", "_own", "_y", "_x").orderBy(at, "_rep", "_own", "_y", "_x").toArrow().combine_chunks()
    rep_of = np.array(got.column("_rep").to_pylist(), object)
    own = np.array(got.column("_own").to_pylist(), object).reshape(len(rep_of), len(schemes))
    y, x = np.array(got.column("_y").to_pylist()), np.array(got.column("_x").to_pylist(), np.float64).reshape(len(rep_of), len(features))
    folds = []
    for r in sorted(set(rep_of.tolist())):
        mine = rep_of == r
        for s, scheme in enumerate(schemes):
            for fold in sorted(set(own[mine, s].tolist())):
                test = mine & (own[:, s] == fold)
                train = mine & ~test
                if train.sum() >= MIN_TRAIN and test.sum() >= MIN_TEST and 0 < y[train].sum() < train.sum():
                    folds.append((r, s, scheme, fold))
    jobs = [(v, *f) for v in names for f in folds]
    out_schema = "rep string, variant string, scheme string, fold string, y int, p double"
    kinds = ", ".join(f"`{c}` {t}" for c, t in data.dtypes if c in carry)
    along, width = [c for c in data.columns if c in carry], len(features)
    if not jobs:
        return spark.createDataFrame([], out_schema + (f", {kinds}" if kinds else "") + ", y_hat int")
    sent = spark.sparkContext.broadcast((rep_of, own, y, x))  # at most ``rows`` rows

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep_of, own, y, x = sent.value
        for part in parts:
            for v, r, s, scheme, fold in part.itertuples(index=False):
                at = np.flatnonzero((rep_of == r) & (own[:, s] != fold))
                yy, xx = y[at], x[at][:, cols[v]]
                n, pos = len(at), yy.sum()
                share = np.where(yy > 0.5, n / (2 * pos), n / (2 * (n - pos))) if balanced else np.ones(n)
                grown = []
                for t in range(trees):
                    draw = np.random.default_rng(_seed(seed, v, r, scheme, fold, t))
                    grown.append(grow(xx, yy, share * np.bincount(draw.integers(0, n, n), minlength=n), draw))
                f, c, leaf = (np.stack(a) for a in zip(*grown, strict=True))
                yield pd.DataFrame({"variant": [v], "rep": [r], "s": [s], "scheme": [scheme], "fold": [fold], "feature": [f.tobytes()], "cut": [c.tobytes()], "leaf": [leaf.tobytes()]})

    tasks = min(len(jobs), 4 * spark.sparkContext.defaultParallelism)
    asked = spark.createDataFrame(jobs, "variant string, rep string, s int, scheme string, fold string").repartition(tasks, F.hash("variant", "rep", "scheme", "fold"))
    trained: dict[tuple, dict[str, tuple]] = {}
    for r in asked.mapInPandas(train, "variant string, rep string, s int, scheme string, fold string, feature binary, cut binary, leaf binary").collect():  # 28 kB a model of 50 trees
        forest = (np.frombuffer(r["feature"], np.int16).reshape(trees, -1), np.frombuffer(r["cut"]).reshape(trees, -1), np.frombuffer(r["leaf"]).reshape(trees, -1))
        trained.setdefault((r["rep"], r["variant"], r["s"], r["scheme"]), {})[r["fold"]] = forest
    models = spark.sparkContext.broadcast(trained)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep_of, own = np.array(batch.column("_rep").to_pylist(), object), batch.column("_own").to_pylist()
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.int32)
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            for (r, v, s, scheme), by_fold in models.value.items():
                fold_of = np.array([o[s] for o in own], object)
                for fold in sorted(set(fold_of[rep_of == r].tolist()) & set(by_fold)):
                    at = np.flatnonzero((rep_of == r) & (fold_of == fold))
                    p = probability(by_fold[fold], x[at][:, cols[v]])
                    k = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a] * k, pa.string()) for a in (r, v, scheme, fold)] + [pa.array(y[at]), pa.array(p)] + [batch.column(c).take(pa.array(at)) for c in along],
                        ["rep", "variant", "scheme", "fold", "y", "p", *along])

    return data.mapInArrow(predict, out_schema + (f", {kinds}" if kinds else "")).withColumn("y_hat", (F.col("p") >= 0.5).cast("int"))
