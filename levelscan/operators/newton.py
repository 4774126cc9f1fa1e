"""Many logistic regressions at once: every fold, variant and replicate of a validation in one sequence of Newton rounds.

A round is one Spark job whatever the number of models.  Tasks keep rows as matrices and meet them with the coefficients of all
models of their replicate, a row's own fold left out; they send one sum per model and coefficient pair, which Spark adds up.
Only coefficients and these sums (models x features^2) pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from levelscan.plans.session import cut_lineage

MIN_TRAIN, MIN_TEST = 5, 2
TOLERANCE = 1e-9   # of a step in the coefficients of standardised features
MAX_ROUNDS = 200   # a fit that has not met the tolerance by then is an error, not a result


@dataclass
class Models:
    """The models of one (replicate, variant, scheme), one per held-out fold."""

    rep: str
    variant: str
    scheme: int
    cols: np.ndarray                      # places of the variant's features
    low: np.ndarray                       # the features' least values: counted from there, a large mean doesn't cancel against the intercept
    c: float
    folds: dict[str, int]                 # held-out fold: row in the arrays below
    frame: np.ndarray                     # (models, d+1, d+1): takes (1, x - low) to (1, standardised x)
    weights: np.ndarray                   # (models, 2): of a negative and of a positive row
    whole: bool                           # nothing is held out: all rows train, and are predicted by, the one model
    first: int = 0                        # number of the first model
    coef: np.ndarray = field(default=None)    # accepted coefficients of standardised features, intercept first
    trial: np.ndarray = field(default=None)   # where the sums are taken next
    loss: np.ndarray = field(default=None)
    done: np.ndarray = field(default=None)

    def raw(self, coef: np.ndarray) -> np.ndarray:
        return np.einsum("mij,mj->mi", self.frame, coef)


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of the texts of a column, and the texts."""
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def _per_replicate(batch: pa.RecordBatch, models: dict[str, list[Models]]) -> Iterator[tuple[Models, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(models, places of the rows, own model or -1, y, (1, x - low)) for each replicate in the batch and each of its model groups."""
    if not batch.num_rows:
        return
    rep, reps = _coded(batch.column("_rep"))
    own, folds = _coded(batch.column("_own").flatten())
    y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.float64)
    own, x = own.reshape(len(y), -1), batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    for r in sorted(reps):
        at = np.flatnonzero(rep == reps.index(r))
        for m in models.get(r, ()):
            held = np.array([m.folds.get(f, -1) for f in folds], np.int64)[own[at, m.scheme]]
            yield m, at, held, y[at], np.concatenate([np.ones((len(at), 1)), x[at][:, m.cols] - m.low], 1)


def prepare(df: DataFrame, features: Sequence[str], schemes: Mapping[str, Column | None], label: str, rep: Column, carry: Sequence[str]) -> DataFrame:
    """The stored rows of a validation: replicate, own fold per scheme, label, features (missing ones 0) and the columns to carry along.

    A scheme without an expression holds nothing out: its one model trains on and predicts all rows.
    """
    own = F.array(*[F.lit("") if e is None else F.coalesce(e.cast("string"), F.lit("null")) for e in schemes.values()])
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for f in features])
    return cut_lineage(df.where(F.col(label).isNotNull()).select(rep.cast("string").alias("_rep"), own.alias("_own"), F.col(label).cast("double").alias("_y"), x.alias("_x"), *carry))


def training_sets(data: DataFrame, features: Sequence[str], variants: Mapping[str, tuple[Sequence[str], float]], schemes: Mapping[str, Column | None], balanced: bool, min_test: int = MIN_TEST, held: str | None = None) -> list[Models]:
    """Standardisation and class weights of every usable model: sums of all rows less those of the model's own fold.

    A fold is used if it leaves 5 rows of both classes to train on and has ``min_test`` rows itself, and, with ``held``, if it has that name.
    """
    k = range(len(features))
    centre = data.agg(*[F.avg(F.col("_x")[j]).alias(f"m{j}") for j in k], *[F.min(F.col("_x")[j]).alias(f"l{j}") for j in k]).first()
    if centre is None or (len(features) and centre[0] is None):
        return []
    mid, low = np.array(centre, np.float64).reshape(2, len(features))  # sums of squares are taken about the overall means
    folds = data.select("_rep", "_y", "_x", F.posexplode("_own").alias("_s", "_fold"))
    dev = [F.col("_x")[j] - F.lit(float(mid[j])) for j in k]
    sums = folds.groupBy("_rep", "_s", "_fold").agg(F.count("*").cast("double"), F.sum("_y"), *[F.sum(d) for d in dev], *[F.sum(d * d) for d in dev])
    groups: dict[tuple[str, int], dict[str, np.ndarray]] = {}
    for r in sums.collect():
        groups.setdefault((r[0], r[1]), {})[r[2]] = np.array(r[3:], np.float64)
    kept_whole = [e is None for e in schemes.values()]
    place = {f: j for j, f in enumerate(features)}
    out: list[Models] = []
    for (rep, scheme), by_fold in sorted(groups.items()):
        total = sum(by_fold.values())
        for variant, (names, c) in variants.items():
            cols = np.array([place[f] for f in names], np.int64)
            frames, weights, usable = [], [], {}
            for fold, own in sorted(by_fold.items()):
                if held is not None and fold != held:
                    continue
                train = total if kept_whole[scheme] else total - own
                n, pos = train[:2]
                if n < MIN_TRAIN or own[0] < min_test or not 0 < pos < n:
                    continue
                shift = train[2 + cols] / n
                mean = mid[cols] + shift
                var = train[2 + len(features) + cols] / n - shift**2
                scale = np.where(var > 1e-18 * (1 + mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
                frame = np.zeros((len(cols) + 1, len(cols) + 1))
                frame[0, 0] = 1
                frame[0, 1:] = -(mid[cols] - low[cols] + shift) / scale
                frame[1:, 1:] = np.diag(1 / scale)
                usable[fold] = len(frames)
                frames.append(frame)
                weights.append([n / (2 * (n - pos)), n / (2 * pos)] if balanced else [1.0, 1.0])
            if frames:
                out.append(Models(rep, variant, scheme, cols, low[cols], c, usable, np.array(frames), np.array(weights), kept_whole[scheme]))
    return out


def newton(data: DataFrame, models: list[Models]) -> int:
    """Fit all models; the number of rounds.  Penalty |coefficients|^2 / 2 without the intercept, loss times c.

    Newton steps that do not lower the loss are halved.  Models that have converged drop out of later rounds.
    """
    spark, first = data.sparkSession, 0
    for m in models:
        n, d = m.weights.shape[0], len(m.cols) + 1
        m.first, first = first, first + n
        m.coef, m.trial = np.zeros((n, d)), np.zeros((n, d))
        m.loss, m.done = np.full(n, np.inf), np.zeros(n, bool)
    for rounds in range(1, MAX_ROUNDS + 1):
        open_models: dict[str, list[Models]] = {}
        for m in models:
            if not m.done.all():
                open_models.setdefault(m.rep, []).append(m)
        if not open_models:
            return rounds - 1
        sent = spark.sparkContext.broadcast(open_models)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            acc: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, _, held, y, x in _per_replicate(batch, sent.value):
                    live = np.flatnonzero(~m.done)
                    f = x @ m.raw(m.trial)[live].T
                    w = np.where(y[:, None] > 0.5, m.weights[live, 1], m.weights[live, 0]) * (m.whole | (held[:, None] != live))
                    p = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
                    loss = (w * (np.logaddexp(0, f) - y[:, None] * f)).sum(0)
                    grad = (w * (p - y[:, None])).T @ x
                    hess = (w * p * (1 - p)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(y), -1)
                    for i, row in zip(live.tolist(), np.concatenate([loss[:, None], grad, hess], 1), strict=True):
                        acc[m.first + i] = acc[m.first + i] + row if m.first + i in acc else row
            if acc:
                width = [len(v) for v in acc.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(acc), width), pa.int64()), pa.array(np.concatenate([np.arange(w) for w in width]), pa.int32()), pa.array(np.concatenate(list(acc.values())), pa.float64())], ["model", "at", "value"])

        table = data.select("_rep", "_own", "_y", "_x").mapInArrow(sums, "model bigint, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).toArrow()
        number, at, value = (table.column(c).to_numpy() for c in ("model", "at", "value"))
        order = np.lexsort((at, number))
        starts = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
        got = dict(zip(number[order][starts].tolist(), np.split(value[order], starts[1:]), strict=True))
        for m in models:
            d = len(m.cols) + 1
            penalty = np.r_[0.0, np.ones(d - 1)]
            for i in np.flatnonzero(~m.done):
                s, trial = got[m.first + i], m.trial[i]
                loss = m.c * s[0] + 0.5 * (penalty * trial**2).sum()
                if loss > m.loss[i] + 1e-12 * (1 + abs(loss)):
                    m.trial[i] = (m.coef[i] + trial) / 2
                    m.done[i] = np.abs(m.trial[i] - m.coef[i]).max() < TOLERANCE
                    continue
                frame = m.frame[i]
                grad = m.c * frame.T @ s[1:1 + d] + penalty * trial
                hess = m.c * frame.T @ s[1 + d:].reshape(d, d) @ frame + np.diag(penalty)
                step = np.linalg.solve(hess, grad)
                m.coef[i], m.loss[i], m.trial[i] = trial, loss, trial - step
                if np.abs(step).max() < TOLERANCE:
                    m.coef[i], m.done[i] = m.trial[i], True
        sent.unpersist()
    raise RuntimeError(f"{sum((~m.done).sum() for m in models)} fits have not converged")


def held_out(data: DataFrame, models: list[Models], schemes: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Each row's probability under the models that did not train on it: rep, variant, scheme, fold, c, y, p, y_hat and carried columns."""
    by_rep: dict[str, list[Models]] = {}
    for m in models:
        by_rep.setdefault(m.rep, []).append(m)
    sent = data.sparkSession.sparkContext.broadcast(by_rep)
    kinds = ", ".join(f"`{c}` {t}" for c, t in data.dtypes if c in carry)
    along, schemes = [c for c in data.columns if c in carry], list(schemes)
    schema = "rep string, variant string, scheme string, fold string, c double, y int, p double" + (f", {kinds}" if kinds else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, at, held, y, x in _per_replicate(batch, sent.value):
                told = np.flatnonzero(held >= 0)
                f = (x[told] * m.raw(m.coef)[held[told]]).sum(1)
                n, names = len(told), np.array(list(m.folds), object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m.rep] * n, pa.string()), pa.array([m.variant] * n, pa.string()), pa.array([schemes[m.scheme]] * n, pa.string()), pa.array(names[held[told]], pa.string()),
                     pa.array(np.full(n, m.c)), pa.array(y[told].astype(np.int32)), pa.array(1 / (1 + np.exp(-np.clip(f, -700, 700)))), *[batch.column(c).take(pa.array(at[told])) for c in along]],
                    ["rep", "variant", "scheme", "fold", "c", "y", "p", *along])

    return data.mapInArrow(run, schema).withColumn("y_hat", (F.col("p") >= 0.5).cast("int"))


def cross_validate(
    df: DataFrame, variants: Mapping[str, Sequence[str] | tuple[Sequence[str], float]], schemes: Mapping[str, Column | None], label: str = "label",
    rep: Column | None = None, carry: Sequence[str] = (), balanced: bool = True, min_test: int = MIN_TEST, held: str | None = None,
) -> DataFrame:
    """Held-out predictions of logistic regressions for all variants x schemes x folds x replicates, in a fixed number of jobs.

    ``variants`` name feature lists, or pairs of a feature list and C (1 otherwise); ``schemes`` give the expression of a row's fold, or
    None to train on all rows; ``rep`` names the replicate a row belongs to.  Features are standardised on the training rows (population
    deviation; constant features stay), missing ones count as 0, classes weigh n / (2 n_class).  Rows without a label take no
    part.  A replicate or scheme without a usable fold has no rows.  ``held`` names the one fold to hold out, where the others only train.
    """
    chosen = {n: (list(v[0]), float(v[1])) if isinstance(v, tuple) and isinstance(v[1], float) else (list(v), 1.0) for n, v in variants.items()}
    features = sorted({f for names, _ in chosen.values() for f in names})
    data = prepare(df, features, schemes, label, F.lit("") if rep is None else rep, carry)
    models = training_sets(data, features, chosen, schemes, balanced, min_test, held)
    newton(data, models)
    return held_out(data, models, list(schemes), carry)
