"""Distribution indicators of vector groups: principal component, clusters, silhouette, dip, mixture.

Groups are (series, level) cells of a response table.  Everything that can be a sum over rows is one
(see ``vectors``); iterative fits keep only their small parameter tables between rounds and read the
rows again, so a lost executor costs one round.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from levelscan.functions.special import dip_sf, normal_cdf
from levelscan.operators.aggregates import bimodality
from levelscan.operators.vectors import dot, group_pair_stats, group_vector_moments, moment_sums
from levelscan.plans.draws import normal
from levelscan.plans.prefix import average_ranks, running_sums
from levelscan.plans.session import cut_lineage

_AXIS = T.StructType([
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("axis", T.ArrayType(T.DoubleType())),
    T.StructField("lambda1", T.DoubleType()), T.StructField("trace", T.DoubleType()),
])


@F.pandas_udf(_AXIS)
def _leading_axis(n: pd.Series, s: pd.Series, g: pd.Series) -> pd.DataFrame:
    """Top eigenvector of a group's covariance (dim x dim) from its sums; sign: largest loading positive."""
    rows = []
    for count, total, gram in zip(n, s, g):
        mu = np.asarray(total) / count
        d = len(mu)
        if count < 2:
            rows.append((mu, np.zeros(d), 0.0, 0.0))
            continue
        cov = (np.asarray(gram).reshape(d, d) - count * np.outer(mu, mu)) / (count - 1)
        val, vec = np.linalg.eigh(cov)
        axis = vec[:, -1]
        axis = axis * (1.0 if axis[np.argmax(np.abs(axis))] > 0 else -1.0)
        rows.append((mu, axis, float(val[-1]), float(np.trace(cov))))
    return pd.DataFrame(rows, columns=["mean", "axis", "lambda1", "trace"])


def principal_axes(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean, first principal axis, its eigenvalue and the covariance trace per group (one pass over the rows)."""
    m = moment_sums(df, keys, vector, gram=True)
    return m.select(*keys, F.col("_n").alias("n"), _leading_axis("_n", "_s", "_g").alias("_a")).select(*keys, "n", "_a.*")


def pc1_scores(df: DataFrame, keys: Sequence[str], vector: str, axes: DataFrame | None = None, out: str = "pc1") -> DataFrame:
    """Adds the score on the group's first component; groups under four rows use their first coordinate."""
    axes = principal_axes(df, keys, vector) if axes is None else axes
    joined = df.join(axes.select(*keys, F.col("n").alias("_n"), F.col("mean").alias("_m"), F.col("axis").alias("_x")), list(keys))
    v = F.col(vector).cast("array<double>")
    score = dot(F.zip_with(v, "_m", lambda a, b: a - b), "_x")
    return joined.withColumn(out, F.when(F.col("_n") < 4, v[0]).otherwise(score)).drop("_n", "_m", "_x")


def pc1_variance(axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population variance of the scores and the explained share, straight from the eigenvalues."""
    return axes.select(
        *keys, (F.col("lambda1") * (F.col("n") - 1) / F.col("n")).alias("pc1_variance"),
        F.when(F.col("trace") > 0, F.col("lambda1") / F.col("trace")).otherwise(0.0).alias("pc1_variance_explained"),
    )


def bimodality_coefficient(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(bimodality(F.skewness(x), F.kurtosis(x), F.count(x)).alias("bimodality_coefficient"))


# ---- two clusters -------------------------------------------------------------------------------

def _centres(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """One row per group: centres c0, c1; a group whose rows all fell on one side keeps one centre twice."""
    per = rows.groupBy(*keys, "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("c"))
    wide = per.groupBy(*keys).agg(
        F.max(F.when(F.col("cluster") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("cluster") == 1, F.col("c"))).alias("c1"))
    return wide.select(*keys, F.coalesce("c0", "c1").alias("c0"), F.coalesce("c1", "c0").alias("c1"))


def _sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign_clusters(df: DataFrame, keys: Sequence[str], vector: str, centres: DataFrame) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.join(centres, list(keys)).withColumn("cluster", (_sq(v, F.col("c1")) < _sq(v, F.col("c0"))).cast("int")).drop("c0", "c1")


def _packed(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The vectors of a group as matrices of at most an Arrow batch, written once: ``_x`` (bytes) of ``_m`` rows."""
    parts = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    schema = T.StructType([*[f for f in parts.schema.fields if f.name in keys], T.StructField("_m", T.IntegerType()), T.StructField("_x", T.BinaryType())])

    def pack(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                yield pd.DataFrame([(*key, len(part), np.vstack(part["_v"].to_numpy()).tobytes())], columns=schema.names)

    return cut_lineage(parts.mapInPandas(pack, schema).withColumn("_h", F.xxhash64("_x")).repartition("_h").drop("_h"))


def _nearness(m: int, x: bytes, c: np.ndarray, live: np.ndarray):
    """Matrix of a packed row, its centres as (starts, 2, dim), and the squared distances (live starts, 2, rows)."""
    x = np.frombuffer(x, np.float64).reshape(m, -1)
    c = np.asarray(c, np.float64).reshape(len(live), 2, -1)
    d2 = np.empty((int(live.sum()), 2, m))
    for s, both in enumerate(c[live]):
        for k in (0, 1):
            y = x - both[k]
            d2[s, k] = np.einsum("ij,ij->i", y, y)
    return x, c, d2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _cluster_sums(m: pd.Series, x: pd.Series, c: pd.Series, live: pd.Series) -> pd.Series:
    """Per start and cluster: rows and vector sum under the given centres, flat; zeros for starts that are done."""
    out = []
    for mi, xi, ci, li in zip(m, x, c, live):
        li = np.asarray(li, bool)
        v, centres, d2 = _nearness(mi, xi, ci, li)
        one = d2[:, 1] < d2[:, 0]
        sums = np.zeros((len(li), 2, 1 + centres.shape[2]))
        for k, w in enumerate((~one, one)):
            sums[li, k, 0], sums[li, k, 1:] = w.sum(1), w.astype(np.float64) @ v
        out.append(sums.ravel())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inertias(m: pd.Series, x: pd.Series, c: pd.Series, live: pd.Series) -> pd.Series:
    """Per start: the sum of the squared distances to the nearer centre."""
    return pd.Series([_nearness(mi, xi, ci, np.ones(len(li), bool))[2].min(1).sum(1) for mi, xi, ci, li in zip(m, x, c, live)])


def _moved_centres(tol: float):
    @F.pandas_udf(T.StructType([T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("live", T.ArrayType(T.BooleanType()))]))
    def step(c: pd.Series, live: pd.Series, sums: pd.Series) -> pd.DataFrame:
        rows = []
        for ci, li, si in zip(c, live, sums):
            li = np.array(li, bool)
            if si is not None:
                old = np.array(ci, np.float64).reshape(len(li), 2, -1)
                s = np.asarray(si, np.float64).reshape(len(li), 2, -1)
                n = s[:, :, :1]
                mean = s[:, :, 1:] / np.where(n > 0, n, 1)
                mean = np.where(n > 0, mean, mean[:, ::-1])  # an empty cluster has the other's centre
                new = np.where(li[:, None, None], mean, old)
                moved = ((new - old) ** 2).sum(2) > tol * (new ** 2).sum((1, 2))[:, None]
                ci, li = new.ravel(), li & moved.any(1)
            rows.append((ci, li))
        return pd.DataFrame(rows, columns=["c", "live"])

    return step


def _ones(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which rows are nearer to c[1] than to c[0]; where the difference is lost in rounding, by the two distances themselves."""
    w, y = c[1] - c[0], x - (c[0] + c[1]) / 2
    side = y @ w
    one = side > 0
    close = np.flatnonzero(np.abs(side) <= 1e-9 * np.sqrt((y * y).sum(1) * (w @ w)))
    d2 = [((x[close] - k) ** 2).sum(1) for k in c]
    one[close] = d2[1] < d2[0]
    return one


def _near_rows(keys: list[str], share: int):
    """mapInPandas over packed rows with their group's state and size ``_n``: one row per live start.

    The rows nearest to the plane between the two centres go on as they are, ``share`` numbers a group at most (``_a``).  The others leave only their
    number and sum per cluster (``_s``), and what a plane may turn and shift before one of them changes sides: all have a distance from the plane of
    at least ``_tau`` times (1 + their distance from its foot, which is ``_lo`` to ``_hi``), in units of the distance between the centres.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                live, x = np.asarray(row["_live"], bool), np.frombuffer(row["_x"], np.float64).reshape(row["_m"], -1)
                m, dim = x.shape
                kept = min(m, share // dim * m // row["_n"] + 1)
                for start, c in enumerate(np.asarray(row["_c"], np.float64).reshape(len(live), 2, dim)):
                    if not live[start]:
                        continue
                    w, y = c[1] - c[0], x - (c[0] + c[1]) / 2
                    unit = max(np.sqrt(w @ w), 1e-300)
                    far = np.sqrt((y * y).sum(1)) / unit
                    score = np.nan_to_num(np.abs(y @ w) / unit ** 2 / (1 + far), nan=0.0)
                    order = np.argpartition(score, kept) if kept < m else np.arange(m)
                    near, rest = order[:kept], order[kept:]
                    one = _ones(x[rest], c)
                    sums = np.concatenate([np.r_[k.sum(), k.astype(np.float64) @ x[rest]] for k in (~one, one)])
                    safe = (score[rest].min(), far[rest].min(), far[rest].max()) if len(rest) else (np.inf, np.inf, -np.inf)
                    yield pd.DataFrame([(*row[keys], start, c.ravel(), sums, *safe, x[near].tobytes())], columns=[*keys, "_start", "_c", "_s", "_tau", "_lo", "_hi", "_a"])

    return run


def _rounds_of_near_rows(c: np.ndarray, n: np.ndarray, s: np.ndarray, tau: float, lo: float, hi: float, near: np.ndarray) -> tuple[np.ndarray, bool]:
    """Lloyd rounds on all rows, of which only the ``near`` ones can change sides: centres, and whether a round may still move them.

    ``n`` and ``s`` are numbers and sums of the other rows.  At least one round is made; the last is the one after which another row might change sides.
    """
    foot, w = (c[0] + c[1]) / 2, c[1] - c[0]
    unit = np.sqrt(w @ w)
    one = _ones(near, c)
    while True:
        side = np.stack([~one, one]).astype(np.float64)
        count = n + side.sum(1)
        mean = (s + side @ near) / np.where(count > 0, count, 1)[:, None]
        c = mean if (count > 0).all() else np.where(count[:, None] > 0, mean, mean[::-1])
        v = c[1] - c[0]
        if not v.any() or not np.isfinite(v).all():
            return c, False  # one centre: all rows are in cluster 0 from now on
        if lo <= hi:
            along = w @ v
            if along <= 0:
                return c, True
            turn = v * (along / (v @ v)) - w  # the plane has no length: the least change that gives its new direction
            angle, shift = np.sqrt(turn @ turn) / unit, abs((((c[0] + c[1]) / 2 - foot) @ v)) * (along / (v @ v)) / unit ** 2
            if min(tau * (1 + r) - (angle * r + shift) for r in (lo, hi)) <= 1e-9 * (1 + hi):
                return c, True
        now = _ones(near, c)
        if (now == one).all():
            return c, False
        one = now


def _settle(blocks: DataFrame, sizes: DataFrame, keys: list[str], state: DataFrame, share: int) -> DataFrame:
    """New state of ``_lloyd`` after as many rounds as the rows near the planes alone decide, all groups and starts at once."""
    working = F.exists("_live", lambda x: x)
    met = blocks.join(state.where(working).join(sizes, keys), keys).select(*keys, "_m", "_x", "_c", "_live", "_n")
    kf, dbl = [f for f in met.schema.fields if f.name in keys], T.DoubleType()
    start = T.StructField("_start", T.IntegerType())
    parts = met.mapInPandas(_near_rows(keys, share), T.StructType([*kf, start, *[T.StructField(x, T.ArrayType(dbl)) for x in ("_c", "_s")], *[T.StructField(x, dbl) for x in ("_tau", "_lo", "_hi")], T.StructField("_a", T.BinaryType())]))

    def rounds(key, pdf):
        c = np.asarray(pdf["_c"].iloc[0], np.float64).reshape(2, -1)
        s = np.vstack(pdf["_s"].to_numpy()).sum(0).reshape(2, -1)
        near = np.frombuffer(b"".join(pdf["_a"]), np.float64).reshape(-1, c.shape[1])
        c, live = _rounds_of_near_rows(c, s[:, 0], s[:, 1:], pdf["_tau"].min(), pdf["_lo"].min(), pdf["_hi"].max(), near)
        return pd.DataFrame([(*key, c.ravel(), live)], columns=[*keys, "_start", "_nc", "_on"])

    made = parts.groupBy(*keys, "_start").applyInPandas(rounds, T.StructType([*kf, start, T.StructField("_nc", T.ArrayType(dbl)), T.StructField("_on", T.BooleanType())]))
    made = made.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_start", F.struct("_nc", "_on")))).alias("_made"))
    each = F.sequence(F.lit(0), F.size("_live") - 1)
    dim = (F.size("_c") / F.size("_live")).cast("int")
    centres = F.transform(each, lambda i: F.coalesce(F.try_element_at("_made", i)["_nc"], F.slice("_c", i * dim + 1, dim)))
    return state.join(made, keys, "left").select(*keys, F.flatten(centres).alias("_c"), F.transform(each, lambda i: F.coalesce(F.try_element_at("_made", i)["_on"], F.lit(False))).alias("_live"))


def _lloyd(blocks: DataFrame, keys: list[str], centres: DataFrame, rounds: int | None, tol: float, share: int) -> DataFrame:
    """(keys, _c, _live) with the centres, flat, that no round moves any more, of all groups and starts at once.

    ``centres`` has one row (c0, c1) per group and ``_start``.  A round over all rows meets packed vectors with the centres of their group; only sums
    per start and cluster leave the tasks and only the centres are kept.  Between two of them come the rounds in which only rows near the plane
    between the centres can change sides: these rows, ``share`` numbers at most of a group and start, meet in one task and make rounds there until
    none moves or a row left out might (see ``_near_rows``).  The centres are those of plain rounds.  Starts that are done take no part in later rounds.
    """
    per = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_start", "c0", "c1"))).alias("_s"))
    state = cut_lineage(per.select(*keys, F.flatten(F.transform("_s", lambda s: F.concat(s["c0"], s["c1"]))).alias("_c"), F.transform("_s", lambda s: F.lit(True)).alias("_live")))
    sizes = cut_lineage(blocks.groupBy(*keys).agg(F.sum("_m").alias("_n")))
    step, working = _moved_centres(tol), F.exists("_live", lambda x: x)
    for done in itertools.count(1):
        met = blocks.join(state.where(working), keys).select(*keys, _cluster_sums("_m", "_x", "_c", "_live").alias("_s"))
        sums = met.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("_s"))).alias("_s"))
        state = cut_lineage(state.join(sums, keys, "left").select(*keys, step("_c", "_live", "_s").alias("_n")).select(*keys, F.col("_n.c").alias("_c"), F.col("_n.live").alias("_live")))
        if state.where(working).isEmpty():
            return state
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"two-means has not converged in {rounds} rounds over all rows")
        state = cut_lineage(_settle(blocks, sizes, keys, state, share))
        if state.where(working).isEmpty():
            return state


def _spread_starts(rows: DataFrame, keys: list[str], vector: str, seed: int) -> DataFrame:
    """k-means++ starts: c0 is a row drawn by hash, c1 another with chances in proportion to its squared distance from c0."""
    v = F.col(vector)
    first = rows.groupBy(*keys).agg(F.min_by(v, F.xxhash64(F.lit(seed), F.lit("c0"), *keys, v)).alias("c0"))
    chance = (F.pmod(F.xxhash64(F.lit(seed), F.lit("c1"), *keys, v), F.lit(2**52)) + 0.5) / float(2**52)
    away = rows.join(first, keys).withColumn("_d", _sq(v, F.col("c0"))).where("_d > 0")
    second = away.groupBy(*keys).agg(F.min_by(v, -F.ln(chance) / F.col("_d")).alias("c1"))
    return first.join(second, keys, "left").select(*keys, "c0", F.coalesce("c1", "c0").alias("c1"))


def kmeans2(df: DataFrame, keys: Sequence[str], vector: str, start: Column | None = None, starts: int = 10, rounds: int | None = None, tol: float = 1e-28, seed: int = 42, share: int = 2**22) -> DataFrame:
    """Two clusters per group by Lloyd rounds on all groups at once, run until none moves.

    From ``start`` (0/1 column), or the best of ``starts`` k-means++ starts, which run together as (group, start) keys: the least sum of squared
    distances stays (ties: the first start).  Of its centres the one with the smaller first component is cluster 0.  A group
    of equal vectors is one cluster.  ``rounds``: rounds over all rows at most, beyond which it is an error; ``share``: numbers
    of a group and start that meet in one task (see ``_lloyd``).
    """
    keys = list(keys)
    blocks = _packed(df, keys, vector)
    if start is not None:
        first = _centres(df.withColumn("cluster", start), keys, vector).withColumn("_start", F.lit(0))
    else:
        vectors = cut_lineage(df.select(*keys, F.col(vector).cast("array<double>").alias("_v")))
        first = _spread_starts(vectors.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))), [*keys, "_start"], "_v", seed)
    state = _lloyd(blocks, keys, first, rounds, tol, share)
    dim = (F.size("_c") / (2 * F.size("_live"))).cast("int")

    def centre(s, k):
        return F.slice("_c", (2 * s + k) * dim + 1, dim)

    if start is not None:
        return assign_clusters(df, keys, vector, state.select(*keys, centre(F.lit(0), 0).alias("c0"), centre(F.lit(0), 1).alias("c1")))
    inertia = blocks.join(state, keys).select(*keys, F.posexplode(_inertias("_m", "_x", "_c", "_live")).alias("_start", "_i")).groupBy(*keys, "_start").agg(F.sum("_i").alias("_sum"))
    best = inertia.groupBy(*keys).agg(F.min_by("_start", F.struct(F.round("_sum", 9), "_start")).alias("_start"))
    both = state.join(best, keys).select(*keys, F.array_sort(F.array(centre(F.col("_start"), 0), centre(F.col("_start"), 1))).alias("_b"))
    return assign_clusters(df, keys, vector, both.select(*keys, F.col("_b")[0].alias("c0"), F.col("_b")[1].alias("c1")))


def silhouette_squared(rows: DataFrame, keys: Sequence[str], vector: str, cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distances, linear in the rows.

    The sum of squared distances from x to a cluster is n|x|^2 - 2 x.sum + sum of |y|^2.  One cluster
    gives 0, a row alone in its cluster counts 0.
    """
    keys = list(keys)
    v = F.col(vector).cast("array<double>")
    base = rows.select(*keys, F.col(cluster).alias("_c"), v.alias("_v"), dot(v, v).alias("_q"))
    m = base.groupBy(*keys, "_c").agg(
        F.count(F.lit(1)).alias("_n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("_v")))).alias("_s"), F.sum("_q").alias("_qq"))
    wide = m.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col("_c") == k, 1)).alias(f"{c}{k}") for k in (0, 1) for c in ("_n", "_s", "_qq")])

    def total(k):
        return F.col(f"_n{k}") * F.col("_q") - 2 * dot("_v", f"_s{k}") + F.col(f"_qq{k}")

    j = base.join(wide, keys).withColumns({"_t0": total(0), "_t1": total(1)})
    zero = F.col("_c") == 0
    own, other = F.when(zero, F.col("_t0")).otherwise(F.col("_t1")), F.when(zero, F.col("_t1")).otherwise(F.col("_t0"))
    return _silhouette(j, keys, own, other, F.when(zero, F.col("_n0")).otherwise(F.col("_n1")), F.when(zero, F.col("_n1")).otherwise(F.col("_n0")))


def _silhouette(j: DataFrame, keys, own: Column, other: Column, n_own: Column, n_other: Column) -> DataFrame:
    a, b = own / (n_own - 1), other / n_other
    s = F.when(n_other.isNull() | (n_own <= 1), 0.0).when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette_k2"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x2, y2 = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    scale = x2 + y2
    d2 = x @ y.T
    d2 *= -2
    d2 += scale
    i, j = np.nonzero(d2 < 1e-7 * scale)  # the expanded form loses digits here
    dist = np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)
    for at in range(0, len(i), 65536):
        p, q = i[at:at + 65536], j[at:at + 65536]
        dist[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(1))
    return dist


def silhouette_k2(rows: DataFrame, keys: Sequence[str], row_id: str, vector: str, cluster: str = "cluster", block: int = 8192, tile: int = 256) -> DataFrame:
    """Mean Euclidean silhouette, exact.

    A group is cut into blocks of about ``block`` rows; each unordered pair of blocks is one task's work in numpy, ``tile`` rows against a
    block at a time, that leaves only per-row sums for both sides, so a large group is many equal tasks and no pair is emitted.
    Quadratic by nature: for very large groups use ``silhouette_squared``.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    base = rows.select(*keys, F.col(row_id).alias("_id"), F.col(cluster).alias("_c"), F.col(vector).cast("array<double>").alias("_v"))
    base = base.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    base = cut_lineage(base)  # the clusters are found once, not for either side
    left = base.withColumn("_j", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1))).select(*keys, F.col("_b").alias("_i"), "_j", "_id", "_c", "_v")
    rkeys = [f"_k{i}" for i in range(len(keys))]
    right = base.where("_b > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select(
        *[F.col(k).alias(r) for k, r in zip(keys, rkeys)], F.col("_i").alias("_ri"), F.col("_b").alias("_rj"), F.col("_id").alias("_rid"), F.col("_c").alias("_rc"), F.col("_v").alias("_rv"))
    fields = [f for f in left.schema.fields if f.name in (*keys, "_id", "_c")]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in ("t0", "t1", "n0", "n1")]])

    def block_sums(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = key[-2] == key[-1]
        if a.empty or (b.empty and not same):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        x, cx, ids = np.vstack(a["_v"].to_numpy()), a["_c"].to_numpy(), [a["_id"].to_numpy()]
        y, cy = (x, cx) if same else (np.vstack(b["_rv"].to_numpy()), b["_rc"].to_numpy())
        of_x, of_y = (np.stack([c == 0, c == 1], 1).astype(np.float64) for c in (cx, cy))
        to_y, to_x = np.empty((len(x), 2)), np.zeros((len(y), 2))
        for at in range(0, len(x), tile):
            dist = _distances(x[at:at + tile], y)
            to_y[at:at + tile] = dist @ of_y
            if not same:
                to_x += dist.T @ of_x[at:at + tile]
        sides = [(cx, to_y, of_y)]
        if not same:
            ids.append(b["_rid"].to_numpy())
            sides.append((cy, to_x, of_x))
        n = [len(t) for _, t, _ in sides]
        whole = {k: [v] * sum(n) for k, v in zip(keys, key)} | {"_id": np.concatenate(ids), "_c": np.concatenate([c for c, _, _ in sides])}
        whole |= {f"t{k}": np.concatenate([t[:, k] for _, t, _ in sides]) for k in (0, 1)} | {f"n{k}": np.repeat([o[:, k].sum() for _, _, o in sides], n) for k in (0, 1)}
        return pd.DataFrame(whole)[[f.name for f in schema.fields]]

    parts = left.groupBy(*keys, "_i", "_j").cogroup(right.groupBy(*rkeys, "_ri", "_rj")).applyInPandas(block_sums, schema)
    j = parts.groupBy(*keys, "_id", "_c").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "n0", "n1")])
    zero = F.col("_c") == 0
    nz = {k: F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")) for k in (0, 1)}
    return _silhouette(
        j, keys, F.when(zero, F.col("t0")).otherwise(F.col("t1")), F.when(zero, F.col("t1")).otherwise(F.col("t0")),
        F.when(zero, nz[0]).otherwise(nz[1]), F.when(zero, nz[1]).otherwise(nz[0]))


# ---- dip ----------------------------------------------------------------------------------------

def _hull_points(v: np.ndarray, f: np.ndarray, step: int | None = None) -> np.ndarray:
    """Corners of the greatest convex minorant of the points (v, f), v rising.

    Between neighbouring corners the point deepest under their chord is a corner too, and points on or above the chord are none, so all
    chords are searched at once; what 64 such rounds leave is folded point by point.  With ``step`` the corners of each stretch of so many
    points on its own; there, points that 64 rounds leave may be among them.
    """
    at = np.unique(np.r_[np.arange(0, len(v), step or max(len(v), 1)), len(v) - 1]) if len(v) else np.arange(0)
    inner = np.delete(np.arange(len(v)), at)
    for _ in range(64):
        a = np.searchsorted(at, inner) - 1
        left, right = at[a], at[a + 1]
        depth = (f[right] - f[left]) * (v[inner] - v[left]) - (f[inner] - f[left]) * (v[right] - v[left])
        under = depth > 0
        inner, a, depth = inner[under], a[under], depth[under]
        if not len(inner):
            return at
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        deepest = np.flatnonzero(depth == np.repeat(np.maximum.reduceat(depth, first), np.diff(np.r_[first, len(a)])))
        deepest = deepest[np.r_[True, a[deepest][1:] != a[deepest][:-1]]]
        at, inner = np.sort(np.r_[at, inner[deepest]]), np.delete(inner, deepest)
    rest = np.sort(np.r_[at, inner])
    if step is not None:
        return rest
    keep = [rest[0]]
    for i in rest[1:]:
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (f[b] - f[a]) * (v[i] - v[a]) >= (f[i] - f[a]) * (v[b] - v[a]):
                keep.pop()
            else:
                break
        keep.append(i)
    return np.array(keep)


def dip_of(values: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Dip of a sample from distinct sorted values and counts.

    For a mode at v_m, the best convex part left of it misses F by half the largest gap to the convex
    minorant of the left limits, and likewise on the right with the concave majorant.  The left miss
    grows and the right miss falls with m, so the best mode is found by bisection.  Corners of any such part are corners of the
    stretches of 512 values that it holds whole, found once, or lie in the one that the mode cuts.
    """
    v = np.asarray(values, float)
    w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
    if weights is None:
        v, w = np.unique(v, return_counts=True)
    n = w.sum()
    hi = np.cumsum(w) / n
    lo = hi - w / n
    k = len(v)
    if k < 2:
        return 0.0

    step = 512
    low, high = (_hull_points(v, f, step) for f in (lo, -hi))

    def left(m):
        if m == 0:
            return 0.0
        cut = m // step * step
        at = np.r_[low[: np.searchsorted(low, cut)], np.arange(cut, m + 1)]
        at = at[_hull_points(v[at], lo[at])]
        return float((hi[:m] - np.interp(v[:m], v[at], lo[at])).max()) / 2

    def right(m):
        if m == k - 1:
            return 0.0
        cut = min(-(-m // step) * step, k - 1)
        at = np.r_[np.arange(m, cut), high[np.searchsorted(high, cut) :]]
        at = at[_hull_points(v[at], -hi[at])]
        return float((np.interp(v[m + 1 :], v[at], hi[at]) - lo[m + 1 :]).max()) / 2

    a, b = 0, k - 1
    while a < b:
        mid = (a + b) // 2
        if left(mid) >= right(mid):
            b = mid
        else:
            a = mid + 1
    return min(max(left(m), right(m)) for m in {a, max(a - 1, 0)})


@F.pandas_udf(T.DoubleType())
def _dip_of_cells(values: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([dip_of(np.asarray(v), np.asarray(c)) for v, c in zip(values, counts)])


def dip_statistic(df: DataFrame, keys: Sequence[str], x: str, limit: int = 500_000, block: int = 200_000) -> DataFrame:
    """Dip per group on its distinct values; under four rows 0.

    A group with up to ``limit`` distinct values is one sorted array in one task; a larger one is searched
    in blocks of about ``block`` values, with the same result.
    """
    keys = list(keys)
    cells = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    cells = cut_lineage(cells)
    sizes = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_k"))
    big = sizes.where(F.col("_k") > limit).select(*keys)
    packed = cells.join(big, keys, "left_anti").groupBy(*keys).agg(F.sum("_c").alias("n"), F.sort_array(F.collect_list(F.struct("_x", "_c"))).alias("_s"))
    dip = _dip_of_cells(F.transform("_s", lambda s: s["_x"]), F.transform("_s", lambda s: s["_c"].cast("double")))
    small = packed.select(*keys, "n", F.when(F.col("n") >= 4, dip).otherwise(0.0).alias("dip_statistic"))
    if big.isEmpty():
        return small
    return small.unionByName(_dip_in_blocks(cells.join(big, keys, "left_semi"), keys, block))


def _dip_in_blocks(cells: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The same bisection over the mode for groups too large for one task, all groups at once.

    A round builds the convex minorant left of the mode and the concave majorant right of it from the
    hull points of each block, then measures the gaps block by block.
    """
    run = running_sums(cells.withColumn("_one", F.lit(1)), keys, "_x", ["_c", "_one"])
    pts = cut_lineage(run.select(
        *keys, "_x", (F.col("cum__c") / F.col("total__c")).alias("_hi"), ((F.col("cum__c") - F.col("_c")) / F.col("total__c")).alias("_lo"),
        F.col("cum__one").alias("_i"), F.floor((F.col("cum__one") - 1) / block).alias("_b"), F.col("total__one").alias("_k"), F.col("total__c").alias("n")))
    kf = [f for f in pts.schema.fields if f.name in keys]
    dbl = T.DoubleType()
    hull_schema = T.StructType([*kf, T.StructField("_side", T.IntegerType()), T.StructField("_hx", dbl), T.StructField("_hf", dbl)])
    gap_schema = T.StructType([*kf, T.StructField("_l", dbl), T.StructField("_r", dbl)])
    rkeys = [f"_k{i}" for i in range(len(keys))]

    def corner_rows(key, side, v, f):
        at = _hull_points(v, f if side == 0 else -f)
        return pd.DataFrame({**{k: [key[j]] * len(at) for j, k in enumerate(keys)}, "_side": [side] * len(at), "_hx": v[at], "_hf": f[at]})

    def corners(key, pdf):
        pdf = pdf.sort_values("_x")
        left, right = pdf[pdf["_i"] <= pdf["_m"]], pdf[pdf["_i"] >= pdf["_m"]]
        parts = [corner_rows(key, s, p["_x"].to_numpy(), p[c].to_numpy()) for s, p, c in ((0, left, "_lo"), (1, right, "_hi")) if len(p)]
        return pd.concat(parts)

    def merge(key, pdf):
        pdf = pdf.sort_values("_hx")
        return corner_rows(key, int(pdf["_side"].iloc[0]), pdf["_hx"].to_numpy(), pdf["_hf"].to_numpy())

    def gaps(key, pdf, hull):
        left, right = pdf[pdf["_i"] < pdf["_m"]], pdf[pdf["_i"] > pdf["_m"]]
        h = {s: hull[hull["_side"] == s].sort_values("_hx") for s in (0, 1)}
        lo = (left["_hi"] - np.interp(left["_x"], h[0]["_hx"], h[0]["_hf"])).max() / 2 if len(left) else 0.0
        hi = (np.interp(right["_x"], h[1]["_hx"], h[1]["_hf"]) - right["_lo"]).max() / 2 if len(right) else 0.0
        return pd.DataFrame({**{k: [key[j]] for j, k in enumerate(keys)}, "_l": [float(lo)], "_r": [float(hi)]})

    def misses(modes: DataFrame) -> DataFrame:
        """modes(keys, _m) -> largest half gaps (_l, _r) with the mode at the m-th value."""
        work = pts.join(modes, keys)
        hull = work.groupBy(*keys, "_b").applyInPandas(lambda key, pdf: corners(key[:-1], pdf), hull_schema)
        hull = cut_lineage(hull.groupBy(*keys, "_side").applyInPandas(lambda key, pdf: merge(key[:-1], pdf), hull_schema))
        blocks = pts.groupBy(*keys).agg(F.max("_b").alias("_nb")).withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb")))).drop("_nb")
        spread = hull.join(blocks, keys).select(*[F.col(k).alias(r) for k, r in zip(keys, rkeys)], "_rb", "_side", "_hx", "_hf")
        part = work.groupBy(*keys, "_b").cogroup(spread.groupBy(*rkeys, "_rb")).applyInPandas(lambda key, a, h: gaps(key[:-1], a, h), gap_schema)
        return part.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))

    state = cut_lineage(pts.groupBy(*keys).agg(F.lit(1).cast("bigint").alias("_a"), F.max("_k").alias("_z"), F.max("n").alias("n")))
    while not state.where("_a < _z").isEmpty():
        mid = F.floor((F.col("_a") + F.col("_z")) / 2)
        at = state.withColumn("_m", mid)
        done = F.col("_a") >= F.col("_z")
        j = at.join(misses(at.select(*keys, "_m")), keys)
        state = cut_lineage(j.select(
            *keys, F.when(done | (F.col("_l") >= F.col("_r")), F.col("_a")).otherwise(F.col("_m") + 1).alias("_a"),
            F.when(~done & (F.col("_l") >= F.col("_r")), F.col("_m")).otherwise(F.col("_z")).alias("_z"), "n"))
    out = None
    for shift in (0, 1):
        m = misses(state.select(*keys, F.greatest(F.col("_a") - shift, F.lit(1)).alias("_m")))
        m = m.select(*keys, F.greatest("_l", "_r").alias(f"_d{shift}"))
        out = m if out is None else out.join(m, keys)
    return out.join(state, keys).select(*keys, "n", F.when(F.col("n") >= 4, F.least("_d0", "_d1")).otherwise(0.0).alias("dip_statistic"))


def dip_pvalue(dips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-value of the dip for groups of any size, from the table of its null distribution (see special.dip_sf); groups under four rows get 1."""
    return dips.select(*keys, "n", "dip_statistic", dip_sf(F.col("dip_statistic"), F.col("n")).alias("dip_pvalue"))


# ---- both modality indicators of one-dimensional rows --------------------------------------------

def split_silhouette(values: np.ndarray, counts: np.ndarray) -> float:
    """Mean silhouette of the best two-means split of distinct sorted values with counts, exact and linear: sums of the values on either
    side give every distance sum.  One distinct value gives 0, and so does a cluster of one row."""
    v, c = np.asarray(values, float), np.asarray(counts, float)
    if len(v) < 2:
        return 0.0
    v = v - (v * c).sum() / c.sum()  # sums of small numbers
    n, s = np.cumsum(c), np.cumsum(c * v)
    # of sums of squares only the part between the clusters depends on the split
    between = s[:-1] ** 2 / n[:-1] + (s[-1] - s[:-1]) ** 2 / (n[-1] - n[:-1])
    cut = int(np.argmax(np.round(between / max(between.max(), 1e-300), 12))) + 1
    left = np.arange(len(v)) < cut
    low_n, low_s = np.where(left, 0, n[cut - 1]), np.where(left, 0, s[cut - 1])       # before the own cluster
    own_n, own_s = np.where(left, n[cut - 1], n[-1] - n[cut - 1]), np.where(left, s[cut - 1], s[-1] - s[cut - 1])
    upto_n, upto_s = n - low_n, s - low_s
    a = (v * upto_n - upto_s) + ((own_s - upto_s) - v * (own_n - upto_n))
    b = np.abs(v * (n[-1] - own_n) - (s[-1] - own_s)) / (n[-1] - own_n)
    a = a / np.maximum(own_n - 1, 1)
    top = np.maximum(a, b)
    return float((c * np.where((own_n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)).sum() / n[-1])


def _modality_of_cells(keys: list[str]):
    """mapInArrow: lists of a group's distinct values and their counts, in any order -> its row count, dip and silhouette."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dip, silhouette = [], [], []
            for values, counts in zip(batch.column("_xs"), batch.column("_cs")):
                v, c = values.values.to_numpy(), counts.values.to_numpy()
                order = np.argsort(v)
                v, c = v[order], c[order].astype(float)
                n.append(int(c.sum()))
                dip.append(dip_of(v, c) if n[-1] >= 4 else 0.0)
                silhouette.append(split_silhouette(v, c))
            found = [pa.array(n, pa.int64()), pa.array(dip, pa.float64()), pa.array(silhouette, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *found], [*keys, "n", "dip_statistic", "silhouette_k2"])

    return run


def _split_silhouette_in_parts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``split_silhouette`` of groups too large for one task, from running sums over chunks of the values."""
    mean = cells.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_mu"))
    centred = cells.join(mean, keys).select(*keys, (F.col("_x") - F.col("_mu")).alias("_x"), "_c").withColumn("_cx", F.col("_x") * F.col("_c"))
    run = cut_lineage(running_sums(centred, keys, "_x", ["_c", "_cx"]))
    n, s, cn, cs = (F.col(c) for c in ("total__c", "total__cx", "cum__c", "cum__cx"))
    between = run.where(cn < n).withColumn("_b", cs * cs / cn + (s - cs) * (s - cs) / (n - cn))
    most = between.groupBy(*keys).agg(F.max("_b").alias("_most"))
    share = F.round(F.col("_b") / F.greatest("_most", F.lit(1e-300)), 12)
    cut = between.join(most, keys).groupBy(*keys).agg(F.max_by(F.struct(F.col("_x").alias("at"), cn.alias("n"), cs.alias("s")), F.struct(share, -F.col("_x"))).alias("_l"))
    left = F.col("_x") <= F.col("_l.at")
    own_n, own_s = F.when(left, F.col("_l.n")).otherwise(n - F.col("_l.n")), F.when(left, F.col("_l.s")).otherwise(s - F.col("_l.s"))
    upto_n, upto_s = F.when(left, cn).otherwise(cn - F.col("_l.n")), F.when(left, cs).otherwise(cs - F.col("_l.s"))
    x = F.col("_x")
    a = ((x * upto_n - upto_s) + ((own_s - upto_s) - x * (own_n - upto_n))) / F.greatest(own_n - 1, F.lit(1))
    b = F.abs(x * (n - own_n) - (s - own_s)) / (n - own_n)
    one = F.when((own_n > 1) & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)
    return run.join(cut, keys).groupBy(*keys).agg((F.sum(F.col("_c") * one) / F.max(n)).alias("silhouette_k2"))


def modality(rows: DataFrame, keys: Sequence[str], x: str = "x", limit: int = 500_000) -> DataFrame:
    """(keys, dip_statistic, dip_pvalue, silhouette_k2) of one-dimensional rows; null values take no part.

    Rows are first counted by value on the map side; see ``modality_of_counts``.
    """
    known = rows.where(F.col(x).isNotNull())
    return modality_of_counts(cut_lineage(known.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))), keys, limit)


def modality_of_counts(cells: DataFrame, keys: Sequence[str], limit: int = 500_000, sizes: DataFrame | None = None) -> DataFrame:
    """The same from the table of distinct values ``_x`` and their counts ``_c``, which is read several times.

    A group of up to ``limit`` distinct values is one list in one task; a larger one goes through blocks and running sums, with the
    same result.  ``sizes``: the groups' numbers of distinct values as ``_k``, where they are known.
    """
    keys = list(keys)
    cells = cells.where(F.col("_x").isNotNull()).select(*keys, "_x", "_c")
    if sizes is None:
        sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    big = cut_lineage(sizes.where(F.col("_k") > limit).select(*keys))
    some = not big.isEmpty()
    small = cells.join(big, keys, "left_anti") if some else cells
    doubles = [T.StructField(c, T.DoubleType()) for c in ("dip_statistic", "silhouette_k2")]
    schema = T.StructType([*[f for k in keys for f in cells.schema.fields if f.name == k], T.StructField("n", T.LongType()), *doubles])
    # dealt by group first: a task holds the lists of its own groups only, and needs no sort
    lists = small.repartition(*keys).groupBy(*keys).agg(F.collect_list("_x").alias("_xs"), F.collect_list("_c").alias("_cs"))
    out = lists.mapInArrow(_modality_of_cells(keys), schema)
    if some:
        large = cells.join(big, keys, "left_semi")
        out = out.unionByName(_dip_in_blocks(large, keys, 200_000).join(_split_silhouette_in_parts(large, keys), keys))
    return out.select(*keys, "dip_statistic", dip_sf(F.col("dip_statistic"), F.col("n")).alias("dip_pvalue"), "silhouette_k2")


# ---- mixture and null ---------------------------------------------------------------------------

def ashman_mixture(df: DataFrame, keys: Sequence[str], x: str, rounds: int = 20, floor: float = 1e-6) -> DataFrame:
    """Separation of a two-component Gaussian mixture fitted per group by EM; starts from the split at the mean.

    Each round is five sums per group over the distinct values.
    """
    keys = list(keys)
    rows = cut_lineage(df.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    mean = rows.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_mu"))
    resp = rows.join(mean, keys).withColumn("_r", (F.col("_x") > F.col("_mu")).cast("double"))

    def maximise(r: DataFrame) -> DataFrame:
        w, p, v = F.col("_w"), F.col("_r"), F.col("_x")
        s = r.groupBy(*keys).agg(
            F.sum(w).alias("n"), F.sum(w * p).alias("n1"), F.sum(w * v).alias("sx"), F.sum(w * p * v).alias("sx1"),
            F.sum(w * v * v).alias("sq"), F.sum(w * p * v * v).alias("sq1"))
        s = s.withColumns({"n0": F.col("n") - F.col("n1"), "sx0": F.col("sx") - F.col("sx1"), "sq0": F.col("sq") - F.col("sq1")})
        cols = {}
        for k in (0, 1):
            c = F.greatest(F.col(f"n{k}"), F.lit(1e-10))
            mu = F.col(f"sx{k}") / c
            cols |= {f"mu{k}": mu, f"var{k}": F.greatest(F.col(f"sq{k}") / c - mu * mu, F.lit(0.0)) + floor, f"pi{k}": c / F.col("n")}
        return cut_lineage(s.select(*keys, *[c.alias(n) for n, c in cols.items()]))

    par = maximise(resp)
    for _ in range(rounds):
        def dens(k):
            return F.ln(f"pi{k}") - 0.5 * F.ln(f"var{k}") - F.pow(F.col("_x") - F.col(f"mu{k}"), 2) / (2 * F.col(f"var{k}"))

        par = maximise(rows.join(par, keys).withColumn("_r", 1.0 / (1.0 + F.exp(F.least(dens(0) - dens(1), F.lit(700.0))))))
    sep = F.sqrt(F.lit(2.0)) * F.abs(F.col("mu0") - F.col("mu1")) / F.sqrt(F.col("var0") + F.col("var1"))
    return par.select(*keys, "mu0", "mu1", "pi1", sep.alias("ashman_d"))


def normal_distance(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Half the Kolmogorov distance of a sample to its fitted normal (population std)."""
    keys = list(keys)
    fit = df.groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"))
    r = average_ranks(df.select(*keys, F.col(x).cast("double").alias("_v")), keys, "_v").join(fit, keys)
    z = normal_cdf((F.col("_v") - F.col("_mu")) / F.col("_sd"))
    r = r.where("_sd > 0").withColumn("_p", z)
    gap = F.greatest(F.col("cum_cnt") / F.col("total_cnt") - F.col("_p"), F.col("_p") - (F.col("cum_cnt") - F.col("cnt")) / F.col("total_cnt"))
    return r.groupBy(*keys).agg((F.max(gap) / 2).alias("ks_half"))


def null_vectors(rows: DataFrame, keys: Sequence[str], row_id: str, dim: int, b: int, seed: int = 42) -> DataFrame:
    """b random unit vectors per row of a table: null groups as large as the real ones, by keyed normal draws."""
    base = rows.select(*keys, F.col(row_id).alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(b))).alias("rep"))
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: normal(seed, F.concat_ws("|", *keys), F.col("rep"), F.col("row_id"), i))
    d = base.withColumn("_raw", raw)
    d = d.withColumn("_norm", F.sqrt(dot("_raw", "_raw")))
    return d.withColumn("vector", F.transform("_raw", lambda x: x / F.col("_norm"))).drop("_raw", "_norm")


def null_distribution(rows: DataFrame, keys: Sequence[str], row_id: str, dim: int = 16, b: int = 20, seed: int = 42, q: float = 0.95) -> DataFrame:
    """Upper quantile of the normal-distance proxy and of the cosine silhouette under random unit vectors, per group.

    Clusters split at the sign of the first component; on unit vectors the cosine silhouette is the
    squared-distance one.
    """
    k = [*keys, "rep"]
    v = cut_lineage(null_vectors(rows, keys, row_id, dim, b, seed))
    scored = pc1_scores(v, k, "vector").withColumn("cluster", (F.col("pc1") > 0).cast("int"))
    ks = normal_distance(scored, k, "pc1")
    sil = silhouette_squared(scored, k, "vector")
    return ks.join(sil, k).groupBy(*keys).agg(
        F.percentile("ks_half", q).alias("dip_proxy_q"), F.percentile("silhouette_k2", q).alias("silhouette_q"), F.count(F.lit(1)).alias("n_reps"))


def pca2(df: DataFrame, vector: str, row_id: str) -> DataFrame:
    """Two-dimensional projection of all vectors (signs: largest loading positive)."""
    v = df.select(row_id, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    sign = [1.0 if col[np.argmax(np.abs(col))] > 0 else -1.0 for col in model.pc.toArray().T]
    p = vector_to_array("_p")
    return model.transform(v).select(row_id, (p[0] * sign[0]).alias("pc1"), (p[1] * sign[1]).alias("pc2"))


def indicator_battery(df: DataFrame, keys: Sequence[str], row_id: str, vector: str, correct: str, answer: str, exact: bool = True) -> DataFrame:
    """All indicators of a response table in one level table; each part is a grouped job joined on the keys."""
    from levelscan.operators.aggregates import disagreement

    keys = list(keys)
    rows = df.select(*keys, F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(correct).alias("correct"), F.col(answer).cast("string").alias("answer"))
    axes = cut_lineage(principal_axes(rows, keys, "vector"))
    scored = pc1_scores(rows, keys, "vector", axes)
    clustered = kmeans2(rows, keys, "vector") if exact else scored.withColumn("cluster", (F.col("pc1") > 0).cast("int"))
    from levelscan.operators.aggregates import ashman_labels

    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")).alias("accuracy"),
        bimodality(F.skewness("pc1"), F.kurtosis("pc1"), F.count("pc1")).alias("bimodality_coefficient"),
        ashman_labels("pc1", "correct").alias("ashman_d"))
    sil = silhouette_k2(clustered, keys, "row_id", "vector") if exact else silhouette_squared(clustered, keys, "vector")
    dips = dip_pvalue(dip_statistic(scored, keys, "pc1"), keys)
    out = base.join(pc1_variance(axes, keys), keys)
    out = out.join(group_vector_moments(rows, keys, "vector").select(*keys, F.col("variance_trace").alias("variance"), "mean_cosine_distance"), keys)
    out = out.join(group_pair_stats(rows, keys, "vector").select(*keys, "std_cosine_distance"), keys)
    out = out.join(dips.drop("n"), keys).join(sil.select(*keys, "silhouette_k2"), keys).join(disagreement(rows, keys, "all"), keys)
    small = F.col("n") < 4
    return out.withColumn("silhouette_k2", F.when(small, 0.0).otherwise(F.col("silhouette_k2")))
