"""Vector statistics per group, linear in the number of rows.

Every pair statistic used here (mean and spread of pair cosines, covariance trace, principal
component) is a function of three sums per group: the count, the vector sum, and the Gram matrix of
outer products.  Arrow batches are folded into those sums on the map side with numpy and only
``dim x dim`` partial matrices are shuffled, so a hot group costs no more than its share of rows and
no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _v(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: str | Column, by: Column) -> Column:
    return F.transform(_v(v), lambda x: x / by)


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def moment_sums(df: DataFrame, keys: Sequence[str], vector: str, gram: bool = True, unit: bool = False) -> DataFrame:
    """One row per group: count ``_n``, ``_dim``, vector sum ``_s``, sum of squares ``_ss`` and flat Gram matrix ``_g``."""
    keys = list(keys)
    parts = df.where(F.col(vector).isNotNull()).select(*keys, _v(vector).alias("_v"))
    fields = [f for f in parts.schema.fields if f.name in keys]
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *fields, T.StructField("_n", T.LongType()), T.StructField("_dim", T.IntegerType()),
        T.StructField("_s", arr), T.StructField("_ss", T.DoubleType()), T.StructField("_g", arr),
    ])

    def fold(batches):
        state: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                x = np.vstack(part["_v"].to_numpy())
                if unit:
                    norms = np.linalg.norm(x, axis=1, keepdims=True)
                    x = (x / np.where(norms > 0, norms, 1.0))[norms[:, 0] > 0]
                old = state.get(key)
                new = [len(x), x.sum(axis=0), float((x * x).sum()), x.T @ x if gram else None]
                if old is not None:
                    new = [a if b is None else a + b for a, b in zip(new, old)]
                state[key] = new
                if len(state) >= 512:
                    yield _emit(state)
                    state = {}
        if state:
            yield _emit(state)

    def _emit(state):
        rows = []
        for key, (n, s, ss, g) in state.items():
            key = key if isinstance(key, tuple) else (key,)
            rows.append((*key, n, len(s), s, ss, g.ravel() if g is not None else None))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    partial = parts.mapInPandas(fold, schema)
    cells = F.concat("_s", F.array("_ss"), F.coalesce("_g", F.array().cast("array<double>")))
    spread = partial.select(*keys, "_n", "_dim", F.posexplode(cells).alias("_i", "_x"))
    summed = spread.groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"), F.sum("_n").alias("_n"), F.max("_dim").alias("_dim"))
    back = summed.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_dim").alias("_dim"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda t: t["_x"]).alias("_all"),
    )
    d = F.col("_dim")
    return back.select(
        *keys, "_n", "_dim", F.slice("_all", 1, d).alias("_s"), F.get("_all", d).alias("_ss"),
        F.slice("_all", d + 2, d * d).alias("_g"),
    )


def group_vector_moments(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Covariance trace and mean pair cosine distance by closed form (0 for fewer than two rows).

    All in SQL expressions: the vector is spread over its coordinates and summed with map-side combine.
    """
    keys = list(keys)
    norm = vector_norm(vector)
    spread = df.select(*keys, _v(vector).alias("_v"), norm.alias("_norm")).select(
        *keys, "_norm", F.posexplode("_v").alias("_i", "_x")
    )
    unit = F.when(F.col("_norm") > 0, F.col("_x") / F.col("_norm"))
    per_dim = spread.groupBy(*keys, "_i").agg(
        F.count(F.lit(1)).alias("n"), F.count(unit).alias("m"), F.coalesce(F.var_samp("_x"), F.lit(0.0)).alias("_var"), F.sum(unit).alias("_u")
    )
    m = F.max("m")
    dist = 1 - (F.sum(F.col("_u") * F.col("_u")) - m) / (m * (m - 1)).cast("double")
    return per_dim.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum("_var").alias("variance_trace"),
        F.when(m >= 2, dist).otherwise(0.0).alias("mean_cosine_distance"),
    )


def group_pair_stats(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Count, mean and population std of the cosine distance over all unordered pairs of a group.

    With unit vectors u: sum of cos over ordered pairs = |sum u|^2, sum of cos^2 = |Gram|_F^2, so both
    moments over pairs follow from the group sums.
    """
    m = moment_sums(df, keys, vector, gram=True, unit=True)
    n = F.col("_n").cast("double")
    pairs = n * (n - 1) / 2
    c1 = (dot("_s", "_s") - n) / 2 / pairs
    c2 = (dot("_g", "_g") - n) / 2 / pairs
    return m.select(
        *keys,
        pairs.cast("long").alias("n_pairs"),
        F.when(n >= 2, 1 - c1).otherwise(0.0).alias("mean_cosine_distance"),
        F.when(n >= 2, F.sqrt(F.greatest(c2 - c1 * c1, F.lit(0.0)))).otherwise(0.0).alias("std_cosine_distance"),
    )
