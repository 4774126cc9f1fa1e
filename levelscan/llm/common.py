"""Helpers shared by the operators of this folder: stored tables, ranks over hot groups, index permutations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from levelscan.plans.session import cut_lineage as stored  # noqa: F401  (written once to the shared folder, read back)

CELL_DIGITS = 3  # hex digits of a key that name its cell: 4096 cells a group, whatever the table's size


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_sample(df: DataFrame, sample: int, *key: str) -> DataFrame:
    """At most ``sample`` rows, drawn by a hash of the key columns; the same for any partitioning.

    The share is set by a count, so tasks send on about as many rows together as are asked for.
    """
    n, at = df.count(), F.xxhash64(*key)
    some = df if n <= sample else df.where(at <= int(2**64 * 0.9 * sample / n) - 2**63)
    return some.orderBy(at, *key).limit(sample)


def hex_key(seed: str, *cols: Column) -> Column:
    """A seeded md5 in hex; nulls count as a value of their own.  The same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def source_key(source: Column) -> Column:
    """Sorts by code point with null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sums_before(df: DataFrame, group: list[str], key: str, ties: list[str], sums: dict[str, str]) -> DataFrame:
    """For each row the sums of columns over the rows of its group with a smaller ``key`` (hex, evenly spread), then ``ties``.

    A group is cut into 4096 cells by the leading digits of the key, so a group that holds a third of all rows spreads
    over 4096 windows.  Cell totals are aggregated on the map side, and only they pass through a window per group.
    """
    cells = df.withColumn("_cell", F.substring(key, 1, CELL_DIGITS))
    totals = cells.groupBy(*group, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_cell", *[F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_cell").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = cells.join(offsets, [*group, "_cell"])
    return joined.withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("_cell", *[f"_o_{n}" for n in sums])


def round_keys(seed: str, rounds: int) -> list[int]:
    """One 60-bit constant for each round of ``permuted``."""
    return [int(hashlib.md5(f"{seed}|{r}".encode()).hexdigest()[:15], 16) for r in range(rounds)]


def permuted(index: Column, size: Column, seed: str, salt: Column, rounds: int = 12) -> Column:
    """The place of ``index`` under a pseudorandom permutation of 0..size-1 (swap-or-not network).

    Each round mirrors the value at a round point and keeps the mirror or not by one hash bit that both have in common,
    so every round, and with it the whole, is a bijection for any size.  No table of the permutation is made.
    """
    def step(at: Column, key: Column) -> Column:
        mirror = F.pmod(key + salt - at, size)
        bit = F.substring(F.md5(F.concat_ws("|", key, salt, F.greatest(at, mirror))), 1, 1)
        return F.when(bit < "8", mirror).otherwise(at)

    return F.aggregate(F.array(*[F.lit(k) for k in round_keys(seed, rounds)]), index.cast("bigint"), step)


def permuted_sql(index: str, size: str, seed: str, salt: str, rounds: int = 12) -> str:
    """``permuted`` for DuckDB."""
    keys = ", ".join(str(k) for k in round_keys(seed, rounds))
    mirror = f"((((rk + {salt} - a) % {size}) + {size}) % {size})"
    bit = f"substr(md5(rk::VARCHAR || '|' || ({salt})::VARCHAR || '|' || greatest(a, {mirror})::VARCHAR), 1, 1)"
    return f"list_reduce([({index})::BIGINT, {keys}], lambda a, rk: CASE WHEN {bit} < '8' THEN {mirror} ELSE a END)"
