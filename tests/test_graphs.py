"""Random graphs against a search by hand, and one draw per pair of nodes."""

import hashlib

from pyspark.sql import functions as F

from levelscan.operators.generators import GRAPH_LEVELS, k_colourable, random_graphs
from levelscan.plans.draws import digits_below, order_key, uniform


def _by_hand(attempts, keep):
    out, seen = {}, {}
    for level, attempt in sorted(attempts):
        _l, n, p, _k = GRAPH_LEVELS[level - 1]
        draw = lambda u, v: (int(hashlib.md5(f"42|{level}|{attempt}|{u}|{v}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        edges = [(u, v) for u in range(n) for v in range(u + 1, n) if draw(u, v) < p]
        reached = {0}
        for _ in range(n):
            reached |= {x for e in edges if reached & set(e) for x in e}
        if len(edges) >= 2 and len(reached) == n and tuple(edges) not in seen.setdefault(level, set()) and len(seen[level]) < keep:
            seen[level].add(tuple(edges))
            out[level, attempt] = edges
    return out


def test_graphs_are_those_found_by_hand(spark):
    pairs = [(i % 20 + 1, i) for i in range(4000)]
    got = random_graphs(spark.createDataFrame(pairs, "level int, attempt long"), per_level=5).collect()
    assert {(r["level"], r["attempt"]): [tuple(e) for e in r["edges"]] for r in got} == _by_hand(pairs, 5)
    assert all((r["n"], r["p"], r["k"]) == GRAPH_LEVELS[r["level"] - 1][1:] for r in got)


def test_other_columns_come_from_the_first_attempt(spark):
    df = spark.range(300).select(F.lit(1).alias("level"), F.col("id").alias("attempt"), (F.col("id") * 3).alias("x"))
    got = random_graphs(df, per_level=None).collect()
    assert got and all(r["x"] == 3 * r["attempt"] for r in got)


def test_edges_are_drawn_once_and_after_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 12 + 1).cast("int").alias("level"), F.col("id").alias("attempt")).repartition(4, "attempt")
    plan = random_graphs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.index("md5(") < plan.index("RepartitionByExpression")


def test_digits_compare_like_the_uniform_number(spark):
    df = spark.range(3000).select(uniform(1, F.col("id")).alias("u"), order_key(1, F.col("id")).alias("k"))
    for p in (0.3, 0.35, 0.45, 0.6):
        assert df.where((F.col("u") < p) != (F.col("k") < digits_below(p))).isEmpty()


def test_colouring_reads_its_graphs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def nodes(n):
        seen.add(1)
        return n

    df = spark.createDataFrame([(1, [[0, 1], [1, 2]], 3, 3)], "id int, edges array<array<int>>, m int, k int").select("id", "edges", nodes("m").alias("n"), "k")
    assert [r["colouring"] for r in k_colourable(df, ["id"]).collect()] == [[0, 1, 0]]
    assert seen.value == 1
