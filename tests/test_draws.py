"""Draws without a number: the same order and the same coin as hash32."""

from pyspark.sql import functions as F

from levelscan.operators.generators import syllogism_items
from levelscan.plans.draws import coin, hash32, order_key


def test_digits_sort_and_toss_like_the_number(spark):
    got = spark.range(500).select(hash32(7, F.col("id")).alias("h"), order_key(7, F.col("id")).alias("k"), coin(7, F.col("id")).alias("odd")).collect()
    assert [r["h"] for r in sorted(got, key=lambda r: r["k"])] == sorted(r["h"] for r in got)
    assert all(r["odd"] == (r["h"] % 2 == 1) for r in got)


def test_entities_are_drawn_by_hash_and_sorted_natively(spark):
    names = [f"n{i}s" for i in range(12)]
    df = spark.range(30).select(F.col("id").alias("item_id"), (2 + F.col("id") % 5).cast("int").alias("level"), F.col("id").alias("index"))
    items = syllogism_items(df, names=names)
    assert "lambdafunction(if" not in items._jdf.queryExecution().optimizedPlan().toString().lower()
    hashes = {(r["i"], r["x"]): r["h"] for r in df.select("item_id", F.explode(F.array(*map(F.lit, names))).alias("x")).select(F.col("item_id").alias("i"), "x", hash32(42, F.col("item_id"), F.lit("name"), F.col("x")).alias("h")).collect()}
    for r in items.collect():
        assert r["entities"] == sorted(names, key=lambda x: (hashes[r["item_id"], x], x))[:r["level"] + 1]
