"""Arithmetic chains against the moves written out, a step at a time."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from levelscan.operators.generators import arithmetic_chains


def _by_hand(item, level, bound):
    draw = lambda x: int(hashlib.md5(f"42|{item}|{x}".encode()).hexdigest()[:8], 16)
    v = 10 + draw("start") % 90
    vals, ops, args = [v], [], []
    for i in range(1, level + 1):
        legal = [("+", a) for a in range(10, 100) if v + a <= bound] + [("-", a) for a in range(10, 100) if v - a >= -bound]
        legal += [("×", a) for a in range(2, 10) if v and abs(v * a) <= bound]
        op, a = legal[draw(i) % len(legal)]
        v = v + a if op == "+" else v - a if op == "-" else v * a
        vals, ops, args = [*vals, v], [*ops, op], [*args, a]
    return vals, ops, args


def test_chains_are_the_drawn_moves(spark):
    df = spark.range(200).select(F.col("id").alias("item_id"), (F.col("id") % 25 + 1).cast("int").alias("level"))
    for bound in (150, 10000):
        for r in arithmetic_chains(df, bound=bound).collect():
            assert (r["intermediates"], r["operations"], r["operands"]) == _by_hand(r["item_id"], r["level"], bound)
            assert r["output"] == str(r["intermediates"][-1]) and r["input"].count("\nStep ") == r["level"]


def test_an_item_without_level_has_no_chain(spark):
    got = arithmetic_chains(spark.createDataFrame([(1, None), (2, 3)], "item_id long, level int")).collect()
    assert {r["item_id"]: r["operations"] and len(r["operations"]) for r in got} == {1: None, 2: 3}


def test_steps_run_in_arrow_batches(spark):
    df = spark.range(3).select(F.col("id").alias("item_id"), F.lit(4).alias("level"))
    plan = arithmetic_chains(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_the_query_replays_a_chain_once(spark, folder):
    plan = entry.queries()["gen01_arithmetic_chains"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
