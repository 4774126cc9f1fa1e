"""Chains over two hops leave all their earlier sources out."""

import duckdb
from test_registry import rows

import __spark_entry__ as entry


def test_no_chain_comes_back_to_a_source(spark, folder):
    source = {r["o_orderkey"]: r["o_custkey"] % 10 for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    df = entry.queries()["jn05_extend_chains"](spark, folder)
    got = df.collect()
    assert got and all(len({source[r["chain_id"]], source[r["hop2"]], source[r["hop3"]]}) == 3 for r in got)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet'")
    cur = con.execute(entry.oracle_sql()["jn05_extend_chains"])
    assert rows([tuple(r) for r in got], df.columns) == rows(cur.fetchall(), [c[0] for c in cur.description])
