"""Sizes and cases beyond former limits."""

from levelscan.operators.generators import k_colourable
from levelscan.operators.joins import extend_chains


def test_graph_of_14_nodes_without_a_colouring(spark):
    triangle = [[0, 1], [1, 2], [11, 12], [12, 13], [11, 13]]
    path = [[i, i + 1] for i in range(13)]
    df = spark.createDataFrame([(1, 14, 2, triangle), (2, 14, 2, path), (3, 1, 1, [])], "id int, n int, k int, edges array<array<int>>")
    got = {r["id"]: r["colouring"] for r in k_colourable(df, ["id"]).collect()}
    assert set(got) == {2, 3} and got[2] == [0, 1] * 7 and got[3] == [0]


def test_chain_that_would_go_back_to_its_first_source(spark):
    facts = spark.createDataFrame([(1, "S0", "b", "c"), (2, "S1", "b", "d"), (3, "S2", "b", "e")], "fact_id int, source string, entity string, answer string")
    chain = spark.createDataFrame([(1, "S1", "b", [0], ["S0", "S1"])], "chain_id int, source string, answer string, path array<int>, used array<string>")
    got = extend_chains(chain, facts, excluded=2).collect()
    assert [(r["source"], r["answer"], r["path"], r["used"]) for r in got] == [("S2", "e", [0, 3], ["S1", "S2"])]
    plain = extend_chains(chain.drop("used"), facts).collect()
    assert [(r["source"], r["path"]) for r in plain] == [("S0", [0, 1])]
