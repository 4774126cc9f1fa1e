"""Components inside rows and by rounds give the same labels."""

import random

from levelscan.operators import audits


def _by_hand(edges):
    out = {}
    for g in {e[0] for e in edges}:
        near = {}
        for _g, u, v in (e for e in edges if e[0] == g):
            near.setdefault(u, {u}).add(v)
            near.setdefault(v, {v}).add(u)
        for n in near:
            seen, todo = {n}, [n]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            out[g, n] = min(seen)
    return out


def test_rows_and_rounds_agree_with_a_search(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(-20, 20), rng.randrange(-20, 20)) for g in range(30) for _ in range(rng.randrange(1, 40))]
    edges += [(99, i, i + 1) for i in range(40)]
    df, want = spark.createDataFrame(edges, "g long, u int, v int"), _by_hand(edges)
    for limit in (0, 60, 1024):
        got = audits.components(df, "g", limit=limit).collect()
        assert len(got) == len(want) and {(r["g"], r["node"]): r["label"] for r in got} == want


def test_nodes_may_be_text(spark):
    got = audits.components(spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "x", "y"), (2, "c", "d")], "g long, u string, v string"), "g").collect()
    assert {(r["g"], r["node"]): r["label"] for r in got} == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "x"): "x", (1, "y"): "x", (2, "c"): "c", (2, "d"): "c"}


def test_small_graphs_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(audits, "_propagate", None)
    df = spark.createDataFrame([(g, i, i + 1) for g in range(5) for i in range(6)], "g long, u int, v int")
    assert {r["label"] for r in audits.components(df, "g").collect()} == {0}
