"""The paired permutation test of F1 against every swap drawn by hand, and where its work runs."""

import hashlib

import pytest

from levelscan.operators import resampling as B


def _f1(rows):
    den = sum(h == 1 for h, _ in rows) + sum(y == 1 for _, y in rows)
    return 2 * sum(h == 1 and y == 1 for h, y in rows) / den if den else 0.0


def _by_hand(rows, seed, p):
    def gap(rep):
        swap = [rep > 0 and int(hashlib.md5(f"{seed}|{g}|{rep}|{i}".encode()).hexdigest()[:8], 16) % 2 for g, i, _, _, _ in rows]
        return _f1([(b if s else a, y) for s, (_, _, y, a, b) in zip(swap, rows)]) - _f1([(a if s else b, y) for s, (_, _, y, a, b) in zip(swap, rows)])

    seen = gap(0)
    return seen, sum(abs(gap(r)) >= abs(seen) - 1e-12 for r in range(1, p + 1)) / p


def test_paired_permutation_by_hand(spark):
    data = [("g", i, int(i % 3 == 0), int(i % 5 < 2), int(i % 7 < 3)) for i in range(40)] + [("g", 40, None, 1, 0), ("g", 41, 1, None, 1), ("g", 42, 1, 1, None)]
    data += [("same", i, i % 2, 1, 1) for i in range(6)] + [("none", i, 0, 0, 0) for i in range(3)]
    df = spark.createDataFrame(data, "g string, id int, y int, a int, b int").coalesce(1)
    out = B.paired_permutation_f1(df, ["g"], "id", "y", "a", "b", 60, 7)
    got = {r["g"]: (r["observed"], r["p_value"]) for r in out.collect()}
    for g in ("g", "same", "none"):
        assert got[g] == pytest.approx(_by_hand([r for r in data if r[0] == g], 7, 60))
    # one split, but the replicates of its rows are drawn on all cores
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
