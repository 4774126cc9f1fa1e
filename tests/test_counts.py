"""Registered queries run the operators' or the survey's counts."""

import inspect

import duckdb
import pytest
from test_registry import TABLES, rows

import __spark_entry__ as entry
from levelscan.operators import fits, learners

#: query: operator, and the arguments it has to be called with
COUNTS = {
    "ml14_feature_importance": (learners, "feature_importance", {"trees": 100}),
    "fit03b_fold_refined": (fits, "fit_fold", {"refine": True}),
    "fit06_compare_models": (fits, "model_scores", {"cusp": True, "fold": {}}),
}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", COUNTS)
def test_counts(spark, folder, monkeypatch, name):
    module, operator, wanted = COUNTS[name]
    signature, seen = inspect.signature(getattr(module, operator)), {}

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called):
        entry.queries()[name](spark, folder)
    assert {k: seen.get(k, {}) for k in wanted} == wanted


@pytest.mark.parametrize("name", ["inf05_paired_permutation_f1", "ind08_ashman_mixture"])
def test_full_count_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), cols)
