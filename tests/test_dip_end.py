"""The dip of cells with more values than 11 halvings reach: the query's is that of the SQL with enough halvings."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from levelscan.operators import indicators as I
from levelscan.queries.bindings import dip_sql


def test_dip_of_more_values_than_eleven_halvings_reach():
    rng = np.random.default_rng(3)
    cells = {g: np.unique(rng.gamma(2.0 + g, 1.0, 7_000)) for g in range(3)}
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"g": np.repeat(list(cells), [len(v) for v in cells.values()]), "x": np.concatenate(list(cells.values()))}))
    whole, early = (dict(con.execute(f"WITH {dip_sql('t', 'g', 'x', n)} SELECT g, dip_statistic FROM dip").fetchall()) for n in (13, 11))
    for g, v in cells.items():
        assert I.dip_of(v) == pytest.approx(whole[g], abs=1e-12)
        assert early[g] >= whole[g] - 1e-12
    assert any(early[g] > whole[g] + 1e-9 for g in cells)
