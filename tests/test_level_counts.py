"""The level table with modes, from counts of distinct values: as from the rows, which are read once for them."""

import numpy as np
import pytest

from levelscan.operators.aggregates import level_table

SCHEMA = "task string, model string, level int, x double, correct boolean, answer string"


def test_moments_of_odd_groups(spark):
    rng = np.random.default_rng(3)
    groups = [
        [(None, None)], [(None, True), (None, False)], [(1.0, True)], [(0.1, True)] * 3 + [(0.1, False)] * 3, [(0.1, True)] * 3 + [(0.7, False)] * 7,
        [(1e9 + i % 4, i % 3 == 0) for i in range(40)], [(2.0, None), (3.0, None)], [(2.0, True), (5.0, None), (None, False), (7.0, False), (7.5, False), (1.0, True)],
        [(float("nan"), True), (1.0, True), (2.0, False), (3.0, False), (4.0, True)], [(float(x), bool(x > 40)) for x in np.round(rng.exponential(50, 400), 1)],
    ]
    rows = spark.createDataFrame([("t", "m", i, x, ok, "a") for i, g in enumerate(groups) for x, ok in g], SCHEMA).repartition(3)
    plain, modes = ({r["level"]: r.asDict() for r in level_table(rows, modes=m).collect()} for m in (False, True))
    assert set(plain) == set(modes) == set(range(len(groups)))
    for level, want in plain.items():
        got = {c: modes[level][c] for c in want}
        assert got == {c: pytest.approx(v, rel=1e-7, nan_ok=True) if isinstance(v, float) else v for c, v in want.items()}, level
    assert modes[3]["ashman_d"] is modes[4]["ashman_d"] is None and modes[0]["silhouette_k2"] is None


def test_rows_are_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("t", "m", i % 3, float(i % 17), i % 2 == 0, str(i % 5)) for i in range(600)], SCHEMA).mapInArrow(count, SCHEMA)
    assert len(level_table(rows).collect()) == 3
    assert read.value == 1200  # values, answers; formerly moments too
