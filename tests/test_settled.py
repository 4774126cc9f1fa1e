"""Two-means where plain Lloyd rounds settle after hundreds: the same rows, with all or few of them near the plane."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelscan.operators import indicators as I

N, FLAT, TILT = 20_000, 0.99, 0.05


def ellipse():
    turn = 2 * np.pi * (np.arange(N) + 0.37) / N
    return np.stack([np.cos(turn), FLAT * np.sin(turn)], 1)


def plain(x, one):
    for done in range(1, 5000):
        c0, c1 = x[~one].mean(0), x[one].mean(0)
        now = ((x - c1) ** 2).sum(1) < ((x - c0) ** 2).sum(1)
        if (now == one).all():
            return one, done
        one = now


@pytest.mark.parametrize("share,passes", [(2**22, 1), (2**13, 40)])
def test_hundreds_of_rounds(spark, monkeypatch, share, passes):
    x = ellipse()
    want, rounds = plain(x, x[:, 1] + TILT * x[:, 0] > 0)
    assert rounds > 300
    made, settle = [], I._settle
    monkeypatch.setattr(I, "_settle", lambda *a: made.append(1) or settle(*a))
    turn = 2 * np.pi * (F.col("id") + 0.37) / N
    df = spark.range(0, N, 1, 4).select("id", F.lit("a").alias("g"), F.array(F.cos(turn), FLAT * F.sin(turn)).alias("v"))
    got = I.kmeans2(df, ["g"], "v", start=(F.col("v")[1] + TILT * F.col("v")[0] > 0).cast("int"), share=share).collect()
    assert len(got) == N and 1 <= len(made) <= passes
    assert {r["id"] for r in got if r["cluster"] == 1} == set(np.flatnonzero(want))


def test_rows_left_out_keep_their_side_until_a_round_may_move_them():
    """Rounds on near rows alone stop no later than the first round in which a row left out changes sides."""
    rng = np.random.default_rng(1)
    for dim in (1, 2, 16):
        x = rng.normal(0, 1, (600, dim))
        c = x[:2].copy()
        for _ in range(1000):
            w, y = c[1] - c[0], x - c.mean(0)
            unit = np.sqrt(w @ w)
            far = np.sqrt((y * y).sum(1)) / unit
            score = np.abs(y @ w) / unit**2 / (1 + far)
            near, rest = np.split(np.argsort(score), [60])
            one = I._ones(x, c)
            n, s = np.array([(~one[rest]).sum(), one[rest].sum()]), np.stack([x[rest][~one[rest]].sum(0), x[rest][one[rest]].sum(0)])
            new, live = I._rounds_of_near_rows(c, n, s, score[rest].min(), far[rest].min(), far[rest].max(), x[near])
            while True:  # plain rounds pass through the same centres
                side = I._ones(x, c)
                c = np.stack([x[~side].mean(0), x[side].mean(0)])
                if np.allclose(c, new, rtol=0, atol=1e-12):
                    break
                assert (side != I._ones(x, c)).any()
            if not live:
                break
        side = I._ones(x, c)
        assert not live and np.allclose(c, [x[~side].mean(0), x[side].mean(0)], rtol=0, atol=1e-12)


def test_ten_starts_of_hundreds_of_rounds(spark):
    """The battery's two-means: all ten starts end, and the best of them is that of plain rounds."""
    x = ellipse()
    turn = 2 * np.pi * (F.col("id") + 0.37) / N
    df = spark.range(0, N, 1, 4).select("id", F.lit("a").alias("g"), F.array(F.cos(turn), FLAT * F.sin(turn)).alias("v"))
    starts = I._spread_starts(df.select("g", F.col("v").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("_start")), ["g", "_start"], "_v", 42).collect()
    sums, most = [], 0
    for r in starts:
        c0, c1 = np.array(r["c0"]), np.array(r["c1"])
        one, rounds = plain(x, ((x - c1) ** 2).sum(1) < ((x - c0) ** 2).sum(1))
        sums.append(sum(((x[k] - x[k].mean(0)) ** 2).sum() for k in (one, ~one)))
        most = max(most, rounds)
    assert len(starts) == 10 and most > 300
    got = I.kmeans2(df, ["g"], "v").collect()
    one = np.zeros(N, bool)
    one[[r["id"] for r in got if r["cluster"] == 1]] = True
    assert len(got) == N and sum(((x[k] - x[k].mean(0)) ** 2).sum() for k in (one, ~one)) == pytest.approx(min(sums), rel=1e-9)
