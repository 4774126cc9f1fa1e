"""Draws the null distribution of the dip and prints the table that levelscan.functions.special states.

A row per sample size: the values that sqrt(n) * dip of n uniform numbers reaches with the given chances.  The last row is the limit law: the mean of the
sizes from 100 on, which differ by no more than their noise.  ``python tools/dip_surface.py [seconds]``; seeds are fixed.
"""

import os
import sys
import time
from multiprocessing import Pool

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from levelscan.operators.indicators import dip_of

SIZES = (4, 6, 8, 10, 15, 20, 30, 50, 100, 200, 500, 1000)
SHARES = (0.99, 0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.001)


def draws(task):
    n, part, reps = task
    rng = np.random.default_rng([n, part])
    return n, [dip_of(np.sort(rng.random(n)), np.ones(n)) * n**0.5 for _ in range(reps)]


def main():
    budget = float(sys.argv[1]) if len(sys.argv) > 1 else 60.0
    tasks = [(n, p, max(40, int(budget * 8 / len(SIZES) / 16 / (2.2e-5 * n + 2e-4)))) for n in SIZES for p in range(16)]
    got = {n: [] for n in SIZES}
    began = time.time()
    with Pool(8) as pool:
        for n, values in pool.imap_unordered(draws, sorted(tasks, reverse=True)):
            got[n] += values
    table = np.array([np.quantile(got[n], 1 - np.array(SHARES)) for n in SIZES])
    late = np.array(SIZES) >= 100
    limit = np.average(table[late], axis=0, weights=[len(got[n]) for n in np.array(SIZES)[late]])
    print("# seconds", round(time.time() - began), "draws", {n: len(v) for n, v in got.items()})
    for row in [*table[~late], limit]:
        print("    (" + ", ".join(f"{x:.4f}" for x in row) + "),")


if __name__ == "__main__":
    main()
