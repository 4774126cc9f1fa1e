"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from levelscan.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Maximal stretches for every period, the least period of each; O(n^2)."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(least, 2 * q):
                best.setdefault((s, e - s + q), q)
            s = max(e, s + 1)
    return sorted(((s, size, q) for (s, size), q in best.items()), key=lambda r: (r[0], r[2]))


def fibonacci(k):
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(k):
        a, b = b, b + a
    return b


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_all_periods(seed):
    draw = random.Random(seed)
    for _ in range(250):
        texts = []
        for _ in range(draw.randint(1, 4)):
            kind, n = draw.random(), draw.randint(0, 70)
            if kind < 0.4:
                words = [draw.choice([b"a", b"b", b"c"][: draw.choice([1, 2, 2, 3])]) for _ in range(n)]
            elif kind < 0.8:
                words = ([draw.choice([b"a", b"b"]) for _ in range(draw.randint(1, 25))] * 70)[:n]
                for _ in range(min(n, draw.randint(0, 2))):
                    words[draw.randrange(n)] = b"c"
            else:
                words = fibonacci(draw.randint(2, 8))[draw.randint(0, 6):draw.randint(7, 80)]
            texts.append(words)
        least = draw.choice([1, 2, 5, 12])
        for words, rows in zip(texts, periodic_runs.runs_of_texts(texts, least), strict=True):
            assert [tuple(r) for r in rows.tolist()] == brute(words, least)


def test_long_texts_in_bounded_time():
    draw = random.Random(1)
    words = [b"w%d" % draw.randrange(500) for _ in range(200_000)]
    words[1000:41_000] = words[1000:1100] * 400
    assert periodic_runs.runs_of_texts([words])[0].tolist() == [[1000, 40_000, 100]] or words[999] == words[1099] or words[41_000] == words[40_900]
    assert periodic_runs.runs_of_texts([[b"a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]
    # proposals grow with the places, not with the pairs of equal words
    length, _, places, group = next(periodic_runs.basic_factors(np.zeros(50_000, np.int64)))
    assert len(periodic_runs.proposed(length, places, group)[0]) <= 6 * 50_000


def digests(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
SCHEMA = "doc_id bigint, text string, runs string, start bigint, best string, listed int"


def test_query_equals_brute_force(spark):
    draw = random.Random(2)
    texts = [None, "", " \t\n", "one", "x " * 40, "é ü   " * 9, "a b c " * 5 + "d " + "a b c d " * 6, "a b " * 6 + "c " + "a b " * 6, "a\x1cb " * 15]
    texts += [" ".join(draw.choice(["the", "of", "and", "to"]) for _ in range(draw.randint(0, 120))) for _ in range(60)]
    texts += [" ".join(f"w{draw.randrange(40)}" for _ in range(1500))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, texts[4]), (-7, texts[6])]
    df = spark.createDataFrame([(i, t, "x", 1, None, 2) for i, t in rows], SCHEMA)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in periodic_runs.run_digests(df).collect()), key=repr)
    assert got == sorted((digests(*r) for r in rows), key=repr)


def test_registered_query(spark, folder):
    from levelscan.llm.queries import op12_periodic_runs

    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    short = [r for r in rows if len(r["text"] or "") < 6000]
    assert len(short) > 100 and all(got[r["doc_id"]] == digests(r["doc_id"], r["text"]) for r in short)


def test_interface(spark):
    df = spark.createDataFrame([(1, "a b " * 8 + "end")], "doc_id bigint, text string")
    r = periodic_runs.detect_runs(df).first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) == (17, [(0, 16, 2)], "a b end")
    assert periodic_runs.detect_runs(df.limit(0)).count() == 0 and periodic_runs.run_digests(df.limit(0)).columns == COLUMNS
