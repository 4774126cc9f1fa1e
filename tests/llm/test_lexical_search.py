"""Ranked lexical search against a plain evaluation of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from levelscan.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score string, rank int, item_id bigint, term string"


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    """(item, rank, doc, score) with plain integers, row by row."""
    docs = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, t in docs:
            tf = Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * (10 + 90 * len(t) * n_docs // total))) for x in wanted & set(t))
            if s > 0 and doc_id is not None:
                scored.append((-s, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, 7, None) for i, t in docs], SCHEMA).repartition(3),
            spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, doc_id int"))


def found(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def case():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "été", "x9", "日本語"]
    text = lambda n: draw.choice([" ", ", ", "-"]).join(draw.choices(vocabulary, [1 / (i + 1) for i in range(44)], k=n))
    docs = [(i, text(draw.randint(1, 40))) for i in range(300)]
    docs += [(i, "w1 w2 w3 W1") for i in range(400, 430)]                               # equal scores
    docs += [(500, None), (501, ""), (502, " .,;"), (None, "w1 w2"), (503, text(30_000)), docs[3], docs[3], (3, "w7 w7 other")]
    items = [(i, text(draw.randint(1, 12))) for i in range(25)]
    items += [(30, None), (31, ""), (None, "w1"), (32, "not there"), (33, "w1 w2 w3"), (34, "w5"), (34, "w6 W5"), (35, text(3_000)), (-1, "ÉTÉ Été")]
    return docs, items


def test_equals_brute_force(spark, case):
    docs, items = case
    assert found(lexical_search.ranked_search(*frames(spark, docs, items))) == brute(docs, items)


def test_small_shards_and_blocks(spark, case, monkeypatch):
    """Many shards, shallow first reads and several blocks of items give the same."""
    docs, items = case
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical_search, "FIRST_READ", 1)
    assert found(lexical_search.ranked_search(*frames(spark, docs, items), entries=20)) == brute(docs, items)


def test_reading_stops_early():
    """A list's tail is not read once no document in it can matter; a tie at the last place is read to the end."""
    n = 4000
    doc = np.r_[np.arange(n), np.arange(20)]
    term = np.r_[np.zeros(n, np.int64), np.ones(20, np.int64)]
    impact = np.r_[np.full(n, 5), np.full(20, 1000)]
    impact[20:n] = 1
    shard = lexical_search.Shard(np.arange(n), doc, term, impact, 2)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(np.size(at))
            return super().__getitem__(at)

    shard.doc = shard.doc.view(Counted)
    places, scores = shard.search(np.array([0, 1]), 10, None)
    assert places.tolist() == list(range(10)) and set(scores.tolist()) == {1005} and sum(reads) < 1000


def test_empty_tables(spark):
    none = lexical_search.ranked_search(*frames(spark, [], [(1, "w1")]))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
    assert lexical_search.ranked_search(*frames(spark, [(1, "w1")], [])).count() == 0
    assert found(lexical_search.ranked_search(*frames(spark, [(1, "w1")], [(2, "w1")]))) == brute([(1, "w1")], [(2, "w1")])


def test_query_equals_sql(spark, folder):
    import duckdb

    from levelscan.llm.queries import op11_lexical_search

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rows = con.execute(lexical_search.SQL).fetchall()
    assert rows and sorted(rows) == found(op11_lexical_search(spark, folder))
