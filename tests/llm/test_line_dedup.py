"""Line deduplication against a plain evaluation, and the case each docstring names."""

import hashlib
import random

import pytest

from levelscan.llm import line_dedup

SCHEMA = "doc_id bigint, text string, row string, h string, version bigint, lost string, of_doc int, lines string, stay int"
LONG = "This line is shared by documents"


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, chars=20, docs=3):
    """One kept text a row, in order."""
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(doc_id)
    last = {k: max(i for i in h if i is not None) for k, h in holders.items() if len(h) >= docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    shared = [LONG, "  " + LONG.upper() + "\t", LONG + "\r", "short", "é" * 19, "É" * 20, "é" * 20, "K" * 20, "K" * 20, "x" * 20, " " + "y" * 19, " " * 30, "", "z" * 19 + " "]
    rows = [(i, "\n".join(draw.choice(shared) if draw.random() < 0.6 else f"own line {i} of this text {j}" for j in range(draw.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n" + LONG), (104, LONG + "\n"), (None, LONG + "\nno id"), (105, LONG + "\n" + LONG)]
    rows += [(200, "in two documents, not three"), (201, "in two documents, not three"), (201, "in two documents, not three")]  # a row twice is one document
    rows += [(202, "one id with two texts here"), (202, "other\none id with two texts here"), (203, "one id with two texts here"), (204, "one id with two texts here")]
    rows += [(300, "\n".join(f"line {i % 3000} of a very long text" for i in range(20_000))), (301, "\n".join(f"LINE {i} of a very long text" for i in range(3000))), (302, "\n".join(f" line {i} of a very long text " for i in range(0, 3000, 2)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, None, 2, "z", 3) for i, t in rows], SCHEMA)


def test_equals_brute_force(spark, rows):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.deduplicated(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert sum(r[2] for r in got) > 1000


def test_digests(spark, rows):
    got = sorted((tuple(r) for r in line_dedup.line_digests(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute(rows)), key=repr)


def test_documents_keep_their_columns(spark, rows):
    df = frame(spark, rows)
    out = line_dedup.drop_repeated_lines(df)
    assert out.schema.names == df.schema.names
    got = sorted(((r["doc_id"], r["text"], r["row"], r["stay"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, None if old is None else t, "x", 3) for (i, _, _, t), (_, old) in zip(brute(rows), rows, strict=True)), key=repr)


def test_empty_table(spark):
    none = frame(spark, [])
    assert line_dedup.line_digests(none).count() == 0 and line_dedup.drop_repeated_lines(none).columns == none.columns


def test_no_python_on_the_path(spark, rows):
    plan = line_dedup.line_digests(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
