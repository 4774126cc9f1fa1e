"""Text, map and chain expressions against cases and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from levelscan.functions import predicates as P
from levelscan.functions import scalars as S


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col).first()[0]


@pytest.mark.parametrize("text,want", [
    ("The answer is Thames.", "thames"), ("ANSWER: Project Mercury", "project mercury"), ("...therefore, Poland.\n", "poland"),
    ("Step 1: blah\nStep 2: blah\nParis", "paris"), ("ANSWER: the Thames river", "the thames river"), ("", ""),
])
def test_free_answer(spark, text, want):
    assert one(spark, text, S.extract_free_answer("text")).lower().strip(".") == want


@pytest.mark.parametrize("pred,truth,aliases,want", [
    ("Thames", "Thames", [], True), ("the thames", "Thames", [], True), ("Kensington", "in Kensington", [], True), ("wrong answer", "Thames", [], False),
    ("John Locke philosopher", "John Locke", [], True), ("Project Mercury", "Project Mercury", ["Mercury Program"], True),
    ("Mercury Program", "Project Mercury", ["Mercury Program"], True), ("", "Thames", [], False),
])
def test_fuzzy_match(spark, pred, truth, aliases, want):
    df = spark.createDataFrame([(pred, truth, aliases)], "p string, t string, a array<string>")
    assert df.select(S.fuzzy_match("p", "t", F.col("a"))["correct"]).first()[0] is want


@pytest.mark.parametrize("text,want", [
    ("The final answer is 1,234", 1234), ("so\n**-7**", -7), ("a = 3\nb = 12", 3), ("Final answer is: 7", 7), ("nothing", None), ("\\boxed{42} then 5", 42),
])
def test_integer_answer(spark, text, want):
    assert one(spark, text, S.extract_integer_answer("text")) == want


@pytest.mark.parametrize("text,want", [
    ("answer: true ... answer is FALSE", "FALSE"), ("TRUE then false", "FALSE"), ("yes or no", "FALSE"), ("it looks incorrect", "FALSE"), ("hm", None),
])
def test_boolean_answer(spark, text, want):
    assert one(spark, text, S.extract_boolean_answer("text")) == want


@pytest.mark.parametrize("text,want", [
    ("Node 0: Red, Node 1: Green, Node 2: Blue", {0: "red", 1: "green", 2: "blue"}),
    ("Node 0: Blue Node 1: Blue\nNode 0: Red, Node 1: Green, Node 2: Blue", {0: "red", 1: "green", 2: "blue"}),
    ("0: red, 1 = green, 2 -> blue", {0: "red", 1: "green", 2: "blue"}), ("Node 0: red, Node 2: blue", None), ("", None),
])
def test_assignment_map(spark, text, want):
    df = S.assignment_maps(spark.createDataFrame([(text,)], "text string"), "text", 3)
    assert df.select("assignment").first()[0] == want


def test_lenient_assignments(spark):
    got = one(spark, "Node 0: Red, Node 1: green, Node 1: Blue", S.lenient_assignments("text", 3))
    assert [(r["node"], r["colour"]) for r in got] == [(0, "red"), (1, "blue")]


def test_certainty_autocorr(spark):
    text = "1. therefore it must follow clearly\n2. maybe this could be wrong\n3. hence it follows so\n4. perhaps it seems unclear"
    steps = [s.strip() for s in re.split(r"(?:(?:^|\n)\s*(?:\d+[.):]|Step\s+\d+|[-*]\s))", text) if len(s.strip()) > 10]
    c = [(sum(w in S.ASSERTIVE for w in s.lower().split()) - sum(w in S.HEDGING for w in s.lower().split())) / len(s.split()) for s in steps]
    m = sum(c) / len(c)
    z = [x - m for x in c]
    want = sum(a * b for a, b in zip(z, z[1:])) / (sum(x * x for x in z) + 1e-10)
    assert one(spark, text, S.certainty_autocorr("text")) == pytest.approx(want)
    assert one(spark, "too short", S.certainty_autocorr("text")) is None


def test_step_correctness(spark):
    df = spark.createDataFrame([("10 then 12, 5, 15 and 9", [10, 12, 15, 9, 3])], "text string, want array<bigint>")
    hits = df.select(S.step_correctness("text", F.col("want")).alias("h"))
    assert hits.first()[0] == [1.0, 1.0, 1.0, 0.0]
    assert hits.select(S.step_correctness_autocorr("h")).first()[0] is None  # the leading part is flat


def test_claims_keep_context(spark):
    line = "x" * 70 + " F1=0.949 and again F1=0.949 at p < 0.05 " + "y" * 70
    rows = S.extract_claims(spark.createDataFrame([(line,)], "line string")).collect()
    f1 = [r for r in rows if r["value_type"] == "f1_score"]
    assert [r["value"] for r in f1] == ["0.949", "0.949"]
    starts = [m.start() for m in re.finditer("F1=0.949", line)]
    assert [r["context"] for r in f1] == [line[max(0, s - 60) : s + 8 + 60] for s in starts]
    assert [r["value"] for r in rows if r["value_type"] == "p_value"] == ["0.05"]


def test_claims_without_context_are_scanned_once(spark):
    lines = ["F1=0.949 [0.91, 0.95] at p < 0.05, N = 12", "AUROC = 0.88 and AUC=0.7, 12% of $3K", "recall is 0.5; improved it by 3%", "no digit", "7 and no claim", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    bare = S.extract_claims(df, margin=None)
    want = [(r["line"], r["value_type"], r["value"]) for r in S.extract_claims(df).collect()]
    assert len(want) > 8 and sorted(tuple(r) for r in bare.collect()) == sorted(want)
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(S.CLAIM_PATTERNS) + 1  # intervals have two groups


def test_paraphrases_and_keyword_baseline(spark):
    got = one(spark, "Compute: Add 3. What is the final result?", S.paraphrases("text"))
    assert got[0] == "Work out: Add 3. What is the final result?" and len(got) == 5
    text = "1. No cats are dogs.\n2. All dogs run.\nBased on the above, is it true that all cats run?"
    assert one(spark, text, S.keyword_baseline("text")) == "FALSE"


def test_safe_float_and_short_name(spark):
    df = spark.createDataFrame([("nan",), ("None",), ("1.5",), ("inf",), (None,)], "x string")
    assert [r[0] for r in df.select(P.safe_float("x", -1.0)).collect()] == [-1.0, -1.0, 1.5, -1.0, -1.0]
    m = spark.createDataFrame([("a/b/c",), ("known",)], "m string")
    assert [r[0] for r in m.select(P.short_name("m", {"known": "K"})).collect()] == ["c", "K"]
