"""Item generators over a table of seeds: every row of the table becomes one item, by keyed draws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from levelscan.functions.predicates import short_answer
from levelscan.functions.scalars import hop_count, self_contained
from levelscan.operators.windows import stratified_pick
from levelscan.plans.draws import coin, digits_below, hash32, order_key
from levelscan.plans.session import cut_lineage

BOUND = 10000

# Fixed values: (level, nodes, edge probability, colours).
GRAPH_LEVELS = (
    (1, 4, 0.30, 4), (2, 4, 0.50, 4), (3, 4, 0.60, 3), (4, 5, 0.30, 4), (5, 5, 0.40, 3), (6, 5, 0.60, 3), (7, 6, 0.30, 3),
    (8, 6, 0.50, 3), (9, 7, 0.30, 3), (10, 7, 0.40, 3), (11, 7, 0.55, 3), (12, 8, 0.30, 3), (13, 8, 0.40, 3), (14, 8, 0.50, 3),
    (15, 9, 0.35, 3), (16, 9, 0.45, 3), (17, 10, 0.30, 3), (18, 10, 0.40, 3), (19, 11, 0.35, 3), (20, 12, 0.35, 3),
)


_MOVES = T.StructType([T.StructField("vals", T.ArrayType(T.LongType())), T.StructField("ops", T.ArrayType(T.StringType())), T.StructField("args", T.ArrayType(T.LongType()))])


def _chain_moves(bound: int):
    """Arrow batches of (start, draws): one legal move per draw, all chains of a batch a step at a time."""

    @F.pandas_udf(_MOVES)
    def moves(start: pd.Series, draws: pd.Series) -> pd.DataFrame:
        sizes = draws.map(len).to_numpy()
        flat, first = np.concatenate([*draws, np.empty(0, np.int64)]).astype(np.int64), np.cumsum(sizes) - sizes
        vals, ops, args = (np.zeros(len(flat), np.int64) for _ in range(3))
        v = start.to_numpy().astype(np.int64)
        for i in range(sizes.max(initial=0)):
            on = sizes > i
            at, x = first[on] + i, v[on]
            add = np.maximum(np.minimum(99, bound - x) - 9, 0)
            sub = add + np.maximum(np.minimum(99, bound + x) - 9, 0)
            mul = np.where(x == 0, 0, np.maximum(np.minimum(9, bound // np.maximum(np.abs(x), 1)) - 1, 0))
            r = flat[at] % (sub + mul)
            op = (r >= add).astype(np.int64) + (r >= sub)
            arg = np.where(op == 0, 10 + r, np.where(op == 1, 10 + r - add, 2 + r - sub))
            v[on] = vals[at] = np.where(op == 0, x + arg, np.where(op == 1, x - arg, x * arg))
            ops[at], args[at] = op, arg
        cuts = first[1:]
        names = np.array(["+", "-", "×"], dtype=object)[ops]
        parts = [np.split(c, cuts) if len(sizes) else [] for c in (vals, names, args)]
        return pd.DataFrame({"vals": [np.concatenate([[s], p]) for s, p in zip(start, parts[0])], "ops": parts[1], "args": parts[2]})

    return moves


def arithmetic_chains(seeds: DataFrame, item: str = "item_id", level: str = "level", seed: int = 42, bound: int = BOUND) -> DataFrame:
    """Chains of ``level`` steps from a start of 10..99; each step is uniform over all legal moves.

    Legal: + and - with 10..99, times 2..9 (not on 0), values within +-bound.  The number of legal moves
    of each kind is arithmetic in the current value, so one draw picks the move.
    """
    chain = seeds.withColumn("_start", (10 + hash32(seed, F.col(item), F.lit("start")) % 90).cast("bigint"))
    chain = chain.withColumn("_key", F.concat_ws("|", F.lit(seed).cast("string"), F.col(item).cast("string"), F.lit("")))
    draws = F.transform(F.sequence(F.lit(1), F.col(level)), lambda i: F.conv(order_key(F.concat("_key", i.cast("string"))), 16, 10).cast("bigint"))
    moves = _chain_moves(bound)("_start", F.coalesce(draws, F.array().cast("array<bigint>")))
    chain = chain.withColumn("_c", F.when(F.col(level).isNotNull(), moves))
    words = F.create_map(F.lit("+"), F.lit("Add"), F.lit("-"), F.lit("Subtract"), F.lit("×"), F.lit("Multiply by"))
    lines = F.transform(F.arrays_zip(F.col("_c.ops").alias("o"), F.col("_c.args").alias("a")), lambda x, i: F.concat(
        F.lit("Step "), (i + 1).cast("string"), F.lit(": "), words[x["o"]], F.lit(" "), x["a"].cast("string")))
    text = F.concat(
        F.lit("Compute the following step by step, showing your work for each operation. What is the final result?\n\nStart with "),
        F.element_at("_c.vals", 1).cast("string"), F.lit(".\n"), F.array_join(lines, "\n"), F.lit("\n\nProvide your final numerical answer."))
    return chain.select(
        *seeds.columns, text.alias("input"), F.element_at("_c.vals", -1).cast("string").alias("output"),
        F.col("_c.vals").alias("intermediates"), F.col("_c.ops").alias("operations"), F.col("_c.args").alias("operands"))


def _connected(n: Column, everything: Column, masks: Column) -> Column:
    """Do the edges, each the sum of 2^end, join nodes 0..n-1, whose sum of 2^node is ``everything``?  The set reached from node 0 is one number that grows inside the row."""
    def touch(seen, m):
        return F.when(seen.bitwiseAND(m) != 0, seen.bitwiseOR(m)).otherwise(seen)

    def grow(seen, _i):
        return F.when(seen == everything, seen).otherwise(F.aggregate(masks, seen, touch))

    return (F.size(masks) >= n - 1) & (F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(1).cast("bigint"), grow) == everything)


def _graph_levels() -> Column:
    """The level table as a literal: nodes, probability, colours, and per pair of nodes the end of its draw's key and its mask."""
    def pair(u, v):
        return F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(f"{u}|{v}").alias("key"), F.lit(2**u + 2**v).cast("bigint").alias("mask"))

    return F.array(*[F.struct(
        F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(digits_below(p)).alias("below"), F.lit(2**n - 1).cast("bigint").alias("all"),
        F.array(*[pair(u, v) for u in range(n) for v in range(u + 1, n)]).alias("pairs")) for _l, n, p, k in GRAPH_LEVELS])


def random_graphs(attempts: DataFrame, attempt: str = "attempt", level: str = "level", per_level: int | None = 20, seed: int = 42) -> DataFrame:
    """Random graphs by the level table: connected, two edges or more, distinct edge sets per level, the first ones kept.

    An attempt's edges are drawn once, in the generator that drops it where they don't join its nodes: a filter on drawn columns
    would move before the caller's shuffle and draw them again.
    """
    extra = [c for c in attempts.columns if c not in (level, attempt)]
    g = attempts.withColumn("_t", F.get(_graph_levels(), F.col(level) - 1)).select("*", "_t.*").drop("_t")
    g = g.withColumn("_key", F.concat_ws("|", F.lit(seed).cast("string"), F.col(level).cast("string"), F.col(attempt).cast("string"), F.lit("")))
    drawn = F.filter("pairs", lambda e: order_key(F.concat("_key", e["key"])) < F.col("below"))
    good = F.filter(F.array(drawn), lambda e: (F.size(e) >= 2) & _connected(F.col("n"), F.col("all"), e["mask"]))
    g = g.select(*attempts.columns, "n", "p", "k", F.explode(good).alias("_e"))
    g = g.withColumn("edges", F.transform("_e", lambda e: F.array(e["u"], e["v"]))).drop("_e")
    # pairs come in one order, so equal sets are equal lists
    first = [F.min(attempt).alias(attempt), *([F.min_by(F.struct(*extra), attempt).alias("_r")] if extra else [])]
    uniq = g.groupBy(level, "n", "p", "k", "edges").agg(*first)
    uniq = uniq.select(level, attempt, *(["_r.*"] if extra else []), "n", "p", "k", "edges")
    return uniq if per_level is None else stratified_pick(uniq, per_level, [level], [F.col(attempt)])


def k_colourable(graphs: DataFrame, keys: Sequence[str], edges: str = "edges", n: str = "n", k: str = "k") -> DataFrame:
    """Graphs with a proper colouring, and the smallest one.

    Node by node every partial colouring is extended by each allowed colour; a new colour may only be
    the next unused one, which drops mirror images.  No shuffle until the smallest is taken.  All nodes are
    coloured: their largest number comes from the table.
    """
    keys = list(keys)
    graphs = cut_lineage(graphs)  # read for the number of nodes and for the colours
    nodes = graphs.agg(F.max(n)).first()[0] or 1
    rows = graphs.withColumn("colouring", F.array(F.lit(0)))
    for i in range(1, nodes):
        used = F.array_max("colouring")
        before = F.transform(F.filter(edges, _ends_at(i)), lambda e: e[0])
        choice = F.filter(F.sequence(F.lit(0), F.least(used + 1, F.col(k) - 1)), lambda c: ~F.exists(before, lambda u: F.get("colouring", u) == c))
        grown = F.transform(choice, lambda c: F.array_append("colouring", c))
        rows = rows.withColumn("colouring", F.explode(F.when(F.col(n) > i, grown).otherwise(F.array("colouring"))))
    rest = [c for c in graphs.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min("colouring").alias("colouring"), F.first(F.struct(*rest)).alias("_r")).select(*keys, "_r.*", "colouring")


def _ends_at(i: int):
    return lambda e: e[1] == i


def entity_names(count: int = 60) -> list[str]:
    """Invented plural nouns by a syllable rule."""
    c, v = "bdfgklmnprstvz", "aeiou"
    return [f"{c[i % 14]}{v[i % 5]}{c[(i * 3 + 1) % 14]}{v[(i // 5) % 5]}{c[(i * 5 + 2) % 14]}s" for i in range(count)]


# Quantifiers, conclusions and their contradictions; five items per template.
TEMPLATES = ("A", "B", "C", "D")
CONCLUSION = {"A": "all", "B": "some", "C": "no", "D": "some_not"}
CONTRADICTION = {"all": "some_not", "some": "no", "no": "some", "some_not": "all"}
TRUE_COUNT = {"A": 3, "B": 2, "C": 3, "D": 2}


def _case(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def syllogism_items(seeds: DataFrame, item: str = "item_id", level: str = "level", index: str = "index", names: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Chains of ``level`` premises over distinct entities; ``index`` 0..19 inside a level fixes template and truth.

    Templates: A all...all; B some, all...; C all..., no; D some, all..., no.  FALSE items ask the contradiction.
    """
    names = list(names or entity_names())
    d, it = F.col(level), F.col(item)
    template = F.get(F.array(*map(F.lit, TEMPLATES)), F.floor(F.col(index) / 5).cast("int") % 4)
    s = seeds.withColumn("template", template)
    s = s.withColumn("truth", F.col(index) % 5 < _case(F.col("template"), TRUE_COUNT))
    pool = F.array(*map(F.lit, names))
    # sort_array compares structs natively, array_sort by a lambda
    order = F.sort_array(F.transform(pool, lambda x: F.struct(order_key(seed, it, F.lit("name"), x).alias("h"), x.alias("x"))))
    s = s.withColumn("entities", F.transform(F.slice(order, 1, d + 1), lambda t: t["x"]))
    first, last = F.col("template").isin("B", "D"), F.col("template").isin("C", "D")
    s = s.withColumn("quantifiers", F.transform(F.sequence(F.lit(1), d), lambda i: F.when(first & (i == 1), "Some").when(last & (i == d), "No").otherwise("All")))

    def one(x):
        return F.regexp_replace(x, "s$", "")

    def art(x):
        return F.concat(F.when(F.rlike(x, F.lit("^[aeiou]")), "an ").otherwise("a "), one(x))

    def premise(q, a, b, alt):
        plain = F.concat(q, F.lit(" "), a, F.lit(" are "), b, F.lit("."))
        other = F.when(q == "Some", F.concat(F.lit("There exist "), a, F.lit(" that are "), b, F.lit("."))).otherwise(
            F.concat(F.when(q == "All", "Every ").otherwise("No "), one(a), F.lit(" is "), art(b), F.lit(".")))
        return F.when(alt, other).otherwise(plain)

    lines = F.transform(F.sequence(F.lit(1), d), lambda i: F.struct(
        order_key(seed, it, F.lit("order"), i).alias("h"),
        premise(F.get("quantifiers", i - 1), F.get("entities", i - 1), F.get("entities", i), coin(seed, it, F.lit("form"), i)).alias("t")))
    numbered = F.transform(F.sort_array(lines), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["t"]))
    asked = F.when(F.col("truth"), _case(F.col("template"), CONCLUSION)).otherwise(_case(_case(F.col("template"), CONCLUSION), CONTRADICTION))
    s = s.withColumn("conclusion_type", asked)
    a, b = F.col("entities")[0], F.element_at("entities", -1)
    verb = F.when(F.col("conclusion_type") == "some_not", " are not ").otherwise(" are ")
    query = F.concat(F.regexp_replace(F.col("conclusion_type"), "_not$", ""), F.lit(" "), a, verb, b)
    text = F.concat(F.lit("Consider the following statements:\n"), F.array_join(numbered, "\n"),
                    F.lit("\n\nBased on the above statements, is it true that "), query, F.lit("? Answer TRUE or FALSE."))
    return s.withColumns({
        "input": text, "output": F.when(F.col("truth"), "TRUE").otherwise("FALSE"), "quantifier_pattern": F.array_join("quantifiers", "-"), "n_premises": F.size("quantifiers")})


def multi_hop_items(questions: DataFrame, qid: str = "qid", decomposition: str = "decomposition", per_hop: int = 30, seed: int = 42, hops: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """Items (hop, id): one-hop from the first self-contained sub-question with a short answer (distinct texts), n-hop whole questions.

    Picks are by keyed hash; only ``per_hop`` rows per hop survive, before any wide column moves.
    """
    first = F.col(decomposition)[0]
    one = questions.select(F.col(qid).alias("id"), first["question"].alias("question"), first["answer"].alias("answer")).where(
        self_contained(F.col("question")) & short_answer(F.col("answer")))
    one = one.groupBy(F.lower(F.trim("question")).alias("_k")).agg(F.min("id").alias("id"), F.min_by("answer", "id").alias("answer")).select(F.lit(1).alias("hop"), "id", "answer")
    n = hop_count(F.col(decomposition))
    many = questions.where(n.isin(*hops)).select(n.alias("hop"), F.col(qid).alias("id"), F.element_at(F.col(decomposition), -1)["answer"].alias("answer"))
    return stratified_pick(one.unionByName(many), per_hop, ["hop"], [hash32(seed, F.col("hop"), F.col("id")), F.col("id")])

