"""Text, array and map expressions over response, item and document tables.

Everything is a native column expression; regular expressions carry the flags (?imd) so that line
ends behave as in other engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends (plain character trimming, no regular expression)."""
    return F.btrim(_c(c), F.lit(" \t\n\r\x0b\f"))


def drop_final_dots(c: Column) -> Column:
    return F.rtrim(c, F.lit("."))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


# Answer patterns in order of priority.
INTEGER_PATTERNS = (
    r"(?:final\s+(?:answer|result)\s*(?:is|=|:)\s*)(-?\d[\d,]*)",
    r"(?:the\s+(?:answer|result)\s*(?:is|=|:)\s*)(-?\d[\d,]*)",
    r"\*\*(-?\d[\d,]*)\*\*\s*$",
    r"=\s*(-?\d[\d,]*)\s*$",
    r"(?:equals|equal\s+to)\s+(-?\d[\d,]*)",
    r"boxed\{(-?\d[\d,]*)\}",
)
INTEGER_FALLBACK = r"-?\d+"
INTEGER_PATTERNS_B = (
    r"(?:final|the)\s+(?:answer|result)\s+(?:is|=|:)\s*\**\s*(-?\d[\d,]*)",
    r"\*\*(-?\d[\d,]*)\*\*\s*$",
    r"(?:=|equals?|is)\s*\**\s*(-?\d[\d,]*)\s*\**\s*$",
    r"\\boxed\{(-?\d[\d,]*)\}",
    r"result\s*(?:is|=|:)\s*\**\s*(-?\d[\d,]*)",
    r"(?:^|\n)\s*(-?\d[\d,]*)\s*$",
)
INTEGER_FALLBACK_B = r"(?<![.\d])(-?\d[\d,]*)(?![.\d])"
BOOLEAN_PATTERNS = (
    r"(?:final\s+)?answer\s*(?:is|:)\s*(TRUE|FALSE)",
    r"\*\*(?:answer|final answer)\s*(?:is|:)?\s*(TRUE|FALSE)\*\*",
    r"(?:therefore|thus|hence|so|conclusion)\s*(?:,\s*)?(?:the\s+(?:answer|statement)\s+is\s+)?(TRUE|FALSE)",
    r"(?:it\s+is\s+)(TRUE|FALSE)",
    r"\b(TRUE|FALSE)\b",
)
FREE_ANSWER_LINE = r"ANSWER:\s*(.+?)(?:\n|$)"
FREE_ANSWER_PATTERNS = (
    r"(?:the\s+)?(?:final\s+)?answer\s+is[:\s]+(.+?)(?:\.|$)",
    r"(?:therefore|thus|so|hence)[,\s]+(?:the\s+answer\s+is\s+)?(.+?)(?:\.|$)",
)
ANSWER_PREFIXES = ("the ", "a ", "an ", "in ", "at ", "on ")
COLOURS = {3: ("red", "green", "blue"), 4: ("red", "green", "blue", "yellow")}
SOLUTION_MARKERS = ("final answer", "answer:", "solution:", "coloring:")
HEDGING = (
    "maybe", "perhaps", "might", "possibly", "uncertain", "could", "seems", "unclear", "assume",
    "suppose", "not sure", "likely", "probably",
)
ASSERTIVE = (
    "therefore", "clearly", "must", "definitely", "certainly", "thus", "hence", "conclude", "follows",
    "so", "proven", "established", "confirmed", "means",
)
STEP_PATTERN = r"(?:(?:^|\n)\s*(?:\d+[.):]|Step\s+\d+|[-*]\s))"


def _to_long(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("bigint")


def extract_integer_answer(text: Column | str, variant: str = "a") -> Column:
    """First pattern that hits gives the number (commas dropped); else the last integer of the text."""
    t = _c(text)
    patterns = INTEGER_PATTERNS if variant == "a" else INTEGER_PATTERNS_B
    hits = [_to_long(first_group(t, f"(?imd){p}")) for p in patterns]
    if variant == "a":
        last = last_group(t, INTEGER_FALLBACK, 0).try_cast("bigint")
    else:
        last = _to_long(last_group(t, INTEGER_FALLBACK_B))
    return F.coalesce(*hits, last)


def extract_boolean_answer(text: Column | str) -> Column:
    """Last match of the first pattern that occurs: TRUE/FALSE, then yes/no, then correct/incorrect."""
    t = _c(text)
    direct = [F.upper(last_group(t, f"(?id){p}")) for p in BOOLEAN_PATTERNS]
    yes = F.lower(last_group(t, r"(?id)\b(yes|no)\b"))
    ok = F.lower(last_group(t, r"(?id)\b(correct|incorrect)\b"))
    return F.coalesce(
        *direct,
        F.when(yes == "yes", "TRUE").when(yes == "no", "FALSE"),
        F.when(ok == "correct", "TRUE").when(ok == "incorrect", "FALSE"),
    )


def extract_free_answer(text: Column | str) -> Column:
    t = _c(text)

    def found(p):
        hit = F.regexp_extract(t, p, 0) != ""
        return F.when(hit, drop_final_dots(strip(F.regexp_extract(t, p, 1))))

    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda s: s != "")
    tail = F.substring(F.try_element_at(lines, F.lit(-1)), 1, 100)
    return F.coalesce(*[found(f"(?id){p}") for p in (FREE_ANSWER_LINE, *FREE_ANSWER_PATTERNS)], tail, F.lit(""))


def _assignments(text: Column, pattern: str, n: Column | int) -> Column:
    """(node, colour) matches in text order, nodes below n only."""
    node = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    colour = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    both = F.zip_with(node, colour, lambda a, b: F.struct(a.try_cast("int").alias("node"), F.lower(b).alias("colour")))
    return F.filter(both, lambda m: m["node"] < n)


def _first(matches: Column, node: Column) -> Column:
    return F.try_element_at(F.filter(matches, lambda m: m["node"] == node), F.lit(1))["colour"]


def _last(matches: Column, node: Column) -> Column:
    return F.try_element_at(F.filter(matches, lambda m: m["node"] == node), F.lit(-1))["colour"]


def assignment_maps(df: DataFrame, text: str, n: Column | int, out: str = "assignment", colours: int = 3) -> DataFrame:
    """Adds node -> colour for nodes 0..n-1, or NULL unless every node has a colour.

    The last n explicit 'Node i: colour' matches come first; missing nodes are filled from bare
    'i: colour' pairs; if some are still missing, pairs after a solution marker override; then
    JSON-like pairs fill what is left.
    """
    t = F.col(text)
    n = F.lit(n) if isinstance(n, int) else n
    names = "|".join(COLOURS.get(colours, COLOURS[3]))
    explicit = rf"(?id)node\s*(\d+)\s*[:=\->]+\s*({names})"
    bare = rf"(?id)(?<!\w)(\d+)\s*[:=\->]+\s*({names})(?!\w)"
    loose = rf'(?id)"?(\d+)"?\s*:\s*"?({names})"?'
    complete = F.forall("_got", lambda c: c.isNotNull())
    low = F.lower(t)
    df = df.withColumns({"_n": n, "_all": _assignments(t, explicit, n), "_bare": _assignments(t, bare, n), "_loose": _assignments(t, loose, n)})
    df = df.withColumns({"_nodes": F.sequence(F.lit(0), F.col("_n") - 1), "_block": F.slice("_all", F.greatest(F.size("_all") - F.col("_n") + 1, F.lit(1)), F.col("_n"))})
    df = df.withColumn("_got", F.transform("_nodes", lambda i: F.coalesce(_first(F.col("_block"), i), _first(F.col("_bare"), i))))
    tails = []
    for k, marker in enumerate(SOLUTION_MARKERS):
        at = F.length(t) - F.locate(marker[::-1], F.reverse(low)) - len(marker) + 2
        tail = F.when(F.contains(low, F.lit(marker)), F.substr(t, at)).otherwise("")
        df = df.withColumn(f"_tail{k}", _assignments(tail, explicit, n))
        tails.append(f"_tail{k}")
    df = df.withColumn("_done", complete)
    late = F.transform(
        "_nodes", lambda i: F.coalesce(*[_last(F.col(k), i) for k in reversed(tails)], F.get("_got", i))
    )
    df = df.withColumn("_got", F.when(F.col("_done"), F.col("_got")).otherwise(late))
    df = df.withColumn("_got", F.transform("_nodes", lambda i: F.coalesce(F.get("_got", i), _first(F.col("_loose"), i))))
    df = df.withColumn(out, F.when(complete, F.map_from_arrays("_nodes", "_got")))
    return df.drop("_n", "_all", "_bare", "_loose", "_nodes", "_block", "_got", "_done", *tails)


def lenient_assignments(text: Column | str, n: Column | int) -> Column:
    """Pairs 'Node i: Word' as an array of (node, colour), later ones winning; NULL if two or more nodes are missing."""
    t = _c(text)
    node = F.regexp_extract_all(t, F.lit(r"[Nn]ode\s+(\d+)\s*[:=\->]+\s*([A-Za-z]+)"), F.lit(1))
    word = F.regexp_extract_all(t, F.lit(r"[Nn]ode\s+(\d+)\s*[:=\->]+\s*([A-Za-z]+)"), F.lit(2))
    pairs = F.zip_with(node, word, lambda a, b: F.struct(a.try_cast("int").alias("node"), F.lower(b).alias("colour")))
    ids = F.array_sort(F.array_distinct(F.transform(pairs, lambda m: m["node"])))
    out = F.transform(ids, lambda i: F.struct(i.alias("node"), _last(pairs, i).alias("colour")))
    return F.when(F.size(out) >= F.greatest(F.lit(1), (F.lit(n) if isinstance(n, int) else n) - 1), out)


def clean_answer(text: Column | str) -> Column:
    """Lower, trim, drop final dots, then drop each leading article or preposition once, in order."""
    t = drop_final_dots(strip(F.lower(_c(text))))
    once = "".join(f"(?:{p})?" for p in ANSWER_PREFIXES)
    return strip(F.regexp_replace(t, f"^{once}", ""))


def fuzzy_match(pred: Column | str, truth: Column | str, aliases: Column) -> Column:
    """struct(correct, score): exact 1.0, containment either way 0.9 (truth, then aliases), else token F1 >= 0.5."""
    known = F.concat(F.array(truth), F.coalesce(aliases, F.array().cast("array<string>")))
    cleaned = F.transform(F.concat(F.array(pred), known), clean_answer)
    return let(cleaned, _grade)


def _grade(cleaned: Column) -> Column:
    p, g = cleaned[0], cleaned[1]
    known = F.slice(cleaned, 2, F.size(cleaned) - 1)
    grade = F.transform(
        known,
        lambda a: F.when(p == a, 1.0).when((a != "") & (F.contains(p, a) | F.contains(a, p)), 0.9),
    )
    quick = F.try_element_at(F.filter(grade, lambda x: x.isNotNull()), F.lit(1))
    tp, tg = F.array_distinct(F.split(p, r"\s+")), F.array_distinct(F.split(g, r"\s+"))
    common = F.size(F.array_intersect(tp, tg))
    f1 = 2.0 * common / (F.size(tp) + F.size(tg))
    tokens = let(f1, lambda x: F.when((g != "") & (x >= 0.5), x))
    score = F.when(p == "", 0.0).otherwise(F.coalesce(quick, tokens, F.lit(0.0)))
    return let(score, lambda x: F.struct((x > 0).alias("correct"), x.alias("score")))


def canonical_assignment(assignment: Column | str) -> Column:
    """Sorted entries of a map as text, so equal assignments count as one answer."""
    return F.to_json(F.array_sort(F.map_entries(_c(assignment))))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def certainty_autocorr(text: Column | str, hedging: Sequence[str] = HEDGING, assertive: Sequence[str] = ASSERTIVE) -> Column:
    """Lag-1 autocorrelation of (assertive - hedging) / words over the steps of a response.

    NULL for fewer than three steps, 0 for a flat series.
    """
    steps = F.filter(F.transform(F.split(_c(text), STEP_PATTERN), strip), lambda s: F.length(s) > 10)
    sure, unsure = F.array(*map(F.lit, assertive)), F.array(*map(F.lit, hedging))

    def score(step):
        def share(words):
            good = F.size(F.filter(words, lambda w: F.array_contains(sure, w)))
            bad = F.size(F.filter(words, lambda w: F.array_contains(unsure, w)))
            return (good - bad) / F.size(words).cast("double")

        return let(F.split(F.lower(step), r"\s+"), share)

    def centre(c):
        return let(_mean(c), lambda m: F.transform(c, lambda x: x - m))

    return let(F.transform(steps, score), lambda c: F.when(F.size(c) >= 3, let(centre(c), lag1)))


def lag1(centred: Column) -> Column:
    """Lag-1 autocorrelation of a centred series, 0 if it is flat."""
    n = F.size(centred)
    nxt = F.slice(centred, 2, F.greatest(n - 1, F.lit(0)))
    now = F.slice(centred, 1, F.greatest(n - 1, F.lit(0)))
    cross = F.aggregate(F.zip_with(now, nxt, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(F.transform(centred, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return let(square, lambda q: F.when(F.sqrt(q / n) < 1e-8, 0.0).otherwise(cross / (q + 1e-10)))


def step_correctness(text: Column | str, expected: Column) -> Column:
    """1/0 per expected integer (the first one is the start value and is skipped), searched greedily in order."""
    numbers = F.transform(F.regexp_extract_all(_c(text), F.lit(r"-?\d+"), F.lit(0)), lambda s: s.try_cast("bigint"))

    todo = F.slice(expected, 2, F.greatest(F.size(expected) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<double>").alias("hits"))

    def search(nums):
        def step(state, want):
            rest = F.slice(nums, state["at"] + 1, F.size(nums))
            pos = F.array_position(rest, want.cast("bigint")).cast("int")
            return F.struct(
                (state["at"] + pos).alias("at"),
                F.array_append(state["hits"], F.when(pos > 0, 1.0).otherwise(0.0)).alias("hits"),
            )

        return F.aggregate(todo, start, step, lambda s: s["hits"])

    return let(numbers, search)


def step_correctness_autocorr(hits: Column | str) -> Column:
    """Pearson correlation of the 0/1 series with itself one step later; NULL if undefined or under three steps."""
    h = _c(hits)
    n = F.size(h)
    a, b = F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0)))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    m = (n - 1).cast("double")
    sab, sa, sb = total(F.zip_with(a, b, lambda x, y: x * y)), total(a), total(b)
    va, vb = m * sa - sa * sa, m * sb - sb * sb
    return F.when((n >= 3) & (va > 0) & (vb > 0), (m * sab - sa * sb) / F.sqrt(va * vb))


def replay_chain(start: Column, ops: Column, operands: Column, bound: int = 10000) -> Column:
    """All values of a chain (start first); NULL from the first unknown operator on."""

    def step(vals, op):
        last = F.element_at(vals, -1)
        nxt = F.when(op["0"] == "+", last + op["1"]).when(op["0"] == "-", last - op["1"]).when(op["0"].isin("*", "\u00d7"), last * op["1"])
        return F.array_append(vals, nxt)

    return F.aggregate(F.arrays_zip(ops.alias("0"), operands.alias("1")), F.array(start.cast("bigint")), step)


def chain_check(start, ops, operands, intermediates, output, bound: int = 10000) -> Column:
    """struct(replay_ok, output_ok, bounds_ok) from one replay of the chain."""
    return let(replay_chain(start, ops, operands), lambda vals: F.struct(
        F.coalesce(vals == intermediates.cast("array<bigint>"), F.lit(False)).alias("replay_ok"),
        F.coalesce(F.element_at(vals, -1) == output, F.lit(False)).alias("output_ok"),
        F.coalesce(F.forall(vals, lambda v: F.abs(v) <= bound), F.lit(False)).alias("bounds_ok")))


def chain_checks(start, ops, operands, intermediates, output, bound: int = 10000) -> dict[str, Column]:
    checks = chain_check(start, ops, operands, intermediates, output, bound)
    return {n: checks[n] for n in ("replay_ok", "output_ok", "bounds_ok")}


def question_facts(decomposition: Column, paragraphs: Column) -> Column:
    """(hop, question, answer, paragraph title) per sub-question; the title is looked up by index."""
    return F.transform(
        decomposition,
        lambda q, i: F.struct(
            (i + 1).alias("hop"), q["question"].alias("question"), q["answer"].alias("answer"),
            F.coalesce(F.get(paragraphs, q["paragraph"]), F.lit("")).alias("title"),
        ),
    )


def hop_count(decomposition: Column | str) -> Column:
    return F.size(_c(decomposition))


def self_contained(question: Column | str) -> Column:
    return ~F.contains(_c(question), F.lit("#"))


def entity_of(question: Column | str) -> Column:
    return F.lower(F.trim(F.element_at(F.split(_c(question), ">>"), 1)))


# Paraphrase rules by task, and prefixes.
PARAPHRASE_RULES = {
    "arithmetic": (
        ("Compute", "Calculate"), ("Calculate", "Work out"), ("Add", "Sum"), ("Subtract", "Take away"),
        ("Multiply by", "Times"), ("showing your work", "with detailed steps"),
        ("step by step", "one step at a time"), ("What is the final result?", "What do you get?"),
        ("Provide your final numerical answer.", "Give the final number."),
    ),
    "graph": (
        ("Color each node", "Assign a color to each node"),
        ("The constraint is that", "The rule is that"),
        ("no two nodes connected by an edge may share the same color", "adjacent nodes must have different colors"),
        ("Provide a valid coloring", "Give a valid color assignment"),
        ("listing each node and its assigned color", "specifying the color for every node"),
    ),
}
PARAPHRASE_PREFIXES = (
    "", "Please solve the following:\n\n", "Work through this problem:\n\n", "Solve this:\n\n", "Determine the answer:\n\n",
)


def paraphrases(text: Column | str, task: str = "arithmetic", n: int = 5, rules=None) -> Column:
    """n rule-based variants of a text: variant i applies rules i and i+1 and takes prefix i."""
    rules = rules or PARAPHRASE_RULES[task]
    out = []
    for i in range(n):
        t = _c(text)
        at = i % len(rules)
        for old, new in rules[at : at + 2]:
            t = F.replace(t, F.lit(old), F.lit(new))
        out.append(F.concat(F.lit(PARAPHRASE_PREFIXES[i % len(PARAPHRASE_PREFIXES)]), t))
    return F.array(*out)


def keyword_baseline(text: Column | str, marker: str = "Based on the above") -> Column:
    """FALSE if the query line says all/every and a numbered premise starts with 'no ', else TRUE."""
    lines = F.split(_c(text), "\n")
    query = F.lower(F.coalesce(F.try_element_at(F.filter(lines, lambda s: F.contains(s, F.lit(marker))), F.lit(1)), F.lit("")))
    universal = F.contains(query, F.lit("all ")) | F.contains(query, F.lit("every "))
    negated = F.exists(lines, lambda s: F.rlike(s, F.lit(r"^\d")) & F.contains(F.substring(F.regexp_replace(F.lower(s), r"^.*?\. ", ""), 1, 5), F.lit("no ")))
    return F.when(universal & negated, "FALSE").otherwise("TRUE")


def reconstruction_steps(depth: Column | str) -> Column:
    d = _c(depth)
    return F.floor(d * (d - 1) / 2)


def longest_text(items: DataFrame, level: str, text: str, limit: int) -> DataFrame:
    return items.groupBy(level).agg(F.max(F.length(text)).alias("max_length")).withColumn("fits", F.col("max_length") <= limit)


# Claim patterns with their type.
CLAIM_PATTERNS = (
    (r"F1\s*[\$\\,\{=\}\s]*=?\s*[\$\\,\{=\}\s]*(\d+\.\d+)", "f1_score"),
    (r"AUROC\s*[\$\\,\{=\}\s]*=?\s*[\$\\,\{=\}\s]*(\d+\.\d+)", "auroc"),
    (r"AUC\s*[\$\\,\{=\}\s]*=?\s*[\$\\,\{=\}\s]*(\d+\.\d+)", "auroc"),
    (r"(\d+\.?\d*)\s*\\?%", "percentage"),
    (r"R\^?\{?2\}?\s*[=:]\s*(\d+\.\d+)", "r_squared"),
    (r"\\hat\{?\\alpha\}?\s*\\approx\s*([\-]?\d+\.\d+)", "exponent"),
    (r"\\alpha\s*[=\u2248]\s*([\-]?\d+\.?\d*)", "exponent"),
    (r"p\s*[<>]\s*(\d+\.\d+)", "p_value"),
    (r"d\^?\*?\s*[={]\s*(\d+)", "d_star"),
    (r"N\s*=\s*(\d+)", "sample_size"),
    (r"\$\s*(\d+\.?\d*[KkMm]?)", "cost"),
    (r"(\d[\d,]*)\s*(?:additional\s+)?(?:API|api)\s+calls", "api_calls"),
    (r"[Pp]recision\s*(?:is\s+)?(\d+\.\d+)", "precision"),
    (r"[Rr]ecall\s*(?:is\s+)?(\d+\.\d+)", "recall"),
    (r"\[(\d+\.\d+),\s*(\d+\.\d+)\]", "confidence_interval"),
    (r"(?:outperform|improv|beat|exceed)\w*\s+.*?by\s+(\d+\.?\d*)\s*\\?%", "improvement_pct"),
    (r"(\d+)\s+(?:model-task|model)\s+pairs", "model_task_pairs"),
    (r"(\d+)\s+difficulty\s+levels", "difficulty_levels"),
    (r"(\d+)\s+responses", "response_count"),
)


# A piece of plain text every match of the pattern at the same place contains: a cheap test before the scan.
CLAIM_HINTS = (
    "F1", "AUROC", "AUC", "%", "R", "alpha", "alpha", "p", "d", "N", "$", "calls", "recision", "ecall", "[", "by", "pairs", "levels", "responses",
)


def _claims_of(line: Column, pattern: str, kind: str, hint: str, margin: int | None) -> Column:
    """struct array (value_type, value, context); positions are found by scanning the full matches in order.  Without a margin one scan finds the values."""
    g1 = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    value = g1
    if kind == "confidence_interval":
        g2 = F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
        value = F.zip_with(g1, g2, lambda a, b: F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")))

    if margin is None:
        bare = F.transform(value, lambda v: F.struct(F.lit(kind).alias("value_type"), v.alias("value")))
        return F.when(F.contains(line, F.lit(hint)), bare).otherwise(F.array().cast("array<struct<value_type:string,value:string>>"))
    whole = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))

    def place(state, m):
        at = F.call_function("locate", m, line, state["to"])
        return F.struct((at + F.length(m)).alias("to"), F.array_append(state["at"], at).alias("at"))

    spots = F.aggregate(whole, F.struct(F.lit(1).alias("to"), F.array().cast("array<int>").alias("at")), place, lambda s: s["at"])
    joined = F.arrays_zip(whole.alias("m"), value.alias("v"), spots.alias("at"))

    def pack(x):
        lo = F.greatest(x["at"] - margin, F.lit(1))
        return F.struct(
            F.lit(kind).alias("value_type"), x["v"].alias("value"),
            F.substr(line, lo, x["at"] + F.length(x["m"]) + margin - lo).alias("context"),
        )

    none = F.array().cast("array<struct<value_type:string,value:string,context:string>>")
    hit = F.contains(line, F.lit(hint)) & F.rlike(line, F.lit(pattern))
    return F.when(hit, F.transform(joined, pack)).otherwise(none)


def extract_claims(lines: DataFrame, line: str = "line", margin: int | None = 60) -> DataFrame:
    """One row per claim: value_type, value and the text around it (none without a margin).

    A line without a digit cannot match any pattern and is dropped before the scans.
    """
    digits = lines.where(F.rlike(line, F.lit(r"\d"))).withColumn("_s", strip(line))
    found = F.concat(*[_claims_of(F.col("_s"), p, k, h, margin) for (p, k), h in zip(CLAIM_PATTERNS, CLAIM_HINTS, strict=True)])
    return digits.withColumn("_c", F.explode(found)).select(*[c for c in lines.columns], "_c.*")
