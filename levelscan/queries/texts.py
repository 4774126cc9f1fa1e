"""SC, SRC, SNK, AU, VA: text functions, sources, sinks, audits and validation.

The driver tables hold no model answers, so response texts are written by Spark from their columns.
"""

import uuid

from pyspark.sql import functions as F

from levelscan.functions import scalars as S
from levelscan.operators import audits as U
from levelscan.operators.joins import tolerance_match
from levelscan.operators.windows import section_fill
from levelscan.plans.parallel import spread
from levelscan.plans.session import shared_folder
from levelscan.queries.bindings import ALL_LV, EV, LV, all_levels, ev_rows, levels, with_d_star
from levelscan.queries.registry import query, r6, rounded, table
from levelscan.sources import exports as X
from levelscan.sources import sinks as K

KEY = ["task", "model", "level"]


# one answer text per lineitem, in eight writing styles
INT_TEXT = """CASE CAST((l_orderkey + l_linenumber) % 8 AS INT)
 WHEN 0 THEN concat('Step 1: 12 + 5. The FINAL answer is ', CAST(l_partkey * 1000 AS VARCHAR(20)))
 WHEN 1 THEN concat('So we add 7 and the result = -', CAST(l_suppkey AS VARCHAR(20)), ' units')
 WHEN 2 THEN concat('3 + 4\n**', CAST(l_partkey AS VARCHAR(20)), '**')
 WHEN 3 THEN concat('12 * 3 = ', CAST(l_partkey AS VARCHAR(20)))
 WHEN 4 THEN concat('this equals ', CAST(l_partkey AS VARCHAR(20)), ' or so')
 WHEN 5 THEN concat('x = 4 then \\boxed{', CAST(l_suppkey AS VARCHAR(20)), '} done')
 WHEN 6 THEN concat('first 5, then ', CAST(l_suppkey AS VARCHAR(20)), ' apples')
 ELSE 'no number at all' END"""
SPARK_INT_TEXT = INT_TEXT.replace("\\boxed", "\\\\boxed")
BOOL_TEXT = """CASE CAST((l_orderkey + l_linenumber) % 7 AS INT)
 WHEN 0 THEN concat('The answer is ', CASE WHEN l_quantity > 25 THEN 'true' ELSE 'FALSE' END, '. Not TRUE otherwise')
 WHEN 1 THEN concat('Therefore, ', CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END)
 WHEN 2 THEN concat('FALSE at first, but later ', CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END)
 WHEN 3 THEN concat('well, ', CASE WHEN l_quantity > 25 THEN 'Yes' ELSE 'no' END)
 WHEN 4 THEN concat('the claim is ', CASE WHEN l_quantity > 25 THEN 'correct' ELSE 'incorrect' END)
 WHEN 5 THEN concat('it is ', CASE WHEN l_quantity > 25 THEN 'TRUE' ELSE 'FALSE' END)
 ELSE 'cannot say' END"""
FREE_TEXT = """CASE CAST((l_orderkey + l_linenumber) % 6 AS INT)
 WHEN 0 THEN concat('thinking\nANSWER: ', l_returnflag, ' Thames. \nbye')
 WHEN 1 THEN concat('The final answer is: the ', l_linestatus, ' river. Done')
 WHEN 2 THEN concat('Therefore, ', l_returnflag, l_linestatus, '.')
 WHEN 3 THEN concat('Step 1\n\n  in ', l_returnflag, ' town  \n')
 WHEN 4 THEN concat(l_returnflag, '\n', repeat('word ', 25), 'end')
 ELSE '   ' END"""


def _li(spark, d, text):
    t = text if text is not INT_TEXT else SPARK_INT_TEXT
    t = t.replace("VARCHAR(20)", "STRING")
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"), "l_orderkey")
    return li.withColumn("text", F.expr(t))


def _int_sql(patterns, fallback):
    def num(x):
        return f"try_cast(replace(nullif({x}, ''), ',', '') AS BIGINT)"
    hits = ", ".join(num(f"regexp_extract(text, '(?im){p}', 1)") for p in patterns)
    return f"coalesce({hits}, {num(f'regexp_extract_all(text, {chr(39)}{fallback}{chr(39)})[-1]')})"


@query("sc01a_extract_integer", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {INT_TEXT} AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {_int_sql(S.INTEGER_PATTERNS, S.INTEGER_FALLBACK)} AS answer FROM t""")
def _(spark, d):
    return _li(spark, d, INT_TEXT).select("l_orderkey", "l_linenumber", "l_partkey", S.extract_integer_answer("text").alias("answer"))


@query("sc01b_extract_integer_second_set", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {INT_TEXT} AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {_int_sql(S.INTEGER_PATTERNS_B, '-?[0-9][0-9,]*')} AS answer FROM t""")
def _(spark, d):
    return _li(spark, d, INT_TEXT).select("l_orderkey", "l_linenumber", "l_partkey", S.extract_integer_answer("text", "b").alias("answer"))


_B = ", ".join(f"upper(regexp_extract_all(text, '(?i){p}', 1)[-1])" for p in S.BOOLEAN_PATTERNS)


@query("sc02_extract_boolean", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {BOOL_TEXT} AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce({_B}, CASE lower(regexp_extract_all(text, '(?i)\\b(yes|no)\\b', 1)[-1]) WHEN 'yes' THEN 'TRUE' WHEN 'no' THEN 'FALSE' END,
 CASE lower(regexp_extract_all(text, '(?i)\\b(correct|incorrect)\\b', 1)[-1]) WHEN 'correct' THEN 'TRUE' WHEN 'incorrect' THEN 'FALSE' END) AS answer FROM t""")
def _(spark, d):
    return _li(spark, d, BOOL_TEXT).select("l_orderkey", "l_linenumber", "l_partkey", S.extract_boolean_answer("text").alias("answer"))


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _free_sql():
    parts = []
    for p in (S.FREE_ANSWER_LINE, *S.FREE_ANSWER_PATTERNS):
        parts.append(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN regexp_replace({_strip(f'regexp_extract(text, {chr(39)}(?i){p}{chr(39)}, 1)')}, '\\.+$', '') END")
    last = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')[-1][1:100]"
    return f"coalesce({', '.join(parts)}, {last}, '')"


@query("sc03_extract_free_answer", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {FREE_TEXT} AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {_free_sql()} AS answer FROM t""")
def _(spark, d):
    return _li(spark, d, FREE_TEXT).select("l_orderkey", "l_linenumber", "l_partkey", S.extract_free_answer("text").alias("answer"))


# colour texts: per order, node i gets a colour from its priority and key; style 3 leaves node 1 out
@query("sc04_extract_assignment_map", """WITH o AS (SELECT o_orderkey AS k, ['red','green','blue'] AS c FROM orders)
SELECT k, CASE WHEN k % 4 = 3 THEN NULL ELSE concat(c[1 + k % 3], ',', c[1 + (k + 1) % 3], ',', c[1 + (k // 7) % 3]) END AS colours FROM o""")
def _(spark, d):
    k = F.col("o_orderkey")
    c = F.array(F.lit("Red"), F.lit("Green"), F.lit("Blue"))
    a, b, e = c[k % 3], c[(k + 1) % 3], c[F.floor(k / 7) % 3]
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Node 0: Blue, node 1: blue\nFinal answer:\nNode 0: "), a, F.lit("\nNode 1 -> "), b, F.lit("\nNode 2 = "), e))
        .when(k % 4 == 1, F.concat(F.lit("0: "), a, F.lit(", 1: "), b, F.lit(", 2: "), e))
        .when(k % 4 == 2, F.concat(F.lit('{"0": "'), a, F.lit('", "1": "'), b, F.lit('", "2": "'), e, F.lit('"}')))
        .otherwise(F.concat(F.lit("Node 0: "), a, F.lit(" Node 2: "), e))
    )
    o = S.assignment_maps(spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("k"), text.alias("text")), "text", 3)
    return o.select("k", F.array_join(F.transform(F.array_sort(F.map_keys("assignment")), lambda i: F.col("assignment")[i]), ",").alias("colours"))


CLEAN = "regexp_replace(" * 6 + "regexp_replace(trim(lower(answer)), '\\.+$', '')" + "".join(f", '^{p}', '')" for p in S.ANSWER_PREFIXES)
ANS = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN concat('The ', l_returnflag, ' river.') WHEN 1 THEN concat('in A ', l_linestatus) WHEN 2 THEN concat(l_returnflag, ' ', l_linestatus, ' big town') WHEN 3 THEN '  ' ELSE 'at nowhere' END AS answer,
 concat(l_linestatus, ' river') AS truth, concat('The ', l_returnflag, ' river') AS alias1 FROM lineitem)"""


def _ans(spark, d):
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), "l_orderkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("""CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN concat('The ', l_returnflag, ' river.') WHEN 1 THEN concat('in A ', l_linestatus) WHEN 2 THEN concat(l_returnflag, ' ', l_linestatus, ' big town') WHEN 3 THEN '  ' ELSE 'at nowhere' END""").alias("answer"),
        F.expr("concat(l_linestatus, ' river')").alias("truth"), F.expr("array(concat('The ', l_returnflag, ' river'))").alias("aliases"))


@query("sc05_clean_answer", f"WITH {ANS} SELECT l_orderkey, l_linenumber, l_partkey, trim({CLEAN}) AS cleaned FROM a")
def _(spark, d):
    return _ans(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", S.clean_answer("answer").alias("cleaned"))


@query("sc06_fuzzy_match", f"""WITH {ANS}, c AS (SELECT *, trim({CLEAN}) AS p, trim({CLEAN.replace('answer', 'truth')}) AS g, trim({CLEAN.replace('answer', 'alias1')}) AS al FROM a),
t AS (SELECT *, list_distinct(string_split_regex(p, '\\s+')) AS tp, list_distinct(string_split_regex(g, '\\s+')) AS tg FROM c),
s AS (SELECT *, 2.0 * len(list_intersect(tp, tg)) / (len(tp) + len(tg)) AS f1 FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN p = '' THEN 0.0 WHEN p = g THEN 1.0 WHEN contains(p, g) OR contains(g, p) THEN 0.9 WHEN p = al THEN 1.0 WHEN contains(p, al) OR contains(al, p) THEN 0.9 WHEN f1 >= 0.5 THEN f1 ELSE 0.0 END, 6) + 0.0::DOUBLE AS score FROM s""")
def _(spark, d):
    m = S.fuzzy_match("answer", "truth", F.col("aliases"))
    return _ans(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", r6(m["score"]).alias("score"))


@query("sc07_canonical_assignment", """SELECT '[{"key":0,"value":"' || l_returnflag || '"},{"key":1,"value":"' || l_linestatus || '"}]' AS assignment, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, d):
    m = F.create_map(F.lit(1), F.col("l_linestatus"), F.lit(0), F.col("l_returnflag"))
    return table(spark, d, "lineitem").select(S.canonical_assignment(m).alias("assignment")).groupBy("assignment").agg(F.count(F.lit(1)).alias("n"))


HEDGE_TEST, SURE_TEST = ("the", "of", "la", "de"), ("and", "that", "ou", "der")


@query("sc08_certainty_autocorr", f"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, pos, {_strip('raw')} AS st FROM s WHERE length({_strip('raw')}) > 10),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, string_split_regex(lower(st), '\\s+') AS ws FROM f),
c AS (SELECT doc_id, i, (len(list_filter(ws, lambda x: list_contains({list(SURE_TEST)}, x))) - len(list_filter(ws, lambda x: list_contains({list(HEDGE_TEST)}, x)))) / len(ws) AS c FROM w),
m AS (SELECT *, c - avg(c) OVER (PARTITION BY doc_id) AS z FROM c), l AS (SELECT doc_id, z, z * lead(z) OVER (PARTITION BY doc_id ORDER BY i) AS zz FROM m),
g AS (SELECT doc_id, CASE WHEN count(*) < 3 THEN NULL WHEN sqrt(sum(z * z) / count(*)) < 1e-8 THEN 0.0 ELSE sum(zz) / (sum(z * z) + 1e-10) END AS ac FROM l GROUP BY ALL)
SELECT d.doc_id, round(ac, 6) + 0.0 AS autocorr FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""")
def _(spark, d):
    # every line becomes a list item, so each is one step
    t = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n- ")))
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", r6(S.certainty_autocorr(t, HEDGE_TEST, SURE_TEST)).alias("autocorr"))


@query("sc09_step_correctness_autocorr", """WITH RECURSIVE r AS (SELECT l_orderkey AS k, list(CAST(l_partkey % 5 AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS nums, list(CAST(l_suppkey % 5 AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS want FROM lineitem GROUP BY ALL),
s AS (SELECT k, nums, want[2:] AS want, 0 AS i, 0 AS ps, []::DOUBLE[] AS hits FROM r
 UNION ALL SELECT k, nums, want, i + 1, CASE WHEN coalesce(list_position(nums[ps + 1:], want[i + 1]), 0) > 0 THEN ps + list_position(nums[ps + 1:], want[i + 1]) ELSE ps END,
  list_append(hits, CASE WHEN coalesce(list_position(nums[ps + 1:], want[i + 1]), 0) > 0 THEN 1.0 ELSE 0.0 END) FROM s WHERE i < len(want)),
e AS (SELECT k, hits, len(hits) AS n FROM s WHERE i = len(want)),
u AS (SELECT k, unnest(hits[:-2]) AS a, unnest(hits[2:]) AS b FROM e WHERE n >= 3),
c AS (SELECT k, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS ac FROM u GROUP BY ALL)
SELECT e.k, CAST(coalesce(list_sum(hits), 0) AS BIGINT) AS n_hits, round(c.ac, 6) + 0.0 AS autocorr FROM e LEFT JOIN c ON c.k = e.k""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    g = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("r"))  # an order has few lines
    g = g.select("k", F.array_join(F.transform("r", lambda x: (x["l_partkey"] % 5).cast("string")), " then ").alias("text"), F.transform("r", lambda x: x["l_suppkey"] % 5).alias("want"))
    g = g.withColumn("hits", S.step_correctness("text", F.col("want")))
    return g.select("k", F.aggregate("hits", F.lit(0.0), lambda s, x: s + x).cast("long").alias("n_hits"), r6(S.step_correctness_autocorr("hits")).alias("autocorr"))


@query("sc10_replay_chain", """WITH c AS (SELECT o_orderkey AS k, 10 + o_custkey % 90 AS a, o_custkey % 7 AS b, o_orderkey % 5 AS m, o_custkey % 11 AS s FROM orders)
SELECT k, o_ok AS output_ok, r_ok AS replay_ok, greatest(abs(a), abs(a + b), abs((a + b) * m), abs((a + b) * m - s)) <= 500 AS bounds_ok FROM (SELECT *, k % 3 <> 0 AS o_ok, k % 2 = 0 AS r_ok FROM c)""")
def _(spark, d):
    o = table(spark, d, "orders")
    k, cu = F.col("o_orderkey"), F.col("o_custkey")
    a, b, m, s = 10 + cu % 90, cu % 7, k % 5, cu % 11
    end = (a + b) * m - s
    o = o.select(k.alias("k"), a.alias("start"), F.array(F.lit("+"), F.lit("*"), F.lit("-")).alias("ops"), F.array(b, m, s).alias("args"),
        F.array(a, a + b + k % 2, (a + b) * m, end).alias("mid"), F.when(k % 3 == 0, end + 1).otherwise(end).alias("out"))
    c = S.chain_checks(F.col("start"), F.col("ops"), F.col("args"), F.col("mid"), F.col("out"), bound=500)
    return o.select("k", *[x.alias(n) for n, x in c.items()])


@query("sc11_question_facts", """SELECT conv_id AS k, turn, unnest([1, 2])::INTEGER AS hop, unnest([role, md5(text)]) AS question, unnest([concat('a', CAST(turn AS VARCHAR)), 'b']) AS answer, unnest(['T' || CAST(turn AS VARCHAR), '']) AS title FROM conversations""")
def _(spark, d):
    t = F.col("turn").cast("string")
    dec = F.array(
        F.struct(F.col("role").alias("question"), F.concat(F.lit("a"), t).alias("answer"), F.lit(1).alias("paragraph")),
        F.struct(F.md5("text").alias("question"), F.lit("b").alias("answer"), F.lit(7).alias("paragraph")))
    pars = F.array(F.lit("zero"), F.concat(F.lit("T"), t))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), "turn", F.explode(S.question_facts(dec, pars)).alias("f"))
    return c.select("k", "turn", "f.*")


@query("sc12_question_shape", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, CAST(1 + l_linenumber AS INTEGER) AS hops, l_linenumber % 2 = 0 AS self_contained, lower(l_returnflag) || ' place' AS entity FROM lineitem""")
def _(spark, d):
    q = F.concat(F.col("l_returnflag"), F.lit(" Place >> made by "), F.when(F.col("l_linenumber") % 2 == 1, "#1").otherwise("it"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey", S.hop_count(F.sequence(F.lit(0), F.col("l_linenumber"))).alias("hops"), S.self_contained(q).alias("self_contained"), S.entity_of(q).alias("entity"))


RULES = (("the", "le"), ("and", "et"), ("of", "de"))


@query("sc13_paraphrase", """WITH t AS (SELECT doc_id, [replace(replace(text, 'the', 'le'), 'and', 'et'), 'Please solve the following:' || chr(10) || chr(10) || replace(replace(text, 'and', 'et'), 'of', 'de'), 'Work through this problem:' || chr(10) || chr(10) || replace(text, 'of', 'de'), 'Solve this:' || chr(10) || chr(10) || replace(replace(text, 'the', 'le'), 'and', 'et'), 'Determine the answer:' || chr(10) || chr(10) || replace(replace(text, 'and', 'et'), 'of', 'de')] AS v FROM documents)
SELECT doc_id, CAST(unnest([0,1,2,3,4]) AS INTEGER) AS i, md5(unnest(v)) AS digest FROM t""")
def _(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(S.paraphrases("text", rules=RULES)).alias("i", "v"))
    return p.select("doc_id", "i", F.md5("v").alias("digest"))


KB = """concat('1. ', CASE WHEN l_returnflag = 'A' THEN 'No ' ELSE 'Some ' END, 'cats are pets.\n2. All pets run.\nBased on the above, ', CASE WHEN l_linestatus = 'F' THEN 'all cats' ELSE 'do cats' END, ' run?')"""


@query("sc14_keyword_baseline", """SELECT l_linenumber AS level, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS n_false, round(avg(CASE WHEN (l_returnflag = 'A' AND l_linestatus = 'F') = (l_quantity > 25) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM lineitem GROUP BY ALL""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", F.expr(KB).alias("text")).withColumn("p", S.keyword_baseline("text"))
    return li.groupBy(F.col("l_linenumber").alias("level")).agg(F.sum((F.col("p") == "FALSE").cast("long")).alias("n_false"), r6(F.avg(((F.col("p") == "FALSE") == (F.col("l_quantity") > 25)).cast("double"))).alias("accuracy"))


# a claims corpus: one document per order, one line per order line
CLAIM_LINE = """CASE l_linenumber WHEN 1 THEN concat('\\section{Results ', l_returnflag, '}')
 WHEN 2 THEN concat('We reach F1=0.', CAST(800 + l_suppkey % 100 AS VARCHAR(20)), ' with p < 0.0', CAST(1 + l_partkey % 9 AS VARCHAR(20)), ' on N = ', CAST(l_partkey AS VARCHAR(20)), ' rows')
 WHEN 3 THEN concat('This outperforms the base by ', CAST(1 + l_suppkey % 50 AS VARCHAR(20)), '.38\\%, F1 0.9', CAST(l_partkey % 10 AS VARCHAR(20)), ' [0.9', CAST(l_suppkey % 10 AS VARCHAR(20)), ', 0.9', CAST(l_partkey % 7 AS VARCHAR(20)), ']')
 WHEN 4 THEN concat('cost $', CAST(l_partkey AS VARCHAR(20)), 'K for ', CAST(l_suppkey AS VARCHAR(20)), ' API calls, 3 difficulty levels and 50 responses')
 WHEN 5 THEN concat('AUROC = 0.8', CAST(90 + l_suppkey % 10 AS VARCHAR(20)), ', Precision is 0.786 and recall 0.880; d*=', CAST(l_partkey % 20 AS VARCHAR(20)))
 ELSE 'no claims here' END"""


def claim_lines(spark, d):
    t = CLAIM_LINE.replace("VARCHAR(20)", "STRING").replace("\\", "\\\\")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("m")).select("doc_id", "line_no", "m.*", F.col("line_no").alias("l_linenumber"))
    # one shuffle serves the window below and gives the costly scans their tasks
    li = li.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    lines = li.select("doc_id", "line_no", F.expr(t).alias("line"))
    head = F.nullif(F.regexp_extract("line", r"\\(?:sub)*section\{([^}]+)\}", 1), F.lit(""))
    return section_fill(lines, "doc_id", "line_no", head)


CLAIM_SRC = f"""b AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_linenumber, min((l_partkey, l_suppkey, l_returnflag)) AS m FROM lineitem GROUP BY ALL),
b2 AS (SELECT doc_id, line_no, l_linenumber, m[1] AS l_partkey, m[2] AS l_suppkey, m[3] AS l_returnflag FROM b),
ln AS (SELECT doc_id, line_no, {CLAIM_LINE} AS line FROM b2),
sec AS (SELECT *, coalesce(last_value(nullif(regexp_extract(line, '\\\\(?:sub)*section\\{{([^}}]+)\\}}', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'preamble') AS section FROM ln)"""


def _claim_sql():
    out = []
    for p, kind in S.CLAIM_PATTERNS:
        q = p.replace(r"\u2248", "≈").replace("'", "''")
        if kind == "confidence_interval":
            v = f"unnest(list_transform(list_zip(regexp_extract_all(line, '{q}', 1), regexp_extract_all(line, '{q}', 2)), lambda z: '[' || z[1] || ', ' || z[2] || ']'))"
        else:
            v = f"unnest(regexp_extract_all(line, '{q}', 1))"
        out.append(f"SELECT doc_id, line_no, section, '{kind}' AS value_type, {v} AS value FROM sec WHERE NOT starts_with(line, '\\section')")
    return " UNION ALL ".join(out)


CLAIMS = f"{CLAIM_SRC}, cl AS ({_claim_sql()})"


def claims(spark, d):
    lines = claim_lines(spark, d).where(~F.startswith("line", F.lit("\\section")))
    return S.extract_claims(lines, margin=None)  # no query reads the context


@query("sc16_extract_claims", f"WITH {CLAIMS} SELECT * FROM cl")
def _(spark, d):
    return claims(spark, d).select("doc_id", "line_no", "section", "value_type", "value")


@query("sc15_tfidf_vectors")
def _(spark, d):
    from levelscan.operators.features import tfidf_vectors
    v = tfidf_vectors(table(spark, d, "documents").select("doc_id", "text"), "text", 500)
    return v.select("doc_id", F.size("vector").alias("dims"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm2"))


@query("sc17_reconstruction_steps", """SELECT l_linenumber AS level, l_linenumber * (l_linenumber - 1) // 2 AS steps, max(l_partkey::VARCHAR.length() + 10) AS max_length, max(l_partkey::VARCHAR.length() + 10) <= 13 AS fits FROM lineitem GROUP BY ALL""".replace("l_partkey::VARCHAR.length()", "length(l_partkey::VARCHAR)"))
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.concat(F.lit("part no.: "), F.col("l_partkey").cast("string")).alias("text"))
    return S.longest_text(t, "level", "text", 13).select("level", S.reconstruction_steps("level").cast("int").alias("steps"), F.col("max_length").cast("long").alias("max_length"), "fits")


# ---- sources and sinks -------------------------------------------------------------------------

EXPORT = ["accuracy", "variance", "bimodality_coefficient", "disagreement_rate"]


def level_export(spark, d):
    """A level export as other tools write it: text numbers under export names."""
    lv = with_d_star(levels(spark, d))
    def t(c, n=6):
        return r6(c, n).cast("string")
    return lv.select(
        F.concat(F.lit("task_T"), (F.col("level") % 3 * 0.5).cast("string"), F.lit("__"), "model").alias("dataset"),
        F.col("level").alias("metadata_difficulty_level"), F.col("model").alias("metadata_model"), F.col("d_star").alias("metadata_d_star"),
        t("accuracy").alias("predict_accuracy"), F.when(F.col("level") % 7 == 0, "nan").otherwise(t("variance", 3)).alias("predict_csd_variance"),
        F.when(F.col("level") % 5 == 0, "None").otherwise(t("disagreement_rate")).alias("predict_disagreement_rate"))


EXP_SQL = f"""{LV}, ex AS (SELECT model, level, d_star, (level % 3) * 0.5::DOUBLE AS temperature, round(accuracy, 6) + 0.0 AS accuracy, CASE WHEN level % 7 = 0 THEN NULL ELSE round(variance, 3) + 0.0 END AS variance, CASE WHEN level % 5 = 0 THEN NULL ELSE round(disagreement_rate, 6) + 0.0 END AS disagreement_rate FROM lvd)"""


@query("src01_read_envelope", f"WITH {EXP_SQL} SELECT 'task_T' || CASE level % 3 WHEN 0 THEN '0.0' WHEN 1 THEN '0.5' ELSE '1.0' END || '__' || model AS dataset, count(*) AS n, round(avg(accuracy), 6) + 0.0 AS mean_accuracy FROM ex GROUP BY ALL")
def _(spark, d):
    from levelscan.sources.envelope import read_envelope, write_envelope
    path = f"{shared_folder(spark)}/levelscan-envelope-{uuid.uuid4().hex}"
    write_envelope(level_export(spark, d), path)
    e = read_envelope(spark, path, "metadata_difficulty_level int, metadata_model string, predict_accuracy string")
    return e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(X.number("predict_accuracy"))).alias("mean_accuracy"))


@query("src02_select_dataset", f"WITH {EXP_SQL} SELECT level, accuracy AS value FROM ex WHERE temperature = 0.5 AND model = 'click'")
def _(spark, d):
    e = X.select_dataset(level_export(spark, d), "task_T0.5__click")
    return X.level_series_of(e, "task_T0.5__click", "metadata_difficulty_level", "predict_accuracy")


@query("src03_levels_from_level_export", f"WITH {EXP_SQL} SELECT model, level, d_star, accuracy, variance, disagreement_rate FROM ex")
def _(spark, d):
    return X.levels_from_level_export(level_export(spark, d)).select("model", "level", "d_star", "accuracy", "variance", "disagreement_rate")


@query("src04_levels_from_response_export", f"""WITH {EV}, f AS (SELECT model, level, arg_min((x, correct), item_id) AS f FROM ev GROUP BY ALL) SELECT model, level, f[1] AS variance, CASE WHEN level % 4 = 0 THEN NULL ELSE f[1] / 2 END AS accuracy FROM f""")
def _(spark, d):
    r = ev_rows(spark, d).select("model", F.col("level").alias("metadata_difficulty_level"), F.col("item_id").alias("row_id"), F.col("x").cast("string").alias("metadata_csd_embedding_variance"),
        F.when(F.col("level") % 4 == 0, "nan").otherwise((F.col("x") / 2).cast("string")).alias("metadata_csd_accuracy"))
    return X.levels_from_response_export(r).select("model", "level", "variance", "accuracy")


@query("src05_levels_from_map_metadata", f"WITH {LV} SELECT model, level, round(accuracy, 6) + 0.0 AS accuracy, CASE WHEN level % 3 = 0 THEN NULL ELSE round(variance, 6) + 0.0 END AS variance, CAST(NULL AS DOUBLE) AS ashman_d FROM lv")
def _(spark, d):
    lv = levels(spark, d)
    m = F.map_filter(F.create_map(F.lit("accuracy"), r6("accuracy"), F.lit("embedding_variance_trace"), F.when(F.col("level") % 3 != 0, r6("variance"))), lambda k, v: v.isNotNull())
    per = lv.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("string"), m))).alias("per_level_indicators"))  # one entry per level
    return X.levels_from_map_metadata(per).select("model", "level", "accuracy", "variance", "ashman_d")


@query("src06_levels_from_temperature_export", f"WITH {EXP_SQL} SELECT temperature, model, level, accuracy, variance FROM ex")
def _(spark, d):
    return X.levels_from_temperature_export(level_export(spark, d)).select("temperature", "model", "level", "accuracy", "variance")


@query("src07_unify_levels", f"WITH {EXP_SQL} SELECT 'a' AS task, model, level, accuracy, variance, CAST(NULL AS DOUBLE) AS ashman_d FROM ex UNION ALL SELECT 'b', model, level, accuracy, CAST(NULL AS DOUBLE), accuracy FROM ex")
def _(spark, d):
    a = X.levels_from_level_export(level_export(spark, d))
    b = a.select(F.lit("b").alias("task"), "model", "level", "accuracy", F.col("accuracy").alias("ashman_d"))
    return X.unify_levels([a.withColumn("task", F.lit("a")), b]).select("task", "model", "level", "accuracy", "variance", "ashman_d")


@query("src08_parse_prefixed", f"WITH {EXP_SQL} SELECT model AS metadata_model, level AS metadata_difficulty_level, accuracy, variance AS csd_variance, disagreement_rate FROM ex")
def _(spark, d):
    return X.parse_prefixed(level_export(spark, d)).select("metadata_model", "metadata_difficulty_level", "accuracy", "csd_variance", "disagreement_rate")


@query("src09_load_tier", f"WITH {LV} SELECT model, level, n FROM lv")
def _(spark, d):
    from levelscan.sources.envelope import load_tier, write_envelope
    base = f"{shared_folder(spark)}/levelscan-tier-{uuid.uuid4().hex}"
    write_envelope(levels(spark, d).select(F.lit("levels").alias("dataset"), "model", "level", "n"), f"{base}/levels.json")
    return load_tier(spark, base, "levels.json", "mini").select("model", F.col("level").cast("int").alias("level"), "n")


@query("src10_read_flat_or_envelope", f"WITH {LV} SELECT model, level, n FROM lv")
def _(spark, d):
    from levelscan.sources.envelope import envelope_rows, read_flat_or_envelope
    base = f"{shared_folder(spark)}/levelscan-flat-{uuid.uuid4().hex}"
    pieces = envelope_rows(levels(spark, d).select(F.lit("all").alias("dataset"), "model", "level", "n"), max_rows=50)
    pieces.select(F.to_json("examples").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(base)
    return read_flat_or_envelope(spark, base).select("model", F.col("level").cast("int").alias("level"), "n")


@query("src11_text_lines", """SELECT page_id, CAST(generate_subscripts(string_split(html, chr(10)), 1) AS INTEGER) AS line_no, md5(unnest(string_split(html, chr(10)))) AS digest FROM pages""")
def _(spark, d):
    t = X.text_lines(table(spark, d, "pages"), "page_id", "html")
    return t.select("page_id", "line_no", F.md5("line").alias("digest"))


@query("snk01_write_envelope", f"WITH {LV} SELECT model AS dataset, true AS pieces_ok, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM lv GROUP BY ALL")
def _(spark, d):
    from levelscan.sources.envelope import envelope_rows
    rows = envelope_rows(levels(spark, d).select(F.col("model").alias("dataset"), "level", "n"), max_rows=10)
    numbered = (F.min("piece") >= 0) & (F.count_distinct("piece") == F.count("*")) & (F.max("piece") < F.ceil(F.sum(F.size("examples")) / 10))
    return rows.groupBy("dataset").agg(numbered.alias("pieces_ok"), F.sum(F.size("examples")).alias("n"), F.sum(F.aggregate("examples", F.lit(0).cast("bigint"), lambda s, e: s + e["n"])).alias("total"))


@query("snk02_format_predictions", f"WITH {LV} SELECT model, level, coalesce(CAST(round(accuracy, 4) AS VARCHAR), 'nan') AS predict_accuracy FROM lv")
def _(spark, d):
    return K.format_predictions(levels(spark, d).select("model", "level", "accuracy"), {"accuracy": 4})


@query("snk03_sanitize", f"WITH {ALL_LV} SELECT task, model, level, coalesce(CAST(d_star AS DOUBLE), -999.0) AS d_star, CASE WHEN accuracy > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS good, CASE WHEN level = 0 THEN -999.0::DOUBLE ELSE 1.0::DOUBLE END AS inv FROM lvd")
def _(spark, d):
    lv = with_d_star(all_levels(spark, d)).select(*KEY, "d_star", (F.col("accuracy") > 0.5).alias("good"), F.when(F.col("level") == 0, float("inf")).otherwise(1.0).alias("inv"))
    return K.sanitize(lv, ["d_star", "good", "inv"])


@query("snk04_metrics_agg", f"""WITH {ALL_LV}, a AS (SELECT task, round(avg(accuracy), 6) + 0.0 AS m1, CAST(count(*) AS DOUBLE) AS m2 FROM lv GROUP BY ALL) SELECT task || '_mean_accuracy' AS metric, m1 AS value FROM a UNION ALL SELECT task || '_n_levels', m2 FROM a""")
def _(spark, d):
    a = all_levels(spark, d).groupBy("task").agg(r6(F.avg("accuracy")).alias("mean_accuracy"), F.count(F.lit(1)).alias("n_levels"))
    return K.metrics_agg(a, ["mean_accuracy", "n_levels"], F.col("task"))


MODELS = ["click", "error", "purchase", "signup", "view"]


@query("snk05_report_table", f"WITH {LV} SELECT level, " + ", ".join(f"round(avg(accuracy) FILTER (WHERE model = '{m}'), 6) + 0.0 AS \"{m}\"" for m in MODELS) + " FROM lv GROUP BY ALL")
def _(spark, d):
    return rounded(K.report_table(levels(spark, d), "level", "model", "accuracy", MODELS), *MODELS)


@query("snk06_figure_data", f"""WITH {ALL_LV}, m AS (SELECT task, level, avg(variance) AS a, avg(disagreement_rate) AS b, avg(bimodality_coefficient) AS c FROM lv GROUP BY ALL)
SELECT 'accuracy_curve' AS figure, task || '__' || model AS series, level AS x, round(accuracy, 6) + 0.0 AS y FROM lv UNION ALL SELECT 'indicator_profile', task || '__variance', level, round(a, 6) + 0.0 FROM m UNION ALL SELECT 'indicator_profile', task || '__disagreement_rate', level, round(b, 6) + 0.0 FROM m
 UNION ALL SELECT 'indicator_profile', task || '__bimodality_coefficient', level, round(c, 6) + 0.0 FROM m UNION ALL SELECT 'boundary_bars', task || '__' || model, min(level) FILTER (WHERE accuracy < 0.5), round(avg(accuracy), 6) + 0.0 FROM lv GROUP BY ALL""")
def _(spark, d):
    lv = all_levels(spark, d)
    out = None
    for f in ("accuracy_curve", "indicator_profile", "boundary_bars"):
        p = K.figure_data(lv, f).select(F.lit(f).alias("figure"), "series", "x", r6("y").alias("y"))
        out = p if out is None else out.unionByName(p)
    return out


# ---- audits and validation ---------------------------------------------------------------------

STALE = {"0.81": "0.949", "0.89": "0.996", "16.38": "33.23"}


@query("au01_stale_values", f"""WITH {CLAIMS}, st AS (SELECT unnest(['0.81', '0.89', '16.38']) AS stale_value, unnest(['0.949', '0.996', '33.23']) AS correct_value)
SELECT DISTINCT doc_id, line_no, stale_value, correct_value FROM cl JOIN st ON contains(value, stale_value) WHERE value_type IN ('f1_score', 'auroc', 'improvement_pct', 'percentage')""")
def _(spark, d):
    return U.stale_values(claims(spark, d), STALE)


CI_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{p}', 1))::DOUBLE AS point, unnest(regexp_extract_all(line, '{p}', 2))::DOUBLE AS lower, unnest(regexp_extract_all(line, '{p}', 3))::DOUBLE AS upper FROM ln" for p in U.CI_PATTERNS)


@query("au02_ci_anomalies", f"""WITH {CLAIM_SRC}, ci AS ({CI_SQL}), i AS (SELECT *, concat_ws('; ', CASE WHEN lower > upper THEN 'ci_lower > ci_upper' END, CASE WHEN point < lower - 0.005::DOUBLE THEN 'point_estimate < ci_lower' END, CASE WHEN point > upper + 0.005::DOUBLE THEN 'point_estimate > ci_upper' END, CASE WHEN upper - lower < 0 THEN 'negative_ci_width' END) AS issues FROM ci)
SELECT doc_id, point, lower, upper, issues, min(line_no) AS line_no FROM i WHERE issues <> '' GROUP BY ALL""")
def _(spark, d):
    return U.ci_anomalies(claim_lines(spark, d).drop("section"))


@query("au03_derived_value_check", """SELECT o_orderkey, round((o_totalprice - o_custkey) / o_custkey * 100, 4) + 0.0 AS expected, abs(o_totalprice / 10 - (o_totalprice - o_custkey) / o_custkey * 100) > 5000 AS is_error FROM orders WHERE o_custkey > 0""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_custkey > 0")
    r = U.derived_value_check(o, "gain", F.col("o_totalprice"), F.col("o_custkey"), F.col("o_totalprice") / 10, 5000)
    return r.select("o_orderkey", r6("expected", 4).alias("expected"), "is_error")


@query("au04_inconsistent_quantities", f"""WITH {CLAIMS} SELECT section, value_type, count(DISTINCT value) AS n_values, count(*) AS n_claims, min(value) AS first_value, max(value) AS last_value FROM cl GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def _(spark, d):
    return U.inconsistent_quantities(claims(spark, d), ["section", "value_type"])


@query("au05_integrity_summary", """WITH s AS (SELECT CASE WHEN s_nationkey >= 20 THEN 'UNSOURCED' WHEN abs(round(s_acctbal) - s_acctbal) <= 0.1 THEN 'VERIFIED' WHEN abs(round(s_acctbal) - s_acctbal) <= 0.1 * 3 THEN 'ROUNDING' ELSE 'CRITICAL' END AS st FROM supplier)
SELECT count(*) AS checked, count(*) FILTER (WHERE st = 'VERIFIED') AS verified, count(*) FILTER (WHERE st = 'ROUNDING') AS rounding, CAST(0 AS BIGINT) AS minor, count(*) FILTER (WHERE st = 'CRITICAL') AS critical, count(*) FILTER (WHERE st = 'UNSOURCED') AS unsourced,
 round(count(*) FILTER (WHERE st = 'VERIFIED') / count(*), 6) + 0.0 AS score, false AS ready FROM s""")
def _(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    c = s.select(F.col("s_suppkey").alias("claim_id"), F.concat(F.lit("k"), key, F.lit("#")).alias("key"), F.round("s_acctbal").alias("value"), F.lit(0.1).alias("tol"))
    src = s.where("s_nationkey < 20").select(F.concat(F.lit("k"), key, F.lit("#")).alias("key"), F.col("s_acctbal").alias("source_value"))
    return rounded(U.integrity_summary(tolerance_match(c, src)), "score")


@query("au06_source_registry", f"""WITH {LV} SELECT 'level' || level || '_accuracy' AS key, round(accuracy, 6) + 0.0 AS value, model AS source_file, 'metrics.level' || level || '.accuracy' AS source_path FROM lv UNION ALL SELECT 'level' || level || '_n', n, model, 'metrics.level' || level || '.n' FROM lv""")
def _(spark, d):
    lv = levels(spark, d)
    inner = F.create_map(F.lit("accuracy"), r6("accuracy"), F.lit("n"), F.col("n").cast("double"))
    m = lv.select("model", F.create_map(F.concat(F.lit("level"), F.col("level").cast("string")), inner).alias("metrics"))
    return U.source_registry(m, "model", "metrics")


@query("va01_validate_items", """SELECT 'has_text' AS rule, count(*) FILTER (WHERE NOT coalesce(length(text) > 0, false)) AS violations FROM documents UNION ALL SELECT 'length_matches', count(*) FILTER (WHERE NOT coalesce(length(text) = n_chars, false)) FROM documents UNION ALL SELECT 'known_language', count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de')) FROM documents
 UNION ALL SELECT 'duplicate_id', count(*) - count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT text) FROM documents UNION ALL SELECT 'level_count', count(*) FILTER (WHERE n <> 50) FROM (SELECT count(*) AS n FROM documents GROUP BY source)""")
def _(spark, d):
    rules = {"has_text": F.length("text") > 0, "length_matches": F.length("text") == F.col("n_chars"), "known_language": F.col("lang").isin("en", "fr", "de")}
    return U.validate_items(table(spark, d, "documents"), rules, "doc_id", "text", "source", 50)


GE = """nd AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS node FROM lineitem), ed AS (SELECT a.g, a.node AS u, b.node AS v FROM nd a JOIN nd b ON a.g = b.g AND (b.node = a.node + 1 OR b.node = a.node + 3))"""


def _chain_graph(spark, d):
    nd = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("node")).distinct()
    to = nd.withColumn("v", F.explode(F.array(F.col("node") + 1, F.col("node") + 3)))
    ed = to.join(nd.select("g", F.col("node").alias("v")), ["g", "v"]).select("g", F.col("node").alias("u"), "v")
    return ed, nd


@query("va02_graph_connected", f"""WITH RECURSIVE {GE}, bi AS (SELECT g, u, v FROM ed UNION SELECT g, v, u FROM ed), reach AS (SELECT g, node AS a, node AS b FROM nd UNION SELECT r.g, r.a, bi.v FROM reach r JOIN bi ON bi.g = r.g AND bi.u = r.b),
lab AS (SELECT g, a, min(b) AS l FROM reach GROUP BY ALL) SELECT g, count(DISTINCT l) AS n_components, count(DISTINCT l) = 1 AS connected FROM lab GROUP BY ALL""")
def _(spark, d):
    e, n = _chain_graph(spark, d)
    return U.graph_connected(e, n, "g")


@query("va03_verify_colouring", f"""WITH {GE}, co AS (SELECT l_orderkey AS g, l_linenumber AS node, min(l_returnflag) AS c FROM lineitem GROUP BY ALL), e AS (SELECT ed.g, a.c AS ca, b.c AS cb FROM ed JOIN co a ON a.g = ed.g AND a.node = u JOIN co b ON b.g = ed.g AND b.node = v),
ok AS (SELECT g, bool_and(c IN ('A', 'N', 'R')) AS cok FROM co GROUP BY ALL) SELECT g, count(*) FILTER (WHERE ca = cb) AS n_violated, count(*) FILTER (WHERE ca = cb) = 0 AND any_value(cok) AS verified FROM e JOIN ok USING (g) GROUP BY ALL""")
def _(spark, d):
    e, _n = _chain_graph(spark, d)
    co = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("node")).agg(F.min("l_returnflag").alias("c"))
    line = F.concat(F.lit("Node "), F.col("node").cast("string"), F.lit(": "), "c")
    txt = co.groupBy("g").agg(F.array_join(F.collect_list(line), "\n").alias("text"))  # at most seven lines per graph
    return U.verify_colouring(txt, "g", "text", e, ["a", "n", "r"])


@query("va04_response_sanity", f"""WITH {EV}, p AS (SELECT model, level, count(*) AS n, count(*) FILTER (WHERE x >= 5) AS ok, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY level) AS up, row_number() OVER (PARTITION BY model ORDER BY level DESC) AS dn FROM p),
s AS (SELECT model, sum(ok) / sum(n) AS er, sum(n) - sum(ok) AS ne, avg(acc) FILTER (WHERE up <= 3) AS ea, avg(acc) FILTER (WHERE dn <= 3) AS ha FROM r GROUP BY ALL)
SELECT model, round(er, 6) + 0.0 AS extraction_rate, CAST(ne AS BIGINT) AS n_empty, round(ea, 6) + 0.0 AS easy_accuracy, round(ha, 6) + 0.0 AS hard_accuracy, er >= 0.5 AS rate_ok, ea >= ha AS order_ok FROM s""")
def _(spark, d):
    r = ev_rows(spark, d).withColumn("answer", F.when(F.col("x") >= 5, F.col("answer")))
    return rounded(U.response_sanity(r, ["model"]), "extraction_rate", "easy_accuracy", "hard_accuracy")
