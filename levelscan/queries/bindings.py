"""How the driver tables feed the operators, in Spark and as SQL text.

events:   series = event type,      level = day,         harder by one unit of value per day
orders:   series = order priority,  level = quarter,     harder by 8 (thousand) per quarter
lineitem: series = return flag,     level = line number, harder by 3 units per line
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from levelscan.functions.special import dip_sf_sql
from levelscan.operators.aggregates import level_table
from levelscan.operators.windows import attach_critical_level
from levelscan.queries.registry import table


def ev_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    level = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(
        F.lit("events").alias("task"), F.col("event_type").alias("model"), level.alias("level"),
        F.col("event_id").alias("item_id"), F.col("user_id").cast("string").alias("answer"),
        F.col("value").alias("x"), (F.col("value") + level <= 60).alias("correct"),
    )


def order_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    level = ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int")
    x = F.col("o_totalprice") / 1000
    return o.select(
        F.lit("orders").alias("task"), F.col("o_orderpriority").alias("model"), level.alias("level"),
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("answer"),
        x.alias("x"), (x + level * 8 <= 350).alias("correct"),
    )


def line_rows(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.lit("lineitem").alias("task"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("level"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_discount").cast("string").alias("answer"), F.col("l_quantity").alias("x"),
        (F.col("l_quantity") + F.col("l_linenumber") * 3 <= 38).alias("correct"),
    )


def all_rows(spark, d) -> DataFrame:
    return ev_rows(spark, d).unionByName(order_rows(spark, d)).unionByName(line_rows(spark, d))


def levels(spark, d, modes: bool = False) -> DataFrame:
    """Level series of the events task; ``modes`` with the dip's p-value and the silhouette."""
    return level_table(ev_rows(spark, d), modes=modes)


def all_levels(spark, d, modes: bool = False) -> DataFrame:
    return level_table(all_rows(spark, d), modes=modes)


def with_d_star(lv: DataFrame) -> DataFrame:
    """The critical level beside every level, by a window, so the level table is built once."""
    return attach_critical_level(lv)


_EV = """SELECT 'events' AS task, event_type AS model,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS level, event_id AS item_id,
  CAST(user_id AS VARCHAR) AS answer, value AS x,
  (value + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) <= 60) AS correct FROM events"""
_ORD_LEVEL = "CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER)"
_ORD = f"""SELECT 'orders' AS task, o_orderpriority AS model, {_ORD_LEVEL} AS level, o_orderkey AS item_id,
  o_orderstatus AS answer, o_totalprice / 1000 AS x, (o_totalprice / 1000 + {_ORD_LEVEL} * 8 <= 350) AS correct FROM orders"""
_LINE = """SELECT 'lineitem' AS task, l_returnflag AS model, l_linenumber AS level,
  l_orderkey * 10 + l_linenumber AS item_id, CAST(l_discount AS VARCHAR) AS answer, l_quantity AS x,
  (l_quantity + l_linenumber * 3 <= 38) AS correct FROM lineitem"""

def dip_sql(src: str, keys: str, x: str, steps: int = 10) -> str:
    """CTEs up to ``dip``: (keys, n, dip_statistic) of the column x of ``src`` per group.

    The convex minorant of a list of points is folded point by point: of the corners so far those up to the one seen at the greatest
    slope stay.  Its height at a place is the highest of the lines through neighbouring corners.  The mode is found by
    ``steps`` bisections, so groups may have 2^steps distinct values.
    """
    def gap(points, above):
        hull = f"list_reduce({points}, lambda h, e: h[1:list_position(list_transform(h, lambda s: (e[1].f - s.f) / (e[1].v - s.v)), list_max(list_transform(h, lambda s: (e[1].f - s.f) / (e[1].v - s.v))))] || e)"
        lines = "list_transform(range(1, len(hull)), lambda j: {v: hull[j].v, f: hull[j].f, m: (hull[j + 1].f - hull[j].f) / (hull[j + 1].v - hull[j].v)})"
        return f"(SELECT coalesce(list_max(list_transform(pts, lambda e: e.u - list_max(list_transform(lines, lambda l: l.f + l.m * (e.v - l.v))))) / 2, 0) FROM (SELECT {lines} AS lines, {above} AS pts FROM (SELECT {hull} AS hull)))"

    left = lambda m: gap(f"list_transform(p[1:{m}], lambda e: [{{v: e.v, f: e.lo}}])", f"list_transform(p[1:{m} - 1], lambda e: {{v: e.v, u: e.hi}})")
    right = lambda m: gap(f"list_transform(p[{m}:], lambda e: [{{v: e.v, f: -e.hi}}])", f"list_transform(p[{m} + 1:], lambda e: {{v: e.v, u: -e.lo}})")
    ctes = [f"""dq AS MATERIALIZED (SELECT {keys}, sum(c)::BIGINT AS n, list({{v: v, lo: lo, hi: hi}} ORDER BY v) AS p, 1::BIGINT AS a, count(*)::BIGINT AS z FROM (SELECT {keys}, v, c, (sum(c) OVER w - c)::DOUBLE / sum(c) OVER g AS lo, (sum(c) OVER w)::DOUBLE / sum(c) OVER g AS hi
 FROM (SELECT {keys}, {x}::DOUBLE AS v, count(*) AS c FROM {src} WHERE {x} IS NOT NULL GROUP BY ALL) WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY v)) GROUP BY {keys})"""]
    last = "dq"
    for i in range(steps):
        ctes.append(f"dq{i} AS MATERIALIZED (SELECT {keys}, n, p, CASE WHEN a >= z OR l >= r THEN a ELSE m + 1 END AS a, CASE WHEN a < z AND l >= r THEN m ELSE z END AS z FROM (SELECT *, CASE WHEN a < z THEN {left('m')} END AS l, CASE WHEN a < z THEN {right('m')} END AS r FROM (SELECT *, (a + z) // 2 AS m FROM {last})))")
        last = f"dq{i}"
    ctes.append(f"dip AS MATERIALIZED (SELECT {keys}, n, CASE WHEN n < 4 THEN 0.0 ELSE least(greatest({left('a')}, {right('a')}), greatest({left('b')}, {right('b')})) END AS dip_statistic FROM (SELECT *, greatest(a - 1, 1) AS b FROM {last}))")
    return ", ".join(ctes)


def split_silhouette_sql(src: str, keys: str, x: str) -> str:
    """CTEs up to ``sil``: (keys, silhouette_k2), the mean silhouette of the best two-means split of the column x per group."""
    k = ", ".join(f"{{t}}.{c.strip()}" for c in keys.split(","))
    on = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in keys.split(","))
    return f"""sv AS MATERIALIZED (SELECT {keys}, v, c, sum(c) OVER w AS cn, sum(c * v) OVER w AS cs, sum(c) OVER g AS n, sum(c * v) OVER g AS s, row_number() OVER w AS i, count(*) OVER g AS k
 FROM (SELECT {keys}, c, v - sum(c * v) OVER g / sum(c) OVER g AS v FROM (SELECT {keys}, {x}::DOUBLE AS v, count(*)::DOUBLE AS c FROM {src} WHERE {x} IS NOT NULL GROUP BY ALL) WINDOW g AS (PARTITION BY {keys})) WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY v)),
sb AS (SELECT *, cs * cs / cn + (s - cs) * (s - cs) / (n - cn) AS b FROM sv WHERE i < k), sc2 AS (SELECT {keys}, i AS cut, cn AS ln, cs AS ls FROM (SELECT *, max(b) OVER (PARTITION BY {keys}) AS mb FROM sb) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(b / greatest(mb, 1e-300), 12) DESC, i) = 1),
sw2 AS (SELECT sv.*, CASE WHEN i <= cut THEN ln ELSE n - ln END AS own_n, CASE WHEN i <= cut THEN ls ELSE s - ls END AS own_s, cn - CASE WHEN i <= cut THEN 0 ELSE ln END AS un, cs - CASE WHEN i <= cut THEN 0 ELSE ls END AS us FROM sv JOIN sc2 ON {on('sv', 'sc2')}),
sx AS (SELECT *, ((v * un - us) + ((own_s - us) - v * (own_n - un))) / greatest(own_n - 1, 1) AS a, abs(v * (n - own_n) - (s - own_s)) / (n - own_n) AS b FROM sw2),
sil AS (SELECT {k.format(t='z')}, coalesce(silhouette_k2, 0) AS silhouette_k2 FROM (SELECT DISTINCT {keys} FROM sv) z LEFT JOIN (SELECT {keys}, sum(c * CASE WHEN own_n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / any_value(n) AS silhouette_k2 FROM sx GROUP BY {keys}) q ON {on('z', 'q')})"""


EV = f"ev AS ({_EV})"
ALL_ROWS = f"ev AS ({_EV} UNION ALL {_ORD} UNION ALL {_LINE})"
# level table over the CTE ``ev``
_LV = """
mu AS (SELECT task, model, level, avg(x) AS mx FROM ev GROUP BY ALL),
mom AS (SELECT ev.task, ev.model, ev.level, count(*) AS n, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE var_samp(x) END AS variance,
  CASE WHEN count(*) < 4 OR avg(power(x - mx, 2)) = 0 THEN 0.0 ELSE
   (power(avg(power(x - mx, 3)) / power(avg(power(x - mx, 2)), 1.5), 2) + 1) /
   (avg(power(x - mx, 4)) / power(avg(power(x - mx, 2)), 2) - 3 + 3.0 * power(count(*) - 1, 2) / ((count(*) - 2.0) * (count(*) - 3.0))) END AS bimodality_coefficient,
  CASE WHEN count(*) FILTER (WHERE correct) >= 2 AND count(*) FILTER (WHERE NOT correct) >= 2 THEN
   sqrt(2.0) * abs(avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE NOT correct)) /
   sqrt(var_pop(x) FILTER (WHERE correct) + var_pop(x) FILTER (WHERE NOT correct)) END AS ashman_d
  FROM ev JOIN mu ON ev.task = mu.task AND ev.model = mu.model AND ev.level = mu.level GROUP BY 1, 2, 3),
ac AS (SELECT task, model, level, answer, count(*) AS c FROM ev GROUP BY ALL),
dis AS (SELECT task, model, level, 1 - max(c) / sum(c) AS disagreement_rate FROM ac GROUP BY ALL),
{modality}lv AS (SELECT mom.*, dis.disagreement_rate{columns} FROM mom JOIN dis USING (task, model, level){joined}),
ds AS (SELECT task, model, min(CASE WHEN accuracy < 0.5 THEN level END) AS d_star FROM lv GROUP BY ALL),
lvd AS (SELECT lv.*, ds.d_star FROM lv JOIN ds USING (task, model))"""
_PLAIN = _LV.format(modality="", columns="", joined="")
_BOTH = _LV.format(
    modality=dip_sql("ev", "task, model, level", "x", 11) + ", " + split_silhouette_sql("ev", "task, model, level", "x") + f", dpv AS MATERIALIZED (SELECT task, model, level, {dip_sf_sql('dip_statistic', 'n')} AS dip_pvalue FROM dip), ",
    columns=", dpv.dip_pvalue, sil.silhouette_k2", joined=" JOIN dpv USING (task, model, level) JOIN sil USING (task, model, level)")
LV = EV + "," + _PLAIN
ALL_LV = ALL_ROWS + "," + _PLAIN
#: with the dip's p-value and the silhouette of every cell
LVM = EV + "," + _BOTH
ALL_LVM = ALL_ROWS + "," + _BOTH
