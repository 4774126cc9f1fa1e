"""Mixing sources to target weights by fixed-length blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from levelscan.llm.common import fresh, hex_key, permuted, permuted_sql, source_key, stored, sums_before

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SLOTS_PER_TASK = 65_536
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
_WORDS = "[ \\t-\\r]+"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, _WORDS), "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(_src, source_size) -> with place (rank by source), weight and target.

    Targets share the total size by weight and stop at ``most`` times the source's size; the excess is reshared by weight.
    The fixed point is found at once: sources are ordered by cap over weight, and a source is capped if its cap is at most its
    share of what those before it leave.  One row per source passes through the window.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("_src")
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    caps = ranked.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy((F.col("_cap") / F.col("weight")), "_src").rowsBetween(Window.unboundedPreceding, -1)
    left = caps.withColumns({
        "_t": F.sum("source_size").over(everything), "_w": F.sum("weight").over(everything),
        "_cb": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_wb": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    wide = "decimal(38,0)"
    capped = F.col("_cap").cast(wide) * (F.col("_w") - F.col("_wb")).cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (F.col("_t") - F.col("_cb")).cast(wide)
    split = left.withColumn("_capped", capped).withColumns({
        "_c": F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everything),
        "_u": F.sum(F.when(F.col("_capped"), F.lit(0)).otherwise(F.col("weight"))).over(everything),
    })
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise((F.col("weight") * (F.col("_t") - F.col("_c"))).cast("double") / F.col("_u").cast("double"))
    return split.select("_src", "source_size", "place", "weight", target.alias("target"))


def draws(plan: DataFrame, slots: int, seed: str = "mix", shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(counts per output shard and source, blocks drawn with the shard they go to).

    ``plan`` has place, blocks, quota and first (the quotas' running sum); ``slots`` is the quotas' sum.  The slots of a shard
    take their source by the place a pseudorandom permutation gives them among all quotas: the counts per shard are
    multinomial, given that every quota is met exactly.  The k-th draw of a source takes block permuted(k), anew for each
    epoch, so a block comes again only when all blocks of its source have been taken.
    """
    spark = plan.sparkSession
    width = max(1, -(-slots // 1024))
    # a source's quota range, listed under each of 1024 equal cells that it meets: 1024 + sources rows at most
    held = plan.where("quota > 0").select("place", "blocks", "first", "quota", F.explode(F.expr(f"sequence(first div {width}, (first + quota - 1) div {width})")).alias("cell"))
    at = permuted(F.col("slot"), F.lit(slots).cast("bigint"), f"{seed}-slot", F.lit(0))
    slot = spark.range(slots).withColumnRenamed("id", "slot").select(F.expr(f"slot div {shard_slots}").alias("shard"), at.alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    counts = stored(slot.join(held, (slot["cell"] == held["cell"]) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("quota"))).groupBy("shard", "place", "blocks").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # listed by as many tasks as there are draws for, whatever the size of the counts
    each = based.repartition(max(1, slots // SLOTS_PER_TASK), "shard", "place").select("shard", "place", "blocks", F.explode(F.expr("sequence(base, base + n - 1)")).alias("k")).withColumn("epoch", F.expr("k div blocks"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), f"{seed}-block", F.col("place") * 8 + F.col("epoch"))
    return counts, each.select("shard", "place", block.alias("block"))


def mixed(docs: DataFrame, seed: str = "mix", block_words: int = BLOCK_WORDS, size: Column | None = None, keep: tuple[str, ...] = (), shrink: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words of it that the mix takes, repeats counted.

    Documents of a source are laid end to end in a seeded order and packed into blocks of ``block_words`` words (the last may be
    short); a document's words lie in one or more blocks.  Drawn blocks are joined to the packed blocks by index, and
    a document takes the words of it that lie in drawn blocks.  Each source takes its target to within a block or two;
    a block is taken at most three times, and so is a document.

    Null sources are one source, the last; null and empty texts have size 0, take nothing and are returned; repeated rows count
    each; no rows give no rows.  ``keep`` names further columns to carry.  With ``shrink`` the blocks of a source with fewer than
    ``block_words`` of them are cut to 1 / ``block_words`` of its size, so a source of a few words meets its target too.  A hot source is packed by 4096 cells of the seeded
    order, its draws are listed per output shard, and blocks are spread by (source, block).
    """
    sized = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), *keep)
    rows = stored(sized.withColumns({"_src": source_key(F.col("source")), "_one": F.lit(1).cast("bigint"), "_key": hex_key(seed, F.col("doc_id"), F.col("size"))}))
    plan = targets(rows.groupBy("_src").agg(F.sum("size").alias("source_size")))
    length = F.expr(f"least({block_words}, greatest(1, source_size div {block_words}))") if shrink else F.lit(block_words)
    plan = plan.withColumn("length", length.cast("bigint")).withColumn("blocks", F.expr("(source_size + length - 1) div length"))
    plan = plan.withColumn("quota", F.least(F.round(F.col("target") / F.col("length")).cast("bigint"), F.col("blocks") * MAX_EPOCHS))
    before = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    plan = stored(plan.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0))))
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    _, taken = draws(plan, slots, seed)
    uses = taken.groupBy("place", "block").agg(F.count("*").alias("uses"))
    packed = sums_before(rows, ["_src"], "_key", ["doc_id"], {"start": "size", "row": "_one"}).join(plan.select("_src", "place", "source_size", "target", "length"), "_src")
    spans = packed.select("doc_id", *keep, "place", "row", "size", "source_size", "target", "start", "length", F.explode_outer(F.expr("CASE WHEN size > 0 THEN sequence(start div length, (start + size - 1) div length) END")).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("start"), F.col("block") * F.col("length"))
    # a draw grows out of a count, which the planner doesn't see: without the hint it broadcasts a table as large as the mix
    words = spans.join(uses.hint("merge"), ["place", "block"], "left").groupBy("place", "row", "doc_id", *keep, "size", "source_size", "target").agg(F.coalesce(F.sum(overlap * F.col("uses")), F.lit(0)).cast("bigint").alias("taken"))
    return words.select("doc_id", *keep, "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture as whole documents: each comes taken / size times, the fraction decided by a keyed draw.

    Documents without words are in no mix.  All columns as they are.
    """
    row, share, times, copy = fresh(docs, "_row", "_share", "_times", "_i")
    key = F.xxhash64("doc_id", "text")
    shares = mixed(docs.withColumn(row, key), seed, keep=(row,), shrink=True).where("taken > 0")
    # repeated rows share a key: their takings are added and each row gets the mean
    per_row = shares.groupBy(row).agg((F.sum("taken") / F.sum("size")).alias(share))
    draw = F.conv(F.substring(hex_key(seed + "-copies", F.col(row)), 1, 12), 16, 10).cast("double") / float(16**12)
    count = (F.floor(share) + F.when(draw < F.col(share) - F.floor(share), 1).otherwise(0)).cast("int")
    out = docs.withColumn(row, key).join(per_row, row).withColumn(times, count).where(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda w: w <> '')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src FROM documents
), k AS (SELECT *, md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR) AS key FROM d),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
      row_number() OVER (PARTITION BY src ORDER BY key, doc_id) AS rn FROM k),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS place FROM k GROUP BY src),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INTEGER]::BIGINT AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS w,
      coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
      coalesce(sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
c AS (SELECT *, cap * (w - wb) <= weight * (t - cb) AS capped FROM l),
g AS (SELECT src, source_size, place, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (t - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT *, (source_size + length - 1) // length AS blocks, least(round(target / length)::BIGINT, 3 * ((source_size + length - 1) // length)) AS quota FROM (SELECT *, least({BLOCK_WORDS}, greatest(1, source_size // {BLOCK_WORDS})) AS length FROM g)),
e AS (SELECT place, blocks, unnest(range(0, quota)) AS k FROM q WHERE quota > 0),
b AS (SELECT place, {permuted_sql("k % blocks", "blocks", "mix-block", "place * 8 + k // blocks")} AS block FROM e),
u AS (SELECT place, block, count(*) AS uses FROM b GROUP BY place, block),
x AS (SELECT p.rn, q.place, unnest(range(start // length, (start + size - 1) // length + 1)) AS block, start, size, length FROM p JOIN q USING (src) WHERE size > 0),
y AS (SELECT rn, place, sum(uses * (least(start + size, (block + 1) * length) - greatest(start, block * length)))::BIGINT AS taken FROM x JOIN u USING (place, block) GROUP BY rn, place)
SELECT p.doc_id, p.size, q.source_size, q.target, coalesce(y.taken, 0)::BIGINT AS taken FROM p JOIN q USING (src) LEFT JOIN y ON y.rn = p.rn AND y.place = q.place
"""
