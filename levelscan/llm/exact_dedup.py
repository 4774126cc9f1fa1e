"""Exact deduplication on an extendible-hash index in shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from levelscan.llm.common import fresh, stored

BUCKET_KEYS = 4_096  # keys a bucket holds before it splits: some megabytes of texts, so owner tasks stay small at any size
MAX_DEPTH = 20        # bits of the directory at most, so it has 1,048,576 rows of 20 bytes at most when it is broadcast; buckets that are still overfull just hold more
SALTS = 16            # parts that copies of one text are combined in before they meet


def depth_for(keys: int, capacity: int = BUCKET_KEYS) -> int:
    """How often the directory doubles for so many keys: two bits beyond full buckets, for ranges that hold more than others."""
    return min(MAX_DEPTH, max(0, math.ceil(math.log2(max(keys, 1) / capacity)) + 2 if keys > capacity else 0))


def key_bits(bits: int) -> Column:
    """The leading bits of the key; the directory's entry number at that depth."""
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS, depth: int = 12) -> DataFrame:
    """(cell, bucket, bits): each of the 2^depth directory entries points to the bucket of its key range.

    ``keys`` has one row per key h.  Doubling step d looks at keys by their first d bits: an overfull range is split in two, a
    range within capacity becomes a bucket and all entries below it share it.  All steps come from one histogram of at most
    2^depth cells, so the keys are read once.
    """
    histogram = keys.groupBy(key_bits(depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = histogram.select("n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"), "cell")
    up = F.expr(f"shiftrightunsigned(cell, {depth} - bits)")
    ranges = levels.groupBy("bits", up.alias("prefix")).agg(F.sum("n").alias("n"))
    overfull = ranges.where(F.col("n") > capacity).select((F.col("bits") + 1).alias("bits"), "prefix")
    split = overfull.select("bits", F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")).where(F.col("bits") <= depth)
    born = split.union(keys.sparkSession.createDataFrame([(0, 0)], "bits int, prefix bigint"))  # the first bucket has depth 0
    leaf = born.join(overfull.select((F.col("bits") - 1).alias("bits"), "prefix").where(F.col("bits") < depth), ["bits", "prefix"], "left_anti")
    first = F.expr(f"shiftleft(prefix, {depth} - bits)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - bits) - 1")
    return leaf.select("bits", first.alias("bucket"), F.explode(F.sequence(first, last)).alias("cell"))


def build_index(keyed: DataFrame, capacity: int = BUCKET_KEYS, depth: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index as shared files (bucket, bits, h, chain, sha, keep_id, group_size), its directory, and the directory's depth.

    ``keyed`` has doc_id, text, h.  Copies are combined in 16 parts first, so a text that a third of all rows share comes to its
    owner as 16 rows.  The directory is made from the keys; each part goes to the owner task of its bucket, a range of keys.
    There rows of a key are sorted by their bytes: where the bytes differ from those before, a new link of the key's chain
    begins.  A link is one text; its largest id and its count come from its rows.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = stored(keyed.groupBy("h", "text", salt.alias("_salt")).agg(F.max("doc_id").alias("_id"), F.count("*").alias("_n")).drop("_salt"))
    keys = stored(parts.select("h").distinct())
    depth = depth_for(keys.count(), capacity) if depth is None else depth
    cells = stored(directory(keys, capacity, depth))
    owned = parts.withColumn("cell", key_bits(depth)).join(F.broadcast(cells), "cell").drop("cell").repartition("bucket")
    of_key = Window.partitionBy("bucket", "h").orderBy("text")
    begins = ~F.col("text").eqNullSafe(F.lag("text").over(of_key))
    linked = owned.withColumn("_new", begins.cast("int")).withColumn("chain", F.sum("_new").over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
    # the link's first row alone carries its digest
    sha = F.max(F.when(F.col("_new") == 1, F.sha2(F.col("text").cast("binary"), 256)))
    entries = linked.groupBy("bucket", "bits", "h", "chain").agg(sha.alias("sha"), F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return stored(entries), cells, depth


def deduplicate(docs: DataFrame, capacity: int = BUCKET_KEYS, depth: int | None = None) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the largest doc_id stays; null ids stay only if the group has no other.  Of
    repeated rows with one id and text, one is kept.  Empty tables give no rows; other columns are ignored.  A very long text is
    one value in one row.  Distinct texts are shuffled twice, to be combined and to their bucket; rows then look themselves up through the
    directory with key and digest, and a key that holds a third of all rows is split by the adaptive join.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    index, cells, depth = build_index(keyed, capacity, depth)
    rows = keyed.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).groupBy("doc_id", "h", "sha").agg(F.count("*").alias("_times"))
    dealt = rows.withColumn("cell", key_bits(depth)).join(F.broadcast(cells.select("cell", "bucket")), "cell").drop("cell")
    found = dealt.join(index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"])
    each = found.select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), F.explode(F.expr("sequence(1, cast(_times as int))")).alias("_i"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their exact copies; all columns as they are.

    The copy with the largest doc_id stays, one row of it, also where rows of one id and text differ in other columns, whatever their
    names.  A null text counts as empty.
    """
    own_id, own_sha, sha = fresh(docs, "_id", "_sha", "_sha2")
    kept = deduplicate(docs).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.withColumn(sha, digest).join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha)), "left_semi")
    return rows.dropDuplicates(["doc_id", sha]).drop(sha)


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
