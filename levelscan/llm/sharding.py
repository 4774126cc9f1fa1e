"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from levelscan.llm.common import CELL_DIGITS, hex_key, source_key, stored, sums_before


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: str = "shard", columns: tuple[str, ...] = ("doc_id", "source", "size", "text_crc32")) -> DataFrame:
    """Deal rows into shards that all have the mixture of sources; law ``rows``: shard counts differ by one at most.

    Rows of a source are ranked from 0 in a seeded shuffle; a row's fractional rank is (rank + u) / rows of the source, with
    one u in [0, 1) for each source; all rows are sorted by it and the sequence is cut into equal pieces.  Any run of the
    sequence holds of each source its share, to within about a row, and the rows of many small sources, spread by their u,
    fill all shards alike.  The same rows always come to the same shards, for any partitioning.

    ``docs`` needs ``columns``; all four are kept, with ``shard`` and ``slot`` (place within the shard, from 0) added.
    Null sources form one source.  Repeated rows get places of their own.  No rows give no rows.  Ranks never take a
    source, or the whole sequence, through one task: see ``sums_before``; the sequence is cut at even fractional ranks.
    """
    spark = docs.sparkSession
    rows = docs.select(*columns).withColumns({"_src": source_key(F.col("source")), "_one": F.lit(1).cast("bigint"), "_key": hex_key(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))})
    totals = rows.groupBy("_src").agg(F.count("*").alias("_n"))
    ranked = sums_before(rows, ["_src"], "_key", ["doc_id"], {"_rank": "_one"}).join(totals, "_src")
    # the fractional rank, and its leading part in hex as an evenly filled key
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("_src"))), 1, 6), 16, 10).cast("double") / 16.0**6
    frac = (F.col("_rank").cast("double") + offset) / F.col("_n").cast("double")
    cell = F.lpad(F.hex(F.least(F.floor(frac * (16**CELL_DIGITS)), F.lit(16**CELL_DIGITS - 1)).cast("bigint")), CELL_DIGITS, "0")
    spread = stored(ranked.withColumn("_frac", frac).withColumn("_cellkey", cell))
    n = spread.count()
    if n == 0:
        return spread.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    placed = sums_before(spread, [], "_cellkey", ["_frac", "_src", "_key", "doc_id"], {"_at": "_one"})
    # the first n % shards shards hold one row more
    low, more = divmod(n, shards)
    head = more * (low + 1)
    shard = F.when(F.col("_at") < head, F.floor(F.col("_at") / (low + 1))).otherwise(more + F.floor((F.col("_at") - head) / max(low, 1)))
    first = F.when(F.col("shard") < more, F.col("shard") * (low + 1)).otherwise(head + (F.col("shard") - more) * low)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("bigint")).select(*columns, "shard", "slot")


def op10_interleaved_sharding(docs: DataFrame) -> DataFrame:
    """One row per document with size (UTF-8 bytes + 1), checksum, shard and slot.

    A null text has no bytes and the checksum of the empty text.  A very long text is measured
    and summed whole, in its own row.  ``grown_shard`` is null: law ``rows`` deals anew when the number of shards changes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = stored(docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    dealt = interleaved_shards(slim)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH RECURSIVE crc(i, v, k) AS (
  SELECT i, i, 0 FROM range(0, 256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) t FROM crc WHERE k = 8),
d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text,
         hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, source, size::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT)),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM d, tab
), r AS (
  SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         md5('shard|' || coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32::VARCHAR || '|' || size::VARCHAR) AS key FROM c
), f AS (
  SELECT *, ((row_number() OVER (PARTITION BY src ORDER BY key, doc_id) - 1)::DOUBLE + ('0x' || substr(md5('shard|' || src), 1, 6))::BIGINT::DOUBLE / 16777216.0::DOUBLE) / (count(*) OVER (PARTITION BY src))::DOUBLE AS frac FROM r
), o AS (SELECT *, row_number() OVER (ORDER BY frac, src, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f),
s AS (SELECT *, CASE WHEN pos < (n % 16) * (n // 16 + 1) THEN pos // (n // 16 + 1) ELSE n % 16 + (pos - (n % 16) * (n // 16 + 1)) // greatest(n // 16, 1) END AS shard FROM o)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
