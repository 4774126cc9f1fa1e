"""Line deduplication: lines that many documents share stay in one of them only.  DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from levelscan.llm.common import stored

LEAST_CHARS = 20  # code points of a key
LEAST_DOCS = 3    # documents that hold it
HOT_KEYS = 1024   # the most frequent keys, which are broadcast

_SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased.

    ``lower`` on lines of ASCII letters alone, where it means the same; other lines keep their other letters as they are.
    """
    bare = F.trim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h, g, doc_id, version, at): 128-bit hash of the key, and place, of every line whose key is long enough.

    ``version`` tells rows of one id with different texts apart.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select("doc_id", "version", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "doc_id", "version", "at")


def lost_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, version, lost): the places of the lines that go, for every text that loses any.

    1. Lines are hashed once and stored.  A key's documents are counted with partial sums on the map side, so a line that a third
       of all documents hold is no hot group.
    2. Keys over the threshold meet their lines.  The 1024 most frequent are broadcast, so their lines stay where they are; any other
       key holds less than 1/1024 of the counted documents, so no task of the shuffled join is hot.
    """
    lines = stored(keyed_lines(docs, least_chars))
    pairs = lines.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
    common = stored(pairs.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= least_docs))
    hot = F.broadcast(common.orderBy(F.col("n").desc(), "h", "g").limit(HOT_KEYS).select("h", "g", "holder"))
    rest = common.join(hot.select("h", "g"), ["h", "g"], "left_anti").select("h", "g", "holder")
    met = lines.join(hot, ["h", "g"]).unionByName(lines.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(rest, ["h", "g"]))
    return met.where(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy("doc_id", "version").agg(F.collect_set("at").alias("lost"))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per row: doc_id, row (the whole input row as a struct), n_lines, n_dropped, kept_text.

    A text is split at each line feed.  A key is a line without white space at both ends, A-Z lower-cased.  Keys of at least
    ``least_chars`` code points in at least ``least_docs`` documents lose all their lines, except in the largest doc_id that holds them.
    The other lines stay in their order, joined by line feeds.

    Null and empty texts are one empty line.  A document is what one doc_id names: rows that repeat an id count as one
    document and lose the same keys.  Rows without an id count as one document that is smaller than all others.  A key that
    stands several times in its largest document keeps all its lines there.  Very long texts are worked on whole; a row's
    lines are put together by place in time linear in their number.  Empty tables give no rows; further columns, whatever their
    names, are only in ``row``.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lost = lost_lines(whole, least_chars, least_docs).withColumnsRenamed({"doc_id": "of_doc", "version": "of_version"})
    rows = whole.withColumn("version", F.xxhash64("text"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))  # by a hash set, in order
    cut = joined.select("doc_id", "row", "text", "lost", lines.alias("lines"), stay.alias("stay"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    return cut.select("doc_id", "row", F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents with the lines dropped from their texts (see ``deduplicated``); all columns as they are, a null text stays null."""
    out = deduplicated(docs, least_chars, least_docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the remaining text in UTF-8)."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {LEAST_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.holder AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
