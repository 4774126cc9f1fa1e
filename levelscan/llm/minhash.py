"""Near-duplicate detection: universal-hash minima, banding, verification, star components."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from levelscan.llm.common import drop_stored, fresh, stored

BANDS, ROWS = 36, 6      # a pair at similarity 0.8 shares no band with probability (1 - 0.8^6)^36 = 1.8e-5
PERCENT = 80
SLACK = 0.12             # signatures are estimates: with 216 minima, 0.12 below the threshold is over four deviations
BLOCK = 512              # members of two components that are compared in one task
CROWD = 16               # components of a bucket that are paired
CELLS = 65_536           # of the hash of shingles, in which their frequencies are counted
_SEED = 20_240_229
_BLOCK = 512             # shingles hashed at once: the buffer stays in the cache


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    n = BANDS * ROWS
    odd = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], draw.integers(0, 2**63, n, dtype=np.uint64)[:, None]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at [\\x20\\x09-\\x0D]+."""
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes], k: int) -> set[bytes]:
    """Distinct k-word shingles; a shorter text is one shingle; no words, none."""
    if not words:
        return set()
    if len(words) <= k:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def base_hash(shingle_set: set[bytes]) -> np.ndarray:
    """32 well-mixed bits per shingle, for the universal hashes."""
    return np.fromiter(map(xxhash.xxh32_intdigest, shingle_set), np.uint64, len(shingle_set))


def minima(base: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each multiply-shift hash (a x + b mod 2^64) / 2^32 over the set.

    The shift keeps order, so it is done once, on the minima; one small buffer is used for every block of shingles.
    """
    least = np.full(len(a), 2**64 - 1, np.uint64)
    room = np.empty((len(a), min(_BLOCK, max(len(base), 1))), np.uint64)
    for at in range(0, len(base), _BLOCK):
        x = base[at:at + _BLOCK]
        part = room[:, :len(x)]
        np.multiply(a, x, out=part)
        np.add(part, b, out=part)
        np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, cls (digest of the word sequence), n_shingles, sig (bytes of the minima; null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        for batch in batches:
            cls, n, sig = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = shingles_of(words, k)
                cls.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                n.append(len(found))
                sig.append(minima(base_hash(found), a, b).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "cls", "n_shingles", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, cls binary, n_shingles bigint, sig binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(bucket, rep): one row per representative and band; the bucket is a hash of the band's number and its minima."""
    width = 4 * ROWS
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")
    return reps.select("rep", F.explode(bands).alias("bucket"))


def similar_signatures(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough places to leave the threshold possible."""
    least = (percent / 100 - SLACK) * BANDS * ROWS
    agree = F.expr(f"aggregate(sequence(0, {BANDS * ROWS - 1}), 0, (n, i) -> n + if(substring(sig_a, 4 * i + 1, 4) = substring(sig_b, 4 * i + 1, 4), 1, 0))")
    left, right = (reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in ("a", "b"))
    joined = pairs.join(left, "a").join(right, "b")
    # of sets whose sizes differ too much no pair reaches the threshold
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return joined.where(sizes & (agree >= least)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on the full shingle sets; ``texts`` has rep and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            for i, (a, b, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)):
                for rep, text in ((a, left), (b, right)):
                    if rep not in known:
                        if len(known) > 64:
                            known.clear()
                        known[rep] = shingles_of(words_of(text), k)
                x, y = known.get(a) or shingles_of(words_of(left), k), known[b]
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])

    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    kind = dict(pairs.dtypes)["a"]
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def links_between(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of the components a and b of ``pairs`` (with size_a, size_b), one per pair of blocks at least.

    The larger component is the centre.  Its members and the members of all that touch it are cut into blocks; each task
    compares one block with one block on full shingle sets and returns links, never pairs, so rows grow with blocks.
    """
    first = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    sides = stored(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.greatest("size_a", "size_b").alias("inner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("root"), F.least("size_a", "size_b").alias("outer")))
    grid = sides.groupBy("centre").agg(F.ceil(F.max("inner") / BLOCK).cast("int").alias("ni"), F.ceil(F.sum("outer") / BLOCK).cast("int").alias("no"))
    inside = grid.withColumn("root", F.col("centre")).withColumn("side", F.lit(0))
    outside = sides.select("centre", "root").join(grid, "centre").select("centre", "ni", "no", "root", F.lit(1).alias("side"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("ni")).otherwise(F.col("no"))).cast("int")
    named = inside.select("centre", "ni", "no", "root", "side").union(outside).join(members, "root").withColumn("own", block)
    needed = stored(named.select("rep").distinct())
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("no")).otherwise(F.col("ni")) - 1))
    dealt = named.withColumn("other", other).select("centre", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("o"), "side", "root", "rep")
    rows = dealt.join(texts.join(needed, "rep", "left_semi"), "rep")
    kind = dict(members.dtypes)["rep"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles_of(words_of(t), k) for t in group["text"]]
        rep, root, side = group["rep"].to_numpy(), group["root"].to_numpy(), group["side"].to_numpy()
        inner, outer = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(inner) or not len(outer):
            return pd.DataFrame({"a": rep[:0], "b": rep[:0]})
        number: dict[bytes, int] = {}
        ids = [np.fromiter((number.setdefault(x, len(number)) for x in sets[i]), np.int64, len(sets[i])) for i in inner]
        flat, length = np.concatenate(ids), np.array([len(x) for x in ids])
        starts = np.cumsum(length) - length
        found, linked = [], set()
        for j in outer:
            if root[j] in linked:  # its component is linked to the centre already
                continue
            mark = np.zeros(len(number), np.int64)
            mark[[number[x] for x in sets[j] if x in number]] = 1
            both = np.add.reduceat(mark[flat], starts)
            hit = np.flatnonzero(100 * both >= percent * (length + len(sets[j]) - both))
            if len(hit):
                found.append((rep[inner[hit[0]]], rep[j]))
                linked.add(root[j])
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": rep.dtype, "b": rep.dtype})

    return rows.select("centre", "i", "o", "side", "root", "rep", "text").groupBy("centre", "i", "o").applyInPandas(compare, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def rare_shingles(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, rep): each text's rarest shingles, as many as make any linked pair share one.

    With n shingles in one order for all texts, two sets at or above the threshold share one of their first n - ceil(n * percent / 100) + 1.
    The order is by frequency, then hash.  Frequencies are counted in CELLS cells of the hash, one array a task, so that counting
    sends no shingles.  Whatever the order, no pair is missed; frequencies only keep common shingles out.
    """
    def hashed(text: str | None) -> np.ndarray:
        found = shingles_of(words_of(text), k)
        return np.fromiter((x - 2**64 if x >= 2**63 else x for x in map(xxhash.xxh64_intdigest, found)), np.int64, len(found))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                cells += np.bincount(hashed(text.as_py()) & (CELLS - 1), minlength=CELLS)
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16]), pa.array([zlib.compress(cells.tobytes(), 1)])], ["part", "cells"])

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cells": [zlib.compress(sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["cells"]).tobytes(), 1)]})

    parts = texts.select("text").mapInArrow(counted, "part bigint, cells binary").groupBy("part").applyInPandas(summed, "cells binary").collect()  # 16 arrays at most
    often = sum((np.frombuffer(zlib.decompress(r["cells"]), np.int64) for r in parts), np.zeros(CELLS, np.int64))
    kind = dict(texts.dtypes)["rep"]

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, length = [], []
            for text in batch.column(1):
                found = hashed(text.as_py())
                n = len(found)
                first = found[np.lexsort((found, often[found & (CELLS - 1)]))][:n + 1 + -n * percent // 100]
                tokens.append(first)
                length.append(len(first))
            reps = batch.column(0).take(pa.array(np.repeat(np.arange(len(length)), length)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), reps], ["token", "rep"])

    return texts.select("rep", "text").mapInArrow(prefix, f"token bigint, rep {kind}")


def touching_components(rare: DataFrame) -> DataFrame:
    """Pairs of components (a, b, size_a, size_b) that share a rare shingle, one of them at least of several members.

    Shingles that the same components share count once.
    """
    held = rare.select("token", "root", "size").distinct()
    alike = held.groupBy("token").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("sum")).where("n > 1 and most > 1")
    once = stored(held.join(alike.groupBy("n", "sum").agg(F.min("token").alias("token")).select("token"), "token", "left_semi"))
    large, other = once.where("size > 1").select("token", F.col("root").alias("a"), F.col("size").alias("size_a")), once.select("token", F.col("root").alias("b"), F.col("size").alias("size_b"))
    return large.join(other, "token").where("a < b or (size_b = 1 and a <> b)").drop("token").distinct()


def links_among_singles(rare: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between documents that are linked to nothing yet and share a rare shingle, enough to connect all that are linked.

    Those of one shingle are cut into blocks.  A task compares one block with another, or with itself, on full sets and returns at most
    one link for each document, so neither rows nor links grow with the pairs.
    """
    alike = rare.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    once = alike.groupBy("n", "sum").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = rare.select("token", "rep").join(once, "token").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = stored(own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep"))
    rows = dealt.join(texts.join(dealt.select("rep").distinct(), "rep", "left_semi"), "rep")
    kind = dict(rare.dtypes)["rep"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        rep, side = group["rep"].to_numpy(), (group["own"] == group["j"]).to_numpy()
        same = group["i"].iloc[0] == group["j"].iloc[0]
        number: dict[bytes, int] = {}
        ids = [np.fromiter((number.setdefault(x, len(number)) for x in shingles_of(words_of(t), k)), np.int64) for t in group["text"]]
        length = np.array([len(x) for x in ids])
        flat, starts = np.concatenate(ids), np.cumsum(length) - length
        label, found = np.arange(len(rep)), []
        for j in np.flatnonzero(side | same):
            mark = np.zeros(len(number), np.int64)
            mark[ids[j]] = 1
            both = np.add.reduceat(mark[flat], starts)
            for i in np.flatnonzero((100 * both >= percent * (length + length[j] - both)) & (same | ~side)):
                if label[i] != label[j]:
                    label[label == label[i]] = label[j]
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": rep.dtype, "b": rep.dtype})

    return rows.select("token", "i", "j", "own", "rep", "text").groupBy("token", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge, by alternating large-star and small-star.

    Large-star links each larger neighbour of a node to the smallest of its neighbourhood, small-star each smaller one and the
    node itself; both keep components and stop when all are stars.  A node's minimum is an aggregate, so a hub's edges are
    never gathered; only edges are carried from round to round, in stored tables, and the last round's is deleted.
    """
    spark = edges.sparkSession
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        after = stored(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(spark, edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("r")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct k-word shingles.  Rows with the
    same word sequence form one class, linked by its smallest doc_id; the rest of the work is on one representative per class.
    Representatives that share a band are candidates, in two steps that never list the pairs of a bucket at once:

    1. Each member of a bucket against the bucket's smallest: signatures, then full sets.  Components of these links.
    2. Components that then share a bucket: up to CROWD of them are paired, so a bucket's pairs grow with its components, and their members
       compared in blocks on full sets (links_between).  The members of a bucket with more components meet by rare
       shingles instead (see rare_shingles), of which any linked pair has one in common: single ones in blocks inside tasks
       (links_among_singles), larger components with all that they touch.  Shingles that many unlinked documents have in common
       are not rare, so a shared passage lists no pairs.

    So any linked pair that shares a band ends up in one component; one shares none, or fails the estimate of step 1 and no other, with
    a probability of about 3e-5 at the threshold.  Null, empty and white-space texts have no set and are their
    own component; null ids form no component and are kept (component null).  Repeated rows are of one class.
    Empty tables give no rows; other columns are ignored.
    """
    signed = stored(signatures(docs, k))
    with_words = signed.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = with_words.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n"))
    reps = stored(signed.join(classes, "cls").where("doc_id = rep").select("rep", "n_shingles", "sig").dropDuplicates(["rep"]))
    buckets = band_rows(reps)
    leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.join(leaders.drop("n"), "bucket").select("bucket", "a", F.col("rep").alias("b")))
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(reps.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])

    tried = stored(shared.where("a < b").select("a", "b").distinct())
    first = stored(similar_signatures(tried, reps, percent))
    needed = stored(first.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    links = stored(confirmed(first, texts.join(needed, "rep", "left_semi"), k, percent))
    roots = components(links)

    # components that share a bucket: few of them are paired, many meet by the rare shingles that any linked pair of them shares
    members = stored(reps.select("rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root")))
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("size")))
    placed = shared.select("bucket", F.col("b").alias("rep")).join(members, "rep")
    held = stored(placed.select("bucket", "root").distinct())
    alike = held.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    few = alike.where(F.col("n") <= CROWD).groupBy("n", "sum").agg(F.min("bucket").alias("bucket"))  # buckets with the same components count once
    once = stored(held.join(few.select("bucket"), "bucket", "left_semi"))
    pairs = once.select("bucket", F.col("root").alias("a")).join(once.select("bucket", F.col("root").alias("b")), "bucket").where("a < b").select("a", "b").distinct()
    touching = stored(pairs.join(sizes.select(F.col("root").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("root").alias("b"), F.col("size").alias("size_b")), "b"))
    single = touching.where("size_a = 1 and size_b = 1").select("a", "b").join(tried, ["a", "b"], "left_anti")
    crowd = stored(placed.join(alike.where(F.col("n") > CROWD).select("bucket"), "bucket", "left_semi").select("rep", "root").distinct().join(sizes, "root"))
    rare = stored(rare_shingles(texts.join(crowd.select("rep"), "rep", "left_semi"), k, percent).join(crowd, "rep"))
    rest = touching.where("size_a > 1 or size_b > 1").unionByName(touching_components(rare)).unionByName(similar_signatures(single, reps, percent).withColumns({"size_a": F.lit(1), "size_b": F.lit(1)}))
    more = stored(links_between(rest.distinct(), members, texts, k, percent).unionByName(links_among_singles(rare.where("size = 1"), texts, k, percent)))
    if not more.isEmpty():
        roots = components(links.union(more))

    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "cls", "n_shingles").join(of_class, "cls", "left")
    root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id; all columns as they are."""
    (name,) = fresh(docs, "_gone")
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
         ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS set FROM w
), e AS (SELECT doc_id, len(set) AS n, unnest(set) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i WHERE 100 * common >= 80 * (na + nb - common)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.node WHERE r.root < t.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept FROM s JOIN m ON m.node = s.doc_id
"""
