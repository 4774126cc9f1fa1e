"""Ranked lexical search: no-random-access reads (NRA) of impact-sorted lists, on an index cut into shards of documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from levelscan.llm.common import stored

TOP = 10
BLOCK_ENTRIES = 262_144    # (item, term) entries that one pass over the documents serves; more items take more passes
SHARD_DOCS = 8_192         # documents of a shard, and
SHARD_ENTRIES = 2_097_152  # its list entries, at most (one document may have more)
FIRST_READ = 128           # entries of a list that the first round reads; each round reads four times as deep

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8, bytes from 0x80 on stand in other characters only


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in order, only A-Z lower-cased."""
    return _TERM.findall((text or b"").lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray | int, n_docs: int, n_terms: int):
    """A document's m."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


class Shard:
    """Impact-sorted lists of some documents for the terms of the items, and NRA on them."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        """``doc`` (place in ids), ``term`` (number) and ``impact`` of each list entry; entries without impact are left out."""
        order = np.lexsort((doc, -impact, term))
        order = order[impact[order] > 0]
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, top: int, least: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """(places in ids, scores) of the item's best documents here, at most ``top``, best first.

        ``least``: score and id of the last document that the item has elsewhere; only better ones are looked for.

        Every round reads all lists on to the same depth.  A document's lower bound is the sum of its impacts read; its upper bound
        adds, for each list in which it was not met, the impact at which that list's reading stands.  The search ends when
        no unseen document and no seen one outside the best can reach the best ones' last score (by equality either, as ids
        decide ties), and each document that still can has equal bounds.  So membership, ties and scores are final.
        """
        lo, hi = self.start[terms], self.start[terms + 1]
        lo, hi = lo[hi > lo], hi[hi > lo]
        lower = np.zeros(len(self.ids), np.int64)
        read, depth = lo.copy(), FIRST_READ
        if not len(lo):
            return np.zeros(0, np.int64), lower[:0]
        seen = np.zeros((len(lo), len(self.ids)), bool)
        floor = max(least[0], 1) if least else 1
        while True:
            until = np.minimum(lo + depth, hi)
            count = until - read
            row = np.repeat(np.arange(len(lo)), count)
            at = np.arange(count.sum()) + np.repeat(read - (np.cumsum(count) - count), count)
            np.add.at(lower, self.doc[at], self.impact[at])
            seen[row, self.doc[at]] = True
            read = until
            bound = np.where(read < hi, self.impact[np.minimum(read, hi - 1)], 0)
            unseen = int(bound.sum())
            last = max(floor, int(np.partition(lower, -top)[-top])) if len(lower) >= top else floor
            if unseen < last:
                open_lists = np.flatnonzero(bound)
                upper = lower + unseen - bound[open_lists] @ seen[open_lists]
                able = np.flatnonzero(upper >= last)
                if (upper[able] == lower[able]).all():
                    break
            depth *= 4
        if least:
            able = able[(lower[able] > least[0]) | ((lower[able] == least[0]) & (self.ids[able] < least[1]))]
        best = able[np.lexsort((self.ids[able], -lower[able]))][:top]
        return best, lower[best]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item, over all its rows; items without an id or a term are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = set(terms_of(text.as_py()))
                ids.extend([item] * len(found))
                out.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item_id", "term"])

    named = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id bigint, term binary").distinct()


def term_statistics(docs: DataFrame, wanted: set[bytes]) -> DataFrame:
    """(term, n): for each wanted term the documents that hold it; term null with ``n`` documents and ``total`` terms in all.

    Tasks send one row a term and task, so a term that all documents hold is counted on the map side.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        n = total = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                terms = terms_of(text.as_py())
                n += bool(terms)
                total += len(terms)
                df.update(wanted.intersection(terms))
        names = [None, *df]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "n", "total"])

    return docs.select("text").mapInArrow(run, "term binary, n bigint, total bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def search_block(docs: DataFrame, block: dict[int, list[bytes]], top: int) -> DataFrame:
    """(item_id, doc_id, score): for a bounded block of items the best documents of every task; the best of all are among them."""
    spark = docs.sparkSession
    names = sorted({t for terms in block.values() for t in terms})
    counted = {r["term"] and bytes(r["term"]): (r["n"], r["total"]) for r in term_statistics(docs, set(names)).collect()}  # as many rows as the block has terms
    n_docs, n_terms = counted.get(None, (0, 0))
    number = {t: i for i, t in enumerate(names)}
    weights = np.array([weight(n_docs, counted.get(t, (0, 0))[0]) for t in names], np.int64)
    wanted = {item: np.array([number[t] for t in terms], np.int64) for item, terms in block.items()}
    model = spark.sparkContext.broadcast((number, weights, wanted))  # at most BLOCK_ENTRIES entries, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights, wanted = model.value
        best: dict[int, list[tuple[int, int]]] = {item: [] for item in wanted}  # (-score, id)
        ids: list[int] = []
        doc: list[np.ndarray] = []
        held = 0

        def search() -> None:
            if not ids:
                return
            at, term, tf, m = (np.concatenate(x) for x in zip(*doc, strict=True))
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            shard = Shard(np.array(ids, np.int64), at, term, impact, len(weights))
            for item, terms in wanted.items():
                so_far = best[item]
                full = (-so_far[-1][0], so_far[-1][1]) if len(so_far) == top else None
                places, scores = shard.search(terms, top, full)
                if len(places):
                    best[item] = sorted(so_far + list(zip((-scores).tolist(), shard.ids[places].tolist(), strict=True)))[:top]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                terms = terms_of(text.as_py())
                counts = Counter(map(number.get, terms))
                counts.pop(None, None)
                if not counts:
                    continue
                if len(ids) == SHARD_DOCS or held + len(counts) > SHARD_ENTRIES:
                    search()
                    ids, doc, held = [], [], 0
                size = len(counts)
                m = length_norm(len(terms), n_docs, n_terms)
                doc.append((np.full(size, len(ids), np.int64), np.fromiter(counts.keys(), np.int64, size), np.fromiter(counts.values(), np.int64, size), np.full(size, m, np.int64)))
                ids.append(doc_id)
                held += size
        search()
        rows = [(item, doc_id, -less) for item, found in best.items() for less, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def item_blocks(items: DataFrame, entries: int) -> Iterator[dict[int, list[bytes]]]:
    """The items with their terms in blocks of at most ``entries`` entries; a larger item is a block of its own."""
    listed = stored(item_terms(items).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id"))
    block: dict[int, list[bytes]] = {}
    held = 0
    for row in listed.orderBy("item_id").toLocalIterator():
        if block and held + len(row["terms"]) > entries:
            yield block
            block, held = {}, 0
        block[row["item_id"]] = [bytes(t) for t in row["terms"]]
        held += len(row["terms"])
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Each item's ``top`` documents by score: item_id, rank (from 1), doc_id, score (above 0; ties by smaller doc_id).

    The items are a stated query set, served in blocks against all documents.  A block takes one pass for the statistics of its
    terms (documents, terms, documents per term) and one for the search: every task cuts its documents into shards of bounded
    size, sorts their lists by impact and runs NRA for each item to the end (see Shard.search), starting from the
    item's last score in earlier shards.  Scores are exact and use the statistics of all documents, so the best of the tasks' best
    are the best of all.  Texts are never shuffled; a task sends at most ``top`` rows an item.

    Null and empty texts have no terms, count in no statistic and are never found; very long texts are read whole.
    Documents without an id count in the statistics but are not returned.  Repeated rows are documents of their own, and come
    with ranks of their own.  Rows of one item id are one item; items without an id or a term have no rows, and
    empty tables give none.  Other columns are ignored.
    """
    found = None
    for block in item_blocks(items, entries):
        part = search_block(docs, block, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
a AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
o AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) u WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM o, a GROUP BY term),
i AS (SELECT r, doc_id, o.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS impact FROM o JOIN w ON w.term = o.term, a),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM q JOIN i ON i.term = q.term GROUP BY item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 AND doc_id IS NOT NULL)
SELECT * FROM k WHERE rank <= {TOP}
"""
