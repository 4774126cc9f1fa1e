"""Periodic runs of words, by a dictionary of basic factors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_WORDS = 12      # a run has at least so many words, and two periods
GROUP_WORDS = 65_536  # texts are worked on together up to so many words; a longer text is worked on alone


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return (text or b"").split()


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's test change: every tenth document, by crc32 of its id, repeats a passage from word a on.  Null ids change nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def basic_factors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per power of two L: L, the number of the factor of L words at each place, and the occurrences of repeated factors.

    ``words`` holds word numbers.  Equal factors have equal numbers; factors that stand once have -1 and are left out of longer
    lengths, as no longer factor from there repeats either.  Occurrences come sorted by (factor, place), with the group's number.
    """
    length, names = 1, words
    alive = np.arange(len(words))
    key = words.astype(np.int64)
    while len(alive):
        order = np.argsort(key, kind="stable")
        sorted_key, places = key[order], alive[order]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        group = np.cumsum(new) - 1
        repeats = np.bincount(group)[group] > 1
        places, group = places[repeats], group[repeats]
        if not len(places):
            return
        names = np.full(len(words), -1, np.int64)
        names[places] = group
        yield length, names, places, group
        alive = np.sort(places)
        alive = alive[alive + length < len(words)]
        right = names[alive + length]
        alive, right = alive[right >= 0], right[right >= 0]
        key = names[alive] * (group[-1] + 1) + right
        length *= 2


def proposed(length: int, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) from occurrences of factors of ``length`` words that follow one another within twice the length.

    Successors at most half the length apart overlap by their least period, so they form one arithmetic progression and stand
    for it by its first and last place.  A run whose period q is in [length, 2 length) leads from a place over at most three
    larger gaps to a later progression, and is met at its first place or by lining up the last places of both progressions.
    """
    new = np.r_[True, (group[1:] != group[:-1]) | (2 * (places[1:] - places[:-1]) > length)]
    member = np.cumsum(new) - 1                       # the progression of each occurrence
    first = places[new]
    last = places[np.r_[np.flatnonzero(new)[1:], len(places)] - 1]
    of = group[new]
    starts, periods = [], []
    for step in (1, 2, 3):
        later = member + step
        ok = later < len(first)
        here, later = np.flatnonzero(ok), later[ok]
        same = of[later] == group[here]
        here, later = here[same], later[same]
        for start, end in ((places[here], first[later]), (last[member[here]], last[later])):
            period = end - start
            fits = (period >= length) & (period < 2 * length)
            starts.append(start[fits])
            periods.append(period[fits])
    return np.concatenate(starts), np.concatenate(periods)


def agreement(tables: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from places a on and b on are the same (``back``: before a and before b), through ever shorter factors."""
    a, b, n = a.copy(), b.copy(), len(tables[0][1])
    total = np.zeros(len(a), np.int64)

    for length, names in reversed(tables):  # no factor of twice the longest length repeats, so each length fits once at most
        x, y = (a - length, b - length) if back else (a, b)
        todo = np.flatnonzero(x >= 0 if back else y < n)
        named = names[x[todo]]
        hit = todo[(named >= 0) & (named == names[y[todo]])]
        move = -length if back else length
        a[hit] += move
        b[hit] += move
        total[hit] += length
    return total


def runs_of(words: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """All runs of a sequence of word numbers: rows (start, length, period), by start, then period.

    Proposals are extended both ways, kept if they hold two periods and ``least`` words, and of equal stretches the least period stays.
    """
    factors, found = list(basic_factors(words)), []
    tables = [(length, names) for length, names, _, _ in factors]
    for length, _, places, group in factors:
        start, period = proposed(length, places, group)
        if not len(start):
            continue
        pairs = np.unique(period * (len(words) + 1) + start)
        period, start = np.divmod(pairs, len(words) + 1)
        fresh = np.r_[True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)]  # neighbours belong to one run
        start, period = start[fresh], period[fresh]
        ahead = agreement(tables, start, start + period, False)
        behind = agreement(tables, start, start + period, True)
        size = behind + ahead + period
        good = size >= np.maximum(least, 2 * period)
        found.append(np.stack([(start - behind)[good], size[good], period[good]], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = np.r_[False, (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])] if len(rows) else np.zeros(0, bool)
    rows = rows[~same]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """The runs of several texts at once.  Words of different texts are different, so no run crosses an edge."""
    numbers: list[int] = []
    top = 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers.extend([top + own.setdefault(w, len(own)) for w in words])
        top += len(own)
    rows = runs_of(np.array(numbers, np.int64), least)
    edges = np.cumsum([0, *map(len, texts)])
    at = np.searchsorted(rows[:, 0], edges)
    return [rows[at[i]:at[i + 1]] - np.array([edges[i], 0, 0]) for i in range(len(texts))]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def detect_runs(docs: DataFrame, least: int = LEAST_WORDS, planted: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period in words from 0, by start, then period), collapsed_text.

    A run is a stretch of words with smallest period q that holds at least two periods and ``least`` words and that neither
    neighbour extends.  ``collapsed_text`` has the words that no run holds after its first q words, joined by one space.
    ``planted`` first repeats a passage in every tenth document (see ``looped``).

    Null, empty and white-space texts have no words and no runs.  Repeated rows give repeated rows; rows without an id are
    worked on like others.  Runs of equal length and start differ in period and all count.  Texts of any length are
    worked on whole: n words take O(n log n) time and 8 log2(n) bytes a repeated word at most, in the task that holds the row;
    shorter texts share one pass.  Nothing is shuffled.  Empty tables give no rows; other columns are ignored.
    """
    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts, least)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        cells = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        kept = [b" ".join(kept_words(w, r)) for w, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(offsets, cells), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                if texts and held + len(words) > GROUP_WORDS:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(looped(words, doc_id) if planted else words)
                held += len(words)
        if texts:
            yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256."""
    found = detect_runs(docs, planted=True)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    # the longest run first, then the smallest start, then the smallest period
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = found.withColumns({"best": first, "listed": F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")})
    length, period = -F.col("best.less"), F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"), F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
