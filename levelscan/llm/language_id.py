"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from levelscan.llm.common import fresh

PROFILE = 400       # n-grams of a profile
ORDERS = (1, 2, 3)  # lengths of n-grams
MAX_LANGUAGES = 1000
LEAST_SCORE = 0.2   # a document is rejected below it: few of its frequent n-grams are in any profile
_BITS = 21          # bits of a code point; a trigram fills 63 bits
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CHUNK = 2_000_000  # characters whose n-grams are sorted at once


def letters(text: str | None) -> str:
    """Lower-cased words with one space around each; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    return f" {words} " if any(map(str.isalpha, words)) else ""


def gram_codes(text: str) -> np.ndarray:
    """One integer per n-gram of every order; n-grams lie within a word and its surrounding spaces."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inner = code != 32
    out = [code[inner]]
    for n in ORDERS[1:]:
        if len(code) < n:
            continue
        gram = code[: len(code) - n + 1].copy()
        for k in range(1, n):
            gram |= code[k: len(code) - n + 1 + k] << (_BITS * k)
        fits = np.ones(len(gram), bool)
        for k in range(1, n - 1):  # a space only at the ends
            fits &= inner[k: len(inner) - n + 1 + k]
        out.append(gram[fits])
    return np.concatenate(out)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; a very long text in pieces cut at spaces, so the whole is counted."""
    if len(text) <= _CHUNK:
        return np.unique(gram_codes(text), return_counts=True)
    grams, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(text) - 1:
        cut = text.find(" ", min(at + _CHUNK, len(text) - 1))
        new, n = np.unique(gram_codes(text[at: cut + 1]), return_counts=True)
        both = np.concatenate([grams, new])
        grams, where = np.unique(both, return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        at = cut
    return grams, counts


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The n-grams by falling count, ties by code."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


class Profiles:
    """Language profiles, each sorted by n-gram for look-up."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(ranked)
        self.sorted = []
        for name in self.names:
            grams = np.array(ranked[name], np.int64)
            order = np.argsort(grams)
            self.sorted.append((grams[order], order))

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The language of the smallest out-of-place distance (ties: the name that sorts first), and 1 - distance / largest."""
        place = np.arange(len(grams))
        best, least = "und", None
        for name, (known, rank) in zip(self.names, self.sorted, strict=True):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            off = np.where(known[at] == grams, np.abs(rank[at] - place), self.size)
            distance = int(off.sum())
            if least is None or distance < least:
                best, least = name, distance
        if least is None:
            return "und", 0.0
        return best, 1.0 - least / (self.size * len(grams))


def _held_out(doc_id):
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the most frequent n-grams of each language, over all texts of documents that have a language and aren't held out.

    Tasks count n-grams of whole batches and combine them, so a shuffled row is one n-gram of one language and task; the top of
    each language is cut per task before the languages meet.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(letters(text))
            for lang, texts in by_lang.items():
                grams, counts = counted(" ".join(t.strip(" ") for t in texts if t).join("  "))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out(F.col("doc_id")))
    totals = told.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("lang", "gram", "place")


def profiles(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Learned profiles on the driver: at most ``size`` n-grams for each of at most MAX_LANGUAGES languages (more are an error)."""
    top = learn(docs, size)
    rows = top.limit(size * MAX_LANGUAGES + 1).collect()
    if len(rows) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    ranked: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, place in rows:
        ranked.setdefault(lang, []).append((place, gram))
    return Profiles({lang: [g for _, g in sorted(pairs)] for lang, pairs in ranked.items()}, size)


def identify(docs: DataFrame, known: Profiles, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the predicted language and its score for every row; the whole text is profiled.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.  No shuffle.
    """
    size = known.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                text = letters(text)
                found.append(known.nearest(most_frequent(*counted(text), size)) if text else ("und", 0.0))
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Documents whose crc32(doc_id as text) mod 4 is 2 are held out of learning; a null id counts as the empty text (not held
    out).  Empty tables give no rows, repeated rows repeated predictions; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", _held_out(F.col("doc_id")))
    return identify(rows, profiles(docs), ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told: those without a letter and those that no profile resembles go."""
    columns = docs.columns
    whole, lang, score = fresh(docs, "_whole", "_told", "_score")
    carried = docs.withColumn(whole, F.col("text"))
    told = identify(carried, profiles(docs), (*(c for c in columns if c != "text"), whole), (lang, score))
    return told.where((F.col(lang) != "und") & (F.col(score) >= least_score)).withColumnRenamed(whole, "text").select(*columns)
