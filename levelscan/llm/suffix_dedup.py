"""Removal of repeated byte strings by suffix arrays of shards, built by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from levelscan.llm.common import stored

LENGTH = 200
GRAM = 64               # bytes of a minimizer, a power of two
LONGEST_RUN = 2048      # windows of a segment at most; a longer run is cut into several
SHARD_BYTES = 250_000   # text of one suffix array; small enough for a core's cache
HOT_SEGMENTS = 4096     # different segments of one key beyond which its windows are keyed one by one
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


# --- suffix arrays -------------------------------------------------------------------------------------------------

def suffix_array(text: list[int] | np.ndarray, symbols: int) -> list[int]:
    """The suffix array by induced sorting.

    Suffixes are classified as smaller or larger than their right neighbour; substrings between leftmost-smaller places are
    named in their order and, if names repeat, sorted by the array of the names, recursively; the sorted places induce the
    rest in two linear scans.  The end of the text is smaller than every symbol.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    array = np.asarray(text, np.int64)
    # suffix i is smaller than suffix i + 1, told by the next place where symbols differ; the end is smaller than all
    step = np.append(array[1:] - array[:-1], -1)
    differ = np.where(step != 0, np.arange(n), n)
    differ = np.minimum.accumulate(differ[::-1])[::-1]
    rises = step[differ] > 0
    wide = symbols > 255
    raw = array.astype(">u4" if wide else np.uint8).tobytes()
    symbol = array.tolist() if wide else raw
    places = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).tolist()
    order = _sorted_places(raw, places, 4 if wide else 1) if places else []
    # by suffix: is the one to its left larger, smaller; the entry at n is for places not filled yet
    left_larger = np.concatenate([[False], ~rises[:-1], [False]]).astype(np.uint8).tobytes()
    left_smaller = np.concatenate([[False], rises[:-1], [False]]).astype(np.uint8).tobytes()
    counts = np.bincount(array, minlength=symbols)
    ends = counts.cumsum()
    end, start = ends.tolist(), (ends - counts).tolist()
    sa = [n] * n
    for i in reversed(order):
        at = end[symbol[i]] = end[symbol[i]] - 1
        sa[at] = i
    last = symbol[n - 1]
    sa[start[last]] = n - 1
    start[last] += 1
    for j in sa:  # grows ahead of the scan
        if left_larger[j]:
            j -= 1
            c = symbol[j]
            at = start[c]
            sa[at] = j
            start[c] = at + 1
    end = ends.tolist()
    for j in reversed(sa):
        if left_smaller[j]:
            j -= 1
            c = symbol[j]
            at = end[c] = end[c] - 1
            sa[at] = j
    return sa


def _sorted_places(raw: bytes, places: list[int], width: int) -> list[int]:
    """The leftmost-smaller places in the order of their suffixes; ``raw`` has ``width`` bytes a symbol, all below the top value.

    A substring reaches up to and including the next such place.  If it begins a longer one, that one falls or stays after its
    end while the suffix there rises, so the shorter is larger, which a top symbol at its end says; the last one ends with the text.
    """
    top = b"\xff" * width
    pieces = [raw[width * i:width * (e + 1)] + top for i, e in zip(places, places[1:], strict=False)]
    pieces.append(raw[width * places[-1]:])
    name = {piece: k for k, piece in enumerate(sorted(set(pieces)))}
    named = [name[piece] for piece in pieces]
    if len(name) < len(named):
        return [places[k] for k in suffix_array(named, len(name))]
    order = [0] * len(named)
    for k, v in enumerate(named):
        order[v] = places[k]
    return order


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each rank, how long the suffix agrees with the one before it, up to ``most``; found in text order.

    In text order a suffix agrees with its predecessor for at least one less than the suffix one place to the left did.  Only
    where the symbols to the left differ must be compared; all others follow from it.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.where((np.arange(n) > 0) & (before > 0), before - 1, 0)
    own = np.arange(n) - 1
    fresh = (before <= 0) | (own < 0) | (text[np.maximum(own, 0)] != text[left]) | (before[np.maximum(own, 0)] != before - 1)
    long = np.zeros(n, np.int64)
    rows = np.flatnonzero(fresh & (before >= 0))
    a, b = rows.copy(), before[rows]
    padded = np.concatenate([text, np.arange(-1, -2, -1)])
    alive = np.arange(len(rows))
    bound = n  # a whole common prefix is needed, as the values to the right are counted down from it
    step = 0
    while len(alive) and step < bound:
        x, y = a[alive] + step, b[alive] + step
        same = (x < n) & (y < n)
        same[same] = padded[x[same]] == padded[y[same]]
        long[rows[alive[~same]]] = step
        alive = alive[same]
        step += 1
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = np.where(before < 0, 0, np.maximum(long[start] - (np.arange(n) - start), 0))
    return np.minimum(plcp[sa], most)


def repeated_starts(segments: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the starts below its number of windows whose next ``length`` bytes stand elsewhere in the segments too."""
    joined = b"\x00".join(segments)
    text = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
    offsets = np.cumsum([0, *(len(s) + 1 for s in segments)])[:-1]
    text[offsets[1:] - 1] = 0  # borders stand in no window
    sa = np.array(suffix_array(text, int(text.max()) + 1), np.int64)  # UTF-8 has no byte above F4
    agree = common_prefixes(text, sa, length)
    twice = np.zeros(len(text), bool)
    hit = np.flatnonzero(agree >= length)
    twice[sa[hit]] = True
    twice[sa[hit - 1]] = True
    return [np.flatnonzero(twice[o:o + w]) for o, w in zip(offsets, windows, strict=True)]


# --- windows that can repeat ---------------------------------------------------------------------------------------

def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = take(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return take(values[:len(values) - rest], values[rest:]) if rest else values


def runs_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last, times): runs of windows with the same least gram hash, and how often that gram stands in the run.

    Equal windows have equal keys.  A window is ``length`` bytes; its key is the least hash of its grams.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = length - GRAM + 1
    code = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(n - GRAM + 1, np.uint64)
    part, span, at = code * _MIX, 1, 0  # hash of 2 * span bytes from two hashes of span bytes
    while span < GRAM:
        part = (part[:-span] * _BASE ^ (part[:-span] >> np.uint64(29))) + part[span:]
        span *= 2
        at += 1
    hashed = part ^ (part >> np.uint64(32))
    hashed = hashed * _MIX
    hashed ^= hashed >> np.uint64(29)
    least = _sliding(hashed, width, np.minimum)
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge - 1, [len(least) - 1]])
    key = least[first]
    # grams that are the least of some window; their number in each run's bytes
    blank = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([blank, least, blank]), width, np.maximum)
    places = np.flatnonzero(hashed == most)
    names, number = np.unique(hashed[places], return_inverse=True)
    held = np.sort(number * np.int64(n + 1) + places)
    own = np.searchsorted(names, key) * np.int64(n + 1)
    times = np.searchsorted(held, own + last + width) - np.searchsorted(held, own + first)
    if (last - first >= LONGEST_RUN).any():
        cut = [(k, f, min(f + LONGEST_RUN - 1, z), t) for k, a, z, t in zip(key, first, last, times, strict=True) for f in range(a, z + 1, LONGEST_RUN)]
        key, first, last, times = (np.array(c) for c in zip(*cut, strict=True))
        key = key.astype(np.uint64)
    return key.view(np.int64), first, last, times


def _runs_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = [runs_of((t or "").encode()) for t in part.column(1).to_pylist()]
                size = np.array([len(f[0]) for f in found])
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), size)))
                key, first, last, times = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([keys, pa.array(key), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.array(np.minimum(times, 2).astype(np.int64))], ["txt", "val", "first", "last", "times"])

    return docs.select("txt", "text").mapInArrow(run, "txt binary, val bigint, first bigint, last bigint, times bigint")


def _segments(texts: DataFrame) -> DataFrame:
    """(val, segment, windows, txt, first): the bytes of each candidate run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.slice(at, 32)
                out: list[tuple[int, bytes, int, bytes, int]] = []
                for txt, text, runs in zip(*(part.column(c).to_pylist() for c in ("txt", "text", "runs")), strict=True):
                    data = text.encode()
                    out.extend((r["val"], data[r["first"]:r["last"] + LENGTH], r["last"] - r["first"] + 1, txt, r["first"]) for r in runs)
                val, segment, windows, txt, first = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(val, pa.int64()), pa.array(segment, pa.binary()), pa.array(windows, pa.int64()), pa.array(txt, pa.binary()), pa.array(first, pa.int64())], ["val", "segment", "windows", "txt", "first"])

    return texts.mapInArrow(run, "val bigint, segment binary, windows bigint, txt binary, first bigint")


def _as_runs(starts: np.ndarray) -> list[dict[str, int]]:
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "z": int(z)} for a, z in zip(starts[np.concatenate([[0], edge + 1])], starts[np.concatenate([edge, [len(starts) - 1]])], strict=True)]


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def _shard_arrays(distinct: DataFrame) -> DataFrame:
    """(val, digest, runs): repeated starts of each segment of (val, segment, windows); rows of one val come together, sorted."""
    def solve(rows: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        found = repeated_starts([r[1] for r in rows], [r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.md5(r[1]).digest() for r in rows], pa.binary()), pa.array([_as_runs(f) for f in found], _RUNS)], ["val", "digest", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield solve(held)

    return distinct.select("val", "segment", "windows").mapInArrow(run, "val bigint, digest binary, runs array<struct<a:bigint,z:bigint>>")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes, if asked for).

    A byte goes if a 200-byte string that covers it starts anywhere else too, in the same document or another.

    1. A window's key is its least gram; runs of windows with one key are segments.  Keys that stand in one place only can't
       repeat and go no further.
    2. Equal segments of a key are combined with their count.  A segment that stands twice repeats as a whole.
    3. Keys with several different segments are gathered into shards of about SHARD_BYTES, whose suffix arrays are built by
       induced sorting; starts that agree with a neighbour for 200 bytes repeat.
    4. A key with more than HOT_SEGMENTS different segments (the edge of a passage in a great many documents) isn't brought
       into one shard: its windows are counted one by one, combined before the shuffle.

    Null and empty texts have 0 bytes and the digest of nothing.  Equal texts, repeated rows among them, repeat each other.  No
    rows give no rows; other columns are ignored.  Texts are known by their md5 between the steps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("txt", F.unhex(F.md5("text")))
    runs = stored(_runs_table(keyed.where(F.octet_length("text") >= LENGTH)))
    again = runs.groupBy("val").agg(F.sum("times").alias("n"), F.count("*").alias("c")).where("n > 1 or c > 1").select("val")
    candidates = runs.join(again, "val").select("txt", "val", "first", "last").distinct().groupBy("txt").agg(F.collect_list(F.struct("val", "first", "last")).alias("runs"))
    many = keyed.groupBy("txt").agg(F.count("*").alias("copies"))
    with_runs = stored(keyed.select("txt", "text").join(candidates.join(many, "txt"), "txt").dropDuplicates(["txt"]))
    segments = stored(_segments(with_runs.select("txt", "text", "runs")).join(many.where("copies > 1"), "txt", "left").withColumn("copies", F.coalesce("copies", F.lit(1))))
    distinct = stored(segments.groupBy("val", "segment", "windows").agg(F.sum("copies").alias("copies")))
    sizes = distinct.groupBy("val").agg(F.count("*").alias("segments"))
    twice = distinct.where("copies > 1").select("val", F.unhex(F.md5("segment")).alias("digest"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("windows") - 1).alias("z"))).alias("runs"))
    # one segment alone can repeat within itself, so every key not settled above goes to the shards
    sized = distinct.join(sizes, "val").where("segments > 1 or copies = 1")
    shards = sized.where(F.col("segments") <= HOT_SEGMENTS).repartition("val").sortWithinPartitions("val")
    solved = _shard_arrays(shards)
    hot = sized.where(F.col("segments") > HOT_SEGMENTS).select("val", F.unhex(F.md5("segment")).alias("digest"), "segment", "copies", F.explode(F.expr("sequence(0L, windows - 1)")).alias("a"))
    window = F.unhex(F.md5(F.substring("segment", F.col("a").cast("int") + 1, F.lit(LENGTH))))
    hot = stored(hot.select("val", "digest", "copies", "a", window.alias("window")))
    common = hot.groupBy("val", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("val", "window")
    split = hot.join(common, ["val", "window"], "left_semi").select("val", "digest", F.array(F.struct("a", F.col("a").alias("z"))).alias("runs"))
    found = stored(twice.union(solved).union(split).where(F.size("runs") > 0))
    marks = segments.select("txt", "val", "first", F.unhex(F.md5("segment")).alias("digest")).join(found, ["val", "digest"])
    spans = marks.select("txt", F.explode("runs").alias("r"), "first").select("txt", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.z")).alias("z")).alias("s")).groupBy("txt").agg(F.collect_list("s").alias("spans"))
    cut = stored(_cut(with_runs.select("txt", "text").join(spans, "txt"), with_text))
    columns = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    slim = keyed.select("doc_id", "txt", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha"), *([F.col("text").cast("binary").alias("_all")] if with_text else []))
    whole = {"n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint"), "kept_sha256": F.col("_sha"), "kept": F.col("_all") if with_text else None}
    return slim.join(cut, "txt", "left").select("doc_id", "n_bytes", *[F.coalesce(F.col(c), whole[c]).alias(c) for c in columns])


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [s["a"] for s in spans], 1)
                np.add.at(edge, [s["z"] + LENGTH for s in spans], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = data[~gone].tobytes()
                out.append((int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest(), kept))
            removed, spans, sha, kept = zip(*out, strict=True) if out else ((),) * 4
            arrays = [batch.column("txt"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.binary())] if with_text else [])], ["txt", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return rows.select("txt", "text", "spans").mapInArrow(run, "txt binary, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
