"""Nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from levelscan.llm.common import bounded_sample, stored

NEAREST = 20
SAMPLE = 20_000          # vectors that the tree is fitted on, at most
BRANCH = 8
SPLIT = 32               # a node with more than this fraction (1 / SPLIT) of the sample is split: about 64 leaves at any size
CALIBRATION = 200        # queries whose true neighbours set the number of leaf visits
RECALL = 0.93            # over the calibration queries; the contract asks for 0.9
PARTS = 12               # bins of a full search
BLOCK = 2048             # vectors, and queries, that meet in one task


class Tree:
    """Inner nodes hold the centres of their children; leaves have numbers."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.small = max(1, len(vectors) // SPLIT)
        draw = np.random.default_rng(seed)
        self._grow(vectors, draw)

    def _grow(self, vectors: np.ndarray, draw: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0)))
        self.leaf.append(-1)
        distinct = np.unique(vectors, axis=0) if len(vectors) > self.small else vectors[:1]
        if len(distinct) <= 1:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        centres = distinct[draw.permutation(len(distinct))[:BRANCH]]
        for _ in range(10):
            near = self._nearest(vectors, centres)
            centres = np.stack([vectors[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        near = self._nearest(vectors, centres)
        used = [c for c in range(len(centres)) if (near == c).any()]
        if len(used) <= 1:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        self.centres[node] = centres[used]
        self.children[node] = [self._grow(vectors[near == c], draw) for c in used]
        return node

    @staticmethod
    def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the nearest centre."""
        out = np.zeros(len(vectors), np.int64)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = self._nearest(vectors[rows], self.centres[node])
            stack.extend((child, rows[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any())
        return out

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first leaves by best bin first: a priority queue of all branches not taken, nearest centre first.

        With ``sizes`` of leaves it goes on after ``most`` leaves until they hold ``least`` vectors or none is left.
        """
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        held = 0
        while queue and (len(found) < most or sizes is not None and held < least):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                far = -(self.centres[node] @ query)
                best = int(far.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(far[c]), child))
                node = self.children[node][best]
            found.append(self.leaf[node])
            held += sizes.get(self.leaf[node], 0) if sizes is not None else 0
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that take part: an id, at least one component, all finite, not all zero, of the usual length.

    The usual length is the most frequent one (the shorter on a tie).
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.expr("size(_e) > 0 and forall(_e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(_e, x -> x <> 0)")
    rows = vectors.select("vec_id", e.alias("_e")).where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("_e").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n")
    return rows.join(F.broadcast(usual), F.size("embedding") == F.col("n")).drop("n")  # one row


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def inner_products(asked: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Every product summed in the order of the components, so equal vectors have equal scores in every block."""
    total = np.zeros((len(asked), len(have)))
    for left, right in zip(asked.T, have.T, strict=True):
        total += left[:, None] * right
    return total


def best_in_blocks(index: DataFrame, asked: DataFrame, by: list[str], nearest: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of the index for each query that asks for it; at most ``nearest`` rows.

    ``index`` has ``by``, vec_id, embedding; ``asked`` has ``by``, query_id, query.  Both sides of a bin are cut into blocks, however many
    vectors or queries it has; the blocks' sizes come from a count, and a task meets two blocks.
    """
    count = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = count(index, "nv").join(count(asked, "nq"), by)
    left = index.join(grid, by).select(*by, F.pmod(F.xxhash64("vec_id"), F.col("nv")).cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "embedding")
    right = asked.join(grid, by).select(*by, F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("v"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("q"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.col("query").alias("embedding"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        have, ask = group[group["side"] == 0].sort_values("id"), group[group["side"] == 1]
        if have.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, qids = have["id"].to_numpy(np.int64), ask["id"].to_numpy(np.int64)
        scores = inner_products(_matrix(ask["embedding"]), _matrix(have["embedding"]))
        ids, starts = np.unique(ids, return_index=True)  # a repeated id takes one place, with its best score
        scores = np.maximum.reduceat(scores, starts, axis=1)
        scores[qids[:, None] == ids[None, :]] = -np.inf
        # all that tie with the last of the best stay; ``ranked`` decides by id
        least = -np.partition(-scores, nearest - 1, 1)[:, nearest - 1, None] if scores.shape[1] > nearest else np.full((len(qids), 1), -np.inf)
        asks, at = np.nonzero((scores >= least) & (scores > -np.inf))
        order = np.lexsort((ids[at], -scores[asks, at], asks))
        asks, at = asks[order], at[order]
        first = np.arange(len(asks)) - np.searchsorted(asks, asks) < nearest
        return pd.DataFrame({"query_id": qids[asks[first]], "vec_id": ids[at[first]], "score": scores[asks[first], at[first]]})

    return left.union(right).groupBy(*by, "v", "q").applyInPandas(meet, "query_id bigint, vec_id bigint, score double")


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)


class Index:
    """A fitted tree, and every vector stored with its leaf."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE):
        rows = stored(usable(vectors))
        drawn = bounded_sample(rows, sample, "vec_id").select("embedding").toPandas()
        self.empty = drawn.empty
        self.tree = Tree(_matrix(drawn["embedding"])) if not self.empty else None
        tree = self.tree

        def place(batches):
            for batch in batches:
                yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": batch["embedding"], "leaf": tree.place(_matrix(batch["embedding"]))}) if len(batch) else batch.assign(leaf=np.zeros(0, np.int64))

        self.rows = rows if self.empty else stored(rows.mapInPandas(place, "vec_id bigint, embedding array<double>, leaf bigint"))
        # ids, each counted in one of its leaves: any leaves together hold at least the sum of their sizes
        once = [] if self.empty else self.rows.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()
        self.sizes = {r["leaf"]: r["count"] for r in once}

    def search(self, queries: DataFrame, visits: int, nearest: int = NEAREST) -> DataFrame:
        """(query_id, rank, vec_id, score) from the first ``visits`` leaves of each query's traversal.

        A query goes on to further leaves until they hold ``nearest`` ids besides its own, or all leaves are visited.
        """
        tree, sizes = self.tree, self.sizes

        def ask(batches):
            for batch in batches:
                rows = [(i, e, leaf) for i, e in zip(batch["vec_id"], batch["embedding"], strict=True) for leaf in tree.visits(np.asarray(e, np.float64), visits, sizes, nearest + 1)]
                yield pd.DataFrame(rows, columns=["query_id", "query", "leaf"]).astype({"query_id": "int64", "leaf": "int64"})

        asked = queries.select("vec_id", "embedding").mapInPandas(ask, "query_id bigint, query array<double>, leaf bigint")
        return ranked(best_in_blocks(self.rows, stored(asked), ["leaf"], nearest), nearest)

    def calibrated(self, queries: DataFrame, nearest: int = NEAREST, recall: float = RECALL, sample: int = CALIBRATION) -> tuple[int, float]:
        """(visits, recall): leaf visits are widened until a bounded sample of queries finds that share of its true neighbours.

        The truth is a full search of all vectors, in blocks, of which at most ``sample`` * ``nearest`` rows come to the driver with the
        leaf each lies in; a neighbour is found once the traversal of its query has come to its leaf.  Once all leaves are
        visited the search is exact.
        """
        some = stored(bounded_sample(queries, sample, "vec_id"))
        spread = self.rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).cast("int"))
        ask = some.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        truth = ranked(best_in_blocks(spread.select("part", "vec_id", "embedding"), ask, ["part"], nearest), nearest)
        leaves = truth.join(self.rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
        order = {r["vec_id"]: {leaf: i for i, leaf in enumerate(self.tree.visits(np.asarray(r["embedding"]), self.tree.leaves))} for r in some.toLocalIterator()}
        needed = np.array([order[q][leaf] + 1 for q, leaf in leaves])
        visits = 1
        while visits < self.tree.leaves and len(needed) and (needed <= visits).mean() < recall:
            visits += 1
        return visits, float((needed <= visits).mean()) if len(needed) else 1.0


def nearest_neighbours(vectors: DataFrame, every: int = 20, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors whose vec_id is divisible by ``every``, against all others.

    Largest inner product in double precision on the original vectors, nearest first, ties to the smaller vec_id.  Vectors that are null,
    zero, hold null or non-finite components, or are not of the usual length take no part, nor do null ids; of repeated ids
    a result names the id once, with its best score.  Without vectors there are no rows.
    """
    index = Index(vectors)
    if index.empty:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = index.rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    visits, _ = index.calibrated(queries, nearest)
    return index.search(queries, visits, nearest).select("query_id", "rank", "vec_id", "score")
