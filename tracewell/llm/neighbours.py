"""Nearest vectors by inner product: low-dimensional stable projections, kd-trees and a chi-square stopping test.

With M the largest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0); their squared distance is |q|^2 + M^2 less
twice the inner product, so the nearest candidate has the largest inner product.  Both are projected on PROJECTED Gaussian directions:
a squared projected distance over the squared distance has a chi-square law with PROJECTED degrees of freedom.  Candidates are visited
by projected distance and verified on the original vectors, until the law says that a candidate as near as the k-th one found would
have shown up with probability CONFIDENCE at the projected distance reached.

A coarse kd-tree, fitted on a bounded sample, deals all candidates to cells, and a crowded cell to several blocks; each block has its
own kd-tree.  A query starts with the k-th inner product in the sample, travels to the cells within its reach only, and each block
returns what beats that start.  Blocks hold BLOCK_ROWS candidates or so, queries stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTED = 8
CONFIDENCE = 0.97
SEED = 20_240_607
#: Vectors of least hash that the coarse tree and the starting bounds are fitted on.
SAMPLE = 16_384
#: Cells of the coarse tree: at least LEAST_CELLS, and more where a cell would hold more than BLOCK_ROWS.
LEAST_CELLS, BLOCK_ROWS = 32, 250_000
#: Points of a leaf of a block's kd-tree.
LEAF = 64
#: Rows of queries that one search step holds.
QUERY_ROWS = 128
VECTOR = "array<double>"


def chi_square(x: float) -> float:
    """Distribution function of the chi-square law with PROJECTED (even) degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, PROJECTED // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < p else (low, mid)
    return high


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors that can be compared.

    A vector that is null, empty, zero or holds a null or a non-finite number takes no part, nor does a row without id.  Of several
    dimensions the most frequent counts (ties: the larger one).
    """
    x = F.col("embedding").cast(VECTOR)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~bad)
    good = good.where(F.exists("x", lambda v: v != 0))
    most = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("x") == (most.d if most else 0))


class Tree:
    """kd-tree over projected points: boxes of its leaves and the points in each."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, waiting = [], [np.arange(len(points))]
        while waiting:
            part = waiting.pop()
            if len(part) <= leaf:
                parts.append(part)
                continue
            spread = points[part].max(0) - points[part].min(0)
            order = np.argpartition(points[part, int(spread.argmax())], len(part) // 2)
            waiting += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
        self.parts = parts
        self.low = np.array([points[p].min(0) for p in parts])
        self.high = np.array([points[p].max(0) for p in parts])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of every query to every box."""
        out = np.zeros((len(queries), len(self.low)))
        for axis in range(queries.shape[1]):
            at = queries[:, axis, None]
            out += np.maximum(np.maximum(self.low[:, axis] - at, at - self.high[:, axis]), 0) ** 2
        return out


class Cells:
    """Coarse tree: ``2 ** depth`` cells by medians of a sample, each on the axis of widest spread."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        size = 2**depth
        self.axis, self.cut = np.zeros(size, np.int64), np.zeros(size)
        m = sample.shape[1]
        self.low, self.high = np.full((2 * size, m), -np.inf), np.full((2 * size, m), np.inf)
        parts = {1: sample}
        for node in range(1, size):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = (part.max(0) - part.min(0)).argmax()
                self.cut[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] > self.cut[node]
            for child, rows in ((2 * node, part[~right]), (2 * node + 1, part[right])):
                parts[child] = rows
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, self.axis[node]] = self.low[2 * node + 1, self.axis[node]] = self.cut[node]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - 2**self.depth

    def distances(self, queries: np.ndarray) -> np.ndarray:
        low, high = self.low[2**self.depth :], self.high[2**self.depth :]
        out = np.zeros((len(queries), len(low)))
        for axis in range(queries.shape[1]):
            at = queries[:, axis, None]
            out += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0) ** 2
        return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal numbers wherever they stand."""
    return (rows * query).sum(1)


class Space:
    """Projection of candidates and queries."""

    def __init__(self, dimension: int, largest: float):
        self.largest = largest
        self.directions = np.random.default_rng(SEED).standard_normal((dimension + 1, PROJECTED))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return x @ self.directions[:-1] + more[:, None] * self.directions[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[:-1]


class Block:
    """Candidates of one block, ready to be searched.  Rows with the same id and vector count once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space):
        order = np.lexsort((*x.T[::-1], ids))
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
        self.ids, self.x, self.space = ids[order][keep], x[order][keep], space
        _, copies = np.unique(self.ids, return_counts=True)
        self.copies = int(copies.max())
        self.tree = Tree(space.candidates(self.x))

    def search(self, qid: np.ndarray, q: np.ndarray, start: np.ndarray, k: int, limit: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(row of the query, ids, inner products)``: the k best of this block that reach the query's start.

        Leaves come by projected distance, in runs of half of what was seen; before each run the test is made with the k-th product so far.
        """
        k *= self.copies
        far = self.tree.distances(self.space.queries(q))
        norms = (q * q).sum(1) + self.space.largest**2
        for i in range(len(q)):
            order = np.argsort(far[i], kind="stable")
            reach, at, run = far[i][order], 0, 4
            bound, ids, scores = start[i], np.empty(0, np.int64), np.empty(0)
            while at < len(order) and reach[at] <= limit * max(norms[i] - 2 * bound, 0) + 1e-9 * norms[i]:
                rows = np.concatenate([self.tree.parts[j] for j in order[at : at + run]])
                s = products(self.x[rows], q[i])
                good = (s >= bound) & (self.ids[rows] != qid[i])
                ids, scores = np.concatenate([ids, self.ids[rows][good]]), np.concatenate([scores, s[good]])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    bound = max(bound, scores[-1])
                at += run
                run = max(4, at // 2)
            if len(ids):
                yield i, ids, scores


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, least_cells: int = LEAST_CELLS, block_rows: int = BLOCK_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``vectors(vec_id, embedding)`` where ``is_query``, its nearest other ids.

    Scores are exact; a neighbour is found with probability ``confidence`` or more.  Ties go to the smaller id.  An id that comes
    with several vectors is returned once, with its best score, and searched with its vector of least hash.  No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    some = rows.agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(F.size("x")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not some.n:
        return spark.createDataFrame([], schema)
    depth = max(0, math.ceil(math.log2(max(least_cells, some.n / block_rows))))
    taken = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample).collect()
    fitted = np.array([r.x for r in taken])
    space, fitted_ids = Space(some.d, some.largest), np.array([r.vec_id for r in taken])
    cells = Cells(space.candidates(fitted), depth)
    limit = quantile(confidence)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.of(space.candidates(_matrix(b.column(1)))).astype(np.int32))], ["vec_id", "x", "cell"])

    dealt = rows.mapInArrow(assign, f"vec_id long, x {VECTOR}, cell int")
    fair = some.n / 2**depth
    shares = [0] * 2**depth
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect():
        shares[r.cell] = max(1, round(r.n / fair))
    blocks = F.array(*[F.lit(s) for s in shares])[F.col("cell")]
    candidates = dealt.select("cell", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "x", F.lit(0.0).alias("start"), F.lit(0).cast("long").alias("version"))

    def travel(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(at, QUERY_ROWS)
                q, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                s = q @ fitted.T
                s[ids[:, None] == fitted_ids[None, :]] = -np.inf
                # repeated ids of the sample count once: the start must be reached by k different ids
                start = np.array([_kth(row, fitted_ids, k) for row in s])
                norms = (q * q).sum(1) + space.largest**2
                reach = limit * np.maximum(norms - 2 * start, 0) + 1e-9 * norms
                who, where = np.nonzero(cells.distances(space.queries(q)) <= reach[:, None])
                where, who = _with_blocks(where, who, shares)
                slack = start - 1e-12 * norms
                yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(np.ones(len(who), np.int32)), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(slack[who]), part.column(2).take(pa.array(who))], ["cell", "block", "kind", "vec_id", "x", "start", "version"])

    asked = rows.where(is_query).select("vec_id", "x", F.xxhash64("x").alias("version"))
    queries = asked.mapInArrow(travel, f"cell int, block int, kind int, vec_id long, x {VECTOR}, start double, version long")
    meeting = candidates.unionByName(queries).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")

    def search(batches):
        for block, part in _met(batches, space):
            for at in range(0, part.num_rows, QUERY_ROWS):
                piece = part.slice(at, QUERY_ROWS)
                qid, version = piece.column("vec_id").to_numpy(), piece.column("version").to_numpy()
                found = list(block.search(qid, _matrix(piece.column("x")), piece.column("start").to_numpy(), k, limit))
                if found:
                    who = np.repeat([i for i, _, _ in found], [len(ids) for _, ids, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(qid[who]), pa.array(version[who]), pa.array(np.concatenate([ids for _, ids, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "version", "vec_id", "score"])

    hits = meeting.mapInArrow(search, "query_id long, version long, vec_id long, score double")
    best = hits.groupBy("query_id", "version", "vec_id").agg(F.max("score").alias("score"))
    versions = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("version").alias("version"))
    best = best.join(versions, ["query_id", "version"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _kth(scores: np.ndarray, ids: np.ndarray, k: int) -> float:
    """k-th largest score among different ids, minus infinity if there are fewer."""
    good = np.isfinite(scores)
    ids, scores = ids[good], scores[good]
    if len(ids) < k:
        return -np.inf
    order = np.argsort(-scores)
    _, first = np.unique(ids[order], return_index=True)
    first.sort()
    return float(scores[order[first[k - 1]]]) if len(first) >= k else -np.inf


def _with_blocks(where: np.ndarray, who: np.ndarray, shares: list[int]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Every (cell, query) once for each block of the cell."""
    times = np.array(shares)[where]
    first = np.cumsum(times) - times
    block = np.arange(times.sum()) - np.repeat(first, times)
    return (np.repeat(where, times), block), np.repeat(who, times)


def _met(batches, space: Space) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Queries next to the block they meet; rows come by (cell, block), candidates first."""
    now, ids, rows, block = None, [], [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "kind")], 1)
        cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part, here = batch.slice(a, b - a), tuple(key[a, :2])
            if here != now:
                now, ids, rows, block = here, [], [], None
            if key[a, 2] == 0:
                ids.append(part.column("vec_id").to_numpy())
                rows.append(_matrix(part.column("x")))
            elif ids or block:
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(rows), space)
                    ids, rows = [], []
                yield block, part


def search_embeddings(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``nearest`` for the rows whose ``vec_id`` is divisible by ``every``."""
    return nearest(embeddings, F.col("vec_id") % every == 0, k)
