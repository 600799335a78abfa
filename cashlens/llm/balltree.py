"""Exact top-k by integer inner product: ball-tree branch and bound in each shard.

A node's upper bound for a query is the product with the ball's centre plus the query's norm times the radius.
Nodes are opened from the largest bound down, until no bound reaches the kth score so far. That score is
shared: every query first searches its own shard, and the score found there is the floor of all other shards.

Components are floor(256 * x) as integers, and scores are exact as long as they fit a long.

Defined results: see the contract in `shards.taking_part`; zero vectors take part; vectors of different lengths
never meet; a query with fewer candidates than k gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from . import shards

LEAF_ROWS = 64
NONE = -(1 << 63)


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors)


def build(ids: np.ndarray, vectors: np.ndarray):
    """The tree of one shard: rows in leaf order, and for each node centre, radius, row range and children."""
    points = quantised(vectors)
    order = np.arange(len(points))
    centres, radii, spans, children, todo = [], [], [], [], [(0, len(points), -1, 0)]
    while todo:
        low, high, parent, side = todo.pop()
        part = points[order[low:high]]
        centre = part.mean(axis=0)
        gaps = part - centre
        far = np.sqrt((gaps * gaps).sum(axis=1))
        node = len(centres)
        centres.append(centre)
        radii.append(far.max())
        spans.append((low, high))
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = node
        if high - low > LEAF_ROWS and far.max() > 0:
            # split at the median along the line between two far rows
            one = part[far.argmax()]
            away = part - one
            axis = part[(away * away).sum(axis=1).argmax()] - one
            order[low:high] = order[low:high][np.argsort(part @ axis, kind="stable")]
            middle = (low + high) // 2
            todo += [(low, middle, node, 0), (middle, high, node, 1)]
    return ids[order], points[order], np.array(centres), np.array(radii), spans, children


def search(index, query_ids, queries, floors, k):
    """query, ids and scores of each query's k best rows of the shard that are not below its floor."""
    ids, points, centres, radii, spans, children = index
    wanted = quantised(queries)
    norms = np.sqrt((wanted * wanted).sum(axis=1))
    # whole numbers below 2**53 are exact in floating point; others are counted in integers
    exact = np.abs(points).max(initial=0) * np.abs(wanted).max(initial=0) * points.shape[1] < 2**52
    rows = points if exact else points.astype(np.int64)
    bounds = wanted @ centres.T + norms[:, None] * radii
    slack = 1e-9 * (np.abs(bounds) + norms[:, None] * (radii + np.sqrt((centres * centres).sum(axis=1)))) + 1e-6
    out = []
    for i, query in enumerate(query_ids.tolist()):
        limit = bounds[i] + slack[i]
        vector = wanted[i] if exact else wanted[i].astype(np.int64)
        best, kth = [], int(floors[i])  # best: a heap of (score, -id), so that of equal scores the larger id goes first
        heap = [(-limit[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if children[node][0] >= 0:
                for child in children[node]:
                    if limit[child] >= kth:
                        heapq.heappush(heap, (-limit[child], child))
                continue
            low, high = spans[node]
            scores = rows[low:high] @ vector
            for at in np.flatnonzero(scores >= kth).tolist():
                entry = (int(scores[at]), -int(ids[low + at]))
                if entry[1] == -query:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        found = sorted(best, key=lambda e: (-e[0], -e[1]))
        out.append((query, [-r for _, r in found], [s for s, _ in found]))
    return out


def top_k(embeddings: DataFrame, queries_where, k: int = 5, rows_per_shard: int = shards.ROWS_PER_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that `queries_where` chooses, their k best others."""
    rows, n = shards.sharded(written(shards.taking_part(embeddings, zeros=True), "vectors"), rows_per_shard)
    index = written(shards.indexed(rows, build), "trees")
    queries = rows.where(queries_where).select("vec_id", "vector", "dim", "shard", F.lit(NONE).alias("floor"))
    at_home = written(shards.searched(index, shards.in_blocks(queries, None), lambda *a: search(*a, k), "long"), "home")
    floors = at_home.where(F.size("scores") == k).select(F.col("query_id").alias("vec_id"), F.element_at("scores", -1).alias("kth"))
    others = F.sequence(F.lit(0), F.lit(n - 1))
    again = (
        queries.join(floors, "vec_id", "left")
        .select("vec_id", "vector", "dim", F.col("shard").alias("home"), F.coalesce("kth", "floor").alias("floor"))
    )
    away = shards.searched(index, shards.in_blocks(again, others), lambda *a: search(*a, k), "long")
    # a query's own shard is searched again with its floor in place: every result comes from this round
    return shards.best(away, k)
