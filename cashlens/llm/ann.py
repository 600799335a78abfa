"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Each shard holds a graph over its distinct vectors. Greedy searches from an entry point propose neighbours;
relaxed distance pruning keeps a neighbour only if no kept one is nearer to it by the factor ALPHA, so that
edges stay diverse; reverse edges are added and pruned likewise. A beam search answers queries.

Pruning needs distances: vectors get one more component that makes all norms equal, by which the largest inner
product is the smallest distance. Copies of a vector are one node that lists its rows, so that they cannot
crowd out a node's edges.

Defined results: see the contract in `shards.taking_part`; zero vectors take no part; vectors of different
lengths never meet; a query with fewer candidates than k gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from . import shards

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
#: The beam is at least this many times as wide as the number of neighbours asked for.
BEAM_PER_NEIGHBOUR = 4
ALPHA = 1.2
#: Nodes that are inserted together, and nodes that a search expands at a time.
BATCH = 256
EXPAND = 4


def beam_search(vectors, edges, entry, queries, width):
    """Rows of the `width` nodes nearest to each query found, nearest first (-1: none), and their distances.

    Distance is minus the inner product; vectors of equal norm make that the order of distances.
    """
    n, m = len(vectors), len(queries)
    seen = np.zeros((m, n + 1), bool)
    seen[:, -1] = seen[:, entry] = True
    nodes, far = np.full((m, width), -1), np.full((m, width), np.inf, np.float32)
    nodes[:, 0], far[:, 0] = entry, -queries @ vectors[entry]
    opened = np.ones((m, width), bool)
    opened[:, 0] = False
    active = np.arange(m)
    while len(active):
        shut = opened[active]
        pick = np.argsort(shut, axis=1, kind="stable")[:, :EXPAND]
        live = ~np.take_along_axis(shut, pick, 1)
        centre = np.where(live, np.take_along_axis(nodes[active], pick, 1), -1)
        shut[np.arange(len(active))[:, None], pick] = True
        fresh = np.where(centre[:, :, None] >= 0, edges[centre], -1).reshape(len(active), -1)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh[seen[active[:, None], fresh]] = -1
        seen[active[:, None], fresh] = True
        rows, cols = np.nonzero(fresh >= 0)
        new = np.full(fresh.shape, np.inf, np.float32)
        new[rows, cols] = -np.einsum("ij,ij->i", vectors[fresh[rows, cols]], queries[active[rows]])
        all_far = np.hstack([far[active], new])
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[active] = np.take_along_axis(all_far, keep, 1)
        nodes[active] = np.take_along_axis(np.hstack([nodes[active], fresh]), keep, 1)
        opened[active] = np.take_along_axis(np.hstack([shut, new == np.inf]), keep, 1)
        active = active[~opened[active].all(axis=1)]
    return nodes, far


def robust_prune(vectors, points, candidates, degree, alpha):
    """Up to `degree` diverse neighbours for each point out of its row of candidate nodes (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == points[:, None]] = -1
    alive = candidates >= 0
    around = vectors[candidates]
    norm = float(vectors[0] @ vectors[0])
    far = np.where(alive, np.maximum(2 * norm - 2 * np.einsum("ijk,ik->ij", around, vectors[points]), 0), np.inf)
    chosen = np.full((len(points), degree), -1)
    every = np.arange(len(points))
    for step in range(degree):
        nearest = far.argmin(axis=1)
        some = far[every, nearest] < np.inf
        if not some.any():
            break
        chosen[some, step] = candidates[every, nearest][some]
        between = np.maximum(2 * norm - 2 * np.einsum("ijk,ik->ij", around, around[every, nearest]), 0)
        # distances are squared here, so the factor is as well
        far[alpha**2 * between <= far] = np.inf
        far[every, nearest] = np.inf
    return chosen


def build_graph(vectors: np.ndarray, degree=DEGREE, width=BUILD_BEAM, alpha=ALPHA, seed=11):
    """Edges (-1: none) and entry node over rows of equal norm."""
    n, rng = len(vectors), np.random.default_rng(seed)
    room = 2 * degree  # reverse edges may fill a node's list up to this before it is pruned again
    edges = np.full((n + 1, room), -1)
    entry = int((vectors @ vectors.mean(axis=0)).argmax())
    order = rng.permutation(n)
    edges[:n, :4] = rng.integers(0, n, (n, 4))
    step = 1
    start = 0
    while start < n:
        # small batches first: early nodes must not miss each other
        step = min(BATCH, max(step, start // 2), n - start) or 1
        points = order[start : start + step]
        start += step
        near, _ = beam_search(vectors, edges, entry, vectors[points], width)
        chosen = robust_prune(vectors, points, np.hstack([near, edges[points]]), degree, alpha)
        edges[points] = -1
        edges[points, :degree] = chosen
        from_, at = np.nonzero(chosen >= 0)
        to, back = chosen[from_, at], points[from_]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        extra = np.full((len(targets), counts.max(initial=1)), -1)
        extra[np.repeat(np.arange(len(targets)), counts), place] = back
        both = np.hstack([edges[targets], extra])
        size = (both >= 0).sum(axis=1)
        full = size > room
        if full.any():
            pruned = robust_prune(vectors, targets[full], both[full], degree, alpha)
            edges[targets[full]] = -1
            edges[targets[full], :degree] = pruned
        if (~full).any():
            packed = -np.sort(-both[~full], axis=1)[:, :room]
            edges[targets[~full]] = packed
    return edges, entry


def build(ids: np.ndarray, vectors: np.ndarray):
    """The index of one shard: distinct vectors with the rows of each, edges, entry."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    by_node = np.argsort(node.ravel(), kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(node.ravel(), minlength=len(distinct))))
    scale = np.abs(distinct).max()
    unit = distinct / scale
    squares = (unit * unit).sum(axis=1)
    level = np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]
    lifted = np.hstack([unit, level]).astype(np.float32)
    edges, entry = build_graph(lifted) if len(distinct) > SEARCH_BEAM else (None, 0)
    return ids[by_node], ends, distinct, lifted[:, :-1].copy(), edges, entry


def search(index, query_ids, queries, floors, k):
    """query, ids and scores of each query's k best rows of the shard that the beam found."""
    ids, ends, distinct, unit, edges, entry = index
    out = []
    for low in range(0, len(queries), BATCH):
        part = queries[low : low + BATCH]
        if edges is None:
            nodes = np.tile(np.arange(len(distinct)), (len(part), 1))
        else:
            scaled = part / np.abs(part).max(axis=1, keepdims=True)
            nodes, _ = beam_search(unit, edges, entry, scaled.astype(np.float32), max(SEARCH_BEAM, BEAM_PER_NEIGHBOUR * k))
        scores = np.where(nodes >= 0, shards.products(distinct[nodes], part[:, None, :]), -np.inf)
        for i, query in enumerate(query_ids[low : low + BATCH].tolist()):
            found = []
            # of a node's rows at most k + 1 count, the query's own among them
            for node in np.argsort(-scores[i], kind="stable").tolist():
                if nodes[i, node] < 0:
                    break
                score = float(scores[i, node])
                if len(found) > k and score < found[k][0]:
                    break
                at = nodes[i, node]
                found += [(score, row) for row in ids[ends[at] : min(ends[at + 1], ends[at] + k + 1)].tolist() if row != query]
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            out.append((query, [r for _, r in found], [s for s, _ in found]))
    return out


def nearest(embeddings: DataFrame, queries_where, k: int = 20, rows_per_shard: int = shards.ROWS_PER_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that `queries_where` chooses, their k nearest others found."""
    rows, n = shards.sharded(written(shards.taking_part(embeddings, zeros=False), "vectors"), rows_per_shard)
    index = written(shards.indexed(rows, build), "graphs")
    queries = rows.where(queries_where).select("vec_id", "vector", "dim", F.lit(0).alias("floor"))
    every_shard = F.sequence(F.lit(0), F.lit(n - 1))
    found = shards.searched(index, shards.in_blocks(queries, every_shard), lambda *a: search(*a, k), "double")
    return shards.best(found, k)
