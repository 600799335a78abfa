"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashlens.llm import ann, balltree, shards


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, dim string, score double")


def vectors(n, dim=24, seed=0, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)


def exact(rows, queries, k, change=lambda x: x):
    ids = np.array([i for i, _ in rows])
    x = change(np.array([v for _, v in rows], np.float64))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = shards.products(x, x[at])
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


ODD = [
    (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]),
    (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [-1.0, 0.5]), (10, [-1.0, 0.5]), (None, [1.0, 1.0]),
]


def test_graph_search_recall(spark):
    x = vectors(3000)
    x[100:1100] = x[100]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [i for i, _ in rows if i % 20 == 0]
    got = found(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, rows_per_shard=1500))
    want = exact(rows, queries, 20)
    assert all(len(got[q]) == 20 for q in queries)
    hits = sum(s >= want[q][-1][1] - 1e-12 for q in queries for _, s in got[q])
    assert hits / (20 * len(queries)) >= 0.95
    score = {(q, i): s for q in queries for i, s in exact(rows, [q], len(rows))[q]} if len(queries) < 5 else None
    assert score is None
    # equal scores go to the smaller ids
    copies = [i for i, _ in got[100]]
    assert copies == [i for i, _ in want[100]]


def test_graph_edges_are_diverse():
    x = vectors(600, clusters=1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = ann.robust_prune(unit, np.arange(5), np.tile(np.arange(600), (5, 1)), 16, 1.2)
    far = lambda a, b: np.linalg.norm(unit[a] - unit[b])
    for p, row in enumerate(chosen):
        row = row[row >= 0]
        for i, b in enumerate(row):
            assert all(1.2 * far(a, b) > far(p, b) - 1e-5 for a in row[:i])


@pytest.mark.parametrize(("operator", "k", "zeros", "change"), [(ann.nearest, 20, False, lambda x: x), (balltree.top_k, 5, True, balltree.quantised)])
def test_odd_vectors(spark, operator, k, zeros, change):
    got = found(operator(frame(spark, ODD), F.lit(True), k))
    two = [(i, v) for i, v in ODD if i in (0, 6, 7, 10) or (zeros and i == 5)]
    two = list({i: (i, v) for i, v in two}.values())
    want = exact(two, [i for i, _ in two], k, change)
    assert {q: g for q, g in got.items() if q != 8} == want
    assert 8 not in got  # nothing else has its length
    assert operator(frame(spark, ODD).limit(0), F.lit(True), k).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_ball_tree_is_exact(spark, scale):
    x = np.round(vectors(2000, dim=6, seed=3), 1) * np.float32(scale)  # many equal scores
    x[500:1200] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(balltree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, rows_per_shard=600))
    ids = np.arange(len(rows))
    q = np.floor(256.0 * x.astype(np.float64)).astype(np.int64)
    for query in range(0, 2000, 50):
        scores = q @ q[query]
        order = sorted((i for i in ids if i != query), key=lambda i: (-scores[i], i))[:5]
        assert got[query] == [(int(i), int(scores[i])) for i in order]


def test_graph_search_gives_more_neighbours_than_its_beam():
    rows = np.random.default_rng(9).standard_normal((1000, 16))
    index = ann.build(np.arange(1000), rows)
    for query, ids, _ in ann.search(index, np.arange(5), rows[:5], None, 200):
        want = [i for i in np.argsort(-(rows @ rows[query])).tolist() if i != query][:200]
        assert len(ids) == 200 and len(set(ids) & set(want)) > 190


def test_blocks_and_indexes_are_never_broadcast(spark, tmp_path):
    """Small by Spark's estimate, but a block is copied for each shard: nothing of the search goes through the driver."""
    rows, n = shards.sharded(shards.taking_part(frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors(600))]), zeros=True), 100)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    shards.indexed(rows, balltree.build).write.parquet(str(tmp_path / "trees"))
    index = spark.read.parquet(str(tmp_path / "trees"))
    queries = rows.where("vec_id % 50 = 0").withColumn("floor", F.lit(balltree.NONE))
    for asked, where in ((queries, None), (queries.drop("shard"), F.sequence(F.lit(0), F.lit(n - 1)))):
        found = shards.searched(index, shards.in_blocks(asked, where), lambda *a: balltree.search(*a, 5), "long")
        assert len(found.collect()) == (12 if where is None else 12 * n)
        plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran, in adaptive execution too
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
