"""Packed products and hard negatives against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashlens.llm import negatives
from cashlens.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, label int, dim string, q int, shard long, wants string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y") for i, v, label in rows], KIND)


def plain(rows, is_anchor, k=5, n=10):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        good[i] = min(good.get(i, (v, label)), (v, label))
    q = {i: ([int(np.floor(256.0 * x)) for x in v], label) for i, (v, label) in good.items()}
    out = []
    for a in sorted(i for i in q if is_anchor(i)):
        scored = sorted(
            (-sum(x * y for x, y in zip(q[a][0], q[b][0])), b) for b in q if b != a and len(q[b][0]) == len(q[a][0])
        )
        for minus, p in [x for x in scored if q[x[1]][1] == q[a][1]][:k]:
            fit = [x for x in scored if q[x[1]][1] != q[a][1] and 30 * -minus <= 100 * -x[0] <= 90 * -minus]
            out += [(a, p, r, b, -minus, -score) for r, (score, b) in enumerate(fit[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("largest", [1, 40, 256, 5_000, 1 << 20, 1 << 30, 1 << 33])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    rows = rng.integers(-largest, largest + 1, (53, 24))
    rows[0], rows[1] = largest, -largest
    packed = negatives.Packed(rows, largest)
    want = rows[:9].astype(object) @ rows.astype(object).T
    assert (packed.products(rows[:9]).astype(object) == want).all()
    assert packed.wide or packed.fields * packed.bits <= 64


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_against_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(6, 8))[rng.integers(0, 6, 700)] + 0.7 * rng.normal(size=(700, 8)), 1) * scale
    x[100:330] = x[100]  # a third of all rows is one vector
    label = np.where(rng.random(700) < 0.4, 3, rng.integers(0, 10, 700))
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(700)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, rows_per_shard=200)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1),
        (5, [0.0, 0.0], 1), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 1), (8, [1.0, 2.0, 3.0], 2), (9, [], 1), (None, [1.0, 2.0], 2),
        (10, [0.5, 1.0], 2), (10, [0.5, 1.0], 2), (11, [0.5, 1.0], 4), (12, [-1.0, -2.0], 5), (13, [-0.5, -1.0], 5),
        (14, [0.0, 0.0], 3), (15, [4.0, -2.0], 1), (16, [9.0, 9.0], 7),
    ]
    got = negatives.hard_negatives(frame(spark, rows), F.lit(True))
    want = plain(rows, lambda i: True)
    assert sorted(map(tuple, got.collect())) == want and any(r[4] == 0 for r in want)
    assert negatives.hard_negatives(frame(spark, rows[:0] or rows).limit(0), F.lit(True)).count() == 0


def test_query_moves_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in docs if r.label is not None]
    got = QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 100 == 0)
