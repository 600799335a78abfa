"""Boosted quantiles against constant offsets, and leaf values against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashlens.operators import quantiles, trees

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    a, b = draw.uniform(0, 1, (2, 1200))
    # the spread hangs on a, the middle on b
    y = 4 * b + (0.2 + 6 * a) * draw.normal(size=1200)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i])) for i in range(1200)], "id long, a double, b double, y double")


def test_beats_constant_offsets_where_the_spread_varies(rows):
    train, rest = rows.filter("id < 800"), rows.filter("id >= 800")
    held, unseen = rest.filter("id < 900"), rest.filter("id >= 900")
    y = F.col("y")
    for alpha in (0.1, 0.9):
        nodes = quantiles.fit_quantile(train, held, COLUMNS, "y", alpha, rounds=8)
        assert nodes.columns == [f.split()[0] for f in trees.NODES.split(", ")]
        # the best that one offset for all rows can do beside the true middle
        offset = train.agg(F.percentile(y - 4 * F.col("b"), alpha)).first()[0]
        got = unseen.agg(
            F.avg(quantiles.pinball(y, trees.margin(nodes), alpha)).alias("trees"),
            F.avg(quantiles.pinball(y, 4 * F.col("b") + offset, alpha)).alias("constant"),
            F.avg((y < trees.margin(nodes)).cast("double")).alias("below"),
        ).first()
        assert got.trees < got.constant and abs(got.below - alpha) < 0.07, (alpha, got)


def test_leaf_values_are_quantiles_of_their_rows(spark, rows):
    nodes = [
        trees.node(0, 0, "a", 0.5, 1, 2), trees.node(0, 1, value=0.0), trees.node(0, 2, "b", 0.3, 3, 4),
        trees.node(0, 3, value=0.0), trees.node(0, 4, value=0.0), trees.node(7, 0, value=0.0),
    ]
    plain = {}
    for r in rows.collect():
        leaf = 1 if r.a <= 0.5 else 3 if r.b <= 0.3 else 4
        plain.setdefault((0, leaf), []).append(r.y)
        plain.setdefault((7, 0), []).append(r.y)
    got = {(r.tree, r.node): (r.rows, r.value) for r in quantiles.leaf_quantiles(rows, nodes, F.col("y"), 0.1).collect()}
    assert {k: (len(v), pytest.approx(np.quantile(v, 0.1))) for k, v in plain.items()} == got
    odd = rows.limit(0).unionByName(spark.createDataFrame([(1, 0.1, 0.1, None)], rows.schema))
    assert quantiles.leaf_quantiles(odd, nodes, F.col("y"), 0.1).count() == 0


def test_odd_rows(spark, rows):
    with pytest.raises(ValueError):
        quantiles.fit_quantile(rows.limit(0), rows, COLUMNS, "y", 0.1)
    same = rows.withColumn("y", F.lit(3.0)).filter("id < 60")
    nodes = quantiles.fit_quantile(same, same.limit(0), COLUMNS, "y", 0.9, rounds=2)
    assert [r[0] for r in same.select(trees.margin(nodes)).distinct().collect()] == [3.0]
