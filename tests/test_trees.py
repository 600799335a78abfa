"""Fitted trees as a table against Spark ML's own predictions and importances."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cashlens.operators import models, trees

COLUMNS = ["a", "b", "c", "never"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0
    frame = spark.range(900).select("id", draw(1).alias("a"), draw(2).alias("b"), (draw(3) * 5).cast("int").alias("c"), F.lit(1.0).alias("never"))
    return frame.withColumn("y", 3 * F.col("a") - F.col("b") * F.col("c")).withColumn("target", (F.col("y") > 0.2).cast("int"))


def fit(rows, stage):
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), stage]).fit(rows)


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_table_scores_like_the_fitted_model(spark, rows, kind):
    if kind == "regression":
        model = fit(rows, GBTRegressor(labelCol="y", maxIter=5, maxDepth=4, seed=1))
    else:
        model = fit(rows, GBTClassifier(labelCol="target", maxIter=5, maxDepth=4, seed=1))
    nodes = trees.tree_table(spark, model, COLUMNS)
    assert nodes.columns == [f.split()[0] for f in trees.NODES.split(", ")]
    if kind == "regression":
        want = {r.id: r.prediction for r in model.transform(rows).collect()}
        got = rows.select("id", trees.margin(nodes).alias("p"))
    else:
        want = {r.id: r.probability for r in models.with_probability(model, rows).collect()}
        got = rows.select("id", trees.probability(trees.margin(nodes)).alias("p"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.p for r in got.collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want) and len(set(want.values())) > 20
    weights = dict(zip(COLUMNS, model.stages[-1].featureImportances.toArray().tolist()))
    found = {r.feature: r.importance for r in trees.importance(nodes).collect()}
    assert all(found.get(c, 0.0) == pytest.approx(weights[c], abs=1e-9) for c in COLUMNS)
    top = models.feature_importance(spark, model, COLUMNS, 3).collect()
    assert [r.feature for r in top] == sorted(COLUMNS, key=lambda c: (-weights[c], c))[:3]


def test_counts_of_nodes(spark, rows):
    model = fit(rows, GBTRegressor(labelCol="y", maxIter=2, maxDepth=3, seed=1))
    nodes = trees.tree_table(spark, model, COLUMNS)
    got = {(r.tree, r.node): r.rows for r in trees.node_counts(rows, nodes).collect()}
    want = {(r.tree, r.node): r.rows for r in nodes.collect()}
    assert got == want and got[0, 0] == 900
    assert trees.node_counts(rows, nodes.limit(0)).count() == 0


def test_a_tree_without_splits(spark, rows):
    model = fit(rows.withColumn("y", F.lit(2.0)), GBTRegressor(labelCol="y", maxIter=1, seed=1))
    nodes = trees.tree_table(spark, model, COLUMNS)
    assert rows.select(trees.margin(nodes).alias("p")).distinct().collect()[0].p == 2.0
    assert trees.importance(nodes).count() == 0
