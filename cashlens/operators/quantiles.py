"""Boosted trees for conditional quantiles (M8).

Each round grows a tree on the gradient of the pinball loss and then gives every leaf the quantile of the residuals
of its own rows. The fitted trees are a table of nodes (see ``trees``), a few for each round.
"""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ..session import written
from . import trees


def pinball(actual, predicted, alpha):
    """Loss of a predicted quantile, as a column."""
    error = actual - predicted
    return F.greatest(alpha * error, (alpha - 1.0) * error)


def leaf_quantiles(rows, nodes, residual, alpha):
    """tree, node, rows and value: the exact quantile of a column over the rows that end in each leaf.

    Rows whose column is NULL count for nothing. ``nodes`` hold one tree or several; a leaf without rows is left out.
    """
    each = rows.select(F.explode(trees.leaves(nodes)).alias("at"), residual.alias("residual")).filter("residual IS NOT NULL")
    return each.groupBy(F.col("at.tree").alias("tree"), F.col("at.node").alias("node")).agg(
        F.count(F.lit(1)).alias("rows"), F.percentile("residual", alpha).alias("value")
    )


def fit_quantile(rows, held, columns, label, alpha, rounds=8, depth=3, step=0.4, least_rows=20, seed=42):
    """Nodes of the trees whose sum is the ``alpha`` quantile of ``label``.

    Rows without a label are left out; a tree's leaf has at least ``least_rows`` of them. The rounds kept are those
    after which the loss of the ``held`` rows is least.
    """
    spark, y = rows.sparkSession, F.col(label)
    rows = written(rows.filter(y.isNotNull()).select(*columns, label), "quantile-rows")
    start = rows.agg(F.percentile(y, alpha).alias("value"), F.count(F.lit(1)).alias("rows")).first()
    if not start["rows"]:
        raise ValueError("no rows to fit a quantile on")
    found = [trees.node(0, 0, value=start["value"], rows=start["rows"], weight=1.0)]
    grower = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            RandomForestRegressor(
                labelCol="gradient", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=depth,
                minInstancesPerNode=least_rows, seed=seed,
            ),
        ]
    )
    for turn in range(1, rounds + 1):
        residual = y - trees.margin(found)
        graded = rows.withColumn("gradient", F.when(residual > 0, alpha).otherwise(alpha - 1.0))
        grown = trees.tree_table(spark, grower.fit(graded), columns).collect()
        values = {r["node"]: r["value"] for r in leaf_quantiles(rows, grown, residual, alpha).collect()}
        for r in grown:
            fields = r.asDict() | {"tree": turn, "weight": step}
            found.append(trees.node(**fields | {"value": values.get(r["node"], 0.0)}))
    totals = [[r for r in found if r["tree"] <= turn] for turn in range(rounds + 1)]
    losses = held.filter(y.isNotNull()).agg(
        *[F.avg(pinball(y, trees.margin(nodes), alpha)).alias(f"after_{turn}") for turn, nodes in enumerate(totals)]
    ).first()
    best = min(range(rounds + 1), key=lambda turn: rounds if losses[turn] is None else losses[turn])
    return spark.createDataFrame(totals[best if losses[best] is not None else rounds], trees.NODES)
