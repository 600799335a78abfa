"""Fitted tree ensembles as a table: scores, node counts and importance without the fitted object.

A row is a node: tree, node, feature, threshold, left_node, right_node, value, gain, weight. Rows whose feature is at
most the threshold go left; a leaf has no feature. The table has a few nodes for each boosting round, whatever
the data size, so it becomes an expression: scoring needs neither a shuffle nor the library that fitted the trees.
"""

import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..session import shared_dir

NODES = (
    "tree int, node int, feature string, threshold double, left_node int, right_node int, value double, gain double, rows long, weight double"
)


def tree_table(spark, model, features):
    """The trees of a fitted pipeline whose last stage is a tree ensemble, or of such a stage."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    path = f"{shared_dir(spark)}/cashlens-trees-{uuid.uuid4().hex}"
    stage.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_metadata_json", "weight").select("tree", "weight")
    names = F.array(*[F.lit(c) for c in features])
    inner = F.col("nodeData.leftChild") >= 0
    only = lambda c: F.when(inner, F.col(c))
    return (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.when(inner, F.get(names, F.col("nodeData.split.featureIndex"))).alias("feature"),
            F.when(inner, F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
            only("nodeData.leftChild").alias("left_node"),
            only("nodeData.rightChild").alias("right_node"),
            F.col("nodeData.prediction").alias("value"),
            only("nodeData.gain").alias("gain"),
            F.col("nodeData.rawCount").alias("rows"),
        )
        .join(weights, "tree")
        .select("tree", "node", "feature", "threshold", "left_node", "right_node", "value", "gain", "rows", "weight")
    )


def node(tree, node, feature=None, threshold=None, left_node=None, right_node=None, value=None, gain=None, rows=None, weight=1.0):
    """A row of the table."""
    return Row(
        tree=tree, node=node, feature=feature, threshold=threshold, left_node=left_node, right_node=right_node, value=value,
        gain=gain, rows=rows, weight=weight,
    )


def _trees(nodes):
    """tree -> node -> row, of a table or a list; bounded by rounds and depth of the fit, not by data."""
    found = {}
    for row in nodes if isinstance(nodes, list) else nodes.collect():
        found.setdefault(row["tree"], {})[row["node"]] = row
    return dict(sorted(found.items()))


def _walk(tree, leaf, node=0, path=()):
    """One tree as an expression; ``leaf(row, path)`` gives the value of a leaf."""
    row, path = tree[node], (*path, node)
    if row["feature"] is None:
        return leaf(row, path)
    left = F.col(row["feature"]) <= F.lit(row["threshold"])
    return F.when(left, _walk(tree, leaf, row["left_node"], path)).otherwise(_walk(tree, leaf, row["right_node"], path))


def margin(nodes):
    """Weighted sum of the leaves that a row falls into, as a column over the features."""
    total = F.lit(0.0)
    for tree in _trees(nodes).values():
        total = total + F.lit(float(tree[0]["weight"])) * _walk(tree, lambda row, _: F.lit(float(row["value"])))
    return total


def leaves(nodes):
    """The leaf of each tree that a row falls into, as an array column of tree and node."""
    at = lambda t, n: F.struct(F.lit(t).alias("tree"), F.lit(n).alias("node"))
    return F.array(*[_walk(tree, lambda row, _, t=t: at(t, row["node"])) for t, tree in _trees(nodes).items()])


def probability(margin_):
    """Probability of the positive class of trees boosted on the logistic loss."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin_))


def node_counts(rows, nodes):
    """tree, node and how many of the rows come through it."""
    trees = _trees(nodes)
    if not trees:
        return nodes.select("tree", "node", F.lit(0).cast("long").alias("rows"))
    paths = [
        _walk(tree, lambda row, path, t=t: F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(n).alias("node")) for n in path]))
        for t, tree in trees.items()
    ]
    each = rows.select(F.explode(F.concat(*paths)).alias("at"))
    return each.groupBy(F.col("at.tree").alias("tree"), F.col("at.node").alias("node")).agg(F.count(F.lit(1)).alias("rows"))


def importance(nodes, per_tree=False):
    """feature, importance: gain times rows of the nodes that split on it, as shares; per tree first if told so."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    if per_tree:
        whole = gains.groupBy("tree").agg(F.sum("g").alias("all")).filter(F.col("all") > 0)
        gains = gains.join(whole, "tree").select("feature", (F.col("g") / F.col("all")).alias("g"))
    sums = gains.groupBy("feature").agg(F.sum("g").alias("g"))
    total = sums.agg(F.sum("g").alias("all"))
    return sums.select("feature", (F.col("g") / total.select("all").scalar()).alias("importance"))
