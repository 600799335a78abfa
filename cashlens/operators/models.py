"""Model fits on Spark ML (M8, M10, M21, M22, M24) and their registry rows."""

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import count_when, ratio
from ..schema import MODEL_REGISTRY
from ..session import written
from . import quantiles, trees
from .features import (
    current_cash,
    feature_columns,
    forecast_features,
    forecast_path,
    latest_features,
    require_rows,
    time_split,
    training_days,
    with_targets,
)
from .retry import FEATURES, encode_ordinals, recommend, retry_dataset, retry_features, scoring_rows

SEED = 42
# ranges of scores between 0 and 1 that are summed on their own
SCORE_RANGES = 1000
FLOW_TARGET = "target_net_flow_1d"
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def training_frame(ledger, as_of, days=365):
    """Feature rows with targets; at least 60 days of data."""
    return with_targets(forecast_features(require_rows(training_days(ledger, as_of, days), 60)))


class QuantileForecast:
    """Median model and the trees of the outer quantiles, ordered so that P10 <= P50 <= P90 always holds."""

    def __init__(self, model, columns, outer, metrics):
        self.model, self.columns, self.outer, self.metrics = model, columns, outer, metrics

    def predict(self, rows):
        """Rows with p10, p50 and p90 columns."""
        middle = F.col("prediction")
        return self.model.transform(rows).withColumns(
            {
                "p10": F.least(trees.margin(self.outer["p10"]), middle),
                "p50": middle,
                "p90": F.greatest(trees.margin(self.outer["p90"]), middle),
            }
        ).drop("features", "prediction")


def fit_quantiles(frame, validation_rows=30, max_iter=30, rounds=8):
    """P10/P50/P90 of next-day net flow.

    The median is a boosted-tree fit of the absolute error, the outer quantiles are boosted on the pinball loss
    (see ``quantiles``). The newest rows validate; each boosting ends where they no longer gain.
    """
    columns = feature_columns(frame)
    split = time_split(written(frame, "forecast-training"), "posted_date", last=validation_rows)
    train, held = (split.filter(F.col("split") == part).drop("split") for part in ("train", "validate"))
    stages = [
        VectorAssembler(inputCols=columns, outputCol="features"),
        GBTRegressor(
            labelCol=FLOW_TARGET, lossType="absolute", maxIter=max_iter, maxDepth=4, stepSize=0.1, seed=SEED,
            validationIndicatorCol="stops",
        ),
    ]
    model = Pipeline(stages=stages).fit(split.withColumn("stops", F.col("split") == "validate"))
    outer = {
        q: quantiles.fit_quantile(train, held, columns, FLOW_TARGET, QUANTILES[q], rounds, seed=SEED) for q in ("p10", "p90")
    }
    fitted = QuantileForecast(model, columns, outer, {})
    scored, actual = fitted.predict(held), F.col(FLOW_TARGET)
    row = scored.agg(
        *[F.avg(F.abs(actual - F.col(q))).alias(f"{q}_mae") for q in QUANTILES],
        *[F.avg(quantiles.pinball(actual, F.col(q), alpha)).alias(f"{q}_pinball_loss") for q, alpha in QUANTILES.items()],
        F.avg(actual.between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"),
    ).first()
    fitted.metrics = row.asDict()
    return fitted


def feature_importance(spark, model, columns, k=15):
    """The k most important features of a fitted tree pipeline, from the gains of its nodes."""
    found = trees.importance(trees.tree_table(spark, model, columns))
    every = spark.createDataFrame([(c,) for c in columns], "feature string")
    rows = every.join(found, "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return rows.orderBy(F.col("importance").desc(), "feature").limit(k)


def forecast_cash(fitted, ledger, daily, horizon=91, forecast_date=None, version="v1"):
    """Forecast rows from the newest complete day."""
    newest = fitted.predict(latest_features(ledger))
    start = newest.select("posted_date", "cumulative_cash_usd", "p10", "p50", "p90")
    point = current_cash(daily, start).select("*", *[start.select(q).scalar().alias(q) for q in ("p10", "p50", "p90")])
    return forecast_path(point, horizon, forecast_date, version)


def retry_frame(ledger, as_of, days=180):
    """Training rows of the retry model; at least 30 declines."""
    rows = require_rows(retry_dataset(ledger, as_of, days), 30)
    return retry_features(encode_ordinals(rows), mode="training")


def fit_retry(frame, max_iter=20):
    """Class-weighted boosted trees for success within seven days; the last fifth validates and ends the boosting."""
    split = time_split(frame, "occurred_at", "transaction_id", frac=0.8)
    train = split.filter(F.col("split") == "train")
    counts = train.agg(count_when(F.col("target") == 0).alias("neg"), count_when(F.col("target") == 1).alias("pos")).first()
    weight = counts["neg"] / max(counts["pos"], 1)
    weighted = split.withColumns(
        {
            "weight": F.when(F.col("target") == 1, F.lit(float(weight))).otherwise(1.0),
            "stops": F.col("split") == "validate",
        }
    )
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        GBTClassifier(labelCol="target", weightCol="weight", maxIter=max_iter, maxDepth=4, stepSize=0.1, seed=SEED, validationIndicatorCol="stops"),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    return model, with_probability(model, split.filter(F.col("split") == "validate"))


def with_probability(model, rows):
    scored = model.transform(rows)
    return scored.withColumn("p_success", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "prediction", "probability"
    ).withColumnRenamed("p_success", "probability")


def classifier_metrics(scored, label="target"):
    """Area under the ROC curve, average precision, and the report of both classes at 0.5, in one row.

    Both areas are exact: rows shrink to one per score, and what lies below a score is the sum of the
    lower ranges of scores and of its own range. No task sorts more than a range.
    """
    scored = written(scored.select(label, "probability"), "scored")
    real, p = F.col(label) == 1, F.col("probability")
    scores = scored.groupBy(p.alias("p")).agg(count_when(real).alias("pos"), count_when(~real).alias("neg"))
    scores = scores.withColumn("range", F.floor(F.col("p") * SCORE_RANGES))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scores.groupBy("range").agg(F.sum("pos").alias("pos_in"), F.sum("neg").alias("neg_in"))
    ranges = ranges.select(
        F.col("range"), *[F.coalesce(F.sum(f"{c}_in").over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")]
    )
    here = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    below = [(F.col(f"{c}_before") + F.sum(c).over(here) - F.col(c)).alias(f"{c}_below") for c in ("pos", "neg")]
    placed = scores.join(ranges, "range").select("pos", "neg", *below)
    totals = scores.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    all_pos, all_neg = totals.select("all_pos").scalar(), totals.select("all_neg").scalar()
    pos, neg = F.col("pos"), F.col("neg")
    pos_from, neg_from = all_pos - F.col("pos_below"), all_neg - F.col("neg_below")
    areas = placed.agg(
        ratio(F.sum(2 * pos * F.col("neg_below") + pos * neg), 2 * F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        F.round(ratio(F.sum(pos * ratio(pos_from, pos_from + neg_from)), F.sum(pos)), 6).alias("pr_auc"),
    )
    report = []
    for c, said, is_ in ((0, p < 0.5, ~real), (1, p >= 0.5, real)):
        hit, told, there = count_when(said & is_), count_when(said), count_when(is_)
        report += [
            ratio(hit, told).alias(f"precision_{c}"), ratio(hit, there).alias(f"recall_{c}"),
            ratio(2 * hit, told + there).alias(f"f1_{c}"), there.alias(f"support_{c}"),
        ]
    return scored.agg(*report).select(
        areas.select("roc_auc").scalar().alias("roc_auc"), areas.select("pr_auc").scalar().alias("pr_auc"), "*"
    )


def score_declines(model, ledger, scored_at, n=100, version="v1", keep=()):
    """Recommendations for the n latest declines, scored by the table of the model's trees.

    ``model`` is a fitted pipeline or such a table (see ``trees``).
    """
    rows = scoring_rows(ledger, n)
    nodes = model if isinstance(model, DataFrame) else trees.tree_table(ledger.sparkSession, model, FEATURES)
    return recommend(rows.withColumn("probability", trees.probability(trees.margin(nodes))), scored_at, version, keep)


def save_model(spark, model, path, name, version, columns, target, metrics_json, trained_at):
    """Save a fitted pipeline and return its registry row."""
    model.write().overwrite().save(path)
    row = [(name, version, path, metrics_json, trained_at, True, list(columns), target)]
    return spark.createDataFrame(row, MODEL_REGISTRY)


def load_model(path):
    return PipelineModel.load(path)


def save_forecast(spark, fitted, path):
    """Save all that a forecast needs: the pipeline, and beside it columns, metrics and the outer quantiles' trees."""
    fitted.model.write().overwrite().save(path)
    row = [(list(fitted.columns), json.dumps(fitted.metrics))]
    rows = spark.createDataFrame(row, "columns array<string>, metrics_json string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiles")
    for q, nodes in fitted.outer.items():
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/trees_{q}")


def load_forecast(spark, path):
    """The forecast that ``save_forecast`` saved, in any session."""
    row = spark.read.parquet(f"{path}/quantiles").first()
    outer = {q: spark.read.parquet(f"{path}/trees_{q}") for q in ("p10", "p90")}
    return QuantileForecast(load_model(path), row["columns"], outer, json.loads(row["metrics_json"]))


def registered(row, registry_path):
    """Append a registry row to the registry's table."""
    row.coalesce(1).write.mode("append").parquet(registry_path)
    return row
