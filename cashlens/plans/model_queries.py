"""Registered queries of models and streams."""

from pyspark.sql import functions as F

from ..operators import merge, models, retry
from ..sources import feeds
from ..sources.ledger import read_ledger, write_ledger
from ..streaming import streams
from . import inputs
from .inputs import daily
from .ledger_queries import OUTCOMES
from .registry import query


def _quantiles(w):
    return w.once("quantiles", lambda: models.fit_quantiles(models.training_frame(w.ledger, w.as_of)))


def _retry(w):
    frame = lambda: models.retry_frame(w.ledger, w.as_of, days=3650)
    return w.once("retry model", lambda: models.fit_retry(frame()))


@query("fit_quantiles")
def _fit_quantiles(w):
    """Validation metrics of the three quantiles."""
    metrics = _quantiles(w).metrics
    names = list(metrics)
    columns = [F.lit(float(metrics[n])).alias(n) for n in names]
    return daily(w).agg(F.count(F.lit(1)).alias("days")).select("days", *columns)


@query("feature_importance")
def _feature_importance(w):
    fitted = _quantiles(w)
    return models.feature_importance(w.spark, fitted.model, fitted.columns)


@query("forecast_cash")
def _forecast_cash(w):
    return models.forecast_cash(_quantiles(w), w.ledger, daily(w), forecast_date=w.as_of)


_SCORED = f"""SELECT p.retry_success_probability AS p, o.succeeded_on_retry AS y
    FROM predictions p JOIN ({OUTCOMES.format(declined="declined")}) o ON o.transaction_id = p.transaction_id"""


def _metrics_sql():
    names, parts = ("precision", "recall", "f1", "support"), []
    for c, said, is_ in ((0, "WHERE p < 0.5", "y = 0"), (1, "WHERE p >= 0.5", "y = 1")):
        hit, told, real = f"COUNT(*) FILTER ({said} AND {is_})", f"COUNT(*) FILTER ({said})", f"COUNT(*) FILTER (WHERE {is_})"
        share = lambda a, b: f"CAST({a} AS DOUBLE) / CAST(NULLIF({b}, 0) AS DOUBLE)"
        values = share(hit, told), share(hit, real), share(f"2 * {hit}", f"{told} + {real}"), real
        parts += [f"{v} AS {n}_{c}" for n, v in zip(names, values)]
    return f"""WITH s AS ({_SCORED}), g AS (SELECT p, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg
        FROM s GROUP BY p),
      c AS (SELECT *, SUM(neg) OVER (ORDER BY p) - neg AS neg_below, SUM(pos) OVER (ORDER BY p DESC) AS pos_from,
        SUM(pos + neg) OVER (ORDER BY p DESC) AS all_from FROM g)
    SELECT (SELECT CAST(SUM(2 * pos * neg_below + pos * neg) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) FROM c) AS roc_auc,
      (SELECT ROUND(SUM(CAST(pos AS DOUBLE) * CAST(pos_from AS DOUBLE) / CAST(all_from AS DOUBLE)) / CAST(SUM(pos) AS DOUBLE), 6) FROM c) AS pr_auc,
      {", ".join(parts)} FROM s"""


@query("classifier_metrics", _metrics_sql())
def _classifier_metrics(w):
    """Metrics of the derived predictions against what became of the declines."""
    outcomes = retry.retry_outcomes(retry.declined_events(w.ledger), w.ledger)
    scored = inputs.predictions(w).join(outcomes, "transaction_id").select(
        F.col("retry_success_probability").alias("probability"), F.col("succeeded_on_retry").alias("target")
    )
    return models.classifier_metrics(scored)


@query("fit_retry")
def _fit_retry(w):
    """Success probability of the validation declines."""
    return _retry(w)[1].select("transaction_id", "target", "probability")


@query("score_declines")
def _score_declines(w):
    return models.score_declines(_retry(w)[0], w.ledger, w.as_of)


# --- streams -------------------------------------------------------------------------------
def _events(w):
    path = inputs.landed(w, "processor_events", inputs.processor_events)
    return feeds.stream_processor_events(w.spark, path)


_MERGED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
      ORDER BY created DESC, occurred_at DESC, idempotency_key DESC) AS rank FROM normalized_events) WHERE rank = 1"""


@query(
    "stream_to_ledger",
    f"""SELECT transaction_id, idempotency_key, occurred_at, type, status, amount, net_amount, fee_amount, decline_code
    FROM ({_MERGED})""",
)
def _stream_to_ledger(w):
    path = w.scratch("stream_ledger")
    streams.stream_to_ledger(_events(w), path, w.scratch("ckpt")).awaitTermination()
    return read_ledger(w.spark, path).select(
        "transaction_id", "idempotency_key", "occurred_at", "type", "status", "amount", "net_amount", "fee_amount",
        "decline_code",
    )


@query(
    "stream_removals",
    """SELECT 'plaid_' || transaction_id AS transaction_id,
      CASE WHEN substr(transaction_id, 2) IN (SELECT CAST(user_id * 4 + i AS VARCHAR) FROM webhooks, range(1, 4) r(i)
        WHERE webhook_type = 'TRANSACTIONS' AND i <= n_removed) THEN 'removed' ELSE 'succeeded' END AS status
    FROM bank_rows WHERE NOT pending""",
)
def _stream_removals(w):
    path = w.scratch("bank_ledger")
    write_ledger(feeds.normalize_bank(feeds.bank_sync_rows(inputs.bank_pages(w))), path)
    landed = inputs.landed(w, "bank_webhooks", inputs.bank_webhooks)
    webhooks = streams.stream_bank_webhooks(w.spark, landed)
    streams.stream_removals(webhooks, path, w.scratch("ckpt")).awaitTermination()
    return read_ledger(w.spark, path).select("transaction_id", "status")


@query(
    "stream_hourly_counts",
    f"""SELECT start, start + INTERVAL 1 HOUR AS "end", source, status, COUNT(*) AS transactions
    FROM (SELECT time_bucket(INTERVAL 5 MINUTE, occurred_at, TIMESTAMP '1970-01-01') - to_minutes(5 * i) AS start,
        'stripe' AS source, status FROM ({_MERGED}), range(0, 12) r(i)) GROUP BY 1, 2, 3, 4""",
)
def _stream_hourly_counts(w):
    path, ledger = w.scratch("hourly"), w.scratch("hourly_ledger")
    streams.stream_hourly_counts(_events(w), ledger, path, w.scratch("ckpt")).awaitTermination()
    return w.spark.read.parquet(path).drop("day")


@query(
    "stream_daily_stats",
    f"""SELECT CAST(occurred_at AS DATE) AS day, COUNT(*) AS volume, CAST(SUM(amount) AS DOUBLE) / 100.0 AS total_usd,
      CAST(COUNT(*) FILTER (WHERE status = 'succeeded') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS success_rate
    FROM ({_MERGED}) GROUP BY 1""",
)
def _stream_daily_stats(w):
    path, ledger = w.scratch("stats"), w.scratch("stats_ledger")
    streams.stream_daily_stats(_events(w), ledger, path, w.scratch("ckpt")).awaitTermination()
    return w.spark.read.parquet(path).select("day", "volume", "total_usd", "success_rate")


@query(
    "followed_cash_position",
    """SELECT posted_date AS date, CAST(SUM(CASE WHEN net_amount > 0 THEN net_amount ELSE 0 END) AS DOUBLE) / 100.0 AS inflows_usd,
      CAST(SUM(CASE WHEN net_amount < 0 THEN -net_amount ELSE 0 END) AS DOUBLE) / 100.0 AS outflows_usd,
      CAST(SUM(net_amount) AS DOUBLE) / 100.0 AS net_flow_usd,
      CAST(SUM(SUM(net_amount)) OVER (ORDER BY posted_date ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100.0 AS cumulative_cash_usd
    FROM (SELECT posted_date, net_amount FROM ledger WHERE basis = 'cash' AND status = 'succeeded'
      UNION ALL SELECT occurred_date + 5, net_amount FROM ledger WHERE basis = 'cash' AND status = 'pending'
      UNION ALL SELECT posted_date, -amount FROM ledger WHERE basis = 'cash' AND status = 'disputed') GROUP BY posted_date""",
)
def _followed_cash_position(w):
    """The position of a ledger to which settlements and chargebacks came after its day sums were stored."""
    path, cash = w.copied_ledger("followed_ledger"), w.scratch("followed_cash")
    streams.follow_ledger(w.spark, path, cash, streams.CASH)
    merge.upsert_ledger_path(w.spark, path, inputs.ledger_updates(w))
    streams.follow_ledger(w.spark, path, cash, streams.CASH)
    return streams.cash_position(w.spark, cash)


@query(
    "upsert_ledger_path",
    """SELECT status, COUNT(*) AS row_count, CAST(SUM(net_amount) AS BIGINT) AS net, CAST(SUM(fee_amount) AS BIGINT) AS fee
    FROM (SELECT status, net_amount, fee_amount FROM ledger WHERE status <> 'pending'
      UNION ALL SELECT status, net_amount, fee_amount FROM updates WHERE batch_id IN ('settle', 'chargeback')) GROUP BY 1""",
)
def _upsert_ledger_path(w):
    path = w.copied_ledger("merged_ledger")
    merge.upsert_ledger_path(w.spark, path, inputs.ledger_updates(w))
    return (
        read_ledger(w.spark, path)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("net_amount").alias("net"), F.sum("fee_amount").alias("fee"))
    )
