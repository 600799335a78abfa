"""End-to-end batch jobs over written tables."""

import json

from pyspark.sql import functions as F

from .operators import marts, models, quality, recon
from .operators.merge import mark_removed_path, upsert_ledger_path, upsert_table
from .session import written
from .sources import feeds, quarantine
from .sources.ledger import quarantine_path, read_ledger


def ingest_processor_events(spark, events_path, ledger_path, account_id, start, end, batch="latest"):
    """Landed processor events of a time range into the ledger; returns how many rows could not be read.

    Those are kept under the ledger's log, by the name of the batch.
    """
    rows = feeds.processor_event_lines(spark, events_path, start, end)
    aside = quarantine.keep_broken(rows, quarantine_path(ledger_path, "events"), batch)
    events = quarantine.readable(rows).withColumn("event_created", F.col("created"))
    rows = feeds.normalize_processor(events, account_id, keep=("event_created",))
    upsert_ledger_path(spark, ledger_path, rows, order_by=("event_created", "occurred_at"))
    return aside


def ingest_bank_sync(spark, pages_path, ledger_path, batch="latest"):
    """Landed bank sync pages into the ledger; returns how many pages and rows could not be read.

    Those are kept under the ledger's log, by the name of the batch.
    """
    rows = feeds.bank_sync_lines(spark, pages_path)
    aside = quarantine.keep_broken(rows, quarantine_path(ledger_path, "bank"), batch)
    upsert_ledger_path(spark, ledger_path, feeds.normalize_bank(quarantine.readable(rows)))
    return aside


def remove_bank_rows(spark, ids, ledger_path):
    """Mark bank rows removed by their feed ids (column transaction_id)."""
    mark_removed_path(spark, ledger_path, ids)


def reconcile(spark, ledger_path, as_of, days=7, shown=20):
    """Nightly reconciliation: summary, largest discrepancies, and ledger audits."""
    ledger = read_ledger(spark, ledger_path)
    payouts = written(recon.payout_candidates(ledger, as_of, days), "payouts")
    deposits = written(recon.deposit_candidates(ledger, as_of, days), "deposits")
    return {
        "summary": recon.recon_summary(payouts, deposits),
        "discrepancies": recon.recon_discrepancies(payouts, deposits, n=shown),
        "duplicate_keys": recon.duplicate_keys(ledger),
        "missing_posted": recon.missing_posted(ledger),
        "basis": recon.basis_check(ledger, as_of),
    }


def health(ledger, customers, merchants, forecast, as_of):
    """Freshness and size checks."""
    tables = {"transactions": ledger, "customers": customers, "merchants": merchants}
    return {
        "freshness": quality.freshness(ledger, as_of),
        "row_counts": quality.row_count_checks(tables, {"transactions": 100, "customers": 10, "merchants": 1}),
        "forecast": quality.forecast_freshness(forecast, as_of),
    }


def train_forecast(spark, ledger_path, model_path, as_of, version, days=365, registry_path=None):
    """Fit and save the cash forecast, register it; returns the fitted model and its registry row."""
    frame = models.training_frame(read_ledger(spark, ledger_path), as_of, days)
    fitted = models.fit_quantiles(frame)
    details = json.dumps(fitted.metrics)
    trained = spark.range(1).select(feeds.utc_now()).first()[0]
    row = models.save_model(
        spark, fitted.model, model_path, "cash_forecast", version, fitted.columns, models.FLOW_TARGET, details, trained
    )
    models.save_forecast(spark, fitted, model_path)
    return fitted, models.registered(row, registry_path) if registry_path else row


def predict_cash(spark, fitted, ledger_path, forecast_path, as_of, version, horizon=91):
    """Forecast rows from the newest day, merged into the forecast table by date pair.

    ``fitted`` is a forecast or the path of a saved one.
    """
    if isinstance(fitted, str):
        fitted = models.load_forecast(spark, fitted)
    ledger = read_ledger(spark, ledger_path)
    daily = written(marts.daily_cash_position(ledger), "daily")
    rows = models.forecast_cash(fitted, ledger, daily, horizon, as_of, version)
    upsert_table(spark, forecast_path, rows, ["forecast_date", "prediction_date"], ["forecast_date"], order_by=())


def train_and_score_retries(spark, ledger_path, predictions_path, model_path, as_of, version, n=100, days=180, registry_path=None):
    """Fit and save the retry model, then score the latest declines into the prediction table."""
    ledger = read_ledger(spark, ledger_path)
    model, held = models.fit_retry(models.retry_frame(ledger, as_of, days))
    metrics = json.dumps(models.classifier_metrics(held).first().asDict())
    trained = spark.range(1).select(feeds.utc_now()).first()[0]
    row = models.save_model(
        spark, model, model_path, "decline_retry", version, models.FEATURES, "target", metrics, trained
    )
    scored = models.score_declines(model, ledger, as_of, n, version, keep=("occurred_at",))
    # the month of the decline never changes for a transaction, and a run touches the latest months only
    scored = scored.withColumn("decline_month", F.date_format("occurred_at", "yyyy-MM")).drop("occurred_at")
    upsert_table(spark, predictions_path, scored, ["transaction_id"], ["decline_month"], order_by=("scored_at",))
    return models.registered(row, registry_path) if registry_path else row
