"""Payment operations report."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.labels import label
from ..functions.money import (
    count_when,
    or_zero,
    percent,
    ratio,
    round_half_up,
    round_toward_plus,
    usd_sum,
)
from .marts import newest_first, settled


def success_trend(rates, n=60, counts=False):
    """Latest n day-source success rates in percent, with the counts behind them if told so."""
    return (
        rates.orderBy(*newest_first("occurred_date", "source"))
        .limit(n)
        .select(
            F.col("occurred_date").alias("date"),
            "source",
            round_half_up(F.col("success_rate") * 100.0, 1).alias("rate"),
            *(["succeeded_count", "total_transactions"] if counts else []),
        )
    )


def success_pivot(trend, sources=fv.SOURCES):
    """Date by source matrix of rates, NULL where a source has none.

    ``other`` is the rate of all sources not listed together; a trend without counts gives their best rate.
    """
    column = F.when(F.col("source").isin(*sources), F.col("source")).otherwise("other")
    pivot = trend.withColumn("_column", column).groupBy("date").pivot("_column", [*sources, "other"])
    if "total_transactions" not in trend.columns:
        return pivot.agg(F.max("rate")).orderBy("date")
    good, total = F.sum("succeeded_count"), F.sum("total_transactions")
    return pivot.agg(round_half_up(ratio(good, total) * 100.0, 1)).orderBy("date")


def decline_counts(analysis):
    """Every decline code with its count."""
    return analysis.select(F.coalesce("decline_code", F.lit("unknown")).alias("code"), F.col("total_declines").alias("count"))


def top_declines(analysis, k=10):
    return decline_counts(analysis.orderBy(F.col("total_declines").desc(), "decline_code").limit(k))


def advisor_rows(predictions, min_probability=0, code=None):
    """Every scored decline above a percentage and of one decline code."""
    rows = predictions.select(
        "transaction_id",
        "decline_code",
        F.col("card_brand").alias("brand"),
        F.col("card_funding").alias("funding"),
        or_zero(round_half_up("amount_usd", 2)).alias("amount_usd"),
        or_zero(round_half_up(F.col("retry_success_probability") * 100.0, 1)).alias("probability"),
        F.col("recommended_action").alias("action"),
        or_zero(round_half_up("expected_recovery_usd", 2)).alias("recovery_usd"),
    )
    if min_probability > 0:
        rows = rows.filter(F.col("probability") >= min_probability)
    if code is not None:
        plain = F.replace(F.lower("decline_code"), F.lit("_"), F.lit(" "))
        rows = rows.filter(plain == code.lower().replace("_", " "))
    return rows


def retry_advisor(predictions, min_probability=0, code=None, n=20):
    """Scored declines by expected recovery, above a percentage and for one decline code.

    The code matches whatever its case and with spaces for underscores.
    """
    rows = advisor_rows(predictions, min_probability, code)
    return rows.orderBy(F.col("recovery_usd").desc(), "transaction_id").limit(n)


def retry_recovery_total(predictions, min_probability=0, code=None):
    """Expected recovery of all rows the advisor filter keeps."""
    return advisor_rows(predictions, min_probability, code).agg(
        F.count(F.lit(1)).alias("retries"),
        or_zero(round_half_up(F.sum("recovery_usd"), 2)).alias("total_recovery_usd"),
    )


def dispute_list(disputes, n=20):
    return (
        disputes.orderBy(*newest_first("dispute_created_at", "transaction_id"))
        .limit(n)
        .select(
            "dispute_id",
            "transaction_id",
            "customer_id",
            or_zero(round_half_up("amount_usd", 2)).alias("amount_usd"),
            F.col("dispute_status").alias("status"),
            F.col("dispute_created_at").alias("created_at"),
            "due_by",
        )
    )


def transaction_monitoring(ledger):
    """Rows, volume, rows per status and settled share."""
    return ledger.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        or_zero(round_half_up(usd_sum("amount"), 2)).alias("total_volume_usd"),
        *[
            count_when(F.col("status") == s).alias(f"{s}_count")
            for s in ("succeeded", "failed", "pending", "disputed")
        ],
    ).withColumn("overall_success_rate", percent("succeeded_count", "total_transactions"))


def gateway_metrics(ledger):
    """Count, settled share, volume and health of each source."""
    sums = ledger.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        percent(count_when(settled()), F.count(F.lit(1))).alias("success_rate"),
        or_zero(round_half_up(usd_sum("amount"), 2)).alias("volume_usd"),
    )
    healthy = F.col("success_rate") >= fv.GATEWAY_HEALTHY_PCT
    return sums.select(
        "source",
        label("gateway", "source").alias("name"),
        "total_transactions",
        "success_rate",
        "volume_usd",
        F.when(healthy, "Optimal").otherwise("Degraded").alias("health_status"),
    ).orderBy(F.col("total_transactions").desc(), "source")


def risk_counts(ledger):
    """Rows per risk level; a missing level is normal."""
    level = F.coalesce("risk_level", F.lit("normal"))
    return ledger.agg(
        count_when(level == "normal").alias("normal_count"),
        count_when(level == "elevated").alias("elevated_risk_count"),
        count_when(level == "highest").alias("highest_risk_count"),
    )


def dispute_rate_bps(monitoring):
    """Disputed rows per ten thousand settled ones."""
    base = F.greatest(F.col("succeeded_count"), F.lit(1))
    return monitoring.select(
        round_half_up(ratio("disputed_count", base) * 10000.0, 1).alias("dispute_rate_bps")
    )


def dispute_outcomes(disputes):
    """Disputes won, lost and open, the amount in dispute, and the win rate when any closed."""
    sums = disputes.agg(
        count_when(F.col("dispute_status") == "won").alias("disputes_won_count"),
        count_when(F.col("dispute_status") == "lost").alias("disputes_lost_count"),
        count_when(F.col("dispute_status").startswith("warning")).alias("active_disputes_count"),
        or_zero(round_half_up(F.sum("amount_usd"), 2)).alias("total_dispute_amount_usd"),
    )
    won = F.col("disputes_won_count")
    closed = won + F.col("disputes_lost_count")
    return sums.withColumn("win_rate_pct", round_half_up(ratio(won, closed) * 100.0, 1))


def retry_summary(predictions):
    """Scored declines: count, expected recovery, confident ones, mean probability."""
    p = F.col("retry_success_probability")
    return predictions.agg(
        F.count(F.lit(1)).alias("scored_declines"),
        or_zero(round_half_up(F.sum("expected_recovery_usd"), 2)).alias("smart_retry_recovery_usd"),
        count_when(p >= 0.7).alias("high_confidence_retries_count"),
        round_half_up(F.avg(p) * 100.0, 1).alias("avg_retry_probability_pct"),
    )


def ops_kpis(declines, trend, advisor, disputes):
    """Headline figures over all declines, scored retries and open disputes, and over the rates of the trend."""
    scored = advisor.agg(
        or_zero(round_toward_plus(F.sum("recovery_usd"), 2)).alias("recovery"),
        count_when(F.col("probability") >= 70).alias("confident"),
    )
    open_disputes = disputes.agg(
        F.count(F.lit(1)).alias("count"), or_zero(round_toward_plus(F.sum("amount_usd"), 2)).alias("amount")
    )
    rate = trend.agg(round_toward_plus(F.round(F.avg(F.col("rate").cast("decimal(12,1)")), 6).cast("double"), 1).alias("rate"))
    ranked = declines.orderBy(F.col("count").desc(), "code").limit(1).select("code")
    return declines.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_declines")).select(
        "total_declines",
        F.coalesce(F.translate(ranked.scalar(), "_", " "), F.lit("None")).alias("top_decline_code"),
        or_zero(rate.scalar()).alias("avg_success_rate"),
        scored.select("recovery").scalar().alias("potential_recovery_usd"),
        scored.select("confident").scalar().alias("high_confidence_retry_count"),
        open_disputes.select("count").scalar().alias("active_disputes_count"),
        open_disputes.select("amount").scalar().alias("total_dispute_amount"),
    )
