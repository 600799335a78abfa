"""Live feed and counters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import count_when, or_zero, percent, ratio, round_half_up, usd_sum
from .marts import as_timestamp, latest, newest_first, newest_month, occurred_since, settled

FEED_COLUMNS = [
    "transaction_id",
    "occurred_at",
    "type",
    "status",
    "source",
    "amount_usd",
    "net_amount_usd",
    "fee_amount_usd",
    "currency",
    "product_line",
    "description",
    "decline_code",
    "ingested_at",
]


def recent_transactions(ledger, n=20):
    """The n rows ingested last."""
    return (
        ledger.select(*FEED_COLUMNS).orderBy(*newest_first("ingested_at", "transaction_id")).limit(n)
    )


def ledger_totals(ledger):
    return ledger.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.max("ingested_at").alias("last_ingested"),
    )


def latest_day_stats(ledger):
    """Count, volume and settled share of the newest event date; one row, zeros when empty."""
    rows = newest_month(ledger)
    day = rows.filter(F.col("occurred_date") == latest(ledger, "occurred_date"))
    total = F.count(F.lit(1))
    return day.agg(
        total.alias("volume"),
        or_zero(usd_sum("amount")).alias("total_usd"),
        or_zero(ratio(count_when(settled()), total)).alias("success_rate"),
    )


def by_source(ledger):
    """Rows per source, most first, and as a share of the busiest one."""
    counts = ledger.groupBy("source").agg(F.count(F.lit(1)).alias("transactions"))
    busiest = F.max("transactions").over(Window.partitionBy())
    return counts.select(
        "source", "transactions", percent("transactions", busiest).alias("share_of_max_pct")
    ).orderBy(F.col("transactions").desc(), "source")


def last_hour_counts(ledger, as_of):
    """Rows of the hour before the reference time and later, by source and status."""
    cutoff = as_timestamp(as_of) - F.expr("INTERVAL 1 HOUR")
    return (
        ledger.filter(occurred_since(cutoff))
        .groupBy("source", "status")
        .agg(F.count(F.lit(1)).alias("transactions"))
    )


def live_kpis(ledger):
    """Counters of the live page in one row; by_source maps each source to its count."""
    totals, day = ledger_totals(ledger), latest_day_stats(ledger)
    sources = by_source(ledger).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "transactions")))).alias("m")
    )
    return totals.select(
        "total_transactions",
        day.select("volume").scalar().alias("today_volume"),
        round_half_up(day.select("total_usd").scalar(), 2).alias("today_total_usd"),
        round_half_up(day.select("success_rate").scalar() * 100.0, 1).alias("live_success_rate"),
        "last_ingested",
        sources.scalar().alias("by_source"),
    )
