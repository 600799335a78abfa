"""Executive report."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import as_col, cents_sum, or_zero, percent, round_half_up, to_usd
from ..functions.rules import runway_status
from .marts import (
    as_date,
    latest,
    newest_first,
    occurred_since,
    oldest_first,
    revenue_type,
    settled,
)


def latest_value(df, order, column, *tie):
    """Value of a column in the newest row; an undated row counts as newest."""
    return df.select(order, column, *tie).orderBy(*newest_first(order, *tie)).limit(1).select(column)


def latest_cash(daily):
    """Running balance of the newest day."""
    newest = latest_value(daily, "date", "cumulative_cash_usd")
    return newest.select(round_half_up("cumulative_cash_usd", 2).alias("current_cash"))


def net_burn(daily, as_of, days=30):
    """Outflow per day since a number of days before the reference date (no upper bound)."""
    since = F.date_sub(as_date(as_of), days)
    return daily.filter(F.col("date") >= since).agg(
        or_zero(round_half_up(F.sum("outflows_usd") / float(days), 2)).alias("net_burn")
    )


def cash_trend(daily, n=30):
    """The last n active days, oldest first."""
    rows = daily.orderBy(*newest_first("date")).limit(n)
    return rows.select(
        "date",
        or_zero(round_half_up("cumulative_cash_usd", 2)).alias("cash"),
        or_zero(round_half_up("net_flow_usd", 2)).alias("net"),
        or_zero(round_half_up("inflows_usd", 2)).alias("inflows"),
        or_zero(round_half_up("outflows_usd", 2)).alias("outflows"),
    ).orderBy(oldest_first("date"))


def _profit_columns():
    zero = F.lit(0)
    paid_out = cents_sum("amount", F.col("type").isin("payout", "fee", "refund") & settled())
    return {
        "revenue": to_usd(F.coalesce(cents_sum("amount", revenue_type() & settled()), zero)),
        "expenses": to_usd(F.coalesce(paid_out, zero)),
        "fees": to_usd(F.coalesce(cents_sum("fee_amount", settled()), zero)),
        "net": to_usd(F.coalesce(cents_sum("net_amount", settled()), zero)),
    }


def financials_window(ledger, days=30):
    """Revenue, expenses, fees, net profit and margins of the last days of recorded data."""
    cutoff = latest(ledger, "occurred_at") - F.make_dt_interval(days=F.lit(days))
    sums = ledger.filter(occurred_since(cutoff)).agg(
        *[col.alias(name) for name, col in _profit_columns().items()]
    )
    profit = F.when(F.col("net") != 0, F.col("net")).otherwise(F.col("revenue") - F.col("expenses"))
    earned = F.when(F.col("revenue") > 0, F.col("revenue"))
    return sums.select(
        round_half_up("revenue", 2).alias("total_revenue"),
        round_half_up("expenses", 2).alias("total_expenses"),
        round_half_up("fees", 2).alias("total_fees"),
        round_half_up(profit, 2).alias("net_profit"),
        percent(F.col("revenue") - F.col("fees"), earned).alias("gross_margin_pct"),
        percent(profit, earned).alias("net_margin_pct"),
    )


def monthly_comparison(ledger, n=6):
    """Revenue, expenses, profit and margin of the last n months, oldest first."""
    columns = _profit_columns()
    month = F.date_format("occurred_at", "yyyy-MM").alias("month")
    months = (
        ledger.filter(F.col("occurred_at").isNotNull())
        .groupBy(month)
        .agg(*[columns[c].alias(c) for c in ("revenue", "expenses", "net")])
        .orderBy(F.col("month").desc())
        .limit(n)
    )
    revenue, net = round_half_up("revenue", 2), round_half_up("net", 2)
    return months.select(
        "month",
        revenue.alias("revenue"),
        round_half_up("expenses", 2).alias("expenses"),
        net.alias("net_profit"),
        percent(net, F.when(revenue > 0, revenue)).alias("margin_pct"),
    ).orderBy("month")


def mom_growth(monthly, value="revenue"):
    """Growth of the last month over the one before, 0 without a positive base."""
    before = F.lag(value).over(Window.orderBy("month"))
    growth = F.when(before > 0, (F.col(value) - before) / before * 100.0)
    return (
        monthly.select("month", growth.alias("growth"))
        .agg(F.max_by(F.struct("growth"), "month").alias("last"))
        .select(or_zero(round_half_up("last.growth", 1)).alias("mom_growth_pct"))
    )


def ar_risk(aging):
    total, overdue = F.sum("total_outstanding_usd"), F.sum("days_90_plus_usd")
    return aging.agg(or_zero(total).alias("total"), or_zero(overdue).alias("overdue")).select(
        round_half_up("total", 2).alias("total_outstanding_usd"),
        round_half_up("overdue", 2).alias("overdue_90plus_usd"),
        percent("overdue", F.when(F.col("total") > 0, F.col("total"))).alias("overdue_90plus_pct"),
    )


def dispute_exposure(disputes):
    return disputes.agg(
        F.count(F.lit(1)).alias("dispute_count"),
        or_zero(round_half_up(F.sum("amount_usd"), 2)).alias("dispute_amount_usd"),
    )


def executive_metrics(daily, forecast, rates, financials, risk):
    """One row of the four figures that alerts look at."""
    return financials.select(
        F.coalesce(latest_value(forecast, "forecast_date", "p50_runway_days", "prediction_date").scalar(), F.lit(0)).alias("runway_days"),
        "net_margin_pct",
        risk.select("overdue_90plus_pct").scalar().alias("overdue_90plus_pct"),
        or_zero(
            round_half_up(latest_value(rates, "occurred_date", "success_rate", "source").scalar() * 100.0, 1)
        ).alias("success_rate_pct"),
    )


def executive_alerts(metrics):
    """Four alert rows (id, type, title) from one row of figures."""
    runway, margin = F.col("runway_days"), F.col("net_margin_pct")
    kinds = {
        "runway": F.when(runway >= fv.RUNWAY_HEALTHY_DAYS, "positive")
        .when(runway >= fv.RUNWAY_MODERATE_DAYS, "warning")
        .otherwise("danger"),
        "profitability": F.when(margin >= fv.MARGIN_STRONG_PCT, "positive")
        .when(margin > 0, "info")
        .otherwise("warning"),
        "ar_overdue": F.when(F.col("overdue_90plus_pct") > fv.OVERDUE_LIMIT_PCT, "warning").otherwise(
            "positive"
        ),
        "gateway": F.when(F.col("success_rate_pct") >= fv.GATEWAY_OPTIMAL_PCT, "positive").otherwise(
            "warning"
        ),
    }
    alerts = []
    for alert, kind in kinds.items():
        title = None
        for name, text in fv.ALERT_TITLES[alert].items():
            title = F.when(kind == name, text) if title is None else title.when(kind == name, text)
        alerts.append(F.struct(F.lit(alert).alias("id"), kind.alias("type"), title.alias("title")))
    return metrics.select(F.inline(F.array(*alerts)))


def executive_kpis(trend, runway):
    """Change of cash over the trend, flow totals, runway class.

    ``runway`` is a one-column, at most one-row frame of days.
    """
    days = F.coalesce(as_col(runway.scalar()).cast("long"), F.lit(0).cast("long"))
    undated = F.col("date").isNull()
    key = F.struct(undated, F.col("date"))
    return trend.agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("cash", key).alias("last"),
        F.min_by("cash", key).alias("first"),
        F.max_by("net", key).alias("only"),
        or_zero(round_half_up(F.sum("inflows"), 2)).alias("total_inflows_30d"),
        or_zero(round_half_up(F.sum("outflows"), 2)).alias("total_outflows_30d"),
    ).select(
        or_zero(
            round_half_up(
                F.when(F.col("points") >= 2, F.col("last") - F.col("first")).otherwise(F.col("only")), 2
            )
        ).alias("net_30d_change"),
        "total_inflows_30d",
        "total_outflows_30d",
        days.alias("runway_days"),
        runway_status(days).alias("runway_status"),
    )
