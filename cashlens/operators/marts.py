"""Analytics views over the ledger (V1-V8)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import cents_sum, count_when, to_usd, usd_sum


def settled():
    return F.col("status") == "succeeded"


def revenue_type():
    return F.col("type").isin(fv.REVENUE_TYPES)


def as_timestamp(as_of):
    return F.lit(str(as_of)).cast("timestamp_ntz")


def as_date(as_of):
    return F.lit(str(as_of)).cast("date")


def days_before(as_of, days):
    """Instant a number of days before the reference time."""
    return as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days))


def month_number():
    """Months since year 0 from the partition columns; NULL where those are missing."""
    return F.col("occurred_year").cast("int") * 12 + F.col("occurred_month").cast("int")


def _month_from(first):
    return month_number().isNull() | (month_number() >= first)


def occurred_since(cutoff):
    """Event time at or after a cutoff, with the year/month bound that prunes partitions."""
    return (F.col("occurred_at") >= cutoff) & _month_from(F.year(cutoff) * 12 + F.month(cutoff))


def occurred_on_or_after(day):
    """Event date at or after a day, with the partition bound."""
    return (F.col("occurred_date") >= day) & _month_from(F.year(day) * 12 + F.month(day))


def occurred_between(lo, hi):
    """Event date within two days (inclusive), with the partition bounds."""
    number = lambda day: F.year(as_date(day)) * 12 + F.month(as_date(day))
    until = month_number().isNull() | (month_number() <= number(hi))
    return F.col("occurred_date").between(as_date(lo), as_date(hi)) & _month_from(number(lo)) & until


def newest_month(ledger):
    """Rows of the newest partition, found from the partition columns alone."""
    return ledger.filter(_month_from(ledger.agg(F.max(month_number())).scalar()))


def latest(ledger, column):
    """Greatest value of a column as a scalar subquery; event times look at the newest month only."""
    if column in ("occurred_at", "occurred_date"):
        ledger = newest_month(ledger)
    return ledger.agg(F.max(column)).scalar()


def newest_first(column, *tie):
    """Descending order in which a missing value counts as the greatest."""
    return [F.col(column).desc_nulls_first(), *[F.col(t).asc() for t in tie]]


def oldest_first(column):
    return F.col(column).asc_nulls_last()


def daily_cash_position(ledger):
    """Settled cash flows by posting day with the running balance; undated rows come last.

    The ledger is reduced to one row per day before the running sum, so the single-partition
    window holds calendar days only.
    """
    net = F.col("net_amount")
    daily = (
        ledger.filter((F.col("basis") == "cash") & settled())
        .groupBy(F.col("posted_date").alias("date"))
        .agg(
            cents_sum(F.when(net > 0, net).otherwise(0)).alias("inflow"),
            cents_sum(F.when(net < 0, -net).otherwise(0)).alias("outflow"),
            cents_sum(net).alias("net"),
        )
    )
    to_date = Window.orderBy(F.col("date").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return daily.select(
        "date",
        to_usd(F.col("inflow")).alias("inflows_usd"),
        to_usd(F.col("outflow")).alias("outflows_usd"),
        to_usd(F.col("net")).alias("net_flow_usd"),
        to_usd(F.sum("net").over(to_date)).alias("cumulative_cash_usd"),
    )


def month_of(column="occurred_at"):
    return F.trunc(F.to_date(F.col(column)), "month")


def monthly_pl(ledger):
    """Accrual profit and loss by month and account."""
    net = F.col("net_amount")
    return (
        ledger.filter((F.col("basis") == "accrual") & settled())
        .groupBy(month_of().alias("month"), "account_code")
        .agg(
            usd_sum(F.when(net > 0, net).otherwise(0)).alias("credit_usd"),
            usd_sum(F.when(net < 0, -net).otherwise(0)).alias("debit_usd"),
            usd_sum(net).alias("net_usd"),
        )
    )


def revenue_by_product(ledger):
    """Accrual revenue, refunds and their difference by month and product line."""
    revenue = cents_sum("amount", revenue_type() & settled())
    refunds = cents_sum("amount", (F.col("type") == "refund") & settled())
    return (
        ledger.filter((F.col("basis") == "accrual") & F.col("product_line").isNotNull())
        .groupBy(month_of().alias("month"), "product_line")
        .agg(revenue.alias("revenue"), refunds.alias("refunds"))
        .select(
            "month",
            "product_line",
            to_usd(F.col("revenue")).alias("revenue_usd"),
            to_usd(F.col("refunds")).alias("refunds_usd"),
            to_usd(F.col("revenue") - F.coalesce(F.col("refunds"), F.lit(0))).alias("net_revenue_usd"),
        )
    )


def success_rate_daily(ledger):
    """Share of settled payments by day and source."""
    total, good = F.count(F.lit(1)), count_when(settled())
    return (
        ledger.filter(revenue_type())
        .groupBy("occurred_date", "source")
        .agg(
            total.alias("total_transactions"),
            good.alias("succeeded_count"),
            (good.cast("double") / total.cast("double")).alias("success_rate"),
        )
    )


def decline_analysis(ledger):
    """Declines by code: counts, per-source counts, mean amount, distinct customers."""
    total = F.count(F.lit(1))
    return (
        ledger.filter((F.col("status") == "failed") & F.col("decline_code").isNotNull())
        .groupBy("decline_code")
        .agg(
            total.alias("total_declines"),
            count_when(F.col("source") == "stripe").alias("stripe_declines"),
            count_when(F.col("source") == "adyen").alias("adyen_declines"),
            (usd_sum("amount") / F.count("amount").cast("double")).alias("avg_amount_usd"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )


def disputes(ledger):
    """Disputed transactions, due 30 days after the event."""
    return ledger.filter(F.col("dispute_id").isNotNull()).select(
        "dispute_id",
        "transaction_id",
        "customer_id",
        "amount_usd",
        "dispute_status",
        F.col("occurred_at").alias("dispute_created_at"),
        (F.col("occurred_at") + F.expr("INTERVAL 30 DAYS")).alias("due_by"),
    )


def latest_forecast(forecast):
    """Rows of the newest forecast snapshot."""
    return forecast.filter(F.col("forecast_date") == latest(forecast, "forecast_date"))


def ar_aging(ledger, customers, as_of, open_statuses=("pending", "succeeded"), with_oldest=False):
    """Open accrual invoices per known customer in four age buckets.

    ``with_oldest`` adds the date of each customer's oldest open invoice.

    Invoices are summed per customer before the dimension join, so a customer with very many
    invoices crosses the network as one partial sum per task.
    """
    at = F.col("occurred_at")
    d30, d60, d90 = (days_before(as_of, d) for d in (30, 60, 90))
    per_customer = (
        ledger.filter(
            (F.col("type") == "invoice_payment")
            & F.col("status").isin(list(open_statuses))
            & (F.col("basis") == "accrual")
        )
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("invoice_count"),
            usd_sum("amount").alias("total_outstanding_usd"),
            usd_sum("amount", at >= d30).alias("current_usd"),
            usd_sum("amount", (at < d30) & (at >= d60)).alias("days_31_60_usd"),
            usd_sum("amount", (at < d60) & (at >= d90)).alias("days_61_90_usd"),
            usd_sum("amount", at < d90).alias("days_90_plus_usd"),
            F.to_date(F.min(at)).alias("oldest_invoice_date"),
        )
    )
    names = customers.select("customer_id", "customer_name")
    oldest = ["oldest_invoice_date"] if with_oldest else []
    return per_customer.join(names, "customer_id").select(
        "customer_id",
        "customer_name",
        "invoice_count",
        "total_outstanding_usd",
        "current_usd",
        "days_31_60_usd",
        "days_61_90_usd",
        "days_90_plus_usd",
        *oldest,
    )


def create_views(ledger, customers, forecast, as_of):
    """The marts as temporary views for SQL users."""
    views = {
        "transactions": ledger,
        "customers": customers,
        "daily_cash_position": daily_cash_position(ledger),
        "monthly_pl": monthly_pl(ledger),
        "revenue_by_product": revenue_by_product(ledger),
        "success_rate_daily": success_rate_daily(ledger),
        "decline_analysis": decline_analysis(ledger),
        "disputes": disputes(ledger),
        "forecasts": latest_forecast(forecast),
        "ar_aging": ar_aging(ledger, customers, as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
