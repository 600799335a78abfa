"""Data quality checks, repairs and control totals (Q1-Q11)."""

from functools import reduce

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import count_when, or_zero, ratio, round_half_up, usd_sum
from ..functions.rules import wall_micros, with_usd
from .marts import as_date, as_timestamp, occurred_between, revenue_type, settled


def freshness(ledger, as_of, max_hours=48):
    """Age of the newest event in hours and whether it is within the limit.

    Events after the reference time count as age 0; an empty ledger is not fresh.
    """
    newest = ledger.agg(F.max("occurred_at").alias("latest"))
    micros = wall_micros(as_timestamp(as_of)) - wall_micros("latest")
    hours = F.when(F.col("latest").isNotNull(), F.greatest(micros, F.lit(0)) / F.lit(3600e6))
    return newest.select(
        "latest",
        hours.alias("age_hours"),
        F.coalesce(hours <= max_hours, F.lit(False)).alias("is_fresh"),
    )


def row_count_checks(tables, minima):
    """Rows of each named table against its minimum."""
    checks = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.lit(minima[name]).cast("long").alias("min_rows"),
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), checks).withColumn(
        "is_ok", F.col("row_count") >= F.col("min_rows")
    )


def forecast_freshness(forecast, as_of):
    """Days since the newest forecast; no forecast at all is no warning."""
    newest = forecast.agg(F.max("forecast_date").alias("latest"))
    age = F.datediff(as_date(as_of), "latest")
    return newest.select("latest", age.alias("age_days"), F.coalesce(age >= 1, F.lit(False)).alias("is_stale"))


def repair_signs(ledger):
    """Refunds, payouts and fees with a positive net become negative."""
    wrong = F.col("type").isin(fv.SIGNED_OUTFLOW_TYPES) & (F.col("net_amount") > 0)
    return with_usd(
        ledger.withColumn("net_amount", F.when(wrong, -F.col("net_amount")).otherwise(F.col("net_amount")))
    )


def repair_basis(ledger):
    """Payouts and fees are always cash."""
    wrong = F.col("type").isin("payout", "fee") & (F.col("basis") != "cash")
    return ledger.withColumn("basis", F.when(wrong, "cash").otherwise(F.col("basis")))


def fill_forecast_outflows(forecast, daily):
    """Missing or zero median outflows take the mean positive daily outflow."""
    mean = daily.filter(F.col("outflows_usd") > 0).agg(round_half_up(F.avg("outflows_usd"), 2)).scalar()
    outflow = F.col("p50_outflows_usd")
    empty = outflow.isNull() | (outflow == 0)
    return forecast.withColumn("p50_outflows_usd", F.when(empty, mean).otherwise(outflow))


def _direction():
    return F.when(revenue_type(), "inflow").when(F.col("type").isin(fv.OUTFLOW_TYPES), "outflow")


def _month():
    return F.date_format("occurred_date", "yyyy-MM")


def _factors(ledger, targets, key):
    """Target over settled actual by calendar period and direction.

    At most two rows per calendar period with a target, which bounds the broadcasts below.
    """
    wanted = targets.select(
        "period",
        F.inline(
            F.array(
                F.struct(F.lit("inflow").alias("direction"), F.col("inflows").alias("target")),
                F.struct(F.lit("outflow").alias("direction"), F.col("outflows").alias("target")),
            )
        ),
    )
    actual = (
        ledger.filter(settled())
        .groupBy(key.alias("period"), _direction().alias("direction"))
        .agg(usd_sum("amount").alias("actual"))
        .filter(F.col("direction").isNotNull() & (F.col("actual") > 0))
    )
    return wanted.join(F.broadcast(actual), ["period", "direction"])


def _apply(ledger, factors, key, floors):
    scaled = (
        ledger.withColumns({"period": key, "direction": _direction()})
        .join(F.broadcast(factors.select("period", "direction", "factor")), ["period", "direction"], "left")
    )
    factor, out = F.col("factor"), F.col("direction") == "outflow"
    times = lambda c: F.bround(c.cast("double") * factor, 0).cast("long")
    amount, net, fee = times(F.col("amount")), times(F.col("net_amount")), times(F.col("fee_amount"))
    if floors:
        at_least = lambda low, value: F.greatest(F.lit(low).cast("long"), value)
        amount = at_least(100, amount)
        net = F.when(out, -at_least(100, times(F.abs("net_amount")))).otherwise(at_least(90, net))
        fee = F.when(out, at_least(0, fee)).otherwise(at_least(10, fee))
    change = lambda name, value: F.when(factor.isNotNull(), value).otherwise(F.col(name)).alias(name)
    new = {"amount": amount, "net_amount": net, "fee_amount": fee}
    return with_usd(scaled.select([change(c, new[c]) if c in new else F.col(c) for c in ledger.columns]))


def scale_to_targets(ledger, targets, floors=False):
    """Rescale cents so that settled monthly flows meet target totals.

    ``targets`` has one row per month: period (yyyy-MM), inflows, outflows in dollars. Every row of
    the month and direction is scaled, whatever its status; months without a target stay.
    """
    factors = _factors(ledger, targets, _month()).withColumn("factor", F.col("target") / F.col("actual"))
    return _apply(ledger, factors, _month(), floors)


def cap_daily_spikes(ledger, targets):
    """Scale down days far above their target (period is the date); small excesses stay."""
    day = F.col("occurred_date")
    factors = (
        _factors(ledger, targets, day)
        .withColumn("factor", F.col("target") / F.col("actual"))
        .filter((F.col("actual") > F.col("target")) & (F.col("factor") < 0.95))
    )
    return _apply(ledger, factors, day, floors=True)


def monthly_flow_check(ledger, lo, hi):
    """Settled signed flows by month of a date range, with outflow as a share of inflow."""
    net = F.col("net_amount")
    return (
        ledger.filter(occurred_between(lo, hi) & settled())
        .groupBy(_month().alias("month"))
        .agg(
            usd_sum(F.when(net > 0, net).otherwise(0)).alias("inflows"),
            usd_sum(F.when(net < 0, -net).otherwise(0)).alias("outflows"),
            usd_sum(net).alias("net_flow"),
        )
        .withColumn("ratio_pct", round_half_up(ratio("outflows", "inflows") * 100.0, 1))
    )


def sparse_days(ledger, lo, hi, min_rows=5):
    """Calendar days of a range with fewer rows than wanted, days without rows included."""
    days = ledger.sparkSession.range(1).select(
        F.explode(F.sequence(as_date(lo), as_date(hi))).alias("occurred_date")
    )
    counts = (
        ledger.filter(occurred_between(lo, hi))
        .groupBy("occurred_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = F.coalesce("n", F.lit(0)).cast("long")
    return (
        days.join(counts, "occurred_date", "left")
        .select("occurred_date", rows.alias("row_count"))
        .filter(F.col("row_count") < min_rows)
    )


def range_totals(ledger, lo, hi):
    """Settled inflows and signed outflows between two dates: counts and amounts."""
    inflow = revenue_type() & settled()
    outflow = F.col("type").isin(fv.SIGNED_OUTFLOW_TYPES) & settled()
    return ledger.filter(occurred_between(lo, hi)).agg(
        count_when(inflow).alias("inflow_count"),
        or_zero(usd_sum("amount", inflow)).alias("inflow_usd"),
        count_when(outflow).alias("outflow_count"),
        or_zero(usd_sum("amount", outflow)).alias("outflow_usd"),
    )
