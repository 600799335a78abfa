"""Cash-flow report."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.labels import label
from ..functions.money import or_zero, percent, round_half_up, round_toward_plus, usd_sum
from .executive import latest_value
from .marts import (
    latest,
    latest_forecast,
    newest_first,
    occurred_on_or_after,
    oldest_first,
    revenue_type,
    settled,
)


def _money(column, name):
    return or_zero(round_half_up(column, 2)).alias(name)


def forecast_fan(forecast):
    """Quantile bands of the newest forecast snapshot by date."""
    return (
        latest_forecast(forecast)
        .select(
            F.col("prediction_date").alias("date"),
            _money("p10_cumulative_cash_usd", "p10"),
            _money("p50_cumulative_cash_usd", "p50"),
            _money("p90_cumulative_cash_usd", "p90"),
            _money("p50_inflows_usd", "inflows"),
            _money("p50_outflows_usd", "outflows"),
        )
        .orderBy("date")
    )


def weekly_flows(daily, n=12):
    """Flows of the last n weeks (Monday start), oldest first."""
    week = F.to_date(F.date_trunc("week", F.col("date"))).alias("week")
    return (
        daily.groupBy(week)
        .agg(
            _money(F.sum("inflows_usd"), "inflows"),
            _money(F.sum("outflows_usd"), "outflows"),
            _money(F.sum("net_flow_usd"), "net"),
        )
        .orderBy(*newest_first("week"))
        .limit(n)
        .orderBy(oldest_first("week"))
    )


def flow_last_n_days(daily, n=30):
    """Flow totals of the last n active days."""
    return (
        daily.orderBy(*newest_first("date"))
        .limit(n)
        .agg(
            _money(F.sum("inflows_usd"), "inflows"),
            _money(F.sum("outflows_usd"), "outflows"),
            _money(F.sum("net_flow_usd"), "net_cash_flow"),
        )
    )


def _since_last_date(ledger, days):
    return occurred_on_or_after(F.date_sub(latest(ledger, "occurred_date"), days))


def _with_share(df):
    return df.withColumn("percentage", percent("amount", F.sum("amount").over(Window.partitionBy())))


def inflow_breakdown(ledger, days=30):
    """Settled revenue by product over the last days of data, with shares."""
    product = F.coalesce("product_line", F.lit(fv.UNLABELLED_INFLOW)).alias("product")
    sums = (
        ledger.filter(revenue_type() & settled() & _since_last_date(ledger, days))
        .groupBy(product)
        .agg(round_half_up(usd_sum("amount"), 2).alias("amount"))
    )
    return (
        _with_share(sums)
        .select("product", label("product_line", "product").alias("category"), "amount", "percentage")
        .orderBy(F.col("amount").desc(), "product")
    )


def outflow_breakdown(ledger, days=30):
    """Outflow by type over the last days of data, whatever the status, with shares."""
    sums = (
        ledger.filter(F.col("type").isin(fv.OUTFLOW_TYPES) & _since_last_date(ledger, days))
        .groupBy("type")
        .agg(round_half_up(usd_sum("amount"), 2).alias("amount"))
    )
    return (
        _with_share(sums)
        .select("type", label("outflow_type", "type").alias("category"), "amount", "percentage")
        .orderBy(F.col("amount").desc(), "type")
    )


def operating_and_free_cash(inflows, outflows):
    """Inflow less fees and refunds; then less payouts and transfers."""
    incoming = or_zero(inflows.agg(F.sum("amount")).scalar())
    sums = outflows.agg(
        or_zero(F.sum(F.when(F.col("type").isin("fee", "refund"), F.col("amount")))).alias("fees"),
        or_zero(F.sum(F.when(F.col("type").isin("payout", "transfer"), F.col("amount")))).alias("paid"),
    )
    operating = round_half_up(incoming - F.col("fees"), 2)
    return sums.select(
        operating.alias("operating_cash_flow"),
        round_half_up(operating - F.col("paid"), 2).alias("free_cash_flow"),
    )


_PERIODS = {
    "month": lambda d: F.date_format(d, "yyyy-MM"),
    "quarter": lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
}


def period_trends(daily, period="month", n=12):
    """Flows and closing cash of the last n months or quarters, oldest first."""
    return (
        daily.groupBy(_PERIODS[period](F.col("date")).alias("period"))
        .agg(
            _money(F.sum("inflows_usd"), "inflows"),
            _money(F.sum("outflows_usd"), "outflows"),
            _money(F.sum("net_flow_usd"), "net_flow"),
            _money(F.max_by("cumulative_cash_usd", F.struct("date")), "ending_cash"),
        )
        .orderBy(*newest_first("period"))
        .limit(n)
        .orderBy(oldest_first("period"))
    )


def baseline_projection(daily, horizon=fv.BASELINE_HORIZON_DAYS):
    """Straight-line projection from the mean flow of the last 30 dated days.

    The band widens with the distance from the last day.
    """
    dated = daily.filter(F.col("date").isNotNull()).orderBy(F.col("date").desc()).limit(30)
    start = dated.agg(
        F.max("date").alias("last_date"),
        or_zero(F.max_by("cumulative_cash_usd", "date")).alias("cash"),
        or_zero(F.avg("inflows_usd")).alias("avg_in"),
        or_zero(F.avg("outflows_usd")).alias("avg_out"),
        F.avg("net_flow_usd").alias("avg_net"),
    ).filter(F.col("last_date").isNotNull())
    flow = F.when(F.col("avg_net") != 0, F.col("avg_net")).otherwise(
        F.col("avg_in") - F.col("avg_out")
    )
    day = F.col("day")
    path = start.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "p50", F.col("cash") + day * flow
    )
    cone = F.abs("p50") * fv.BASELINE_CONE_RATE * (day / fv.BASELINE_CONE_DAYS)
    return path.select(
        F.date_add("last_date", day).alias("date"),
        round_half_up(F.col("p50") - cone, 2).alias("p10"),
        round_half_up("p50", 2).alias("p50"),
        round_half_up(F.col("p50") + cone, 2).alias("p90"),
        round_half_up(F.greatest(F.lit(0.0), "avg_in"), 2).alias("inflows"),
        round_half_up(F.greatest(F.lit(0.0), "avg_out"), 2).alias("outflows"),
    ).orderBy("date")


def scenarios(fan, forecast, daily):
    """Worst, base and best case at the end of the fan.

    Runways come from the newest snapshot; without one, from whether cash grows.
    """
    snapshot = latest_forecast(forecast).orderBy("prediction_date").limit(1)
    reserves = latest_value(daily, "date", "cumulative_cash_usd")
    reserve = or_zero(round_half_up(reserves.scalar(), 2))
    base = fan.agg(
        *[F.coalesce(F.max_by(q, "date"), reserve).alias(q) for q in ("p10", "p50", "p90")]
    ).select(
        "*",
        F.coalesce(snapshot.select("starting_cash_usd").scalar(), reserve).alias("start"),
        *[
            snapshot.select(f"{q}_runway_days").scalar().cast("long").alias(f"{q}_runway")
            for q in ("p10", "p50", "p90")
        ],
    )
    cases = []
    for name, (q, text, falling) in fv.SCENARIOS.items():
        end, start = F.col(q), F.col("start")
        fallback = F.when(end >= start, fv.SCENARIO_RUNWAY_GROWING).otherwise(falling).cast("long")
        cases.append(
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(text).alias("label"),
                F.coalesce(F.col(f"{q}_runway"), fallback).alias("runway_days"),
                end.alias("ending_cash_90d"),
                round_half_up(end - start, 2).alias("net_change_90d"),
                round_half_up((end - start) / 90.0, 2).alias("daily_burn_or_growth"),
            )
        )
    return base.select(F.inline(F.array(*cases)))


def cashflow_kpis(fan, weekly):
    """Projected ending cash, band width, 12-week net and its weekly mean."""
    last = fan.agg(F.max_by(F.struct("p10", "p50", "p90"), "date").alias("last"))
    net = weekly.agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("weeks"))
    total = or_zero(round_toward_plus("net", 2))
    return net.select(
        or_zero(last.select("last.p50").scalar()).alias("projected_ending_cash"),
        or_zero(
            F.greatest(
                F.lit(0.0), round_toward_plus(last.select(F.col("last.p90") - F.col("last.p10")).scalar(), 2)
            )
        ).alias("confidence_spread"),
        total.alias("historical_12w_net"),
        or_zero(
            F.when(F.col("weeks") > 0, round_toward_plus(total / F.col("weeks").cast("double"), 2))
        ).alias("avg_weekly_net"),
    )


def actual_vs_forecast(trend, fan):
    """Actual days then forecast days; the last actual point also opens the forecast lines."""
    position = F.struct(F.col("date").isNull(), F.col("date"))
    newest = position == F.max(position).over(Window.partitionBy())
    anchor = F.when(newest, F.col("cash"))
    actual = trend.select(
        "date",
        F.lit("actual").alias("series"),
        F.col("cash").alias("actual"),
        anchor.alias("p10"),
        anchor.alias("p50"),
        anchor.alias("p90"),
    )
    ahead = fan.select("date", F.lit("forecast").alias("series"), "p10", "p50", "p90")
    return actual.unionByName(ahead, allowMissingColumns=True)
