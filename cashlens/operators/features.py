"""Daily features and the cash forecast."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import count_when, or_zero, usd_sum
from ..functions.rules import runway_days, split_flow
from ..session import written
from .executive import latest_value
from .marts import as_date, latest, revenue_type, settled

IDENTITY_COLUMNS = [
    "posted_date",
    "target_net_flow_1d",
    "target_net_flow_7d",
    "inflows_usd",
    "outflows_usd",
    "net_flow_usd",
    "cumulative_cash_usd",
]


def daily_features(ledger, since, inference=False):
    """Settled cash flows and counts by posting day since a date.

    ``since`` is a date column or scalar; inference adds the fee count. Days bound the result.
    """
    net = F.col("net_amount")
    of = lambda *types: F.col("type").isin(*types) & settled()
    refund, revenue = of("refund"), revenue_type() & settled()
    fees = [count_when(of("fee")).alias("n_fees")] if inference else []
    return (
        ledger.filter((F.col("basis") == "cash") & settled() & (F.col("posted_date") >= since))
        .groupBy("posted_date")
        .agg(
            usd_sum(F.when(net > 0, net).otherwise(0)).alias("inflows_usd"),
            usd_sum(F.when(net < 0, -net).otherwise(0)).alias("outflows_usd"),
            usd_sum(net).alias("net_flow_usd"),
            count_when(revenue).alias("n_charges"),
            count_when(refund).alias("n_refunds"),
            count_when(of("payout")).alias("n_payouts"),
            *fees,
            or_zero(usd_sum("amount", revenue)).alias("gross_revenue_usd"),
            or_zero(usd_sum("amount", refund)).alias("refunds_usd"),
        )
    )


def training_days(ledger, as_of, days=365):
    return daily_features(ledger, F.date_sub(as_date(as_of), days))


def inference_days(ledger, days=90):
    return daily_features(ledger, F.date_sub(latest(ledger, "posted_date"), days), inference=True)


def require_rows(df, minimum):
    """Fail the job when there are some, but fewer, rows than a model needs."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    message = F.concat(F.lit(f"need at least {minimum} rows, got "), rows.cast("string"))
    enough = F.when(rows >= minimum, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.filter(enough)


def calendar_features(df):
    """Weekday (Monday 1), day, month, quarter, year, weekend and month-edge flags."""
    d = F.col("posted_date")
    flag = lambda condition: condition.cast("int")
    return df.withColumns(
        {
            "dow": F.weekday(d) + 1,
            "day_of_month": F.dayofmonth(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "year": F.year(d),
            "is_weekend": flag(F.weekday(d) + 1 >= 6),
            "is_month_start": flag(F.dayofmonth(d) <= 5),
            "is_month_end": flag(F.dayofmonth(d) >= 25),
        }
    )


def _by_day():
    return Window.orderBy("posted_date")


def lag_features(df):
    """Values a number of rows (active days, not calendar days) back."""
    lags = {"net_flow": [1, 2, 3, 7, 14, 30], "inflows": [1, 7, 30], "outflows": [1, 7, 30]}
    return df.withColumns(
        {
            f"{name}_lag_{k}d": F.lag(f"{name}_usd", k).over(_by_day())
            for name, steps in lags.items()
            for k in steps
        }
    )


def rolling_features(df):
    """Rolling means and sample deviations; NULL until the window is full."""

    def full(fn, column, n):
        frame = _by_day().rowsBetween(-(n - 1), 0)
        return F.when(F.count(column).over(frame) == n, fn(column).over(frame))

    return df.withColumns(
        {
            "net_flow_ma_7d": full(F.avg, "net_flow_usd", 7),
            "net_flow_std_7d": full(F.stddev_samp, "net_flow_usd", 7),
            "net_flow_ma_30d": full(F.avg, "net_flow_usd", 30),
            "net_flow_std_30d": full(F.stddev_samp, "net_flow_usd", 30),
            "inflows_ma_7d": full(F.avg, "inflows_usd", 7),
            "outflows_ma_7d": full(F.avg, "outflows_usd", 7),
        }
    )


def trend_features(df):
    """Running cash and the change against 7 and 30 rows earlier."""
    running = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    change = lambda k: F.col("net_flow_usd") - F.lag("net_flow_usd", k).over(_by_day())
    exact = F.col("net_flow_usd").cast("decimal(28,6)")
    return df.withColumns(
        {
            "cumulative_cash_usd": F.sum(exact).over(running).cast("double"),
            "net_flow_wow_change": change(7),
            "net_flow_mom_change": change(30),
        }
    )


def forecast_features(daily):
    """All feature columns over daily rows."""
    return trend_features(rolling_features(lag_features(calendar_features(daily))))


def with_targets(df):
    """Net flow 1 and 7 rows ahead; rows with any gap are dropped."""
    return df.withColumns(
        {f"target_net_flow_{k}d": F.lead("net_flow_usd", k).over(_by_day()) for k in (1, 7)}
    ).na.drop()


def feature_columns(df):
    return [c for c in df.columns if c not in IDENTITY_COLUMNS]


def cutoff(df, levels, rank):
    """Values of the level columns, coarse to fine, at the row of a given rank.

    Each level counts rows per value inside the value the level before settled on, so a driver
    sees one row per level and no task orders more than one level's values.
    """
    found = []
    for level in levels:
        counts = df.groupBy(level.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        running = counts.select("value", "n", F.sum("n").over(upto).alias("upto"))
        hit = running.filter(F.col("upto") >= rank).orderBy("value").limit(1).first()
        found.append(hit["value"])
        rank -= hit["upto"] - hit["n"]
        df = df.filter(level == _literal(hit["value"]))
    return found


def _literal(value):
    """A collected value as a literal; wall-clock times stay clear of the session time zone."""
    return F.lit(str(value)).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def time_split(df, order, tie=None, last=None, frac=None):
    """Chronological split: the last rows, or those past a fraction, validate.

    Rows of one instant are told apart by the hash of ``tie``. Only the boundary is looked up, by
    narrowing it from days down; rows are neither sorted nor numbered.
    """
    df = written(df, "split")
    total = df.count()
    train = max(total - last, 0) if last is not None else int(total * frac)
    at = F.col(order)
    if train == 0:
        return df.withColumn("split", F.lit("validate"))
    if tie is None:
        edge = cutoff(df, [at], train)[0]
        inside = at <= _literal(edge)
    else:
        code = F.md5(tie)
        second = F.date_trunc("second", at).cast("timestamp_ntz")
        levels = [F.to_date(at), second, at, F.left(code, F.lit(2)), F.left(code, F.lit(4)), code]
        edge = cutoff(df, levels, train)
        instant = _literal(edge[2])
        inside = (at < instant) | ((at == instant) & (code <= F.lit(edge[-1])))
    return df.withColumn("split", F.when(inside, "train").otherwise("validate"))


def quantile_metrics(predictions, alpha, label="target_net_flow_1d", prediction="prediction"):
    """Mean absolute error and pinball loss at one quantile."""
    error = F.col(label) - F.col(prediction)
    pinball = F.greatest(alpha * error, (alpha - 1.0) * error)
    return predictions.agg(F.avg(F.abs(error)).alias("mae"), F.avg(pinball).alias("pinball_loss"))


def latest_features(ledger, days=90):
    """Feature row of the newest complete day, the date, and all-time cash."""
    rows = forecast_features(require_rows(inference_days(ledger, days), 30)).na.drop()
    return rows.orderBy(F.col("posted_date").desc()).limit(1)


def current_cash(daily, features):
    """All-time running balance, else that of the feature window."""
    total = latest_value(daily, "date", "cumulative_cash_usd").scalar()
    return features.select(
        F.col("posted_date").alias("last_date"),
        F.coalesce(total, F.col("cumulative_cash_usd")).alias("current_cash_usd"),
    )


def forecast_path(prediction, horizon=91, forecast_date=None, version="v1", trained_at=None):
    """Daily forecast rows from one row of last_date, current_cash_usd, p10, p50, p90.

    Each day repeats the three flows; the median is carried forward and the outer quantiles step
    from the median of the day before.
    """
    h = F.col("horizon_days")
    rows = prediction.withColumn("horizon_days", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    carried = F.col("current_cash_usd") + (h - 1) * F.col("p50")
    cash = {q: carried + F.col(q) for q in ("p10", "p50", "p90")}
    inflow, outflow = split_flow("p50")
    made_on = as_date(forecast_date) if forecast_date is not None else F.current_date()
    return rows.select(
        made_on.alias("forecast_date"),
        F.date_add("last_date", h).alias("prediction_date"),
        h.cast("short").alias("horizon_days"),
        *[F.col(q).alias(f"{q}_net_flow_usd") for q in cash],
        inflow.alias("p50_inflows_usd"),
        outflow.alias("p50_outflows_usd"),
        F.col("current_cash_usd").alias("starting_cash_usd"),
        *[value.alias(f"{q}_cumulative_cash_usd") for q, value in cash.items()],
        *[runway_days(value, F.col(q)).alias(f"{q}_runway_days") for q, value in cash.items()],
        F.lit(version).alias("model_version"),
        F.lit(trained_at).cast("timestamp_ntz").alias("model_trained_at"),
        F.lit("v1").alias("feature_set_version"),
    )
