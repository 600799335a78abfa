"""Column rules of the ledger: type maps, fees, signs, dates, keys, policies."""

from itertools import chain

from pyspark.sql import functions as F

from .. import fixed_values as fv
from .money import as_col


def map_lookup(table, key):
    """Value of a small literal table for a key column, NULL when absent."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(entries, as_col(key))


def map_event_type(col):
    return map_lookup(fv.EVENT_TYPES, col)


def map_status(col):
    """Known processor statuses pass; a missing or unknown one counts as succeeded."""
    return F.coalesce(map_lookup(fv.EVENT_STATUSES, col), F.lit("succeeded"))


def fee_cents(txn_type, status, amount):
    """Card fee: 2.9 % + 30 cents on a settled charge, the 2.9 % returned on a refund.

    Both truncate toward zero.
    """
    kind, state, cents = as_col(txn_type), as_col(status), as_col(amount)
    share = cents * F.lit(fv.CARD_FEE_RATE)
    return (
        F.when(
            (kind == "charge") & (state == "succeeded"),
            (share + F.lit(float(fv.CARD_FEE_FIXED_CENTS))).cast("long"),
        )
        .when(kind == "refund", -share.cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )


def net_cents(txn_type, status, amount, fee):
    """Signed net: outflow types negative, settled charges less the fee, others gross."""
    kind, state, cents = as_col(txn_type), as_col(status), as_col(amount)
    return (
        F.when(kind.isin(fv.SIGNED_OUTFLOW_TYPES), -F.abs(cents))
        .when((kind == "charge") & (state == "succeeded"), cents - as_col(fee))
        .otherwise(cents)
    )


def date_parts(column="occurred_at"):
    """Calendar columns of the event time: Sunday is day 0, weeks are ISO weeks."""
    at = F.col(column)
    return {
        "occurred_date": F.to_date(at),
        "occurred_hour": F.hour(at).cast("short"),
        "occurred_dow": (F.dayofweek(at) - 1).cast("short"),
        "occurred_week": F.weekofyear(at).cast("short"),
        "occurred_month": F.month(at).cast("short"),
        "occurred_quarter": F.quarter(at).cast("short"),
        "occurred_year": F.year(at).cast("short"),
    }


def with_date_parts(df, column="occurred_at", known=()):
    """The rows with their calendar columns, of which those ``known`` are there already."""
    return df.withColumns({name: part for name, part in date_parts(column).items() if name not in known})


def day_micros(at):
    """Microseconds since midnight of a wall-clock time."""
    t = as_col(at)
    seconds = F.extract(F.lit("SECOND"), t).cast("decimal(8,6)")
    return (F.hour(t) * 60 + F.minute(t)).cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")


def wall_micros(at):
    """Microseconds since 1970 of a UTC wall-clock time, whatever the session time zone."""
    return F.unix_date(F.to_date(as_col(at))).cast("long") * 86_400_000_000 + day_micros(at)


def from_micros(micros):
    """UTC wall-clock time of microseconds since 1970."""
    seconds = as_col(micros).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def with_usd(df):
    """Generated columns: cents times rate over 100."""
    return df.withColumns(
        {
            f"{name}_usd": F.col(name).cast("double") * F.col("fx_rate") / F.lit(100.0)
            for name in ("amount", "net_amount", "fee_amount")
        }
    )


def idempotency_key(*parts):
    return F.concat_ws("_", *[as_col(p) for p in parts])


def tag_recurring(df):
    """Settled subscription charges whose description reads like a recurring one."""
    matches = (
        (F.col("type") == "charge")
        & (F.col("status") == "succeeded")
        & (F.col("product_line") == "subscriptions")
        & F.col("description").rlike(fv.RECURRING_PATTERN)
    )
    return df.withColumn("is_recurring", F.coalesce(matches, F.lit(False)))


def runway_days(cash, flow):
    """Days until cash runs out at a daily flow; 999 when the flow is not negative.

    NULL when a vanishing flow gives more days than a long can hold.
    """
    cash, flow = as_col(cash), as_col(flow)
    return F.when(flow >= 0, F.lit(fv.RUNWAY_UNLIMITED).cast("long")).otherwise(
        (cash / F.nullif(F.abs(flow), F.lit(0.0))).try_cast("long")
    )


def split_flow(p50):
    """Median flow split into (inflow, outflow) at the fixed share, each floored at 0."""
    flow = as_col(p50)
    inflow = F.when(flow > 0, flow * fv.INFLOW_SHARE_OF_P50).otherwise(
        -flow * (1 - fv.INFLOW_SHARE_OF_P50)
    )
    zero = F.lit(0.0)
    return F.greatest(zero, inflow), F.greatest(zero, inflow - flow)


def retry_action(probability, scored_at):
    """(recommended action, retry time) by probability thresholds; no time when not retried."""
    p, now = as_col(probability), as_col(scored_at)
    action, retry_at = None, None
    for name, (at_least, hours) in fv.RETRY_ACTIONS.items():
        hit = p >= at_least
        later = now + F.make_dt_interval(hours=F.lit(hours))
        action = F.when(hit, name) if action is None else action.when(hit, name)
        retry_at = F.when(hit, later) if retry_at is None else retry_at.when(hit, later)
    return action.otherwise(fv.NO_RETRY_ACTION), retry_at


def ar_severity(suffix="_usd"):
    """Oldest bucket with a balance decides the class."""
    return (
        F.when(F.col(f"days_90_plus{suffix}") > 0, "critical")
        .when(F.col(f"days_61_90{suffix}") > 0, "elevated")
        .when(F.col(f"days_31_60{suffix}") > 0, "moderate")
        .otherwise("current")
    )


def runway_status(days):
    d = as_col(days)
    return (
        F.when(d >= fv.RUNWAY_HEALTHY_DAYS, "healthy")
        .when(d >= fv.RUNWAY_MODERATE_DAYS, "moderate")
        .otherwise("critical")
    )
