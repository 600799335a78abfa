"""Decline-retry features, outcomes and policy."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import cents_sum, count_when, or_zero, round_half_up, to_usd
from ..functions.rules import day_micros, map_lookup, retry_action
from .marts import as_date, latest, occurred_on_or_after, occurred_since, revenue_type, settled

WINDOW_DAYS = 7
#: Microseconds of the slices a customer's day of instants is cut into: a minute, 1440 in a day.
SLICE = 60_000_000


def declined_events(ledger, as_of=None, days=180):
    """Declined payments with card details from the metadata; all of them without ``as_of``."""
    declined = (F.col("status") == "failed") & F.col("decline_code").isNotNull() & revenue_type()
    if as_of is not None:
        declined = declined & occurred_on_or_after(F.date_sub(as_date(as_of), days))
    detail = lambda key, default: F.coalesce(
        F.get_json_object("metadata_json", f"$.{key}"), F.lit(default)
    ).alias(key)
    return ledger.filter(declined).select(
        "transaction_id",
        "decline_code",
        detail("card_brand", fv.CARD_BRANDS[0]),
        detail("card_funding", fv.CARD_FUNDING[0]),
        "amount_usd",
        F.hour("occurred_at").alias("occurred_hour"),
        "customer_id",
        "occurred_at",
    )


def retry_outcomes(declined, ledger):
    """What the same customer's payments did in the seven days after each decline.

    The span (t, t + 7 d] is cut at day borders: the rest of the first day, six whole days, and
    the start of the eighth. The days with declines name the eight days they need, and payments
    meet these in one join, so that each crosses the network once and those far from any decline
    go no further. What the whole days hold shrinks to totals. A decline without a customer or a time
    has no outcome.

    The two days of instants are cut into slices of ``SLICE``. A window holds the instants of one slice
    of a customer's day; what its other slices hold comes in as one row, carried over at most as many
    totals as a day has slices. So an account that pools all customers is dealt like the others.
    """
    day, offset = F.to_date("occurred_at"), day_micros("occurred_at")
    known = F.col("customer_id").isNotNull() & day.isNotNull()
    asked = declined.filter(known).select("transaction_id", "customer_id", day.alias("day"), offset.alias("offset"))
    needed = asked.select("customer_id", "day").distinct().select(
        "customer_id", "day", F.explode(F.sequence(F.lit(0), F.lit(WINDOW_DAYS))).alias("later")
    )
    payments = ledger.filter(revenue_type() & known).select(
        "customer_id", day.alias("on"), offset.alias("offset"), "occurred_at",
        settled().cast("int").alias("good"), (F.col("status") == "failed").cast("int").alias("bad"),
    )
    near = payments.join(needed.withColumn("on", F.date_add("day", "later")), ["customer_id", "on"])
    # an offset of -1 holds what the days between come to
    later = F.col("later")
    between = later.between(1, WINDOW_DAYS - 1)
    parts = {"own": later < WINDOW_DAYS, "tail": later == WINDOW_DAYS}
    seen = near.groupBy(
        "customer_id", "day", F.when(between, F.lit(-1).cast("long")).otherwise(F.col("offset")).alias("offset")
    ).agg(
        *[F.sum(F.when(is_, F.col(kind))).alias(f"{part}_{kind}") for kind in ("good", "bad") for part, is_ in parts.items()],
        *[F.min(F.when(is_ & (F.col("good") > 0), F.col("occurred_at"))).alias(f"{part}_at") for part, is_ in parts.items()],
    )
    sliced = lambda rows: rows.withColumn("slice", F.floor(F.col("offset") / F.lit(SLICE)).cast("int"))
    asked, seen = sliced(asked), sliced(seen)

    # a day's slices with what the others hold: later ones of the own day, earlier ones of the last, the days between
    slices = seen.unionByName(asked.select("customer_id", "day", "slice").distinct(), allowMissingColumns=True).groupBy(
        "customer_id", "day", "slice"
    ).agg(
        *[F.sum(f"{part}_{kind}").alias(f"{part}_{kind}") for kind in ("good", "bad") for part in parts],
        *[F.min(f"{part}_at").alias(f"{part}_at") for part in parts],
    )
    of_day = Window.partitionBy("customer_id", "day")
    others = {
        "own": of_day.orderBy("slice").rowsBetween(1, Window.unboundedFollowing),
        "tail": of_day.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1),
    }
    mid = lambda column: F.when(F.col("slice") < 0, F.col(column))
    total = lambda of, frames, kind: sum((F.coalesce(of(f"{p}_{kind}").over(w), F.lit(0)) for p, w in frames.items()), F.lit(0))
    carried = slices.select(
        "customer_id", "day", "slice",
        *[(total(F.sum, others, k) + F.coalesce(F.sum(mid(f"own_{k}")).over(of_day), F.lit(0))).alias(f"other_{k}") for k in ("good", "bad")],
        *[F.min(f"{part}_at").over(w).alias(f"other_{part}_at") for part, w in others.items()],
        F.min(mid("own_at")).over(of_day).alias("other_mid_at"),
    )
    of_slice = Window.partitionBy("customer_id", "day", "slice")
    within = {
        "own": of_slice.orderBy("offset").rangeBetween(1, Window.unboundedFollowing),
        "tail": of_slice.orderBy("offset").rangeBetween(Window.unboundedPreceding, 0),
    }
    found = (
        asked.unionByName(seen, allowMissingColumns=True)
        .select(
            "transaction_id", "customer_id", "day", "slice", *[total(F.sum, within, k).alias(k) for k in ("good", "bad")],
            *[F.min(f"{part}_at").over(w).alias(f"{part}_at") for part, w in within.items()],
        )
        .filter(F.col("transaction_id").isNotNull())
        # every asked slice is carried; an inner join would filter one use of `seen` and so compute it twice, as
        # would sums in another order
        .join(carried, ["customer_id", "day", "slice"], "left")
        .select(
            "transaction_id",
            (F.col("good") + F.col("other_good")).alias("n_successful_retries"),
            (F.col("bad") + F.col("other_bad")).alias("n_failed_retries"),
            # the first day comes before the days between, and these before the last
            F.coalesce("own_at", "other_own_at", "other_mid_at", "other_tail_at", "tail_at").alias("first_success_at"),
        )
    )
    nobody = declined.filter(~known).select(
        "transaction_id",
        F.lit(0).cast("long").alias("n_successful_retries"),
        F.lit(0).cast("long").alias("n_failed_retries"),
        F.lit(None).cast("timestamp_ntz").alias("first_success_at"),
    )
    return found.unionByName(nobody).select(
        "transaction_id",
        (F.col("n_successful_retries") > 0).cast("int").alias("succeeded_on_retry"),
        "first_success_at",
        "n_successful_retries",
        "n_failed_retries",
    )


def customer_history(ledger, since):
    """Declines, successes and mean failed amount per customer since a cutoff column."""
    failed = F.col("status") == "failed"
    return (
        ledger.filter(since & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            count_when(failed & F.col("decline_code").isNotNull()).alias("total_declines_30d"),
            count_when(settled() & revenue_type()).alias("total_successes_30d"),
            (to_usd(cents_sum("amount", failed)) / F.nullif(count_when(failed), F.lit(0)).cast("double")).alias(
                "avg_decline_amount_30d"
            ),
        )
    )


def history_before(ledger, as_of, days=30):
    """History since a number of days before the reference date (training)."""
    return customer_history(ledger, occurred_on_or_after(F.date_sub(as_date(as_of), days)))


def history_of_data(ledger, days=30):
    """History of the last days of recorded data (scoring)."""
    cutoff = latest(ledger, "occurred_at") - F.make_dt_interval(days=F.lit(days))
    return customer_history(ledger, occurred_since(cutoff))


def _with_history(declined, history):
    zero = F.lit(0).cast("long")
    return declined.join(history, "customer_id", "left").withColumns(
        {
            "cust_declines_30d": F.coalesce("total_declines_30d", zero),
            "cust_successes_30d": F.coalesce("total_successes_30d", zero),
            "cust_avg_decline_amt_30d": or_zero("avg_decline_amount_30d"),
        }
    ).drop("total_declines_30d", "total_successes_30d", "avg_decline_amount_30d")


def retry_dataset(ledger, as_of, days=180):
    """Declines with their seven-day outcome and the customer's recent history."""
    declined = declined_events(ledger, as_of, days)
    since = occurred_on_or_after(F.date_sub(as_date(as_of), days))
    outcomes = retry_outcomes(declined, ledger.filter(since))
    rows = _with_history(declined, history_before(ledger, as_of)).join(outcomes, "transaction_id", "left")
    return rows.withColumn("target", F.coalesce("succeeded_on_retry", F.lit(0))).drop("succeeded_on_retry")


def encode_ordinals(df):
    """Fixed ordinal codes; a value outside the list takes the next free code."""
    ordinal = lambda values, column: F.coalesce(
        map_lookup({v: i for i, v in enumerate(values)}, column), F.lit(len(values))
    )
    return df.withColumns(
        {
            "decline_code_enc": ordinal(fv.DECLINE_CODES, "decline_code"),
            "card_brand_enc": ordinal(fv.CARD_BRANDS, "card_brand"),
            "card_funding_enc": ordinal(fv.CARD_FUNDING, "card_funding"),
        }
    )


def exact_quantile(df, column, q, width=100.0):
    """Smallest value with at least a share q of the rows at or below it, in one row.

    Values are counted, then ranked inside ranges of the given width, so that no task holds
    all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("band", F.floor(F.col("v") / width))
    bands = counts.groupBy("band").agg(F.sum("n").alias("m"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bands.select("band", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(offsets, "band").withColumn("rank", F.col("below") + F.sum("n").over(inside))
    total = bands.agg(F.sum("m")).scalar()
    return ranked.filter(F.col("rank") >= total * F.lit(float(q))).agg(F.min("v").alias("quantile"))


def retry_features(df, mode="training", wrap_night=False):
    """Amount, time and customer features.

    A high amount is above the 0.9 quantile in training and above a fixed sum in scoring. The
    night flag tests 22 <= hour <= 6, which never holds; ``wrap_night`` tests 22 to 6 instead.
    """
    if mode == "training":
        high = exact_quantile(df, "amount_usd", fv.TRAINING_HIGH_AMOUNT_QUANTILE).scalar()
    else:
        high = F.lit(fv.SCORING_HIGH_AMOUNT_USD)
    hour, declines, successes = F.col("occurred_hour"), F.col("cust_declines_30d"), F.col("cust_successes_30d")
    night = ((hour >= 22) | (hour <= 6)) if wrap_night else hour.between(22, 6)
    flag = lambda condition: condition.cast("int")
    return df.withColumns(
        {
            "log_amount_usd": F.log1p("amount_usd"),
            "is_high_amount": flag(F.col("amount_usd") > high),
            "hour": hour,
            "is_night": flag(night),
            "is_business_hours": flag(hour.between(9, 17)),
            "has_recent_declines": flag(declines > 0),
            "cust_success_rate_30d": successes.cast("double") / (declines + successes + 1).cast("double"),
            "cust_log_avg_decline_amt": F.log1p("cust_avg_decline_amt_30d"),
            "cust_high_decline_velocity": flag(declines > 3),
        }
    )


FEATURES = [
    "decline_code_enc",
    "card_brand_enc",
    "card_funding_enc",
    "log_amount_usd",
    "is_high_amount",
    "hour",
    "is_night",
    "is_business_hours",
    "cust_declines_30d",
    "cust_successes_30d",
    "cust_log_avg_decline_amt",
    "cust_success_rate_30d",
    "cust_high_decline_velocity",
]


def scoring_rows(ledger, n=100):
    """The n latest declines with history and features, ready to score.

    History is taken for their customers only; at most n ids are broadcast to pick the rows.
    """
    declined = declined_events(ledger).orderBy(F.col("occurred_at").desc(), "transaction_id").limit(n)
    ids = F.broadcast(declined.select("customer_id").distinct())
    since = latest(ledger, "occurred_at") - F.make_dt_interval(days=F.lit(30))
    recent = ledger.filter(occurred_since(since)).join(ids, "customer_id", "left_semi")
    rows = _with_history(declined, customer_history(recent, F.lit(True)))
    return retry_features(encode_ordinals(rows), mode="scoring")


def recommend(scored, scored_at, version="v1", keep=()):
    """Prediction rows from scored declines (column ``probability``); ``keep`` names further columns to carry."""
    at = F.lit(str(scored_at)).cast("timestamp_ntz")
    p = F.col("probability")
    action, retry_at = retry_action(p, at)
    return scored.select(
        "transaction_id",
        "decline_code",
        "card_brand",
        "card_funding",
        or_zero("amount_usd").alias("amount_usd"),
        F.col("occurred_hour").cast("short").alias("occurred_hour"),
        "customer_id",
        F.lit("{}").alias("customer_retry_history"),
        round_half_up(p, 4).alias("retry_success_probability"),
        action.alias("recommended_action"),
        retry_at.alias("recommended_retry_at"),
        round_half_up(p * or_zero("amount_usd"), 2).alias("expected_recovery_usd"),
        F.lit(version).alias("model_version"),
        at.alias("scored_at"),
        *keep,
    )
