"""Receivables report (A1-A10). Inputs named ``aging`` come from ``marts.ar_aging``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import (
    or_zero,
    percent,
    ratio,
    round_half_up,
    usd_sum,
)
from ..functions.rules import ar_severity, map_lookup
from .marts import as_date, days_before, occurred_since

BUCKET_COLUMNS = {key: f"{key}_usd" for key in fv.AGING_BUCKETS}


def _rounded_sum(column):
    return or_zero(round_half_up(F.sum(column), 2))


def ar_summary(aging):
    """Customers, invoices, totals per bucket, overdue balance and shares."""
    sums = aging.agg(
        F.count(F.lit(1)).alias("total_customers_count"),
        F.coalesce(F.sum("invoice_count"), F.lit(0)).alias("total_invoices_count"),
        _rounded_sum("total_outstanding_usd").alias("total_outstanding_usd"),
        *[_rounded_sum(c).alias(c) for c in BUCKET_COLUMNS.values()],
    )
    total = F.col("total_outstanding_usd")
    overdue = round_half_up(total - F.col("current_usd"), 2)
    return sums.withColumns(
        {
            "overdue_usd": overdue,
            "current_pct": percent("current_usd", total),
            "overdue_pct": percent(overdue, total),
            "critical_90_plus_pct": percent("days_90_plus_usd", total),
            "avg_invoice_usd": or_zero(round_half_up(ratio(total, "total_invoices_count"), 2)),
        }
    )


def sales_and_collections(ledger, as_of):
    """Invoiced amount of 90 days and settled invoice amount of 30 days."""
    recent = days_before(as_of, 30)
    invoices = ledger.filter(
        (F.col("type") == "invoice_payment") & occurred_since(days_before(as_of, 90))
    )
    settled = (F.col("status") == "succeeded") & (F.col("occurred_at") >= recent)
    return invoices.agg(
        or_zero(usd_sum("amount")).alias("invoice_sales_90d"),
        or_zero(round_half_up(usd_sum("amount", settled), 2)).alias("collections_30d"),
    )


def collection_efficiency(summary, sales, target=fv.COLLECTIONS_TARGET_30D):
    """Days sales outstanding, best possible, days delinquent, realised share of a target."""
    sold = sales.select("invoice_sales_90d").scalar()
    collected = sales.select("collections_30d").scalar()
    days = lambda balance: or_zero(round_half_up(ratio(balance, sold) * 90.0, 1))
    dso, best = days("total_outstanding_usd"), days("current_usd")
    return summary.select(
        dso.alias("dso_days"),
        best.alias("best_possible_dso_days"),
        round_half_up(dso - best, 1).alias("average_days_delinquent"),
        collected.alias("collections_realized_30d_usd"),
        F.lit(float(target)).alias("collections_target_30d_usd"),
        percent(collected, F.lit(float(target))).alias("collections_realization_rate_pct"),
    )


def _bucket_rows(summary, rates):
    """One row per bucket with its balance and loss provision, from the one-row summary."""
    rows = []
    for position, (key, column) in enumerate(BUCKET_COLUMNS.items()):
        rate = (rates or {}).get(key, fv.AGING_BUCKETS[key][4] / 100.0)
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(key).alias("range_key"),
                F.col(column).alias("amount_usd"),
                F.lit(rate).alias("rate"),
                round_half_up(F.col(column) * rate, 2).alias("loss_provision_usd"),
            )
        )
    return summary.select("total_outstanding_usd", F.inline(F.array(*rows)))


def bad_debt_provision(summary, rates=None):
    """Provision per bucket rate and in total, with the total as a share of the balance."""
    rows = _bucket_rows(summary, rates)
    return rows.agg(
        round_half_up(F.sum("loss_provision_usd"), 2).alias("bad_debt_provision_usd"),
        F.max("total_outstanding_usd").alias("total"),
    ).select("bad_debt_provision_usd", percent("bad_debt_provision_usd", "total").alias("provision_rate_pct"))


def bucket_invoice_counts(aging):
    """Invoices of the customers with a balance in each bucket.

    A customer's whole invoice count is counted in every bucket the customer touches.
    """
    return aging.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(c) > 0, F.col("invoice_count"))), F.lit(0)).alias(f"{key}_invoices")
            for key, c in BUCKET_COLUMNS.items()
        ]
    )


def aging_buckets(aging):
    """One row per bucket: balance, share, invoices, tier, provision and recovery."""
    counts = bucket_invoice_counts(aging)
    rows = _bucket_rows(ar_summary(aging), None)
    key = F.col("range_key")
    attribute = lambda i: map_lookup({k: v[i] for k, v in fv.AGING_BUCKETS.items()}, key)
    invoices = F.coalesce(
        *[F.when(key == k, counts.select(f"{k}_invoices").scalar()) for k in BUCKET_COLUMNS]
    )
    return rows.select(
        attribute(0).alias("bucket"),
        key,
        "amount_usd",
        percent("amount_usd", "total_outstanding_usd").alias("percentage"),
        invoices.alias("invoice_count"),
        attribute(1).alias("risk_tier"),
        attribute(2).alias("severity"),
        attribute(3).alias("status_label"),
        attribute(4).alias("provision_rate_pct"),
        "loss_provision_usd",
        attribute(5).alias("recovery_expectation_pct"),
    )


def top_overdue(aging, n=5):
    """The n customers with the largest 90+ balance."""
    return (
        aging.filter(F.col("days_90_plus_usd") > 0)
        .orderBy(F.col("days_90_plus_usd").desc(), "customer_id")
        .limit(n)
    )


def _account_columns(accounts, customers):
    """Balances with contact columns, for accounts already cut to a top-k list.

    The list's ids (k of them, so safe to broadcast) pick their customers from the dimension.
    """
    listed = F.broadcast(accounts.select("customer_id"))
    contacts = customers.select("customer_id", "customer_email", "plan", "country").join(
        listed, "customer_id", "left_semi"
    )
    joined = accounts.join(contacts, "customer_id", "left")
    money = lambda c, name: or_zero(round_half_up(c, 2)).alias(name)
    plan = F.coalesce("plan", F.lit("standard"))
    return joined.select(
        "customer_id",
        F.coalesce("customer_name", "customer_id").alias("customer_name"),
        F.coalesce("customer_email", F.concat(F.lit("billing@"), "customer_id", F.lit(".com"))).alias("customer_email"),
        F.upper(plan).alias("plan"),
        F.coalesce("country", F.lit("US")).alias("country"),
        F.col("invoice_count").alias("invoices"),
        money("total_outstanding_usd", "total"),
        money("current_usd", "current"),
        money("days_31_60_usd", "days_31_60"),
        money("days_61_90_usd", "days_61_90"),
        money("days_90_plus_usd", "days_90_plus"),
        *[c for c in ("oldest_invoice_date",) if c in accounts.columns],
    )


def high_risk_accounts(aging, customers, as_of, k=8):
    """Accounts with the largest 90+ balances and their dunning stage.

    Days overdue count from the oldest open invoice, so ``aging`` needs ``with_oldest``.
    """
    rows = _account_columns(top_overdue(aging, k), customers)
    balance = F.col("days_90_plus")
    tier = None
    for name, (above, _, _) in fv.HIGH_RISK_STAGES.items():
        tier = F.when(balance > above, name) if tier is None else tier.when(balance > above, name)
    part = lambda i: map_lookup({t: v[i] for t, v in fv.HIGH_RISK_STAGES.items()}, "risk_tier")
    return (
        rows.withColumn("risk_tier", tier)
        .withColumns({"dunning_stage": part(1), "recommended_action": part(2)})
        .withColumn("days_overdue", F.datediff(as_date(as_of), "oldest_invoice_date"))
        .drop("oldest_invoice_date")
        .orderBy(balance.desc(), "customer_id")
    )


def aging_list(aging, customers, n=200):
    """The n largest accounts with severity, dunning stage and credit use."""
    top = aging.drop("oldest_invoice_date").orderBy(
        F.col("total_outstanding_usd").desc(), "customer_id"
    )
    rows = _account_columns(top.limit(n), customers).withColumn("severity", ar_severity(""))
    stage = lambda i: map_lookup({s: v[i] for s, v in fv.SEVERITY_STAGES.items()}, "severity")
    limit = F.coalesce(map_lookup(fv.CREDIT_LIMITS, F.lower("plan")), F.lit(fv.CREDIT_LIMIT_DEFAULT))
    return (
        rows.withColumn("credit_limit", limit)
        .withColumns(
            {
                "credit_utilization": round_half_up(
                    F.least(F.lit(100.0), F.col("total") / F.col("credit_limit") * 100.0), 1
                ),
                "dunning_stage": stage(0),
                "recommended_action": stage(1),
            }
        )
        .orderBy(F.col("total").desc(), "customer_id")
    )


def severity_counts(aging):
    """Accounts per severity class and in all."""
    return (
        aging.groupBy(ar_severity().alias("severity"))
        .agg(F.count(F.lit(1)).alias("accounts"))
        .withColumn("all_accounts", F.sum("accounts").over(Window.partitionBy()))
    )


def search_accounts(aging, customers, text=None, bucket=None, severity=None, n=25):
    """Accounts by bucket, severity class, and text in name, id or email; largest first."""
    rows = aging.join(customers.select("customer_id", "customer_email"), "customer_id", "left")
    if bucket is not None:
        rows = rows.filter(F.col(BUCKET_COLUMNS[bucket]) > 0)
    if severity is not None:
        rows = rows.filter(ar_severity() == severity)
    if text and text.strip():
        needle = F.lit(text.lower())
        rows = rows.filter(
            F.coalesce(F.lower("customer_name").contains(needle), F.lit(False))
            | F.lower("customer_id").contains(needle)
            | F.coalesce(F.lower("customer_email").contains(needle), F.lit(False))
        )
    return (
        rows.withColumn("severity", ar_severity())
        .orderBy(F.col("total_outstanding_usd").desc(), "customer_id")
        .limit(n)
        .select(
            "customer_id",
            "customer_name",
            "customer_email",
            "severity",
            F.col("invoice_count").alias("invoices"),
            round_half_up("total_outstanding_usd", 2).alias("total"),
        )
    )
