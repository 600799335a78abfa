"""Golden values of the derived report figures."""

import pytest
from pyspark.sql import functions as F

from cashlens.functions.labels import label, short_id
from cashlens.functions import money
from cashlens.operators import cashflow, executive, filters, models, ops, receivables, revenue

MONTHS = [
    ("2024-01-01", "subscriptions", 10000.0, 9700.0),
    ("2024-01-01", "ecommerce", 5000.0, 4850.0),
    ("2024-02-01", "subscriptions", 12000.0, 11640.0),
    ("2024-02-01", "ecommerce", 6000.0, 5820.0),
    ("2024-03-01", "subscriptions", 15000.0, 14550.0),
    ("2024-03-01", "ecommerce", 9000.0, 8730.0),
]


@pytest.fixture
def rev(spark):
    df = spark.createDataFrame(MONTHS, "month string, product_line string, revenue_usd double, net_revenue_usd double")
    return df.withColumn("month", F.to_date("month"))


def test_revenue_kpis(rev):
    row = revenue.revenue_kpis(rev).first()
    assert (row.total_revenue, row.net_revenue, row.gross_margin_pct, row.mom_growth_pct) == (57000, 55290, 97, 33)
    one = revenue.revenue_kpis(rev.filter("month = '2024-01-01'")).first()
    assert one.mom_growth_pct == 0
    none = revenue.revenue_kpis(rev.limit(0)).first()
    assert (none.total_revenue, none.gross_margin_pct, none.mom_growth_pct) == (0, 0, 0)


def test_mom_series(rev):
    assert [(r.total, r.mom_growth_pct) for r in revenue.mom_series(rev).collect()] == [
        (15000, None), (18000, 20), (24000, 33)]


def test_product_totals(rev):
    rows = revenue.product_totals(rev).collect()
    assert [(r.product_line, r.label, r.total) for r in rows] == [
        ("subscriptions", "Subscriptions", 37000), ("ecommerce", "Ecommerce", 20000)]
    assert revenue.product_totals(rev, "2024-02").first().total == 12000
    assert revenue.product_totals(rev, "1999-01").first().total == 37000


def test_income_statement(rev):
    rows = revenue.income_statement(rev).collect()
    assert len(rows) == 9 and str(rows[0].month) == "2024-03-01"
    subtotals = [(r.gross, r.net) for r in rows if r.is_subtotal]
    assert subtotals[0] == (24000, 23280) and subtotals[2] == (15000, 14550)


def test_pivot_fills_zero(rev):
    rows = revenue.product_month_pivot(rev.filter("NOT (month = '2024-02-01' AND product_line = 'ecommerce')")).collect()
    assert rows[1].ecommerce == 0.0 and rows[1].subscriptions == 12000


def test_cross_filter(rev):
    rows = filters.cross_filter(rev, month="2024-02", product_line="ecommerce", department=None)
    assert [r.revenue_usd for r in rows.collect()] == [6000]


FAN = [
    ("2026-09-15", 120000.0, 150000.0, 180000.0),
    ("2026-09-22", 125000.0, 160000.0, 195000.0),
    ("2026-09-29", 130000.0, 175000.0, 215000.0),
]
WEEKS = [("2026-08-10", 10000.0), ("2026-08-17", -7000.0), ("2026-08-24", 12000.0), ("2026-08-31", 5000.0)]


def test_cashflow_kpis(spark):
    fan = spark.createDataFrame(FAN, "date string, p10 double, p50 double, p90 double")
    weekly = spark.createDataFrame(WEEKS, "week string, net double")
    assert tuple(cashflow.cashflow_kpis(fan, weekly).first()) == (175000, 85000, 20000, 5000)
    assert tuple(cashflow.cashflow_kpis(fan.limit(0), weekly.limit(0)).first()) == (0, 0, 0, 0)


TREND = [
    ("2026-08-01", 24000000.0, 50000.0, 80000.0, 30000.0),
    ("2026-08-02", 24070000.0, 70000.0, 100000.0, 30000.0),
    ("2026-08-03", 25400120.5, 1330120.5, 1400000.0, 69879.5),
]


def test_executive_kpis(spark):
    trend = spark.createDataFrame(TREND, "date string, cash double, net double, inflows double, outflows double")
    runway = lambda d: spark.createDataFrame([(d,)], "days int")
    row = executive.executive_kpis(trend, runway(240)).first()
    assert (row.net_30d_change, row.total_inflows_30d, row.total_outflows_30d) == (1400120.5, 1580000, 129879.5)
    status = {d: executive.executive_kpis(trend, runway(d)).first().runway_status for d in (200, 180, 120, 90, 60, 0)}
    assert status == {200: "healthy", 180: "healthy", 120: "moderate", 90: "moderate", 60: "critical", 0: "critical"}
    assert executive.executive_kpis(trend.limit(1), runway(1)).first().net_30d_change == 50000


def test_alerts(spark):
    metrics = spark.createDataFrame(
        [(95, 0.0, 20.0, 95.0)],
        "runway_days int, net_margin_pct double, overdue_90plus_pct double, success_rate_pct double",
    )
    got = {r.id: r.type for r in executive.executive_alerts(metrics).collect()}
    assert got == {"runway": "warning", "profitability": "warning", "ar_overdue": "positive", "gateway": "positive"}


def test_ops_kpis(spark):
    declines = spark.createDataFrame(
        [("insufficient_funds", 120), ("do_not_honor", 80), ("card_velocity_exceeded", 30)], "code string, count long")
    trend = spark.createDataFrame([(98.2,), (95.0,), (97.4,), (96.2,)], "rate double")
    advisor = spark.createDataFrame([(78.5, 117.75), (32.0, 25.6), (85.0, 170.0)], "probability double, recovery_usd double")
    disputes = spark.createDataFrame([(350.0,), (125.5,)], "amount_usd double")
    row = ops.ops_kpis(declines, trend, advisor, disputes).first()
    assert tuple(row) == (230, "insufficient funds", 96.7, 313.35, 2, 2, 475.5)
    empty = ops.ops_kpis(declines.limit(0), trend.limit(0), advisor.limit(0), disputes.limit(0)).first()
    assert tuple(empty) == (0, "None", 0, 0, 0, 0, 0)


AGING = "customer_id string, customer_name string, invoice_count long, total_outstanding_usd double, current_usd double, days_31_60_usd double, days_61_90_usd double, days_90_plus_usd double"


@pytest.fixture
def accounts(spark):
    rows = [
        ("1", "A", 1, 50.0, None, None, None, 50.0),
        ("2", "B", 2, 210.0, 10.0, None, None, 200.0),
        ("3", "C", 1, 1.0, None, None, 1.0, None),
        ("4", "D", 1, 7.0, None, 7.0, None, None),
        ("5", "E", 3, 1000.0, 1000.0, None, None, None),
    ]
    return spark.createDataFrame(rows, AGING)


def test_severity_and_overdue(accounts):
    counts = {r.severity: r.accounts for r in receivables.severity_counts(accounts).collect()}
    assert counts == {"critical": 2, "elevated": 1, "moderate": 1, "current": 1}
    assert [r.customer_id for r in receivables.top_overdue(accounts).collect()] == ["2", "1"]
    assert [r.customer_id for r in receivables.top_overdue(accounts, 1).collect()] == ["2"]


def test_ar_summary(accounts):
    row = receivables.ar_summary(accounts).first()
    assert (row.total_outstanding_usd, row.total_invoices_count, row.total_customers_count) == (1268, 8, 5)
    assert (row.days_90_plus_usd, row.overdue_usd, row.critical_90_plus_pct) == (250, 258, 19.7)
    empty = receivables.ar_summary(accounts.limit(0)).first()
    assert (empty.total_outstanding_usd, empty.avg_invoice_usd, empty.overdue_pct) == (0, 0, 0)


def test_buckets(accounts):
    rows = {r.range_key: r for r in receivables.aging_buckets(accounts).collect()}
    assert (rows["current"].invoice_count, rows["days_90_plus"].invoice_count) == (5, 3)
    assert rows["days_90_plus"].loss_provision_usd == 112.5
    assert receivables.bad_debt_provision(receivables.ar_summary(accounts)).first()[0] == 128.15


def test_labels(spark):
    df = spark.createDataFrame([("professional_services", "g&a", "2024-03", "days_31_60")], "p string, d string, m string, b string")
    row = df.select(
        label("product_line", "p"), label("department", "d"), label("month", "m"), label("aging_bucket", "b"),
        label("report_department", "d"), label("department", "p"),
    ).first()
    assert tuple(row) == (
        "Professional Services", "General & Administrative", "March 2024", "31-60 Days Overdue",
        "General & Administrative", "Professional_services")


def test_short_id(spark):
    df = spark.createDataFrame([("txn_demo_82937402948271",), ("txn_12345",), ("",), (None,)], "id string")
    assert [r[0] for r in df.select(short_id("id")).collect()] == ["txn_demo…948271", "txn_12345", "—", "—"]


def test_nothing_falls_outside_the_lists(spark):
    rows = spark.createDataFrame(
        [("2024-01-01", "ecommerce", 5.0), ("2024-01-01", "new line", 2.0), ("2024-01-01", None, 1.0)],
        "month string, product_line string, revenue_usd double",
    )
    row = revenue.product_month_pivot(rows).first()
    assert row["ecommerce"] == 5.0 and row["other"] == 3.0
    trend = spark.createDataFrame([("2024-01-01", "stripe", 90.0), ("2024-01-01", "manual", 80.0)], "date string, source string, rate double")
    row = ops.success_pivot(trend).first()
    assert row["stripe"] == 90.0 and row["other"] == 80.0
    rows = [("2024-01-01", "stripe", 0.9, 9, 10), ("2024-01-01", "new", 0.5, 1, 2), ("2024-01-01", "newer", 1.0, 98, 98), ("2024-01-02", "stripe", 0.5, 1, 2)]
    rates = spark.createDataFrame(rows, "occurred_date string, source string, success_rate double, succeeded_count long, total_transactions long")
    first, second = ops.success_pivot(ops.success_trend(rates, counts=True), ["stripe"]).collect()
    assert first["stripe"] == 90.0 and first["other"] == 99.0 and second["other"] is None


def test_budget_keeps_lines_of_both_sides(spark):
    budget = spark.createDataFrame([("A", "Operating Expenses", 10.0), ("B", "Operating Expenses", 5.0)], "line_item string, category string, budget_usd double")
    actual = spark.createDataFrame([("A", 8.0, "Operating Expenses"), ("C", 3.0, "Operating Expenses")], "line_item string, actual_usd double, category string")
    lines = revenue.budget_vs_actual(actual, budget)
    got = {r.line_item: (r.actual_usd, r.budget_usd, r.category) for r in lines.collect()}
    opex = "Operating Expenses"
    assert got == {"A": (8.0, 10.0, opex), "B": (0.0, 5.0, opex), "C": (3.0, 0.0, opex)}
    assert tuple(revenue.budget_opex_totals(lines).first())[:2] == (11.0, 15.0)
    plain = {r.line_item: r.category for r in revenue.budget_vs_actual(actual.drop("category"), budget).collect()}
    assert plain == {"A": opex, "B": opex, "C": "Unbudgeted"}


def test_a_month_without_net_stays_at_zero(spark):
    rows = spark.createDataFrame([("2024-01-01", 100.0, 0.0), ("2024-02-01", 100.0, None)], "month string, revenue_usd double, net_revenue_usd double")
    got = revenue.performance_trends(rows.withColumn("month", F.col("month").cast("date"))).collect()
    assert [r.cogs for r in got] == [100.0, 100.0]


def test_large_and_small_exchange_rates(spark):
    rows = spark.createDataFrame([(100, 60_000.0), (1_000_000_000_00, 0.000000061), (250, 1.0)], "amount long, fx_rate double")
    assert rows.agg(money.usd_sum("amount")).first()[0] == 60_000.0 + 61.0 + 2.5
    one = rows.filter("fx_rate < 1").select((F.lit(1_000_000_000).cast("long")).alias("amount"), "fx_rate")
    assert one.agg(money.cents_sum("amount")).first()[0] == 61


def test_classifier_metrics_are_exact(spark):
    import random

    rng = random.Random(1)
    rows = [(round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(3000)]
    got = models.classifier_metrics(spark.createDataFrame(rows, "probability double, target int")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    roc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    precision = 0.0
    for p in {p for p, _ in rows}:
        there = sum(y for q, y in rows if q == p)
        precision += there / len(pos) * sum(y for q, y in rows if q >= p) / sum(q >= p for q, _ in rows)
    hit = sum(p >= 0.5 for p in pos)
    told = sum(p >= 0.5 for p, _ in rows)
    assert got.roc_auc == pytest.approx(roc) and got.pr_auc == pytest.approx(precision, abs=1e-6)
    assert (got.precision_1, got.recall_1, got.support_1) == (hit / told, hit / len(pos), len(pos))
    assert got.f1_1 == pytest.approx(2 * hit / (told + len(pos))) and got.support_0 == len(neg)
