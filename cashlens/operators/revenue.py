"""Revenue and finance report."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.labels import label
from ..functions.money import (
    cents_sum,
    or_zero,
    percent,
    ratio,
    round_half_up,
    round_toward_plus,
    to_usd,
    usd_sum,
)
from .marts import revenue_type, settled


def _money(column, name):
    return or_zero(round_half_up(column, 2)).alias(name)


def revenue_listing(revenue):
    """Revenue by month and product, newest month first."""
    return revenue.select(
        "month",
        "product_line",
        _money("revenue_usd", "revenue"),
        _money("net_revenue_usd", "net_revenue"),
    ).orderBy(F.col("month").desc(), "product_line")


def pl_listing(pl):
    """Net by month and account, newest month first."""
    return pl.select("month", "account_code", _money("net_usd", "net")).orderBy(
        F.col("month").desc(), "account_code"
    )


def financial_summary(revenue):
    """Gross, net, costs, operating income and net profit with margins."""
    sums = revenue.agg(
        or_zero(F.sum("revenue_usd")).alias("gross"), or_zero(F.sum("net_revenue_usd")).alias("net")
    )
    gross, net = F.col("gross"), F.col("net")
    operating = round_half_up(net - gross * fv.OPEX_RATE, 2)
    profit = round_half_up(operating * fv.AFTER_TAX_RATE, 2)
    return sums.select(
        round_half_up(gross, 2).alias("total_revenue_ttm"),
        round_half_up(net, 2).alias("net_revenue_ttm"),
        round_half_up(gross - net, 2).alias("total_cogs"),
        operating.alias("operating_income_ttm"),
        profit.alias("net_profit_ttm"),
        percent(net, gross).alias("gross_margin_pct"),
        percent(operating, gross).alias("operating_margin_pct"),
        percent(profit, gross).alias("net_margin_pct"),
    )


def expenses_by_department(ledger):
    """Expense by department, whatever the status, with shares."""
    sums = (
        ledger.filter(F.col("type").isin(fv.EXPENSE_TYPES))
        .groupBy(F.coalesce("department", F.lit("operations")).alias("dept"))
        .agg(round_half_up(usd_sum("amount"), 2).alias("amount_usd"))
    )
    return sums.select(
        label("report_department", "dept").alias("department"),
        F.lower("dept").alias("key"),
        "amount_usd",
        percent("amount_usd", F.sum("amount_usd").over(Window.partitionBy())).alias("percentage"),
    ).orderBy(F.col("amount_usd").desc(), "key")


def _revenue_per_customer(ledger):
    """Settled revenue in one row per customer, so the dimension join moves customers only."""
    return (
        ledger.filter(revenue_type() & settled() & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(cents_sum("amount").alias("cents"), F.count(F.lit(1)).alias("transactions"))
    )


def revenue_by_tier(ledger, customers):
    """Settled revenue, customers and transactions by plan, with shares."""
    joined = _revenue_per_customer(ledger).join(customers.select("customer_id", "plan"), "customer_id")
    sums = joined.groupBy(F.coalesce("plan", F.lit("standard")).alias("tier_key")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        round_half_up(to_usd(F.sum("cents")), 2).alias("total_revenue"),
        F.sum("transactions").alias("transactions_count"),
    )
    return sums.select(
        label("report_tier", "tier_key").alias("tier"),
        F.lower("tier_key").alias("plan_key"),
        "customer_count",
        "total_revenue",
        percent("total_revenue", F.sum("total_revenue").over(Window.partitionBy())).alias("percentage"),
        "transactions_count",
    ).orderBy(F.col("total_revenue").desc(), "plan_key")


def top_customers(ledger, customers, k=6):
    """The k customers with the most settled revenue."""
    joined = _revenue_per_customer(ledger).join(
        customers.select("customer_id", "customer_name", "plan", "country"), "customer_id"
    )
    return (
        joined.groupBy("customer_name", "plan", "country")
        .agg(
            round_half_up(to_usd(F.sum("cents")), 2).alias("total_revenue"),
            F.sum("transactions").alias("transactions_count"),
        )
        .orderBy(F.col("total_revenue").desc(), "customer_name", "plan", "country")
        .limit(k)
        .select(
            F.col("customer_name").alias("name"),
            label("report_tier", "plan").alias("tier"),
            "country",
            "total_revenue",
            "transactions_count",
        )
    )


def performance_trends(revenue, n=12):
    """Gross, costs, operating expense and income of the last n months, oldest first."""
    months = (
        revenue.groupBy(F.date_format("month", "yyyy-MM").alias("month"))
        .agg(_money(F.sum("revenue_usd"), "gross"), round_half_up(F.sum("net_revenue_usd"), 2).alias("net"))
        .orderBy(F.col("month").desc())
        .limit(n)
    )
    gross = F.col("gross")
    net = or_zero("net")
    opex = round_half_up(gross * fv.OPEX_RATE, 2)
    income = round_half_up(net - opex, 2)
    return months.select(
        "month",
        gross.alias("gross_revenue"),
        round_half_up(gross - net, 2).alias("cogs"),
        opex.alias("operating_expenses"),
        income.alias("operating_income"),
        percent(income, gross).alias("operating_margin_pct"),
    ).orderBy("month")


def mom_series(revenue):
    """Monthly totals with whole-percent growth; the first month has none."""
    months = revenue.groupBy("month").agg(_money(F.sum("revenue_usd"), "total"))
    before = F.lag("total").over(Window.orderBy("month"))
    growth = F.when(before > 0, round_toward_plus((F.col("total") - before) / before * 100.0)).when(
        before.isNotNull(), 0.0
    )
    return months.select("month", "total", growth.alias("mom_growth_pct")).orderBy("month")


def product_totals(revenue, month=None):
    """Revenue by product, most first; for one month (yyyy-MM) when it has rows."""
    rows = revenue
    if month is not None:
        hit = F.date_format("month", "yyyy-MM") == month
        found = revenue.agg(F.count_if(hit)).scalar()
        rows = revenue.filter(hit | (found == 0))
    return (
        rows.groupBy("product_line")
        .agg(or_zero(round_toward_plus(F.sum(or_zero("revenue_usd")), 2)).alias("total"))
        .select("product_line", label("product_line", "product_line").alias("label"), "total")
        .orderBy(F.col("total").desc(), "product_line")
    )


def income_statement(revenue):
    """Product rows and a subtotal per month, newest month first."""
    return (
        revenue.groupingSets([["month", "product_line"], ["month"]], "month", "product_line")
        .agg(
            F.grouping("product_line").cast("int").alias("is_subtotal"),
            _money(F.sum("revenue_usd"), "gross"),
            _money(F.sum("net_revenue_usd"), "net"),
        )
        .orderBy(F.col("month").desc(), "is_subtotal", "product_line")
    )


def product_month_pivot(revenue, products=fv.PRODUCT_LINES):
    """Month by product matrix of revenue, 0 where a product has none; products not listed add up to ``other``."""
    column = F.when(F.col("product_line").isin(*products), F.col("product_line")).otherwise("other")
    pivot = revenue.withColumn("_column", column).groupBy("month").pivot("_column", [*products, "other"])
    return pivot.agg(round_half_up(F.sum("revenue_usd"), 2)).na.fill(0.0).orderBy("month")


def budget_vs_actual(actuals, budget):
    """Actuals (line_item, actual_usd) against budget rows (line_item, category, budget_usd).

    Lines of either side stay: what was not planned has budget 0 and the category that the actuals
    name, or ``Unbudgeted``; what was not spent has actual 0.
    """
    told = F.col("_category") if "category" in actuals.columns else F.lit(None).cast("string")
    if "category" in actuals.columns:
        actuals = actuals.withColumnRenamed("category", "_category")
    joined = budget.join(actuals, "line_item", "full")
    rows = joined.withColumn("category", F.coalesce("category", told, F.lit("Unbudgeted"))).withColumns(
        {
            "actual_usd": or_zero(round_half_up("actual_usd", 2)),
            "budget_usd": or_zero(round_half_up("budget_usd", 2)),
        }
    )
    actual, planned, category = F.col("actual_usd"), F.col("budget_usd"), F.col("category")
    variance = F.when(category == "Direct Costs", planned - actual).otherwise(actual - planned)
    good = F.when(category == "Revenue", actual >= planned).otherwise(actual <= planned)
    return rows.select(
        "line_item",
        "category",
        "actual_usd",
        "budget_usd",
        round_half_up(variance, 2).alias("variance_usd"),
        percent(actual - planned, planned).alias("variance_pct"),
        F.when(good, "favorable").otherwise("unfavorable").alias("status"),
    )


def budget_opex_totals(lines):
    """Operating-expense totals of the budget table; a positive variance is under budget."""
    opex = lines.filter(F.col("category") == "Operating Expenses").agg(
        or_zero(F.sum("actual_usd")).alias("actual"), or_zero(F.sum("budget_usd")).alias("planned")
    )
    return opex.select(
        round_half_up("actual", 2).alias("total_actual_opex"),
        round_half_up("planned", 2).alias("total_budget_opex"),
        round_half_up(F.col("planned") - F.col("actual"), 2).alias("opex_variance"),
    )


def forward_quarters(summary, rates=None):
    """Projected revenue and income of the coming quarters from the average quarter."""
    quarter = round_half_up(F.col("total_revenue_ttm") / 4.0, 2)
    margin = F.col("operating_margin_pct") / 100.0
    rows = [
        F.struct(
            F.lit(name).alias("quarter"),
            round_half_up(quarter * rate, 2).alias("projected_revenue"),
            round_half_up(quarter * rate * margin, 2).alias("projected_income"),
        )
        for name, rate in (rates or fv.FORWARD_QUARTER_RATES).items()
    ]
    return summary.select(F.inline(F.array(*rows)))


def revenue_kpis(revenue):
    """Headline figures recomputed over whatever rows a filter left, in whole percents."""
    sums = revenue.agg(
        or_zero(round_half_up(F.sum("revenue_usd"), 2)).alias("gross"),
        or_zero(round_half_up(F.sum("net_revenue_usd"), 2)).alias("net"),
    )
    latest_growth = mom_series(revenue).agg(F.max_by(F.struct("mom_growth_pct"), "month").alias("g"))
    gross, net = F.col("gross"), F.col("net")
    operating = net - gross * fv.OPEX_RATE
    whole_pct = lambda part: or_zero(round_toward_plus(ratio(part, gross) * 100.0))
    return sums.select(
        gross.alias("total_revenue"),
        net.alias("net_revenue"),
        whole_pct(net).alias("gross_margin_pct"),
        or_zero(latest_growth.select("g.mom_growth_pct").scalar()).alias("mom_growth_pct"),
        round_toward_plus(gross * fv.OPEX_RATE).alias("operating_expenses"),
        round_toward_plus(operating).alias("operating_income"),
        round_toward_plus(operating * fv.AFTER_TAX_RATE).alias("net_profit"),
        whole_pct(operating).alias("operating_margin_pct"),
        whole_pct(operating * fv.AFTER_TAX_RATE).alias("net_margin_pct"),
    )


