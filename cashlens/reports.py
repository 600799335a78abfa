"""The six reports, each a dict of section name to DataFrame.

Inputs are the ledger and its dimensions plus the marts a report leans on; pass marts that were
written once (``session.written``) so that sections share them.
"""

from pyspark.sql import functions as F

from .functions.money import percent
from .operators import cashflow, executive, live, marts, ops, receivables, revenue


def live_report(ledger, as_of, n=20):
    return {
        "kpis": live.live_kpis(ledger),
        "by_source": live.by_source(ledger),
        "last_hour": live.last_hour_counts(ledger, as_of),
        "transactions": live.recent_transactions(ledger, n),
    }


def executive_report(ledger, daily, rates, aging, forecast, as_of):
    trend = executive.cash_trend(daily)
    months = executive.monthly_comparison(ledger)
    financials = executive.financials_window(ledger)
    risk = executive.ar_risk(aging)
    metrics = executive.executive_metrics(daily, forecast, rates, financials, risk)
    runway = executive.latest_value(forecast, "forecast_date", "p50_runway_days", "prediction_date")
    return {
        "current_cash": executive.latest_cash(daily),
        "net_burn_30d": executive.net_burn(daily, as_of),
        "totals": live.ledger_totals(ledger),
        "cash_trend": trend,
        "financials_30d": financials,
        "monthly_comparison": months,
        "revenue_growth": executive.mom_growth(months),
        "ar_risk": risk,
        "disputes_risk": executive.dispute_exposure(marts.disputes(ledger)),
        "alerts": executive.executive_alerts(metrics),
        "kpis": executive.executive_kpis(trend, runway),
    }


def cashflow_report(ledger, daily, forecast):
    """Without any forecast row the fan falls back to the straight-line projection."""
    fan = cashflow.forecast_fan(forecast)
    missing = forecast.agg(F.count(F.lit(1))).scalar() == 0
    fan = fan.unionByName(cashflow.baseline_projection(daily).filter(missing))
    inflows, outflows = cashflow.inflow_breakdown(ledger), cashflow.outflow_breakdown(ledger)
    weekly = cashflow.weekly_flows(daily)
    trend = executive.cash_trend(daily)
    return {
        "forecast": fan,
        "weekly": weekly,
        "flows_30d": cashflow.flow_last_n_days(daily),
        "inflows_breakdown": inflows,
        "outflows_breakdown": outflows,
        "operating_and_free_cash": cashflow.operating_and_free_cash(inflows, outflows),
        "monthly_trends": cashflow.period_trends(daily, "month", 12),
        "quarterly_trends": cashflow.period_trends(daily, "quarter", 6),
        "actual_history_30d": trend,
        "actual_vs_forecast": cashflow.actual_vs_forecast(trend, fan),
        "scenarios": cashflow.scenarios(fan, forecast, daily),
        "kpis": cashflow.cashflow_kpis(fan, weekly),
    }


def revenue_report(ledger, customers, daily, products, budget=None):
    """``budget`` holds line_item, category, budget_usd; without it there is no budget section."""
    summary = revenue.financial_summary(products)
    departments = revenue.expenses_by_department(ledger)
    trends = revenue.performance_trends(products)
    growth = executive.mom_growth(trends, "gross_revenue")
    opex = departments.agg(F.sum("amount_usd")).scalar()
    sections = {
        "revenue_by_product": revenue.revenue_listing(products),
        "monthly_pl": revenue.pl_listing(marts.monthly_pl(ledger)),
        "financial_summary": summary.withColumns(
            {
                "operating_expenses_ttm": opex,
                "mom_growth_pct": growth.scalar(),
                "cash_flow_net_30d": cashflow.flow_last_n_days(daily).select("net_cash_flow").scalar(),
            }
        ),
        "revenue_by_customer_tier": revenue.revenue_by_tier(ledger, customers),
        "top_customers": revenue.top_customers(ledger, customers),
        "expenses_by_department": departments,
        "financial_performance_trends": trends,
        "forecasting": revenue.forward_quarters(summary),
        "income_statement": revenue.income_statement(products),
        "kpis": revenue.revenue_kpis(products),
    }
    if budget is not None:
        line = lambda name, column, category: F.struct(
            F.lit(name).alias("line_item"), F.col(column).alias("actual_usd"), F.lit(category).alias("category")
        )
        gross = line("Gross Invoiced Revenue", "total_revenue_ttm", "Revenue")
        costs = line("COGS & Interchange Fees", "total_cogs", "Direct Costs")
        spent = departments.select(
            F.col("department").alias("line_item"), F.col("amount_usd").alias("actual_usd"), F.lit("Operating Expenses").alias("category")
        )
        actuals = summary.select(F.inline(F.array(gross, costs))).unionByName(spent)
        lines = revenue.budget_vs_actual(actuals, budget)
        sections |= {"budget_vs_actual": lines, "budget_totals": revenue.budget_opex_totals(lines)}
    return sections


def ops_report(ledger, rates, predictions):
    analysis, trend = marts.decline_analysis(ledger), ops.success_trend(rates)
    open_disputes = marts.disputes(ledger)
    monitoring = ops.transaction_monitoring(ledger)
    return {
        "success_trend": trend,
        "declines": ops.top_declines(analysis),
        "retry_advisor": ops.retry_advisor(predictions),
        "disputes": ops.dispute_list(open_disputes),
        "transaction_monitoring": monitoring,
        "gateways": ops.gateway_metrics(ledger),
        "risk_counts": ops.risk_counts(ledger),
        "dispute_rate": ops.dispute_rate_bps(monitoring),
        "dispute_outcomes": ops.dispute_outcomes(open_disputes),
        "retry_summary": ops.retry_summary(predictions),
        "kpis": ops.ops_kpis(ops.decline_counts(analysis), trend, ops.advisor_rows(predictions), open_disputes),
    }


def receivables_report(ledger, customers, aging, as_of):
    """``aging`` needs the oldest invoice date (``marts.ar_aging(..., with_oldest=True)``)."""
    summary = receivables.ar_summary(aging)
    provision = receivables.bad_debt_provision(summary)
    cost = provision.select("bad_debt_provision_usd").scalar()
    return {
        "summary": summary.withColumns(
            {"bad_debt_provision_usd": cost, "provision_rate_pct": percent(cost, "total_outstanding_usd")}
        ),
        "buckets": receivables.aging_buckets(aging),
        "collection_efficiency": receivables.collection_efficiency(
            summary, receivables.sales_and_collections(ledger, as_of)
        ),
        "high_risk_accounts": receivables.high_risk_accounts(aging, customers, as_of),
        "aging": receivables.aging_list(aging, customers),
        "severity_counts": receivables.severity_counts(aging),
        "top_overdue": receivables.top_overdue(aging),
    }
