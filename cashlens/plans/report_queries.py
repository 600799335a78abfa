"""Registered queries of the marts and reports (V, L, E, C, R, O, A, X)."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import cashflow, executive, filters, live, marts, ops, receivables, revenue
from ..sources.tables import AS_OF
from . import inputs
from .inputs import aging, daily, disputes, forecast, predictions, rates
from .inputs import revenue as product_revenue
from .registry import query
from .views import REV_OK, js, labelled, pct, rnd, title, usd

# --- marts ---------------------------------------------------------------------------------
query("daily_cash_position", "SELECT * FROM daily")(lambda w: marts.daily_cash_position(w.ledger))
query("monthly_pl", "SELECT * FROM pl")(lambda w: marts.monthly_pl(w.ledger))
query("revenue_by_product", "SELECT * FROM rev")(lambda w: marts.revenue_by_product(w.ledger))
query("success_rate_daily", "SELECT * FROM rates")(lambda w: marts.success_rate_daily(w.ledger))
query("decline_analysis", "SELECT * FROM declines")(lambda w: marts.decline_analysis(w.ledger))
query("disputes", "SELECT * FROM open_disputes")(disputes)
query("latest_forecast", "SELECT * FROM snapshot")(lambda w: marts.latest_forecast(forecast(w)))
query("ar_aging", "SELECT * FROM aging")(lambda w: marts.ar_aging(w.ledger, w.customers, w.as_of))

# --- live ----------------------------------------------------------------------------------
query(
    "recent_transactions",
    """SELECT transaction_id, occurred_at, type, status, source, amount_usd, net_amount_usd, fee_amount_usd,
      currency, product_line, description, decline_code, ingested_at
    FROM ledger ORDER BY ingested_at DESC NULLS FIRST, transaction_id LIMIT 20""",
)(lambda w: live.recent_transactions(w.ledger))
query(
    "ledger_totals",
    "SELECT COUNT(*) AS total_transactions, MAX(ingested_at) AS last_ingested FROM ledger",
)(lambda w: live.ledger_totals(w.ledger))
_TODAY = f"""SELECT COUNT(*) AS volume, COALESCE({usd("SUM(amount)")}, 0) AS total_usd,
      COALESCE(CAST(COUNT(*) FILTER (WHERE status = 'succeeded') AS DOUBLE) / NULLIF(COUNT(*), 0), 0) AS success_rate
    FROM ledger WHERE occurred_date = (SELECT MAX(occurred_date) FROM ledger)"""
query("latest_day_stats", _TODAY)(lambda w: live.latest_day_stats(w.ledger))
query(
    "by_source",
    f"""SELECT source, n AS transactions, {pct("n", "MAX(n) OVER ()")} AS share_of_max_pct
    FROM (SELECT source, COUNT(*) AS n FROM ledger GROUP BY 1)""",
)(lambda w: live.by_source(w.ledger))
query(
    "last_hour_counts",
    f"""SELECT source, status, COUNT(*) AS transactions FROM ledger
    WHERE occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR GROUP BY 1, 2""",
)(lambda w: live.last_hour_counts(w.ledger, w.as_of))
query(
    "live_kpis",
    f"""SELECT (SELECT COUNT(*) FROM ledger) AS total_transactions, volume AS today_volume,
      {rnd("total_usd", 2)} AS today_total_usd, {rnd("success_rate * 100.0", 1)} AS live_success_rate,
      (SELECT MAX(ingested_at) FROM ledger) AS last_ingested,
      (SELECT COUNT(*) FROM ledger WHERE source = 'stripe') AS stripe_transactions
    FROM ({_TODAY})""",
)(
    lambda w: live.live_kpis(w.ledger)
    .withColumn("stripe_transactions", F.try_element_at("by_source", F.lit("stripe")))
    .drop("by_source")
)

# --- executive -----------------------------------------------------------------------------
query(
    "latest_cash",
    f"SELECT {rnd('cumulative_cash_usd', 2)} AS current_cash FROM daily ORDER BY date DESC NULLS FIRST LIMIT 1",
)(lambda w: executive.latest_cash(daily(w)))
query(
    "latest_value",
    "SELECT success_rate FROM rates ORDER BY occurred_date DESC, source LIMIT 1",
)(lambda w: executive.latest_value(rates(w), "occurred_date", "success_rate", "source"))
query(
    "net_burn",
    f"""SELECT COALESCE({rnd("SUM(outflows_usd) / 30.0", 2)}, 0) AS net_burn FROM daily
    WHERE date >= DATE '{AS_OF}' - 30""",
)(lambda w: executive.net_burn(daily(w), w.as_of))
_TREND = f"""SELECT date, {rnd("cumulative_cash_usd", 2)} AS cash, {rnd("net_flow_usd", 2)} AS net,
      {rnd("inflows_usd", 2)} AS inflows, {rnd("outflows_usd", 2)} AS outflows
    FROM daily ORDER BY date DESC NULLS FIRST LIMIT 30"""
query("cash_trend", _TREND)(lambda w: executive.cash_trend(daily(w)))
_PROFIT = f"""COALESCE({usd(f"SUM(amount) FILTER (WHERE {REV_OK})")}, 0) AS revenue,
      COALESCE({usd("SUM(amount) FILTER (WHERE type IN ('payout', 'fee', 'refund') AND status = 'succeeded')")}, 0) AS expenses,
      COALESCE({usd("SUM(fee_amount) FILTER (WHERE status = 'succeeded')")}, 0) AS fees,
      COALESCE({usd("SUM(net_amount) FILTER (WHERE status = 'succeeded')")}, 0) AS net"""
_FINANCIALS = f"""SELECT {rnd("revenue", 2)} AS total_revenue, {rnd("expenses", 2)} AS total_expenses,
      {rnd("fees", 2)} AS total_fees, {rnd("net", 2)} AS net_profit,
      {pct("(revenue - fees)", "revenue")} AS gross_margin_pct, {pct("net", "revenue")} AS net_margin_pct
    FROM (SELECT {_PROFIT} FROM ledger
      WHERE occurred_at >= (SELECT MAX(occurred_at) FROM ledger) - INTERVAL 30 DAY)"""
query("financials_window", _FINANCIALS)(lambda w: executive.financials_window(w.ledger))
_MONTHS = f"""SELECT month, {rnd("revenue", 2)} AS revenue, {rnd("expenses", 2)} AS expenses,
      {rnd("net", 2)} AS net_profit, {pct("net", "revenue")} AS margin_pct
    FROM (SELECT strftime(occurred_at, '%Y-%m') AS month, {_PROFIT} FROM ledger GROUP BY 1)
    ORDER BY month DESC LIMIT 6"""
query("monthly_comparison", _MONTHS)(lambda w: executive.monthly_comparison(w.ledger))
query(
    "mom_growth",
    f"""SELECT COALESCE({rnd("(revenue - before) / before * 100.0", 1)}, 0) AS mom_growth_pct
    FROM (SELECT month, revenue, LAG(revenue) OVER (ORDER BY month) AS before FROM ({_MONTHS}))
    ORDER BY month DESC LIMIT 1""",
)(lambda w: executive.mom_growth(executive.monthly_comparison(w.ledger)))
_RISK = f"""SELECT {rnd("SUM(total_outstanding_usd)", 2)} AS total_outstanding_usd,
      {rnd("SUM(days_90_plus_usd)", 2)} AS overdue_90plus_usd,
      {pct("SUM(days_90_plus_usd)", "SUM(total_outstanding_usd)")} AS overdue_90plus_pct FROM aging"""
query("ar_risk", _RISK)(lambda w: executive.ar_risk(aging(w)))
query(
    "dispute_exposure",
    f"SELECT COUNT(*) AS dispute_count, {rnd('SUM(amount_usd)', 2)} AS dispute_amount_usd FROM open_disputes",
)(lambda w: executive.dispute_exposure(disputes(w)))


def _metrics(w):
    return executive.executive_metrics(
        daily(w), forecast(w), rates(w), executive.financials_window(w.ledger), executive.ar_risk(aging(w))
    )


_RUNWAY = "(SELECT p50_runway_days FROM snapshot ORDER BY prediction_date LIMIT 1)"
_METRICS = f"""SELECT {_RUNWAY} AS runway_days, net_margin_pct,
      (SELECT overdue_90plus_pct FROM ({_RISK})) AS overdue_90plus_pct,
      (SELECT {rnd("success_rate * 100.0", 1)} FROM rates ORDER BY occurred_date DESC, source LIMIT 1) AS success_rate_pct
    FROM ({_FINANCIALS})"""
query("executive_metrics", _METRICS)(_metrics)
query(
    "executive_alerts",
    f"""WITH m AS ({_METRICS})
    SELECT 'runway' AS id, CASE WHEN runway_days >= 180 THEN 'positive' WHEN runway_days >= 90 THEN 'warning' ELSE 'danger' END AS type,
      CASE WHEN runway_days >= 180 THEN 'Healthy Runway Buffer' WHEN runway_days >= 90 THEN 'Moderate Runway Watch' ELSE 'Runway Warning' END AS title FROM m
    UNION ALL SELECT 'profitability', CASE WHEN net_margin_pct >= 20 THEN 'positive' WHEN net_margin_pct > 0 THEN 'info' ELSE 'warning' END,
      CASE WHEN net_margin_pct >= 20 THEN 'Strong Net Operating Margins' WHEN net_margin_pct > 0 THEN 'Positive Operating Cash' ELSE 'Net Operating Deficit' END FROM m
    UNION ALL SELECT 'ar_overdue', CASE WHEN overdue_90plus_pct > 20 THEN 'warning' ELSE 'positive' END,
      CASE WHEN overdue_90plus_pct > 20 THEN 'Elevated AR Delinquency' ELSE 'Low Receivables Risk' END FROM m
    UNION ALL SELECT 'gateway', CASE WHEN success_rate_pct >= 95 THEN 'positive' ELSE 'warning' END,
      CASE WHEN success_rate_pct >= 95 THEN 'Optimal Payment Routing' ELSE 'Elevated Card Declines' END FROM m""",
)(lambda w: executive.executive_alerts(_metrics(w)))
query(
    "executive_kpis",
    f"""WITH t AS ({_TREND})
    SELECT {rnd("(SELECT cash FROM t ORDER BY date DESC NULLS FIRST LIMIT 1) - (SELECT cash FROM t ORDER BY date ASC NULLS LAST LIMIT 1)", 2)} AS net_30d_change,
      {rnd("(SELECT SUM(inflows) FROM t)", 2)} AS total_inflows_30d, {rnd("(SELECT SUM(outflows) FROM t)", 2)} AS total_outflows_30d,
      {_RUNWAY} AS runway_days,
      CASE WHEN {_RUNWAY} >= 180 THEN 'healthy' WHEN {_RUNWAY} >= 90 THEN 'moderate' ELSE 'critical' END AS runway_status""",
)(
    lambda w: executive.executive_kpis(
        executive.cash_trend(daily(w)),
        executive.latest_value(forecast(w), "forecast_date", "p50_runway_days", "prediction_date"),
    )
)

# --- cash flow -----------------------------------------------------------------------------
_FAN = f"""SELECT prediction_date AS date, {rnd("p10_cumulative_cash_usd", 2)} AS p10,
      {rnd("p50_cumulative_cash_usd", 2)} AS p50, {rnd("p90_cumulative_cash_usd", 2)} AS p90,
      {rnd("p50_inflows_usd", 2)} AS inflows, {rnd("p50_outflows_usd", 2)} AS outflows FROM snapshot"""
query("forecast_fan", _FAN)(lambda w: cashflow.forecast_fan(forecast(w)))
_WEEKS = f"""SELECT CAST(date_trunc('week', date) AS DATE) AS week, {rnd("SUM(inflows_usd)", 2)} AS inflows,
      {rnd("SUM(outflows_usd)", 2)} AS outflows, {rnd("SUM(net_flow_usd)", 2)} AS net
    FROM daily GROUP BY 1 ORDER BY week DESC NULLS FIRST LIMIT 12"""
query("weekly_flows", _WEEKS)(lambda w: cashflow.weekly_flows(daily(w)))
query(
    "flow_last_n_days",
    f"""SELECT {rnd("SUM(inflows_usd)", 2)} AS inflows, {rnd("SUM(outflows_usd)", 2)} AS outflows,
      {rnd("SUM(net_flow_usd)", 2)} AS net_cash_flow
    FROM (SELECT * FROM daily ORDER BY date DESC NULLS FIRST LIMIT 30)""",
)(lambda w: cashflow.flow_last_n_days(daily(w)))
_SINCE = "occurred_date >= (SELECT MAX(occurred_date) - 30 FROM ledger)"
_INFLOW = f"""SELECT product, {title("product", fv.PRODUCT_LINES)} AS category, amount,
      {pct("amount", "SUM(amount) OVER ()")} AS percentage
    FROM (SELECT COALESCE(product_line, 'Direct Payments') AS product, {rnd(usd("SUM(amount)"), 2)} AS amount
      FROM ledger WHERE {REV_OK} AND {_SINCE} GROUP BY 1)"""
_OUTFLOW = f"""SELECT type, {labelled(fv.OUTFLOW_LABELS, "type", "type")} AS category, amount,
      {pct("amount", "SUM(amount) OVER ()")} AS percentage
    FROM (SELECT type, {rnd(usd("SUM(amount)"), 2)} AS amount FROM ledger
      WHERE type IN ('refund', 'fee', 'payout', 'transfer', 'adjustment') AND {_SINCE} GROUP BY 1)"""
query("inflow_breakdown", _INFLOW)(lambda w: cashflow.inflow_breakdown(w.ledger))
query("outflow_breakdown", _OUTFLOW)(lambda w: cashflow.outflow_breakdown(w.ledger))
query(
    "operating_and_free_cash",
    f"""SELECT {rnd("i - f", 2)} AS operating_cash_flow, {rnd("i - f - p", 2)} AS free_cash_flow
    FROM (SELECT (SELECT SUM(amount) FROM ({_INFLOW})) AS i,
      SUM(amount) FILTER (WHERE type IN ('fee', 'refund')) AS f,
      SUM(amount) FILTER (WHERE type IN ('payout', 'transfer')) AS p FROM ({_OUTFLOW}))""",
)(
    lambda w: cashflow.operating_and_free_cash(
        cashflow.inflow_breakdown(w.ledger), cashflow.outflow_breakdown(w.ledger)
    )
)
for _name, _period, _n, _text in (
    ("monthly_trends", "month", 12, "strftime(date, '%Y-%m')"),
    ("quarterly_trends", "quarter", 6, "year(date) || '-Q' || quarter(date)"),
):
    query(
        _name,
        f"""SELECT {_text} AS period, {rnd("SUM(inflows_usd)", 2)} AS inflows, {rnd("SUM(outflows_usd)", 2)} AS outflows,
          {rnd("SUM(net_flow_usd)", 2)} AS net_flow,
          {rnd("array_agg(cumulative_cash_usd ORDER BY date DESC)[1]", 2)} AS ending_cash
        FROM daily GROUP BY 1 ORDER BY period DESC NULLS FIRST LIMIT {_n}""",
    )(lambda w, period=_period, n=_n: cashflow.period_trends(daily(w), period, n))
query(
    "baseline_projection",
    f"""SELECT last_date + CAST(d AS INTEGER) AS date, {rnd("p50 - cone", 2)} AS p10, {rnd("p50", 2)} AS p50,
      {rnd("p50 + cone", 2)} AS p90, {rnd("i", 2)} AS inflows, {rnd("o", 2)} AS outflows
    FROM (SELECT *, abs(p50) * 0.015 * (d / 14.0) AS cone
      FROM (SELECT *, cash + d * flow AS p50
        FROM (SELECT MAX(date) AS last_date, arg_max(cumulative_cash_usd, date) AS cash, AVG(inflows_usd) AS i,
            AVG(outflows_usd) AS o, AVG(net_flow_usd) AS flow
          FROM (SELECT * FROM daily WHERE date IS NOT NULL ORDER BY date DESC LIMIT 30)), range(1, 92) r(d)))""",
)(lambda w: cashflow.baseline_projection(daily(w)))
_CASES = " UNION ALL ".join(
    f"""SELECT '{name}' AS scenario, '{text}' AS label, {q}_runway AS runway_days, {q} AS ending_cash_90d,
      {rnd(f"{q} - start", 2)} AS net_change_90d, {rnd(f"({q} - start) / 90.0", 2)} AS daily_burn_or_growth FROM e"""
    for name, (q, text, _) in fv.SCENARIOS.items()
)
query(
    "scenarios",
    f"""WITH e AS (SELECT f.*, s.starting_cash_usd AS start, s.p10_runway_days AS p10_runway,
      s.p50_runway_days AS p50_runway, s.p90_runway_days AS p90_runway
      FROM (SELECT * FROM ({_FAN}) ORDER BY date DESC LIMIT 1) f,
      (SELECT * FROM snapshot ORDER BY prediction_date LIMIT 1) s) {_CASES}""",
)(lambda w: cashflow.scenarios(cashflow.forecast_fan(forecast(w)), forecast(w), daily(w)))
query(
    "cashflow_kpis",
    f"""SELECT last.p50 AS projected_ending_cash, GREATEST(0.0, {js("last.p90 - last.p10", 2)}) AS confidence_spread,
      net AS historical_12w_net, {js("net / weeks", 2)} AS avg_weekly_net
    FROM (SELECT * FROM ({_FAN}) ORDER BY date DESC LIMIT 1) last,
      (SELECT {js("SUM(net)", 2)} AS net, COUNT(*) AS weeks FROM ({_WEEKS}))""",
)(lambda w: cashflow.cashflow_kpis(cashflow.forecast_fan(forecast(w)), cashflow.weekly_flows(daily(w))))
query(
    "actual_vs_forecast",
    f"""WITH t AS ({_TREND}), n AS (SELECT *, row_number() OVER (ORDER BY date DESC NULLS FIRST) AS back FROM t)
    SELECT date, 'actual' AS series, cash AS actual, CASE WHEN back = 1 THEN cash END AS p10,
      CASE WHEN back = 1 THEN cash END AS p50, CASE WHEN back = 1 THEN cash END AS p90 FROM n
    UNION ALL SELECT date, 'forecast', NULL, p10, p50, p90 FROM ({_FAN})""",
)(lambda w: cashflow.actual_vs_forecast(executive.cash_trend(daily(w)), cashflow.forecast_fan(forecast(w))))

# --- revenue -------------------------------------------------------------------------------
query(
    "revenue_listing",
    f"""SELECT month, product_line, COALESCE({rnd("revenue_usd", 2)}, 0) AS revenue,
      COALESCE({rnd("net_revenue_usd", 2)}, 0) AS net_revenue FROM rev""",
)(lambda w: revenue.revenue_listing(product_revenue(w)))
query("pl_listing", f"SELECT month, account_code, {rnd('net_usd', 2)} AS net FROM pl")(
    lambda w: revenue.pl_listing(marts.monthly_pl(w.ledger))
)
_SUMMARY = f"""SELECT gross AS total_revenue_ttm, net AS net_revenue_ttm, {rnd("gross - net", 2)} AS total_cogs,
      operating AS operating_income_ttm, {rnd("operating * 0.85", 2)} AS net_profit_ttm,
      {pct("net", "gross")} AS gross_margin_pct, {pct("operating", "gross")} AS operating_margin_pct,
      {pct(rnd("operating * 0.85", 2), "gross")} AS net_margin_pct
    FROM (SELECT *, {rnd("net - gross * 0.38", 2)} AS operating
      FROM (SELECT {rnd("SUM(revenue_usd)", 2)} AS gross, {rnd("SUM(net_revenue_usd)", 2)} AS net FROM rev))"""
query("financial_summary", _SUMMARY)(lambda w: revenue.financial_summary(product_revenue(w)))
_DEPARTMENTS = f"""SELECT {labelled(fv.DEPARTMENT_LABELS, "dept", "dept")} AS department, lower(dept) AS key,
      amount_usd, {pct("amount_usd", "SUM(amount_usd) OVER ()")} AS percentage
    FROM (SELECT COALESCE(department, 'operations') AS dept, {rnd(usd("SUM(amount)"), 2)} AS amount_usd
      FROM ledger WHERE type IN ('refund', 'fee', 'payout', 'transfer') GROUP BY 1)"""
query("expenses_by_department", _DEPARTMENTS)(lambda w: revenue.expenses_by_department(w.ledger))
query(
    "revenue_by_tier",
    f"""SELECT {labelled(fv.TIER_LABELS, "plan", "plan")} AS tier, lower(plan) AS plan_key, customer_count, total_revenue,
      {pct("total_revenue", "SUM(total_revenue) OVER ()")} AS percentage, transactions_count
    FROM (SELECT COALESCE(plan, 'standard') AS plan, COUNT(DISTINCT c.customer_id) AS customer_count,
        {rnd(usd("SUM(amount)"), 2)} AS total_revenue, COUNT(*) AS transactions_count
      FROM ledger t JOIN clients c ON t.customer_id = c.customer_id WHERE {REV_OK} GROUP BY 1)""",
)(lambda w: revenue.revenue_by_tier(w.ledger, w.customers))
query(
    "top_customers",
    f"""SELECT customer_name AS name, {labelled(fv.TIER_LABELS, "plan", "plan")} AS tier, country,
      {rnd(usd("SUM(amount)"), 2)} AS total_revenue, COUNT(*) AS transactions_count
    FROM ledger t JOIN clients c ON t.customer_id = c.customer_id WHERE {REV_OK}
    GROUP BY customer_name, plan, country ORDER BY total_revenue DESC, customer_name LIMIT 6""",
)(lambda w: revenue.top_customers(w.ledger, w.customers))
query(
    "performance_trends",
    f"""SELECT month, gross AS gross_revenue, {rnd("gross - net", 2)} AS cogs, opex AS operating_expenses,
      {rnd("net - opex", 2)} AS operating_income, {pct(rnd("net - opex", 2), "gross")} AS operating_margin_pct
    FROM (SELECT *, {rnd("gross * 0.38", 2)} AS opex
      FROM (SELECT strftime(month, '%Y-%m') AS month, {rnd("SUM(revenue_usd)", 2)} AS gross,
          {rnd("SUM(net_revenue_usd)", 2)} AS net FROM rev GROUP BY 1 ORDER BY 1 DESC LIMIT 12))""",
)(lambda w: revenue.performance_trends(product_revenue(w)))
_SERIES = f"""SELECT month, total, CASE WHEN before > 0 THEN {js("(total - before) / before * 100.0")}
      WHEN before IS NOT NULL THEN 0.0 END AS mom_growth_pct
    FROM (SELECT month, total, LAG(total) OVER (ORDER BY month) AS before
      FROM (SELECT month, COALESCE({rnd("SUM(revenue_usd)", 2)}, 0.0) AS total FROM {{source}} GROUP BY 1))"""
query("mom_series", _SERIES.format(source="rev"))(lambda w: revenue.mom_series(product_revenue(w)))


def _totals_sql(where=""):
    return f"""SELECT product_line, {title("product_line", fv.PRODUCT_LINES)} AS label,
      {js("SUM(COALESCE(revenue_usd, 0))", 2)} AS total FROM rev {where} GROUP BY 1"""


query("product_totals", _totals_sql())(lambda w: revenue.product_totals(product_revenue(w)))
query("product_mix_of_month", _totals_sql("WHERE strftime(month, '%Y-%m') = '2001-03'"))(
    lambda w: revenue.product_totals(product_revenue(w), "2001-03")
)
query(
    "income_statement",
    f"""SELECT month, product_line, 0 AS is_subtotal, COALESCE({rnd("revenue_usd", 2)}, 0) AS gross,
      COALESCE({rnd("net_revenue_usd", 2)}, 0) AS net FROM rev
    UNION ALL SELECT month, NULL, 1, COALESCE({rnd("SUM(revenue_usd)", 2)}, 0),
      COALESCE({rnd("SUM(net_revenue_usd)", 2)}, 0) FROM rev GROUP BY month""",
)(lambda w: revenue.income_statement(product_revenue(w)))
_OTHER = f"SUM(revenue_usd) FILTER (WHERE COALESCE(product_line NOT IN {tuple(fv.PRODUCT_LINES)}, TRUE))"
query(
    "product_month_pivot",
    "SELECT month, "
    + ", ".join(
        f"COALESCE({rnd(f'''SUM(revenue_usd) FILTER (WHERE product_line = '{p}')''', 2)}, 0) AS {p}"
        for p in fv.PRODUCT_LINES
    )
    + f", COALESCE({rnd(_OTHER, 2)}, 0) AS other FROM rev GROUP BY month",
)(lambda w: revenue.product_month_pivot(product_revenue(w)))
_BUDGET = f"""WITH s AS ({_SUMMARY}), d AS ({_DEPARTMENTS}),
    b AS (SELECT 'Gross Invoiced Revenue' AS line_item, 'Revenue' AS category, total_revenue_ttm AS actual_usd,
        {rnd("total_revenue_ttm * 0.94", 2)} AS budget_usd FROM s
      UNION ALL SELECT 'COGS & Interchange Fees', 'Direct Costs', total_cogs, {rnd("total_cogs * 1.08", 2)} FROM s
      UNION ALL SELECT department, 'Operating Expenses', amount_usd,
        {rnd("(SELECT AVG(amount_usd) FROM d)", 2)} FROM d)"""
_LINES = f"""SELECT line_item, category, actual_usd, budget_usd,
      {rnd("CASE WHEN category = 'Direct Costs' THEN budget_usd - actual_usd ELSE actual_usd - budget_usd END", 2)} AS variance_usd,
      {pct("(actual_usd - budget_usd)", "budget_usd")} AS variance_pct,
      CASE WHEN (category = 'Revenue' AND actual_usd >= budget_usd) OR (category <> 'Revenue' AND actual_usd <= budget_usd)
        THEN 'favorable' ELSE 'unfavorable' END AS status FROM b"""


def _budget(w):
    return revenue.budget_vs_actual(inputs.actual_lines(w), inputs.budget_lines(w))


query("budget_vs_actual", f"{_BUDGET} {_LINES}")(_budget)
query(
    "budget_opex_totals",
    f"""{_BUDGET} SELECT {rnd("SUM(actual_usd)", 2)} AS total_actual_opex, {rnd("SUM(budget_usd)", 2)} AS total_budget_opex,
      {rnd("SUM(budget_usd) - SUM(actual_usd)", 2)} AS opex_variance FROM b WHERE category = 'Operating Expenses'""",
)(lambda w: revenue.budget_opex_totals(_budget(w)))
query(
    "forward_quarters",
    f"""WITH s AS (SELECT {rnd("total_revenue_ttm / 4.0", 2)} AS q, operating_margin_pct / 100.0 AS m FROM ({_SUMMARY}))
    SELECT 'q1' AS quarter, {rnd("q * 1.08", 2)} AS projected_revenue, {rnd("q * 1.08 * m", 2)} AS projected_income FROM s
    UNION ALL SELECT 'q2', {rnd("q * 1.16", 2)}, {rnd("q * 1.16 * m", 2)} FROM s""",
)(lambda w: revenue.forward_quarters(revenue.financial_summary(product_revenue(w))))
_SUBS = "(SELECT * FROM rev WHERE product_line = 'subscriptions')"
query(
    "revenue_kpis",
    f"""SELECT gross AS total_revenue, net AS net_revenue, {js("net / gross * 100.0")} AS gross_margin_pct,
      (SELECT mom_growth_pct FROM ({_SERIES.format(source=_SUBS)}) ORDER BY month DESC LIMIT 1) AS mom_growth_pct,
      {js("gross * 0.38")} AS operating_expenses, {js("net - gross * 0.38")} AS operating_income,
      {js("(net - gross * 0.38) * 0.85")} AS net_profit, {js("(net - gross * 0.38) / gross * 100.0")} AS operating_margin_pct,
      {js("(net - gross * 0.38) * 0.85 / gross * 100.0")} AS net_margin_pct
    FROM (SELECT {rnd("SUM(revenue_usd)", 2)} AS gross, {rnd("SUM(net_revenue_usd)", 2)} AS net FROM {_SUBS})""",
)(lambda w: revenue.revenue_kpis(filters.cross_filter(product_revenue(w), product_line="subscriptions")))

# --- operations ----------------------------------------------------------------------------
_SUCCESS = f"""SELECT occurred_date AS date, source, {rnd("success_rate * 100.0", 1)} AS rate FROM rates
    ORDER BY occurred_date DESC NULLS FIRST, source LIMIT 60"""
_SUCCESS_COUNTS = _SUCCESS.replace(" AS rate FROM", " AS rate, succeeded_count, total_transactions FROM")
query("success_trend", _SUCCESS)(lambda w: ops.success_trend(rates(w)))
query(
    "success_pivot",
    "SELECT date, "
    + ", ".join(f"MAX(rate) FILTER (WHERE source = '{s}') AS {s}" for s in fv.SOURCES)
    + f""", {rnd("(100.0 * SUM(succeeded_count) FILTER (WHERE outside) / SUM(total_transactions) FILTER (WHERE outside))", 1)} AS other
    FROM (SELECT *, COALESCE(source NOT IN {tuple(fv.SOURCES)}, TRUE) AS outside FROM ({_SUCCESS_COUNTS})) GROUP BY date""",
)(lambda w: ops.success_pivot(ops.success_trend(rates(w), counts=True)))
_TOP = """SELECT decline_code AS code, total_declines AS count FROM declines
    ORDER BY total_declines DESC, decline_code LIMIT 10"""
query("top_declines", _TOP)(lambda w: ops.top_declines(marts.decline_analysis(w.ledger)))
_ADVISOR = f"""SELECT transaction_id, decline_code, card_brand AS brand, card_funding AS funding,
      {rnd("amount_usd", 2)} AS amount_usd, {rnd("retry_success_probability * 100.0", 1)} AS probability,
      recommended_action AS action, {rnd("expected_recovery_usd", 2)} AS recovery_usd FROM predictions"""
_ADVISOR_20 = f"SELECT * FROM ({_ADVISOR}) ORDER BY recovery_usd DESC, transaction_id LIMIT 20"
query("retry_advisor", _ADVISOR_20)(lambda w: ops.retry_advisor(predictions(w)))
_CODE = "probability >= 50 AND decline_code = 'do_not_honor'"
query(
    "retry_advisor_filtered",
    f"SELECT * FROM ({_ADVISOR}) WHERE {_CODE} ORDER BY recovery_usd DESC, transaction_id LIMIT 20",
)(lambda w: ops.retry_advisor(predictions(w), 50, "Do Not Honor"))
query(
    "retry_recovery_total",
    f"SELECT COUNT(*) AS retries, {rnd('SUM(recovery_usd)', 2)} AS total_recovery_usd FROM ({_ADVISOR}) WHERE {_CODE}",
)(lambda w: ops.retry_recovery_total(predictions(w), 50, "Do Not Honor"))
_DISPUTES = f"""SELECT dispute_id, transaction_id, customer_id, {rnd("amount_usd", 2)} AS amount_usd, dispute_status AS status,
      dispute_created_at AS created_at, due_by FROM open_disputes
    ORDER BY dispute_created_at DESC, transaction_id LIMIT 20"""
query("dispute_list", _DISPUTES)(lambda w: ops.dispute_list(disputes(w)))
_MONITOR = f"""SELECT COUNT(*) AS total_transactions, {rnd(usd("SUM(amount)"), 2)} AS total_volume_usd,
      COUNT(*) FILTER (WHERE status = 'succeeded') AS succeeded_count, COUNT(*) FILTER (WHERE status = 'failed') AS failed_count,
      COUNT(*) FILTER (WHERE status = 'pending') AS pending_count, COUNT(*) FILTER (WHERE status = 'disputed') AS disputed_count,
      {pct("COUNT(*) FILTER (WHERE status = 'succeeded')", "COUNT(*)")} AS overall_success_rate FROM ledger"""
query("transaction_monitoring", _MONITOR)(lambda w: ops.transaction_monitoring(w.ledger))
query(
    "gateway_metrics",
    f"""SELECT source, {labelled(fv.GATEWAY_LABELS, "source", "source")} AS name, total_transactions, success_rate, volume_usd,
      CASE WHEN success_rate >= 93 THEN 'Optimal' ELSE 'Degraded' END AS health_status
    FROM (SELECT source, COUNT(*) AS total_transactions, {rnd(usd("SUM(amount)"), 2)} AS volume_usd,
      {pct("COUNT(*) FILTER (WHERE status = 'succeeded')", "COUNT(*)")} AS success_rate FROM ledger GROUP BY 1)""",
)(lambda w: ops.gateway_metrics(w.ledger))
query(
    "risk_counts",
    """SELECT COUNT(*) FILTER (WHERE risk_level = 'normal' OR risk_level IS NULL) AS normal_count,
      COUNT(*) FILTER (WHERE risk_level = 'elevated') AS elevated_risk_count,
      COUNT(*) FILTER (WHERE risk_level = 'highest') AS highest_risk_count FROM ledger""",
)(lambda w: ops.risk_counts(w.ledger))
query(
    "dispute_rate_bps",
    f"""SELECT {rnd("CAST(disputed_count AS DOUBLE) / GREATEST(succeeded_count, 1) * 10000.0", 1)} AS dispute_rate_bps
    FROM ({_MONITOR})""",
)(lambda w: ops.dispute_rate_bps(ops.transaction_monitoring(w.ledger)))
query(
    "dispute_outcomes",
    f"""SELECT *, {rnd("CAST(disputes_won_count AS DOUBLE) / NULLIF(disputes_won_count + disputes_lost_count, 0) * 100.0", 1)} AS win_rate_pct
    FROM (SELECT COUNT(*) FILTER (WHERE dispute_status = 'won') AS disputes_won_count,
      COUNT(*) FILTER (WHERE dispute_status = 'lost') AS disputes_lost_count,
      COUNT(*) FILTER (WHERE dispute_status LIKE 'warning%') AS active_disputes_count,
      {rnd("SUM(amount_usd)", 2)} AS total_dispute_amount_usd FROM open_disputes)""",
)(lambda w: ops.dispute_outcomes(disputes(w)))
query(
    "retry_summary",
    f"""SELECT COUNT(*) AS scored_declines, {rnd("SUM(expected_recovery_usd)", 2)} AS smart_retry_recovery_usd,
      COUNT(*) FILTER (WHERE retry_success_probability >= 0.7) AS high_confidence_retries_count,
      {rnd("AVG(retry_success_probability) * 100.0", 1)} AS avg_retry_probability_pct FROM predictions""",
)(lambda w: ops.retry_summary(predictions(w)))
query(
    "ops_kpis",
    f"""SELECT CAST((SELECT SUM(total_declines) FROM declines) AS BIGINT) AS total_declines,
      (SELECT replace(code, '_', ' ') FROM ({_TOP}) ORDER BY count DESC, code LIMIT 1) AS top_decline_code,
      (SELECT {js("ROUND(AVG(rate), 6)", 1)} FROM ({_SUCCESS})) AS avg_success_rate,
      (SELECT {js("SUM(CAST(recovery_usd AS DECIMAL(28, 2)))", 2)} FROM ({_ADVISOR})) AS potential_recovery_usd,
      (SELECT COUNT(*) FROM ({_ADVISOR}) WHERE probability >= 70) AS high_confidence_retry_count,
      (SELECT COUNT(*) FROM open_disputes) AS active_disputes_count,
      (SELECT {js("SUM(CAST(amount_usd AS DECIMAL(28, 2)))", 2)} FROM open_disputes) AS total_dispute_amount""",
)(
    lambda w: ops.ops_kpis(
        ops.decline_counts(marts.decline_analysis(w.ledger)),
        ops.success_trend(rates(w)),
        ops.advisor_rows(predictions(w)),
        disputes(w),
    )
)

# --- receivables ---------------------------------------------------------------------------
_BUCKETS = list(fv.AGING_BUCKETS)
_SUMS = ", ".join(f"COALESCE({rnd(f'SUM({b}_usd)', 2)}, 0) AS {b}_usd" for b in _BUCKETS)
_AR = f"""SELECT *, {rnd("total_outstanding_usd - current_usd", 2)} AS overdue_usd, {pct("current_usd", "total_outstanding_usd")} AS current_pct,
      {pct("(total_outstanding_usd - current_usd)", "total_outstanding_usd")} AS overdue_pct,
      {pct("days_90_plus_usd", "total_outstanding_usd")} AS critical_90_plus_pct,
      {rnd("total_outstanding_usd / total_invoices_count", 2)} AS avg_invoice_usd
    FROM (SELECT COUNT(*) AS total_customers_count, CAST(SUM(invoice_count) AS BIGINT) AS total_invoices_count,
      {rnd("SUM(total_outstanding_usd)", 2)} AS total_outstanding_usd, {_SUMS} FROM aging)"""
query("ar_summary", _AR)(lambda w: receivables.ar_summary(aging(w)))
_SALES = f"""SELECT {usd(f"SUM(amount) FILTER (WHERE type = 'invoice_payment' AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)")} AS invoice_sales_90d,
      {rnd(usd(f"SUM(amount) FILTER (WHERE type = 'invoice_payment' AND status = 'succeeded' AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"), 2)} AS collections_30d FROM ledger"""
query("sales_and_collections", _SALES)(lambda w: receivables.sales_and_collections(w.ledger, w.as_of))
query(
    "collection_efficiency",
    f"""SELECT *, {rnd("dso_days - best_possible_dso_days", 1)} AS average_days_delinquent
    FROM (SELECT {rnd("total_outstanding_usd / invoice_sales_90d * 90.0", 1)} AS dso_days,
      {rnd("current_usd / invoice_sales_90d * 90.0", 1)} AS best_possible_dso_days,
      collections_30d AS collections_realized_30d_usd, CAST(550000.0 AS DOUBLE) AS collections_target_30d_usd,
      {pct("collections_30d", "550000.0")} AS collections_realization_rate_pct FROM ({_AR}), ({_SALES}))""",
)(
    lambda w: receivables.collection_efficiency(
        receivables.ar_summary(aging(w)), receivables.sales_and_collections(w.ledger, w.as_of)
    )
)
_PROVISION = " + ".join(rnd(f"{b}_usd * {v[4] / 100.0}::DOUBLE", 2) for b, v in fv.AGING_BUCKETS.items())
query(
    "bad_debt_provision",
    f"""SELECT p AS bad_debt_provision_usd, {pct("p", "total_outstanding_usd")} AS provision_rate_pct
    FROM (SELECT total_outstanding_usd, {rnd(_PROVISION, 2)} AS p FROM ({_AR}))""",
)(lambda w: receivables.bad_debt_provision(receivables.ar_summary(aging(w))))
_COUNTS = (
    "SELECT "
    + ", ".join(
        f"CAST(COALESCE(SUM(invoice_count) FILTER (WHERE {b}_usd > 0), 0) AS BIGINT) AS {b}_invoices" for b in _BUCKETS
    )
    + " FROM aging"
)
query("bucket_invoice_counts", _COUNTS)(lambda w: receivables.bucket_invoice_counts(aging(w)))
query(
    "aging_buckets",
    f"WITH s AS ({_AR}), c AS ({_COUNTS}) "
    + " UNION ALL ".join(
        f"""SELECT '{v[0]}' AS bucket, '{b}' AS range_key, {b}_usd AS amount_usd, {pct(f"{b}_usd", "total_outstanding_usd")} AS percentage,
        {b}_invoices AS invoice_count, '{v[1]}' AS risk_tier, '{v[2]}' AS severity, '{v[3]}' AS status_label,
        {v[4]}::DOUBLE AS provision_rate_pct, {rnd(f"{b}_usd * {v[4] / 100.0}::DOUBLE", 2)} AS loss_provision_usd,
        {v[5]}::DOUBLE AS recovery_expectation_pct FROM s, c"""
        for b, v in fv.AGING_BUCKETS.items()
    ),
)(lambda w: receivables.aging_buckets(aging(w)))
query(
    "top_overdue",
    "SELECT * FROM aging WHERE days_90_plus_usd > 0 ORDER BY days_90_plus_usd DESC, customer_id LIMIT 5",
)(lambda w: receivables.top_overdue(aging(w)))
_ACCOUNT = f"""a.customer_id, a.customer_name, c.customer_email, upper(c.plan) AS plan, c.country, invoice_count AS invoices,
      {rnd("total_outstanding_usd", 2)} AS total, COALESCE({rnd("current_usd", 2)}, 0) AS current,
      COALESCE({rnd("days_31_60_usd", 2)}, 0) AS days_31_60, COALESCE({rnd("days_61_90_usd", 2)}, 0) AS days_61_90,
      COALESCE({rnd("days_90_plus_usd", 2)}, 0) AS days_90_plus"""
query(
    "high_risk_accounts",
    f"""SELECT {_ACCOUNT},
      CASE WHEN days_90_plus_usd > 500 THEN 'Critical' WHEN days_90_plus_usd > 250 THEN 'High' ELSE 'Elevated' END AS risk_tier,
      CASE WHEN days_90_plus_usd > 500 THEN 'Legal Demand Notice' WHEN days_90_plus_usd > 250 THEN 'Final Notice Sent' ELSE 'Escalated Dunning' END AS dunning_stage,
      CASE WHEN days_90_plus_usd > 500 THEN 'Issue Formal Demand Letter & Freeze Credit'
        WHEN days_90_plus_usd > 250 THEN 'Direct Senior Collector Call & Escalate'
        ELSE 'Send Urgent Statement with 5% Pay Discount' END AS recommended_action,
      CAST(DATE '{AS_OF}' - oldest_invoice_date AS INTEGER) AS days_overdue
    FROM aging_all a LEFT JOIN clients c ON a.customer_id = c.customer_id WHERE days_90_plus_usd > 0
    ORDER BY days_90_plus_usd DESC, a.customer_id LIMIT 8""",
)(lambda w: receivables.high_risk_accounts(aging(w, with_oldest=True), w.customers, w.as_of))
_SEVERITY = """CASE WHEN days_90_plus_usd > 0 THEN 'critical' WHEN days_61_90_usd > 0 THEN 'elevated'
      WHEN days_31_60_usd > 0 THEN 'moderate' ELSE 'current' END"""
_LIMIT = "(CASE c.plan WHEN 'enterprise' THEN 5000.0 WHEN 'pro' THEN 2500.0 ELSE 1000.0 END)::DOUBLE"
query(
    "aging_list",
    f"""SELECT *, CASE severity WHEN 'critical' THEN 'Demand Notice' WHEN 'elevated' THEN 'Collector Assigned'
        WHEN 'moderate' THEN 'Dunning Step 2' ELSE 'Current Terms' END AS dunning_stage,
      CASE severity WHEN 'critical' THEN 'Issue Legal Notice' WHEN 'elevated' THEN 'Direct Phone Call'
        WHEN 'moderate' THEN 'Email Reminder' ELSE 'Standard Invoice Delivery' END AS recommended_action
    FROM (SELECT {_ACCOUNT}, {_SEVERITY} AS severity, {_LIMIT} AS credit_limit,
        {rnd(f"LEAST(100.0, total_outstanding_usd / {_LIMIT} * 100.0)", 1)} AS credit_utilization
      FROM aging a LEFT JOIN clients c ON a.customer_id = c.customer_id
      ORDER BY total_outstanding_usd DESC, a.customer_id LIMIT 200)""",
)(lambda w: receivables.aging_list(aging(w), w.customers))
query(
    "severity_counts",
    f"""SELECT severity, COUNT(*) AS accounts, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS all_accounts
    FROM (SELECT {_SEVERITY} AS severity FROM aging) GROUP BY 1""",
)(lambda w: receivables.severity_counts(aging(w)))
query(
    "search_accounts",
    f"""SELECT a.customer_id, a.customer_name, customer_email, {_SEVERITY} AS severity, invoice_count AS invoices,
      {rnd("total_outstanding_usd", 2)} AS total
    FROM aging a LEFT JOIN clients c ON a.customer_id = c.customer_id
    WHERE days_90_plus_usd > 0 AND {_SEVERITY} = 'critical'
      AND (contains(lower(a.customer_name), 'r#00000000') OR contains(lower(a.customer_id), 'r#00000000')
        OR contains(lower(customer_email), 'r#00000000'))
    ORDER BY total_outstanding_usd DESC, a.customer_id LIMIT 25""",
)(
    lambda w: receivables.search_accounts(
        aging(w), w.customers, text="R#00000000", bucket="days_90_plus", severity="critical"
    )
)

# --- cross filters -------------------------------------------------------------------------
query(
    "cross_filter",
    """SELECT transaction_id, occurred_date, product_line, department, decline_code, amount_usd FROM ledger
    WHERE strftime(occurred_date, '%Y-%m') = '2000-05' AND product_line = 'marketplace'
      AND department = 'sales'""",
)(
    lambda w: filters.cross_filter(
        w.ledger, columns={"month": "occurred_date"}, month="2000-05", product_line="marketplace",
        department="Sales", decline_code=None,
    ).select("transaction_id", "occurred_date", "product_line", "department", "decline_code", "amount_usd")
)
query(
    "flows_filter",
    f"""WITH t AS ({_TREND}) SELECT * FROM t
    WHERE strftime(date, '%Y-%m') = '2001-11' OR NOT EXISTS (SELECT 1 FROM t WHERE strftime(date, '%Y-%m') = '2001-11')""",
)(lambda w: filters.flows_filter(executive.cash_trend(daily(w)), month="2001-11"))
