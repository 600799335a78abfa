"""SQL views that the check queries build on, in the dialect of the checking engine."""

import re

from .. import fixed_values as fv
from ..sources.tables import AS_OF, DESCRIPTIONS, FX_RATES, ORDER_PRIORITIES


def _list(values):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values) + "]"


def _map(table):
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def rnd(expr, places):
    """Half-away-from-zero rounding on a decimal."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,6)), {places}) AS DOUBLE)"


def pct(part, whole, places=1):
    return f"COALESCE({rnd(f'CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 100.0', places)}, 0.0)"


def js(expr, places=0):
    """Half toward plus infinity."""
    scale = float(10**places)
    return f"(FLOOR(({expr}) * {scale}::DOUBLE + 0.5::DOUBLE)::DOUBLE / {scale}::DOUBLE)"


def usd(cents):
    return f"(CAST({cents} AS DOUBLE) / 100.0)"


def title(expr, values):
    """Title Case of snake_case values, spelled out."""
    words = {v: v.replace("_", " ").title() for v in values}
    return f"element_at({_map(words)}, {expr})[1]"


def labelled(table, expr, fallback):
    return f"COALESCE(element_at({_map(table)}, lower({expr}))[1], {fallback})"


REV_OK = "type IN ('charge', 'invoice_payment') AND status = 'succeeded'"


def _ledger(multi_currency):
    currency = f"{_list(fv.CURRENCIES)}[(h % 6) + 1]" if multi_currency else "'USD'"
    rate = f"{_list(FX_RATES)}[(h % 6) + 1]" if multi_currency else "CAST(1.0 AS DOUBLE)"
    return f"""
  SELECT s3.*,
    CAST(amount AS DOUBLE) * fx_rate / 100.0 AS amount_usd,
    CAST(net_amount AS DOUBLE) * fx_rate / 100.0 AS net_amount_usd,
    CAST(fee_amount AS DOUBLE) * fx_rate / 100.0 AS fee_amount_usd
  FROM (
    SELECT
      concat_ws('-', 'txn', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_id,
      concat_ws('-', 'idem', l_orderkey, l_linenumber) AS idempotency_key,
      occurred_at,
      CAST(posted_date AS TIMESTAMP) AS posted_at,
      CAST(occurred_at AS DATE) AS occurred_date,
      posted_date,
      CAST(hour(occurred_at) AS SMALLINT) AS occurred_hour,
      CAST(dayofweek(occurred_at) AS SMALLINT) AS occurred_dow,
      CAST(weekofyear(occurred_at) AS SMALLINT) AS occurred_week,
      CAST(month(occurred_at) AS SMALLINT) AS occurred_month,
      CAST(quarter(occurred_at) AS SMALLINT) AS occurred_quarter,
      CAST(year(occurred_at) AS SMALLINT) AS occurred_year,
      type, status,
      CASE WHEN l_partkey % 20 < 10 THEN 'stripe' WHEN l_partkey % 20 < 12 THEN 'adyen'
           WHEN l_partkey % 20 < 14 THEN 'ach' WHEN l_partkey % 20 < 15 THEN 'wire'
           WHEN l_partkey % 20 < 18 THEN 'plaid' ELSE 'manual_journal' END AS source,
      amount, {currency} AS currency, {rate} AS fx_rate,
      CASE WHEN type IN ('refund', 'payout', 'fee') THEN -amount
           WHEN type = 'transfer' THEN CASE WHEN (h // 10) % 10 < 6 THEN -amount ELSE amount END
           WHEN type = 'adjustment' THEN CASE WHEN h % 2 = 0 THEN -amount ELSE amount END
           WHEN type = 'charge' AND status = 'succeeded' THEN amount - fee_amount
           ELSE amount END AS net_amount,
      fee_amount,
      'cus_' || o_custkey AS customer_id,
      'acct_' || l_suppkey AS merchant_account_id,
      product_line,
      {_list(fv.DEPARTMENTS)}[((h // 13) % 6) + 1] AS department,
      element_at({_map(fv.ACCOUNT_CODES)}, product_line)[1] AS account_code,
      'CC-' || l_returnflag AS cost_center,
      CASE WHEN (h // 11) % 100 < CASE WHEN type IN ('payout', 'fee') THEN 85 ELSE 70 END
           THEN 'cash' ELSE 'accrual' END AS basis,
      CASE WHEN status = 'failed' AND type IN ('charge', 'invoice_payment')
           THEN {_list(fv.DECLINE_CODES)}[((h // 17) % 15) + 1] END AS decline_code,
      CASE WHEN status <> 'failed' OR (h // 19) % 10 < 6 THEN 'normal'
           WHEN (h // 19) % 10 < 9 THEN 'elevated' ELSE 'highest' END AS risk_level,
      CASE WHEN status = 'disputed'
           THEN concat_ws('-', 'dp_txn', l_orderkey, l_linenumber, l_partkey, l_suppkey) END AS dispute_id,
      CASE WHEN status = 'disputed' THEN {_list(fv.DISPUTE_STATUSES)}[((h // 23) % 4) + 1] END AS dispute_status,
      type = 'charge' AND status = 'succeeded' AND product_line = 'subscriptions'
        AND regexp_matches({_list(DESCRIPTIONS)}[((h // 37) % 4) + 1], 'recur|subscription|monthly', 'i') AS is_recurring,
      {_list(DESCRIPTIONS)}[((h // 37) % 4) + 1] AS description,
      CASE WHEN h % 10 <> 0 THEN '{{"card_brand": "' || {_list(fv.CARD_BRANDS)}[((h // 29) % 5) + 1]
           || '", "card_funding": "' || {_list(fv.CARD_FUNDING)}[((h // 31) % 3) + 1] || '"}}' END AS metadata_json,
      occurred_at + INTERVAL 1 HOUR AS ingested_at,
      'batch_' || l_linestatus AS batch_id
    FROM (
      SELECT s1.*,
        CASE WHEN type = 'charge' AND status = 'succeeded' THEN LEAST((amount * 29 + 30000) // 1000, amount)
             WHEN type = 'fee' THEN amount ELSE 0 END AS fee_amount
      FROM (
        SELECT s0.*,
          CASE WHEN type IN ('payout', 'transfer', 'fee') THEN 'succeeded'
               WHEN type = 'refund' THEN CASE WHEN hs < 97 THEN 'succeeded' ELSE 'failed' END
               WHEN hs < 92 THEN 'succeeded' WHEN hs < 97 THEN 'failed' WHEN hs < 99 THEN 'pending'
               ELSE 'disputed' END AS status
        FROM (
          SELECT k.*, (h // 100) % 100 AS hs,
            CASE WHEN h % 100 < 60 THEN 'charge' WHEN h % 100 < 67 THEN 'refund' WHEN h % 100 < 77 THEN 'payout'
                 WHEN h % 100 < 89 THEN 'fee' WHEN h % 100 < 93 THEN 'transfer'
                 WHEN h % 100 < 98 THEN 'invoice_payment' ELSE 'adjustment' END AS type,
            CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * 100) AS BIGINT) % 500000 + 100 AS amount,
            l_shipdate + to_hours(CAST(h % 24 AS BIGINT)) AS occurred_at,
            CASE WHEN h % 499 = 0 THEN NULL
                 ELSE CAST(l_shipdate AS DATE) + CAST((h // 7) % 3 AS INTEGER) END AS posted_date,
            {_list(fv.PRODUCT_LINES)}[list_position({_list(ORDER_PRIORITIES)}, o_orderpriority)] AS product_line
          FROM (
            SELECT l.*, o_custkey, o_orderpriority,
              l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3 AS h
            FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
          ) k
        ) s0
      ) s1
    ) s2
  ) s3"""


VIEWS = {
    "ledger": _ledger(False),
    "fx_ledger": _ledger(True),
    "clients": """
  SELECT 'cus_' || c_custkey AS customer_id, 'billing@cus' || c_custkey || '.example' AS customer_email,
    c_name AS customer_name, n_name AS country,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'enterprise' WHEN 'AUTOMOBILE' THEN 'pro'
      WHEN 'MACHINERY' THEN 'starter' ELSE 'free' END AS plan
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "merchants": """
  SELECT 'acct_' || s_suppkey AS merchant_account_id, s_name AS account_name FROM supplier""",
    "daily": f"""
  SELECT posted_date AS date,
    {usd("SUM(CASE WHEN net_amount > 0 THEN net_amount ELSE 0 END)")} AS inflows_usd,
    {usd("SUM(CASE WHEN net_amount < 0 THEN -net_amount ELSE 0 END)")} AS outflows_usd,
    {usd("SUM(net_amount)")} AS net_flow_usd,
    {usd("SUM(SUM(net_amount)) OVER (ORDER BY posted_date ASC NULLS LAST ROWS UNBOUNDED PRECEDING)")} AS cumulative_cash_usd
  FROM ledger WHERE basis = 'cash' AND status = 'succeeded' GROUP BY posted_date""",
    "pl": f"""
  SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS month, account_code,
    {usd("SUM(CASE WHEN net_amount > 0 THEN net_amount ELSE 0 END)")} AS credit_usd,
    {usd("SUM(CASE WHEN net_amount < 0 THEN -net_amount ELSE 0 END)")} AS debit_usd,
    {usd("SUM(net_amount)")} AS net_usd
  FROM ledger WHERE basis = 'accrual' AND status = 'succeeded' GROUP BY 1, 2""",
    "rev": f"""
  SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS month, product_line,
    {usd(f"SUM(amount) FILTER (WHERE {REV_OK})")} AS revenue_usd,
    {usd("SUM(amount) FILTER (WHERE type = 'refund' AND status = 'succeeded')")} AS refunds_usd,
    {usd(f"(SUM(amount) FILTER (WHERE {REV_OK}) - COALESCE(SUM(amount) FILTER (WHERE type = 'refund' AND status = 'succeeded'), 0))")} AS net_revenue_usd
  FROM ledger WHERE basis = 'accrual' AND product_line IS NOT NULL GROUP BY 1, 2""",
    "rates": """
  SELECT occurred_date, source, COUNT(*) AS total_transactions,
    COUNT(*) FILTER (WHERE status = 'succeeded') AS succeeded_count,
    CAST(COUNT(*) FILTER (WHERE status = 'succeeded') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS success_rate
  FROM ledger WHERE type IN ('charge', 'invoice_payment') GROUP BY 1, 2""",
    "declines": f"""
  SELECT decline_code, COUNT(*) AS total_declines,
    COUNT(*) FILTER (WHERE source = 'stripe') AS stripe_declines,
    COUNT(*) FILTER (WHERE source = 'adyen') AS adyen_declines,
    {usd("SUM(amount)")} / CAST(COUNT(amount) AS DOUBLE) AS avg_amount_usd,
    COUNT(DISTINCT customer_id) AS unique_customers
  FROM ledger WHERE status = 'failed' AND decline_code IS NOT NULL GROUP BY 1""",
    "open_disputes": """
  SELECT dispute_id, transaction_id, customer_id, amount_usd, dispute_status,
    occurred_at AS dispute_created_at, occurred_at + INTERVAL 30 DAY AS due_by
  FROM ledger WHERE dispute_id IS NOT NULL""",
    "aging_all": f"""
  SELECT t.customer_id, c.customer_name, COUNT(*) AS invoice_count,
    {usd("SUM(amount)")} AS total_outstanding_usd,
    {usd(f"SUM(amount) FILTER (WHERE occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)")} AS current_usd,
    {usd(f"SUM(amount) FILTER (WHERE occurred_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY)")} AS days_31_60_usd,
    {usd(f"SUM(amount) FILTER (WHERE occurred_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)")} AS days_61_90_usd,
    {usd(f"SUM(amount) FILTER (WHERE occurred_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)")} AS days_90_plus_usd,
    CAST(MIN(occurred_at) AS DATE) AS oldest_invoice_date
  FROM ledger t JOIN clients c ON t.customer_id = c.customer_id
  WHERE type = 'invoice_payment' AND status IN ('pending', 'succeeded') AND basis = 'accrual'
  GROUP BY t.customer_id, c.customer_name""",
    "aging": "SELECT * EXCLUDE (oldest_invoice_date) FROM aging_all",
}


def with_views(body):
    """The body with the views it names, and the views those name, as a WITH prefix."""
    needed = []

    def visit(text):
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name]}\n)" for name in needed)
    if not views:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
