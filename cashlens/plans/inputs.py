"""Derived inputs of the registered queries: forecasts, scores, feeds, targets, budgets."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.money import usd_sum
from ..functions.rules import map_lookup, wall_micros
from ..operators import features, marts, retry
from ..operators.executive import latest_value
from ..operators.revenue import expenses_by_department, financial_summary
from ..schema import BANK_SYNC_PAGE, PROCESSOR_EVENT
from ..sources.tables import AS_OF
from .views import VIEWS, rnd

EARLIER = "2001-07-25"


def daily(w):
    return w.stored("daily", lambda: marts.daily_cash_position(w.ledger))


def revenue(w):
    return w.stored("revenue", lambda: marts.revenue_by_product(w.ledger))


def rates(w):
    return w.stored("rates", lambda: marts.success_rate_daily(w.ledger))


def disputes(w):
    return marts.disputes(w.ledger)


def aging(w, with_oldest=False):
    rows = w.stored("aging", lambda: marts.ar_aging(w.ledger, w.customers, w.as_of, with_oldest=True))
    return rows if with_oldest else rows.drop("oldest_invoice_date")


def _flow_quantiles(w, last=None):
    days = daily(w).filter(F.col("date").isNotNull())
    recent = days.orderBy(F.col("date").desc()).limit(last) if last else days
    quantile = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY net_flow_usd)")
    cash = latest_value(daily(w), "date", "cumulative_cash_usd").scalar()
    return recent.agg(
        F.max("date").alias("last_date"),
        quantile(0.1).alias("p10"),
        quantile(0.5).alias("p50"),
        quantile(0.9).alias("p90"),
    ).withColumn("current_cash_usd", cash)


def build_forecast(w):
    """Two snapshots from plain flow quantiles: the newest from 90 days, an earlier from all."""
    newest = features.forecast_path(_flow_quantiles(w, 90), forecast_date=AS_OF)
    earlier = features.forecast_path(_flow_quantiles(w), forecast_date=EARLIER, version="v0")
    return newest.unionByName(earlier)


def forecast(w):
    return w.stored("forecast", lambda: build_forecast(w))


def _forecast_sql(date, version, source):
    cash = {q: f"(current_cash_usd + (h - 1) * p50 + {q})" for q in ("p10", "p50", "p90")}
    runway = lambda q: f"CASE WHEN {q} >= 0 THEN 999 ELSE CAST(trunc({cash[q]} / abs({q})) AS BIGINT) END"
    inflow = "(CASE WHEN p50 > 0 THEN p50 * 0.6::DOUBLE ELSE -p50 * 0.4::DOUBLE END)"
    return f"""
  SELECT DATE '{date}' AS forecast_date, last_date + CAST(h AS INTEGER) AS prediction_date,
    CAST(h AS SMALLINT) AS horizon_days,
    p10 AS p10_net_flow_usd, p50 AS p50_net_flow_usd, p90 AS p90_net_flow_usd,
    GREATEST(0.0, {inflow}) AS p50_inflows_usd, GREATEST(0.0, {inflow} - p50) AS p50_outflows_usd,
    current_cash_usd AS starting_cash_usd,
    {cash['p10']} AS p10_cumulative_cash_usd, {cash['p50']} AS p50_cumulative_cash_usd,
    {cash['p90']} AS p90_cumulative_cash_usd,
    {runway('p10')} AS p10_runway_days, {runway('p50')} AS p50_runway_days, {runway('p90')} AS p90_runway_days,
    '{version}' AS model_version, CAST(NULL AS TIMESTAMP) AS model_trained_at, 'v1' AS feature_set_version
  FROM (SELECT MAX(date) AS last_date, quantile_disc(net_flow_usd, 0.1) AS p10,
          quantile_disc(net_flow_usd, 0.5) AS p50, quantile_disc(net_flow_usd, 0.9) AS p90,
          (SELECT cumulative_cash_usd FROM daily ORDER BY date DESC NULLS FIRST LIMIT 1) AS current_cash_usd
        FROM ({source})), range(1, 92) r(h)"""


VIEWS["forecast"] = (
    _forecast_sql(AS_OF, "v1", "SELECT * FROM daily WHERE date IS NOT NULL ORDER BY date DESC LIMIT 90")
    + "\n  UNION ALL"
    + _forecast_sql(EARLIER, "v0", "SELECT * FROM daily WHERE date IS NOT NULL")
)
VIEWS["snapshot"] = "SELECT * FROM forecast WHERE forecast_date = (SELECT MAX(forecast_date) FROM forecast)"


def build_predictions(w):
    """Every decline with a score spread over 0..1 by its amount, so all policies occur."""
    declined = retry.declined_events(w.ledger)
    cents = F.round(F.col("amount_usd") * 100).cast("long")
    scored = declined.withColumn("probability", (cents % 997).cast("double") / 997.0)
    return retry.recommend(scored, AS_OF)


def predictions(w):
    return w.stored("predictions", lambda: build_predictions(w))


VIEWS["declined"] = """
  SELECT transaction_id, decline_code,
    COALESCE(json_extract_string(metadata_json, '$.card_brand'), 'Visa') AS card_brand,
    COALESCE(json_extract_string(metadata_json, '$.card_funding'), 'credit') AS card_funding,
    amount, amount_usd, CAST(hour(occurred_at) AS INTEGER) AS occurred_hour, customer_id, occurred_at
  FROM ledger
  WHERE status = 'failed' AND decline_code IS NOT NULL AND type IN ('charge', 'invoice_payment')"""
_P = "(CAST(amount % 997 AS DOUBLE) / 997.0)"
VIEWS["predictions"] = f"""
  SELECT transaction_id, decline_code, card_brand, card_funding, amount_usd,
    CAST(occurred_hour AS SMALLINT) AS occurred_hour, customer_id, '{{}}' AS customer_retry_history,
    {rnd(_P, 4)} AS retry_success_probability,
    CASE WHEN {_P} >= 0.7::DOUBLE THEN 'retry_1h' WHEN {_P} >= 0.4::DOUBLE THEN 'retry_24h'
         WHEN {_P} >= 0.2::DOUBLE THEN 'retry_72h' ELSE 'do_not_retry' END AS recommended_action,
    CASE WHEN {_P} >= 0.7::DOUBLE THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR
         WHEN {_P} >= 0.4::DOUBLE THEN TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR
         WHEN {_P} >= 0.2::DOUBLE THEN TIMESTAMP '{AS_OF}' + INTERVAL 72 HOUR END AS recommended_retry_at,
    {rnd(_P + " * amount_usd", 2)} AS expected_recovery_usd, 'v1' AS model_version,
    TIMESTAMP '{AS_OF}' AS scored_at
  FROM declined"""

# --- feeds ---------------------------------------------------------------------------------
EVENT_KINDS = [*fv.EVENT_TYPES, "customer.created"]
EVENT_STATES = ["succeeded", "failed", "pending", "canceled", "unknown"]


def processor_events(w):
    """Processor events from the event table: some unsupported, some without an id, ids repeat."""
    e = w.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    created = F.floor(wall_micros("ts") / 1_000_000)
    detail = F.create_map(
        F.lit("product_line"), pick(fv.PRODUCT_LINES, k % 5), F.lit("order"), F.col("event_id").cast("string")
    )
    payload = F.struct(
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("obj_"), F.floor(F.col("event_id") / 2).cast("string"))).alias("id"),
        F.when(k % 4 != 0, created).alias("created"),
        (F.round(F.col("value").cast("decimal(18,2)") * 100).cast("long") + 100).alias("amount"),
        F.when(k % 6 != 0, pick(["usd", "eur", "gbp"], k % 3)).alias("currency"),
        F.when(k % 9 != 0, pick(EVENT_STATES, F.col("user_id") % 5)).alias("status"),
        F.concat(F.lit("cus_"), F.col("user_id")).alias("customer"),
        pick(fv.DECLINE_CODES, k % 15).alias("failure_code"),
        F.when(k % 8 == 0, F.struct(F.lit("elevated").alias("risk_level"))).alias("outcome"),
        F.when(k % 50 == 0, F.concat(F.lit("dp_"), F.col("event_id"))).alias("dispute"),
        F.when(k % 3 == 0, F.lit("Card payment")).when(k % 3 == 1, F.lit("")).alias("description"),
        F.when(k % 2 == 0, F.lit("STATEMENT")).alias("statement_descriptor"),
        F.when(k % 7 != 0, detail).alias("metadata"),
    )
    return e.select(
        pick(EVENT_KINDS, F.col("event_id") % 11).alias("type"),
        F.struct(payload.alias("object")).alias("data"),
        F.concat(F.lit("evt_"), F.col("event_id")).alias("id"),
        created.alias("created"),
    )


def event_rows(w):
    """The events with every declared column."""
    events = processor_events(w)
    present = {"type", "data", "id", "created"}
    return events.select(
        [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PROCESSOR_EVENT.fields
        ]
    )


def event_lines(w):
    """A text line for each event: some cut short, some with a time or an amount that is no number, some without a type."""
    e, n = w.table("events"), F.col("event_id")
    created = F.floor(wall_micros("ts") / 1_000_000).cast("string")
    text = F.concat(
        F.lit('{"id": "obj_'), n.cast("string"), F.lit('", "created": '),
        F.when(n % 103 == 0, F.lit('"soon"')).otherwise(created), F.lit(', "amount": '),
        F.when(n % 109 == 0, F.lit("[1]")).otherwise(F.lit("5")), F.when(n % 107 != 0, F.lit(', "type": "charge.succeeded"')).otherwise(F.lit("")), F.lit("}"),
    )
    return e.select(F.when(n % 101 == 0, F.substring(text, 1, 14)).otherwise(text).alias("value"))


VIEWS["event_lines"] = """
  SELECT CASE WHEN event_id % 101 = 0 THEN substr(line, 1, 14) ELSE line END AS line,
    CASE WHEN event_id % 101 = 0 THEN 'not a JSON object' WHEN event_id % 103 = 0 OR event_id % 109 = 0 THEN 'a value of the wrong type'
      WHEN event_id % 107 = 0 THEN 'no type' END AS reason
  FROM (SELECT event_id, '{"id": "obj_' || event_id || '", "created": ' || CASE WHEN event_id % 103 = 0 THEN '"soon"'
      ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END || ', "amount": ' || CASE WHEN event_id % 109 = 0 THEN '[1]' ELSE '5' END
      || CASE WHEN event_id % 107 <> 0 THEN ', "type": "charge.succeeded"' ELSE '' END || '}' AS line FROM events)"""


def landed_lines(w, name, build):
    """Text files of a feed, written once per workspace."""
    path = f"{w.root}/{name}"
    return w.once(f"landed {name}", lambda: (build(w).write.mode("overwrite").text(path), path)[1])


def landed(w, name, build):
    """JSON files of a feed, written once per workspace."""
    path = f"{w.root}/{name}"
    return w.once(f"landed {name}", lambda: (build(w).write.mode("overwrite").json(path), path)[1])


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EVENT_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fv.EVENT_TYPES.items()) + "}"
VIEWS["raw_events"] = f"""
  SELECT event_id, {_sql_list(EVENT_KINDS)}[(event_id % 11) + 1] AS kind,
    CASE WHEN event_id % 97 <> 0 THEN 'obj_' || (event_id // 2) END AS id,
    CAST(floor(epoch(ts)) AS BIGINT) AS created,
    CASE WHEN k % 4 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS object_created,
    CAST(ROUND(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT) + 100 AS amount,
    CASE WHEN k % 6 <> 0 THEN ['usd', 'eur', 'gbp'][(k % 3) + 1] END AS currency,
    CASE WHEN k % 9 <> 0 THEN {_sql_list(EVENT_STATES)}[(user_id % 5) + 1] END AS state,
    'cus_' || user_id AS customer, {_sql_list(fv.DECLINE_CODES)}[(k % 15) + 1] AS failure_code,
    CASE WHEN k % 8 = 0 THEN 'elevated' END AS risk,
    CASE WHEN k % 50 = 0 THEN 'dp_' || event_id END AS dispute,
    CASE WHEN k % 3 = 0 THEN 'Card payment' WHEN k % 3 = 1 THEN '' END AS description,
    CASE WHEN k % 2 = 0 THEN 'STATEMENT' END AS descriptor,
    CASE WHEN k % 7 <> 0 THEN {_sql_list(fv.PRODUCT_LINES)}[(k % 5) + 1] END AS product_line,
    CASE WHEN k % 7 <> 0 THEN '{{"product_line":"' || {_sql_list(fv.PRODUCT_LINES)}[(k % 5) + 1]
      || '","order":"' || event_id || '"}}' ELSE '{{}}' END AS metadata_json
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
VIEWS["normalized_events"] = f"""
  SELECT event_id, created, id AS transaction_id, 'stripe_' || kind || '_' || id AS idempotency_key,
    TIMESTAMP '1970-01-01' + to_seconds(COALESCE(object_created, created)) AS occurred_at,
    type, status, amount, upper(COALESCE(currency, 'usd')) AS currency, customer AS customer_id,
    CASE WHEN type = 'charge' AND status = 'succeeded' THEN CAST(trunc(amount * 0.029::DOUBLE + 30) AS BIGINT)
         WHEN type = 'refund' THEN -CAST(trunc(amount * 0.029::DOUBLE) AS BIGINT) ELSE 0 END AS fee_amount,
    CASE WHEN type IN ('refund', 'payout') THEN -abs(amount)
         WHEN type = 'charge' AND status = 'succeeded'
         THEN amount - CAST(trunc(amount * 0.029::DOUBLE + 30) AS BIGINT) ELSE amount END AS net_amount,
    COALESCE(product_line, 'subscriptions') AS product_line,
    CASE WHEN type = 'charge' AND status = 'failed' THEN failure_code END AS decline_code,
    COALESCE(risk, 'normal') AS risk_level, dispute AS dispute_id,
    COALESCE(NULLIF(description, ''), NULLIF(descriptor, ''), '') AS description, metadata_json
  FROM (SELECT *, element_at({_EVENT_MAP}, kind)[1] AS type,
          CASE WHEN state IN ('succeeded', 'failed', 'pending', 'canceled') THEN state ELSE 'succeeded' END AS status
        FROM raw_events)
  WHERE type IS NOT NULL AND id IS NOT NULL"""

BANK_KINDS = [*fv.BANK_CATEGORIES, "SOMETHING_ELSE"]


def bank_pages(w):
    """One sync page per order: the order as an added row, filled orders also as a modified row."""
    o = w.table("orders")
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    cents = F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")
    dollars = F.when(F.col("o_orderkey") % 2 == 0, -cents).otherwise(cents).cast("double") / 100.0

    def row(suffix, pending):
        return F.struct(
            F.concat(F.lit("b"), F.col("o_orderkey"), F.lit(suffix)).alias("transaction_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            dollars.alias("amount"),
            F.when(F.col("o_orderkey") % 5 != 0, F.lit("USD")).alias("iso_currency_code"),
            F.when(F.col("o_orderkey") % 7 != 0, F.array(pick(BANK_KINDS, F.col("o_orderkey") % 18), F.lit("x"))).alias("category"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("name"),
            F.when(F.col("o_orderkey") % 3 == 1, F.lit("Merchant")).alias("merchant_name"),
            pending.alias("pending"),
        )

    empty = F.array().cast(BANK_SYNC_PAGE["modified"].dataType)
    pages = o.select(
        F.concat(F.lit("item_"), F.col("o_custkey")).alias("account_id"),
        F.array(row("", F.col("o_orderstatus") == "P")).alias("added"),
        F.when(F.col("o_orderstatus") == "F", F.array(row("m", F.lit(False)))).otherwise(empty).alias("modified"),
        F.array().cast(BANK_SYNC_PAGE["removed"].dataType).alias("removed"),
    )
    return pages


_ROW = """SELECT 'item_' || o_custkey AS account_id, 'b' || o_orderkey || '{suffix}' AS transaction_id,
    CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) / 100.0 AS amount,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'USD' END AS iso_currency_code,
    COALESCE(CASE WHEN o_orderkey % 7 <> 0 THEN {kinds}[(o_orderkey % 18) + 1] END, 'UNCATEGORIZED') AS category,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Merchant' END AS merchant_name,
    {pending} AS pending
  FROM orders"""
VIEWS["bank_rows"] = (
    _ROW.format(suffix="", kinds=_sql_list(BANK_KINDS), pending="o_orderstatus = 'P'")
    + "\n  UNION ALL "
    + _ROW.format(suffix="m", kinds=_sql_list(BANK_KINDS), pending="FALSE")
    + " WHERE o_orderstatus = 'F'"
)


def bank_webhooks(w):
    """Bank notifications from the event table."""
    e = w.table("events")
    k = F.get_json_object("props", "$.k").cast("int")
    codes = {
        "view": "SYNC_UPDATES_AVAILABLE",
        "click": "INITIAL_UPDATE_COMPLETE",
        "error": "HISTORICAL_UPDATE_COMPLETE",
        "purchase": "TRANSACTIONS_REMOVED",
        "signup": "ERROR",
    }
    ids = F.transform(F.sequence(F.lit(1), k % 4), lambda i: F.concat(F.lit("b"), F.col("user_id") * 4 + i))
    return e.select(
        F.when(F.col("user_id") % 10 == 0, "ITEM").otherwise("TRANSACTIONS").alias("webhook_type"),
        map_lookup(codes, "event_type").alias("webhook_code"),
        F.concat(F.lit("item_"), F.col("event_id")).alias("item_id"),
        F.when((F.col("event_type") == "purchase") & (k % 4 > 0), ids).alias("transactions_removed"),
    )


VIEWS["webhooks"] = """
  SELECT CASE WHEN user_id % 10 = 0 THEN 'ITEM' ELSE 'TRANSACTIONS' END AS webhook_type,
    CASE event_type WHEN 'view' THEN 'SYNC_UPDATES_AVAILABLE' WHEN 'click' THEN 'INITIAL_UPDATE_COMPLETE'
      WHEN 'error' THEN 'HISTORICAL_UPDATE_COMPLETE' WHEN 'purchase' THEN 'TRANSACTIONS_REMOVED' ELSE 'ERROR' END AS webhook_code,
    'item_' || event_id AS item_id,
    CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 ELSE 0 END AS n_removed,
    user_id
  FROM events"""

ENTRY_KINDS = ["charge", "refund", "payout", "fee", "transfer", "invoice_payment"]


def manual_entries(w):
    """Manual entries from customer balances; negative balances are refused entries."""
    c = w.table("customer")
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    return c.select(
        key.cast("string").alias("entry_id"),
        (F.lit("2001-07-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 700).cast("int"))).alias("entered_at"),
        F.col("c_acctbal").alias("amount_usd"),
        F.when(key % 8 != 0, pick(ENTRY_KINDS, key % 6)).alias("type"),
        F.when(key % 9 != 0, pick(["succeeded", "failed", "pending"], key % 3)).alias("status"),
        F.when(key % 4 != 0, F.lit("wire")).alias("source"),
        F.when(key % 5 != 0, F.lit("usd")).alias("currency"),
        F.when(key % 3 == 0, F.lit("Entry")).when(key % 3 == 1, F.lit("")).alias("description"),
        F.when(key % 2 == 0, F.lit("marketplace")).alias("product_line"),
        none.alias("department"),
        none.alias("account_code"),
        none.alias("cost_center"),
        F.concat(F.lit("cus_"), key).alias("customer_id"),
        none.alias("decline_code"),
        none.alias("basis"),
        F.lit(None).cast("boolean").alias("is_recurring"),
    )


# --- merges --------------------------------------------------------------------------------
def ledger_updates(w):
    """Pending rows settle five days on (with an older failed copy); disputes open a new row."""
    five_days, one_hour = F.expr("INTERVAL 5 DAYS"), F.expr("INTERVAL 1 HOUR")
    pending = w.ledger.filter(F.col("status") == "pending")
    settled = pending.withColumns(
        {
            "status": F.lit("succeeded"),
            "posted_at": F.col("occurred_at") + five_days,
            "posted_date": F.date_add("occurred_date", 5),
            "fee_amount": F.lit(30).cast("long"),
            "ingested_at": F.col("ingested_at") + five_days,
            "batch_id": F.lit("settle"),
            "description": F.lit("not merged"),
        }
    )
    older = pending.withColumns(
        {"status": F.lit("failed"), "ingested_at": F.col("ingested_at") + one_hour, "batch_id": F.lit("older")}
    )
    opened = w.ledger.filter(F.col("status") == "disputed").withColumns(
        {
            "transaction_id": F.concat(F.lit("cb-"), "transaction_id"),
            "idempotency_key": F.concat(F.lit("cb-"), "idempotency_key"),
            "type": F.lit("adjustment"),
            "status": F.lit("succeeded"),
            "net_amount": -F.col("amount"),
            "batch_id": F.lit("chargeback"),
        }
    )
    return settled.unionByName(older).unionByName(opened).drop("amount_usd", "net_amount_usd", "fee_amount_usd")


VIEWS["updates"] = """
  SELECT transaction_id, 'succeeded' AS status, occurred_date + 5 AS posted_date, net_amount, 30 AS fee_amount,
    ingested_at + INTERVAL 5 DAY AS ingested_at, 'settle' AS batch_id, type, amount, description
  FROM ledger WHERE status = 'pending'
  UNION ALL
  SELECT transaction_id, 'failed', posted_date, net_amount, fee_amount, ingested_at + INTERVAL 1 HOUR, 'older',
    type, amount, description FROM ledger WHERE status = 'pending'
  UNION ALL
  SELECT 'cb-' || transaction_id, 'succeeded', posted_date, -amount, fee_amount, ingested_at, 'chargeback',
    'adjustment', amount, description FROM ledger WHERE status = 'disputed'"""


# --- targets and budgets -------------------------------------------------------------------
def monthly_targets(w):
    """Targets of 2001: the same month's settled flows a year before."""
    good = F.col("status") == "succeeded"
    before = w.ledger.filter(F.col("occurred_year") == 2000)
    return before.groupBy(F.date_format(F.add_months("occurred_date", 12), "yyyy-MM").alias("period")).agg(
        usd_sum("amount", F.col("type").isin(fv.REVENUE_TYPES) & good).alias("inflows"),
        usd_sum("amount", F.col("type").isin(fv.OUTFLOW_TYPES) & good).alias("outflows"),
    )


_IN = "type IN ('charge', 'invoice_payment')"
_OUT = "type IN ('refund', 'payout', 'fee', 'transfer', 'adjustment')"
VIEWS["targets"] = f"""
  SELECT strftime(occurred_date + INTERVAL 1 YEAR, '%Y-%m') AS period,
    CAST(SUM(amount) FILTER (WHERE {_IN} AND status = 'succeeded') AS DOUBLE) / 100.0 AS inflows,
    CAST(SUM(amount) FILTER (WHERE {_OUT} AND status = 'succeeded') AS DOUBLE) / 100.0 AS outflows
  FROM ledger WHERE occurred_year = 2000 GROUP BY 1"""
VIEWS["factors"] = f"""
  SELECT a.period, direction, CASE direction WHEN 'inflow' THEN inflows ELSE outflows END / actual AS factor
  FROM (SELECT strftime(occurred_date, '%Y-%m') AS period,
          CASE WHEN {_IN} THEN 'inflow' ELSE 'outflow' END AS direction,
          CAST(SUM(amount) AS DOUBLE) / 100.0 AS actual
        FROM ledger WHERE status = 'succeeded' GROUP BY 1, 2) a JOIN targets t ON t.period = a.period"""


def daily_targets(w):
    """Targets per day: the mean settled flow of its month."""
    good = F.col("status") == "succeeded"
    month = F.trunc("occurred_date", "month")
    months = (
        w.ledger.groupBy(month.alias("m"))
        .agg(
            usd_sum("amount", F.col("type").isin(fv.REVENUE_TYPES) & good).alias("i"),
            usd_sum("amount", F.col("type").isin(fv.OUTFLOW_TYPES) & good).alias("o"),
        )
        .withColumn("days", F.dayofmonth(F.last_day("m")))
    )
    return months.select(
        F.explode(F.sequence("m", F.last_day("m"))).alias("period"),
        (F.col("i") / F.col("days")).alias("inflows"),
        (F.col("o") / F.col("days")).alias("outflows"),
    )


VIEWS["day_factors"] = f"""
  SELECT a.occurred_date, a.direction, target / actual AS factor
  FROM (SELECT occurred_date, CASE WHEN {_IN} THEN 'inflow' ELSE 'outflow' END AS direction,
          CAST(SUM(amount) AS DOUBLE) / 100.0 AS actual
        FROM ledger WHERE status = 'succeeded' GROUP BY 1, 2) a
  JOIN (SELECT date_trunc('month', occurred_date) AS m,
          CASE WHEN {_IN} THEN 'inflow' ELSE 'outflow' END AS direction,
          CAST(SUM(amount) FILTER (WHERE status = 'succeeded') AS DOUBLE) / 100.0
            / day(last_day(date_trunc('month', occurred_date))) AS target
        FROM ledger GROUP BY 1, 2, day(last_day(date_trunc('month', occurred_date)))) t
    ON t.m = date_trunc('month', a.occurred_date) AND t.direction = a.direction
  WHERE actual > target AND target / actual < 0.95::DOUBLE"""


def actual_lines(w):
    """Revenue, direct costs and department expenses as budget lines."""
    summary = financial_summary(revenue(w))
    lines = summary.select(
        F.inline(
            F.array(
                F.struct(F.lit("Gross Invoiced Revenue").alias("line_item"), F.col("total_revenue_ttm").alias("actual_usd")),
                F.struct(F.lit("COGS & Interchange Fees").alias("line_item"), F.col("total_cogs").alias("actual_usd")),
            )
        )
    )
    departments = expenses_by_department(w.ledger).select(
        F.col("department").alias("line_item"), F.col("amount_usd").alias("actual_usd")
    )
    return lines.unionByName(departments)


def budget_lines(w):
    """Revenue at 94 %, direct costs at 108 %, every department at the mean department."""
    actual = actual_lines(w)
    name = F.col("line_item")
    is_gross, is_cogs = name == "Gross Invoiced Revenue", name == "COGS & Interchange Fees"
    departments = actual.filter(~(is_gross | is_cogs)).agg(
        F.avg(F.col("actual_usd").cast("decimal(18,2)")).cast("double")
    )
    return actual.select(
        "line_item",
        F.when(is_gross, "Revenue").when(is_cogs, "Direct Costs").otherwise("Operating Expenses").alias("category"),
        F.when(is_gross, F.col("actual_usd") * 0.94)
        .when(is_cogs, F.col("actual_usd") * 1.08)
        .otherwise(departments.scalar())
        .alias("budget_usd"),
    )
