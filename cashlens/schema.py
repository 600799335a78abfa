"""Declared schemas. Instants are UTC wall-clock (TIMESTAMP_NTZ), money is integer cents."""

from pyspark.sql import types as T

_LONG, _STR, _TS, _DATE = T.LongType(), T.StringType(), T.TimestampNTZType(), T.DateType()
_SHORT, _DOUBLE, _BOOL = T.ShortType(), T.DoubleType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LEDGER_STORED = _struct(
    ("transaction_id", _STR),
    ("idempotency_key", _STR),
    ("occurred_at", _TS),
    ("posted_at", _TS),
    ("occurred_date", _DATE),
    ("posted_date", _DATE),
    ("occurred_hour", _SHORT),
    ("occurred_dow", _SHORT),
    ("occurred_week", _SHORT),
    ("occurred_month", _SHORT),
    ("occurred_quarter", _SHORT),
    ("occurred_year", _SHORT),
    ("type", _STR),
    ("status", _STR),
    ("source", _STR),
    ("amount", _LONG),
    ("currency", _STR),
    ("fx_rate", _DOUBLE),
    ("net_amount", _LONG),
    ("fee_amount", _LONG),
    ("customer_id", _STR),
    ("merchant_account_id", _STR),
    ("product_line", _STR),
    ("department", _STR),
    ("account_code", _STR),
    ("cost_center", _STR),
    ("basis", _STR),
    ("decline_code", _STR),
    ("risk_level", _STR),
    ("dispute_id", _STR),
    ("dispute_status", _STR),
    ("is_recurring", _BOOL),
    ("description", _STR),
    ("metadata_json", _STR),
    ("ingested_at", _TS),
    ("batch_id", _STR),
)
GENERATED_COLUMNS = ["amount_usd", "net_amount_usd", "fee_amount_usd"]
LEDGER = T.StructType(
    LEDGER_STORED.fields + [T.StructField(c, _DOUBLE, True) for c in GENERATED_COLUMNS]
)
LEDGER_PARTITIONS = ["occurred_year", "occurred_month"]

CUSTOMERS = _struct(
    ("customer_id", _STR),
    ("customer_email", _STR),
    ("customer_name", _STR),
    ("created_at", _TS),
    ("country", _STR),
    ("plan", _STR),
    ("ltv_usd", _DOUBLE),
    ("is_active", _BOOL),
)
MERCHANTS = _struct(
    ("merchant_account_id", _STR),
    ("account_name", _STR),
    ("currency", _STR),
    ("country", _STR),
    ("is_active", _BOOL),
)
FORECAST = _struct(
    ("forecast_date", _DATE),
    ("prediction_date", _DATE),
    ("horizon_days", _SHORT),
    ("p10_net_flow_usd", _DOUBLE),
    ("p50_net_flow_usd", _DOUBLE),
    ("p90_net_flow_usd", _DOUBLE),
    ("p50_inflows_usd", _DOUBLE),
    ("p50_outflows_usd", _DOUBLE),
    ("starting_cash_usd", _DOUBLE),
    ("p10_cumulative_cash_usd", _DOUBLE),
    ("p50_cumulative_cash_usd", _DOUBLE),
    ("p90_cumulative_cash_usd", _DOUBLE),
    ("p10_runway_days", _LONG),
    ("p50_runway_days", _LONG),
    ("p90_runway_days", _LONG),
    ("model_version", _STR),
    ("model_trained_at", _TS),
    ("feature_set_version", _STR),
    ("created_at", _TS),
)
DECLINE_PREDICTIONS = _struct(
    ("transaction_id", _STR),
    ("decline_code", _STR),
    ("card_brand", _STR),
    ("card_funding", _STR),
    ("amount_usd", _DOUBLE),
    ("occurred_hour", _SHORT),
    ("customer_id", _STR),
    ("customer_retry_history", _STR),
    ("retry_success_probability", _DOUBLE),
    ("recommended_action", _STR),
    ("recommended_retry_at", _TS),
    ("expected_recovery_usd", _DOUBLE),
    ("model_version", _STR),
    ("scored_at", _TS),
)
MODEL_REGISTRY = _struct(
    ("model_name", _STR),
    ("version", _STR),
    ("file_path", _STR),
    ("metrics_json", _STR),
    ("trained_at", _TS),
    ("is_active", _BOOL),
    ("feature_columns", T.ArrayType(_STR)),
    ("target_column", _STR),
)

# Payment-processor event: the payload sits in data.object; flat events carry it at the top.
_PAYLOAD_FIELDS = [
    ("id", _STR),
    ("created", _LONG),
    ("amount", _LONG),
    ("currency", _STR),
    ("status", _STR),
    ("customer", _STR),
    ("failure_code", _STR),
    ("outcome", _struct(("risk_level", _STR))),
    ("dispute", _STR),
    ("description", _STR),
    ("statement_descriptor", _STR),
    ("metadata", T.MapType(_STR, _STR)),
]
EVENT_PAYLOAD = _struct(*_PAYLOAD_FIELDS)
PROCESSOR_EVENT = _struct(
    ("type", _STR), ("data", _struct(("object", EVENT_PAYLOAD))), *_PAYLOAD_FIELDS
)

BANK_TRANSACTION = _struct(
    ("transaction_id", _STR),
    ("date", _STR),
    ("amount", _DOUBLE),
    ("iso_currency_code", _STR),
    ("category", T.ArrayType(_STR)),
    ("name", _STR),
    ("merchant_name", _STR),
    ("pending", _BOOL),
)
BANK_SYNC_PAGE = _struct(
    ("account_id", _STR),
    ("added", T.ArrayType(BANK_TRANSACTION)),
    ("modified", T.ArrayType(BANK_TRANSACTION)),
    ("removed", T.ArrayType(_struct(("transaction_id", _STR)))),
)
# a page as it is read first: each transaction still a text
BANK_SYNC_TEXT = _struct(("account_id", _STR), ("added", T.ArrayType(_STR)), ("modified", T.ArrayType(_STR)))
BANK_WEBHOOK = _struct(
    ("webhook_type", _STR),
    ("webhook_code", _STR),
    ("item_id", _STR),
    ("transactions_removed", T.ArrayType(_STR)),
)
MANUAL_ENTRY = _struct(
    ("entry_id", _STR),
    ("entered_at", _TS),
    ("amount_usd", _DOUBLE),
    ("type", _STR),
    ("status", _STR),
    ("source", _STR),
    ("currency", _STR),
    ("description", _STR),
    ("product_line", _STR),
    ("department", _STR),
    ("account_code", _STR),
    ("cost_center", _STR),
    ("customer_id", _STR),
    ("decline_code", _STR),
    ("basis", _STR),
    ("is_recurring", _BOOL),
)
