"""Processor, bank and manual feeds: sources and normalisation to ledger rows."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rules import (
    fee_cents,
    from_micros,
    idempotency_key,
    map_event_type,
    map_lookup,
    map_status,
    net_cents,
    with_date_parts,
)
from ..schema import BANK_SYNC_TEXT, BANK_TRANSACTION, EVENT_PAYLOAD, PROCESSOR_EVENT
from . import quarantine
from .ledger import stored_columns


def utc_now():
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def from_epoch(seconds):
    """Epoch seconds to UTC wall-clock time."""
    return from_micros(seconds * 1_000_000)


def _text_or(*choices):
    """First choice that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices[:-1]], choices[-1])


def processor_event_lines(spark, path, start, end):
    """Landed events of a time range, with the broken lines of all files (see ``quarantine``)."""
    rows = quarantine.parsed(quarantine.lines(spark.read, path), PROCESSOR_EVENT, required=("type", "created"))
    wanted = F.col("created").between(start, end) & F.col("type").isin(list(fv.EVENT_TYPES))
    return rows.filter(F.col("reason").isNotNull() | wanted)


def read_processor_events(spark, path, start, end):
    """Landed event files: supported types created within two epoch seconds (inclusive).

    What cannot be read is left out here; ``processor_event_lines`` has it.
    """
    return quarantine.readable(processor_event_lines(spark, path, start, end))


def bank_sync_lines(spark, path):
    """Added and modified rows of landed sync pages, with the pages and the rows in them that are broken.

    A broken row of a page is set aside alone.
    """
    pages = quarantine.parsed(quarantine.lines(spark.read, path), BANK_SYNC_TEXT)
    rows = [
        quarantine.parsed(pages.filter("reason IS NULL").select("account_id", F.explode(part).alias("line")), BANK_TRANSACTION)
        for part in ("added", "modified")
    ]
    return rows[0].unionByName(rows[1]).unionByName(quarantine.broken(pages), allowMissingColumns=True)


def read_bank_sync(spark, path):
    """Added and modified rows of landed sync pages, one row per transaction, without what cannot be read."""
    return quarantine.readable(bank_sync_lines(spark, path))


def bank_sync_rows(pages):
    rows = lambda part: pages.select("account_id", F.inline(part))
    return rows("added").unionByName(rows("modified"))


def stream_processor_events(spark, path, broken=False, **options):
    """Event files as a stream; unsupported types are dropped.

    With ``broken`` the lines that cannot be read stay, with their text and a reason, and
    ``stream_to_ledger`` sets them aside.
    """
    reader = spark.readStream
    for key, value in options.items():
        reader = reader.option(key, value)
    rows = quarantine.parsed(quarantine.lines(reader, path), PROCESSOR_EVENT, required=("type",))
    if not broken:
        rows = quarantine.readable(rows)
        return rows.filter(F.col("type").isin(list(fv.EVENT_TYPES)))
    return rows.filter(F.col("reason").isNotNull() | F.col("type").isin(list(fv.EVENT_TYPES)))


def route_bank_webhooks(df):
    """Action for each bank notification: sync, removal with its count, or ignored."""
    about_rows = F.col("webhook_type") == "TRANSACTIONS"
    sync = about_rows & F.col("webhook_code").isin(fv.BANK_SYNC_CODES)
    removal = about_rows & (F.col("webhook_code") == fv.BANK_REMOVAL_CODE)
    removed = F.coalesce(F.array_size("transactions_removed"), F.lit(0)).cast("long")
    return df.withColumns(
        {
            "status": F.when(sync | removal, "accepted").otherwise("ignored"),
            "action": F.when(sync, "queued_sync").when(removal, "queued_removal"),
            "removed_count": F.when(removal, removed),
        }
    )


def removed_ids(webhooks):
    """Feed ids named by removal notifications."""
    removal = (F.col("webhook_type") == "TRANSACTIONS") & (F.col("webhook_code") == fv.BANK_REMOVAL_CODE)
    return webhooks.filter(removal).select(F.explode("transactions_removed").alias("transaction_id"))


def normalize_processor(events, account_id, now=None, keep=()):
    """Processor events to ledger rows.

    The payload is data.object, or the event itself when it is flat. Unsupported types and events
    without an id are dropped. ``keep`` carries event columns along for ordering.
    """
    now = utc_now() if now is None else now
    flat = F.struct(*[F.col(f.name) for f in EVENT_PAYLOAD.fields])
    rows = events.withColumns({"obj": F.coalesce(F.col("data.object"), flat), "txn_type": map_event_type("type")})
    rows = rows.filter(F.col("txn_type").isNotNull() & (F.length("obj.id") > 0))
    created = F.nullif(F.coalesce("obj.created", "created"), F.lit(0))
    detail = lambda key: F.coalesce(F.try_element_at("obj.metadata", F.lit(key)), F.lit(fv.ENTRY_DEFAULTS[key]))
    rows = rows.select(
        F.col("obj.id").alias("transaction_id"),
        idempotency_key(F.lit("stripe"), "type", "obj.id").alias("idempotency_key"),
        F.coalesce(from_epoch(created), now).alias("occurred_at"),
        F.col("txn_type").alias("type"),
        map_status("obj.status").alias("status"),
        F.lit("stripe").alias("source"),
        F.coalesce("obj.amount", F.lit(0)).alias("amount"),
        F.upper(F.coalesce("obj.currency", F.lit("usd"))).alias("currency"),
        F.lit(1.0).alias("fx_rate"),
        F.col("obj.customer").alias("customer_id"),
        F.lit(account_id).alias("merchant_account_id"),
        *[detail(key).alias(key) for key in fv.ENTRY_DEFAULTS],
        F.lit("cash").alias("basis"),
        F.col("obj.failure_code").alias("decline_code"),
        F.coalesce("obj.outcome.risk_level", F.lit("normal")).alias("risk_level"),
        F.col("obj.dispute").alias("dispute_id"),
        _text_or(F.col("obj.description"), F.col("obj.statement_descriptor"), F.lit("")).alias("description"),
        F.coalesce(F.to_json("obj.metadata"), F.lit("{}")).alias("metadata_json"),
        now.alias("ingested_at"),
        F.concat(F.lit("stripe_webhook_"), F.date_format(now, "yyyyMMdd_HHmmss")).alias("batch_id"),
        *keep,
    )
    rows = rows.withColumn("fee_amount", fee_cents("type", "status", "amount")).withColumns(
        {
            "net_amount": net_cents("type", "status", "amount", "fee_amount"),
            "decline_code": F.when(
                (F.col("type") == "charge") & (F.col("status") == "failed"), F.col("decline_code")
            ),
        }
    )
    return _posted_when_occurred(rows, keep)


def _posted_when_occurred(rows, keep=()):
    rows = with_date_parts(rows).withColumns(
        {"posted_at": F.col("occurred_at"), "posted_date": F.col("occurred_date")}
    )
    return rows.select(*stored_columns(rows), *keep)


def normalize_bank(rows, account_id=None, now=None):
    """Bank rows to ledger rows; pending ones wait for their final copy.

    A negative bank amount is money coming in. The first category decides type and product.
    """
    now = utc_now() if now is None else now
    account = F.col("account_id") if account_id is None else F.lit(account_id)
    category = F.coalesce(F.get("category", F.lit(0)), F.lit("UNCATEGORIZED"))
    amount = F.coalesce("amount", F.lit(0.0))
    cents = F.abs(amount * 100.0).cast("long")
    credit = amount < 0
    kind = {k: v[0] for k, v in fv.BANK_CATEGORIES.items()}
    product = {k: v[1] for k, v in fv.BANK_CATEGORIES.items()}
    product_line = F.coalesce(map_lookup(product, category), F.lit(fv.BANK_CATEGORY_DEFAULT[1]))
    key = F.concat(F.lit("plaid_"), F.col("transaction_id"))
    settled = rows.filter(~F.coalesce("pending", F.lit(False)))
    return _posted_when_occurred(
        settled.select(
            key.alias("transaction_id"),
            key.alias("idempotency_key"),
            F.to_date("date").cast("timestamp_ntz").alias("occurred_at"),
            F.coalesce(map_lookup(kind, category), F.lit(fv.BANK_CATEGORY_DEFAULT[0])).alias("type"),
            F.lit("succeeded").alias("status"),
            F.lit("plaid").alias("source"),
            cents.alias("amount"),
            _text_or(F.col("iso_currency_code"), F.lit("USD")).alias("currency"),
            F.lit(1.0).alias("fx_rate"),
            F.when(credit, cents).otherwise(-cents).alias("net_amount"),
            account.alias("merchant_account_id"),
            product_line.alias("product_line"),
            product_line.alias("department"),
            F.when(credit, "4000-revenue").otherwise("6000-expense").alias("account_code"),
            F.lit("CC-OPS-001").alias("cost_center"),
            F.lit("cash").alias("basis"),
            F.lit("normal").alias("risk_level"),
            _text_or(F.col("name"), F.col("merchant_name"), F.lit("Bank transaction")).alias("description"),
            F.to_json(F.struct(category.alias("plaid_category"), account.alias("account_id"))).alias("metadata_json"),
            now.alias("ingested_at"),
            F.concat(F.lit("plaid_webhook_"), F.date_format(now, "yyyyMMdd_HHmmss")).alias("batch_id"),
        )
    )


def normalize_manual(rows, account_id):
    """Manual entries to ledger rows; amounts must be positive dollars."""
    cents = F.bround(F.col("amount_usd") * 100.0, 0).cast("long")
    kind = F.coalesce("type", F.lit("charge"))
    state = F.coalesce("status", F.lit("succeeded"))
    entered = rows.filter(F.col("amount_usd") > 0).select(
        F.concat(F.lit("manual_"), "entry_id").alias("transaction_id"),
        F.concat(F.lit("manual_"), "entry_id").alias("idempotency_key"),
        F.col("entered_at").alias("occurred_at"),
        kind.alias("type"),
        state.alias("status"),
        F.coalesce("source", F.lit("manual")).alias("source"),
        cents.alias("amount"),
        F.upper(F.coalesce("currency", F.lit("USD"))).alias("currency"),
        F.lit(1.0).alias("fx_rate"),
        "customer_id",
        F.lit(account_id).alias("merchant_account_id"),
        *[_text_or(F.col(key), F.lit(default)).alias(key) for key, default in fv.ENTRY_DEFAULTS.items()],
        F.coalesce("basis", F.lit("cash")).alias("basis"),
        "decline_code",
        F.lit("normal").alias("risk_level"),
        F.coalesce("is_recurring", F.lit(False)).alias("is_recurring"),
        _text_or(F.col("description"), F.concat(F.lit("Manual "), kind)).alias("description"),
        F.lit('{"source": "manual_entry"}').alias("metadata_json"),
        F.col("entered_at").alias("ingested_at"),
        F.concat(F.lit("manual_"), F.date_format("entered_at", "yyyyMMdd_HHmmss")).alias("batch_id"),
    )
    entered = entered.withColumn("fee_amount", fee_cents("type", "status", "amount"))
    return _posted_when_occurred(
        entered.withColumn("net_amount", net_cents("type", "status", "amount", "fee_amount"))
    )
