"""Golden cases: generated columns, views, normalisers, merge."""

import json

from pyspark.sql import functions as F

from cashlens import fixed_values as fv
from cashlens.operators import marts, merge, quality
from cashlens.schema import BANK_TRANSACTION, BANK_WEBHOOK, MANUAL_ENTRY, PROCESSOR_EVENT
from cashlens.sources import feeds
from cashlens.sources.ledger import read_ledger, write_ledger


def base(**over):
    row = {
        "transaction_id": "txn_001",
        "idempotency_key": "idem_001",
        "occurred_at": "2024-01-15 00:00:00",
        "posted_date": "2024-01-15",
        "type": "charge",
        "status": "succeeded",
        "source": "stripe",
        "amount": 10000,
        "currency": "USD",
        "fx_rate": 1.0,
        "net_amount": 9710,
        "fee_amount": 290,
        "customer_id": "cus_001",
        "basis": "cash",
    }
    return row | over


THREE = [
    base(),
    base(transaction_id="txn_002", type="refund", amount=2000, net_amount=-2000, fee_amount=0),
    base(transaction_id="txn_003", occurred_at="2024-01-16 00:00:00", posted_date="2024-01-16", amount=5000,
         net_amount=4855, fee_amount=145),
]


def test_generated_columns(ledger_of):
    row = ledger_of([base()]).first()
    assert (row.amount_usd, row.net_amount_usd, row.fee_amount_usd) == (100.0, 97.10, 2.90)


def test_daily_cash_position(ledger_of):
    rows = marts.daily_cash_position(ledger_of(THREE)).orderBy("date").collect()
    assert len(rows) == 2
    assert rows[0][1:] == (97.10, 20.00, 77.10, 77.10)
    assert rows[1].cumulative_cash_usd == 125.65


def test_undated_flows_come_last(ledger_of):
    rows = marts.daily_cash_position(ledger_of([*THREE, base(transaction_id="x", posted_date=None)]))
    last = rows.orderBy(F.col("date").asc_nulls_last()).collect()[-1]
    assert last.date is None and last.cumulative_cash_usd == 222.75


def test_exchange_rates_are_exact(ledger_of):
    rows = [base(transaction_id=str(i), amount=1, net_amount=1, currency="EUR", fx_rate=0.1) for i in range(10)]
    assert marts.daily_cash_position(ledger_of(rows)).first().net_flow_usd == 0.01


def test_net_revenue_needs_revenue(ledger_of):
    refund = base(type="refund", basis="accrual", product_line="ecommerce")
    row = marts.revenue_by_product(ledger_of([refund])).first()
    assert row.revenue_usd is None and row.refunds_usd == 100.0 and row.net_revenue_usd is None


def test_date_parts(ledger_of):
    row = ledger_of([base(occurred_at="2026-08-25 14:30:00")]).first()
    assert (row.occurred_hour, row.occurred_month, row.occurred_quarter, row.occurred_year) == (14, 8, 3, 2026)
    assert row.occurred_dow == 2 and row.occurred_week == 35


def events(spark, *items):
    return spark.read.schema(PROCESSOR_EVENT).json(spark.sparkContext.parallelize([json.dumps(i) for i in items]))


def charge(**over):
    body = {
        "id": "ch_1", "amount": 15000, "currency": "usd", "status": "succeeded", "customer": "cus_9",
        "description": "Test", "metadata": {"product_line": "ecommerce"},
    } | over
    return {"id": "evt_1", "type": "charge.succeeded", "created": 1700000000, "data": {"object": body}}


def test_processor_charge(spark):
    row = feeds.normalize_processor(events(spark, charge()), "acct").first()
    fee = int(15000 * 0.029 + 30)
    assert (row.type, row.status, row.source, row.currency) == ("charge", "succeeded", "stripe", "USD")
    assert (row.fee_amount, row.net_amount) == (fee, 15000 - fee)
    assert row.product_line == "ecommerce" and row.department == "engineering"
    assert row.idempotency_key == "stripe_charge.succeeded_ch_1"
    assert str(row.occurred_at) == "2023-11-14 22:13:20"


def test_processor_refund_failed_and_dropped(spark):
    refund = charge(id="re_1", amount=5000) | {"type": "charge.refunded"}
    failed = charge(id="ch_2", status="failed", failure_code="do_not_honor") | {"type": "charge.failed"}
    unsupported = charge() | {"type": "customer.created"}
    no_id = charge(id=None)
    flat = {"type": "payout.paid", "id": "po_1", "created": 1700000000, "amount": 700, "status": "weird"}
    rows = feeds.normalize_processor(events(spark, refund, failed, unsupported, no_id, flat), "acct").collect()
    got = {r.transaction_id: r for r in rows}
    assert set(got) == {"re_1", "ch_2", "po_1"}
    assert got["re_1"].type == "refund" and got["re_1"].net_amount == -5000 and got["re_1"].fee_amount == -145
    assert got["ch_2"].decline_code == "do_not_honor" and got["ch_2"].net_amount == 15000
    assert got["po_1"].net_amount == -700 and got["po_1"].status == "succeeded"


def bank(spark, **over):
    row = {
        "transaction_id": "b1", "date": "2026-08-01", "amount": 45.50, "iso_currency_code": "USD",
        "category": ["SOFTWARE_SUBSCRIPTIONS"], "name": "Tool", "pending": False,
    } | over
    return spark.createDataFrame([tuple(row.get(f.name) for f in BANK_TRANSACTION)], BANK_TRANSACTION)


def test_bank_rows(spark):
    row = feeds.normalize_bank(bank(spark), "item").first()
    assert (row.transaction_id, row.amount, row.net_amount, row.product_line) == ("plaid_b1", 4550, -4550, "engineering")
    income = feeds.normalize_bank(bank(spark, amount=-1200.0, category=["INCOME_WAGES"]), "item").first()
    assert income.net_amount == 120000 and income.type == "invoice_payment"
    assert feeds.normalize_bank(bank(spark, pending=True), "item").count() == 0
    other = feeds.normalize_bank(bank(spark, category=None, name="", iso_currency_code=None), "item").first()
    assert (other.type, other.product_line, other.description, other.currency) == (
        "charge", "operations", "Bank transaction", "USD")


def test_manual_entries(spark):
    def entry(**over):
        row = {"entry_id": "1", "amount_usd": 19.99, **over}
        return tuple(row.get(f.name) for f in MANUAL_ENTRY)

    rows = [entry(), entry(entry_id="2", type="refund"), entry(entry_id="3", amount_usd=-5.0)]
    df = spark.createDataFrame(rows, MANUAL_ENTRY).withColumn(
        "entered_at", F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    )
    got = {r.transaction_id: r for r in feeds.normalize_manual(df, "acct").collect()}
    assert set(got) == {"manual_1", "manual_2"}
    assert got["manual_1"].amount == 1999 and got["manual_1"].fee_amount == int(1999 * 0.029 + 30)
    assert got["manual_2"].net_amount == -1999 and got["manual_2"].fee_amount == -57
    assert got["manual_1"].description == "Manual charge" and got["manual_1"].basis == "cash"


def test_webhook_routes(spark):
    rows = [
        ("TRANSACTIONS", "SYNC_UPDATES_AVAILABLE", "i1", None),
        ("TRANSACTIONS", "TRANSACTIONS_REMOVED", "i2", ["a", "b"]),
        ("TRANSACTIONS", "TRANSACTIONS_REMOVED", "i3", None),
        ("ITEM", "ERROR", "i4", None),
    ]
    df = spark.createDataFrame(rows, BANK_WEBHOOK)
    got = {r.item_id: (r.status, r.action, r.removed_count) for r in feeds.route_bank_webhooks(df).collect()}
    assert got == {
        "i1": ("accepted", "queued_sync", None),
        "i2": ("accepted", "queued_removal", 2),
        "i3": ("accepted", "queued_removal", 0),
        "i4": ("ignored", None, None),
    }


def test_upsert_updates_nine_columns(ledger_of):
    old = ledger_of([base(amount=5000, net_amount=4825, description="old")])
    new = ledger_of([
        base(amount=9999, net_amount=4825, status="refunded", description="new", ingested_at="2024-02-01 00:00:00"),
        base(status="pending", ingested_at="2024-01-20 00:00:00"),
        base(transaction_id="txn_new", ingested_at="2024-01-20 00:00:00"),
    ])
    rows = {r.transaction_id: r for r in merge.merge_ledger(old, new).collect()}
    assert len(rows) == 2
    row = rows["txn_001"]
    assert (row.status, row.amount_usd, row.net_amount_usd, row.description) == ("refunded", 50.0, 48.25, "old")
    again = merge.merge_ledger(merge.merge_ledger(old, new), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.values()))


def test_write_read_prune(spark, ledger_of, new_dir):
    path = new_dir("ledger")
    write_ledger(ledger_of([*THREE, base(transaction_id="feb", occurred_at="2024-02-03 10:00:00")]), path)
    rows = read_ledger(spark, path, "2024-02-01", "2024-02-28")
    assert [r.transaction_id for r in rows.collect()] == ["feb"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "occurred_month" in plan.split("PartitionFilters")[1]
    assert "PushedFilters: [IsNotNull(occurred_date)" in plan


def test_path_upsert_touches_its_months_only(spark, ledger_of, new_dir):
    import glob
    import os

    path = new_dir("ledger")
    write_ledger(ledger_of([*THREE, base(transaction_id="feb", occurred_at="2024-02-03 10:00:00")]), path)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/occurred_month=2/*.parquet")}
    changes = ledger_of([
        base(status="refunded", occurred_at="2024-05-05 00:00:00", ingested_at="2024-02-01 00:00:00"),
        base(transaction_id="mar", occurred_at="2024-03-03 10:00:00"),
    ])
    for _ in range(2):
        merge.upsert_ledger_path(spark, path, changes)
        rows = {r.transaction_id: r for r in read_ledger(spark, path).collect()}
        assert len(rows) == 5 and rows["txn_001"].status == "refunded"
        assert str(rows["txn_001"].occurred_date) == "2024-01-15"
    assert before == {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/occurred_month=2/*.parquet")}


def test_fixed_tables():
    assert len(fv.EVENT_TYPES) == 10 and len(fv.BANK_CATEGORIES) == 17 and len(fv.DECLINE_CODES) == 15


def test_missing_partition_values_survive_a_merge(spark, new_dir):
    path, schema = new_dir("table"), "id int, v string, part string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    merge.upsert_table(spark, path, rows((1, "a", None), (2, "b", None), (3, "c", "x")), ["id"], ["part"], order_by=())
    merge.upsert_table(spark, path, rows((1, "new", None), (4, "d", None)), ["id"], ["part"], order_by=())
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v", "part").collect())
    assert got == [(1, "new", None), (2, "b", None), (3, "c", "x"), (4, "d", None)]


def test_freshness(ledger_of):
    ledger = ledger_of([base()])
    assert quality.freshness(ledger, "2024-01-17").first().is_fresh
    assert not quality.freshness(ledger, "2024-01-18").first().is_fresh
    assert quality.freshness(ledger, "2024-01-01").first().age_hours == 0
    assert not quality.freshness(ledger.limit(0), "2024-01-01").first().is_fresh


def test_control_totals(ledger_of, spark):
    rows = [
        base(transaction_id="a", amount=30000, net_amount=29000, fee_amount=1000),
        base(transaction_id="b", amount=10000, net_amount=9000, fee_amount=1000, status="failed"),
        base(transaction_id="c", type="payout", amount=100, net_amount=-100, fee_amount=0),
        base(transaction_id="d", occurred_at="2024-02-01 00:00:00", amount=777),
    ]
    ledger = ledger_of(rows)
    targets = spark.createDataFrame([("2024-01", 150.0, 0.5)], "period string, inflows double, outflows double")
    pick = lambda df: {r.transaction_id: (r.amount, r.net_amount, r.fee_amount) for r in df.collect()}
    plain = pick(quality.scale_to_targets(ledger, targets))
    assert plain == {"a": (15000, 14500, 500), "b": (5000, 4500, 500), "c": (50, -50, 0), "d": (777, 9710, 290)}
    floors = pick(quality.scale_to_targets(ledger, targets, floors=True))
    assert floors["c"] == (100, -100, 0) and floors["a"] == (15000, 14500, 500)
    days = spark.createDataFrame([("2024-01-15", 295.0, 0.5)], "period string, inflows double, outflows double")
    days = days.withColumn("period", F.to_date("period"))
    capped = pick(quality.cap_daily_spikes(ledger, days))
    assert capped["a"] == (30000, 29000, 1000) and capped["c"] == (100, -100, 0)


def test_sparse_days(ledger_of):
    rows = [base(transaction_id=str(i)) for i in range(5)] + [base(transaction_id="x", occurred_at="2024-01-16 09:00:00")]
    got = {str(r.occurred_date): r.row_count for r in quality.sparse_days(ledger_of(rows), "2024-01-14", "2024-01-17").collect()}
    assert got == {"2024-01-14": 0, "2024-01-16": 1, "2024-01-17": 0}
