"""Streams over several micro-batches give what one batch gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cashlens.operators import merge
from cashlens.schema import PROCESSOR_EVENT
from cashlens.session import shared_dir
from cashlens.sources import feeds
from cashlens.sources.ledger import read_ledger, write_ledger
from cashlens.streaming import streams

BASE = 1700000000
TYPES = [
    "charge.succeeded", "charge.failed", "charge.refunded", "refund.created", "payout.created", "payout.paid",
    "payout.failed", "invoice.payment_succeeded", "invoice.payment_failed", "transfer.created",
]


def event(i, kind="charge.succeeded", txn=None, status="succeeded", at=None, created=None, amount=15000):
    body = {"id": txn or f"obj_{i}", "created": BASE + (i if at is None else at), "amount": amount, "currency": "usd",
            "status": status, "customer": "cus_1", "failure_code": "do_not_honor"}
    return {"id": f"evt_{i}", "type": kind, "created": BASE + (i if created is None else created), "data": {"object": body}}


DAY = 86400
FILES = [
    [event(i, kind) for i, kind in enumerate(TYPES)] + [event(50, "customer.created")],
    # a failed charge recovers; a copy of a known event; one without an id
    [event(100, "charge.failed", "ch_x", "failed", at=100), event(1, TYPES[1]), event(3) | {"data": {"object": {"amount": 5}}}],
    [event(200, "charge.succeeded", "ch_x", at=100), event(200, "charge.succeeded", "ch_x", at=100)],
    # far ahead, then an event much older than anything a watermark keeps
    [event(300, at=40 * DAY, created=40 * DAY)],
    [event(400, txn="late", at=-30 * DAY, created=40 * DAY + 1)],
]


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for n, events in enumerate(FILES):
        path = folder / f"part-{n}.json"
        path.write_text("\n".join(json.dumps(e) for e in events))
        os.utime(path, (BASE + n, BASE + n))
    return str(folder)


def test_event_source(spark, landed):
    rows = feeds.read_processor_events(spark, landed, BASE, BASE + 200)
    assert rows.count() == 10 + 3 + 2
    assert rows.filter("type = 'customer.created'").count() == 0


def test_stream_to_ledger(spark, landed, new_dir):
    events = feeds.stream_processor_events(spark, landed, maxFilesPerTrigger=1)
    path = new_dir("ledger")
    streams.stream_to_ledger(events, path, new_dir("ckpt")).awaitTermination()
    rows = {r.transaction_id: r for r in read_ledger(spark, path).collect()}
    assert len(rows) == 13  # ten kinds, the recovered charge, the two far events
    assert "late" in rows and str(rows["late"].occurred_date) == "2023-10-15"
    x = rows["ch_x"]
    assert x.status == "succeeded" and x.fee_amount == 465 and x.net_amount == 14535 and x.net_amount_usd == 145.35
    batch = feeds.normalize_processor(spark.read.schema(PROCESSOR_EVENT).json(landed), "acct_main")
    assert {r.transaction_id for r in batch.select("transaction_id").distinct().collect()} == set(rows)
    # running on with nothing new changes nothing
    again = feeds.stream_processor_events(spark, landed, maxFilesPerTrigger=1)
    streams.stream_to_ledger(again, path, new_dir("ckpt")).awaitTermination()
    assert read_ledger(spark, path).count() == 13


def test_stream_removals(spark, new_dir):
    rows = spark.createDataFrame(
        [(f"b{i}", "2026-08-01", 1.0, "USD", ["RENT"], "x", None, False) for i in range(6)],
        "transaction_id string, date string, amount double, iso_currency_code string, category array<string>, name string, merchant_name string, pending boolean",
    )
    path = new_dir("bank")
    write_ledger(feeds.normalize_bank(rows, "item"), path)
    hooks = new_dir("hooks")
    spark.createDataFrame(
        [("TRANSACTIONS", "TRANSACTIONS_REMOVED", "i", ["b1", "b2", "unknown"]), ("TRANSACTIONS", "TRANSACTIONS_REMOVED", "i", ["b2"]),
         ("TRANSACTIONS", "SYNC_UPDATES_AVAILABLE", "i", ["b3"])],
        "webhook_type string, webhook_code string, item_id string, transactions_removed array<string>",
    ).repartition(3).write.json(hooks)
    stream = streams.stream_bank_webhooks(spark, hooks)
    streams.stream_removals(stream, path, new_dir("ckpt")).awaitTermination()
    got = {r.transaction_id: r.status for r in read_ledger(spark, path).collect()}
    assert {k for k, v in got.items() if v == "removed"} == {"plaid_b1", "plaid_b2"} and len(got) == 6


def test_live_streams_follow_the_ledger(spark, landed, new_dir):
    """With default arguments and a file per batch: repeated, recovered and 30-day-late events give the batch result."""
    for start, pick in ((streams.stream_hourly_counts, streams.hourly_counts), (streams.stream_daily_stats, streams.daily_stats)):
        path, ledger = new_dir(start.__name__), new_dir(f"{start.__name__}-ledger")
        events = feeds.stream_processor_events(spark, landed, maxFilesPerTrigger=1)
        start(events, ledger, path, new_dir(f"{start.__name__}-ckpt")).awaitTermination()
        want = pick(read_ledger(spark, ledger))
        got = spark.read.parquet(path).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert read_ledger(spark, ledger).count() == 13
    volumes = {str(r.day): r.volume for r in spark.read.parquet(new_dir("stream_daily_stats")).collect()}
    assert sum(volumes.values()) == 13 and volumes["2023-10-15"] == 1


def test_merges_leave_no_staging(spark, landed, new_dir):
    shared = shared_dir(spark).removeprefix("file://")
    before = {x for x in os.listdir(shared) if x.startswith("cashlens-merge-")}
    events = feeds.stream_processor_events(spark, landed, maxFilesPerTrigger=1)
    streams.stream_to_ledger(events, new_dir("clean"), new_dir("clean-ckpt")).awaitTermination()
    assert {x for x in os.listdir(shared) if x.startswith("cashlens-merge-")} <= before


def test_copied_tables(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    target = spark.createDataFrame([(1, "old")], "id int, v string")
    merged, count = merge.copy_tables({"t": source}, {"t": target}, {"t": ["id"]})["t"]
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "old"), (2, "b")]
    assert count.select(F.col("row_count")).first()[0] == 2
