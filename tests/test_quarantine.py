"""Lines that cannot be read are kept and counted: rows in are rows out and rows set aside."""

import json

from cashlens import jobs
from cashlens.schema import PROCESSOR_EVENT
from cashlens.sources import feeds, quarantine
from cashlens.sources.ledger import quarantine_path, read_ledger
from cashlens.streaming import streams

BASE = 1700000000


def event(i, **other):
    body = {"id": f"obj_{i}", "created": BASE + i, "amount": 1500, "currency": "usd", "status": "succeeded"}
    return json.dumps({"type": "charge.succeeded", "created": BASE + i, "data": {"object": body}} | other)


BAD = {
    '{"type": "charge.succeeded", "created": 17': quarantine.NOT_JSON,
    "plain text": quarantine.NOT_JSON,
    "[1, 2": quarantine.NOT_JSON,
    '{"type": "charge.succeeded", "created": "soon"}': quarantine.WRONG_TYPE,
    event(7, data={"object": {"id": "obj_7", "amount": "much"}}): quarantine.WRONG_TYPE,
    '{"created": 1700000003}': "no type",
}
GOOD = [event(1), "", "  ", event(2), f"[{event(3)}, {event(4)}]"]


def land(folder, *files):
    folder.mkdir()
    for n, rows in enumerate(files):
        (folder / f"part-{n}.json").write_text("\n".join(rows))
    return str(folder)


def test_every_line_is_a_row_or_set_aside(spark, tmp_path):
    path = land(tmp_path / "in", [*GOOD, *BAD])
    rows = quarantine.parsed(quarantine.lines(spark.read, path), PROCESSOR_EVENT, required=("type", "created"))
    assert rows.count() == 4 + len(BAD)
    assert {r.line: r.reason for r in quarantine.broken(rows).collect()} == BAD
    good = quarantine.readable(rows)
    assert good.columns == [f.name for f in PROCESSOR_EVENT.fields] and good.schema == PROCESSOR_EVENT
    assert sorted(r.data.object.id for r in good.collect()) == ["obj_1", "obj_2", "obj_3", "obj_4"]
    # whatever columns are asked for, the same lines are broken
    assert good.select("type").count() == 4 and rows.filter("reason IS NOT NULL").select("reason").count() == len(BAD)
    assert feeds.read_processor_events(spark, path, BASE, BASE + 3).count() == 3
    assert quarantine.parsed(quarantine.lines(spark.read, land(tmp_path / "none", [])), PROCESSOR_EVENT).count() == 0


def test_event_job_counts_what_it_sets_aside(spark, tmp_path, new_dir):
    path, ledger = land(tmp_path / "in", GOOD, list(BAD)), new_dir("ledger")
    assert jobs.ingest_processor_events(spark, path, ledger, "acct", BASE, BASE + 10) == len(BAD)
    assert jobs.ingest_processor_events(spark, path, ledger, "acct", BASE, BASE + 10) == len(BAD)
    assert read_ledger(spark, ledger).count() == 4
    kept = spark.read.parquet(quarantine_path(ledger, "events"))
    assert {r.line: r.reason for r in kept.collect()} == BAD and kept.count() == len(BAD)


def test_stream_counts_by_batch(spark, tmp_path, new_dir):
    bad, ledger = list(BAD), new_dir("ledger")
    path = land(tmp_path / "in", [*GOOD, bad[0]], bad[1:], [event(9)])
    events = feeds.stream_processor_events(spark, path, broken=True, maxFilesPerTrigger=1)
    streams.stream_to_ledger(events, ledger, new_dir("ckpt")).awaitTermination()
    assert read_ledger(spark, ledger).count() == 5
    kept = spark.read.parquet(quarantine_path(ledger, "events"))
    assert sorted(r["count"] for r in kept.groupBy("batch").count().collect()) == [1, len(bad) - 1]
    assert {r.line for r in kept.collect()} == set(bad)
    # a stream that does not ask for them goes on without them
    plain = feeds.stream_processor_events(spark, path)
    assert plain.columns == [f.name for f in PROCESSOR_EVENT.fields]


def test_bank_pages_lose_only_their_broken_rows(spark, tmp_path, new_dir):
    row = {"transaction_id": "a", "date": "2026-08-01", "amount": -12.5, "category": ["RENT"], "name": "x", "pending": False}
    pages = [
        json.dumps({"account_id": "acc", "added": [row, row | {"transaction_id": "b", "amount": "much"}], "modified": []}),
        json.dumps({"account_id": "acc", "modified": [row | {"transaction_id": "c"}], "removed": [{"transaction_id": "z"}]}),
        '{"account_id": "acc", "added": [',
    ]
    path, ledger = land(tmp_path / "in", pages), new_dir("bank")
    assert sorted(r.transaction_id for r in feeds.read_bank_sync(spark, path).collect()) == ["a", "c"]
    assert jobs.ingest_bank_sync(spark, path, ledger) == 2
    got = {r.transaction_id: r.net_amount for r in read_ledger(spark, ledger).collect()}
    assert got == {"plaid_a": 1250, "plaid_c": 1250}
    kept = {r.reason: r.line for r in spark.read.parquet(quarantine_path(ledger, "bank")).collect()}
    assert kept[quarantine.NOT_JSON] == pages[2] and json.loads(kept[quarantine.WRONG_TYPE])["transaction_id"] == "b"
