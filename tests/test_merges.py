"""Merges into written tables: the key index, cut-short and competing changes, and tables that follow the ledger."""

import os

import pytest
from pyspark.sql import functions as F

from cashlens.operators import marts, merge
from cashlens.sources.ledger import read_ledger, write_ledger
from cashlens.sources.tablelog import ConcurrentChange, TableLog
from cashlens.streaming import streams

KEPT = ["transaction_id", "status", "net_amount", "occurred_at", "occurred_date"]


def rows_of(spark, first, n, months, status="pending", start="2020-01-01", every=37):
    """n rows dealt over the months from the start on, a few days in each."""
    at = F.expr(f"timestamp_ntz'{start}' + make_ym_interval(0, cast(id % {months} as int)) + make_dt_interval(cast(id % 5 as int), 0, cast(id % {every} as int))")
    return (
        spark.range(first, first + n)
        .select(
            F.concat(F.lit("t"), "id").alias("transaction_id"), F.concat(F.lit("k"), "id").alias("idempotency_key"),
            at.alias("occurred_at"), F.lit("charge").alias("type"), F.lit(status).alias("status"), F.lit("stripe").alias("source"),
            (F.col("id") * 100).alias("amount"), (F.col("id") * 90).alias("net_amount"), F.lit(timestamp()).cast("timestamp_ntz").alias("ingested_at"),
            F.lit(1.0).alias("fx_rate"), F.lit("cash").alias("basis"), F.lit("USD").alias("currency"),
        )
        .withColumn("occurred_date", F.to_date("occurred_at"))
        .withColumn("occurred_year", F.year("occurred_at"))
        .withColumn("occurred_month", F.month("occurred_at"))
    )


def timestamp():
    return "2026-01-01 00:00:00"


def state_of(spark, path):
    return sorted(map(str, read_ledger(spark, path).select(*KEPT).collect()))


def plain_merge(before, updates):
    rows = {r.transaction_id: r.asDict() for r in before.select(*KEPT).collect()}
    for r in updates.select(*KEPT).collect():
        old = rows.setdefault(r.transaction_id, r.asDict())
        old["status"], old["net_amount"] = r.status, r.net_amount
    return sorted(str(tuple(r.values())) for r in rows.values())


def as_tuples(spark, path):
    return sorted(str(tuple(r)) for r in read_ledger(spark, path).select(*KEPT).collect())


def bytes_read(spark):
    found = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(x.getBytesRead() for x in found if x.getScheme() == "file")


def staged(path):
    return [x for x in os.listdir(f"{path}/_log") if x.startswith(("staging", "pending"))]


def test_a_small_batch_reads_no_more_of_a_larger_ledger(spark, new_dir, monkeypatch):
    monkeypatch.setattr(merge, "BUCKET_KEYS", 50)
    monkeypatch.setattr(merge, "BLOOM_KEYS", 0)
    read = {}
    for months in (6, 60):
        path = new_dir(f"ledger-{months}")
        write_ledger(rows_of(spark, 0, 100 * months, months), path)
        merge.upsert_ledger_path(spark, path, rows_of(spark, 0, 1, months, "failed"))  # builds the index
        assert TableLog(spark, path).state()["buckets"] >= months
        # twenty rows of one month, half of them new
        known = rows_of(spark, 0, 10 * months, months, "succeeded").filter("occurred_year = 2020 AND occurred_month = 1")
        batch = known.unionByName(rows_of(spark, 10**9, 10, 1, "succeeded")).cache()
        assert batch.count() == 20
        begun = bytes_read(spark)
        touched = merge.upsert_ledger_path(spark, path, batch)
        read[months] = bytes_read(spark) - begun
        assert touched == [(2020, 1)] and staged(path) == []
        got = {r.transaction_id: r.status for r in read_ledger(spark, path).collect()}
        assert len(got) == 100 * months + 10 and sum(s == "succeeded" for s in got.values()) == 20
        batch.unpersist()
    assert read[60] < 1.3 * read[6], read


@pytest.mark.parametrize("files", [1, 16])
def test_the_index_follows_merges_and_other_writers(spark, new_dir, monkeypatch, files):
    monkeypatch.setattr(merge, "BUCKET_KEYS", 40)
    monkeypatch.setattr(merge, "BUCKET_FILES", files)
    path = new_dir("ledger")
    for n, (first, count) in enumerate([(0, 100), (50, 100), (140, 30), (0, 30), (400, 500)]):
        before = read_ledger(spark, path) if n else rows_of(spark, 0, 0, 1)
        updates = rows_of(spark, first, count, 5, f"s{n}")
        want = plain_merge(before, updates)
        merge.upsert_ledger_path(spark, path, updates)
        assert as_tuples(spark, path) == want
    # rows that something else appended are found too
    write_ledger(rows_of(spark, 2000, 40, 5), path, mode="append")
    want = plain_merge(read_ledger(spark, path), rows_of(spark, 1990, 30, 5, "late"))
    merge.upsert_ledger_path(spark, path, rows_of(spark, 1990, 30, 5, "late"))
    assert as_tuples(spark, path) == want
    log = TableLog(spark, path)
    keys = merge._index(spark, log, log.state())
    assert sorted(r[0] for r in keys.select(merge.KEY).collect()) == sorted(r[0] for r in read_ledger(spark, path).select(merge.KEY).collect())


def test_the_second_writer_is_refused(spark, new_dir, monkeypatch):
    path = new_dir("ledger")
    write_ledger(rows_of(spark, 0, 60, 3), path)
    first, second = rows_of(spark, 0, 10, 3, "first"), rows_of(spark, 5, 10, 3, "second")
    merge.upsert_ledger_path(spark, path, rows_of(spark, 0, 1, 3, "x"))
    want = plain_merge(read_ledger(spark, path), first)
    original = merge.write_partitions

    def meanwhile(*args):
        monkeypatch.setattr(merge, "write_partitions", original)
        merge.upsert_ledger_path(spark, path, first)
        original(*args)

    monkeypatch.setattr(merge, "write_partitions", meanwhile)
    with pytest.raises(ConcurrentChange):
        merge.upsert_ledger_path(spark, path, second)
    assert as_tuples(spark, path) == want and staged(path) == []
    want = plain_merge(read_ledger(spark, path), second)
    merge.upsert_ledger_path(spark, path, second)
    assert as_tuples(spark, path) == want


@pytest.mark.parametrize("moves", [0, 2, 4])
def test_a_cut_short_change_is_completed(spark, new_dir, monkeypatch, moves):
    path, stats = new_dir("ledger"), new_dir("stats")
    write_ledger(rows_of(spark, 0, 90, 3), path)
    merge.upsert_ledger_path(spark, path, rows_of(spark, 0, 1, 3, "x"))
    streams.follow_ledger(spark, path, stats, streams.DAILY)
    updates = rows_of(spark, 80, 30, 3, "succeeded")
    want, original, done = plain_merge(read_ledger(spark, path), updates), TableLog._move, []

    def cut(self, source, target):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(target)
        original(self, source, target)

    monkeypatch.setattr(TableLog, "_move", cut)
    with pytest.raises(KeyboardInterrupt):
        merge.upsert_ledger_path(spark, path, updates)
    monkeypatch.setattr(TableLog, "_move", original)
    # the next one who opens the table completes it, and the same batch again changes nothing
    merge.upsert_ledger_path(spark, path, updates)
    assert as_tuples(spark, path) == want and staged(path) == []
    streams.follow_ledger(spark, path, stats, streams.DAILY)
    assert stats_of(spark, stats, streams.daily_stats(read_ledger(spark, path)))


def stats_of(spark, path, want):
    got = spark.read.parquet(path).select(want.columns)
    return sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("kind", "plain"), [(streams.DAILY, streams.daily_stats), (streams.HOURLY, streams.hourly_counts)])
def test_statistics_follow_changes_without_reading_the_ledger(spark, new_dir, monkeypatch, kind, plain):
    path, stats = new_dir("ledger"), new_dir("stats")
    merge.upsert_ledger_path(spark, path, rows_of(spark, 0, 80, 3))
    streams.follow_ledger(spark, path, stats, kind)
    assert stats_of(spark, stats, plain(read_ledger(spark, path)))
    with monkeypatch.context() as m:
        m.setattr(streams, "read_ledger", lambda *a: pytest.fail("the ledger was read"))
        for first, count, status in ((70, 30, "succeeded"), (0, 10, "failed"), (0, 10, "failed"), (300, 5, "succeeded")):
            merge.upsert_ledger_path(spark, path, rows_of(spark, first, count, 3, status))
            if first != 0:  # two merges are followed at once
                streams.follow_ledger(spark, path, stats, kind)
                streams.follow_ledger(spark, path, stats, kind)
                assert stats_of(spark, stats, plain(read_ledger(spark, path)))
    # changes by something else, and changes no longer kept, lead to a fresh start
    write_ledger(rows_of(spark, 5000, 20, 3), path, mode="append")
    merge.upsert_ledger_path(spark, path, rows_of(spark, 5010, 20, 3, "succeeded"))
    streams.follow_ledger(spark, path, stats, kind)
    assert stats_of(spark, stats, plain(read_ledger(spark, path)))


def postings(spark, first, n, status, days, months=5):
    """Cash rows posted up to ``days`` before their event, every eleventh undated or without a rate or an amount."""
    rows = rows_of(spark, first, n, months, status)
    gone = lambda c, k: F.when(F.col("amount") % 1100 == k, None).otherwise(F.col(c))
    net = F.when(F.col("amount") % 300 == 0, -F.col("net_amount")).otherwise(F.col("net_amount"))
    return (
        rows.withColumn("posted_date", F.date_sub("occurred_date", days))
        .withColumn("net_amount", net).withColumn("net_amount", gone("net_amount", 100)).withColumn("fx_rate", gone("fx_rate", 200))
        .withColumn("posted_date", gone("posted_date", 300))
    )


def test_cash_position_follows_backdated_changes(spark, new_dir, monkeypatch):
    path, cash = new_dir("ledger"), new_dir("cash")
    merge.upsert_ledger_path(spark, path, postings(spark, 0, 0, "succeeded", 0))
    streams.follow_ledger(spark, path, cash, streams.CASH)
    assert streams.cash_position(spark, cash).count() == 0

    def same(**bounds):
        want = marts.daily_cash_position(read_ledger(spark, path))
        if bounds:
            want = want.filter(F.col("date").between(bounds["start"], bounds["end"]))
        got = streams.cash_position(spark, cash, **bounds)
        assert got.columns == want.columns
        return sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()

    touched = []
    commit = TableLog.commit

    def noted(self, since, staging, moves, **state):
        if self.path == cash:
            touched.append({t.rsplit("month=", 1)[1] for _, t in moves if "month=" in t})
        return commit(self, since, staging, moves, **state)

    monkeypatch.setattr(TableLog, "commit", noted)
    with monkeypatch.context() as m:
        m.setattr(streams, "read_ledger", lambda *a: pytest.fail("the ledger was read"))
        # new rows; some settle later; backdated ones; some are taken back, a month as a whole
        for first, n, status, days in ((0, 80, "pending", 0), (0, 60, "succeeded", 0), (500, 3, "succeeded", 200), (20, 10, "failed", 0), (500, 3, "failed", 0)):
            merge.upsert_ledger_path(spark, path, postings(spark, first, n, status, days))
            streams.follow_ledger(spark, path, cash, streams.CASH)
            streams.follow_ledger(spark, path, cash, streams.CASH)
            assert same() or status == "pending"
    # the three backdated postings touched their months alone, though every later balance moved
    assert len(touched[2]) <= 3 < len(touched[1]) and touched[4] == touched[2]
    assert same(start="2020-02-03", end="2020-04-02")
    scan = streams.cash_position(spark, cash, "2020-03-01", "2020-03-09")._jdf.queryExecution().executedPlan().toString()
    assert "month" in scan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_removals_name_ids_only(spark, new_dir):
    path = new_dir("ledger")
    bank = rows_of(spark, 0, 40, 2).withColumn("transaction_id", F.concat(F.lit("plaid_"), F.substring("transaction_id", 2, 9)))
    write_ledger(bank, path)
    ids = spark.createDataFrame([("3",), ("3",), ("7",), (None,), ("unknown",)], "transaction_id string")
    merge.mark_removed_path(spark, path, ids)
    got = {r.transaction_id: r.status for r in read_ledger(spark, path).collect()}
    assert len(got) == 40 and {k for k, v in got.items() if v == "removed"} == {"plaid_3", "plaid_7"}
    assert merge.mark_removed_path(spark, path, ids.filter("transaction_id = 'unknown'")) == []
    assert merge.mark_removed_path(spark, new_dir("none"), ids) == []
