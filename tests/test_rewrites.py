"""Skew-safe rewrites against the plain definition, with a key that holds much of the data."""

import random
from datetime import datetime, timedelta

import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F

from cashlens.operators import features, merge, recon, retry

START = datetime(2024, 1, 1)


def row(i, **over):
    return {
        "transaction_id": f"t{i:05d}",
        "occurred_at": str(START + timedelta(hours=i)),
        "posted_date": str(START.date()),
        "type": "charge",
        "status": "succeeded",
        "source": "stripe",
        "amount": 100,
        "net_amount": 100,
        "fee_amount": 0,
        "currency": "USD",
        "fx_rate": 1.0,
        "basis": "cash",
        "customer_id": "c0",
    } | over


@pytest.fixture
def books(ledger_of):
    """Payouts and deposits, a third of both at one date and amount."""
    rng, rows = random.Random(7), []
    for i in range(400):
        hot = i % 3 == 0
        day = START + timedelta(days=0 if hot else rng.randrange(20))
        cents = 250000 if hot else rng.choice([rng.randrange(100, 900000), 250000, 350000, 349999])
        payout = i % 2 == 0
        rows.append(
            row(
                i,
                posted_date=str(day.date()),
                source="stripe" if payout else "plaid",
                type="payout" if payout else "charge",
                amount=cents,
                net_amount=-cents if payout else cents,
            )
        )
    return ledger_of(rows)


def naive_pairs(ledger):
    rows = ledger.collect()
    payouts = [r for r in rows if r.source == "stripe"]
    deposits = [r for r in rows if r.source == "plaid"]
    return payouts, deposits, [
        (p, d)
        for p in payouts
        for d in deposits
        if 0 <= (d.posted_date - p.posted_date).days <= 2 and abs(d.net_amount + p.net_amount) < 100000
    ]


@pytest.mark.parametrize("rows_per_salt", [50_000, 5])
def test_recon_match(books, monkeypatch, rows_per_salt):
    monkeypatch.setattr(recon, "ROWS_PER_SALT", rows_per_salt)
    pay, dep = recon.payout_candidates(books, "2024-01-05"), recon.deposit_candidates(books, "2024-01-05")
    payouts, deposits, pairs = naive_pairs(books)
    got = recon.recon_match(pay, dep).collect()
    assert len(got) == len(pairs)
    assert {(r.payout_txn_id, r.bank_txn_id) for r in got} == {(p.transaction_id, d.transaction_id) for p, d in pairs}
    classes = {(p.transaction_id, d.transaction_id): abs(p.net_amount + d.net_amount) for p, d in pairs}
    for r in got:
        gap = classes[r.payout_txn_id, r.bank_txn_id]
        assert r.match_status == ("matched" if gap < 1 else "minor_diff" if gap < 100 else "major_diff")
        assert abs(r.diff_usd) == gap / 100
    lone_p = {p.transaction_id for p in payouts} - {p.transaction_id for p, _ in pairs}
    lone_d = {d.transaction_id for d in deposits} - {d.transaction_id for _, d in pairs}
    assert {r.transaction_id for r in recon.unmatched_payouts(pay, dep).collect()} == lone_p
    assert {r.transaction_id for r in recon.unmatched_deposits(pay, dep).collect()} == lone_d
    summary = {r.category: (r["count"], r.total_diff) for r in recon.recon_summary(pay, dep).collect()}
    assert summary["matched"] == (len(pairs), sum(-p.net_amount - d.net_amount for p, d in pairs) / 100)
    assert summary["unmatched_payouts"][0] == len(lone_p)
    assert summary["unmatched_deposits"][0] == len(lone_d)
    detail = recon.recon_discrepancies(pay, dep).collect()
    assert len(detail) == len(lone_p) + sum(g >= 100 for g in classes.values())
    sizes = [r.payout_amount if r.diff_usd is None else abs(r.diff_usd) for r in detail]
    assert sizes == sorted(sizes, reverse=True)


def test_blocks_of_one_hot_cell_are_even(ledger_of, monkeypatch):
    """All rows of both sides in one day and one amount cell: no block holds more than thrice the median of either side."""
    monkeypatch.setattr(recon, "ROWS_PER_SALT", 40)
    rows = [
        row(i, posted_date=str(START.date()), source="stripe" if i % 3 == 0 else "plaid", type="payout" if i % 3 == 0 else "charge",
            amount=250000 + i % 7, net_amount=-250000 - i % 7 if i % 3 == 0 else 250000 + i % 7)
        for i in range(900)
    ]
    ledger = ledger_of(rows)
    sides = recon.payout_candidates(ledger, "2024-01-05"), recon.deposit_candidates(ledger, "2024-01-05")
    for side, parts in zip(recon.match_blocks(*sides), (8, 15), strict=True):
        sizes = sorted(r["count"] for r in side.groupBy("bank_date", "cell", "payouts_block", "deposits_block").count().collect())
        assert len(sizes) == 8 * 15 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and sizes[-1] < 3 * 40, (parts, sizes)
    assert recon.recon_match(*sides).count() == 300 * 600


@pytest.fixture
def hot_sides(ledger_of):
    """150 payouts and 450 deposits of one day and cell, with amounts that come by turns."""
    rows = [
        row(i, posted_date=str(START.date()), source="plaid" if i % 4 else "stripe", type="charge" if i % 4 else "payout",
            net_amount=(210000 + i * 7919 % 23 * 100) * (1 if i % 4 else -1))
        for i in range(600)
    ]
    ledger = ledger_of(rows)
    return recon.payout_candidates(ledger, "2024-01-05"), recon.deposit_candidates(ledger, "2024-01-05")


def test_pairs_of_a_payout_come_by_amount(hot_sides, tmp_path):
    """A payout's pairs lie together and equal amounts follow each other, so written pairs take few bytes."""
    found = recon.recon_match(*hot_sides)
    rows = found.collect()
    assert len(rows) == 150 * 450
    turns = sum(a.payout_txn_id != b.payout_txn_id for a, b in zip(rows, rows[1:]))
    steps = sum((a.payout_txn_id, a.bank_amount) != (b.payout_txn_id, b.bank_amount) for a, b in zip(rows, rows[1:]))
    amounts = len({r.bank_amount for r in rows})
    assert turns == 150 - 1 and steps == 150 * amounts - 1


@pytest.fixture
def dense_sides(ledger_of):
    """601 payouts and 1803 deposits of one day and cell, far more than a tile, with 23 amounts that come by turns."""
    rows = [
        row(i, posted_date=str(START.date()), source="plaid" if i % 4 else "stripe", type="charge" if i % 4 else "payout",
            net_amount=(210000 + i * 7919 % 23 * 100) * (1 if i % 4 else -1))
        for i in range(2404)
    ]
    assert 1803 > 3 * recon.TILE
    ledger = ledger_of(rows)
    return recon.payout_candidates(ledger, "2024-01-05"), recon.deposit_candidates(ledger, "2024-01-05")


def bytes_written(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet"))


def test_written_pairs_of_a_large_block_take_few_bytes(dense_sides, tmp_path):
    """Ids of deposits recur within a Parquet page, so a pair stays below half a byte."""
    found = recon.recon_match(*dense_sides)
    assert found.count() == 601 * 1803
    assert bytes_written(found, tmp_path / "pairs") < 601 * 1803 / 2
    # one slice of payouts at a time meets a tile: as generated code, all pairs of a block would be kept until they are formed
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    slices = [line for line in plan if "Generate explode(transform(" in line]
    assert slices and not any("*(" in line for line in slices)


def test_written_discrepancies_of_a_large_block_take_few_bytes(dense_sides, tmp_path):
    """The whole list holds the pairs a dollar or more apart: nearly all, and as small as the pairs."""
    apart = recon.recon_discrepancies(*dense_sides, ordered=False)
    equal = sum((i * 7919 - j * 7919) % 23 == 0 for i in range(0, 2404, 4) for j in range(2404) if j % 4)
    assert apart.count() == 601 * 1803 - equal
    assert bytes_written(apart, tmp_path / "apart") < 601 * 1803 / 2


@pytest.mark.parametrize(("tile", "at_once"), [(1, 1), (3, 2), (7, 500)])
def test_tiles_of_any_size_find_the_same_pairs(books, monkeypatch, tile, at_once):
    """Rows that come twice and ids that are missing count as often as they stand there."""
    twice = books.unionByName(books.filter("transaction_id < 't00040'")).withColumn(
        "transaction_id", F.expr("IF(transaction_id BETWEEN 't00020' AND 't00060', NULL, transaction_id)")
    )
    _, _, pairs = naive_pairs(twice)
    monkeypatch.setattr(recon, "TILE", tile)
    monkeypatch.setattr(recon, "PAYOUTS_AT_ONCE", at_once)
    pay, dep = recon.payout_candidates(twice, "2024-01-05"), recon.deposit_candidates(twice, "2024-01-05")
    got = recon.recon_match(pay, dep).collect()
    key = lambda p, d: (p or "", d or "")
    assert sorted(key(r.payout_txn_id, r.bank_txn_id) for r in got) == sorted(key(p.transaction_id, d.transaction_id) for p, d in pairs)


def test_tasks_of_the_match_follow_the_pairs(books, monkeypatch):
    """The number of tasks comes from the candidate pairs, not from the bytes read; all pairs are found with any number."""
    pay, dep = recon.payout_candidates(books, "2024-01-05"), recon.deposit_candidates(books, "2024-01-05")
    _, _, pairs = naive_pairs(books)
    few = recon.recon_match(pay, dep)
    assert few.sparkSession.sparkContext.defaultParallelism == few.rdd.getNumPartitions()
    monkeypatch.setattr(recon, "PAIRS_PER_TASK", 500)
    many = recon.recon_match(pay, dep)
    assert len(pairs) / 500 < many.rdd.getNumPartitions() < 4 * len(pairs) / 500
    assert few.count() == many.count() == len(pairs) and few.exceptAll(many).isEmpty()
    assert recon.recon_match(pay, dep, dealt=False).exceptAll(many).isEmpty()


@pytest.mark.parametrize("n", [1, 7, 20, 5000])
def test_largest_discrepancies_open_few_pairs(books, n):
    """Ties by the hundred at one date and amount: the same first rows as through all pairs."""
    sides = recon.payout_candidates(books, "2024-01-05"), recon.deposit_candidates(books, "2024-01-05")
    every = recon.recon_discrepancies(*sides).collect()
    assert recon.recon_discrepancies(*sides, n=n).collect() == every[:n]
    # one pair for each two amounts, down to the nth gap and what equals it
    apart = [r for r in every if r.diff_usd is not None]
    amounts = {(r.payout_date, r.payout_amount, r.bank_date, r.bank_amount): abs(r.diff_usd) for r in apart}
    last = sorted(amounts.values(), reverse=True)[: n][-1] if n <= len(amounts) else 0
    opened = recon.amount_gaps(*sides, n=n).count()
    assert opened == sum(g >= last for g in amounts.values()) and opened < len(apart) / 3


def test_largest_discrepancies_of_odd_tables(books):
    pay, dep = recon.payout_candidates(books, "2024-01-05"), recon.deposit_candidates(books, "2024-01-05")
    assert recon.recon_discrepancies(pay, dep.limit(0), n=5).count() == 5
    assert recon.recon_discrepancies(pay.limit(0), dep, n=5).count() == 0
    assert recon.widest_gaps(pay, dep.limit(0)).count() == 0


def test_the_whole_list_of_discrepancies_is_not_sorted(spark, books):
    """The registered query's SQL has no order: pairs stay where they were found, and are the same ones."""
    df = entry.queries()["recon_discrepancies"](spark, "/root/testdata/sf0.001")
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    sides = recon.payout_candidates(books, "2024-01-05"), recon.deposit_candidates(books, "2024-01-05")
    plain, ranked = recon.recon_discrepancies(*sides, ordered=False), recon.recon_discrepancies(*sides)
    assert plain.count() > 1000 and plain.exceptAll(ranked).isEmpty() and ranked.exceptAll(plain).isEmpty()
    assert recon.recon_discrepancies(*sides, n=7, ordered=False).collect() == ranked.collect()[:7]


def test_no_deposits(books):
    pay = recon.payout_candidates(books, "2024-01-05")
    none = recon.deposit_candidates(books.limit(0), "2024-01-05")
    assert recon.recon_match(pay, none).count() == 0
    assert recon.unmatched_payouts(pay, none).count() == pay.count()
    summary = {r.category: r["count"] for r in recon.recon_summary(pay, none).collect()}
    assert summary == {"matched": 0, "unmatched_payouts": pay.count(), "unmatched_deposits": 0}


@pytest.mark.parametrize("grain", [3600, 1, 86400])
def test_retry_outcomes(ledger_of, grain):
    """One customer has a third of all rows; some rows have no customer; borders are hit exactly."""
    rng, rows = random.Random(grain), []
    for i in range(600):
        customer = "hot" if i % 3 == 0 else None if i % 17 == 1 else f"c{rng.randrange(8)}"
        at = START + timedelta(seconds=rng.randrange(0, 25 * 86400) // grain * grain)
        status = rng.choice(["succeeded", "failed", "failed", "pending"])
        rows.append(
            row(i, occurred_at=str(at), customer_id=customer, status=status,
                decline_code="do_not_honor" if status == "failed" else None,
                type=rng.choice(["charge", "invoice_payment", "charge", "refund"]))
        )
    ledger = ledger_of(rows)
    declined = retry.declined_events(ledger)
    got = {r.transaction_id: tuple(r)[1:] for r in retry.retry_outcomes(declined, ledger).collect()}
    everything = ledger.collect()
    attempts = [r for r in everything if r.type in ("charge", "invoice_payment")]
    want = {}
    for d in attempts:
        if d.status != "failed":
            continue
        after = [
            r for r in attempts
            if d.customer_id is not None and r.customer_id == d.customer_id
            and d.occurred_at < r.occurred_at <= d.occurred_at + timedelta(days=7)
        ]
        good = [r.occurred_at for r in after if r.status == "succeeded"]
        want[d.transaction_id] = (
            int(bool(good)), min(good) if good else None, len(good), sum(r.status == "failed" for r in after))
    assert got == want and any(v[0] for v in want.values())


def test_a_pooled_account_is_dealt_in_slices(spark, ledger_of, monkeypatch):
    """One customer has all payments, most of them in two days; ties at one instant, on both sides of a border."""
    rng, rows, minute = random.Random(9), [], 60_000_000
    for i in range(500):
        second = rng.choice([rng.randrange(86400), 43200, 43199, 43260])
        at = START + timedelta(days=rng.choice([0, 0, 7, 7, 3, 8]), seconds=second)
        status = rng.choice(["succeeded", "failed", "failed", "pending"]) if i % 50 else "succeeded"
        rows.append(row(i, occurred_at=str(at), customer_id="guest", status=status, decline_code="x" if status == "failed" else None))
    ledger = ledger_of(rows)
    declined = retry.declined_events(ledger)
    found = {}
    for width in (minute, 1_000_000, 86400 * 1_000_000):
        monkeypatch.setattr(retry, "SLICE", width)
        found[width] = {r.transaction_id: tuple(r)[1:] for r in retry.retry_outcomes(declined, ledger).collect()}
    attempts = ledger.select("transaction_id", "occurred_at", "status").collect()
    for d in attempts:
        if d.status == "failed":
            after = [r for r in attempts if d.occurred_at < r.occurred_at <= d.occurred_at + timedelta(days=7)]
            good = [r.occurred_at for r in after if r.status == "succeeded"]
            want = int(bool(good)), min(good) if good else None, len(good), sum(r.status == "failed" for r in after)
            assert all(got[d.transaction_id] == want for got in found.values())
    timeless = declined.withColumn("occurred_at", F.lit(None).cast("timestamp_ntz"))
    assert {tuple(r)[1:] for r in retry.retry_outcomes(timeless, ledger).collect()} == {(0, None, 0, 0)}
    # no window is dealt by customer and day alone, but that over the totals of slices
    monkeypatch.setattr(retry, "SLICE", minute)
    text = retry.retry_outcomes(declined, ledger)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert any("slice" in line.split("], [")[1] for line in windows)


def test_time_split_is_exact(ledger_of):
    """Ties at one instant hold a third of the rows, around the boundary too."""
    rng = random.Random(3)
    for hot_hour in (0, 200, 400):
        rows = [row(i, occurred_at=str(START + timedelta(hours=hot_hour if i % 3 == 0 else rng.randrange(400))))
                for i in range(301)]
        ledger = ledger_of(rows).select("transaction_id", "occurred_at")
        split = features.time_split(ledger, "occurred_at", "transaction_id", frac=0.8).collect()
        train = [r.occurred_at for r in split if r.split == "train"]
        rest = [r.occurred_at for r in split if r.split == "validate"]
        assert len(train) == int(301 * 0.8) and max(train) <= min(rest)
    last = features.time_split(ledger_of(rows).select("transaction_id", "occurred_at"), "occurred_at", "transaction_id", last=30)
    assert last.filter("split = 'validate'").count() == 30


def test_exact_quantile(spark):
    rng = random.Random(5)
    values = [250.0 if i % 3 == 0 else rng.randrange(1, 500000) / 100 for i in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "amount_usd double")
    for q in (0.1, 0.5, 0.9, 1.0):
        want = next(v for i, v in enumerate(sorted(values), 1) if i >= q * len(values))
        assert retry.exact_quantile(df, "amount_usd", q).first()[0] == want


def test_hot_key_of_updates(ledger_of):
    """A third of all updates are copies of one key; the last one wins."""
    updates = [row(i if i % 3 else 0, ingested_at=str(START + timedelta(minutes=i)), batch_id=str(i)) for i in range(300)]
    merged = merge.merge_ledger(ledger_of([row(0, status="pending")]), ledger_of(updates))
    rows = {r.transaction_id: r for r in merged.collect()}
    assert len(rows) == 201 and rows["t00000"].batch_id == "297" and rows["t00000"].status == "succeeded"


def test_insert_only_keeps_existing(ledger_of):
    target = ledger_of([row(0, status="pending")])
    updates = ledger_of([row(0), row(1, ingested_at="2024-01-02 00:00:00", batch_id="late"),
                         row(1, ingested_at="2024-01-01 00:00:00", batch_id="early")])
    rows = {r.transaction_id: r for r in merge.merge_insert_only(target, updates, ["transaction_id"], ["ingested_at"]).collect()}
    assert rows["t00000"].status == "pending" and rows["t00001"].batch_id == "early" and len(rows) == 2


def test_full_column_upsert(spark):
    schema = "day string, horizon int, p50 double, note string"
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, 2.0, "y")], schema)
    new = spark.createDataFrame([("a", 2, None, "z"), ("b", 1, 3.0, "w")], schema)
    rows = sorted(tuple(r) for r in merge.merge_upsert(old, new, ["day", "horizon"], None).collect())
    assert rows == [("a", 1, 1.0, "x"), ("a", 2, None, "z"), ("b", 1, 3.0, "w")]


def test_row_guard(ledger_of):
    with pytest.raises(Exception, match="need at least 5 rows, got 1"):
        features.require_rows(ledger_of([row(0)]), 5).collect()
    assert features.require_rows(ledger_of([row(0)]), 1).count() == 1


def test_night_flag(spark):
    df = spark.createDataFrame([(h, 1.0, 0, 0, 0.0) for h in (23, 3, 12)],
                               "occurred_hour int, amount_usd double, cust_declines_30d long, cust_successes_30d long, cust_avg_decline_amt_30d double")
    flags = lambda **k: [r.is_night for r in retry.retry_features(df, "scoring", **k).orderBy(F.col("hour").desc()).collect()]
    assert flags() == [0, 0, 0] and flags(wrap_night=True) == [1, 0, 1]
