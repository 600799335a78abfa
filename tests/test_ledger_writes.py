"""Written ledgers: what a task shuffles and sorts on the way to the files."""

import re

import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F

from cashlens.operators import marts, merge
from cashlens.sources import ledger as ledgers
from cashlens.sources.ledger import read_ledger
from cashlens.sources.tables import build_ledger, workspace
from cashlens.streaming import streams
from tests.test_merges import as_tuples, plain_merge, rows_of, staged

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written_plan(spark):
    """The plan of the last partitioned write, with the columns of its nodes."""

    def last():
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        texts = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
        text = [x for x in texts if "InsertIntoHadoopFsRelationCommand" in x][-1]
        return text

    return last


def widths(text, node):
    """Columns that enter the nodes of this name."""
    return [int(n) for n in re.findall(rf"\) {node}[^\n]*\nInput \[(\d+)\]", text)]


@pytest.mark.parametrize("multi_currency", [False, True])
def test_the_ledger_is_shuffled_and_sorted_while_narrow(spark, tmp_path, written_plan, multi_currency):
    wide = len(build_ledger(spark, SF, multi_currency).columns)
    w = workspace(spark, SF)
    rows = w._write_ledger(f"narrow-{multi_currency}-{tmp_path.name}", multi_currency)
    text = written_plan()
    assert widths(text, "Sort") and max(widths(text, "Sort") + widths(text, "Exchange")) < wide / 2
    plain = build_ledger(spark, SF, multi_currency)
    assert rows.count() == plain.count()
    assert rows.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(rows.select(plain.columns)).isEmpty()


@pytest.mark.parametrize("multi_currency", [False, True])
def test_the_wide_columns_are_derived_in_one_projection(spark, tmp_path, written_plan, multi_currency):
    wide = len(build_ledger(spark, SF, multi_currency).columns)
    rows = workspace(spark, SF)._write_ledger(f"once-{multi_currency}-{tmp_path.name}", multi_currency)
    inputs = re.findall(r"\) Project[^\n]*\nOutput \[\d+\][^\n]*\nInput \[(\d+)\]", written_plan())
    assert inputs and max(int(n) for n in inputs) < 0.75 * wide, inputs
    assert rows.filter("fee_amount IS NULL OR fx_rate IS NULL OR description IS NULL").isEmpty()


def test_the_query_of_the_sink_writes_narrow_rows(spark, written_plan):
    workspace(spark, SF)._tables.pop("fx_ledger", None)
    entry.queries()["write_ledger"](spark, SF)
    assert max(widths(written_plan(), "Sort") + widths(written_plan(), "Exchange")) < 20


def test_a_copied_ledger_is_neither_shuffled_nor_sorted(spark, tmp_path, written_plan):
    source = workspace(spark, SF).ledger
    ledgers.copy_ledger(spark, source.inputFiles()[0].split("/occurred_year")[0], str(tmp_path / "copy"))
    text = written_plan()
    assert ") Sort" not in text and ") Exchange" not in text
    copy = read_ledger(spark, str(tmp_path / "copy"))
    assert copy.count() == source.count() and copy.exceptAll(source).isEmpty()
    assert copy.select("occurred_year", "occurred_month").distinct().count() == source.select(
        F.col("occurred_year"), "occurred_month"
    ).distinct().count()


@pytest.mark.parametrize("slots", [64, 1 << 26])
def test_rows_without_an_update_stay_apart_in_a_merge(spark, tmp_path, written_plan, monkeypatch, slots):
    monkeypatch.setattr(merge, "APART_BYTES", 1)
    monkeypatch.setattr(merge, "SLOTS", slots)
    path, cash = str(tmp_path / "ledger"), str(tmp_path / "cash")
    ledgers.write_ledger(rows_of(spark, 0, 400, 4), path)
    merge.upsert_ledger_path(spark, path, rows_of(spark, 0, 1, 1, "first"))
    streams.follow_ledger(spark, path, cash, streams.CASH)
    for updates in (rows_of(spark, 390, 20, 4, "succeeded"), rows_of(spark, 0, 400, 4, "failed")):
        before = read_ledger(spark, path)
        others, version = before.join(updates, "transaction_id", "left_anti").count(), merge.ledger_state(spark, path)["version"]
        want, new = plain_merge(before, updates), updates.join(before, "transaction_id", "left_anti").count()
        merge.upsert_ledger_path(spark, path, updates)
        text = written_plan()
        assert ") Sort" not in text and max(widths(text, "Exchange"), default=0) < 4
        assert as_tuples(spark, path) == want and staged(path) == []
        changed = merge.ledger_changes(spark, path, version + 1)
        assert changed.count() <= updates.count() and changed.filter("before IS NULL").count() == new
        assert read_ledger(spark, path).count() == others + updates.count()
    streams.follow_ledger(spark, path, cash, streams.CASH)
    follows = streams.cash_position(spark, cash)
    whole = marts.daily_cash_position(read_ledger(spark, path))
    assert follows.select(whole.columns).exceptAll(whole).isEmpty() and whole.exceptAll(follows.select(whole.columns)).isEmpty()


def test_bank_rows_are_removed_from_large_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    bank = rows_of(spark, 0, 90, 3).withColumn("transaction_id", F.concat(F.lit("plaid_"), "transaction_id"))
    ledgers.write_ledger(bank, path)
    monkeypatch.setattr(merge, "APART_BYTES", 1)
    ids = spark.createDataFrame([("t7",), ("t50",), ("t999",), (None,)], "transaction_id string")
    merge.mark_removed_path(spark, path, ids)
    got = {r.transaction_id: r.status for r in read_ledger(spark, path).collect()}
    assert len(got) == 90 and {k for k, v in got.items() if v == "removed"} == {"plaid_t7", "plaid_t50"}
