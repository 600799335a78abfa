"""Jobs and reports end to end on the smallest tables."""

import pytest

from cashlens import jobs, reports
from cashlens.operators import marts, models
from cashlens.plans import inputs
from cashlens.sources.ledger import read_ledger
from cashlens.sources.tables import workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return workspace(spark, SF)


@pytest.fixture(scope="module")
def ledger_path(w):
    w.ledger
    return f"{w.root}/ledger"


def test_ingest_jobs(spark, w, new_dir):
    path, events = new_dir("ledger"), inputs.landed(w, "processor_events", inputs.processor_events)
    jobs.ingest_processor_events(spark, events, path, "acct", 0, 4102444800)
    first = read_ledger(spark, path).count()
    jobs.ingest_bank_sync(spark, inputs.landed(w, "bank_pages", inputs.bank_pages), path)
    both = read_ledger(spark, path)
    total = both.count()
    assert first > 0 and total > first
    bank_id = both.filter("source = 'plaid'").first().transaction_id
    jobs.remove_bank_rows(spark, spark.createDataFrame([(bank_id[6:],)], "transaction_id string"), path)
    after = read_ledger(spark, path)
    assert after.filter("status = 'removed'").first().transaction_id == bank_id and after.count() == total


def test_reconcile_and_health(spark, w, ledger_path):
    result = jobs.reconcile(spark, ledger_path, w.as_of, days=365)
    counts = {r.category: r["count"] for r in result["summary"].collect()}
    assert counts["matched"] > 0 and result["discrepancies"].count() == 20
    checks = jobs.health(w.ledger, w.customers, w.merchants, inputs.forecast(w), w.as_of)
    assert all(r.is_ok for r in checks["row_counts"].collect())
    assert checks["freshness"].first().is_fresh and not checks["forecast"].first().is_stale


def test_forecast_job(spark, w, ledger_path, new_dir):
    fitted, row = jobs.train_forecast(spark, ledger_path, new_dir("model"), w.as_of, "v1", days=2000)
    assert row.first().model_name == "cash_forecast" and 0 <= fitted.metrics["coverage"] <= 1
    path = new_dir("forecast")
    for version in ("v1", "v2"):
        jobs.predict_cash(spark, fitted, ledger_path, path, w.as_of, version)
    rows = spark.read.parquet(path).orderBy("prediction_date").collect()
    assert len(rows) == 91 and {r.model_version for r in rows} == {"v2"}
    assert all(r.p10_net_flow_usd <= r.p50_net_flow_usd <= r.p90_net_flow_usd for r in rows)
    flow = rows[0].p50_net_flow_usd
    assert rows[90].p50_cumulative_cash_usd == pytest.approx(rows[0].starting_cash_usd + 91 * flow)
    assert models.load_model(new_dir("model")).stages[-1].getNumTrees > 0
    # a saved forecast gives the same rows in another session, and its registry row is kept
    again = new_dir("forecast-again")
    jobs.predict_cash(spark.newSession(), new_dir("model"), ledger_path, again, w.as_of, "v2")
    assert sorted(map(str, spark.read.parquet(again).collect())) == sorted(map(str, spark.read.parquet(path).collect()))
    models.registered(row, new_dir("registry"))
    assert spark.read.parquet(new_dir("registry")).first().version == "v1"


def test_retry_job(spark, w, ledger_path, new_dir):
    path = new_dir("predictions")
    row = jobs.train_and_score_retries(spark, ledger_path, path, new_dir("model"), w.as_of, "v1", n=40, days=4000)
    assert row.first().target_column == "target"
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 40 and all(0 <= r.retry_success_probability <= 1 for r in rows)
    for r in rows:
        assert r.expected_recovery_usd == pytest.approx(r.retry_success_probability * r.amount_usd, abs=0.3)
        assert (r.recommended_retry_at is None) == (r.recommended_action == "do_not_retry")


def test_reports(w):
    daily, rates, aging = inputs.daily(w), inputs.rates(w), inputs.aging(w, with_oldest=True)
    forecast, predictions = inputs.forecast(w), inputs.predictions(w)
    sections = {
        **reports.live_report(w.ledger, w.as_of),
        **reports.executive_report(w.ledger, daily, rates, aging, forecast, w.as_of),
        **reports.revenue_report(w.ledger, w.customers, daily, inputs.revenue(w), inputs.budget_lines(w)),
        **reports.ops_report(w.ledger, rates, predictions),
        **reports.receivables_report(w.ledger, w.customers, aging, w.as_of),
        **reports.cashflow_report(w.ledger, daily, forecast),
    }
    for name, df in sections.items():
        assert len(df.collect()) > 0, name


def test_fan_without_forecast(w):
    daily = inputs.daily(w)
    sections = reports.cashflow_report(w.ledger, daily, inputs.forecast(w).limit(0))
    assert sections["forecast"].count() == 91
    cases = {r.scenario: r for r in sections["scenarios"].collect()}
    assert cases["best_case"].runway_days == 365 and cases["base_case"].runway_days in (240, 365)


def test_views(spark, w):
    names = marts.create_views(w.ledger, w.customers, inputs.forecast(w), w.as_of)
    assert len(names) == 10
    assert spark.sql("SELECT COUNT(*) FROM ar_aging a JOIN customers c USING (customer_id)").first()[0] > 0
    for name in names:
        spark.catalog.dropTempView(name)
