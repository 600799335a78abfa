"""Column rules against their plain statement over generated inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cashlens import fixed_values as fv
from cashlens.functions import money, rules

once = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
cents = st.integers(0, 10**9)


@once
@given(st.lists(st.tuples(st.sampled_from(fv.TYPES), st.sampled_from(fv.STATUSES), cents), min_size=1, max_size=40))
def test_fee_and_net(spark, rows):
    df = spark.createDataFrame(rows, "type string, status string, amount long")
    df = df.withColumn("fee", rules.fee_cents("type", "status", "amount"))
    for r in df.withColumn("net", rules.net_cents("type", "status", "amount", "fee")).collect():
        charged = r.type == "charge" and r.status == "succeeded"
        fee = int(r.amount * 0.029 + 30) if charged else -int(r.amount * 0.029) if r.type == "refund" else 0
        net = -r.amount if r.type in ("refund", "payout", "fee") else r.amount - fee if charged else r.amount
        assert (r.fee, r.net) == (fee, net)


@once
@given(st.lists(st.tuples(st.floats(-1e9, 1e9), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_runway_and_split(spark, rows):
    df = spark.createDataFrame(rows, "cash double, flow double")
    inflow, outflow = rules.split_flow("flow")
    for r in df.select("*", rules.runway_days("cash", "flow").alias("d"), inflow.alias("i"), outflow.alias("o")).collect():
        if r.flow >= 0:
            assert r.d == 999
        elif abs(r.cash / r.flow) < 2**62:
            assert r.d == int(r.cash / abs(r.flow))
        if r.flow > 0:
            assert math.isclose(r.i, 0.6 * r.flow) and r.o == 0
        else:
            assert math.isclose(r.i, 0.4 * abs(r.flow)) and math.isclose(r.o, 1.4 * abs(r.flow))


@once
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_retry_policy(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, 0.7, 0.4, 0.2]], "p double")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    action, later = rules.retry_action("p", at)
    for r in df.select("p", action.alias("a"), F.timestamp_diff("HOUR", at, later).alias("h")).collect():
        want = ("retry_1h", 1) if r.p >= 0.7 else ("retry_24h", 24) if r.p >= 0.4 else ("retry_72h", 72) if r.p >= 0.2 else ("do_not_retry", None)
        assert (r.a, r.h) == want


@once
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.floats(0, 10))] * 3), min_size=1, max_size=40))
def test_severity(spark, rows):
    df = spark.createDataFrame(rows, "days_31_60_usd double, days_61_90_usd double, days_90_plus_usd double")
    for r in df.withColumn("s", rules.ar_severity()).collect():
        a, b, c = (x or 0 for x in tuple(r)[:3])
        assert r.s == ("critical" if c > 0 else "elevated" if b > 0 else "moderate" if a > 0 else "current")


@once
@given(st.lists(st.tuples(cents, st.sampled_from([1.0, 0.92, 0.79, 0.0067, 1.2345])), min_size=1, max_size=60))
def test_sums_do_not_depend_on_order(spark, rows):
    from decimal import Decimal

    df = spark.createDataFrame(rows, "amount long, fx_rate double")
    want = float(sum(Decimal(a) * Decimal(str(fx)) for a, fx in rows)) / 100.0
    for parts in (1, 5):
        assert df.repartition(parts).agg(money.usd_sum("amount")).first()[0] == want


def test_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (-0.125,), (1.005,), (None,)], "x double")
    got = [r[0] for r in df.select(money.round_half_up("x", 2)).collect()]
    assert got == [2.68, 0.13, -0.13, 1.01, None]
    assert df.limit(1).select(money.round_toward_plus(F.lit(-2.5))).first()[0] == -2.0
    assert df.limit(1).select(money.percent(F.lit(1), F.lit(0))).first()[0] == 0.0
