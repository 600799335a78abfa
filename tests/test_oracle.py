"""Every registered query with SQL, against DuckDB on the smallest tables."""

import __spark_entry__ as entry
from cashlens.plans.registry import ORACLES
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "date" and df.count() > 0


def test_queries_match_sql(spark):
    con, queries, bad = connect(SF), entry.queries(), {}
    for name in ORACLES:
        sql = entry.oracle_sql()[name]
        error, _ = compare(queries[name](spark, SF), con, sql)
        if error:
            bad[name] = error
    assert not bad, bad
