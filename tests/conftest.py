import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cashlens.schema import LEDGER_STORED  # noqa: E402
from cashlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("cashlens-tests", cores="8", spark__sql__shuffle__partitions="2")
    yield session
    session.stop()


@pytest.fixture
def ledger_of(spark):
    """Ledger rows from dicts: plain columns as given, dates and generated columns derived."""
    from pyspark.sql import functions as F

    from cashlens.functions.rules import with_date_parts, with_usd
    from cashlens.sources.ledger import conform_to_schema

    def build(rows, parts=True):
        names = sorted({k for r in rows for k in r})
        kinds = {f.name: f.dataType.simpleString() for f in LEDGER_STORED}
        text = spark.createDataFrame(
            [[None if r.get(n) is None else str(r[n]) for n in names] for r in rows],
            ", ".join(f"{n} string" for n in names),
        )
        df = text.select([F.col(n).cast(kinds[n]).alias(n) for n in names])
        return with_usd(conform_to_schema(with_date_parts(df) if parts else df))

    return build


@pytest.fixture
def new_dir(tmp_path):
    return lambda name: str(tmp_path / name)
