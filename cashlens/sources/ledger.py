"""Ledger table: conform, write, read."""

from pyspark.sql import functions as F

from ..functions.rules import date_parts, with_usd
from ..schema import LEDGER, LEDGER_PARTITIONS, LEDGER_STORED
from ..session import unsorted_writes
from .tablelog import FOLDER

#: What the written rows of a task are sorted by.
DAYS = [*LEDGER_PARTITIONS, "occurred_date"]

_DEFAULTS = {
    "is_recurring": False,
    "fx_rate": 1.0,
    "fee_amount": 0,
    "basis": "cash",
}


def stored_columns(df):
    """The stored ledger columns as expressions over staged rows."""
    present = dict(df.dtypes)
    columns = []
    for field in LEDGER_STORED:
        if field.name not in present:
            col = F.lit(None)
        elif field.name == "metadata_json" and present[field.name] != "string":
            col = F.to_json(F.col(field.name))
        else:
            col = F.col(field.name)
        col = col.cast(field.dataType)
        if field.name in _DEFAULTS:
            col = F.coalesce(col, F.lit(_DEFAULTS[field.name]).cast(field.dataType))
        columns.append(col.alias(field.name))
    return columns


def conform_to_schema(df):
    """Staged rows to the stored ledger columns.

    Absent columns become NULL, defaults fill NULLs, structured metadata becomes JSON text, every
    column is cast to its declared type, and anything else (generated columns too) is dropped.
    """
    return df.select(stored_columns(df))


def by_month(df):
    """Rows brought together by month.

    The rebalance hint lets adaptive execution merge thin months and split a hot one, so file
    sizes follow the advisory size whatever the spread of rows over months.
    """
    return df.hint("rebalance", *LEDGER_PARTITIONS)


def with_days(df):
    """Rows with the columns of ``DAYS`` from their event time."""
    return df.withColumns({name: part for name, part in date_parts().items() if name in DAYS})


def sorted_by_day(df):
    return df.sortWithinPartitions(*DAYS)


def write_ledger(df, path, mode="overwrite", arranged=False):
    """Partitioned zstd Parquet by year and month, with the generated columns stored.

    ``arranged`` rows come from ``by_month`` and ``sorted_by_day`` already and are neither shuffled nor
    sorted again.
    """
    rows = with_usd(conform_to_schema(df))
    (
        (rows if arranged else sorted_by_day(by_month(rows)))
        .write.partitionBy(*LEDGER_PARTITIONS)
        .option("compression", "zstd")
        .mode(mode)
        .parquet(path)
    )


def copy_ledger(spark, source, path):
    """A written ledger under another path; its rows lie by month already and are neither shuffled nor sorted."""
    write_ledger(read_ledger(unsorted_writes(spark), source), path, arranged=True)


def quarantine_path(path, feed):
    """Where a feed's lines that could not be read are kept, in the folder of the ledger's log."""
    return f"{path.rstrip('/')}/{FOLDER}/quarantine/{feed}"


def read_ledger(spark, path, start=None, end=None):
    """Scan with the declared schema; a date range also prunes year/month partitions."""
    df = spark.read.schema(LEDGER).parquet(path)
    if start is not None:
        df = df.filter(
            (F.col("occurred_date") >= F.lit(start).cast("date"))
            & (month_number() >= _literal_month(start))
        )
    if end is not None:
        df = df.filter(
            (F.col("occurred_date") <= F.lit(end).cast("date"))
            & (month_number() <= _literal_month(end))
        )
    return df


def month_number():
    return F.col("occurred_year").cast("int") * 12 + F.col("occurred_month").cast("int")


def _literal_month(day):
    year, month = str(day).split("-")[:2]
    return F.lit(int(year) * 12 + int(month))
