"""Display labels for report dimensions."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from .money import as_col
from .rules import map_lookup


def title_words(col):
    """snake_case to Title Case."""
    return F.initcap(F.translate(as_col(col), "_", " "))


def capitalised(col):
    """First letter upper, the rest as it stands."""
    value = as_col(col)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substr(value, F.lit(2)))


def _month_label(value):
    names = {f"{i:02d}": name for i, name in enumerate(fv.MONTH_NAMES, start=1)}
    name = map_lookup(names, F.substring(value, 6, 2))
    return F.coalesce(F.concat(name, F.lit(" "), F.substring(value, 1, 4)), value)


def _table_label(table, fallback):
    return lambda value: F.coalesce(map_lookup(table, F.lower(value)), fallback(value))


_DIMENSIONS = {
    "month": _month_label,
    "product_line": title_words,
    "decline_code": title_words,
    "department": _table_label(fv.FILTER_DEPARTMENT_LABELS, capitalised),
    "customer_tier": _table_label(fv.TIER_LABELS, capitalised),
    "aging_bucket": lambda value: F.coalesce(map_lookup(fv.FILTER_BUCKET_LABELS, value), value),
    # report labels
    "report_department": _table_label(fv.DEPARTMENT_LABELS, F.initcap),
    "report_tier": _table_label(fv.TIER_LABELS, F.initcap),
    "gateway": lambda value: F.coalesce(map_lookup(fv.GATEWAY_LABELS, value), F.initcap(value)),
    "outflow_type": lambda value: F.coalesce(map_lookup(fv.OUTFLOW_LABELS, value), F.initcap(value)),
}


def label(dimension, col):
    """Label column for one dimension; a value without a label is title-cased."""
    return _DIMENSIONS[dimension](as_col(col))


def with_label(df, dimension, column=None, out=None):
    column = column or dimension
    return df.withColumn(out or f"{column}_label", label(dimension, column))


def short_id(col):
    """First 8 and last 6 characters of an id longer than 18; a dash for a missing one."""
    value = as_col(col)
    return (
        F.when(value.isNull() | (value == ""), F.lit("—"))
        .when(
            F.length(value) > 18,
            F.concat(F.substring(value, 1, 8), F.lit("…"), F.right(value, F.lit(6))),
        )
        .otherwise(value)
    )
