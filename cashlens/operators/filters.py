"""Cross-filtering of report rows."""

from pyspark.sql import functions as F

DIMENSIONS = {
    "month": lambda c, v: F.date_format(c, "yyyy-MM") == v,
    "product_line": lambda c, v: c == v,
    "department": lambda c, v: F.lower(c) == v.lower(),
    "customer_tier": lambda c, v: F.lower(c) == v.lower(),
    "aging_bucket": lambda c, v: c == v,
    "decline_code": lambda c, v: F.replace(F.lower(c), F.lit("_"), F.lit(" ")) == v.lower().replace("_", " "),
    "date": lambda c, v: c == F.lit(v).cast("date"),
}


def cross_filter(df, columns=None, **dims):
    """Rows meeting every active dimension; a dimension set to None is off.

    ``columns`` names the column of a dimension where it differs from the dimension's name.
    """
    for dim, value in dims.items():
        if value is not None:
            column = F.col((columns or {}).get(dim, dim))
            df = df.filter(DIMENSIONS[dim](column, value))
    return df


def flows_filter(trend, date=None, month=None):
    """Newest-first flows of one day, or of one month when it has rows, else all."""
    rows = trend
    if date is not None:
        rows = rows.filter(F.col("date") == F.lit(date).cast("date"))
    elif month is not None:
        hit = F.coalesce(F.date_format("date", "yyyy-MM") == month, F.lit(False))
        found = trend.agg(F.count_if(hit)).scalar()
        rows = rows.filter(hit | (found == 0))
    return rows.orderBy(F.col("date").desc_nulls_first())
