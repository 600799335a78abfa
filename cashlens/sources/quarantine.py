"""Landed JSON lines, told apart into rows that can be read and lines that cannot.

Every line gives its rows (one, or those of an array) either as typed columns with a NULL ``reason``, or with
the text as it came and why it could not be read: nothing vanishes on the way. Blank lines hold no row.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"
NOT_JSON, WRONG_TYPE, MISSING = "not a JSON object", "a value of the wrong type", "no "


def parsed(rows, schema, line="line", required=()):
    """Rows with the fields of ``schema`` read from a JSON text, and ``reason`` where that failed.

    All fields are read at once, so that what counts as broken does not hang on the columns a caller selects.
    """
    others = [c for c in rows.columns if c != line]
    text = F.ltrim(F.col(line))
    # objects of an array stay text here; an array that cannot be read stays one line
    parts = F.when(text.startswith("["), F.from_json(line, "array<string>"))
    one = rows.select(*others, F.explode(F.coalesce(parts, F.array(line))).alias(line))
    full = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    read = F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    # a generated column is not computed again for each filter on its fields
    found = one.select(*others, line, F.explode(F.array(read)).alias("read"))
    field = lambda name: F.col("read").getField(name)
    empty = reduce(lambda a, b: a & b, [field(f.name).isNull() for f in schema.fields])
    reason = F.when(F.col("read").isNull() | (field(BROKEN).isNotNull() & empty), NOT_JSON).when(field(BROKEN).isNotNull(), WRONG_TYPE)
    for name in required:
        reason = reason.when(field(name).isNull(), MISSING + name)
    return found.select(*others, *[field(f.name).alias(f.name) for f in schema.fields], F.col(line), reason.alias("reason"))


def lines(reader, path):
    """Text lines of landed files, of a batch or a stream reader."""
    return reader.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")


def readable(rows):
    return rows.filter("reason IS NULL").drop("line", "reason")


def broken(rows):
    return rows.filter("reason IS NOT NULL").select("line", "reason")


def keep_broken(rows, path, batch):
    """Writes what could not be read under its batch and returns how many rows that is; a replayed batch replaces its own."""
    target = f"{path.rstrip('/')}/batch={batch}"
    found = broken(rows)
    found.write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.schema(found.schema).parquet(target).count()
