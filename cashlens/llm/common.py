"""What several operators need."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator counts them: a run without space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one. Other columns cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def held_out(of: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod `of` is `remainder`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def uniform(*columns, seed: int = 0) -> Column:
    """A number in [0, 1) drawn by hash: the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))).cast("double")


def bounded_sample(rows: DataFrame, bound: int, *columns, seed: int = 0) -> DataFrame:
    """All rows, or about `bound` of them chosen by hash where there are more."""
    n = rows.count()
    return rows if n <= bound else rows.where(uniform(*columns, seed=seed) < bound / n)


def spans_text(spans: list[tuple[int, int, str]], order: dict[str, int]) -> str:
    """kind:start:end of each span by start, then by kind as listed, comma-joined."""
    ranked = sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ranked)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has such a column."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
