"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Every function takes (spark, docs, sf_dir). All but the last return the columns of documents; the last one
returns the token ids. Every stage takes nulls in any column (a null text counts as the empty one, a null doc_id is
judged by its text and linked with nothing), empty and very long texts, repeated rows, columns of any name and empty
tables; what each of these gives stands in the operators' docstrings. SQL cannot express the classifier or the
pieces, so there is no ORACLE_SQL; tests compare the stages with plain versions.
"""

from __future__ import annotations

from cashlens.llm import dedup, mixing, pieces, quality, secrets
from cashlens.llm.common import table
from cashlens.session import written


def quality_filter(spark, docs, sf_dir):
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates."""
    return dedup.distinct_documents(docs)


def secret_redaction(spark, docs, sf_dir):
    """Replaces secrets in the texts by a mark."""
    return secrets.redacted(docs)


def source_mixing(spark, docs, sf_dir):
    """Repeats, cuts or drops documents so that the sources meet their target weights."""
    return mixing.mixed_documents(docs)


def piece_encoding(spark, docs, sf_dir):
    """doc_id, n_tokens and ids of every text."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secret_redaction", secret_redaction),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
