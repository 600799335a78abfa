"""The queries of the operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, balltree, dedup, edits, mixing, negatives, pieces, pii, quality, runs, secrets, simhash, toxicity
from .common import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_personal_data")
def op2_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op3_quality_scores")
def op3_quality_scores(spark, sf_dir):
    return quality.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_top_products",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 50 = 0
    ), ranked AS (
        SELECT query_id, vec_id, score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op4_top_products(spark, sf_dir):
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op5_near_duplicates",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingled AS (
        SELECT doc_id, list_distinct(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
        FROM words
    ), each AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS common
        FROM each AS a JOIN each AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ), links AS (
        SELECT a, b FROM shared WHERE 100 * common >= 80 * (n_a + n_b - common)
    ), both_ways AS (
        SELECT a, b FROM links UNION SELECT b, a FROM links
    ), reach AS (
        SELECT DISTINCT a AS start, a AS node FROM both_ways
        UNION
        SELECT r.start, l.b FROM reach AS r JOIN both_ways AS l ON r.node = l.a
    ), least AS (
        SELECT start, min(node) AS component FROM reach GROUP BY start
    )
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
           s.doc_id = coalesce(c.component, s.doc_id) AS kept
    FROM shingled AS s LEFT JOIN least AS c ON s.doc_id = c.start
    """,
)
def op5_near_duplicates(spark, sf_dir):
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    return secrets.contract(table(spark, sf_dir, "documents"))


@query("op7_pieces")
def op7_pieces(spark, sf_dir):
    return pieces.contract(table(spark, sf_dir, "documents"))


@query("op8_edited_counts")
def op8_edited_counts(spark, sf_dir):
    return edits.contract(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_mix_sources")
def op10_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return runs.contract(table(spark, sf_dir, "documents"))


@query("op12_simhash_duplicates")
def op12_simhash_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    ), ranked AS (
        SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
        FROM positives AS p JOIN scored AS s ON p.anchor_id = s.anchor_id AND NOT s.same
        WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
