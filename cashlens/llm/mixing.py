"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a shuffled order that a hash of the doc_id fixes; a queue that
ends starts over, up to `most` times. A document's virtual finish time is the source's cumulative words
divided by its weight. All documents are range-sorted by finish time and served until the total budget is
spent; the document in service at that moment is cut.

Defined results: a null text has size 0 and nothing is taken of it; the null source is a source of its own;
repeated rows are queued one by one; an empty table gives an empty result; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashlens.session import written

from .common import WORD, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Documents in one slice of a queue, and in one range of finish times: what one window task sorts.
SLICE_ROWS = 1000
RANGE_ROWS = 4000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a draw that orders the queue; texts are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", F.lit("queue")).alias("draw"),
        F.xxhash64("text", F.lit("tie")).alias("tie"),
    )


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, target.

    The targets share `share` times all words by weight. A target stops at `most` times its source's size and
    the excess goes to the others by weight, until none is above. That end is reached at once: with sources
    ordered by the ratio of bound to weight, a source is bounded if its ratio is at most what the words and
    weights left by the sources before it would give. The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    here = (
        by_source.withColumn("weight", weight)
        .withColumn("bound", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("words_left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("bounded", F.col("ratio") <= F.col("words_left") / F.col("weight_left"))
    )
    level = F.min(F.when(~F.col("bounded"), F.struct("ratio", (F.col("words_left") / F.col("weight_left")).alias("level")))).over(every)
    return here.select(
        "source", "source_size", "n_docs", "weight",
        F.when(F.col("bounded"), F.col("bound")).otherwise(F.col("weight") * level["level"]).alias("target"),
    )


def _queued(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with the words before it in its source's queue.

    A queue is cut into slices by the leading part of the draw, so that a source with a third of all rows is
    many window groups; the words before a slice come from the sums of the slices.
    """
    slices = F.ceil(F.col("n_docs") / F.lit(SLICE_ROWS))
    draw01 = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    rows = sizes.join(
        targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))
    ).withColumn("slice", F.floor(draw01 * slices))
    key = ["of_source", "slice"]
    before = Window.partitionBy("of_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*key).agg(F.sum("size").alias("words"))
        .select(F.col("of_source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("slice_start"))
    )
    order = Window.partitionBy(*key).orderBy("draw", "doc_id", "size", "tie")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .withColumn("in_slice", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(starts, F.col("of_source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .withColumn("queue_start", F.col("slice_start") + F.col("in_slice"))
    )


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, offset.

    taken: words the mix takes of the document, repeats counted, at most `most` times its size. offset: words
    of the mix before the document's first one; null if nothing is taken.
    """
    return _planned(docs, share, most, weights).drop("tie")


def _planned(docs: DataFrame, share: float, most: int, weights) -> DataFrame:
    sizes = written(sized(docs), "mix-sizes")
    targets = source_targets(sizes, share, most, weights)
    queued = written(
        _queued(sizes, targets).select("doc_id", "source", "slice", "place", "size", "source_size", "target", "queue_start", "tie"), "mix-queue"
    )
    totals = queued.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    ranges, budget = max(1, -(-totals["n"] * most // RANGE_ROWS)), int(share * (totals["words"] or 0))

    start = F.col("queue_start") + F.col("turn") * F.col("source_size")
    served = F.least(F.col("size"), F.floor(F.col("target")) - F.col("start"))
    # a document that is still in service at time 1, when every target is met, ends there
    finish = F.least(F.lit(1.0), (F.col("start") + F.col("size")) / F.col("target"))
    copies = (
        queued.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(most)])))
        .withColumn("start", start).withColumn("served", served).where("served > 0")
        .withColumn("finish", finish)
        .withColumn("range", F.least(F.lit(ranges - 1), F.floor(F.col("finish") * ranges)))
        .select("source", "slice", "place", "turn", "served", "finish", "range")
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        copies.groupBy("range").agg(F.sum("served").alias("words"))
        .select("range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("range_start"))
    )
    order = Window.partitionBy("range").orderBy("finish", "source", "slice", "place", "turn").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        copies.withColumn("offset", F.sum("served").over(order) - F.col("served"))
        .join(starts, "range")
        .withColumn("offset", F.col("offset") + F.col("range_start"))
        .where(F.col("offset") < budget)
        .groupBy(F.col("source").alias("t_source"), F.col("slice").alias("t_slice"), F.col("place").alias("t_place"))
        .agg(F.sum(F.least("served", F.lit(budget) - F.col("offset"))).alias("taken"), F.min("offset").alias("offset"))
    )
    same = (
        F.col("source").eqNullSafe(F.col("t_source"))
        & (F.col("slice") == F.col("t_slice"))
        & (F.col("place") == F.col("t_place"))
    )
    return queued.join(taken, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "offset", "tie"
    )


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """The documents of the mix: `docs` rows once for each time they are taken, the last one cut to the words left.

    A document is known by doc_id, source and text, nulls included. Rows that share all three are alike: one of
    them stands for what is taken of all. Documents without words are in no mix. n_chars, where there is such a
    column, follows the text. Other columns keep names and values, an empty table gives an empty result.
    """
    taken, turn, text, n, size = unused(docs, "taken", "turn", "taken_text", "rows", "words")
    plan_id, plan_source, plan_tie = unused(docs, "plan_id", "plan_source", "plan_tie")
    plan = _planned(docs, share, most, weights)
    per_text = (
        plan.groupBy(F.col("doc_id").alias(plan_id), F.col("source").alias(plan_source), F.col("tie").alias(plan_tie))
        .agg(F.sum("taken").alias(taken), F.max("size").alias(size), F.count(F.lit(1)).alias(n))
        .where(F.col(taken) > 0)
    )
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col(plan_id))
        & F.col("source").cast("string").eqNullSafe(F.col(plan_source))
        & (F.xxhash64("text", F.lit("tie")) == F.col(plan_tie))
    )
    found = docs.join(written(per_text, "mix-taken"), same)
    alike = found.where(F.col(n) > 1).dropDuplicates([plan_id, plan_source, plan_tie])
    rows = found.where(F.col(n) == 1).unionByName(alike)
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size)))))
    left = F.least(F.col(size), F.col(taken) - F.col(turn) * F.col(size))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), "")
    return rows.withColumn(text, F.when(left < F.col(size), cut).otherwise(F.col("text"))).select(
        *[F.col(text).alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )
