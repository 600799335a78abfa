"""Hard negatives by exact integer products of packed candidates (Kronecker packing).

Components are floor(256 * x). All are lifted by one bias so that none is negative, and the same component of
several candidates goes into separated fields of one wide integer, each field wide enough for a whole product
sum. One multiplication per component of the anchor then advances the sums of all packed candidates at once; at
the end the fields are cut apart and the biases' share is taken off. Words are machine integers, or Python's own
where a field needs more than 64 bits.

Rows are dealt to shards of about ROWS_PER_SHARD by a hash of vec_id, so labels of any size spread evenly. A
shard's rows cross the network once, followed by the anchors, which are read in batches; a task holds one shard
and one batch. Anchors meet all shards twice: first for the positives, then, knowing their scores, for negatives
within the stated shares of those. Windows over a few rows of each shard and anchor merge the finds.

Defined results: rows with a null vec_id, label or vector, an empty vector, or null or non-finite components take
no part; rows that share a vec_id count as one, the smallest (vector, label); vectors of different lengths never
meet; equal scores go to the smaller vec_id; an anchor without positives gives no rows; a positive score below
zero has an empty range; an empty table gives an empty result. Scores are exact as long as they fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.session import written

ROWS_PER_SHARD = 8192
ANCHORS_AT_ONCE = 32
WORD_BITS = 64
#: Candidates in a word of Python's integers.
WIDE_FIELDS = 8

POSITIVES = "array<struct<positive_id: long, positive_score: long>>"


class Packed:
    """Candidates, one row each, packed for products with vectors of the same length.

    No component of either side may exceed `largest` in absolute value.
    """

    def __init__(self, rows: np.ndarray, largest: int):
        self.n, self.length, self.bias = len(rows), rows.shape[1], int(largest)
        self.bits = max(1, (self.length * (2 * self.bias) ** 2).bit_length())
        self.wide = self.bits > WORD_BITS - 1
        self.fields = WIDE_FIELDS if self.wide else WORD_BITS // self.bits
        self.kind, self.number = (object, int) if self.wide else (np.uint64, np.uint64)
        lifted = rows.astype(object) + self.bias if self.wide else (rows + self.bias).astype(np.uint64)
        padded = np.zeros((-(-self.n // self.fields) * self.fields, self.length), self.kind)
        padded[: self.n] = lifted
        self.words = np.zeros((self.length, len(padded) // self.fields), self.kind)
        for f in range(self.fields):
            self.words += padded[f :: self.fields].T << self.number(f * self.bits)
        self.of_bias = self.bias * rows.astype(object if self.wide else np.int64).sum(axis=1)

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, a row for each anchor and a column for each candidate."""
        exact = object if self.wide else np.int64
        anchors = anchors.astype(exact)
        lifted = (anchors + self.bias).astype(self.kind)
        sums = np.zeros((len(anchors), self.words.shape[1]), self.kind)
        for i in range(self.length):
            sums += lifted[:, i, None] * self.words[i]
        mask, out = self.number((1 << self.bits) - 1), np.empty((len(anchors), self.words.shape[1] * self.fields), exact)
        for f in range(self.fields):
            out[:, f :: self.fields] = (sums >> self.number(f * self.bits)) & mask
        fixed = self.bias * anchors.sum(axis=1) + self.length * self.bias**2
        return out[:, : self.n] - fixed[:, None] - self.of_bias


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q (components as integers), dim."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(F.coalesce(finite, F.lit(False)))
    once = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("r"))
    q = F.transform("r.vector", lambda x: F.floor(x * F.lit(256.0)).cast("long"))
    return once.select("vec_id", F.col("r.label").alias("label"), q.alias("q"), F.size("r.vector").alias("dim"))


def _met(rows: DataFrame, anchors: DataFrame, n_shards: int, largest: int, find, schema: str) -> DataFrame:
    """What `find` makes of every batch of anchors and every shard. anchors: as rows, with wants."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    candidates = rows.select(shard.alias("shard"), "dim", F.lit(0).alias("kind"), "vec_id", "label", "q", F.lit(None).cast(POSITIVES).alias("wants"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    asked = anchors.select(everywhere.alias("shard"), "dim", F.lit(1).alias("kind"), "vec_id", "label", "q", "wants")
    # the partition is the shard: candidates first, then the anchors that they meet
    stream = candidates.unionByName(asked).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind", "vec_id")

    def run(batches):
        place, parts, opened = None, [], None
        for batch in batches:
            for key, part in batch.groupby(["shard", "dim", "kind"], sort=False):
                if key[:2] != place:
                    place, parts, opened = key[:2], [], None
                q = np.array(part["q"].tolist(), np.int64).reshape(len(part), -1)
                if key[2] == 0:
                    parts.append((part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), q))
                    continue
                if not parts:
                    continue
                if opened is None:
                    ids, labels, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                    opened = ids, labels, Packed(vectors, largest)
                ids, labels, packed = opened
                for low in range(0, len(part), ANCHORS_AT_ONCE):
                    some = part.iloc[low : low + ANCHORS_AT_ONCE]
                    scores = packed.products(q[low : low + ANCHORS_AT_ONCE])
                    out = []
                    for anchor, label, wants, row in zip(some["vec_id"], some["label"], some["wants"], scores, strict=True):
                        out += find(anchor, label, wants, ids, labels, row)
                    yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return stream.mapInPandas(run, schema)


def _positives(k: int):
    def find(anchor, label, wants, ids, labels, scores):
        at = np.flatnonzero((labels == label) & (ids != anchor))
        at = at[np.argsort(-scores[at], kind="stable")[:k]]  # ids rise, so ties go to the smaller
        return [(anchor, int(ids[i]), int(scores[i])) for i in at]

    return find


def _negatives(k: int, low: int, high: int):
    def find(anchor, label, wants, ids, labels, scores):
        at = np.flatnonzero(labels != label)
        at = at[np.argsort(-scores[at], kind="stable")]
        falling, out = -scores[at], []
        for want in wants:
            positive = int(want["positive_score"])
            # low * positive <= 100 * score <= high * positive, in whole numbers
            least, most = -(-low * positive // 100), high * positive // 100
            first, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            out += [(anchor, int(want["positive_id"]), positive, int(ids[i]), int(scores[i])) for i in at[first : min(end, first + k)]]
        return out

    return find


def _first(rows: DataFrame, k: int, keys: list[str], item: str, score: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, anchors_where: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best `positives` others of its label; for each, the best `negatives` rows of
    other labels whose score lies within low and high per cent of the positive's.
    """
    rows = written(taking_part(embeddings), "negatives-rows")
    n, largest = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("q", F.abs)))).first()
    shards, largest = max(1, -(-n // rows_per_shard)), largest or 0
    anchors = rows.where(anchors_where)
    asked = anchors.withColumn("wants", F.lit(None).cast(POSITIVES))
    found = _met(rows, asked, shards, largest, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = _first(found, positives, ["anchor_id"], "positive_id", "positive_score")
    wants = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wants"))
    asked = written(anchors.join(wants, anchors["vec_id"] == wants["anchor_id"]).drop("anchor_id"), "negatives-anchors")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _met(rows, asked, shards, largest, _negatives(negatives, low, high), schema)
    best = _first(found, negatives, ["anchor_id", "positive_id"], "negative_id", "negative_score")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
