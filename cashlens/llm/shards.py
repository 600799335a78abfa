"""What the two vector searches share: rows that take part, shards, blocks of queries, and the merge.

Every shard's index is built in one task from about ROWS_PER_SHARD rows that a hash of vec_id chose, and is
written as one row; every block of queries meets every shard in a row of its own. What a task holds is so
bounded at any size of the table, and the best of all shards are merged by a window per query.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 1024


def taking_part(embeddings: DataFrame, zeros: bool) -> DataFrame:
    """vec_id, vector (double), dim: vectors without null or non-finite components, and without zero vectors unless `zeros`.

    Rows without vec_id take no part; rows that share a vec_id count as one, the smallest vector.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(F.coalesce(finite, F.lit(False)))
    if not zeros:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def sharded(rows: DataFrame, rows_per_shard: int) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // rows_per_shard))
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def indexed(rows: DataFrame, build) -> DataFrame:
    """dim, shard, index: what `build(ids, vectors)` makes of each shard's rows, ids rising."""

    def of_shard(key, part):
        part = part.sort_values("vec_id")
        return pd.DataFrame([(*key, pickle.dumps(build(part["vec_id"].to_numpy(), matrix(part["vector"]))))], columns=["dim", "shard", "index"])

    return rows.groupBy("dim", "shard").applyInPandas(of_shard, "dim int, shard int, index binary")


def in_blocks(queries: DataFrame, shards: Column, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """dim, shard, block: packed ids, vectors and floors of queries, a copy for each shard in the array `shards`."""
    n = max(1, -(-queries.count() // per_block))

    def pack(key, part):
        packed = pickle.dumps((part["vec_id"].to_numpy(), matrix(part["vector"]), part["floor"].to_numpy()))
        return pd.DataFrame([(*key[1:], packed)], columns=["dim", "shard", "block"])

    dealt = queries.withColumn("n", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n)))
    if "shard" in queries.columns:
        return dealt.groupBy("n", "dim", "shard").applyInPandas(pack, "dim int, shard int, block binary")
    packed = dealt.withColumn("shard", F.lit(0)).groupBy("n", "dim", "shard").applyInPandas(pack, "dim int, shard int, block binary")
    return packed.withColumn("shard", F.explode(shards))


def searched(index: DataFrame, blocks: DataFrame, search, score: str) -> DataFrame:
    """query_id, vec_ids, scores: `search(index, ids, vectors, floors)` of each shard and block, best first.

    Both sides are shuffled whatever size Spark takes them for: it counts neither the copies of a block, one for each
    shard, nor what an index takes unpacked, and would send them all through the driver to broadcast them. A shard's
    one index is the side the merge keeps, so the blocks it meets are not held.
    """

    def run(batches):
        last, opened = None, None
        for batch in batches:
            for dim, shard, blob, block in zip(batch["dim"], batch["shard"], batch["index"], batch["block"], strict=True):
                if (dim, shard) != last:
                    last, opened = (dim, shard), pickle.loads(blob)
                yield pd.DataFrame(search(opened, *pickle.loads(block)), columns=["query_id", "vec_ids", "scores"])

    return blocks.join(index.hint("merge"), ["dim", "shard"]).select("dim", "shard", "index", "block").mapInPandas(
        run, f"query_id long, vec_ids array<long>, scores array<{score}>"
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best over all shards, ties to the smaller vec_id."""
    each = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x"))
    each = each.select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b in double precision, components added from first to last."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        total = total + a[..., i] * b[..., i]
    return total
