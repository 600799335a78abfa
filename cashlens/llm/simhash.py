"""Near duplicates by SimHash, with tables of distances to reference fingerprints.

A document's 64-bit fingerprint has a bit set where over half of its shingles' hashes have it set. Every distinct
fingerprint gets a row of Hamming distances to REFERENCES fixed reference fingerprints. By the triangle
inequality two fingerprints within `most` bits differ by at most `most` in every one of these distances: a pair
with a larger difference in any coordinate is discarded, and the survivors are verified bit by bit.

Distances to references alone hardly tell random fingerprints apart (one coordinate keeps over half of all pairs),
so the tables are compared within groups: fingerprints are cut into most + 2 blocks of bits, and two within
`most` bits agree in two blocks at least. Each fingerprint stands in one group for every pair of blocks, so no
link is missed. Within a group rows are sorted by their first distance, and a row meets those after it until that
coordinate alone is too far. A group with more than GROUP_ROWS members is cut by first distance and by hash into
blocks, of which only those meet whose ranges of distances allow a link. Links leave a task as the stars of
their components, never as all pairs of a group.

Defined results: null or empty texts have the fingerprint zero, linked like any other; a text with fewer words
than a shingle is one shingle; equal fingerprints are one node; rows with a null doc_id get their fingerprint, link
nothing and have a null component_id; rows that share a doc_id keep their own fingerprints and may stand in
different components; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from .common import texts
from .dedup import components

SHINGLE_WORDS = 5
MOST_BITS = 4
REFERENCES = 16
SEED = 42
#: Members of a group that meet within one task; a larger group meets block by block.
GROUP_ROWS = 4096
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Links that are kept before they are reduced to stars.
MOST_LINKS = 1 << 20

REFERENCE_FINGERPRINTS = np.random.default_rng(12).integers(0, 1 << 64, REFERENCES, np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included: words lower-cased A-Z, split at white space of ASCII."""
    run = text.encode("utf-8", "surrogatepass").lower().split()
    if not run:
        return np.empty(0, np.uint64)
    width, joined = min(words, len(run)), b" ".join(run)
    lengths = np.fromiter(map(len, run), np.int64, len(run))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(run) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes: a bit is set where over half of them have it set."""
    lengths = np.array([len(x) for x in sets], np.int64)
    counts = np.zeros((len(sets), 64), np.int64)
    owner, hashes = np.repeat(np.arange(len(sets)), lengths), np.concatenate([np.empty(0, np.uint64), *sets])
    for low in range(0, len(hashes), CHUNK):
        some, of = hashes[low : low + CHUNK], owner[low : low + CHUNK]
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > lengths[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and the fingerprint as a long, one row per document."""

    def sign(batches):
        for batch in batches:
            parts, size, low = [], 0, 0
            for at, text in enumerate([*batch["text"], None]):
                if parts and (text is None or size > CHUNK):
                    found = fingerprints_of(parts).view(np.int64)
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[low:at].astype("Int64").array, "fingerprint": found})
                    parts, size, low = [], 0, at
                if text is not None:
                    parts.append(shingle_hashes(text, words))
                    size += len(parts[-1])

    return texts(docs).mapInPandas(sign, "doc_id long, fingerprint long")


def blocks_of_bits(n: int) -> list[tuple[int, int]]:
    """First bit and width of n blocks that make up 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def grouped(nodes: DataFrame, most: int) -> DataFrame:
    """group, node, distances: a row for every pair of blocks of bits; the group names the pair and its bits."""
    parts = [
        F.shiftrightunsigned("node", first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in blocks_of_bits(most + 2)
    ]
    keys = [F.xxhash64(F.lit(i), a, b) for i, (a, b) in enumerate(combinations(parts, 2))]
    return nodes.select(F.explode(F.array(*keys)).alias("group"), "node", "distances")


def linked(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between rows 0 to n as stars: every row with the least row that it reaches."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        least = least[least]
        if (least == before).all():
            break
    rows = np.flatnonzero(least != np.arange(n))
    return rows, least[rows]


def near(i: np.ndarray, j: np.ndarray, node: np.ndarray, distances: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows are links: the largest difference of distances first, then the bits."""
    keep = np.flatnonzero(np.abs(distances[i] - distances[j]).max(axis=1) <= most)
    return keep[np.bitwise_count((node[i[keep]] ^ node[j[keep]]).view(np.uint64)) <= most]


def links_within(group: np.ndarray, node: np.ndarray, distances: np.ndarray, most: int):
    """Stars of the links of rows sorted by group and first distance."""
    found, kept = [], 0
    at, step = np.arange(len(group)), 0
    while len(at):
        step += 1
        at = at[at + step < len(group)]
        # a row that has left its group or the reach of its first distance stays out: both only grow
        at = at[(group[at + step] == group[at]) & (distances[at + step, 0] - distances[at, 0] <= most)]
        if len(at):
            hit = at[near(at, at + step, node, distances, most)]
            found.append((hit, hit + step))
            kept += len(hit)
            if kept > MOST_LINKS:
                found = [linked(found, len(group))]
                kept = len(found[0][0])
    return linked(found, len(group))


def _columns(part: pd.DataFrame):
    """Fingerprints, which are the nodes, and their distances."""
    return part["node"].to_numpy(np.int64), np.array(part["distances"].tolist(), np.int16).reshape(len(part), REFERENCES)


def _links_of_groups(rows: DataFrame, most: int) -> DataFrame:
    """a, b: stars of the links within groups that fit one task."""

    def run(batches):
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            # the last group may go on in the next batch
            ends = batch["group"].to_numpy() == batch["group"].iloc[-1] if len(batch) else np.empty(0, bool)
            left = batch[ends]
            yield links(batch[~ends])
        if left is not None:
            yield links(left)

    def links(part):
        node, distances = _columns(part)
        a, b = links_within(part["group"].to_numpy(), node, distances, most)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return rows.repartition("group").sortWithinPartitions("group", F.col("distances")[0]).mapInPandas(run, "a long, b long")


def _links_of_large(rows: DataFrame, most: int, group_rows: int) -> DataFrame:
    """a, b: stars of the links within larger groups, block by block."""
    first = F.col("distances")[0]
    sizes = written(rows.groupBy("group", first.alias("first")).agg(F.count(F.lit(1)).alias("n")), "simhash-sizes")
    dealt = rows.withColumn("first", first).join(sizes, ["group", "first"])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group_rows)))

    def pack(key, part):
        node, distances = _columns(part)
        low, high = distances.min(axis=0).tolist(), distances.max(axis=0).tolist()
        return pd.DataFrame([(*key, low, high, pickle.dumps((node, distances)))], columns=["group", "first", "salt", "low", "high", "packed"])

    schema = "group long, first int, salt long, low array<int>, high array<int>, packed binary"
    blocks = written(
        dealt.select("group", F.col("first").cast("int").alias("first"), "salt", "node", "distances")
        .groupBy("group", "first", "salt").applyInPandas(pack, schema),
        "simhash-blocks",
    )
    b = blocks.select(*[F.col(c).alias(f"{c}_b") for c in blocks.columns])
    later = (F.col("first") < F.col("first_b")) | ((F.col("first") == F.col("first_b")) & (F.col("salt") <= F.col("salt_b")))
    reach = F.forall(F.arrays_zip("low", "high", "low_b", "high_b"), lambda x: (x["low"] - x["high_b"] <= most) & (x["low_b"] - x["high"] <= most))
    meet = blocks.join(b, (F.col("group") == F.col("group_b")) & (F.col("first_b") - F.col("first") <= most) & later).where(reach)

    def judge(batches):
        for batch in batches:
            for blob_a, blob_b in zip(batch["packed"], batch["packed_b"], strict=True):
                (node_a, far_a), (node_b, far_b) = pickle.loads(blob_a), pickle.loads(blob_b)
                node, distances, found, kept = np.concatenate([node_a, node_b]), np.concatenate([far_a, far_b]), [], 0
                others = len(node_a) + np.arange(len(node_b))
                for i in range(len(node_a)):
                    hit = others[near(np.full(len(others), i), others, node, distances, most)]
                    found.append((np.full(len(hit), i), hit))
                    kept += len(hit)
                    if kept > MOST_LINKS:
                        found = [linked(found, len(node))]
                        kept = len(found[0][0])
                x, y = linked(found, len(node))
                yield pd.DataFrame({"a": node[x], "b": node[y]})

    return meet.select("packed", "packed_b").mapInPandas(judge, "a long, b long").where("a != b")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MOST_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    signed = written(fingerprints(docs, words), "simhash-fingerprints")
    # a node and a row of the table for each distinct fingerprint
    distances = F.array(*[F.bit_count(F.col("node").bitwiseXOR(F.lit(int(r)))).cast("short") for r in REFERENCE_FINGERPRINTS.view(np.int64)])
    nodes = signed.where("doc_id IS NOT NULL").groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("doc"))
    nodes = written(nodes.withColumn("distances", distances), "simhash-nodes")
    rows = grouped(nodes, most)
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    large = written(sizes.where(F.col("members") > group_rows).select("group"), "simhash-large")
    if large.isEmpty():
        links = _links_of_groups(rows, most)
    else:
        links = _links_of_groups(rows.join(large, "group", "left_anti"), most)
        links = links.union(_links_of_large(rows.join(large, "group", "left_semi"), most, group_rows))
    classes = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = written(classes.select("node", "doc", "component"), "simhash-classes")
    least = written(classes.groupBy("component").agg(F.min("doc").alias("component_id")), "simhash-components")
    named = written(classes.join(least, "component").select(F.col("node").alias("fingerprint"), "component_id"), "simhash-named")
    return signed.join(named, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
