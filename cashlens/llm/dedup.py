"""Near-duplicate classes by HyperMinHash.

Of a document's hashed shingles, the leading bits name a bucket; the least rest in each bucket is stored as
its count of leading zeros and the next mantissa bits, 16 bits in all. Empty buckets borrow from another one
by a fixed order of the buckets, so that short documents can be compared as well. Bands of registers propose
pairs, the share of equal registers (less the share that is equal by chance) estimates the similarity, and
what can reach the threshold is confirmed on the full shingle sets.

Copies form one class by the fingerprint of their whole set before anything is paired. Within a bucket of a
band no all-pairs list is made: members meet the smallest member, and members that are still in different
components after that meet pair by pair in small buckets and block by block in large ones.

Defined results: null or empty texts have no shingles and are linked with nothing; a text with fewer words
than a shingle is one shingle; rows with a null doc_id are returned, linked with nothing; rows that share a
doc_id are one document, and if their texts differ the one with the least fingerprint speaks for its near
duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import small_batches, written

from .common import texts, unused

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND_REGISTERS = 4
#: Estimates this far below the threshold are still confirmed: more than six standard errors of 128 registers.
ESTIMATE_MARGIN = 0.25
#: Members that meet pair by pair; a bucket with more is compared in blocks of about BLOCK members.
SMALL_BUCKET = 32
BLOCK = 256
#: Pairs of blocks that cross to Python at a time; a block may hold a megabyte of hashes.
BLOCK_PAIRS = 4
#: Rows with texts that Python turns into objects at a time.
TEXT_ROWS = 500
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 2_000_000

_BUCKETS = 1 << BUCKET_BITS
_REST_BITS = 64 - BUCKET_BITS
_BANDS = _BUCKETS // BAND_REGISTERS


#: A random odd number for each byte, the same for both cases of A-Z; 0 for white space.
_BYTE_VALUES = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: A random number for each place of a byte in its word.
_PLACES = np.uint64(0xD1342543DE82EF95)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]
_BYTE_VALUES[[32, 9, 10, 11, 12, 13]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _scattered(h: np.ndarray) -> np.ndarray:
    """Numbers without any structure left: what two words share in sums of them is chance."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word: a random number for each (byte, place), summed per word."""
    values = _BYTE_VALUES[np.frombuffer(data, np.uint8)]
    word = values != 0
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.arange(len(values)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(values)]))))
    drawn = np.where(word, _scattered(values + place.astype(np.uint64) * _PLACES), np.uint64(0))
    return _mixed(np.add.reduceat(drawn, starts)), starts


def _pieces(data: bytes):
    """The text in pieces of about CHUNK_BYTES that end with a white space."""
    start = 0
    while len(data) - start > 2 * CHUNK_BYTES:
        end = min((e for e in (data.find(space, start + CHUNK_BYTES) for space in (b" ", b"\n", b"\t")) if e >= 0), default=len(data))
        yield data[start:end]
        start = end
    yield data[start:]


def _shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    n = len(hashes) - width + 1
    mixed = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        mixed = mixed * _BASE + hashes[i : n + i]
        mixed ^= mixed >> np.uint64(31)
    return _mixed(mixed)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words lower-cased A-Z, split at white space of ASCII."""
    hashes = np.concatenate([word_hashes(piece)[0] for piece in _pieces(_utf8(text))])
    return np.unique(_shingled(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def shingle_hashes_of(texts_: list[str], words: int):
    """shingle_hashes of each text; the words of short texts are hashed together."""
    group, size = [], 0
    for text in [*texts_, None]:
        if group and (text is None or size + len(text) > CHUNK_BYTES):
            data = [_utf8(t) for t in group]
            if len(data) == 1:
                yield shingle_hashes(group[0], words)
            else:
                hashes, starts = word_hashes(b"\n".join(data))
                ends = np.cumsum([len(d) + 1 for d in data])
                cuts = np.append(0, np.searchsorted(starts, ends)).tolist()
                whole = _shingled(hashes, words) if len(hashes) >= words else hashes[:0]
                for low, high in zip(cuts, cuts[1:]):
                    if high - low >= words:
                        yield np.unique(whole[low : high - words + 1])
                    else:
                        yield _shingled(hashes[low:high], high - low) if high > low else hashes[:0]
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)


def _borrowing_order() -> np.ndarray:
    """Row i: bucket i, then the others in a fixed random order."""
    draw = np.random.default_rng(20).random((_BUCKETS, _BUCKETS))
    np.fill_diagonal(draw, -1)
    return np.argsort(draw, axis=1)


def registers(sets: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """A row of 16-bit registers for each nonempty sorted set of hashes."""
    hashes, lengths = np.concatenate(sets), [len(x) for x in sets]
    cell = np.repeat(np.arange(len(sets)) * _BUCKETS, lengths) + (hashes >> np.uint64(_REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    least, filled = np.zeros(len(sets) * _BUCKETS, np.uint64), np.zeros(len(sets) * _BUCKETS, bool)
    least[cell[first]], filled[cell[first]] = hashes[first] & np.uint64((1 << _REST_BITS) - 1), True
    empty, owned, step = np.flatnonzero(~filled), filled.copy(), 0
    while len(empty):
        step += 1
        bucket = empty % _BUCKETS
        lender = empty - bucket + order[bucket, step]
        lends = owned[lender]
        least[empty[lends]] = least[lender[lends]]
        empty = empty[~lends]
    mantissa, length = np.frexp(least.astype(np.float64))
    fraction = np.clip(((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64), 0, (1 << MANTISSA_BITS) - 1)
    return ((np.maximum(_REST_BITS - length, 0) << MANTISSA_BITS) + fraction).astype(np.uint16).reshape(-1, _BUCKETS)


def chance_equal(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of two sets without common shingles are equal.

    A bucket's least value is treated as the first point of a Poisson process; each level of leading zeros
    contributes a geometric series over its mantissa cells.
    """
    rate_a, rate_b = np.maximum(n_a / _BUCKETS, 1.0), np.maximum(n_b / _BUCKETS, 1.0)
    total, cells = np.zeros(len(rate_a)), 1 << MANTISSA_BITS
    for level in range(_REST_BITS):
        low = 2.0 ** -(level + 1)
        width = low / cells
        both = rate_a + rate_b
        total += (
            np.expm1(-rate_a * width) * np.expm1(-rate_b * width) * np.exp(-both * low)
            * np.expm1(-both * width * cells) / np.expm1(-both * width)
        )
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity estimates from register matrices: the share of equal registers, corrected for chance."""
    sizes, which = np.unique(np.stack([n_a, n_b]).astype(np.int64), axis=1, return_inverse=True)
    chance = chance_equal(sizes[0], sizes[1])[which.ravel()]
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _slices(batches):
    """The Arrow batches in slices of TEXT_ROWS rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(low, TEXT_ROWS)


def signatures(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, fingerprint of the whole set, registers; the last two null without shingles."""

    def sign(batches):
        order = _borrowing_order()
        for part in _slices(batches):
            sets = list(shingle_hashes_of(part["text"].to_pylist(), words))
            rows = iter(registers(full, order)) if (full := [x for x in sets if len(x)]) else None
            out = [(len(x), xxhash.xxh3_128_digest(x.tobytes()), next(rows).tobytes()) if len(x) else (0, None, None) for x in sets]
            types = {"n_shingles": pa.int64(), "fingerprint": pa.binary(), "registers": pa.binary()}
            columns = {name: pa.array(values, kind) for (name, kind), values in zip(types.items(), zip(*out), strict=True)}
            yield pa.RecordBatch.from_pydict(columns | {name: part[name].cast(pa.int64()) for name in ("doc_id", "text_hash")})

    schema = "n_shingles long, fingerprint binary, registers binary, doc_id long, text_hash long"
    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, schema)


def _banded(sketches: DataFrame) -> DataFrame:
    """bucket, node: one row for each band of each sketch; the last bits of a bucket name the band."""
    width, bits = 2 * BAND_REGISTERS, (_BANDS - 1).bit_length()
    keys = [
        F.shiftleft(F.xxhash64(F.lit(i), F.substring("registers", 1 + width * i, width)), bits).bitwiseOR(F.lit(i).cast("long"))
        for i in range(_BANDS)
    ]
    return sketches.select(F.explode(F.array(*keys)).alias("bucket"), "node")


def _links(found):
    """The found pairs a, b as an Arrow batch."""
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirmed(pairs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b that are links: first by sizes and estimates, then by full shingle sets.

    members: node, n_shingles, registers, text.
    """
    percent, least = round(similarity * 100), similarity - ESTIMATE_MARGIN

    def check(batches):
        last, set_a = None, None
        for batch in (part.to_pandas() for part in _slices(batches)):
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, _BUCKETS) for c in ("registers_a", "registers_b"))
            batch = batch[estimate(a, b, batch["n_shingles_a"].to_numpy(), batch["n_shingles_b"].to_numpy()) >= least]
            out = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, set_a = a, shingle_hashes(text_a, words)
                set_b = shingle_hashes(text_b, words)
                common = len(set_a) + len(set_b) - len(np.union1d(set_a, set_b))
                if 100 * common >= percent * (len(set_a) + len(set_b) - common):
                    out.append((a, b))
            yield _links(out)

    def side(name):
        return members.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n_shingles", "registers", "text")])

    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    rows = pairs.join(side("b"), "b").join(side("a"), "a").where(small >= F.lit(similarity) * large - 1e-9)
    return rows.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for all nodes of the links a, b.

    Alternates large-star and small-star steps: every node hands the nodes it knows to the smallest one, until
    every node hangs on one root. Each round is written, so a lost executor costs no earlier round.
    """

    def large_star(edges):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(edges):
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        to_least = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return to_least.union(least.select("u", F.col("m").alias("v"))).distinct()

    def settled(edges):
        """Whether every node hangs on one root."""
        many = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return many.isEmpty() and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while not settled(edges):
        edges = written(small_star(large_star(edges)), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mixed_buckets(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets that still hold several components, with their number of members."""
    rows = crowded.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(mixed.where("low != high").select("bucket", "members"), "bucket")


def _pairs_of_small(mixed: DataFrame) -> DataFrame:
    """Distinct pairs of different components within buckets of at most SMALL_BUCKET members."""
    rows = mixed.where(F.col("members") <= SMALL_BUCKET).select("bucket", "node", "component")
    other = rows.toDF("of", "b", "other")
    meet = (F.col("bucket") == F.col("of")) & (F.col("node") < F.col("b")) & (F.col("component") != F.col("other"))
    return rows.join(other, meet).select(F.col("node").alias("a"), "b").distinct()


def _links_of_large(mixed: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between different components within larger buckets.

    Members are dealt to blocks by hash; a component that fills a block of its own gets blocks of its own.
    Two blocks meet in one row unless both belong to the same component, and only confirmed links leave it. A
    pair is judged in the first band that it shares. Few pairs of blocks cross to Python at a time, however many meet.
    """
    rows = mixed.where(F.col("members") > SMALL_BUCKET)
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("of_component"))
    own = sizes.where(F.col("of_component") >= BLOCK)
    dealt = (
        rows.join(own, ["bucket", "component"], "left")
        .withColumn("owner", F.when(F.col("of_component").isNotNull(), F.col("component")).otherwise(F.lit(-1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("of_component", "members") / F.lit(BLOCK))))
        .select("bucket", "owner", "block", "node", "component")
        .join(members, "node")
    )
    percent, caller = round(similarity * 100), mixed.sparkSession

    def pack(key, rows):
        sets = list(shingle_hashes_of(rows["text"].tolist(), words))
        parts = (rows["node"].to_numpy(np.int64), rows["component"].to_numpy(np.int64), [len(x) for x in sets], b"".join(rows["registers"]), np.concatenate(sets))
        return pd.DataFrame([(*key, pickle.dumps(parts))], columns=["bucket", "owner", "block", "packed"])

    packed = written(
        dealt.groupBy("bucket", "owner", "block").applyInPandas(pack, "bucket long, owner long, block long, packed binary"),
        "blocks",
        small_batches(caller, BLOCK_PAIRS),
    )
    other = packed.select(F.col("bucket").alias("of"), F.col("owner").alias("owner_b"), F.col("block").alias("block_b"), F.col("packed").alias("packed_b"))
    meet = (
        (F.col("bucket") == F.col("of"))
        & ((F.col("owner") == -1) | (F.col("owner") != F.col("owner_b")))
        & ((F.col("owner") < F.col("owner_b")) | ((F.col("owner") == F.col("owner_b")) & (F.col("block") <= F.col("block_b"))))
    )

    def judge(batches):
        for batch in batches:
            for bucket, blob_a, blob_b in zip(batch["bucket"], batch["packed"], batch["packed_b"], strict=True):
                parts = (pickle.loads(blob.as_buffer()) for blob in (blob_a, blob_b))
                yield _links(_links_between(bucket.as_py() % _BANDS, *parts, similarity, percent))

    found = packed.join(other, meet).select("bucket", "packed", "packed_b").mapInArrow(judge, "a long, b long").distinct()
    return written(found, "block-links", caller)


def _links_between(band, block_a, block_b, similarity, percent):
    """Links between members of two packed blocks of a bucket of the given band."""
    node_a, comp_a, len_a, regs_a, sets_a = block_a
    node_b, comp_b, len_b, regs_b, sets_b = block_b
    len_a, len_b = np.asarray(len_a), np.asarray(len_b)
    regs_a, regs_b = (np.frombuffer(r, np.uint16).reshape(-1, _BUCKETS) for r in (regs_a, regs_b))
    bands_a, bands_b = (r.view(np.uint64).reshape(len(r), -1) for r in (regs_a, regs_b))
    ends_a, ends_b = np.append(0, np.cumsum(len_a)), np.append(0, np.cumsum(len_b))
    pairs, least = [], similarity - ESTIMATE_MARGIN
    for i in range(len(node_a)):
        ratio = np.minimum(len_a[i], len_b) >= similarity * np.maximum(len_a[i], len_b) - 1e-9
        near = np.flatnonzero(ratio & (comp_a[i] != comp_b))
        near = near[~(bands_b[near, :band] == bands_a[i, :band]).any(axis=1)]
        near = near[(regs_b[near] == regs_a[i]).mean(axis=1) >= least]  # the corrected estimate is never larger
        pairs.append(np.stack([np.full(len(near), i), near], axis=1))
    at_a, at_b = np.concatenate(pairs).T
    near = estimate(regs_a[at_a], regs_b[at_b], len_a[at_a], len_b[at_b]) >= least
    found = []
    for i, j in zip(at_a[near].tolist(), at_b[near].tolist(), strict=True):
        own, other = sets_a[ends_a[i] : ends_a[i + 1]], sets_b[ends_b[j] : ends_b[j + 1]]
        place = np.searchsorted(own, other)
        common = int((own[np.minimum(place, len(own) - 1)] == other).sum())
        if 100 * common >= percent * (len(own) + len(other) - common):
            found.append((node_a[i], node_b[j]))
    return found


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    signed = written(signatures(docs, words), "signatures")
    sketches = written(
        signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("fingerprint")
        .agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "registers")).alias("s"))
        .select("fingerprint", F.col("s.doc_id").alias("node"), "s.text_hash", "s.n_shingles", "s.registers"),
        "sketches",
    )
    # of different sets that the same document leads, the one with the least fingerprint is compared
    led = sketches.groupBy("node").agg(F.min("fingerprint").alias("least"), F.count(F.lit(1)).alias("sets"))
    clashing = written(led.where("sets > 1").select("node", "least"), "clashing")
    if not clashing.isEmpty():
        sketches = written(sketches.join(clashing, "node", "left").where("least IS NULL OR least = fingerprint").drop("least"), "sketches")
    banded = _banded(sketches)
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(banded.join(leaders.select("bucket", "a"), "bucket"), "crowded")
    # only these nodes are ever compared: their texts cross the network once
    near = crowded.select("node").distinct().join(sketches.select("node", "text_hash", "n_shingles", "registers"), "node")
    hashed = texts(docs).withColumnRenamed("doc_id", "node").withColumn("text_hash", F.xxhash64("text"))
    members = written(hashed.join(near, ["node", "text_hash"]).dropDuplicates(["node"]).drop("text_hash"), "members")

    met = crowded.where("node != a").select("a", F.col("node").alias("b")).distinct()
    links = written(_confirmed(met, members, words, similarity), "confirmed")
    mixed = written(_mixed_buckets(crowded, components(links)), "mixed-buckets")
    links = links.union(_confirmed(_pairs_of_small(mixed), members, words, similarity))
    labels = components(links.union(_links_of_large(mixed, members, words, similarity)))
    classes = sketches.select("fingerprint", "node")
    return (
        signed.select("doc_id", "n_shingles", "fingerprint")
        .join(classes, "fingerprint", "left")
        .join(labels, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def distinct_documents(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, as it came: the one with the smallest doc_id.

    Of rows that share that doc_id one stays, by the least hash of its text. Rows without doc_id are linked with
    nothing and stay. Columns keep names and values; an empty table gives an empty result.
    """
    kept_id, text_hash, least = unused(docs, "kept_id", "text_hash", "least_hash")
    kept = near_duplicates(docs, words, similarity).where("kept AND doc_id IS NOT NULL")
    ids = written(kept.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count(F.lit(1)).alias("rows")), "kept")
    several = written(ids.where("rows > 1").select(kept_id), "kept-several")
    only = ids.where("rows = 1").select(kept_id)
    rows = docs.join(only, docs["doc_id"] == only[kept_id]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    if several.isEmpty():
        return rows
    # read apart from the others, so that these texts alone cross the network again
    hashed = docs.withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    repeated = written(hashed.join(several, hashed["doc_id"] == several[kept_id]), "kept-repeated")
    first = repeated.groupBy(F.col(kept_id).alias(least)).agg(F.min(text_hash).alias(f"{least}_"))
    one = repeated.join(first, (F.col(kept_id) == F.col(least)) & (F.col(text_hash) == F.col(f"{least}_"))).dropDuplicates([kept_id])
    return rows.unionByName(one.select(*docs.columns))
