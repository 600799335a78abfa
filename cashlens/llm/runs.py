"""Periodic runs of words: stretches that repeat with a smallest period q at least LEAST_REPEATS times.

Every document is cut into overlapping tiles, once for each octave [P, 2P) of periods. A run with a period of the
octave covers a boundary c, a multiple of 2P, so that `width` words from c on equal those a period later; a tile
is kept only where names (hashes of fixed lengths, built by doubling) say that such a boundary may be in it. Kept
tiles are dealt over the cluster and solved one by one: Z-functions of the words after and before a boundary give,
for every period of the octave, how far the repetition goes to both sides within the tile. What comes out are
fragments: intervals [low, high) of words that equal the word a period later. They are shuffled by (document,
period), and fragments that touch are stitched to whole intervals, however many tiles a run spans. Of the
periods of one stretch the smallest stays. A period that is a multiple of a smaller one at its boundary is left
to the smaller one's octave, so monotonous documents do not multiply fragments.

Defined results: a null text counts as the empty one; words are split at white space of ASCII and compared by
their bytes; repeated rows are solved one by one; a document without words or runs has an empty list of runs; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashlens.session import written

from .common import texts

LEAST_REPEATS = 4
LEAST_WORDS = 6
#: Words of a tile between its first and last boundary, where the octave allows that many.
TILE_WORDS = 2048
#: Words whose tiles are handed on at a time.
BATCH_WORDS = 1 << 20

_NAME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def doubled(names: np.ndarray, length: int) -> np.ndarray:
    """Names of the stretches of twice the length; equal stretches have equal names."""
    mixed = names[:-length] * _NAME + (names[length:] ^ (names[length:] >> np.uint64(29)))
    return mixed ^ (mixed >> np.uint64(32))


def octaves(numbers: np.ndarray):
    """Shortest period P of each octave, the width of its test, and the boundaries that may lie in a run."""
    n, period = len(numbers), 1
    # runs have LEAST_REPEATS periods and LEAST_WORDS words: at least 3 P words, and 5 where P is 1, equal the word a period later
    names = (numbers.astype(np.uint64) + np.uint64(1)) * _NAME
    by_length = {1: names}
    while LEAST_REPEATS * period <= n and n >= LEAST_WORDS:
        width, stride = max(period, 4 if period == 1 else 1), 2 * period
        while (longest := max(by_length)) < width:
            by_length[2 * longest] = doubled(by_length[longest], longest)
        names = by_length[width]
        table = np.zeros(-(-len(names) // stride) * stride, np.uint64)
        table[: len(names)] = names
        table = table.reshape(-1, stride)
        hit = np.flatnonzero((table[:, period:] == table[:, :1]).any(axis=1))
        if len(hit):
            yield period, width, hit * stride
        by_length = {k: v for k, v in by_length.items() if k >= period}
        period *= 2


def tiles(numbers: np.ndarray):
    """octave (its P), first word, numbers and boundaries within them, of every tile that may hold part of a run."""
    for period, width, boundaries in octaves(numbers):
        core = max(1, TILE_WORDS // (2 * period)) * 2 * period
        of = boundaries // core
        for tile in np.unique(of).tolist():
            first = max(0, tile * core - 2 * period)
            end = min(len(numbers), (tile + 1) * core + width + 2 * period)
            yield period, first, numbers[first:end], (boundaries[of == tile] - first).astype(np.int32)


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the beginning on."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(period: int, first: int, numbers: np.ndarray, boundaries: np.ndarray):
    """period, low, high of what repeats around the boundaries of a tile, counted from the document's first word."""
    width, stride = max(period, 4 if period == 1 else 1), 2 * period
    found: dict[int, list[list[int]]] = {}
    for c in boundaries.tolist():
        ahead = numbers[c : c + stride + width + 2 * period].tolist()
        z = np.array(z_function(ahead), np.int64)
        after = z[period : 2 * period]
        periods = period + np.flatnonzero(after >= width)
        if not len(periods):
            continue
        # the smallest period of the first p words: where it divides p, a smaller octave has the run
        reach = np.maximum.accumulate(np.arange(1, len(z)) + z[1:])
        smallest = 1 + np.searchsorted(reach, periods)
        periods = periods[(smallest >= periods) | (periods % smallest != 0)]
        if not len(periods):
            continue
        low, end = max(0, c - stride), min(len(numbers), c + 2 * period)
        before = numbers[low:c][::-1].tolist()
        back = z_function([*before, -1, *numbers[low:end][::-1].tolist()])
        for p in periods.tolist():
            b, f = back[len(before) + 1 + end - (c + p)], min(int(z[p]), stride + width)
            open_left, open_right = b == len(before) and first + c - b > 0, f == stride + width
            item, kept = [first + c - b, first + c + f, open_left, open_right], found.setdefault(p, [])
            if kept and item[0] <= kept[-1][1]:
                last = kept[-1]
                if item[1] >= last[1]:
                    last[1], last[3] = item[1], open_right
            else:
                kept.append(item)
    least = LEAST_REPEATS - 1
    for p, intervals in found.items():
        for low, high, open_left, open_right in intervals:
            # what ends within the tile on both sides and is too short belongs to no run
            if open_left or open_right or high - low >= max(least * p, LEAST_WORDS - p):
                yield p, low, high


def scanned(docs: DataFrame, rewrite=None) -> DataFrame:
    """A row per document (octave null): key, doc_id, n_words, sha256 of its words, text where it has tiles; and a row per tile."""
    names = ["key", "doc_id", "n_words", "sha256", "text", "octave", "first", "numbers", "boundaries"]

    def find(batches):
        for batch in batches:
            out, size = [], 0
            for key, doc_id, text in zip(batch["key"], batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                words = words_of(text)
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                own = 0
                for octave, first, numbers, boundaries in tiles(numbered(words)):
                    out.append((key, None, None, None, None, octave, first, numbers.tobytes(), boundaries.tobytes()))
                    own += len(numbers)
                    if size + own > BATCH_WORDS:
                        yield frame(out)
                        out, size = [], -own
                digest = hashlib.sha256(b" ".join(words)).hexdigest()
                out.append((key, doc_id, len(words), digest, text if own else None, None, None, None, None))
                size += own + 1
            yield frame(out)

    def frame(out):
        kinds = {"key": "int64", "doc_id": "Int64", "n_words": "Int64", "octave": "Int32", "first": "Int64"}
        return pd.DataFrame(out, columns=names, dtype=object).astype(kinds)

    schema = "key long, doc_id long, n_words long, sha256 string, text string, octave int, first long, numbers binary, boundaries binary"
    return texts(docs).withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text").mapInPandas(find, schema)


def solved(tile_rows: DataFrame) -> DataFrame:
    """key, period, low, high: the fragments of every tile."""

    def run(batches):
        for batch in batches:
            out = []
            for key, octave, first, numbers, boundaries in zip(*(batch[c] for c in ("key", "octave", "first", "numbers", "boundaries")), strict=True):
                found = fragments(int(octave), int(first), np.frombuffer(numbers, np.int32), np.frombuffer(boundaries, np.int32))
                out += [(key, *x) for x in found]
            yield pd.DataFrame(out, columns=["key", "period", "low", "high"], dtype="int64")

    dealt = tile_rows.select("key", "octave", "first", "numbers", "boundaries").repartition("key", "octave", "first")
    return dealt.mapInPandas(run, "key long, period long, low long, high long")


def stitched(pieces: DataFrame) -> DataFrame:
    """key, start, length, period of every run: fragments that touch are one, and of equal stretches the smallest period stays."""
    before = Window.partitionBy("key", "period").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce((F.col("low") > F.max("high").over(before)).cast("long"), F.lit(0))
    whole = (
        pieces.withColumn("apart", apart).withColumn("interval", F.sum("apart").over(upto))
        .groupBy("key", "period", "interval").agg(F.min("low").alias("start"), (F.max("high") + F.col("period")).alias("end"))
        .withColumn("length", F.col("end") - F.col("start"))
        .where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_REPEATS * F.col("period")))
    )
    return whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def kept_words(words: list[bytes], runs) -> list[bytes]:
    """The words that no run holds after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        depth[run["start"] + run["period"]] += 1
        depth[run["start"] + run["length"]] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed, collapsed_sha256.

    runs: start, period, length of each run, by start and period. collapsed: the words outside repeats joined by a
    blank, null where there is no run and all words stay. `rewrite(doc_id, words)` may change the words first.
    """
    rows = written(scanned(docs, rewrite), "runs-tiles")
    found = stitched(solved(rows.where("octave IS NOT NULL")))
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    each = rows.where("octave IS NULL").select("key", "doc_id", "n_words", "sha256", "text").join(lists, "key", "left")

    def collapse(batches):
        for batch in batches:
            out = []
            for doc_id, n, digest, text, runs in zip(*(batch[c] for c in ("doc_id", "n_words", "sha256", "text", "runs")), strict=True):
                if runs is None or not len(runs):
                    out.append((doc_id, n, [], None, digest))
                    continue
                words = words_of(text)
                rest = b" ".join(kept_words(words if rewrite is None else rewrite(doc_id, words), runs))
                out.append((doc_id, n, runs, rest.decode("utf-8", "surrogatepass"), hashlib.sha256(rest).hexdigest()))
            names = ["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"]
            yield pd.DataFrame(out, columns=names, dtype=object).astype({"doc_id": "Int64", "n_words": "Int64"})

    # doc_id may be null: objects keep whole numbers whole
    schema = "doc_id long, n_words long, runs array<struct<start: long, period: long, length: long>>, collapsed string, collapsed_sha256 string"
    return each.select("doc_id", "n_words", "sha256", "text", "runs").mapInPandas(collapse, schema)


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that a tenth of the documents gets by the checksum of their doc_id."""
    if doc_id is None or pd.isna(doc_id) or not words:
        return words
    h, n = crc32(str(int(doc_id)).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed words."""
    rows = periodic_runs(docs, planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / (-F.col("best.p"))).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
