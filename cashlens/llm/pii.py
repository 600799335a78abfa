"""Personal data by fixed patterns, and by contexts bootstrapped from what they find.

The fixed patterns give the seed entities. Every identifier-like token (one with enough digits) is an instance,
and the text just before it is a lexical pattern: up to two words within PATTERN_CHARS characters. Spark scores
the graph of patterns and instances in turns: a pattern is as good as the share of its occurrences that stand
before good instances, an instance is as good as its patterns leave no doubt. An instance that scores the
confidence supports patterns like a seed, and turns go on until no score moves by more than a billionth.

An occurrence is a place of any document with the pattern before it, so ordinary words, which stand before
anything, never become patterns. Counting that for all patterns would cost more than all else, so the graph is
first scored with the instances alone as occurrences. Scores rise with every score and fall with every
occurrence, so this bounds them from above: only patterns that qualify there, and those before a value that
reached the confidence there, can matter. Occurrences in SAMPLE_ROWS documents tighten the bound, and what is left
is counted over all documents before the turns are taken again.

Behind a pattern of high confidence with enough support, every token with a digit, underscore or @ is added as a
span of kind "context", of whatever length. Spans never overlap base spans.

Defined results: a null text counts as the empty one; repeated rows are scanned one by one and count once in
the graph; instances of the graph are at most MOST_CHARS long; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from .common import bounded_sample, sha256, spans_text, texts

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "context": 4}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits can only begin a match at its own beginning
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NOT_DIGITS = re.compile(r"[^0-9]+")

#: What an identifier-like token is: digits and characters in it, and what ends it.
LEAST_DIGITS, MOST_CHARS = 5, 64
ENDS = frozenset(" \t\n\r\v\f\"'`<>(){}[],;|=:!?#$%&*")
#: A pattern needs this many different seeds or found values, and this confidence.
LEAST_SEEDS, LEAST_CONFIDENCE = 5, 0.8
PATTERN_CHARS = 48
#: A run with the blanks behind it, and the last of a pattern.
RUN, LAST_RUN = re.compile(r"\S+\s*"), re.compile(r"\S+\s*\Z")
#: Patterns that are sought by one automaton at most, some 50 MB of it; documents that tighten the first bound.
MOST_SOUGHT, SAMPLE_ROWS = 100_000, 20_000
#: Bits of a bitmap at most; with more candidates than that suits, more others reach the join.
MOST_BITS = 1 << 25


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, found from each @ outwards, so that long runs without @ cost nothing."""
    low = at = 0
    while (at := text.find("@", max(at, low))) >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(s, e, "email") for s, e in emails(text)]
    if not DIGITS.search(text):
        return spans
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return spans


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def instances(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, bool]]:
    """start, end, value, pattern, seed of every identifier-like token and base span, two patterns for each."""
    found, covered = [], sorted((s, e) for s, e, _ in base)
    places, low = [(s, e, True) for s, e in covered], 0
    for m in DIGITS.finditer(text):
        if m.start() < low:
            continue
        start, end = m.span()
        while start > low and start > m.start() - MOST_CHARS and text[start - 1] not in ENDS:
            start -= 1
        while end < len(text) and end - start <= MOST_CHARS and text[end] not in ENDS:
            end += 1
        low = end
        while end > start and text[end - 1] in ".-/":
            end -= 1
        value = text[start:end]
        if len(value) <= MOST_CHARS and sum(map(str.isdigit, value)) >= LEAST_DIGITS:
            places.append((start, end, False))
    at = 0
    for start, end, seed in sorted(places):
        if not seed:
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if any(s < end and start < e for s, e in covered[at : at + 3]):
                continue
        for pattern in patterns_before(text, start):
            found.append((start, end, text[start:end].lower(), pattern, seed))
    return found


def patterns_before(text: str, start: int) -> set[str]:
    """The word before a place with what stands between, and the two words before it."""
    before = text[max(0, start - PATTERN_CHARS) : start]
    words = list(re.finditer(r"\S+", before))
    return {p for p in (before[w.start() :] for w in words[-2:]) if len(p) > 1 and any(map(str.isalpha, p))}


def places(text: str):
    """Every place that something may stand at, after a run and its blanks or within one, with the run before it."""
    for m in RUN.finditer(text):
        word = m[0].rstrip()
        if not word.isalnum():
            for i in range(1, len(word)):
                if not word[i - 1].isalnum():
                    yield m.start() + i, word[max(0, i - PATTERN_CHARS) : i]
        yield m.end(), m[0][-PATTERN_CHARS:]


def checksum(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def bitmaps(patterns: DataFrame) -> tuple[bytes, bytes]:
    """Bits of the checksums of the patterns, and of their last words with what follows; about 1 in 16 is set."""
    bits = min(MOST_BITS, 1 << max(16, (16 * patterns.count()).bit_length()))

    def fill(batches):
        out = np.zeros((2, bits), bool)
        for batch in batches:
            for pattern in batch["pattern"]:
                out[0, checksum(pattern) % bits] = out[1, checksum(LAST_RUN.search(pattern)[0]) % bits] = True
        yield pd.DataFrame({"bits": [np.packbits(out, axis=1, bitorder="little").tobytes()]})

    total = np.zeros(bits // 4, np.uint8)
    for row in patterns.select("pattern").coalesce(4).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return total[: bits // 8].tobytes(), total[bits // 8 :].tobytes()


def is_place(text: str, at: int) -> bool:
    """Whether `at` is one of the places of the text."""
    return at == len(text) or not (text[at].isspace() or text[at - 1].isalnum())


def token(text: str, at: int) -> int:
    """The end of the identifier-like token of any length that begins at a place, or the place itself if there is none."""
    end = at
    if at and text[at - 1] not in ENDS:
        return at
    while end < len(text) and text[end] not in ENDS:
        end += 1
    while end > at and text[end - 1] in ".-/":
        end -= 1
    return end if any(c.isdigit() or c in "_@" for c in text[at:end]) else at


def behind(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """row_key, pattern, n, found: how often each of `patterns` stands before a place of a text, and tokens there as spans.

    Up to MOST_SOUGHT patterns are sought by an automaton; with more, bitmaps of checksums let only them and a few
    others out of the texts, and a join removes the others.
    """
    sought = [r["pattern"] for r in patterns.select("pattern").limit(MOST_SOUGHT + 1).collect()]
    few = len(sought) <= MOST_SOUGHT
    if few:
        whole = last = b""
    else:
        sought, (whole, last) = [], bitmaps(patterns)
    bits = 8 * len(whole)

    def known(bitmap: bytes, text: str) -> int:
        at = checksum(text) % bits
        return bitmap[at >> 3] >> (at & 7) & 1

    def before_places(text, automaton):
        if few:
            for end, pattern in automaton.iter(text):
                if is_place(text, end + 1) and pattern in patterns_before(text, end + 1):
                    yield end + 1, pattern
        else:
            for at, run in places(text):
                if known(last, run):
                    yield from ((at, p) for p in patterns_before(text, at) if known(whole, p))

    def count(batches):
        automaton = ahocorasick.Automaton()
        for pattern in sought:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for key, text in zip(batch["row_key"], batch["text"], strict=True):
                at_places = defaultdict(list)
                for at, pattern in before_places(text, automaton):
                    at_places[pattern].append(at)
                base = base_spans(text) if at_places else []
                for pattern, ats in at_places.items():
                    spans = [(at, token(text, at)) for at in ats]
                    found = [f"context:{a}:{b}" for a, b in spans if b > a and not any(s < b and a < e for s, e, _ in base)]
                    out.append((key, pattern, len(ats), found))
            yield pd.DataFrame(out, columns=["row_key", "pattern", "n", "found"], dtype=object).astype({"row_key": "int64", "n": "int64"})

    rows = texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).select("row_key", "text")
    if few and not sought:
        rows = rows.limit(0)
    each = rows.mapInPandas(count, "row_key long, pattern string, n long, found array<string>")
    once = each.groupBy("row_key", "pattern").agg(F.max("n").alias("n"), F.max("found").alias("found"))
    return once if few else once.join(patterns.select("pattern"), "pattern", "left_semi")


def total(at_places: DataFrame) -> DataFrame:
    return at_places.groupBy("pattern").agg(F.sum("n").alias("occurrences"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, occurrences: how often each of `patterns` stands before a place of any text; repeated rows count once."""
    return total(behind(docs, patterns))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, counts, base spans as text with their digest, and instances."""
    kinds = ("email", "ip", "card", "phone")
    names = ["doc_id", "row_key", *[f"n_{k}" for k in kinds], "base_spans", "base_sha256", "instances"]
    fields = ("start", "end", "value", "pattern", "seed")

    def find(batches):
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"].astype("Int64"), batch["row_key"], batch["text"], strict=True):
                base = base_spans(text)
                counts = [sum(s[2] == k for s in base) for k in kinds]
                spans = spans_text(base, KINDS)
                near = [dict(zip(fields, x, strict=True)) for x in instances(text, base)]
                out.append((doc_id, key, *counts, spans, sha256(spans), near))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "base_spans": object, "base_sha256": object})

    instance = "array<struct<start: long, end: long, value: string, pattern: string, seed: boolean>>"
    schema = "doc_id long, row_key long, " + ", ".join(f"n_{k} long" for k in kinds) + f", base_spans string, base_sha256 string, instances {instance}"
    return texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).mapInPandas(find, schema)


def turns(graph: DataFrame, often: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The fixed point of the scores: (pattern, seeds, confidence) and (value, seed, score).

    graph: pattern, value, seed, times. often: pattern, occurrences; a pattern has as many as its instances at least.
    """
    scores, before = graph.groupBy("value").agg(F.max("seed").cast("double").alias("score")), None
    while True:
        good = (
            graph.join(scores.select("value", "score"), "value").groupBy("pattern")
            .agg(
                F.sum(F.col("times") * F.col("score")).alias("good"), F.sum("times").alias("times"),
                F.sum((F.col("score") >= least).cast("long")).alias("seeds"),
            )
            .join(often, "pattern", "left")
            # a place that follows a letter or digit is not counted, so a pattern may have no occurrences but its instances
            .select("pattern", "seeds", (F.col("good") / F.greatest("times", "occurrences")).alias("confidence"))
        )
        good = written(good, "pii-confidence")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        scores = written(
            graph.join(good, "pattern").groupBy("value")
            .agg(F.max("seed").alias("seed"), (1 - doubt).alias("found"))
            .select("value", "seed", F.when(F.col("seed") == 1, 1.0).when(F.col("found") >= least, F.col("found")).otherwise(0.0).alias("score")),
            "pii-values",
        )
        # scores only rise, so an equal sum of billionths says that none moved
        now = scores.agg(F.sum(F.floor(F.col("score") * 1e9).cast("decimal(38,0)"))).first()[0]
        if before is not None and (now or 0) <= before:
            return good, scores
        before = now or 0


def confident_patterns(docs: DataFrame, scanned: DataFrame, least_seeds: int = LEAST_SEEDS, least: float = LEAST_CONFIDENCE):
    """Patterns that enough seeds or found values support (pattern, confidence), and what stands behind them (see `behind`)."""
    rows = scanned.where(F.size("instances") > 0).dropDuplicates(["row_key"])
    each = rows.select("row_key", F.explode("instances").alias("i")).select("row_key", "i.*")
    # value: 1 for a seed anywhere, else what its patterns make of it
    graph = each.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed"), F.count(F.lit(1)).alias("times"))
    # those with too few values can never qualify
    values = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_seeds)
    graph = written(graph.join(written(values.select("pattern"), "pii-candidates"), "pattern", "left_semi"), "pii-graph")

    def qualified(good):
        return good.where((F.col("confidence") >= least) & (F.col("seeds") >= least_seeds)).select("pattern", "confidence")

    def matter(graph, often):
        """The part of the graph that can still decide anything, by scores that are not below the final ones."""
        good, scores = turns(graph, often, least)
        lifted = scores.where((F.col("seed") == 0) & (F.col("score") >= least)).select("value")
        near = graph.join(lifted, "value", "left_semi").select("pattern").join(good.where("confidence > 0"), "pattern", "left_semi")
        left = written(qualified(good).select("pattern").union(near).distinct(), "pii-patterns")
        return left, written(graph.join(left, "pattern", "left_semi"), "pii-graph")

    left, graph = matter(graph, graph.groupBy("pattern").agg(F.sum("times").alias("occurrences")))
    if not left.isEmpty():
        some = bounded_sample(docs.select("doc_id", "text"), SAMPLE_ROWS, "doc_id", "text")
        left, graph = matter(graph, written(occurrences(some, left), "pii-sampled"))
    at_places = written(behind(docs, left), "pii-places")
    if left.isEmpty():
        return left.withColumn("confidence", F.lit(1.0)), at_places
    good, _ = turns(graph, written(total(at_places), "pii-occurrences"), least)
    return qualified(good), at_places


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans (base and context), n_context."""
    scanned = written(scan(docs), "pii-scan")
    patterns, at_places = confident_patterns(docs, scanned)
    tokens = at_places.join(patterns, "pattern", "left_semi").select("row_key", F.explode("found").alias("span"))
    instances_ = (
        scanned.where(F.size("instances") > 0).dropDuplicates(["row_key"])
        .select("row_key", F.explode("instances").alias("i")).select("row_key", "i.*").where("NOT seed")
        .join(patterns, "pattern", "left_semi")
        .select("row_key", F.concat_ws(":", F.lit("context"), "start", "end").alias("span"))
    )
    found = tokens.union(instances_).groupBy("row_key").agg(F.collect_set("span").alias("found"))
    rank = F.create_map(*[F.lit(x) for item in KINDS.items() for x in item])
    parts = F.filter(F.concat(F.split("base_spans", ","), "found"), lambda x: x != "")
    ranked = F.transform(parts, lambda x: F.struct(F.split(x, ":")[1].cast("long"), F.element_at(rank, F.split(x, ":")[0]), x.alias("span")))
    both = F.array_join(F.transform(F.array_sort(ranked), lambda x: x["span"]), ",")
    return scanned.join(found, "row_key", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("found").isNull(), F.col("base_spans")).otherwise(both).alias("spans"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_context"),
    )
