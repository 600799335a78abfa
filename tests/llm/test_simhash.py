"""SimHash classes against plain versions."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashlens.llm import simhash
from cashlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_print(spark, texts_, width):
    """Fingerprints by Spark's own XXH64 and bit counts in plain integers."""
    shingles, owner = [], []
    for i, text in enumerate(texts_):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            shingles.append(" ".join(words[k : k + width]))
            owner.append(i)
    counts, n = collections.defaultdict(lambda: [0] * 64), collections.Counter(owner)
    if shingles:
        rows = spark.createDataFrame(list(enumerate(shingles)), "k long, s string").select("k", F.xxhash64("s").alias("h")).collect()
        for r in rows:
            for bit in range(64):
                counts[owner[r.k]][bit] += (r.h >> bit) & 1
    return [sum(1 << b for b in range(64) if 2 * counts[i][b] > n[i]) if i in n else 0 for i in range(len(texts_))]


def plain_classes(prints, most=4):
    """Component of each print by brute force; prints: id -> fingerprint."""
    ids, parent = sorted(prints), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, node int, doc int, component int")


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in rows], plain_print(spark, [t for _, t in rows], 4), strict=True))
    classes = plain_classes(want)
    got = {r.doc_id: r for r in QUERIES["op12_simhash_duplicates"](spark, SF).collect()}
    assert len(got) == len(rows)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in want.items()}
    assert {i: r.component_id for i, r in got.items()} == classes
    assert len(set(classes.values())) < len(classes)


def clusters(seed, n=900):
    """Fingerprints around a few centres, so that chains of links and crowded groups occur."""
    rng = random.Random(seed)
    centres, out = [rng.getrandbits(64) for _ in range(12)], set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 8])):
            x ^= 1 << bit
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize(("group_rows", "most"), [(4096, 4), (20, 4), (50, 2), (4096, 0)])
def test_no_link_is_lost(spark, monkeypatch, group_rows, most):
    prints = {i: x for i, x in enumerate(clusters(group_rows + most))}
    table = spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: table)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, most=most, group_rows=group_rows).collect()}
    assert got == plain_classes({i: x % (1 << 64) for i, x in prints.items()}, most)


def test_links_are_reduced_to_stars(monkeypatch):
    monkeypatch.setattr(simhash, "MOST_LINKS", 10)
    node = np.array([1 << i for i in range(60)])
    distances = np.array([[int(int(x) ^ int(r)).bit_count() for r in simhash.REFERENCE_FINGERPRINTS] for x in node], np.int16)
    order = np.argsort(distances[:, 0], kind="stable")
    a, b = simhash.links_within(np.zeros(60), node[order], distances[order], 4)
    assert len(a) == 59 and set(b.tolist()) == {0}


def test_distances_discard_no_link():
    rng = np.random.default_rng(1)
    node = rng.integers(0, 1 << 63, 400)
    flipped = node ^ (1 << rng.integers(0, 60, 400)) ^ (1 << rng.integers(0, 60, 400))
    both = np.concatenate([node, flipped])
    distances = np.bitwise_count(both.view(np.uint64)[:, None] ^ simhash.REFERENCE_FINGERPRINTS).astype(np.int16)
    at = np.arange(400)
    assert len(simhash.near(at, at + 400, both, distances, 4)) == 400
    assert len(simhash.near(at, np.roll(at, 1), both, distances, 4)) == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [
        (5, None), (2, ""), (9, " \n\t"), (3, "one two"), (8, "ONE\ttwo"), (3, "one two"), (None, "one two"), (None, "nothing like it"),
        (4, long), (7, " " + long), (1, "x" * 150_000), (6, "tie tie tie tie tie"), (10, "tie tie tie tie"), (11, "É é"),
    ]
    got = simhash.near_duplicates(frame(spark, rows), words=4).collect()
    assert len(got) == len(rows)
    prints = plain_print(spark, [t for _, t in rows], 4)
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(((i, f"{x:016x}") for (i, _), x in zip(rows, prints)), key=str)
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert [by_id[i] for i in (5, 2, 9)] == [2, 2, 2] and by_id[8] == by_id[3] == 3 and by_id[7] == by_id[4] == 4 and by_id[10] == by_id[6]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
