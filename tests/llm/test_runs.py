"""Periodic runs against a plain search of all periods and places."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from cashlens.llm import runs
from cashlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of every run: each period's maximal stretches, then those whose period is the smallest."""
    seen, n, out = {}, len(words), {}
    number = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[0], number[:-p] == number[p:], [0]]).astype(np.int8)
        for low, high in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            if high - low + p >= max(6, 4 * p):
                out.setdefault((low, high - low + p), p)
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(doc_id, text, rewritten=True):
    words = plain_words(text)
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewritten and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(found, key=lambda r: (r[0], r[2])))
    rest = " ".join(w for i, w in enumerate(words) if i not in drop)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)]
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *digest)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, key long, octave int, runs int")


def solved_here(words):
    """Tiles and fragments of one document, stitched in plain Python."""
    pieces = {}
    for tile in runs.tiles(runs.numbered([str(w).encode() for w in words])):
        for p, low, high in runs.fragments(*tile):
            pieces.setdefault(p, []).append((low, high))
    out = {}
    for p in sorted(pieces):
        low, high = None, None
        for a, b in [*sorted(pieces[p]), (1 << 60, 1 << 60)]:
            if low is not None and a <= high:
                high = max(high, b)
                continue
            if low is not None and high - low + p >= max(6, 4 * p):
                out.setdefault((low, high - low + p), p)
            low, high = a, b
    return sorted((s, length, p) for (s, length), p in out.items())


@pytest.mark.parametrize("tile_words", [2048, 16])
def test_tiles_find_every_run(monkeypatch, tile_words):
    monkeypatch.setattr(runs, "TILE_WORDS", tile_words)
    rng = random.Random(tile_words)
    for _ in range(400):
        words, letters = [], rng.choice([1, 2, 3, 30])
        while len(words) < rng.choice([5, 20, 60, 200, 700]):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
            words += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[: rng.randint(0, len(piece))]
        assert solved_here(words) == plain_runs(words)


@pytest.mark.parametrize("n", [6, 100, 5000])
def test_monotonous_texts_give_few_fragments(n):
    found = [x for tile in runs.tiles(np.zeros(n, np.int32)) for x in runs.fragments(*tile)]
    assert solved_here(["a"] * n) == [(0, n, 1)] and len(found) <= 1 + n // runs.TILE_WORDS


def test_long_periods_span_tiles():
    rng = random.Random(3)
    for period, times in ((700, 4), (1023, 5.3), (1024, 4), (1025, 9.9), (3000, 4.001)):
        piece = [rng.random() for _ in range(period)]
        words = [rng.random() for _ in range(rng.randint(0, 3000))] + [piece[i % period] for i in range(int(period * times))] + [0.5] * 3
        assert solved_here(words) == plain_runs(words)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [plain_row(*r) for r in rows]
    got = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_runs > 0 for r in got) > 10 and sum(r.n_runs == 0 for r in got) > 10


def test_odd_rows(spark):
    rng = random.Random(8)
    long = [str(rng.randrange(5000)) for _ in range(30_000)]
    long = long + ["x", "y", "z"] * 2000 + long[:300] + long[:5000] * 5
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "a a a a a"), (6, "a a a a a a"), (7, "a b a b a b a"), (8, "a b a b a b a b"),
        (None, "q w q w q w q w q"), (9, "same same same same same same"), (9, "same same same same same same"), (11, "é é é é " * 7),
        (12, "x" * 150_000), (13, " ".join(long)), (14, "w " * 50_000), (39, None), (40, "only"),
    ]
    got = runs.contract(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    whole = {r.doc_id: r for r in runs.periodic_runs(frame(spark, rows)).collect()}
    assert whole[6].collapsed == "a" and whole[7].collapsed is None and whole[8].collapsed == "a b" and whole[2].runs == []
    assert [tuple(r) for r in whole[8].runs] == [(0, 2, 8)] and whole[14].collapsed == "w" and whole[13].n_words == len(long)
    assert runs.contract(frame(spark, rows).limit(0)).count() == 0


def test_some_document_is_rewritten():
    changed = [i for i in range(200) if runs.planted(i, [b"%d" % k for k in range(50)]) != [b"%d" % k for k in range(50)]]
    assert changed and all(crc32(str(i).encode()) % 10 == 0 for i in changed) and runs.planted(None, [b"a"]) == [b"a"]
