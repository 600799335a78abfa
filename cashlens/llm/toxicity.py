"""Toxicity by compression distance: windows of a text are compressed with a toxic and with an ordinary dictionary.

The ordinary dictionary is trained on windows of ordinary labelled text. The toxic one holds the same, led by
what marks toxic rows: short words, beginnings of longer ones, pairs of words, and pieces of text without blanks
that are far more frequent in toxic than in ordinary documents. So
the two differ in what marks toxicity alone, and a window's gap (ordinary less toxic length in bytes) is not
blurred by how well each happens to know ordinary words. Thresholds on gaps, counted over a document's
windows, are weighed by a logistic fit on the labelled rows.

Defined results: a null text counts as the empty one, and the empty text gets a score like any other; rows
with a null doc_id or without a label are scored but teach nothing; repeated rows are scored one by one; an
empty table gives an empty result; without any label, or with one class only, every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from .common import bounded_sample, held_out, texts

#: At most about this many labelled rows of each class are learned from, chosen by hash, and windows of them.
TRAINING_ROWS, TRAINING_WINDOWS = 6000, 8000
WINDOW_BYTES, SAMPLE_BYTES = 128, 256
DICTIONARY_BYTES, LEVEL = 12_288, 16
#: A marking beginning has this many characters; shorter words count whole, longer ones than UNSPACED by pieces of this size.
BEGINNING, UNSPACED, PIECE = (4, 10), 24, (3, 6)
#: A mark is in this many toxic rows and has this log odds ratio. Of at most MOST_CANDIDATES that do, the MOST_MARKS with the
#: highest odds are taken after those within others have been left out.
LEAST_ROWS, LEAST_ODDS, MOST_CANDIDATES, MOST_MARKS = 8, 4.5, 50_000, 2000
#: Gaps in bytes that are thresholds.
GAPS = (1, 2, 3, 4, 5, 6, 7)
RIDGE = 1.0


def windows(text: str, size: int) -> list[bytes]:
    """The whole lower-cased text in windows of about `size` bytes that end with a blank where one is near."""
    data, out, at = text.lower().encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = at + size
        blank = data.find(b" ", end, end + 64)
        end = blank + 1 if blank >= 0 else end
        out.append(data[at:end])
        at = end
    return out


def candidates(text: str) -> set[str]:
    """What may mark a text, blanks showing where words end: short words, beginnings of others, pairs, pieces."""
    low, high = BEGINNING
    words = text.lower().split()
    found = {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if len(a) <= UNSPACED and len(b) <= UNSPACED}
    for word in set(words):
        if len(word) < low:
            found.add(f" {word} ")
        else:
            found.update(" " + word[:n] for n in range(low, min(len(word), high) + 1))
        if len(word) > UNSPACED:
            for n in range(PIECE[0], PIECE[1] + 1):
                found.update(word[i : i + n] for i in range(len(word) - n + 1))
    return found


def marking(counts: dict[str, tuple[int, int]], n_toxic: int, n_ordinary: int) -> list[str]:
    """Candidates with high odds, rarest first.

    A pair goes if one of its words is marking by itself, a beginning or piece if a longer one nearly always
    stands for it. The bound comes after that, so that a mark takes one place.
    """
    odds = {
        g: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_ordinary + 1))
        for g, (a, b) in counts.items() if a >= LEAST_ROWS
    }
    high = {g for g, o in odds.items() if o > LEAST_ODDS}
    pairs = {g for g in high if " " in g[1:-1]}
    kept, covered = [], Counter()
    for g in sorted(high - pairs, key=lambda g: (-len(g), g)):
        if covered[g] < 0.8 * counts[g][0]:
            kept.append(g)
            # every shorter candidate within this one occurs wherever this one does
            for part in {g[i:j] for i in range(len(g)) for j in range(i + PIECE[0], len(g) + 1)} - {g}:
                covered[part] = max(covered[part], counts[g][0])
    alone = high - pairs
    kept += [g for g in pairs if not any(m in alone for m in candidates(g) - {g})]
    best = sorted(kept, key=lambda g: (-odds[g], -counts[g][0], g))[:MOST_MARKS]
    return sorted(best, key=lambda g: (counts[g][0], g))


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    share: float = 0.5

    def compressors(self):
        out = []
        for content in (self.ordinary, self.toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=2 * WINDOW_BYTES, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0
            )
            known.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.share)
        return 1 / (1 + np.exp(-np.clip(_design((features - self.mean) / self.scale) @ self.weights, -30, 30)))


def gap_features(text: str, ordinary, toxic) -> list[float]:
    """How many windows reach each threshold, as a number and as a share; windows; largest and mean gap."""
    gaps = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text, WINDOW_BYTES)] or [0])
    gaps = np.clip(gaps, 0, 8)
    reach = np.array([(gaps >= g).sum() for g in GAPS], float)
    return [*np.log1p(reach), *(reach / len(gaps)), math.log1p(len(gaps)), float(gaps.max()), float(gaps.mean())]


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, w = _design(x), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    return w


def dictionaries(rows: DataFrame) -> ToxicityModel:
    """The two dictionaries out of rows doc_id, text, label."""

    def count(batches):
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts[int(label)].update(candidates(text))
        # candidates that this partition saw in ordinary rows only still count against those of others
        found = sorted(counts[0].keys() | counts[1].keys())
        for low in range(0, len(found), 100_000):
            part = found[low : low + 100_000]
            out = {"mark": part, "toxic": [counts[1][g] for g in part], "ordinary": [counts[0][g] for g in part]}
            yield pd.DataFrame(out).astype({"mark": object})

    def cut(batches):
        for batch in batches:
            yield pd.DataFrame({"window": [w for t in batch["text"] for w in windows(t, SAMPLE_BYTES)]})

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = (
        rows.select("text", "label").mapInPandas(count, "mark string, toxic long, ordinary long")
        .groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        .where(F.col("toxic") >= LEAST_ROWS)
        .withColumn("odds", F.log(F.col("toxic") + 0.5) - F.log(F.col("ordinary") + 0.5))
        .orderBy(F.desc("odds"), F.desc("toxic"), "mark").limit(MOST_CANDIDATES).collect()
    )
    marks = marking({r["mark"]: (r["toxic"], r["ordinary"]) for r in found}, sizes.get(1, 0), sizes.get(0, 0))
    ordinary_windows = written(rows.where("label = 0").select("text").mapInPandas(cut, "window binary"), "toxic-windows")
    samples = sorted(bytes(r[0]) for r in bounded_sample(ordinary_windows, TRAINING_WINDOWS, "window").collect())
    try:
        ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: they are the dictionary
        ordinary = b"".join(samples)[:DICTIONARY_BYTES]
    lead = "\n".join(marks).encode("utf-8", "replace")
    return ToxicityModel(ordinary or b" ", lead + b"\n" + ordinary)


def score_toxicity(docs: DataFrame, labels: DataFrame, taught, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every document; `taught` is the condition on doc_id of rows to learn from."""
    marks = labels.where(F.col("toxic").isNotNull() & taught).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
    labelled = written(marks, "toxic-labels")
    chosen = [bounded_sample(labelled.where(F.col("label") == c), TRAINING_ROWS, "doc_id", seed=c) for c in (0, 1)]
    chosen = written(chosen[0].union(chosen[1]), "toxic-chosen")
    model = dictionaries(written(texts(docs).join(chosen, "doc_id"), "toxic-rows"))

    def measure(batches):
        pair = model.compressors()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "features": [gap_features(t, *pair) for t in batch["text"]]})

    measured = written(texts(docs).mapInPandas(measure, "doc_id long, features array<double>"), "toxic-features")
    # the fit sees both classes as often as the labels have them
    share = labelled.agg(F.avg("label"), F.sum("label"), F.sum(1 - F.col("label"))).first()
    rows = measured.join(chosen, "doc_id").select("doc_id", "features", "label").orderBy("doc_id").collect()
    x, y = np.array([r["features"] for r in rows], float), np.array([r["label"] for r in rows], float)
    model.share = 0.5 if share[0] is None else float(share[0])
    if 0 < y.sum() < len(y):
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        model.weights = _logistic((x - model.mean) / model.scale, y)
        model.weights[-1] += math.log(share[1] / share[2]) - math.log(y.sum() / (len(y) - y.sum()))

    def score(batches):
        for batch in batches:
            features = np.array(batch["features"].tolist(), float).reshape(len(batch), -1)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(features)})

    return measured.mapInPandas(score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of a model that learned from documents whose crc32 of the id, modulo 3, is not 1."""
    out = held_out(3, 1)
    return score_toxicity(docs, labels, ~out).select("doc_id", out.alias("held_out"), "score", "predicted")
