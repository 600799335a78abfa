"""Quality scores from document statistics through random Fourier features.

Every whole text gives a vector of statistics of its bytes, words and lines. Random cosine features
approximate a Gaussian kernel over the standardised statistics; the normal equations of a ridge regression are
summed per partition, and an isotonic curve turns the regression's value into a probability.

Defined results: a null text counts as the empty one, and the empty text gets a score like any other; rows
with a null doc_id or without a label are scored but teach nothing; repeated rows are scored one by one; an
empty table gives an empty result; without any label, or with one class only, every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.session import written

from .common import bounded_sample, held_out, texts, unused

#: At most about this many labelled rows are learned from, chosen by hash.
TRAINING_ROWS = 100_000
FEATURES = 256
#: Kernel width, in standard deviations times the square root of the number of statistics.
WIDTH = 1.0
RIDGE = 1.0
#: Partitions that sum the normal equations; each sends one matrix.
SUMMING_PARTITIONS = 16
CURVE_BINS = 200

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_sd", "distinct_words", "top_word",
    "distinct_lines", "line_words", "upper", "digit", "space", "beyond_ascii", "stops", "commas", "marks",
    "symbols", "bars", "brackets", "distinct_bytes", "byte_entropy", "upper_words", "short_words", "long_words",
    "bare_words", "sentence_words",
)


def statistics(text: str) -> list[float]:
    """The values named in STATISTICS of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    times = Counter(words)
    share = counts[counts > 0] / n

    def of(chars: str) -> float:
        return float(counts[np.frombuffer(chars.encode(), np.uint8)].sum()) / n

    stops = of(".?")
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        float(lengths.mean()), float(lengths.std()), len(times) / n_words,
        max(times.values(), default=0) / n_words,
        len(set(lines)) / n_lines, np.log1p(len(words) / n_lines),
        float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n, of(" \n\t\r"), float(counts[128:].sum()) / n,
        stops, of(",;:"), of("!"), of("#$%&*@^~+=<>_/\\"), of("|"), of("()[]{}\"'"),
        float((counts > 0).sum()) / 100, float(-(share * np.log(share)).sum()) if len(data) else 0.0,
        sum(map(str.isupper, words)) / n_words, float((lengths <= 3).mean()), float((lengths > 12).mean()),
        sum(map(str.isalpha, words)) / n_words, np.log1p(len(words) / (1 + stops * n)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the statistics of every whole text."""

    def measure(batches):
        for batch in batches:
            stats = [statistics(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "stats": stats})

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInPandas(measure, "doc_id long, text_hash long, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    features: int
    seed: int

    def phi(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features of rows of statistics, with a constant."""
        rng = np.random.default_rng(self.seed)
        omega = rng.standard_normal((stats.shape[1], self.features)) / (WIDTH * np.sqrt(stats.shape[1]))
        shift = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z @ omega + shift), np.ones((len(z), 1))])

    def margin(self, stats: np.ndarray) -> np.ndarray:
        return self.phi(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(stats), *self.curve)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x with mean y of n rows: places and rising values of the curve."""
    blocks: list[list[float]] = []
    for at, mean, weight in zip(x, y, n, strict=True):
        blocks.append([at * weight, mean * weight, weight])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    place, value, weight = np.array(blocks).T
    return place / weight, value / weight


def fit(labelled: DataFrame, bound: int = TRAINING_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> QualityModel:
    """Learns from rows doc_id, stats, label. One row in five is kept back for the curve."""
    rows = written(bounded_sample(labelled, bound, "doc_id"), "quality-rows").repartition(SUMMING_PARTITIONS, "doc_id")
    rows = written(rows.withColumn("for_curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(5)) == 0), "quality-parts")
    size = len(STATISTICS)
    moments = rows.agg(
        F.avg("label"), F.count_distinct("label"),
        *[f(F.col("stats")[i]) for i in range(size) for f in (F.avg, F.stddev_pop)],
    ).first()
    if moments[1] < 2:
        share = 0.5 if moments[0] is None else float(moments[0])
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(features + 1), (np.array([0.0]), np.array([share])), features, seed)
    scale = np.array(moments[3::2], float)
    model = QualityModel(np.array(moments[2::2], float), np.where(scale > 1e-9, scale, 1.0), np.zeros(features + 1), (np.zeros(1), np.zeros(1)), features, seed)

    def sums(batches):
        gram, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            phi = model.phi(_matrix(batch["stats"]))
            gram += phi.T @ phi
            right += phi.T @ batch["label"].to_numpy(float)
        yield pd.DataFrame({"gram": [gram.tobytes()], "side": [right.tobytes()]})

    # one matrix from each of SUMMING_PARTITIONS partitions, added in the order of their bytes
    parts = sorted((bytes(r[0]), bytes(r[1])) for r in rows.where("NOT for_curve").coalesce(SUMMING_PARTITIONS).mapInPandas(sums, "gram binary, side binary").collect())
    gram = sum(np.frombuffer(g).reshape(features + 1, -1) for g, _ in parts)
    right = sum(np.frombuffer(s) for _, s in parts)
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(gram + penalty, right)

    def margins(batches):
        for batch in batches:
            yield pd.DataFrame({"margin": model.margin(_matrix(batch["stats"])), "label": batch["label"]})

    scored = written(rows.where("for_curve").mapInPandas(margins, "margin double, label long"), "quality-margins")
    edges = scored.agg(F.percentile_approx("margin", [i / CURVE_BINS for i in range(1, CURVE_BINS)], 10_000)).first()[0] or []
    bin_ = F.size(F.filter(F.lit(sorted(set(edges))).cast("array<double>"), lambda e: e < F.col("margin")))
    bins = scored.groupBy(bin_.alias("bin")).agg(F.avg("margin"), F.avg(F.col("label").cast("double")), F.count(F.lit(1))).orderBy("bin").collect()
    if bins:
        model.curve = isotonic(*np.array([b[1:] for b in bins], float).T)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, taught, threshold: float = 0.3) -> DataFrame:
    """doc_id, text_hash, score, predicted for every document; `taught` is the condition on doc_id of rows to learn from."""
    measured = written(with_statistics(docs), "statistics")
    marks = labels.where(F.col("quality").isNotNull() & taught).groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    model = fit(measured.dropDuplicates(["doc_id"]).join(marks, "doc_id"))

    def score(batches):
        for batch in batches:
            scores = model.score(_matrix(batch["stats"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "score": np.clip(scores, 0, 1)})

    return measured.mapInPandas(score, "doc_id long, text_hash long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of a model that learned from documents whose crc32 of the id is not divisible by 5."""
    out = held_out(5, 0)
    return score_quality(docs, labels, ~out).select("doc_id", out.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they came.

    A document is judged by its own text, so of rows that share a doc_id, or have none, each goes or stays by what
    it holds; repeated rows fare alike. A null text counts as the empty one. Columns keep names and values.
    """
    of_id, of_text = unused(docs, "rejected_id", "rejected_text")
    judged = score_quality(docs, labels, ~held_out(5, 0)).where("predicted = 0")
    rejected = judged.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_text))
    return docs.join(rejected, same, "left_anti")
