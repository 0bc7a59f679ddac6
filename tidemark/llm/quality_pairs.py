"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, one_text, remainder_of_crc32

#: Labelled documents that the ranking is learned from, at most.
SAMPLE = 20_000
#: Preference pairs drawn from them, at most.
PAIRS = 200_000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'",
    "shout": b"!",
    "symbol": b"#*$%&",
    "bar": b"|<>",
    "other": b"\"()+-/=@[\\]^_`{}~",
    "newline": b"\n",
}
_MEMBERS = np.zeros((len(_CLASSES) + 1, 256))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBERS[_i, list(_bytes)] = 1
_MEMBERS[-1, 128:] = 1

N_FEATURES = 2 * (len(_CLASSES) + 1) + 8


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares of byte classes, vocabulary, repetition, lengths."""
    data = (text or "").encode()
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    shares = _MEMBERS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size
    counts = Counter(words)
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    length = (size - shares[7] * size) / n
    return np.array(
        [
            *shares,
            *np.sqrt(shares),
            np.log1p(len(words)) / 5,
            len(counts) / n,
            np.log1p(len(counts)) / np.log1p(n),
            twins / n,
            max(counts.values(), default=0) / n,
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(length) / 2,
            float(len(words) < 5),
        ]
    )


@dataclass
class Ranking:
    """Document score ``weights @ (x - mean) / spread``; ``threshold`` splits good from bad."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance to win against a document that stands at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -40, 40)))


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 11) -> Ranking:
    """Logistic loss on feature differences of preference pairs, then a score quantile.

    Each pair prefers a document labelled 1 to one labelled 0; pairs are drawn
    with a seed, every document about equally often. The threshold is the
    quantile of the scores at the share of documents labelled 0, midway to the
    next score. With labels of one kind only, all scores lie on its side.
    """
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    spread = np.where(spread < 1e-9, 1.0, spread)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(len(mean))
    if not len(good) or not len(bad):
        return Ranking(mean, spread, weights, 1.0 if len(bad) else -1.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad), 8 * max(len(good), len(bad)))
    winners = good[rng.permutation(n) % len(good)]
    losers = bad[rng.permutation(n) % len(bad)]
    z = np.clip((x - mean) / spread, -6, 6)
    diff = z[winners] - z[losers]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -40, 40)))
        slope = diff.T @ (1 - p) - ridge * weights
        curve = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    ordered = np.sort(z @ weights)
    return Ranking(mean, spread, weights, float(ordered[len(bad) - 1 : len(bad) + 1].mean()))


def learn_ranking(documents: DataFrame, labels: DataFrame, label: str = "quality", where=None, sample: int = SAMPLE) -> Ranking:
    """Fit on at most ``sample`` labelled documents for which ``where`` holds.

    Their features are computed in tasks; the driver gets one short row of
    numbers for each id. The sample goes by a hash of the id, so reruns agree.
    Null ids and labels teach nothing; of rows that repeat an id, the smallest
    label and text count, once. Without labelled documents all scores are equal.
    """
    ids = labelled_sample(labels, label, sample, F.lit(True) if where is None else where)
    known = one_text(documents, ids, ["doc_id"])

    def measure(batches):
        for batch in batches:
            rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), batch.column("label").cast("int32"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    rows = known.mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").collect()
    return fit_ranking(np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["label"] for r in rows]))


def score_quality(documents: DataFrame, ranking: Ranking, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``, from 0 to 1, last; an input column of that name, in any case of letters, is replaced.

    Null and empty texts are scored as texts without words; equal texts score
    alike. One narrow pass: rows are read whole and one by one, so repeated
    rows, long texts and an empty table need no rule of their own.
    """
    others = documents.drop(name)

    def score(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(text).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranking.score(x))], [*batch.schema.names, name])

    return others.mapInArrow(score, T.StructType([*others.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = remainder_of_crc32("doc_id", 3) == 1
    ranking = learn_ranking(documents, labels, where=~held_out)
    return score_quality(documents.select("doc_id", "text"), ranking).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
