"""Language identification by inference of each document's mixture of languages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import near_start, one_text, remainder_of_crc32

#: Documents of each language that its n-grams are counted in, at most.
SAMPLE_PER_LANGUAGE = 2_000
#: More languages would make a model of more than 128 MB in every worker; such a corpus is refused.
MAX_LANGUAGES = 512
BUCKETS = 1 << 16
ROUNDS = 12
#: Neighbouring trigrams share letters: so many count as one observation.
OVERLAP = 3.0


@cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash buckets and counts of the letter trigrams of a whole text, words padded by a gap.

    None if the text has no letter.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    padded = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint32)
    inner = padded != 0
    keep = inner | np.concatenate(([True], inner[:-1]))
    c = padded[keep]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(h >> np.uint32(16), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


@dataclass
class MixtureModel:
    """Log probabilities of n-gram buckets by language, as 32-bit numbers."""

    languages: list[str]
    log_p: np.ndarray

    def _fit(self, p: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Expectation-maximisation of the proportions; they and the log likelihood."""
        total, share = counts.sum(), start
        for _ in range(ROUNDS):
            share = share * (p @ (counts / (share @ p))) / total
        return share, float(counts @ np.log(share @ p))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Main language, its proportion, and all selected languages with proportions.

        The proportions of all languages order them; nested sets, the largest
        first ones, are then compared by likelihood less half the logarithm of
        the observations for each language.
        """
        grams = trigram_counts(text)
        if grams is None or not self.languages:
            return "und", 0.0, []
        found, counts = grams
        logs = self.log_p[:, found].astype(float)
        top = logs.max(0)
        p = np.exp(logs - top)
        n = len(self.languages)
        share, _ = self._fit(p, counts, np.full(n, 1 / n))
        order = np.argsort(-share, kind="stable")
        cost = 0.5 * np.log(max(counts.sum() / OVERLAP, 2.0))
        alone = [float(counts @ np.log(p[i])) / OVERLAP for i in order[: min(n, 3)]]
        first = order[int(np.argmax(alone))]
        best, chosen = max(alone) - cost, ([first], np.ones(1))
        for size in range(2, n + 1):
            members = order[:size]
            if share[members[-1]] < 0.01:
                break
            fitted, likelihood = self._fit(p[members], counts, share[members] / share[members].sum())
            if likelihood / OVERLAP - size * cost <= best:
                break
            best, chosen = likelihood / OVERLAP - size * cost, (list(members), fitted)
        mixture = sorted(((self.languages[i], float(s)) for i, s in zip(*chosen, strict=True)), key=lambda x: (-x[1], x[0]))
        return mixture[0][0], min(mixture[0][1], 1.0), mixture


def learn_mixture(
    documents: DataFrame, where: Column, per_language: int = SAMPLE_PER_LANGUAGE, smooth: float = 0.05, most: int = MAX_LANGUAGES
) -> MixtureModel:
    """Count trigrams in at most ``per_language`` documents of each language for which ``where`` holds.

    Rows with a null id, text or language teach nothing; a row counts once
    however often its id and language are repeated, with its smallest text. All
    languages are learned; more than ``most`` raise ValueError. The sample goes
    by a hash of the id. Tasks count by language and bucket; the driver gets
    one row for each of the two, so no more than ``most`` times ``BUCKETS``.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & where)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("_n"))
    known = counts.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} languages")
    sizes = documents.sparkSession.createDataFrame(known, counts.schema)
    # The part of a language's hashes that holds a fifth more than is wanted is ranked, so
    # that a frequent language doesn't meet in one task.
    near = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(near_start(F.col("doc_id"), F.col("_n"), per_language))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = near.groupBy("lang", "doc_id").agg(F.lit(1).alias("_one")).withColumn("_nth", nth).where(F.col("_nth") <= per_language)
    sample = one_text(rows, ids.select("doc_id", "lang"), ["doc_id", "lang"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams = trigram_counts(text)
                if grams is not None:
                    own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own[grams[0]] += grams[1].astype(np.int64)
        for lang, own in sums.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found.astype(np.int32)), pa.array(own[found])], ["lang", "bucket", "n"]
            )

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages: dict[str, np.ndarray] = {}
    for lang, bucket, n in counted.toLocalIterator():
        languages.setdefault(lang, np.zeros(BUCKETS, np.float32))[bucket] = n
    names = sorted(languages)
    log_p = np.zeros((len(names), BUCKETS), np.float32)
    for row, name in zip(log_p, names, strict=True):
        grams = languages.pop(name) + smooth
        row[:] = np.log(grams / grams.sum())
    return MixtureModel(names, log_p)


def identify_language(documents: DataFrame, model: MixtureModel, text: str = "text", name: str = "language") -> DataFrame:
    """Add the struct ``name``: ``lang, score, mixture`` (languages with proportions).

    ``und`` with score 0 for null texts and texts without a letter, or if no
    language was learned. Equal shares go by name. An input column called
    ``name``, in any case of letters, is replaced. Rows are read one by one and
    whole, so repeated rows, long texts and an empty table need no rule: no
    shuffle.
    """
    documents = documents.drop(name)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", mixture)])
    arrow = pa.struct(
        [("lang", pa.string()), ("score", pa.float64()), ("mixture", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
    )

    def infer(batches):
        model = shared.value
        for batch in batches:
            out = []
            for body in batch.column(text).to_pylist():
                lang, score, parts = model.infer(body)
                out.append({"lang": lang, "score": score, "mixture": [{"lang": x, "share": s} for x, s in parts]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    return documents.mapInArrow(infer, T.StructType([*documents.schema.fields, T.StructField(name, kind)]))


def op3_query(documents: DataFrame) -> DataFrame:
    held_out = remainder_of_crc32("doc_id", 4) == 2
    model = learn_mixture(documents.select("doc_id", "lang", "text"), ~held_out)
    rows = identify_language(documents.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.size("language.mixture").alias("n_languages"),
    )
