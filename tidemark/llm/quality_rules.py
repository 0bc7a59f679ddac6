"""Quality rules: a decision list learned by sequential covering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, SPACE_CLASS, free_name, labelled_sample, let, one_text

SYMBOLS = "#*$%&|<>"
#: Labelled documents that the rules are learned from, at most.
SAMPLE = 20_000
#: Base rule: fewer words, or more than this percentage of repeated ones, fails.
LEAST_WORDS = 50
MOST_REPEATED = 50

Condition = tuple[str, str, float]

FEATURES = (
    "chars_per_word",
    "symbols_per_char",
    "dup_lines_per_line",
    "repeats_per_word",
    "distinct_per_word",
    "upper_per_char",
    "marks_per_char",
)


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are hashed with their place and sorted; equal neighbours mark both
    places, and each marked place covers three words.
    """
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("p")))

        def marked(run: Column) -> Column:
            pairs = F.arrays_zip(
                F.slice(run, F.lit(1), F.size(run) - 1).alias("a"),
                F.slice(run, F.lit(2), F.size(run) - 1).alias("b"),
            )
            same = F.filter(pairs, lambda x: x["a"]["h"] == x["b"]["h"])
            places = F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["a"]["p"], x["b"]["p"]))))
            return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, marked))

    return let(windows, covered)


def with_statistics(df: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Add the struct ``name`` of word and line statistics of a whole text (null: none)."""
    body = F.coalesce(F.col(text), F.lit(""))

    def count_of(chars: str, of: Column) -> Column:
        return (F.length(of) - F.length(F.translate(of, chars, ""))).cast("long")

    def measured(words: Column) -> Column:
        def joined(dense: Column) -> Column:
            def lined(lines: Column) -> Column:
                return F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.length(dense).cast("long").alias("word_chars"),
                    count_of(SYMBOLS, dense).alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    _repeated(words).cast("long").alias("n_repeat_words"),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                    count_of(ASCII_UPPER, dense).alias("n_upper"),
                    count_of("!?.,;:", dense).alias("n_marks"),
                )

            worded = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
            return let(worded, lined)

        return let(F.array_join(words, ""), joined)

    words = F.array_remove(F.split(body, f"{SPACE_CLASS}+"), "")
    return df.withColumn(name, let(words, measured))


def base_failed(stats: Column) -> Column:
    n, repeated = stats["n_words"], stats["n_repeat_words"]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def feature(stats: Column, name: str) -> Column:
    def ratio(a: str, b: str) -> Column:
        return F.round(stats[a] / F.greatest(stats[b], F.lit(1)), 6)

    return {
        "chars_per_word": ratio("word_chars", "n_words"),
        "symbols_per_char": ratio("n_symbols", "word_chars"),
        "dup_lines_per_line": ratio("n_dup_lines", "n_lines"),
        "repeats_per_word": ratio("n_repeat_words", "n_words"),
        "distinct_per_word": ratio("n_distinct", "n_words"),
        "upper_per_char": ratio("n_upper", "word_chars"),
        "marks_per_char": ratio("n_marks", "word_chars"),
    }[name]


class RuleList:
    """Ordered conjunctions; a document that one of them covers is rejected."""

    def __init__(self, rules: list[list[Condition]]):
        self.rules = rules

    def verdict(self, stats: Column) -> Column:
        """One ordered conditional expression: false where a rule fires, else true."""
        if not self.rules:
            return F.lit(True)
        chain = F
        for rule in self.rules:
            fires = F.lit(True)
            for name, side, cut in rule:
                value = feature(stats, name)
                fires = fires & ((value <= cut) if side == "<=" else (value > cut))
            chain = chain.when(fires, F.lit(False))
        return chain.otherwise(F.lit(True))

    def __repr__(self) -> str:
        return "; ".join(" and ".join(f"{n} {s} {c:g}" for n, s, c in rule) for rule in self.rules)


class Counted:
    """Labelled documents by combination of bins: columns of bins, weights, labels.

    On the driver there are no more rows than sampled documents.
    """

    def __init__(self, bins: np.ndarray, weight: np.ndarray, good: np.ndarray):
        self.bins, self.weight, self.good = bins, weight, good

    def covered(self, rule: list[tuple[int, str, int]]) -> np.ndarray:
        hit = np.ones(len(self.weight), dtype=bool)
        for column, side, cut in rule:
            hit &= (self.bins[:, column] <= cut) == (side == "<=")
        return hit

    def without(self, rule: list[tuple[int, str, int]]) -> Counted:
        rest = ~self.covered(rule)
        return Counted(self.bins[rest], self.weight[rest], self.good[rest])

    def counts(self, rule: list[tuple[int, str, int]]) -> tuple[int, int]:
        """Weights of bad and of good documents that the rule covers."""
        hit = self.covered(rule)
        return int(self.weight[hit & ~self.good].sum()), int(self.weight[hit & self.good].sum())

    def worth(self, rule: list[tuple[int, str, int]]) -> float:
        bad, good = self.counts(rule)
        return (bad - good) / (bad + good) if bad + good else -1.0

    def grown(self, n_cuts: list[int], most: int) -> list[tuple[int, str, int]]:
        """Conditions of largest information gain, added until no good document is covered.

        Of equal gains the first feature, lowest cut and side ``<=`` is taken.
        """
        rule: list[tuple[int, str, int]] = []
        while len(rule) < most:
            hit = self.covered(rule)
            bad, good = self.counts(rule)
            if not bad or not good:
                break
            best, gain = None, 1e-9
            for column, n in enumerate(n_cuts):
                # Weights at or below each cut are sums over bins.
                upto = [
                    np.cumsum(np.bincount(self.bins[keep, column], self.weight[keep], n + 1))[:n] for keep in (hit & ~self.good, hit & self.good)
                ]
                for cut in range(n):
                    for side, p, q in (("<=", upto[0][cut], upto[1][cut]), (">", bad - upto[0][cut], good - upto[1][cut])):
                        if p:
                            won = p * (np.log2(p / (p + q)) - np.log2(bad / (bad + good)))
                            if won > gain:
                                best, gain = (column, side, cut), won
            if best is None:
                break
            rule.append(best)
        return rule


def midpoints(values: list[float]) -> list[float]:
    """Cuts halfway between neighbouring distinct values, so that each has a margin on both sides."""
    ordered = sorted(set(values))
    return [round((a + b) / 2, 9) for a, b in zip(ordered, ordered[1:], strict=False)]


def learn_rules(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample: int = SAMPLE,
    bins: int = 24,
    most_rules: int = 8,
    most_conditions: int = 3,
    precision: float = 0.98,
    support: int = 5,
) -> RuleList:
    """Sequential covering of the documents labelled 0.

    At most ``sample`` labelled documents that pass the base rules are read, by
    a hash of their ids; two thirds of them grow the rules and one third prunes
    them. Spark computes their statistics, the quantiles that the cuts lie
    between and the counts per combination of bins; the driver sees only those
    counts, no more than ``sample`` of them. A rule that is not ``precision``
    right on the pruning part, or covers fewer than ``support`` bad documents
    there, is not used and ends the search. Null ids and labels teach nothing;
    of rows that repeat an id, the smallest label and text count, once. Without
    labels of both kinds there are no rules.
    """
    ids = labelled_sample(labels, label, sample, F.lit(True))
    known = one_text(documents, ids, ["doc_id"])
    # The base rules are applied to the stored statistics: as a filter on the join they
    # would be pushed below it and measure every document.
    stored = with_statistics(known).select(
        "label",
        base_failed(F.col("stats")).alias("failed"),
        (F.xxhash64("doc_id", F.lit(3)) % 3 == 0).alias("prune"),
        *[feature(F.col("stats"), n).alias(n) for n in FEATURES],
    ).persist()
    table = stored.where("not failed").drop("failed")
    try:
        marks = [k / bins for k in range(1, bins)]
        by_label = table.groupBy("label").agg(*[F.percentile_approx(n, marks).alias(n) for n in FEATURES]).collect()
        cuts = {n: midpoints([float(v) for row in by_label for v in row[n] or []]) for n in FEATURES}
        binned = [sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in FEATURES]
        counted = table.select("label", "prune", *binned).groupBy("label", "prune", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        stored.unpersist()

    def part(prune: bool) -> Counted:
        rows = [r for r in counted if r["prune"] == prune]
        bins = np.array([[r[n] for n in FEATURES] for r in rows], dtype=int).reshape(-1, len(FEATURES))
        return Counted(bins, np.array([r["n"] for r in rows], dtype=float), np.array([bool(r["label"]) for r in rows], dtype=bool))

    # Bin numbers stand for cuts here: bin b lies above cut b - 1 and not above cut b.
    growing, pruning = part(False), part(True)
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        rule = growing.grown([len(cuts[n]) for n in FEATURES], most_conditions)
        while len(rule) > 1:
            shorter = max(([c for c in rule if c != out] for out in rule), key=pruning.worth)
            if pruning.worth(shorter) < pruning.worth(rule):
                break
            rule = shorter
        bad, good = pruning.counts(rule)
        if not rule or bad < support or bad < precision * (bad + good):
            break
        rules.append([(FEATURES[i], side, cuts[FEATURES[i]][cut]) for i, side, cut in rule])
        growing, pruning = growing.without(rule), pruning.without(rule)
    return RuleList(rules)


def judge_quality(documents: DataFrame, rules: RuleList, name: str = "quality") -> DataFrame:
    """Add the struct ``name``: the statistics, ``base_failed`` and ``kept``.

    Null and empty texts have no words and so fail the base rules. Rows are
    judged one by one and whole: no shuffle, whatever rows repeat, texts tie or
    are long; an empty table gives no rows. An input column called ``name``, in
    any case of letters, is replaced.
    """
    stats = free_name(documents, "stats")
    judged = with_statistics(documents, name=stats)
    failed = base_failed(F.col(stats))
    verdict = F.struct(
        *[F.col(stats)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & rules.verdict(F.col(stats))).alias("kept"),
    )
    return judged.withColumn(name, verdict).drop(stats)


def op7_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn_rules(documents, labels)
    judged = judge_quality(documents.select("doc_id", "text"), rules)
    return judged.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )
