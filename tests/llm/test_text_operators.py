"""Operators on single texts against plain Python over the same rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_mixture, personal_data, quality_pairs, quality_rules, token_trie

SF = "/root/testdata/sf0.001"
EDGE = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "x" * 60_000), (900_005, "a b " * 20_000), (900_006, "one two"), (900_006, "one two"), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(EDGE, "doc_id long, text string"))


@pytest.fixture(scope="module")
def texts(docs):
    return [tuple(r) for r in docs.collect()]


def by_row(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(k, m.group())] for k, p in BASE.items()}


def test_personal_data(spark, docs, texts):
    rng = random.Random(7)
    pieces = ["a", "b.", "@", "@x.y", "%", "é", "\U0001f600", "1", "22", "255", "256", "1.2.3.4", "001.2.3.4", ".", "-", " ", "+", "(", ")", "\n",
              "+1 (556) 555-9070", "4315726095712222", "4111 1111 1111 1111", "00", "call 555-123-4567"]
    made = [(10**6 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(800)]
    rows = personal_data.op2_query(docs.union(spark.createDataFrame(made, docs.schema)))
    want = Counter()
    for i, text in [*texts, *made]:
        spans = base_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        want[(i, *[len(spans[k]) for k in BASE], hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert by_row(rows, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_added_spans_need_checksum_or_context(spark):
    rows = [(1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "pay to GB83 WEST 1234 5698 7654 32 now"), (3, "call 555-123-4567"), (4, "part 555-123-4567")]
    found = personal_data.op2_query(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.spans for r in found.collect()} == {1: "iban:7:34", 2: "", 3: "local_phone:5:17", 4: ""}


def test_account_numbers_end_at_their_country_length(spark):
    number, grouped = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = {
        f"{number} Please": [(0, 22)],
        f"{grouped} Thanks": [(0, 27)],
        f"IBAN {grouped} BIC COBADEFF": [(5, 32)],
        f"IBAN {number} 2024": [(5, 27)],
        f"{number} GB82WEST12345698765432 NO9386011117947 X": [(0, 22), (23, 45), (46, 61)],
        f"REF AB12 {number} PAID": [(9, 31)],
        f"FR12 {number} 7": [(5, 27)],
        f"é {number} é": [(2, 24)],
        f"{number}1 Please": [],
        "DE88370400440532013000 Please": [],
    }
    rows = personal_data.op2_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {i: ",".join(f"iban:{a}:{b}" for a, b in found) for i, found in enumerate(texts.values())}
    assert {r.doc_id: r.spans for r in rows.collect()} == want


def test_decontamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(
        spark.createDataFrame([(5000, "one two"), (5001, None), (5002, ""), (5003, "!!")], "item_id long, text string")
    )
    windows = {}
    for item, text in bench.collect():
        w = decontaminate.words_of(text)
        for i in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    want = Counter()
    for i, text in texts:
        w, hit, items = decontaminate.words_of(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want[(i, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(decontaminate.op6_query(docs, bench), *columns) == want
    assert sum(n for k, n in want.items() if k[-1]) > 3
    small = decontaminate.contamination(docs, bench, windows_per_table=50)
    assert by_row(small, "doc_id", "overlap.n_hit", "overlap.n_items") == by_row(decontaminate.op6_query(docs, bench), "doc_id", "n_hit", "n_items")
    none = decontaminate.op6_query(docs, bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(texts)


def test_words_keep_what_is_not_ascii():
    assert decontaminate.words_of("Ab-cD é中文1_x Ä") == ["ab", "cd", "é中文1", "x", "Ä"]


def statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.op7_query(docs, labels)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(rows, "doc_id", *columns) == Counter((i, *statistics(t)) for i, t in texts)
    assert rows.where("base_failed and kept").count() == 0
    judged = rows.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in judged}[1] > 0.98


def test_rules_find_a_conjunction(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "###" * bad for w in words)))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.learn_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(rules.rules) == 1
    kept = {r.doc_id for r in quality_rules.judge_quality(docs, rules).where("quality.kept").collect()}
    assert kept == {i for i, y in labels if y}


def test_rules_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn_rules(docs, none).rules == []
    assert quality_rules.op7_query(docs.limit(0), none).count() == 0


def test_quality_ranking(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_pairs.op1_query(docs, labels)
    assert rows.count() == docs.count() and rows.where("score is null or score < 0 or score > 1").count() == 0
    held = rows.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.9 * held.count()
    none = quality_pairs.op1_query(docs, labels.limit(0))
    assert none.count() == docs.count()


def test_pairs_recover_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality_pairs.N_FEATURES))
    y = (x[:, 0] - 2 * x[:, 3] + 0.1 * rng.normal(size=400) > -1).astype(int)
    ranking = quality_pairs.fit_ranking(x, y)
    assert ((ranking.score(x) >= 0.5) == y).mean() > 0.95
    assert abs((ranking.score(x) < 0.5).mean() - (y == 0).mean()) < 0.01


def test_language(spark, docs):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_mixture.op3_query(full).join(full.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang_pred = lang").count() >= 0.98 * rows.count()
    model = language_mixture.learn_mixture(full, F.lit(True), per_language=200)
    named = {r.lang: r.text for r in full.where("length(text) > 3000").select("lang", "text").collect()}
    mixed = named["en"][:3000] + " " + named["fr"][:2000]
    lang, share, parts = model.infer(mixed)
    assert lang == "en" and {x for x, _ in parts} == {"en", "fr"} and 0.45 < share < 0.75
    assert model.infer(None) == model.infer("12 !?") == ("und", 0.0, [])
    edge = language_mixture.identify_language(docs.where("doc_id is null or doc_id > 900000"), model)
    got = {r.doc_id: r.language.lang for r in edge.collect()}
    assert got[900_001] == got[900_002] == got[900_003] == "und" and got[None] != "und"
    assert language_mixture.op3_query(full.limit(0)).count() == 0


def brute_tokens(word, pieces, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end):
            score = pieces.get(word[begin:end], unknown if begin == end - 1 else None)
            if score is not None:
                options.append((best[begin][0] + score, -(best[begin][1] + 1)))
        total, minus = max(options)
        best.append((total, -minus))
    return best[-1][1]


def test_token_counts(spark, docs, texts):
    pieces = token_trie.read_pieces(token_trie.VOCABULARY)
    rows = token_trie.op5_query(docs.where("length(text) < 3000 or text is null"))
    trie, memo, want = token_trie.TokenTrie(pieces), {}, Counter()
    for i, text in texts:
        if text is None or len(text) < 3000:
            words = token_trie.pre_tokens(text)
            for w in set(words) - set(memo):
                memo[w] = brute_tokens(w, pieces, trie.unknown)
            want[(i, len(words), sum(memo[w] for w in words))] += 1
    assert by_row(rows, "doc_id", "n_pre_tokens", "n_tokens") == want
    words = list(memo)[:500]
    assert token_trie.TokenTrie(pieces, max_nodes=50).counts(words) == trie.counts(words) == {w: memo[w] for w in words}


def test_long_words_and_clashing_columns(spark, docs):
    odd = docs.withColumns({"tokens": F.lit(1), "language": F.lit("x"), "score": F.lit(1), "_marks": F.lit(2), "overlap": F.lit(3), "_stats": F.lit(4)})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    n = docs.count()
    assert token_trie.count_tokens(odd).count() == n
    assert decontaminate.contamination(odd, bench).count() == n
    assert personal_data.find_personal_data(odd).count() == n
    assert quality_rules.judge_quality(odd, quality_rules.RuleList([[("upper_per_char", ">", 0.5)]])).count() == n


def test_two_hundred_languages_are_all_learned(spark):
    rng = random.Random(2)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(40)] for k in range(200)}
    made = [(200 * i + k, lang, " ".join(rng.choice(words[lang]) for _ in range(60))) for i in range(4) for k, lang in enumerate(words)]
    docs = spark.createDataFrame(made, "doc_id long, lang string, text string")
    model = language_mixture.learn_mixture(docs.where("doc_id < 600"), F.lit(True))
    assert model.languages == sorted(words)
    read = language_mixture.identify_language(docs.where("doc_id >= 600"), model).select("lang", "language.lang").collect()
    assert sum(a == b for a, b in read) >= 0.95 * len(read)
    with pytest.raises(ValueError, match="more than 199 languages"):
        language_mixture.learn_mixture(docs, F.lit(True), most=199)
