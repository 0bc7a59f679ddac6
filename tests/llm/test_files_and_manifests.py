"""Token files, fill-in-the-middle and Merkle manifests against plain Python over the same rows."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import fill_middle, merkle, token_files

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " \n\t ", "x" * 30_000, "Ab c\x1c\x1dd " * 5_000, "one two", "one two", "é é ́x ÅÅ I'll don't 42", "<|endoftext|> a<|startoftext|>b",
             "has <P> mark", "has <S>", "<M>", "<<S<P ends <", "\x85 a b\x0bc\x0cd", "ΣΑΣ İstanbul ﬁne 你好 世界", "\U0001f600\U0001f600 b"]
ODD = [(900_000 + i // 2 * 2, t, None if i % 3 else "en", None if i % 2 else "odd", i if i % 4 else None) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id Here", None, None, None)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # Extra columns with names that the operators use themselves; columns that differ by case alone are no valid Spark table.
    return own.union(spark.createDataFrame(ODD, SCHEMA)).withColumns({n: F.lit("own") for n in ("key", "run", "place", "leaf", "tree", "n", "form", "id", "grp", "content", "_digest", "_cuts")}).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").collect()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("top", [1, 2, 200, 70_000, 2**32 - 1])
def test_levels_give_back_every_id(top):
    rng = np.random.default_rng(top)
    ids = np.concatenate([rng.integers(0, top + 1, 5_000), (top * rng.random(140_000) ** 9).astype(np.int64), [0, top, 0]]).astype(np.uint32)
    segment = token_files.Segment(token_files.segment_bytes(3, 4, ["a", None, ""], [len(ids) - 5, 5, 0], ids) + b"\n")
    assert (segment.run, segment.seq, segment.keys(), segment.ends.tolist()) == (3, 4, ["a", None, ""], [len(ids) - 5, len(ids), len(ids)])
    assert (segment.tokens(0, len(ids)) == ids).all()
    places = rng.integers(0, len(ids), 3_000)
    assert (segment.tokens_at(places) == ids[places]).all()
    for a, b in [(0, 0), (5, 6), (63, 65), (65_535, 65_537), (len(ids) - 1, len(ids)), (len(ids), len(ids)), *np.sort(rng.integers(0, len(ids), (20, 2)), axis=1).tolist()]:
        assert (segment.tokens(a, b) == ids[a:b]).all()
    if top > 1:
        assert len(segment.levels) > 1 or top == 2


def test_no_ids_make_an_empty_segment():
    segment = token_files.Segment(token_files.segment_bytes(0, 0, [], [], np.zeros(0, np.uint32)))
    assert segment.n_tokens == 0 and segment.tokens(0, 0).tolist() == [] and segment.tokens_at(np.zeros(0, np.int64)).tolist() == []


def test_widths_cost_no_more_than_any_other_split():
    rng = np.random.default_rng(5)
    ids = (60 * rng.random(400) ** 3).astype(np.uint32)

    def bits(widths):
        total, rest = 0.0, ids
        for k, w in enumerate(widths):
            total += len(rest) * (w + (1.25 if k < len(widths) - 1 else 0))
            rest = (rest >> w)[(rest >> w) > 0]
        return total

    splits = lambda n: [[n]] + [[k, *s] for k in range(1, n) for s in splits(n - k)]
    assert bits(token_files.level_widths(ids)) == min(bits(s) for s in splits(int(ids.max()).bit_length()))


@pytest.fixture(scope="module")
def encoded(rows):
    """Rows in file order with their ids: null ids first."""
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    return [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op11_against_the_tokenizer(docs, encoded):
    got = token_files.op11_query(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(ids), crc(ids)) for k, ids in encoded)
    # Starts follow the order of ids; rows that repeat an id follow each other in any order.
    run = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in run] == [k for k, _ in encoded]
    assert [r.start for r in run] == np.cumsum([0, *[r.n_tokens for r in run[:-1]]]).tolist()


@pytest.mark.parametrize("by_words", [True, False])
def test_files_of_few_ids_read_back(spark, docs, encoded, tmp_path, by_words):
    path = str(tmp_path / uuid.uuid4().hex)
    token_files.write_token_files(docs, path, segment_tokens=5_000, by_words=by_words)
    read = token_files.with_starts(token_files.read_documents(spark, path)).collect()
    assert len({(r.run, r.seq) for r in read}) > 8
    assert Counter((r.key, tuple(r.ids)) for r in read) == Counter((None if k is None else str(k), tuple(ids)) for k, ids in encoded)
    known = [(r.key, o, r.ids[o]) for r in read if r.key is not None for o in {0, r.n_tokens // 2, r.n_tokens - 1}]
    asked = [(k, o) for k, o, _ in known] * 2 + [("nowhere", 0), (None, 0), (known[0][0], -1), (known[0][0], 10**9)]
    got = rows_of(token_files.read_positions(spark, path, spark.createDataFrame(asked, "key string, offset int")))
    single = {k for k, n in Counter(r.key for r in read).items() if n == 1}
    assert {x: n for x, n in got.items() if x[0] in single} == {x: 1 for x in known if x[0] in single}


def test_files_of_an_empty_table(spark, docs, tmp_path):
    none = docs.where("false")
    assert token_files.op11_query(none).collect() == []
    token_files.write_token_files(none, str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).collect() == []


def test_memo_bound_changes_nothing(monkeypatch):
    texts = ["a b c a b", "b" * 100 + " a", "c a d e f g a"]
    want = [token_files.WordIds(Tokenizer.from_file(token_files.VOCABULARY)).of(t) for t in texts]
    monkeypatch.setattr(token_files, "MEMO_WORDS", 2)
    few = token_files.WordIds(Tokenizer.from_file(token_files.VOCABULARY))
    assert [few.of(t) for t in texts] == want and len(few) <= 2
    assert token_files.WordIds(Tokenizer.from_file(token_files.VOCABULARY)).of(" \n") == b""


def test_segments_follow_each_other():
    ids = np.arange(9, dtype=np.uint32)
    data = b"".join(token_files.segment_bytes(0, seq, ["a"], [n], ids[:n]) + b"\n" for seq, n in enumerate((0, 9, 4)))
    assert [(s.seq, s.tokens(0, s.n_tokens).tolist()) for s in token_files.segments_in(data)] == [(0, []), (1, list(range(9))), (2, list(range(4)))]


def filled(doc_id, text):
    """n, form, lengths, output and text put together again, from the definition."""
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_against_lists_of_units(docs, rows):
    # Each odd text under many ids, so that each takes every form that it can.
    many = docs.sparkSession.createDataFrame([(i, t) for i in range(60) for t in ODD_TEXTS], "doc_id long, text string")
    for table, known in ((docs, [(r.doc_id, r.text) for r in rows]), (many, [(i, t) for i in range(60) for t in ODD_TEXTS])):
        want = Counter()
        for k, t in known:
            *head, output = filled(k, t)
            want[(k, *head, sha(output), sha(t or ""))] += 1
        assert rows_of(fill_middle.op12_query(table)) == want
    outputs = fill_middle.fill_in_middle(many).select("doc_id", "text", "fim.*")
    assert {r.form for r in outputs.collect()} == {"plain", "spm", "psm"}
    assert outputs.where(~fill_middle.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def test_fill_in_middle_keeps_columns_and_empty_tables(docs):
    out = fill_middle.fill_in_middle(docs.withColumn("FIM", F.lit(1)), plain_percent=100, spm_percent=0)
    assert out.columns == [*docs.columns, "fim"] and {r.form for r in out.select("fim.form").collect()} <= {"plain", "psm"}
    assert fill_middle.op12_query(docs.where("false")).collect() == []


def test_restored_needs_its_marks(spark):
    broken = spark.createDataFrame([("<P>a<S>b", "psm"), ("a<S>b<M>c", "psm"), ("", "spm"), ("<P>a<S>b<M>c", "psm"), ("a", "plain")], "output string, form string")
    assert [r[0] for r in broken.select(fill_middle.restored(F.col("output"), F.col("form"))).collect()] == [None, None, None, "acb", "a"]


@pytest.mark.parametrize("unit, text", [(fill_middle.UNIT, " a b\n\nc "), (r"(?s).", "abc"), (r"[^\n]*\n|[^\n]+", "l1\nl2\n\nl4")])
def test_cut_points_are_those_of_lists(unit, text):
    units = [m.group() for m in re.finditer(unit, text)]
    for low in range(12):
        for high in range(12):
            a, b = sorted((low % (len(units) + 1), high % (len(units) + 1)))
            assert fill_middle.cut_points(text, low, high, re.compile(unit)) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(r, text):
    return sha("".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree_of(leaves, fan=16):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def proof_of(levels, i, fan=16):
    steps = []
    for level in levels[:-1]:
        run = level[i // fan * fan : i // fan * fan + fan]
        steps.append((run[: i % fan], run[i % fan + 1 :]))
        i //= fan
    return steps


def manifest(rows, fan=16):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fan) for s in sources]
    top = tree_of([t[-1][0] for t in trees], fan)
    out = Counter()
    for j, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = proof_of(trees[j], i, fan) + proof_of(top, j, fan)
            changed = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0 and r.text is not None
            folded = leaf_of(r, r.text.translate(lower)) if changed else leaf
            for before, after in steps:
                folded = sha("".join([*before, folded, *after]))
            root = top[-1][0]
            out[(r.doc_id, leaf, trees[j][-1][0], root, sha("".join("".join(b + a) for b, a in steps)), folded, folded == root)] += 1
    return out


def test_op13_against_trees_of_lists(docs, rows):
    assert rows_of(merkle.op13_query(docs)) == manifest(rows)


@pytest.mark.parametrize("sizes", [[1], [2], [17], [1, 1], [300, 1, 16, 257], [1] * 40 + [33]])
def test_trees_of_all_heights(spark, sizes, monkeypatch):
    made = [(1_000 * s + i, f"Text {i}", "xx", f"s{s}" if s else None, i) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(made)
    table = spark.createDataFrame(made, SCHEMA)
    want = manifest(table.collect())
    assert rows_of(merkle.op13_query(table)) == want
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 1)
    assert rows_of(merkle.op13_query(table)) == want


def test_paths_fold_to_the_root_and_name_changed_rows(spark):
    table = spark.createDataFrame([(i, f"Text {i}", "xx", f"s{i % 3}", i) for i in range(60)], SCHEMA)
    seen = [F.col(c) for c in merkle.FIELDS[:-1]] + [F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))]
    got = merkle.merkle_manifest(table, fan=3, shown=seen, with_paths=True).collect()
    for r in got:
        path = [(s.slot, list(s.siblings)) for s in r.path]
        assert merkle.fold(r.leaf, path) == r.root and merkle.proof_digest(path) == r.proof_sha256
        assert all(len(s) <= 2 for _, s in path)
    assert [r.id for r in got if not r.verified] == [7]
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3


def test_manifest_of_an_empty_table(docs):
    assert merkle.op13_query(docs.where("false")).collect() == []


def test_any_change_changes_the_root(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    root = lambda df: {r.root for r in merkle.merkle_manifest(df).select("root").distinct().collect()}
    first = root(table)
    assert len(first) == 1 and root(table.repartition(3, "n_chars")) == first
    for changed in (table.where("not doc_id <=> 3"), table.union(table.limit(1)), table.withColumn("lang", F.when(F.col("doc_id") == 3, "zz").otherwise(F.col("lang")))):
        assert root(changed) != first


def test_words_of_texts_are_encoded_once(monkeypatch):
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    texts = ["Don't, DON'T! ẖ. H̱, İ, İ, Of,. a's: \xc9!x ǅ, \xaa. xͅ, a,́ a'S;.", None, "", " \x0b\x0c", "Of of, OF.\x0bof! " * 9]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (1, 1 << 20):
        monkeypatch.setattr(token_files, "LOOK_BYTES", size)
        assert list(token_files.WordIds(tokenizer).of_texts(pa.array(texts))) == want
    known = token_files.WordIds(tokenizer)
    assert known.of(texts[4]) == want[4] and len(known) <= 4


def test_special_pieces_are_found_before_letters_are_made_small():
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    texts = ["A<|ENDOFTEXT|> <|EndOfText|>, <|endoftext|>. X<|endoftext|>Y*** Ab<|startoftext|>", "Da*** da&&& DA$$$, é%%% É### ß_` ﬁ.. don'T'' K' ά; я,", "Aͅ. a̸< b≮ ŉ' ǰ! ῗ? ª: º; ʰ, ⅷ. ⓐ!"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    known = token_files.WordIds(tokenizer)
    assert list(known.of_texts(pa.array(texts))) == want
    assert [token_files.WordIds(tokenizer).of(t) for t in texts] == want


def test_marks_behind_a_word_are_looked_up_on_their_own():
    known = token_files.WordIds(Tokenizer.from_file(token_files.VOCABULARY))
    list(known.of_texts(pa.array([" ".join(w + m for w in ("one", "Two", "dré") for m in ("", ".", "***", "&&&", "%%%", "$$$,"))])))
    assert set(known) == {"one", "two", "dré", ".", "***", "&&&", "%%%", "$$$,"}
