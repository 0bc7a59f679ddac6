"""Token ids in binary files of directly addressable codes.

A file is a row of segments, each followed by one byte that says nothing. A
segment is a header, a directory of its documents, and the ids of these
documents one after the other. Ids are split into chunks of bits, level
by level: level 0 holds the lowest bits of every id, and a bitmap says which
ids go on; level 1 holds the next bits of those alone, and so on. Where an id
goes on at the next level is the number of set bits before it, which a rank
directory gives in constant time. So any id is read by one look into each
level that it reaches, and nothing before it is decoded.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import Lowercase

from .common import in_order, remove_table, shared_dir, stage_table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A segment is closed by the document that fills it up to so many ids.
SEGMENT_TOKENS = 1 << 20
#: A Python worker remembers the ids of twice so many words at most, of at most so many characters: some 180 MB.
MEMO_WORDS, MEMO_CHARS = 1 << 19, 64
#: Bytes of texts whose words are looked up together, and words encoded at once.
LOOK_BYTES, ENCODE_WORDS = 1 << 23, 10_000
#: Fixed values of the format: first bytes, bits of a word of the bitmaps, bits counted by one entry of the upper directory.
MAGIC, WORD, UPPER = b"TMDAC01\n", 64, 1 << 16
#: Bits of an id.
ID_BITS = 32


@dataclass
class Level:
    """Chunks of ``width`` bits, of which ``more`` go on at the next level."""

    width: int
    count: int
    chunks: np.ndarray
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u8"))
    upper: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u8"))
    lower: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u2"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of chunks before each place that go on."""
        word = at // WORD
        part = self.more[word] & ((np.uint64(1) << (at % WORD).astype(np.uint64)) - np.uint64(1))
        return (self.upper[at // UPPER] + self.lower[word] + np.bitwise_count(part)).astype(np.int64)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.more[at // WORD] >> (at % WORD).astype(np.uint64)) & np.uint64(1) > 0

    def at(self, at: np.ndarray) -> np.ndarray:
        """The chunks at some places."""
        bit = at * self.width
        seen = np.zeros(len(at), np.uint64)
        for k in range((self.width + 14) // 8):
            seen |= self.chunks[bit // 8 + k].astype(np.uint64) << np.uint64(8 * k)
        return ((seen >> (bit % 8).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def run(self, first: int, last: int) -> np.ndarray:
        """The chunks from ``first`` to before ``last``."""
        begin = first * self.width
        bits = np.unpackbits(self.chunks[begin // 8 : (last * self.width + 7) // 8], bitorder="little")
        return _joined_bits(bits[begin % 8 : begin % 8 + (last - first) * self.width].reshape(-1, self.width))

    def run_more(self, first: int, last: int) -> np.ndarray:
        words = self.more[first // WORD : (last + WORD - 1) // WORD]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return bits[first % WORD : first % WORD + last - first].astype(bool)


def _joined_bits(bits: np.ndarray) -> np.ndarray:
    """The numbers whose bits, lowest first, are the rows."""
    size = next(k for k in (1, 2, 4) if bits.shape[1] <= 8 * k)
    wide = np.zeros((len(bits), 8 * size), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, bitorder="little").view(f"<u{size}").astype(np.uint32)


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8], axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little")


def level_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels that take the fewest bits in all.

    ``reach[b]`` ids have more than b bits. A level of the bits from b to e
    holds reach[b] chunks of e - b bits, and a bit and a quarter for bitmap and
    directory where ids go on. The best split of the bits is found from the
    highest bit down.
    """
    bits = np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int) if len(ids) else np.zeros(0, int)
    reach = len(ids) - np.cumsum(np.bincount(bits, minlength=ID_BITS + 1))
    top = max(1, int(bits.max(initial=0)))
    reach = np.concatenate([[len(ids)], reach[1 : top + 1]])
    best: dict[int, tuple[float, list[int]]] = {top: (0.0, [])}
    for b in range(top - 1, -1, -1):
        best[b] = min((reach[b] * (e - b + (1.25 if e < top else 0)) + best[e][0], [e - b, *best[e][1]]) for e in range(b + 1, top + 1))
    return best[0][1]


def encode_levels(ids: np.ndarray) -> list[Level]:
    """Levels of directly addressable codes for unsigned ids of at most 32 bits."""
    levels, rest = [], ids.astype(np.uint32)
    widths = level_widths(rest)
    for k, width in enumerate(widths):
        level = Level(width, len(rest), _packed_bits(rest, width))
        if k < len(widths) - 1:
            above = rest >> np.uint32(width)
            on = above > 0
            padded = np.zeros((len(rest) // WORD + 1) * WORD, np.uint8)
            padded[: len(rest)] = on
            level.more = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(level.more))[:-1]]).astype(np.uint64)
            level.upper = before[:: UPPER // WORD].astype("<u8")
            level.lower = (before - np.repeat(level.upper, UPPER // WORD)[: len(before)]).astype("<u2")
            rest = above[on]
        levels.append(level)
    return levels


class Segment:
    """A segment read from the bytes of a file, from ``at`` on to before ``end``; arrays are views of these bytes."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self._data, self._at = data, at + len(MAGIC)
        self.run, self.seq, self.n_docs, self.n_tokens, n_levels = self._take("<u8", 5).tolist()
        self.ends = self._take("<u8", self.n_docs).astype(np.int64)
        key_ends, self._known = self._take("<u8", self.n_docs).tolist(), self._take("u1", self.n_docs)
        self._keys = self._take("u1", key_ends[-1] if key_ends else 0).tobytes()
        self._key_ends = [0, *key_ends]
        self.levels = []
        for _ in range(n_levels):
            width, count, *sizes = self._take("<u8", 6).tolist()
            self.levels.append(Level(width, count, *(self._take(kind, n) for kind, n in zip(("u1", "<u8", "<u8", "<u2"), sizes, strict=True))))
        self.end = self._at

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def keys(self) -> list[str | None]:
        """The ids of the documents as text."""
        cuts = zip(self._key_ends, self._key_ends[1:], self._known, strict=False)
        return [self._keys[a:b].decode() if known else None for a, b, known in cuts]

    def tokens_at(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places of the segment, each from its own chunks alone."""
        value, at, open_ = np.zeros(len(places), np.uint32), np.asarray(places, np.int64), np.arange(len(places))
        shift = 0
        for k, level in enumerate(self.levels):
            value[open_] |= level.at(at) << np.uint32(shift)
            shift += level.width
            if k < len(self.levels) - 1:
                on = level.goes_on(at)
                at, open_ = level.rank(at[on]), open_[on]
        return value.astype("<u4")

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` to before ``last``: one run of each level, found by two ranks."""
        value, open_, shift = np.zeros(last - first, np.uint32), np.arange(last - first), 0
        for k, level in enumerate(self.levels):
            if first == last:
                break
            value[open_] |= level.run(first, last) << np.uint32(shift)
            shift += level.width
            if k < len(self.levels) - 1:
                open_ = open_[level.run_more(first, last)]
                first, last = (int(x) for x in level.rank(np.array([first, last])))
        return value.astype("<u4")


def segment_bytes(run: int, seq: int, keys: list[str | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one segment: the ids of documents ``keys``, ``lengths`` ids each."""
    levels = encode_levels(ids)
    texts = [(k or "").encode() for k in keys]
    parts = [
        MAGIC,
        np.array([run, seq, len(keys), len(ids), len(levels)], "<u8"),
        np.cumsum(lengths).astype("<u8"),
        np.cumsum([len(t) for t in texts]).astype("<u8"),
        np.array([k is not None for k in keys], "u1"),
        b"".join(texts),
    ]
    for level in levels:
        # Reading a chunk may look a few bytes beyond its own.
        chunks = np.concatenate([level.chunks, np.zeros(8, np.uint8)])
        parts += [np.array([level.width, level.count, len(chunks), len(level.more), len(level.upper), len(level.lower)], "<u8"), chunks, level.more, level.upper, level.lower]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def segments_in(data: bytes) -> Iterator[Segment]:
    """The segments of a file, one after the other."""
    at = 0
    while at < len(data):
        yield (segment := Segment(data, at))
        at = segment.end + 1


def _picked(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` some places of ``flat``, which holds runs of ``sizes``, one after the other, and where each begins."""
    many = sizes[at]
    past = np.concatenate([[0], np.cumsum(many)])
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - past[:-1], many) + np.arange(past[-1])], past


class WordIds(dict):
    """Ids of a word as bytes. Words not seen while ``MEMO_WORDS`` others came are forgotten.

    The vocabulary drops white space and lets no piece reach over it, so a
    text's ids are those of its words, one after the other. Words end at
    ASCII white space only, which white space of any definition includes.
    Of printable ASCII the vocabulary's normaliser makes small letters and no
    more, so such words are spared its other steps.
    """

    _WORDS = re.compile(r"[^ \t\n\v\f\r]+")
    #: A word with marks behind its last letter. Small letters stay letters in the vocabulary's normal form.
    _MARKED, _MARKS = r"[A-Za-z\p{Ll}][[:punct:]]+$", string.punctuation
    #: What the vocabulary's special pieces begin with, which are found before capitals are made small.
    _SPECIAL = "<|"

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self._tokenizer, self._before = tokenizer, {}
        self._plain = Tokenizer.from_str(tokenizer.to_str())
        self._plain.normalizer = Lowercase()

    def __missing__(self, word: str) -> bytes:
        return self.of_words(pa.array([word]))[0].tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self._WORDS.findall(text)))

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Two arrays of words that have the ids of each word together: ASCII in small letters, and marks behind the last letter.

        The vocabulary makes small letters of all, and no piece holds a letter
        and a mark. Only after an apostrophe may a mark be followed by letters.
        """
        plain = pc.invert(pc.match_substring(words, self._SPECIAL))
        cut = pc.and_(plain, pc.match_substring_regex(words, self._MARKED))
        heads = pc.if_else(cut, pc.ascii_rtrim(words, self._MARKS), words)
        heads = pc.if_else(pc.and_(plain, pc.string_is_ascii(heads)), pc.ascii_lower(heads), heads)
        marked = words.filter(cut).to_pylist()
        marks = np.full(len(words), "", object)
        marks[cut.to_numpy(zero_copy_only=False)] = [w[n:] for w, n in zip(marked, pc.utf8_length(heads.filter(cut)).to_pylist(), strict=True)]
        return heads, pa.array(marks, pa.string())

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of some parts, each given once; those not known are encoded together."""
        found = list(map(self.get, parts))
        fresh = [k for k, ids in enumerate(found) if ids is None]
        new: tuple[list[int], list[int]] = ([], [])
        for k in fresh:
            found[k] = self._before.get(parts[k])
            if found[k] is None:
                new[parts[k].isascii() and parts[k].isprintable()].append(k)
        for tokenizer, some in zip((self._tokenizer, self._plain), new, strict=True):
            for at in range(0, len(some), ENCODE_WORDS):
                here = some[at : at + ENCODE_WORDS]
                for k, encoded in zip(here, tokenizer.encode_batch_fast([parts[k] for k in here], add_special_tokens=False), strict=True):
                    found[k] = array("I", encoded.ids).tobytes()
        for k in fresh:
            if 0 < len(parts[k]) <= MEMO_CHARS:
                if len(self) >= MEMO_WORDS:
                    self._before = dict(self)
                    self.clear()
                self[parts[k]] = found[k]
        return found

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words one after the other, and how many each has."""
        heads, marks = self._parts(words)
        parts = pa.concat_arrays([heads.cast(pa.string()), marks]).dictionary_encode()
        known = self._of_parts(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of = parts.indices.to_numpy().reshape(2, -1)
        flat, _ = _picked(np.frombuffer(b"".join(known), "<u4"), sizes, of.T.ravel())
        return flat, sizes[of].sum(0)

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a word is looked up once for ``LOOK_BYTES`` of texts, or for a longer text."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // LOOK_BYTES)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            split = pc.ascii_split_whitespace(texts.slice(first, last - first))
            words = split.flatten().dictionary_encode()
            # White space at an end of a text leaves an empty word there, which has no ids.
            ids, past = _picked(*self.of_words(words.dictionary), words.indices.to_numpy())
            bounds = past[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield ids[a:b].tobytes()


@cache
def _words_of(vocabulary: str) -> tuple[Tokenizer, WordIds]:
    """One for each Python worker, which outlives its tasks and has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(vocabulary)
    return tokenizer, WordIds(tokenizer)


def write_token_files(
    documents: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = 2,
    segment_tokens: int = SEGMENT_TOKENS,
    by_words: bool = True,
) -> None:
    """Write the ids of all texts to files below ``path``, in ascending ``doc_id`` order.

    Each text's ids are followed by ``end_id``. Documents are dealt out by
    ranges of ids in one shuffle and sorted; a task encodes its run document by
    document and closes a segment once it holds ``segment_tokens`` ids, so
    memory is that of one segment and the longest text. Segments carry their
    place: number of the task's run and of the segment in it. Spark's own
    writer commits a file for each task, so a lost executor leaves no half
    file; it is what adds a byte after each segment.

    Null texts are empty and have the end id alone. Null ids come first;
    rows that repeat an id all stay, in the order of a hash of their texts. An
    empty table writes no segment. Ids of any type that casts to text and back
    are kept. ``by_words`` is for vocabularies of which ``WordIds`` holds;
    others are given whole texts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, words), run, seq = _words_of(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        keys, lengths, parts, filled = [], [], [], 0

        def segment() -> pa.RecordBatch:
            data = segment_bytes(run, seq, keys, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

        for batch in batches:
            texts = batch.column("text")
            whole = (np.array(tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, "<u4").tobytes() for text in texts)
            for key, ids in zip(batch.column("key"), words.of_texts(texts) if by_words else whole, strict=True):
                keys.append(key.as_py())
                parts.append(ids + end)
                lengths.append(len(parts[-1]) // 4)
                filled += lengths[-1]
                if filled >= segment_tokens:
                    yield segment()
                    seq, keys, lengths, parts, filled = seq + 1, [], [], [], 0
        if keys:
            yield segment()

    rows = documents.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The text writer puts the bytes of a row into a file as they are.
    files = dealt.select("key", "text").mapInArrow(encode, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.mode("overwrite").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1").select("content")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True, with_crc32: bool = False) -> DataFrame:
    """Documents of the files: ``key, run, seq, k, first, n_tokens`` with ``ids`` (array) and ``ids_crc32`` where asked for.

    ``k`` is the document's place in its segment, ``first`` that of its ids there.
    ``ids_crc32`` is the unsigned checksum of the ids as little-endian unsigned
    integers of 32 bits. No files give no rows.
    """
    extra = ([("ids", pa.list_(pa.int64()))] if with_ids else []) + ([("ids_crc32", pa.int64())] if with_crc32 else [])
    names = ["key", "run", "seq", "k", "first", "n_tokens", *[n for n, _ in extra]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in (s for content in batch.column(0) for s in segments_in(content.as_py())):
                ends, firsts = segment.ends, np.concatenate([[0], segment.ends[:-1]])
                many = len(ends)
                columns = [
                    pa.array(segment.keys(), pa.string()),
                    pa.array([segment.run] * many, pa.int64()),
                    pa.array([segment.seq] * many, pa.int64()),
                    pa.array(range(many), pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array(ends - firsts, pa.int64()),
                ]
                # Every id is wanted here, so a segment is one run.
                whole = segment.tokens(0, segment.n_tokens) if extra else np.zeros(0, "<u4")
                read = [whole[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)] if extra else []
                for name, kind in extra:
                    columns.append(pa.array([zlib.crc32(r.tobytes()) if name == "ids_crc32" else r.astype(np.int64) for r in read], kind))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key string, run long, seq long, k long, first long, n_tokens long" + ", ids array<long>" * with_ids + ", ids_crc32 long" * with_crc32
    return _files(spark, path).mapInArrow(decode, schema)


def with_starts(read: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids in all segments and documents before, to rows of ``read_documents``.

    Only the segments' sums are ordered, one row each.
    """
    sums = stage_table(read.groupBy("run", "seq").agg(F.sum("n_tokens").alias("all_tokens")), "segments")
    placed = in_order(sums, [F.col("run"), F.col("seq")], sums={"all_tokens": "base"}, rows=sums.count())
    return read.join(placed.select("run", "seq", "base"), ["run", "seq"]).withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_positions(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids at ``wanted`` places: rows of ``key, offset`` (from 0 in the document), each once, with ``token``.

    Offsets that a document hasn't, and unknown or null keys, give no row; of
    a key that several rows hold, all. Places are sent to their segment, at
    most as many as it has ids, and each is read on its own: nothing before it is
    decoded.
    """
    places = (
        read_documents(spark, path, with_ids=False)
        .join(wanted.select("key", "offset").distinct(), "key")
        .where((F.col("offset") >= 0) & (F.col("offset") < F.col("n_tokens")))
        .select("run", "seq", "k", "key", "offset", (F.col("first") + F.col("offset")).alias("place"))
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in (c.as_py() for c in batch.column(0)):
                at = 0
                for segment in segments_in(content):
                    yield pa.RecordBatch.from_arrays([pa.array([segment.run]), pa.array([segment.seq]), pa.array([content[at : segment.end]])], ["run", "seq", "content"])
                    at = segment.end + 1

    def look(files: pa.Table, at: pa.Table) -> pa.Table:
        if not files.num_rows or not at.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "offset": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        token = Segment(files.column("content")[0].as_py()).tokens_at(at.column("place").to_numpy())
        return pa.table({"key": at.column("key"), "offset": at.column("offset").cast(pa.int64()), "token": pa.array(token, pa.int64())})

    numbered = _files(spark, path).mapInArrow(number, "run long, seq long, content binary")
    return numbered.groupBy("run", "seq").cogroup(places.groupBy("run", "seq")).applyInArrow(look, "key string, offset long, token long")


def op11_query(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents, path)
    read = stage_table(read_documents(spark, path, with_ids=False, with_crc32=True), "token_rows")
    remove_table(spark, path)
    doc_id: Column = F.col("key").cast(documents.schema["doc_id"].dataType)
    return with_starts(read).select(doc_id.alias("doc_id"), "start", "n_tokens", "ids_crc32")
