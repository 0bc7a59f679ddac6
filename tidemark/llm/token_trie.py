"""Token counts under a unigram model, shared over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Trie nodes of one task, at most; a full trie is emptied and grown anew.
MAX_NODES = 2_000_000
#: Pre-tokens of more bytes are scored in a short ring of states instead of nodes.
MAX_WORD = 4_096
_PRE_TOKEN = re.compile(rb" ?[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+(?= [^\x09-\x0D\x20])|[\x09-\x0D\x20]+")


def read_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a public vocabulary of ranks, with unigram scores.

    The file orders pieces by rank and gives no probabilities; a piece of rank
    r gets the Zipf score -ln(r + 1). Any such table of scores may be given
    instead.
    """
    with open(path, "rb") as lines:
        ranks = (line.split() for line in lines if line.strip())
        return {base64.b64decode(piece): -math.log(int(rank) + 1) for piece, rank in ranks}


class TokenTrie:
    """A trie over the bytes of pre-tokens with the forward scores of a unigram model.

    A node stands for a prefix; it holds the best score of any segmentation of
    that prefix, its number of tokens and, where a pre-token ends, that count
    is its terminal count. A prefix that several pre-tokens share is scored
    once. Each byte without a piece is one token of ``unknown`` score.
    """

    def __init__(self, pieces: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.max_nodes = max_nodes
        self._empty()

    def _empty(self) -> None:
        # Edges by node and byte in one table, scores and counts in flat arrays.
        self.edges: dict[int, int] = {}
        self.score = array("d", [0.0])
        self.count = array("i", [0])

    def counts(self, pre_tokens: Iterable[bytes]) -> dict[bytes, int]:
        """Terminal counts of distinct pre-tokens."""
        return {p: self._insert(p) for p in pre_tokens}

    def _walk(self, word: bytes) -> int:
        """The count of one long pre-token; only the scores that a piece can reach back to are held."""
        pieces, longest, unknown = self.pieces, self.longest, self.unknown
        ring = longest + 1
        score, count = array("d", [0.0]) * ring, array("q", [0]) * ring
        for end in range(1, len(word) + 1):
            best, tokens = -math.inf, 0
            for begin in range(end - 1, max(-1, end - 1 - longest), -1):
                piece = pieces.get(word[begin:end], unknown if begin == end - 1 else None)
                if piece is not None:
                    total, n = score[begin % ring] + piece, count[begin % ring] + 1
                    if total > best or total == best and n < tokens:
                        best, tokens = total, n
            score[end % ring], count[end % ring] = best, tokens
        return count[len(word) % ring]

    def _insert(self, word: bytes) -> int:
        if len(word) > MAX_WORD:
            return self._walk(word)
        if len(self.score) + len(word) > self.max_nodes and len(self.score) > 1:
            self._empty()
        edges, score, count = self.edges, self.score, self.count
        pieces, longest, unknown = self.pieces, self.longest, self.unknown
        node, path = 0, [0]
        for end in range(1, len(word) + 1):
            edge = node << 8 | word[end - 1]
            child = edges.get(edge)
            if child is None:
                best, tokens = -math.inf, 0
                for begin in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = pieces.get(word[begin:end])
                    if piece is None:
                        if begin != end - 1:
                            continue
                        piece = unknown
                    before = path[begin]
                    total = score[before] + piece
                    # Equal scores take fewer tokens, so that counts don't depend on the order.
                    if total > best or total == best and count[before] + 1 < tokens:
                        best, tokens = total, count[before] + 1
                child = len(score)
                edges[edge] = child
                score.append(best)
                count.append(tokens)
            node = child
            path.append(node)
        return count[node]


def pre_tokens(text: str | None) -> list[bytes]:
    """Words with one space before them, if there is one, and the runs of white space between; joined they are the text."""
    return _PRE_TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []


def count_tokens(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    text: str = "text",
    name: str = "tokens",
    pieces: dict[bytes, float] | None = None,
    max_nodes: int = MAX_NODES,
) -> DataFrame:
    """Add the struct ``name``: ``n_pre_tokens, n_tokens`` of the whole text.

    Each task inserts the distinct pre-tokens of its batches in one trie; the
    counts of a document are the sum over its pre-tokens. Nothing shuffles, the
    trie's size is bounded, and its state never changes a count: of equally
    scored segmentations the one of fewer tokens counts. Null and empty texts
    have no tokens, white space is counted; very long pre-tokens are segmented
    whole, in a bounded state. Repeated rows have the same counts, an empty
    table gives no rows. An input column called ``name``, in any case of
    letters, is replaced.

    The driver reads the vocabulary, a file of fixed size, and broadcasts it.
    """
    documents = documents.drop(name)
    table = documents.sparkSession.sparkContext.broadcast(pieces if pieces is not None else read_pieces(vocabulary))
    kind = T.StructType([T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(table.value, max_nodes)
        for batch in batches:
            rows = [pre_tokens(t) for t in batch.column(text).to_pylist()]
            known = trie.counts({w for row in rows for w in row})
            out = [{"n_pre_tokens": len(row), "n_tokens": sum(map(known.__getitem__, row))} for row in rows]
            struct = pa.struct([("n_pre_tokens", pa.int64()), ("n_tokens", pa.int64())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, struct)], [*batch.schema.names, name])

    return documents.mapInArrow(count, T.StructType([*documents.schema.fields, T.StructField(name, kind)]))


def op5_query(documents: DataFrame) -> DataFrame:
    return count_tokens(documents.select("doc_id", "text")).select("doc_id", "tokens.n_pre_tokens", "tokens.n_tokens")
