"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut before each run of spaces into pre-tokens (no vocabulary piece holds a space after
another character, so the best segmentation of a text is that of its pre-tokens). Distinct pre-tokens
that are not known yet are inserted in a trie; one walk over it computes at each node, and so once per shared
prefix, the best unigram score of the prefix and the number of pieces on that path, and stores the counts
of the terminals. Every node carries the places from which a piece may still go on, each with its node in the trie
of the vocabulary, so a piece is followed character by character and left where the vocabulary ends. Texts
then sum the counts of their pre-tokens. Everything happens where the texts are: no shuffle, and the
store of counts, which a worker keeps between tasks, is bounded (``CACHE_WORDS``) and refilled when full.

Semantics: the vocabulary file gives pieces in order of rank, not probabilities, and nothing is trained here; so
probabilities follow the ranks by Zipf and Mandelbrot's law, log p = -log(rank + ZIPF_SHIFT) less the
logarithm of their sum. A space counts as U+2581 and a text gets one in front; a character that no piece
covers costs the lowest score less 10 and counts as its UTF-8 bytes; of equal scores the path with the longer
last piece wins.

Cases: null and empty texts have 0 tokens; texts and pre-tokens are taken whole, however long; repeated rows are
counted alike; empty tables give empty results; ``token_counts`` returns the columns named in ``keep``, of which
one named n_tokens or n_pretokens is replaced, and drops others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, slices, span_hash, table, text_bytes

VOCABULARY = "piece_bpe_32k.model"
CACHE_WORDS = 1_000_000
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
END = ""


def insert(root: dict, word: str, value) -> None:
    """Store ``value`` at ``word``'s terminal of a trie of nested dicts."""
    node = root
    for c in word:
        below = node.get(c)
        if below is None:
            below = node[c] = {}
        node = below
    node[END] = value


class Unigram:
    """Trie of the vocabulary's pieces with their log-probabilities, and the shared-prefix program over pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        # highest score first; pieces of one score keep the file's order
        plain.sort(key=lambda i: (-model.get_score(i), i))
        weight = 1.0 / (np.arange(len(plain)) + 1 + ZIPF_SHIFT)
        logs = np.log(weight / weight.sum())
        self.scores = {model.id_to_piece(i): float(x) for i, x in zip(plain, logs)}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.pieces: dict = {}
        for piece, score in self.scores.items():
            insert(self.pieces, piece, score)

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each of the distinct ``words``."""
        out = np.zeros(len(words), np.int64)
        trie: dict = {}
        for n, word in enumerate(words):
            insert(trie, word, n)
        start, unknown = self.pieces, self.unknown
        # by depth, along the path from the root: best score, its pieces, and (place, vocabulary node) still followed
        best, number, follows = [0.0], [0], [[]]
        todo = [(0, END, trie)]
        while todo:
            depth, c, node = todo.pop()
            if depth:
                del best[depth:], number[depth:], follows[depth:]
                top, of, on = -1e300, 0, []
                for k, at in follows[depth - 1]:
                    at = at.get(c)
                    if at is not None:
                        on.append((k, at))
                        s = at.get(END)
                        if s is not None and best[k] + s > top:
                            top, of = best[k] + s, number[k] + 1
                at = start.get(c)
                s = None
                if at is not None:
                    on.append((depth - 1, at))
                    s = at.get(END)
                if s is not None:
                    if best[depth - 1] + s > top:
                        top, of = best[depth - 1] + s, number[depth - 1] + 1
                elif best[depth - 1] + unknown > top:
                    top, of = best[depth - 1] + unknown, number[depth - 1] + len(c.encode())
                best.append(top)
                number.append(of)
                follows.append(on)
            for x, below in node.items():
                if x is END:
                    out[below] = number[depth]
                else:
                    todo.append((depth + 1, x, below))
        return out


class Counter:
    """Counts of texts, with the counts of pre-tokens seen before kept by hash."""

    def __init__(self, path: str):
        self.model = Unigram(path)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) per text of a slice."""
        buf, off = text_bytes(column)
        n = len(off) - 1
        if not len(buf):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        mark = SPACE_MARK.encode()
        if mark in buf.tobytes():
            return self.count(pa.array([x.as_py().replace(SPACE_MARK, " ") if x.is_valid else "" for x in column], pa.large_string()))
        some = off[:-1][np.diff(off) > 0]
        buf = np.insert(buf, some, 32)
        off = off + np.searchsorted(some, off, "left")
        space = buf == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(buf))
        row = np.searchsorted(off, start, "right") - 1
        if len(self.keys) > CACHE_WORDS:
            self._reset()
        keys, first, back = np.unique(span_hash(BYTE_CODE[buf], start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if fresh.any():
            raw, at = buf.tobytes(), first[fresh]
            words = [raw[a:b].decode().replace(" ", SPACE_MARK) for a, b in zip(start[at].tolist(), end[at].tolist())]
            counts = self.model.counts(words).astype(np.int32)
            where = np.searchsorted(self.keys, keys[fresh])
            self.keys, self.known = np.insert(self.keys, where, keys[fresh]), np.insert(self.known, where, counts)
            place = np.searchsorted(self.keys, keys)
        tokens = np.bincount(row, self.known[place][back], n).astype(np.int64)
        return tokens, np.bincount(row, minlength=n).astype(np.int64)


#: of this worker, by vocabulary file
_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and n_pretokens of every whole text."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    own = [c for c in keep if c not in ("n_tokens", "n_pretokens")]
    base = docs.select(F.struct(*own).alias("row"), F.col(text).alias("text"))
    schema = base.select("row").withColumns({"n_tokens": F.lit(0).cast("long"), "n_pretokens": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, words = known.count(part.column("text"))
                yield pa.record_batch({"row": part.column("row"), "n_tokens": pa.array(tokens), "n_pretokens": pa.array(words)})

    return base.mapInArrow(run, schema).select("row.*", "n_tokens", "n_pretokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
