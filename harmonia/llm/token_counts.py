"""Token counts by a count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.tokens import tokenizer_path

PIECE_MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 2_000_000

# White space of the Unicode property White_Space.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")

Vocabulary = list[tuple[str, float]]


def rank_vocabulary(model: str) -> Vocabulary:
    """Pieces of a public vocabulary with Zipf scores: the log of one over the rank.

    Nothing is trained: a piece's place in the file is its rank.  Control and
    byte pieces are left out.
    """
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [
        held.id_to_piece(i) for i in range(held.get_piece_size())
        if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i) or held.is_unused(i))
    ]
    return [(piece, -math.log(rank + 1)) for rank, piece in enumerate(plain, 1)]


class UnigramCounter:
    """How many pieces the best segmentation of a word has.

    The rules are those of the library's unigram model: the best sum of scores
    wins, and of equal sums the one whose last piece begins first; a character
    without a piece of its own may be unknown, at the least score less
    UNKNOWN_PENALTY, and unknown characters in a row are one piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def counts(self, words: list[str]) -> list[int]:
        """Piece counts of marked words."""
        joined = "\n".join(words)
        size = len(joined)
        # Matches by end, longest first, as the automaton gives them.
        ending: list[list[tuple[int, float]] | None] = [None] * (size + 1)
        for end, match in self.automaton.iter(joined):
            held = ending[end + 1]
            if held is None:
                ending[end + 1] = [match]
            else:
                held.append(match)
        singles, unknown, least = self.singles, self.unknown, -math.inf
        best, count, loose = [least] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        found, at = [], 0
        for word in words:
            best[at] = 0.0
            stop = at + len(word)
            for end in range(at + 1, stop + 1):
                top = least
                held = ending[end]
                if held is not None:
                    for length, score in held:
                        start = end - length
                        if start >= at and score + best[start] > top:
                            top, chosen = score + best[start], start
                    if top > least:
                        count[end] = count[chosen] + 1
                if joined[end - 1] not in singles and unknown + best[end - 1] > top:
                    top = unknown + best[end - 1]
                    count[end] = count[end - 1] + (not loose[end - 1])
                    loose[end] = True
                best[end] = top
            found.append(count[stop])
            at = stop + 1
        return found


class WordCounts:
    """Counts of whitespace words, worked out once per distinct word and remembered by a 64-bit hash."""

    def __init__(self, counter: UnigramCounter):
        self.counter = counter
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        parts = [_SPACES.split(text) for text in texts]
        words = [MARK + word for held in parts for word in held if word]
        counts = iter(self.counter.counts(words))
        values = np.array([sum(next(counts) for word in held if word) for held in parts], np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text."""
        starts, ends, bounds = bt.find_words(data, offsets, bt.NOT_SPACE)
        if not len(starts):
            return np.diff(bounds), np.diff(bounds)
        keys, example, which = np.unique(bt.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.keys, self.values = self.keys[:0], self.values[:0]
        place = np.searchsorted(self.keys, keys)
        unknown = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            unknown = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if unknown.any():
            raw, spans = data.tobytes(), example[unknown]
            self._learn(
                keys[unknown], [raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]
            )
            place = np.searchsorted(self.keys, keys)
        return np.diff(bounds), bt.segment_sums(self.values[place][which], bounds)


@lru_cache(maxsize=1)
def _worker_counts(model: str) -> WordCounts:
    return WordCounts(UnigramCounter(rank_vocabulary(model)))


def _counter(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _worker_counts(model)
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                words, pieces = counts.totals(data, offsets)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(low, high - low), "n_words": pa.array(words.astype(np.int64)),
                        "n_tokens": pa.array(pieces.astype(np.int64)),
                    }
                )

    return count


def token_counts(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row of ``docs`` (``doc_id, text``).

    Words are split at white space and marked in front, as the vocabulary's
    pieces are.  NULL and empty texts have 0.  Repeated rows each get their
    result; a NULL ``doc_id`` is carried through; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_counter(model or tokenizer_path(PIECE_MODEL)), "doc_id long, n_words long, n_tokens long")
