"""Language identification: scripts, per-word scores, and a Viterbi over the words of each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt

BUCKETS = 1 << 16
UNKNOWN = "und"
HELD_OUT = 2
# Scores are logarithms in units of 1 / SCALE, so sums do not depend on their order.
SCALE = 256
# The cost of a change of language between two words, about the evidence of two clear words.
SWITCH = 12 * SCALE
# A language is a candidate for the words of a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.005
OUT_OF_SCRIPT = -40 * SCALE

# First and last code point of the letters of each script; a fixed table.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x2000):
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


def _scan(data: np.ndarray, offsets: np.ndarray):
    """Words of letters: starts, ends, each text's first word, scripts; and the bucket of every trigram.

    Trigram ``i`` covers the characters ``i - 1`` to ``i + 1``, with a space for
    all that is not a letter of the same text.
    """
    letter, lower, script = _tables()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    inside = letter[points]
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), none, none
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
    last[-1], last[:-1] = inside[-1], inside[:-1] & ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner], last[inner - 1] = inside[inner], inside[inner - 1]
    plain = np.where(inside, lower[points], np.uint32(32))
    left, right = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    left[1:], right[:-1] = plain[:-1], plain[1:]
    left[first], right[last] = 32, 32
    value = plain * np.uint32(0x9E3779B1) + left * np.uint32(0x85EBCA6B) + right * np.uint32(0xC2B2AE35)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    bucket = (value >> np.uint32(16)).astype(np.int64)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds), script[points[starts]], bucket


def _letters(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all letters, word by word."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)


def _count_trigrams(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a task by language: trigrams, then letters by script; at most one row per counter."""
    width = BUCKETS + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * width, np.int64)
        number = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            langs = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                starts, ends, bounds, scripts, bucket = _scan(data, offsets)
                own = np.repeat(langs[low:high], np.diff(bounds))
                lengths = ends - starts
                at = _letters(starts, ends)
                total += np.bincount(np.repeat(own * width, lengths) + bucket[at], minlength=len(total))
                total += np.bincount(own * width + BUCKETS + scripts, weights=lengths, minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.record_batch(
            {"lang": pa.array((seen // width).astype(np.int32)), "slot": pa.array((seen % width).astype(np.int32)), "n": pa.array(total[seen])}
        )

    return count


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, trigram scores (bucket x language) and candidates (script x language)."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel:
    """Trigram and script counts of all documents that have an id and a language and are not held out."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    languages = sorted(row.lang for row in known.select("lang").distinct().collect())
    width = BUCKETS + len(SCRIPT_NAMES)
    counts = known.mapInArrow(_count_trigrams(languages), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), width), np.int64)
    for row in counts.collect():  # languages x width rows at most
        table[row.lang, row.slot] = row.n
    grams, letters = table[:, :BUCKETS], table[:, BUCKETS:]
    share = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    scores = np.rint(np.log(share) * SCALE).astype(np.int32).T.copy()
    candidates = (letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)).T.copy()
    return LanguageModel(languages, scores, candidates)


def best_path(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best state of every word; texts are followed side by side, longest first.

    A change of state between two words costs SWITCH; of equals the state stays,
    and otherwise the lower number wins.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    path = np.zeros(len(scores), np.int64)
    if not len(order):
        return path
    base, lengths = bounds[:-1][order], lengths[order]
    alive = len(order) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    own = np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] <= 256 else np.int32)
    value = scores[base].astype(np.int64)
    for step in range(1, int(lengths[0])):
        k = alive[step]
        now, at = value[:k], base[:k] + step
        top = now.max(axis=1, keepdims=True) - SWITCH
        stays = now >= top
        back[at] = np.where(stays, own, now.argmax(axis=1)[:, None])
        value[:k] = np.maximum(now, top) + scores[at]
    state = value.argmax(axis=1)
    for step in range(int(lengths[0]) - 1, -1, -1):
        k = alive[step]
        at = base[:k] + step
        path[at] = state[:k]
        if step:
            state[:k] = back[at, state[:k]]
    return path


def word_scores(model: LanguageModel, data: np.ndarray, offsets: np.ndarray):
    """Scores of every word by language, the words' lengths, and each text's first word."""
    starts, ends, bounds, scripts, bucket = _scan(data, offsets)
    found = np.zeros((len(starts), len(model.languages)), np.int32)
    if len(starts):
        lengths = ends - starts
        at = bucket[_letters(starts, ends)]
        first = np.cumsum(lengths) - lengths
        for k in range(found.shape[1]):
            found[:, k] = np.add.reduceat(model.scores[at, k], first)
        allowed = model.candidates[scripts]
        narrowed = allowed.any(axis=1, keepdims=True) & ~allowed
        found += np.where(narrowed, OUT_OF_SCRIPT, 0).astype(np.int32)
    return found, ends - starts, bounds


def _predictor(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [word_scores(model, data, offsets) for _, _, data, offsets in bt.text_chunks(batch.column(1))]
            if not parts:
                continue
            scores, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            counts = np.concatenate([np.diff(p[2]) for p in parts])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            n, known = len(counts), len(model.languages)
            weight = np.zeros((n, max(known, 1)))
            spans = np.zeros(n, np.int64)
            if known and len(scores):
                path = best_path(scores, bounds)
                owner = bt.owners(bounds)
                weight = np.bincount(owner * known + path, weights=lengths, minlength=n * known).reshape(n, known)
                begins = np.ones(len(path), bool)
                begins[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
                spans = np.bincount(owner[begins], minlength=n)
            total, best = weight.sum(axis=1), weight.argmax(axis=1)
            share = weight[np.arange(n), best] / np.maximum(total, 1)
            names = [model.languages[k] if t else UNKNOWN for k, t in zip(best.tolist(), total.tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(share), "n_spans": pa.array(spans.astype(np.int64)),
                }
            )

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans`` of every row of ``docs`` (``doc_id, text``).

    Every word of letters has a score in each language that its script allows
    (all, where no language has the script).  The best path over a text's words
    labels spans; ``lang_pred`` is the language of most letters (ties: the first
    by name), ``score`` its share of them, ``n_spans`` the number of spans.
    Without letters, and for NULL, the result is ``und`` with score 0, as it is
    for every text when nothing could be learned.  Repeated rows each get their
    result; a NULL ``doc_id`` is carried through.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
    )
    return narrow.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
