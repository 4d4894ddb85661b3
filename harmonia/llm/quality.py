"""Quality rules: base counts and a log-likelihood ratio over hashed n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt

GRAM_BYTES = 4
BUCKETS = 1 << 16
# Bits that mark labelled ids: texts of others are not shuffled, but for a few that share a bit.
MARK_BITS = 1 << 24
SCALE = 1 << 16
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Poor rows that place the threshold half-way between the classes.  With fewer it stays at least SPREAD deviations
# below the mean of the trusted rows.
LEAST_POOR = 8
SPREAD = 6.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[0x0A] = False

_BASE = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_grams long, ratio long"
)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every byte n-gram within one text, and how many each text has."""
    counts = np.maximum(np.diff(offsets) - (GRAM_BYTES - 1), 0)
    n = len(data) - GRAM_BYTES + 1
    if n <= 0:
        return np.zeros(0, np.uint16), counts
    value = data[:n].astype(np.uint32)
    for k in range(1, GRAM_BYTES):
        value |= data[k:k + n].astype(np.uint32) << np.uint32(8 * k)
    value *= np.uint32(0x9E3779B1)
    bucket = (value >> np.uint32(16)).astype(np.uint16)
    crossing = (offsets[1:-1, None] - np.arange(1, GRAM_BYTES)).ravel()
    inside = np.ones(n, dtype=bool)
    inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    return bucket[inside], counts


def _repeated(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, value), and which of the ordered entries equal the one before."""
    key = bt.mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, same


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of each text."""
    starts, ends, bounds = bt.find_words(data, offsets, bt.NOT_SPACE)
    n = len(bounds) - 1
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    words = bt.word_hashes(data, starts, ends)

    line_starts, line_ends, line_bounds = bt.find_words(data, offsets, _NEWLINE)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    owner = bt.owners(line_bounds)[filled]
    lines = bt.word_hashes(data, line_starts[filled], line_ends[filled])
    order, again = _repeated(lines, owner)
    dup_lines = np.bincount(owner[order][again], minlength=n)

    grams, at = bt.gram_hashes(words, bounds, 3)
    word_owner = bt.owners(bounds)
    order, again = _repeated(grams, word_owner[at])
    twice = again.copy()
    twice[:-1] |= again[1:]
    first = at[order[twice]]
    marked = np.zeros(len(words), dtype=bool)
    for k in range(3):
        marked[first + k] = True
    return {
        "n_words": np.diff(bounds),
        "word_chars": bt.segment_sums(points[ends] - points[starts], bounds),
        "n_symbols": np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": bt.segment_sums(marked.astype(np.int64), bounds),
    }


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task: at most BUCKETS rows."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in bt.text_chunks(batch.column(0)):
            total += np.bincount(gram_buckets(data, offsets)[0], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over every text of the table."""
    counts = texts.select("text").mapInArrow(_count_grams, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():  # at most BUCKETS rows
        found[row.bucket] = row.n
    return found


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed log of target over raw probability of each bucket, in units of 1 / SCALE."""
    p = (target + 0.5) / (target.sum() + 0.5 * len(target))
    q = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    return np.rint(np.log(p / q) * SCALE).astype(np.int64)


def _scorer(ratio: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                buckets, counts = gram_buckets(data, offsets)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                columns = base_counts(data, offsets) | {
                    "n_grams": counts, "ratio": bt.segment_sums(ratio[buckets], bounds),
                }
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(low, high - low)}
                    | {name: pa.array(values.astype(np.int64)) for name, values in columns.items()}
                )

    return score


@dataclass(frozen=True)
class QualityModel:
    """Log ratio of each bucket and the least mean ratio of a kept text, both in units of 1 / SCALE."""

    ratio: np.ndarray
    threshold: float


def _part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 2


def _labelled(labels: DataFrame) -> DataFrame:
    """One row for every labelled document."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min("quality").alias("quality"))


def _may_meet(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text``) whose ids may be in ``chosen``: all that are, and by chance some that are not."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    # Bitmaps number their bits from 1.
    marks = chosen.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    packed = np.zeros(MARK_BITS // 8, np.uint8)
    for row in marks.collect():  # MARK_BITS bits at most
        packed[(row.bucket - 1) * len(row.bits):row.bucket * len(row.bits)] = np.frombuffer(row.bits, np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(packed, bitorder="little").astype(bool)
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(marked[batch.column(2).to_numpy()]))

    return docs.select("doc_id", "text", place.alias("place")).where("doc_id IS NOT NULL").mapInArrow(keep, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, *, spread: float = SPREAD) -> QualityModel:
    """Multinomials and threshold.

    The raw multinomial counts every text.  The target multinomial counts the
    trusted texts (quality 1) of one half of the labelled documents; the other
    half, unseen by it, sets the threshold: half-way between the mean ratios of
    its trusted and its poor texts.  With fewer than LEAST_POOR poor texts it is
    ``spread`` deviations below the mean of the trusted ones, if that is lower.
    Without trusted texts every text passes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = _labelled(labels)
    filled, part = docs.where("text IS NOT NULL"), _part(F.col("doc_id"))
    raw = gram_counts(docs)
    trusted_ids = chosen.where("quality = 1")
    target = gram_counts(_may_meet(filled.where(part == 0), trusted_ids).join(trusted_ids, "doc_id"))
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS, np.int64), -np.inf)
    ratio = log_ratio(target, raw)
    # Texts are scored where they are read; narrow rows meet the labels.
    scored = filled.where(part == 1).mapInArrow(_scorer(ratio), _BASE)
    mean = F.col("ratio") / F.greatest("n_grams", F.lit(1))
    trusted = (F.col("quality") == 1).alias("trusted")
    seen = scored.where(f"n_words >= {LEAST_WORDS}").select("doc_id", "ratio", "n_grams").join(chosen, "doc_id").groupBy(trusted).agg(
        F.count("*").alias("n"), F.avg(mean).alias("mean"), F.stddev_pop(mean).alias("deviation")
    )
    found = {row.trusted: row for row in seen.collect()}  # two rows
    if True not in found:
        return QualityModel(ratio, -np.inf)
    threshold = found[True].mean - spread * found[True].deviation
    if False in found:
        middle = (found[True].mean + found[False].mean) / 2
        threshold = middle if found[False].n >= LEAST_POOR else min(threshold, middle)
    # Rounded, so that the order of the sums does not matter.
    threshold = round(threshold, 3)
    return QualityModel(ratio, float(threshold))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Base counts, mean log ratio and verdict of every row of ``docs`` (``doc_id, text``).

    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows.  ``kept``: not so, and the mean log ratio of the text's
    n-grams is not below the threshold (a tie is kept).  NULL reads as the empty
    text: 0 everywhere, ``base_failed``.  Repeated rows each get their result;
    a NULL ``doc_id`` is carried through; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = narrow.mapInArrow(_scorer(model.ratio), _BASE)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    mean = F.col("ratio") / F.greatest("n_grams", F.lit(1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (mean >= F.lit(float(model.threshold)))).alias("kept"), (mean / SCALE).alias("mean_log_ratio"),
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with all their columns; nothing is shuffled."""
    ratio, threshold, place = model.ratio, float(model.threshold), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(place)):
                buckets, counts = gram_buckets(data, offsets)
                sums = bt.segment_sums(ratio[buckets], np.concatenate([[0], np.cumsum(counts)]))
                base = base_counts(data, offsets)
                good = (base["n_words"] >= LEAST_WORDS) & (
                    100 * base["n_repeat_words"] <= MOST_REPEATED_PERCENT * base["n_words"]
                ) & (sums / np.maximum(counts, 1) >= threshold)
                yield batch.slice(low, high - low).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
