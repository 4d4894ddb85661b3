"""Importance resampling towards a target text distribution over hashed word n-grams."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.crc_table import word_checksums
from harmonia.llm.scratch import Scratch

BUCKETS = 10_000
SHARE_PERCENT = 25
LEAST_WORDS = 20
SEED = 7
# Rows that one list of ranks may make.
RANKS_AT_ONCE = 100_000

# Word bytes before lower-casing.
_WORD = bt.ALPHANUMERIC[bt.LOWER]

_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bytes, offsets, whether the first word was given before) of a chunk; a long text comes in several pieces.

    Pieces end between words.  Each begins with the last word of the one before
    it, whose own pair is then the one across the border.
    """
    if len(data) <= 2 * limit:
        yield bt.LOWER[data], offsets, False
        return
    low, repeated = 0, False
    while low < len(data):
        high = bt.word_border(data, low + limit, _WORD)
        piece = bt.LOWER[data[low:high]]
        yield piece, np.array([0, len(piece)]), repeated
        if high == len(data):
            return
        starts, _, _ = bt.find_words(piece, np.array([0, len(piece)]), bt.ALPHANUMERIC)
        # A piece that holds nothing but the repeated word goes on after it.
        repeated = len(starts) > 0
        low += int(starts[-1]) if repeated else high - low
        if high - low >= limit:
            # One word as long as a piece: the next piece takes it whole, so the limit must reach past it.
            limit = 2 * (high - low)


def _features(data: np.ndarray, offsets: np.ndarray, repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of consecutive words, and each text's bounds in the two arrays."""
    starts, ends, bounds = bt.find_words(data, offsets, bt.ALPHANUMERIC)
    words, pairs = word_checksums(data, starts, ends)
    owner = bt.owners(bounds)
    within = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    pair_bounds = np.searchsorted(within, bounds)
    if repeated:
        words, bounds = words[1:], np.maximum(bounds - 1, 0)
    return (words % BUCKETS).astype(np.int64), (pairs[within] % BUCKETS).astype(np.int64), bounds, pair_bounds


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    for low, high, data, offsets in bt.text_chunks(column):
        yield low, high, (_features(*piece) for piece in _pieces(data, offsets, bt.CHUNK_BYTES))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a task's texts by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, pieces in _chunks(batch.column(0)):
            for words, pairs, _, _ in pieces:
                total += np.bincount(words, minlength=BUCKETS)
                total += np.bincount(pairs, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})


def bucket_counts(texts: DataFrame) -> list[int]:
    """Features of all ``texts`` (one column) by bucket: BUCKETS numbers, whatever the table's size."""
    counts = texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = [0] * BUCKETS
    for row in counts.collect():  # at most BUCKETS rows
        found[row.bucket] = row.n
    return found


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """Log-likelihood ratio of target to raw by bucket, in thousandths, rounded down; one is added to every count."""
    raw_total, target_total = sum(raw), sum(target)
    return [
        math.floor(1000 * math.log((t + 1) * (raw_total + BUCKETS) / ((s + 1) * (target_total + BUCKETS))))
        for s, t in zip(raw, target, strict=True)
    ]


def noise(doc_id: int, seed: int) -> int:
    """The Gumbel noise of a document, in thousandths, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gains: list[int], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = np.array(gains, np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, pieces in _chunks(batch.column(1)):
                n_words, n_pairs, total = (np.zeros(high - low, np.int64) for _ in range(3))
                for words, pairs, bounds, pair_bounds in pieces:
                    n_words += np.diff(bounds)
                    n_pairs += np.diff(pair_bounds)
                    total += bt.segment_sums(table[words], bounds) + bt.segment_sums(table[pairs], pair_bounds)
                n_features = n_words + n_pairs
                weight = total // np.maximum(n_features, 1)
                ids = batch.column(0).slice(low, high - low)
                scores = [None if i is None else w + noise(i, seed) for i, w in zip(ids.to_pylist(), weight.tolist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": ids, "n_words": pa.array(n_words), "n_features": pa.array(n_features),
                    "weight": pa.array(weight), "score": pa.array(scores, pa.int64()),
                })

    return score


def _numbered(rows: DataFrame, first: Column, n: Column) -> DataFrame:
    """``n`` copies of every row with ranks from ``first`` on, a bounded list at a time."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / RANKS_AT_ONCE))
    block = rows.select("*", F.explode(blocks).alias("_block"))
    low = F.col("_block") * RANKS_AT_ONCE
    ranks = F.sequence(low, F.least(low + RANKS_AT_ONCE, n) - 1)
    return block.select("*", F.explode(ranks).alias("_nth")).withColumn("rank", first + F.col("_nth"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = SHARE_PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``).

    1. Words and pairs of consecutive words of all texts are counted by their
       checksum's bucket; the BUCKETS counts of ``docs`` and ``target`` (``text``)
       give each bucket's gain.
    2. A document's weight is the mean gain of its features; Gumbel noise of its
       id is added, so the highest scores are a sample without replacement.
    3. Of the documents with LEAST_WORDS words, ``percent`` in a hundred are
       drawn.  Equal results are counted first.  A score's place follows from the
       counts of the scores above it: gains are logarithms and the noise has 32
       bits, so there are some ten thousand scores whatever the size.  Within a
       score rows go by ``doc_id``; the noise spreads even equal weights so that
       no score holds more than one in a thousand ids.

    NULL texts, and those without words, have no features and weight 0.  A row
    without ``doc_id`` has no noise, so no score and no rank, and does not count
    for the share.  Repeated rows are documents of their own with equal scores
    and following ranks; rows of one id and score go by features and weight.
    Empty tables give no rows.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    text = F.col("text").cast("string").alias("text")
    gains = bucket_gains(bucket_counts(docs.select(text)), bucket_counts(target.select(text)))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_scorer(gains, seed), _SCORED)
    kinds = scratch.keep(
        scored.groupBy("doc_id", "n_features", "weight", "score", (F.col("n_words") >= LEAST_WORDS).alias("long")).agg(F.count("*").alias("n"))
    )
    able = F.col("long") & F.col("score").isNotNull()
    per_score = kinds.where(able).groupBy("score").agg(F.sum("n").alias("n"))
    # One row a score: gains and noise are bounded logarithms in thousandths.
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = scratch.keep(per_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), "n"))
    drawn = (places.agg(F.sum("n")).first()[0] or 0) * percent // 100
    reached = places.where(F.col("above") < drawn)
    least = reached.agg(F.min("score")).first()[0]
    scratch.clear(kinds, places)
    unranked = F.lit(None).cast("long")
    if least is None:
        return _numbered(kinds.select("*", unranked.alias("first")), F.col("first"), F.col("n")).select("doc_id", "n_features", "weight", "score", "rank")
    high = able & (F.col("score") >= least)
    before = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    top = kinds.where(high).withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0)))
    top = top.join(reached.select("score", "above"), "score").withColumn("first", F.col("above") + F.col("nearer") + 1)
    rest = kinds.where(~F.coalesce(high, F.lit(False))).withColumn("first", unranked)
    both = top.select(*kinds.columns, "first").unionByName(rest.select(*kinds.columns, "first"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return _numbered(both, F.col("first"), F.col("n")).select("doc_id", "n_features", "weight", "score", rank)
