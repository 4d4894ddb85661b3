"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.scratch import Scratch

WINDOW_WORDS = 10
GRAM_WORDS = 5
# The least of so many consecutive gram hashes is kept, so a shared run of
# GRAM_WORDS + KEEP_OF - 1 = WINDOW_WORDS words always shares a fingerprint.
KEEP_OF = WINDOW_WORDS - GRAM_WORDS + 1
MARGIN = WINDOW_WORDS - GRAM_WORDS
# Fingerprints of the benchmark are sent to the tasks up to this number (16 MB);
# beyond it every fingerprint of the documents goes to the join.
FILTER_BOUND = 2_000_000
_BITS = 22

_HITS = "size int, hash long, at int, before array<string>, gram array<string>, after array<string>"
_MARKS = f"doc_id long, text_key long, n_words long, hits array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _HITS.split(','))}>>"


class Fingerprints:
    """The benchmark's fingerprints by gram size, or None for all when they are too many."""

    def __init__(self, hashes: dict[int, np.ndarray] | None, short: list[int]):
        self.hashes, self.short = hashes, short
        self.bits = {}
        for size, values in (hashes or {}).items():
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[values >> np.uint64(64 - _BITS)] = True
            self.bits[size] = bits

    def keep(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that the benchmark may hold."""
        if self.hashes is None:
            return np.arange(len(hashes))
        if size not in self.hashes:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[size][hashes >> np.uint64(64 - _BITS)])
        known = self.hashes[size]
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return at[known[place] == hashes[at]]


def winnow(grams: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least gram of every KEEP_OF consecutive ones of a text, ties all kept; texts with fewer have none."""
    n = len(grams) - KEEP_OF + 1
    if n <= 0:
        return grams[:0], at[:0]
    owner = bt.owners(bounds)[at]
    least = grams[:n].copy()
    for k in range(1, KEEP_OF):
        np.minimum(least, grams[k:k + n], out=least)
    whole = owner[:n] == owner[KEEP_OF - 1:]
    chosen = np.zeros(len(grams), dtype=bool)
    for k in range(KEEP_OF):
        chosen[k:k + n] |= whole & (grams[k:k + n] == least)
    return grams[chosen], at[chosen]


def _scan(data: np.ndarray, offsets: np.ndarray):
    lower = bt.LOWER[data]
    starts, ends, bounds = bt.find_words(lower, offsets, bt.ALPHANUMERIC)
    return lower, starts, ends, bounds, bt.word_hashes(lower, starts, ends)


def _hits(lower, starts, ends, bounds, size, hashes, at) -> tuple[np.ndarray, list[dict]]:
    """Owner of each fingerprint and the fingerprint with the words around it.

    ``size`` is GRAM_WORDS, or the negative word count of a whole short item.
    """
    owner = np.searchsorted(bounds, at, side="right") - 1
    words, margin = abs(size), MARGIN if size > 0 else 0
    found = []

    def text(a: int, b: int) -> list[str]:
        return [lower[starts[j]:ends[j]].tobytes().decode() for j in range(a, b)]

    for value, i, k in zip(bt.signed(hashes).tolist(), at.tolist(), owner.tolist(), strict=True):
        low, high = int(bounds[k]), int(bounds[k + 1])
        found.append({
            "size": size, "hash": value, "at": i - low, "before": text(max(low, i - margin), i)[::-1],
            "gram": text(i, i + words), "after": text(i + words, min(high, i + words + margin)),
        })
    return owner, found


_HIT_TYPE = pa.struct([
    ("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.string())),
    ("gram", pa.list_(pa.string())), ("after", pa.list_(pa.string())),
])


def _marker(known: Fingerprints) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                lower, starts, ends, bounds, words = _scan(data, offsets)
                owners, hits = [], []
                grams, at = bt.gram_hashes(words, bounds, GRAM_WORDS)
                parts = [(GRAM_WORDS, *winnow(grams, at, bounds))]
                parts += [(-size, *bt.gram_hashes(words, bounds, size)) for size in known.short]
                for size, values, places in parts:
                    kept = known.keep(size, values)
                    owner, found = _hits(lower, starts, ends, bounds, size, values[kept], places[kept])
                    owners.append(owner)
                    hits += found
                owner = np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                counts = np.bincount(owner, minlength=high - low)
                ordered = pa.array([hits[k] for k in order], _HIT_TYPE)
                bounds_of = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(low, high - low),
                        "text_key": batch.column(2).slice(low, high - low),
                        "n_words": pa.array(np.diff(bounds)),
                        "hits": pa.ListArray.from_arrays(bounds_of, ordered),
                    }
                )

    return mark


def _item_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Winnowed fingerprints of items; an item shorter than a window is one fingerprint."""
    for batch in batches:
        for low, high, data, offsets in bt.text_chunks(batch.column(1)):
            lower, starts, ends, bounds, words = _scan(data, offsets)
            counts = np.diff(bounds)
            prints = winnow(*bt.gram_hashes(words, bounds, GRAM_WORDS), bounds)
            owner, found = _hits(lower, starts, ends, bounds, GRAM_WORDS, *prints)
            owner = owner.tolist()
            for k in np.flatnonzero((counts > 0) & (counts < WINDOW_WORDS)).tolist():
                size = int(counts[k])
                whole = bt.gram_hashes(words[bounds[k]:bounds[k + 1]], np.array([0, size]), size)[0]
                found += _hits(lower, starts, ends, bounds, -size, whole, bounds[k:k + 1])[1]
                owner.append(k)
            ids = batch.column(0).slice(low, high - low).to_pylist()
            table = pa.array(found, _HIT_TYPE)
            yield pa.record_batch(
                [pa.array([ids[k] for k in owner], pa.string()), *(table.field(k) for k in range(6))],
                names=["item_id", "size", "hash", "at", "before", "gram", "after"],
            )


def _same(left: str, right: str) -> Column:
    """How many words agree, counted outwards from the gram."""
    equal = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.array_position(F.concat(equal, F.array(F.lit(False))), False).cast("int") - 1


def _known(items: DataFrame) -> Fingerprints:
    prints = items.select("size", "hash").distinct()
    short = sorted(-row.size for row in items.where("size < 0").select("size").distinct().collect())  # at most 9
    if prints.count() > FILTER_BOUND:
        return Fingerprints(None, short)
    by_size: dict[int, list[int]] = {}
    for row in prints.collect():  # at most FILTER_BOUND rows
        by_size.setdefault(row["size"], []).append(row["hash"])
    return Fingerprints({k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in by_size.items()}, short)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    1. Items (``item_id, text``) are winnowed: the least five-word hash of every
       six in a row, so that each ten-word window holds one.  An item of one to
       nine words is one fingerprint as a whole.
    2. Documents are winnowed likewise; fingerprints that no item has are dropped
       in the task while the items' are few enough to send, else in the join.
    3. The join on the hash compares the words themselves and extends a hit up to
       five words either way; ten words in all (the item's own for a short item)
       are an occurrence, whose words are hit.

    NULL texts have no words and no hits.  Items without words occur nowhere.
    Repeated rows, and rows with one id and other texts, each get their own
    result.  Repeated items count once by id; NULL item ids are left out of ids
    and counts, but their words are hit.  Other columns are not read.  ``item_ids``
    and ``text_key`` (xxhash64 of the text) follow the named columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.keep(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_fingerprints, f"item_id string, {_HITS}")
    )
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    marks = scratch.keep(narrow.mapInArrow(_marker(_known(items)), _MARKS))
    hits = (
        marks.where(F.size("hits") > 0).select("doc_id", "text_key", "hits").distinct()
        .select("doc_id", "text_key", F.explode("hits").alias("hit")).select("doc_id", "text_key", "hit.*")
    )
    test = items.select("item_id", "size", "hash", *(F.col(c).alias(f"item_{c}") for c in ("before", "gram", "after")))
    joined = hits.join(test.distinct(), ["size", "hash"]).where("gram = item_gram")
    left, right = _same("before", "item_before"), _same("after", "item_after")
    found = joined.select(
        "doc_id", "text_key", "item_id", (F.col("at") - left).alias("start"),
        (F.col("at") + F.abs("size") + right).alias("end"), "size",
    ).where(f"size < 0 OR end - start >= {WINDOW_WORDS}")
    # Overlapping spans count once: sorted by start, each adds what lies beyond the furthest end so far.
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")),
        lambda acc, span: F.struct(
            (acc["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], acc["far"]))).alias("n"),
            F.greatest(acc["far"], span["end"]).alias("far"),
        ),
        lambda acc: acc["n"],
    )
    per_text = found.groupBy("doc_id", "text_key").agg(
        covered.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    marks = marks.select("doc_id", "text_key", "n_words").alias("m")
    per_text = per_text.alias("p")
    same = (F.col("m.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.col("m.text_key") == F.col("p.text_key"))
    ids = F.coalesce("p.item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("p.n_hit", F.lit(0).cast("long"))
    return marks.join(per_text, same, "left").select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), ids.alias("item_ids"), F.col("m.text_key").alias("text_key"),
    )
