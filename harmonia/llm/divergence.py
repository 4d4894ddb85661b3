"""Source divergence audit: how the word use of each source departs from its language's and from other sources'."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.scratch import Scratch
from harmonia.session import BROADCAST_ROW_BOUND

LEAST_DOCUMENTS = 30
ADDED = 5
PARTS = 1_000_000_000
RANKS = 50
# Sources of one language that are compared side by side, and rows of counts in one block of terms.
TILE = 128
BLOCK_ROWS = 500_000
TERMS_AT_ONCE = 4096

_TERM = np.zeros(256, dtype=bool)
_TERM[ord("a"):ord("z") + 1] = True
_TERM[0x80:] = True
_EITHER_CASE = _TERM[bt.LOWER]

_COUNTED = "lang string, source string, term string, n long, docs long"


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a string column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]
    ).cast(pa.string())


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together (the last key first), and where each run of equals begins in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _chunk_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of every (group, term) of a chunk."""
    starts, ends, bounds = bt.find_words(data, offsets, _TERM)
    hashes, owner = bt.word_hashes(data, starts, ends), bt.owners(bounds)
    order, first = _runs(hashes, owner)
    n = np.diff(np.append(first, len(order)))
    word = order[first]
    own, value = group[owner[word]], hashes[word]
    order, first = _runs(value, own)
    docs = np.diff(np.append(first, len(order)))
    total = np.add.reduceat(n[order], first) if len(first) else n[:0]
    word, own = word[order[first]], own[order[first]]
    return own, _strings(data, starts[word], ends[word]), total, docs


def _long_terms(data: np.ndarray) -> Counter[str]:
    """Occurrences of every term of one long text, piece by piece; pieces end between terms."""
    found: Counter[str] = Counter()
    low = 0
    while low < len(data):
        high = bt.word_border(data, low + bt.CHUNK_BYTES, _EITHER_CASE)
        piece = bt.LOWER[data[low:high]]
        _, terms, n, _ = _chunk_terms(piece, np.array([0, len(piece)]), np.zeros(1, np.int64))
        for term, k in zip(terms.to_pylist(), n.tolist(), strict=True):
            found[term] += k
        low = high
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each (lang, source) by chunk, and one row without a term for every (lang, source)."""
    for batch in batches:
        pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
        known: dict[tuple, int] = {}
        group = np.array([known.setdefault((p["lang"], p["source"]), len(known)) for p in pairs.to_pylist()], np.int64)
        langs, sources = (pa.array([key[k] for key in known], pa.string()) for k in range(2))

        def rows(own: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray, langs=langs, sources=sources) -> pa.RecordBatch:
            at = pa.array(own)
            return pa.record_batch({
                "lang": langs.take(at), "source": sources.take(at), "term": terms, "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64()),
            })

        none = np.zeros(len(known), np.int64)
        yield rows(np.arange(len(known)), pa.nulls(len(known), pa.string()), none, none)
        for low, high, data, offsets in bt.text_chunks(batch.column(2)):
            if len(data) > 2 * bt.CHUNK_BYTES:
                found = _long_terms(data)
                one = np.ones(len(found), np.int64)
                yield rows(one * group[low], pa.array(list(found), pa.string()), np.fromiter(found.values(), np.int64, len(found)), one)
            else:
                yield rows(*_chunk_terms(bt.LOWER[data], offsets, group[low:high]))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(PARTS * (count + ADDED) / (total + ADDED * terms))``, exactly: products in 31 digits."""
    divisor = F.greatest(total + ADDED * terms, F.lit(1)).cast("decimal(20,0)")
    product = (count + ADDED).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", product, divisor) + 1


def _shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``share`` over arrays, in three steps of long division that stay within 64 bits."""
    divisor = np.maximum(total + ADDED * terms, 1)
    rest, found = count + ADDED, np.zeros_like(count)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, divisor)
        found = found * 1000 + step
    return found + 1


def _block_distances(tile: int) -> Callable[[pa.Table], pa.Table]:
    """What the terms of one block add to the distance of every two sources of two tiles (or of one with itself).

    Terms that neither of two sources has add the same each, so these are taken
    together: all V terms in block 0, and the difference to that for each term
    of the block.
    """

    def distances(block: pa.Table) -> pa.Table:
        return _distances(block, tile)

    return distances


def _distances(block: pa.Table, tile: int) -> pa.Table:
    lang, number, lo, hi = (block.column(c)[0].as_py() for c in ("lang", "block", "lo", "hi"))
    terms = int(block.column("terms")[0].as_py())
    place, n, total = (block.column(c).to_numpy() for c in ("place", "n", "total"))
    held, first, row = np.unique(place, return_index=True, return_inverse=True)
    names = block.column("source").take(pa.array(first)).to_pylist()
    zero = _shares(np.zeros(len(held), np.int64), total[first], terms)
    counted = np.flatnonzero(block.column("term").is_valid().to_numpy())
    code = block.column("term").take(pa.array(counted)).combine_chunks().dictionary_encode()
    code = code.indices.to_numpy() if isinstance(code, pa.DictionaryArray) else code.chunk(0).indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, row, n = code[order], row[counted][order], n[counted][order]
    left, right = np.flatnonzero(held // tile == lo), np.flatnonzero(held // tile == hi)
    base = np.abs(zero[left][:, None] - zero[right][None, :])
    added = base * (terms if number == 0 else 0)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, TERMS_AT_ONCE):
        a, b = np.searchsorted(code, [low, low + TERMS_AT_ONCE])
        width = int(code[b - 1]) + 1 - low
        count = np.zeros((len(held), width), np.int64)
        count[row[a:b], code[a:b] - low] = n[a:b]
        shares = _shares(count, np.repeat(total[first][:, None], width, axis=1), terms)
        for k, own in enumerate(left.tolist()):
            added[k] += np.abs(shares[right] - shares[own]).sum(axis=1) - width * base[k]
    if not terms:
        added[:] = 0
    x, y = np.nonzero(held[left][:, None] < held[right][None, :])
    return pa.table({
        "lang": pa.array([lang] * len(x), pa.string()), "source": pa.array([names[k] for k in left[x].tolist()], pa.string()),
        "item": pa.array([names[k] for k in right[y].tolist()], pa.string()), "value": pa.array(added[x, y], pa.int64()),
    })


def _source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language, in both orders.

    The counts of a language are dealt to blocks of terms by hash, and its
    sources to tiles; a task holds one block of two tiles, so its rows and its
    table of counts are bounded whatever the language's share of the input.
    """
    by_name = Window.partitionBy("lang").orderBy("source")
    sizes = groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.sum("cells") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")
    )
    placed = _with_groups(groups.select("lang", "source", "total", "terms", (F.row_number().over(by_name) - 1).alias("place")), sizes, ["lang"])
    own = kept.select("lang", "source", "term", "n")
    counted = _with_groups(own, placed, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    # Every source is in every block, so that terms which only others have are compared too.
    empty = placed.select(
        "*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    tile, other = F.floor(F.col("place") / TILE).cast("int"), F.col("other")
    rows = counted.unionByName(empty).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select(
        "lang", "source", "place", "total", "terms", "term", "n", "block", F.least(tile, other).alias("lo"), F.greatest(tile, other).alias("hi")
    )
    found = rows.groupBy("lang", "block", "lo", "hi").applyInArrow(_block_distances(TILE), "lang string, source string, item string, value long")
    half = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with their group's columns; a broadcast join only where the groups have been counted as few."""
    few = groups.limit(BROADCAST_ROW_BOUND + 1).count() <= BROADCAST_ROW_BOUND
    return rows.join(F.broadcast(groups) if few else groups, on)


def _leading_terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms that a source uses most above its language.

    Terms with equal counts in group and language are one cell, evaluated once;
    cells with equal values are merged.  At most ``ranks`` values are needed, of
    which the cumulative number of terms tells the place of each.  Only terms of
    these values are read back, at most ``ranks`` of each value and task.
    """
    group = ["lang", "source"]
    own, whole = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = kept.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("same"))
    values = _with_groups(cells, groups, group).select(*group, (own - whole).alias("value"), "same").where("value > 0")
    values = values.groupBy(*group, "value").agg(F.sum("same").alias("same"))
    highest = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = values.withColumn("nth", F.row_number().over(highest)).where(F.col("nth") <= ranks)
    before = F.coalesce(F.sum("same").over(highest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < ranks).select(*group, "value", "before")
    least = values.groupBy(*group).agg(F.min("value").alias("least"))
    terms = _with_groups(kept, groups.join(least, group), group).select(*group, "term", (own - whole).alias("value"), "least").where("value >= least")
    in_order = Window.partitionBy(*group, "value").orderBy("term")
    terms = terms.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= ranks)
    rank = F.col("before") + F.col("nth")
    return terms.join(values, [*group, "value"]).where(rank <= ranks).select(*group, F.col("term").alias("item"), "value", rank.cast("int").alias("rank"))


def divergence(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) of ``docs`` (``text, lang, source``).

    1. Terms are counted chunk by chunk and combined before the shuffle; texts
       are read once.  A language keeps the terms in ``least_documents`` of its
       documents.
    2. ``pair``: the distance to each other source of the language, over all kept
       terms, from blocks of terms and tiles of sources.
    3. ``term``: the terms used more than in the language as a whole, to ``ranks``.

    NULL texts, languages and sources read as ''.  A source without terms has
    zero counts; a language without kept terms has distances of 0 and no terms.
    A source alone in its language has no pair.  Ties go by the item's UTF-8
    bytes.  Repeated rows count as often as they occur.  An empty table gives no
    rows.  Other columns are not read.  Counts stay exact up to 9e15.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.keep(
        read.mapInArrow(_count_terms, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    in_lang = scratch.keep(
        counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_documents).drop("docs")
    )
    kept = scratch.keep(counts.where("term IS NOT NULL").join(in_lang, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    zero = F.lit(0).cast("long")
    whole = in_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    groups = scratch.keep(
        counts.where("term IS NULL").select("lang", "source").join(held, ["lang", "source"], "left").join(whole, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "cells", "terms", "lang_total")))
    )
    scratch.clear(kept, groups)
    pairs = _source_distances(kept, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = _leading_terms(kept, groups, ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
