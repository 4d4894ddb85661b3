"""MinHash near-duplicate detection: bands, signatures, full sets, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.components import connected_components
from harmonia.llm.scratch import Scratch

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
# A pair of similarity 0.75 agrees in 96 of 128 minima (deviation 4.9); fewer than
# 72 lie 4.9 deviations below: one such pair in two million.
LEAST_AGREEING = 72
# Buckets of up to so many texts are compared in full; larger ones in blocks of BLOCK.
FULL_BUCKET = 32
BLOCK = 256

_FACTORS, _ADDENDS = bt.constants(MINIMA, 211), bt.constants(MINIMA, 223)
_BAND = bt.constants(BANDS * (BAND_ROWS + 1), 227).reshape(BANDS, BAND_ROWS + 1)
_WHOLE = np.uint64(0xA24BAED4963EE407)

_MARKS = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, signature binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the bounds of each set."""
    starts, ends, bounds = bt.find_words(data, offsets, bt.NOT_SPACE)
    words = bt.word_hashes(bt.LOWER[data], starts, ends)
    grams, at = bt.gram_hashes(words, bounds, SHINGLE_WORDS)
    cuts = np.searchsorted(at, bounds)
    sets, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for k in range(len(counts)):
        found = grams[cuts[k]:cuts[k + 1]]
        if not len(found) and bounds[k + 1] > bounds[k]:
            few = words[bounds[k]:bounds[k + 1]]
            found = bt.gram_hashes(few, np.array([0, len(few)]), len(few))[0] ^ _WHOLE
        elif len(found):
            found = np.sort(found)
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        counts[k] = len(found)
        sets.append(found)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def minima(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each non-empty set: sets x MINIMA, 32 bits."""
    firsts = bounds[:-1][np.diff(bounds) > 0]
    found = np.empty((MINIMA, len(firsts)), np.uint32)
    # Pieces of whole sets that stay in the processor's cache.
    low = 0
    while low < len(firsts):
        high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + 65536)))
        end = firsts[high] if high < len(firsts) else bounds[-1]
        part, inner = shingles[firsts[low]:end], firsts[low:high] - firsts[low]
        for k in range(MINIMA):
            value = part * _FACTORS[k]
            value += _ADDENDS[k]
            found[k, low:high] = np.minimum.reduceat(value, inner) >> np.uint64(32)
        low = high
    return found.T


def _band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    return bt.mix((parts * _BAND[:, :BAND_ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[:, BAND_ROWS])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in bt.text_chunks(batch.column(1)):
            shingles, bounds = shingle_sets(data, offsets)
            counts = np.diff(bounds)
            signature = minima(shingles, bounds)
            keys = _band_keys(signature)
            filled = counts > 0
            short = np.zeros((high - low, MINIMA), np.uint8)
            short[filled] = signature & np.uint32(0xFF)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).slice(low, high - low),
                    "n_shingles": pa.array(counts),
                    "set_hi": pa.array(bt.signed(bt.segment_sums(bt.mix(shingles + _WHOLE), bounds))),
                    "set_lo": pa.array(bt.signed(bt.segment_sums(bt.mix(shingles ^ _WHOLE), bounds))),
                    "bands": bt.ragged(bt.signed(keys.ravel()), np.where(filled, BANDS, 0), pa.int64()),
                    "signature": pa.array([row.tobytes() for row in short], pa.binary()),
                }
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3)
        )
        agreeing = (left == right).sum(axis=1).astype(np.int32)
        found = agreeing >= LEAST_AGREEING
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(agreeing)], names=["a", "b", "agreeing"]
        ).filter(pa.array(found))


def _confirmer(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose full sets are similar: 100 * shared >= percent * united."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for k in (2, 3):
                found = []
                for low, high, data, offsets in bt.text_chunks(batch.column(k)):
                    shingles, bounds = shingle_sets(data, offsets)
                    found += [shingles[bounds[i]:bounds[i + 1]] for i in range(high - low)]
                sets.append(found)
            held = []
            for left, right in zip(*sets, strict=True):
                both = np.concatenate([left, right])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                held.append(100 * shared >= percent * (len(both) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return confirm


def _pairs_of_lists(buckets: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of buckets that hold at most FULL_BUCKET texts."""
    lists = buckets.groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    each = lists.select("reps", F.posexplode("reps").alias("at", "a"))
    return each.select("a", F.explode(F.expr("slice(reps, at + 2, size(reps))")).alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Signature verification of candidate pairs."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("signature").alias("left_signature"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("signature").alias("right_signature"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left_signature", "right_signature")
    return joined.mapInArrow(_agreeing, "a long, b long, agreeing int")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right_text"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left_text", "right_text")
    return joined.mapInArrow(_confirmer(percent), "a long, b long")


def _labelled(rows: DataFrame, column: str, components: DataFrame, name: str) -> DataFrame:
    """Adds the component of a node; nodes without links are their own."""
    nodes = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(nodes, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs that no links join yet."""
    labelled = _labelled(_labelled(pairs, "a", components, "ca"), "b", components, "cb")
    return labelled.where("ca <> cb").select("a", "b")


def _block_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the visitors and the homes of one block that join different components.

    A pair is looked at in the first band that it agrees in, so in one bucket
    only, and its sets are compared only while no other link joins the two.
    """

    def links(block: pa.Table) -> pa.Table:
        rep, part = (block.column(n).to_numpy() for n in ("rep", "part"))
        visits, band = block.column("visits").to_numpy(zero_copy_only=False), block.column("band")[0].as_py()
        bands = np.array(block.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        signature = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)
        text = block.column("text")
        homes, sets, parent = np.flatnonzero(~visits), {}, {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                raw = np.frombuffer(text[k].as_py().encode(), np.uint8)
                sets[k] = shingle_sets(raw, np.array([0, len(raw)]))[0]
            return sets[k]

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        found = []
        for v in np.flatnonzero(visits).tolist():
            likely = homes[
                ((signature[homes] == signature[v]).sum(axis=1) >= LEAST_AGREEING) & (part[homes] != part[v])
                & ((bands[homes] == bands[v]).argmax(axis=1) == band)
            ]
            for h in likely.tolist():
                x, y = root(int(part[v])), root(int(part[h]))
                if x == y:
                    continue
                both = np.concatenate([shingles(v), shingles(h)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    parent[max(x, y)] = min(x, y)
                    found.append((int(rep[v]), int(rep[h])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def _crowded_links(crowded: DataFrame, reps: DataFrame, texts: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets that other links have not implied yet.

    A bucket of one component is done.  Of the others, the members outside the
    bucket's largest component visit every block of the bucket, a block of
    visitors at a time: rows grow with members and visits, not with pairs.
    """
    held = _labelled(crowded.select("key", "band", "rep"), "rep", components, "part")
    sizes = held.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("n", (-F.col("part")).alias("minus"))).alias("top"), F.sum("n").alias("n")
    ).where("n > top.n").select(
        "key", (-F.col("top.minus")).alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("home_blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("visit_blocks"),
    )
    held = held.join(mixed, "key")

    def nth(blocks: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    columns = ["key", "band", "rep", "part"]
    homes = held.select(*columns, F.lit(False).alias("visits"), nth("home_blocks", 1).alias("home"), every("visit_blocks").alias("visit"))
    visitors = held.where("part <> main").select(
        *columns, F.lit(True).alias("visits"), every("home_blocks").alias("home"), nth("visit_blocks", 2).alias("visit")
    )
    marks = reps.select(F.col("doc_id").alias("rep"), "bands", "signature")
    rows = homes.unionByName(visitors).join(marks, "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("key", "home", "visit").applyInArrow(_block_links(percent), "a long, b long")


def near_dedup(docs: DataFrame, *, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    1. Each text becomes its shingle set's size, a 128-bit digest, 128 minima
       and 32 band keys; equal sets are one class from here on.
    2. Classes that share a band key are candidates: all pairs of a bucket of up
       to 32 classes, the pairs with the bucket's least class in a larger one.
    3. Signatures, then full sets, confirm the pairs of each class with its least
       and its most similar candidate; components follow.  Only pairs between
       different components are left, and all of these are confirmed likewise;
       those of large buckets are compared in blocks.

    Texts without words, and NULL texts, have ``n_shingles`` 0 and their own
    component.  A NULL ``doc_id`` is linked with nothing, has a NULL component
    and is kept.  Rows with one ``doc_id`` are one document.  Ties go to the
    least ``doc_id``.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = scratch.keep(docs.mapInArrow(_marks, _MARKS))
    filled = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["set_hi", "set_lo", "n_shingles"]
    classes = scratch.keep(filled.groupBy(*digest).agg(F.min("doc_id").alias("rep")))
    reps = filled.join(classes.withColumnRenamed("rep", "doc_id"), [*digest, "doc_id"], "left_semi").dropDuplicates([*digest, "doc_id"])
    bands = reps.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    shared = scratch.keep(bands.join(sizes, "key").select("key", "band", "rep", "n", "leader"))
    crowded = shared.where(F.col("n") > FULL_BUCKET)
    candidates = _ordered(
        _pairs_of_lists(shared.where(F.col("n") <= FULL_BUCKET)).unionByName(
            crowded.select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        )
    )
    likely = scratch.keep(_likely(candidates, reps))

    both = likely.unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "agreeing"))
    chosen = both.groupBy("a").agg(
        F.min("b").alias("least"), F.max(F.struct("agreeing", (-F.col("b")).alias("other"))).alias("best")
    ).select("a", F.explode(F.array("least", -F.col("best.other"))).alias("b"))
    near = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.keep(docs.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    links = scratch.keep(_confirmed(_ordered(chosen), texts, percent))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    components = scratch.keep(connected_components(edges, scratch))

    for more in (
        lambda: _confirmed(_apart(likely, components), texts, percent),
        lambda: _crowded_links(crowded, reps, texts, components, percent),
    ):
        found = scratch.keep(more())
        if not found.isEmpty():
            edges = edges.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
            components = scratch.keep(connected_components(edges, scratch))

    final = scratch.keep(_labelled(classes, "rep", components, "component_id").drop("rep"))
    scratch.clear(marks, final)
    component = F.coalesce("component_id", "doc_id")
    return marks.select("doc_id", *digest).join(final, digest, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component).cast("long").alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )
