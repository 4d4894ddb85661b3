"""Best-fit packing of tokenised documents with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm.tokens import WORD_BPE, encoder, tokenizer_path, with_ends

CAPACITY = 2048
OPEN_BINS = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bins with room, found through a bitset: bit ``f`` is set while a bin with ``f`` free places is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, place in it) for a piece: the open bin that it fills best, or a new one.

        When as many bins are open as may be, the fullest closes first.
        """
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.capacity - free


def _cutter(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, False).encode
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                ids, bounds = with_ends(*encode(data, offsets))
                lengths = np.diff(bounds)
                pieces = -(-lengths // capacity)
                owner = np.repeat(np.arange(high - low), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, lengths[owner] - start)
                raw, at = ids.astype("<u4").tobytes(), (bounds[owner] + start) * 4
                view = memoryview(raw)
                sums = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(low, high - low).take(pa.array(owner)),
                        "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    return cut


def _packer(capacity: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, limit)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    return pack


def pack(
    docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Pieces of every row of ``docs`` (``doc_id, text``) and their places in sequences.

    A document is its token ids and an end id; only one longer than ``capacity``
    is cut.  Pieces are dealt by a hash over partitions, put in the order of the
    hash (so that a repeated task packs alike) and packed there one by one: the
    open bin that a piece fills best takes it; at most ``open_bins`` are open in
    a task, and the fullest closes first.

    NULL and empty texts are one end id.  Repeated rows are packed each; a NULL
    ``doc_id`` is carried through.  Other columns are not read.
    """
    path = path or tokenizer_path(WORD_BPE)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = narrow.mapInArrow(_cutter(path, capacity), _PIECES)
    dealt = pieces.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition("deal")
    ordered = dealt.sortWithinPartitions("deal", "doc_id", "piece", "length", "ids_crc32").drop("deal")
    return ordered.mapInArrow(_packer(capacity, open_bins), f"{_PIECES}, sequence_id long, offset long")
