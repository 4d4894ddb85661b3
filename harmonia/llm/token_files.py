"""Token ids in compressed files, in the order of document ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harmonia.llm import bytetext as bt
from harmonia.llm import range_coder
from harmonia.llm.tokens import BYTE_BPE, encoder, tokenizer_path, with_ends

# A frame is a row of a file: whole documents of about so many ids, in independent blocks.
FRAME_IDS = 1 << 21

_FRAME = "part long, frame long, before long, n_ids long, vocabulary int, doc_ids array<long>, lengths array<long>, payload binary"
_DOC = "part long, doc_id long, within long, n_tokens long, ids_crc32 long"


class _Frames:
    """Frames of one part, in order: documents are held until they fill one, whatever batches they come in."""

    def __init__(self, part: int, vocabulary: int):
        self.part, self.vocabulary, self.frame, self.before = part, vocabulary, 0, 0
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.held = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The frames that are full now: each ends with the document that fills it."""
        bounds, low = np.concatenate([[0], np.cumsum(lengths)]), 0
        while low < len(lengths):
            high = min(len(lengths), int(np.searchsorted(bounds, bounds[low] + FRAME_IDS - self.held)))
            self.ids.append(ids[bounds[low]:bounds[high]])
            self.lengths.append(lengths[low:high])
            self.doc_ids.append(doc_ids.slice(low, high - low))
            self.held, low = self.held + int(bounds[high] - bounds[low]), high
            if self.held >= FRAME_IDS:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held, as a frame of blocks that end with it."""
        if not self.lengths:
            return
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        # What the last document adds makes no short block of its own.
        blocks = np.array_split(ids, max(1, round(len(ids) / range_coder.BLOCK_IDS)))
        payload = b"".join(range_coder.encode_blocks(blocks, self.vocabulary))
        doc_ids, n = pa.concat_arrays(self.doc_ids), len(ids)
        self.ids, self.lengths, self.doc_ids, self.held = [], [], [], 0
        yield pa.record_batch(
            {
                "part": pa.array([self.part], pa.int64()), "frame": pa.array([self.frame], pa.int64()),
                "before": pa.array([self.before], pa.int64()), "n_ids": pa.array([n], pa.int64()),
                "vocabulary": pa.array([self.vocabulary], pa.int32()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), doc_ids),
                "lengths": bt.ragged(lengths, np.array([len(lengths)]), pa.int64()), "payload": pa.array([payload], pa.binary()),
            }
        )
        self.frame, self.before = self.frame + 1, self.before + n


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path, True)
        frames = _Frames(TaskContext.get().partitionId(), held.tokenizer.get_vocab_size())
        for batch in batches:
            for low, high, data, offsets in bt.text_chunks(batch.column(1)):
                ids, bounds = with_ends(*held.encode(data, offsets))
                yield from frames.add(batch.column(0).slice(low, high - low), ids, np.diff(bounds))
        yield from frames.rest()

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = range_coder.decode(batch.column("payload").to_pylist(), batch.column("vocabulary")[0].as_py())
        parts, befores = batch.column("part").to_pylist(), batch.column("before").to_pylist()
        for k, ids in enumerate(found):
            doc_ids, lengths = batch.column("doc_ids")[k].values, batch.column("lengths")[k].values.to_numpy()
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            view, at = memoryview(ids.astype("<u4").tobytes()), (bounds * 4).tolist()
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(len(lengths), parts[k], np.int64)), "doc_id": doc_ids,
                    "within": pa.array(befores[k] + bounds[:-1]), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                }
            )


def write_ids(docs: DataFrame, folder: str, *, path: str | None = None) -> None:
    """Writes the ids of every row of ``docs`` (``doc_id, text``) in ascending ``doc_id`` order.

    Texts are dealt by ranges of the id; each task encodes its own, adds an end
    id to each, and writes frames: whole documents, their ids and lengths, and
    blocks of ids that the range coder has packed.  Parquet holds the frames, so
    any store that Spark writes to will do and a lost task leaves nothing behind.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    frames = ordered.mapInArrow(_writer(path or tokenizer_path(BYTE_BPE)), _FRAME)
    # The payload is packed already.
    frames.write.option("compression", "uncompressed").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, from the decoded ids.

    ``start`` counts the ids of all documents before: those of earlier parts,
    of earlier frames, and of earlier documents of the frame.
    """
    frames = spark.read.schema(_FRAME).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file part, so the window and the broadcast are bounded by the number of tasks.
    bases = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return frames.mapInArrow(_read, _DOC).join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_ids(docs: DataFrame, folder: str, *, path: str | None = None) -> DataFrame:
    """Writes the ids and reads the files back: see :func:`write_ids` and :func:`read_ids`.

    NULL and empty texts are one end id; NULL ids come first; rows with one id
    follow one another by a hash of their text.  Other columns are not read.
    """
    write_ids(docs, folder, path=path)
    return read_ids(docs.sparkSession, folder)
