"""N-gram counts of texts, normalised on the way, in Arrow batches: numpy over integer codes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from harmonia.fixed_values import NGRAM_SIZES
from harmonia.functions.text import folded_chars

# Characters handled at once; a longer text is counted piece by piece.
PIECE_CHARS = 1 << 20
# Letters and digits are the digits 1 to 36 of a number, so n-grams of all sizes differ.
BASE = 37
_SHIFT = 27  # BASE ** 5 < 2 ** 27
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ord("0"):ord("9") + 1] = np.arange(1, 11)
_DIGIT[ord("a"):ord("z") + 1] = np.arange(11, 37)


@lru_cache(maxsize=1)
def _forms() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `normalize` leaves of each code point: where it begins in a row of bytes, how many they are, and the row."""
    forms = {code: chr(code).lower() for code in range(0x80) if re.match("[A-Za-z0-9]", chr(code))}
    forms |= {ord(char): re.sub("[^a-z0-9]", "", folded.lower()) for char, folded in folded_chars().items()}
    first, size, held = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.uint8), bytearray()
    for code, form in forms.items():
        first[code], size[code] = len(held), len(form)
        held += form.encode()
    return first, size, np.frombuffer(bytes(held), np.uint8)


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`normalize` of texts in UTF-8, one after another."""
    first, size, held = _forms()
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero((data[at] >= least) & (data[at] < (0xE0, 0xF0, 0xF8)[more - 1]))
        value = data[at[wide]].astype(np.int32) & mask
        for k in range(1, more + 1):
            value = (value << 6) | (padded[at[wide] + k] & 0x3F)
        code[wide] = np.minimum(value, 0x10FFFF)
    sizes = size[code]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    bounds = ends[np.searchsorted(at, offsets)]
    if len(sizes) and sizes.max() > 1:
        index = np.repeat(first[code] - ends[:-1], sizes) + np.arange(ends[-1])
    else:
        index = first[code[sizes > 0]]
    return held[index], bounds


def _normalized_long(data: np.ndarray) -> np.ndarray:
    """`normalized` of one long text, piece by piece."""
    found, low = [], 0
    while low < len(data):
        high = min(len(data), low + PIECE_CHARS)
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        found.append(normalized(data[low:high], np.array([0, high - low]))[0])
        low = high
    return np.concatenate(found)


def _codes(digits: np.ndarray, ends: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of each size: n-grams that begin in the first ``starts`` places and end by ``ends[place]``."""
    for size in NGRAM_SIZES:
        n = min(starts, len(digits) - size + 1)
        if n <= 0:
            continue
        code = digits[:n].copy()
        for k in range(1, size):
            code *= BASE
            code += digits[k:k + n]
        inside = np.arange(n) + size <= ends[:n]
        yield np.flatnonzero(inside), code[inside]


def _of_many(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of several short texts."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(offsets[1:], lengths)
    keys = [(owner[at] << _SHIFT) | code for at, code in _codes(_DIGIT[data], ends, len(data))]
    found, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return found >> _SHIFT, found & ((1 << _SHIFT) - 1), n


def _of_one(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of one long text; memory is bounded by a piece and the distinct n-grams."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    overlap = max(NGRAM_SIZES) - 1
    for at in range(0, len(data), PIECE_CHARS):
        piece = _DIGIT[data[at:at + PIECE_CHARS + overlap]]
        ends = np.full(len(piece), len(piece))
        for _, code in _codes(piece, ends, PIECE_CHARS):
            new, n = np.unique(code, return_counts=True)
            codes, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
    return codes, counts


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, what `normalize` leaves of them one after another, bounds) of the texts that are not empty then; a long one is alone."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + PIECE_CHARS, side="right")) - 1
        high = min(len(column), max(high, low + 1))
        raw = data[offsets[low]:offsets[high]]
        if len(raw) > PIECE_CHARS:
            part = _normalized_long(raw)
            bounds = np.array([0, len(part)])
        else:
            part, bounds = normalized(raw, offsets[low:high + 1] - offsets[low])
        filled = np.flatnonzero(np.diff(bounds))
        yield low + filled, part, np.concatenate([[0], bounds[filled + 1]])
        low = high


def _marks(part: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(part[a:b]).digest() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())


def packer(kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for every text of batches of ``kept`` columns and a text: the columns, codes, n and digest.

    Texts that are empty once normalised have no row; one below the smallest size has one code, its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, bounds in _pieces(batch.column(kept)):
                if len(part) > PIECE_CHARS and len(rows) == 1:
                    codes, n = _of_one(part)
                    owner = np.zeros(len(codes), np.int64)
                else:
                    owner, codes, n = _of_many(part, bounds)
                    short = np.flatnonzero(np.diff(bounds) < min(NGRAM_SIZES))
                    if len(short):
                        own = [sum(int(_DIGIT[b]) * BASE**k for k, b in enumerate(part[bounds[i]:bounds[i + 1]][::-1])) for i in short]
                        order = np.argsort(np.concatenate([owner, short]), kind="stable")
                        owner = np.concatenate([owner, short])[order]
                        codes = np.concatenate([codes, np.array(own, np.int64)])[order]
                        n = np.concatenate([n, np.ones(len(short), np.int64)])[order]
                lengths = np.bincount(owner, minlength=len(rows))
                yield pa.record_batch(
                    [*(batch.column(k).take(pa.array(rows)) for k in range(kept)), _lists(codes, lengths), _lists(n, lengths), _marks(part, bounds)],
                    names=[*batch.schema.names[:kept], "codes", "n", "digest"],
                )

    return pack


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column and the digest of the text in the second."""
    for batch in batches:
        for rows, part, bounds in _pieces(batch.column(1)):
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), _marks(part, bounds)], names=[batch.schema.names[0], "digest"])


# Distinct codes that a task counts before it passes them on.
HELD_CODES = 1 << 22


def count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of a task each code of a list column stands."""
    codes, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    waiting, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, count = np.unique(np.concatenate(waiting), return_counts=True)
        found, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return found, np.bincount(place, weights=np.concatenate([n, count]), minlength=len(found)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        return pa.record_batch({"code": pa.array(codes, pa.int32()), "df": pa.array(n, pa.int64())})

    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        waiting.append(flat)
        size += len(flat)
        if size > HELD_CODES:
            codes, n = merged()
            waiting, size = [], 0
            if len(codes) > HELD_CODES:
                yield rows()
                codes, n = codes[:0], n[:0]
    if waiting:
        codes, n = merged()
    yield rows()


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``count_codes`` and the digests of a column of texts, without their packed rows: code, digest, df; one of the first two is null."""
    marks: list[pa.Array] = []

    def codes() -> Iterator[pa.RecordBatch]:
        for packed in packer(0)(batches):
            marks.append(packed.column("digest"))
            yield packed.select(["codes"])

    def rows(code: pa.Array, digest: pa.Array, df: pa.Array) -> pa.RecordBatch:
        return pa.record_batch({"code": code, "digest": digest, "df": df})

    for found in count_codes(codes()):
        yield rows(found.column("code"), pa.nulls(len(found), pa.binary()), found.column("df"))
        for held in marks:
            yield rows(pa.nulls(len(held), pa.int32()), held, pa.array(np.ones(len(held), np.int64)))
        marks.clear()
