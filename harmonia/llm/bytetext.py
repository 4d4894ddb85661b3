"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes handled at once (about 50 times as much memory); a longer text is handled alone.
CHUNK_BYTES = 1 << 20
POSITIONS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers, the same on every machine."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


# A random number for each place in a word and byte value.
_PLACE = constants(POSITIONS * 256, 101)
_ORDER = constants(64, 103)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

# a-z, 0-9 and everything outside ASCII; texts are lower-cased before.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[ord("0"):ord("9") + 1] = True
ALPHANUMERIC[ord("a"):ord("z") + 1] = True
ALPHANUMERIC[0x80:] = True


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of a text column; NULL reads as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def word_border(data: np.ndarray, at: int, table: np.ndarray, step: int = 1 << 16) -> int:
    """The first place from ``at`` on that is outside ``table``, or the end; only the bytes up to it are looked at."""
    while at < len(data):
        outside = np.flatnonzero(~table[data[at:at + step]])
        if len(outside):
            return at + int(outside[0])
        at += step
    return len(data)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of ``table`` bytes, and each text's first word number.

    Runs end with their text.  The third array has one entry more than there are texts.
    """
    inside = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.empty_like(inside)
    first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
    last = np.empty_like(inside)
    last[-1], last[:-1] = inside[-1], inside[:-1] & ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (tabulation by place, folded beyond 64 bytes)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    bytes_ = data[np.repeat(starts, lengths) + place]
    value = _PLACE[((place & (POSITIONS - 1)) << 8) | bytes_]
    if int(lengths.max()) > POSITIONS:
        far = np.flatnonzero(place >= POSITIONS)
        value[far] *= mix(place[far].astype(np.uint64) >> np.uint64(6)) | np.uint64(1)
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _LENGTH)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text number of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gram_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of one text, and the number of each one's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += words[k:k + n] * _ORDER[k]
    owner = owners(bounds)
    at = np.flatnonzero(owner[:n] == owner[size - 1:])
    return mix(value[at] + np.uint64(size)), at


def long_gram_hashes(words: np.ndarray, bounds: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words (64 at most) that begin at the places ``at`` and end in the same text, and these places."""
    at = at[at + size <= bounds[np.searchsorted(bounds, at, side="right")]]
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value += words[at + k] * _ORDER[k]
    return mix(value + np.uint64(size)), at


def span_counts(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted positions ``at`` lie in each text."""
    return np.diff(np.searchsorted(at, bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the given spans; empty spans give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
