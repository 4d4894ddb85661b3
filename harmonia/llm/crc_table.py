"""CRC-32 of many byte spans at once, from a table by byte and distance from the span's end.

The checksum is affine over GF(2): that of a span is the XOR of what each byte
adds, which depends only on the byte and its distance from the end, and of a
constant for the span's length.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

# Distances that the table holds; longer spans are folded from blocks of this size.
REACH = 128
# Bytes of long spans handled at once.
SLICE = 1 << 16
_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    """The register after each single byte: eight shifts with the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_STEP = _byte_steps()


def _contributions() -> np.ndarray:
    """What a byte adds when so many bytes follow it; flat, at ``distance * 256 + byte``."""
    rows = [_STEP]
    for _ in range(REACH - 1):
        rows.append(_STEP[rows[-1] & 0xFF] ^ (rows[-1] >> np.uint32(8)))
    return np.concatenate(rows)


TABLE = _contributions()
# The checksum of so many zero bytes: what a length adds by itself.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


@cache
def _advance(power: int) -> np.ndarray:
    """Tables (4 x 256) of the register moved on by ``REACH << power`` zero bytes."""
    if power:
        return moved(_advance(power - 1), _advance(power - 1))
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(REACH):
        table = _STEP[table & 0xFF] ^ (table >> np.uint32(8))
    return table


def moved(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Registers moved on by the zero bytes that ``tables`` stand for."""
    return (
        tables[0][value & 0xFF] ^ tables[1][(value >> np.uint32(8)) & 0xFF]
        ^ tables[2][(value >> np.uint32(16)) & 0xFF] ^ tables[3][value >> np.uint32(24)]
    )


def _zeros_constant(length: int) -> np.uint32:
    """The checksum of ``length`` zero bytes."""
    blocks, rest = divmod(length, REACH)
    value = np.uint32(0xFFFFFFFF)
    for _ in range(rest):
        value = _STEP[value & 0xFF] ^ (value >> np.uint32(8))
    power = 0
    while blocks:
        if blocks & 1:
            value = moved(_advance(power), np.array([value], np.uint32))[0]
        blocks >>= 1
        power += 1
    return np.uint32(value ^ np.uint32(0xFFFFFFFF))


def folded(span: np.ndarray) -> int:
    """Checksum of one span of any length.

    Zero bytes in front add nothing, so the span is filled up to whole blocks;
    each block is reduced by the table, and neighbours are then joined in
    rounds, the left one moved on by the right one's bytes.
    """
    if not len(span):
        return 0
    blocks = -(-len(span) // REACH)
    places = (np.arange(REACH - 1, -1, -1, dtype=np.int32) << 8)
    per_slice = max(1, SLICE // REACH)
    value = np.zeros(1 << (blocks - 1).bit_length(), np.uint32)
    first, short = len(value) - blocks, blocks * REACH - len(span)
    for low in range(0, blocks, per_slice):
        high = min(blocks, low + per_slice)
        piece = span[max(0, low * REACH - short):high * REACH - short]
        if low == 0 and short:
            piece = np.concatenate([np.zeros(short, np.uint8), piece])
        at = places + piece.reshape(-1, REACH)
        value[first + low:first + high] = np.bitwise_xor.reduce(TABLE[at], axis=1)
    power = 0
    while len(value) > 1:
        value = moved(_advance(power), value[0::2]) ^ value[1::2]
        power += 1
    return int(value[0] ^ _zeros_constant(len(span)))


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of the words ``data[starts:ends]`` and of each word, one space and the word after it.

    The words do not overlap and none is empty.  The second array has one entry
    for each word but the last.  In a pair, the second word adds what it adds by
    itself and the first word's bytes add from further back.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    lengths = (ends - starts).astype(np.int32)
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
    distance = np.repeat((ends - 1).astype(np.int64), lengths) - at
    inside = data[at].astype(np.int32)
    mask = REACH - 1
    own = np.bitwise_xor.reduceat(TABLE[((distance.astype(np.int32) & mask) << 8) | inside], first)
    words = own ^ ZEROS[np.minimum(lengths, REACH)]
    long_words = np.flatnonzero(lengths > REACH)
    for k in long_words.tolist():
        words[k] = folded(data[starts[k]:ends[k]])
    after = np.zeros(n, np.int32)
    after[:-1] = lengths[1:] + 1
    distance = (distance + np.repeat(after, lengths)).astype(np.int32)
    before = np.bitwise_xor.reduceat(TABLE[((distance & mask) << 8) | inside], first)[:-1]
    space = TABLE[((lengths[1:] & mask) << 8) | 0x20]
    both = lengths[:-1] + lengths[1:] + 1
    pairs = before ^ space ^ own[1:] ^ ZEROS[np.minimum(both, REACH)]
    for k in np.flatnonzero(both > REACH).tolist():
        pairs[k] = folded(np.concatenate([data[starts[k]:ends[k]], np.array([0x20], np.uint8), data[starts[k + 1]:ends[k + 1]]]))
    return words, pairs
