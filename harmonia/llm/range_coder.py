"""An adaptive context-mixing range coder for token ids, many lanes of a block side by side.

Every block starts from an empty model, so blocks are independent.  The ids of a
block are dealt to lanes of about LANE_IDS in a row; numpy codes one id of each
lane per step, and all lanes of a block share one model, which learns what they
coded after each step.  All arithmetic is on integers, so every machine decodes
what another has encoded.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

BLOCK_IDS = 1 << 21
LANE_IDS = 256
PAIR_BITS = 18
_HEADER = struct.Struct("<III")  # ids, crc32 of the ids, 32-bit words of the payload
_LANE = np.dtype("<u2")  # 32-bit words of each lane, before the words

_WORD = np.uint64(1 << 32)
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
_ONE = np.uint64(1)

# Weights are out of 512; order 0 always keeps the rest of _MOST.
_SCALE, _MOST, _LEAST = 512, 496, 2
_RATE = 3
# First weights of a guess by how sure it is, and the least ones; index: order-2 certainty * 4 + order-1 certainty.
_FIRST = np.array([0, 75, 188, 300])
_FIRST_2, _FIRST_1 = np.repeat(_FIRST, 4) // 2, np.tile(_FIRST, 4) // 2
_LEASTS = np.stack([np.repeat([0, _LEAST, _LEAST, _LEAST], 4), np.tile([0, _LEAST, _LEAST, _LEAST], 4)])
# Chances of order 0 are out of this, or of eight times the vocabulary; they are set anew when the ids have grown by a sixteenth.
_MASS = 1 << 20
_NEAR_BITS = 3
_NEAR = (1 << _NEAR_BITS) - 1


@lru_cache(maxsize=4)
def _unseen(vocabulary: int) -> tuple[np.ndarray, int]:
    """Chances of ids not seen yet, and their sum: they fall with the id, as merges come by frequency."""
    chances = (1 << 20) // (np.arange(vocabulary) + 2048) + 1
    return chances, int(chances.sum())


class _Model:
    """What each lane expects next: a mixture of three predictions.

    Order 2 and order 1 guess the id last seen after a context, with how sure
    they are; order 0 gives every id its count so far (one for the first, two
    for each further occurrence) and all ids together the number of different
    ones plus one, as their first chances go.  The weights of the guesses are
    learned for each pair of certainties, each moving to its mean share in the
    chance of what came.
    """

    def __init__(self, lanes: int, ids: int, vocabulary: int):
        self.vocabulary, self.pair_bits = vocabulary, min(PAIR_BITS, max(10, ids.bit_length()))
        # Row 0 of what comes in pairs is order 2, row 1 order 1, whose guesses follow those of order 2.
        self.mass = max(_MASS, 1 << (vocabulary.bit_length() + 3))
        # Short numbers wherever all sizes fit them.
        self.kind = np.int32 if self.mass * _SCALE < 1 << 31 else np.int64
        self.table = np.full((1 << self.pair_bits) + vocabulary, vocabulary << 2, self.kind)
        self.at = np.zeros((2, lanes), np.int64)
        self.at[1] = 1 << self.pair_bits
        self.last = np.zeros(lanes, np.int64)
        self.weights = np.stack([_FIRST_2, _FIRST_1])
        self.counts, self.came = np.zeros(vocabulary, np.int64), []
        self.seen, self.next = 0, 0
        self.cumulated = np.zeros(vocabulary + 1, self.kind)

    def _set_chances(self) -> None:
        if self.came:
            self.counts += np.bincount(np.concatenate(self.came), minlength=self.vocabulary)
            self.came = []
        held = np.maximum(2 * self.counts - 1, 0)
        twice, different = 2 * self.seen + 1, int(np.count_nonzero(self.counts))
        left = self.mass - 2 * self.vocabulary
        unseen = left * (different + 1) // twice
        first, whole = _unseen(self.vocabulary)
        chances = first * unseen // whole + 1
        if self.seen:
            chances += held * (left - unseen) // (2 * self.seen - different)
        np.cumsum(chances, out=self.cumulated[1:])
        self.whole = int(self.cumulated[-1])
        self.next = self.seen + max(1, self.seen >> 4)
        # Ids by eighths of places, made when one is looked for.
        self.nearest: np.ndarray | None = None

    def predict(self, k: int) -> int:
        """Prepares the predictions of the first ``k`` lanes; gives the sum of all sizes."""
        if self.seen >= self.next:
            self._set_chances()
        self.held = self.table[self.at[:, :k]]
        self.guess, self.sure = self.held >> 2, self.held & 3
        self.pair = ((self.sure[0] << 2) + self.sure[1]).astype(np.int64)
        self.rest = (_SCALE - self.weights.sum(axis=0)).astype(self.kind)[self.pair]
        self.extra = (self.weights * self.whole).astype(self.kind)[:, self.pair]
        return self.whole * _SCALE

    def size(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids that come."""
        start, end = self.cumulated[ids], self.cumulated[ids + 1]
        ids = ids.astype(self.kind)
        self.hit = self.guess == ids
        before, own = self.extra * (self.guess < ids), self.extra * self.hit
        return self.rest * start + before[0] + before[1], self.rest * (end - start) + own[0] + own[1]

    def find(self, place: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``place``."""
        place = place.astype(self.kind)
        swap = self.guess[0] > self.guess[1]
        starts = self.rest * self.cumulated[self.guess]
        first = np.where(swap, self.extra[1], self.extra[0])
        second = self.extra[0] + self.extra[1] - first
        # What a guess adds comes in front of its id's own chance.
        for begun, added in ((np.minimum(starts[0], starts[1]), first), (np.maximum(starts[0], starts[1]), second)):
            place = place - np.minimum(np.maximum(place - begun, 0), added)
        place = np.minimum(place // self.rest, self.whole - 1)
        if self.nearest is None:
            edges = (self.cumulated + _NEAR) >> _NEAR_BITS
            self.nearest = np.repeat(np.arange(self.vocabulary), np.diff(edges))
        ids = self.nearest[place >> _NEAR_BITS]
        # Every id has a chance, so a few more steps reach the right one.
        beyond = np.flatnonzero(self.cumulated[ids + 1] <= place)
        while len(beyond):
            ids[beyond] += 1
            beyond = beyond[self.cumulated[ids[beyond] + 1] <= place[beyond]]
        return ids

    def learn(self, ids: np.ndarray, size: np.ndarray) -> None:
        k = len(ids)
        order, lane = np.nonzero(self.hit)
        parts = self.extra[order, lane].astype(np.int64) * _MOST // size[lane]
        n = np.bincount(self.pair, minlength=16)
        # Sums of whole numbers below 2**53 are exact.
        sums = np.bincount((order << 4) + self.pair[lane], parts, minlength=32).astype(np.int64).reshape(2, 16)
        moved = np.maximum(self.weights + ((sums // np.maximum(n, 1) - self.weights) >> _RATE), _LEASTS)
        self.weights = np.where(n > 0, moved, self.weights)
        # Of lanes with one context the last one's guess stays.
        kept = np.where(self.sure > 1, self.held - 1, ((ids << 2) + 1).astype(self.kind))
        self.table[self.at[:, :k]] = np.where(self.hit, self.held + (self.sure < 3), kept)
        self.came.append(ids)
        self.seen += k
        self.at[0, :k] = ((ids * 0x9E3779B1 + self.last[:k] * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - self.pair_bits)
        self.at[1, :k] = ids + (1 << self.pair_bits)
        self.last[:k] = ids


class _Ranges:
    """Low end and width of the interval of each lane; the width is at least 2**32 before each use."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, k: int, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low[:k] += unit * start.astype(np.uint64)
        self.width[:k] = unit * size.astype(np.uint64)

    def settle(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Lanes whose first 32 bits are settled, and these bits; an interval across a border is cut at it."""
        lanes = np.flatnonzero(self.width[:k] < _WORD)
        low, width = self.low[lanes], self.width[lanes]
        across = ((low ^ (low + width - _ONE)) >> _SHIFT) != 0
        width = np.where(across, _WORD - (low & _LOW), width)
        self.low[lanes], self.width[lanes] = low << _SHIFT, width << _SHIFT
        return lanes, (low >> _SHIFT).astype(np.uint32)


def _shape(n: int) -> tuple[int, int]:
    """Lanes of a block and ids of each but the last."""
    steps = -(-n // max(1, n // LANE_IDS))
    return -(-n // steps), steps


def _encode(block: np.ndarray, vocabulary: int) -> bytes:
    n = len(block)
    if not n:
        return b""
    lanes, steps = _shape(n)
    ids = np.zeros(lanes * steps, np.int64)
    ids[:n] = block
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    short = n - (lanes - 1) * steps
    words, used = np.zeros((lanes, steps + 1), np.uint32), np.zeros(lanes, np.int64)
    model, ranges = _Model(lanes, n, vocabulary), _Ranges(lanes)
    for step in range(steps):
        k = lanes if step < short else lanes - 1
        now = ids[step, :k]
        total = model.predict(k)
        start, size = model.size(now)
        ranges.narrow(k, ranges.width[:k] // np.uint64(total), start, size)
        settled, found = ranges.settle(k)
        words[settled, used[settled]] = found
        used[settled] += 1
        model.learn(now, size)
    # The interval is wider than 2**32, so 32 bits name a place in it.
    words[np.arange(lanes), used] = ((ranges.low + _LOW) >> _SHIFT).astype(np.uint32)
    used += 1
    held = words[np.arange(steps + 1) < used[:, None]]
    return used.astype(_LANE).tobytes() + held.astype("<u4").tobytes()


def _decode(n: int, used: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    lanes, steps = _shape(n)
    held = np.zeros((lanes, int(used.max()) + 2), np.uint64)
    held[np.arange(held.shape[1]) < used[:, None]] = words
    code = (held[:, 0] << _SHIFT) | held[:, 1]
    at = np.full(lanes, 2, np.int64)
    short = n - (lanes - 1) * steps
    ids = np.zeros((steps, lanes), np.uint32)
    model, ranges = _Model(lanes, n, vocabulary), _Ranges(lanes)
    for step in range(steps):
        k = lanes if step < short else lanes - 1
        total = model.predict(k)
        unit = ranges.width[:k] // np.uint64(total)
        place = np.minimum((code[:k] - ranges.low[:k]) // unit, np.uint64(total - 1)).view(np.int64)
        now = model.find(place)
        start, size = model.size(now)
        ranges.narrow(k, unit, start, size)
        settled, _ = ranges.settle(k)
        code[settled] = (code[settled] << _SHIFT) | held[settled, np.minimum(at[settled], held.shape[1] - 1)]
        at[settled] += 1
        ids[step, :k] = now
        model.learn(now, size)
    return ids.T.reshape(-1)[:n]


def encode_blocks(parts: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block with its length, checksum and size in front."""
    found = []
    for part in parts:
        lanes = _shape(len(part))[0] if len(part) else 0
        coded = _encode(part, vocabulary)
        check = zlib.crc32(part.astype("<u4").tobytes())
        found.append(_HEADER.pack(len(part), check, (len(coded) - lanes * _LANE.itemsize) // 4) + coded)
    return found


def decode(payloads: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """Ids of each payload, which is any number of blocks one after another; wrong checksums raise."""
    found = []
    for payload in payloads:
        at, parts = 0, [np.zeros(0, np.uint32)]
        while at < len(payload):
            n, check, size = _HEADER.unpack_from(payload, at)
            lanes = _shape(n)[0] if n else 0
            at += _HEADER.size
            used = np.frombuffer(payload, _LANE, lanes, at).astype(np.int64)
            at += lanes * _LANE.itemsize
            if used.sum() != size:
                raise ValueError("the sizes of a block's lanes are wrong")
            ids = _decode(n, used, np.frombuffer(payload, "<u4", size, at), vocabulary)
            at += 4 * size
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum is wrong")
            parts.append(ids)
        found.append(np.concatenate(parts))
    return found
