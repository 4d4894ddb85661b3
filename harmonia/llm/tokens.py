"""Token ids of many texts: the tokenizers library once per distinct piece of text."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from harmonia.llm import bytetext as bt

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 0
# Pieces given to the library at once: what it returns takes over a kilobyte each.
ENCODED_AT_ONCE = 4096
# Pieces of a row that the library is given as one text.
IN_A_ROW = 256
# Pieces a worker remembers before it starts afresh (about 40 bytes each).
REMEMBERED = 1_500_000
_PLACE_BITS = 22
# Ids of remembered pieces; texts without white space are single pieces with many.
REMEMBERED_IDS = 8_000_000

_PLAIN = bt.NOT_SPACE.copy()
_PLAIN[0x80:] = False
_PLAIN[0x1C:0x20] = False
# Lead bytes whose characters hold no white space.
_TWO_BYTE = np.zeros(256, dtype=bool)
_TWO_BYTE[0xC3:0xE0] = True
_SAFE_NEXT = _PLAIN | _TWO_BYTE
_SAFE_NEXT[0xE4:] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Letters and digits of ASCII, and marks that never share a token with the one before.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True

Pieces = tuple[np.ndarray, np.ndarray, np.ndarray]


def _marks_apart(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Pieces:
    """Cuts pieces once more between an ASCII letter or digit and the mark after it: both tokenizers do."""
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _MARK[data[1:]] & _ALNUM[data[:-1]]
    cut[offsets[offsets < len(data)]] = False
    inner = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([starts, inner]))
    return starts, np.sort(np.concatenate([ends, inner])), np.searchsorted(starts, offsets)


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Pieces of a tokenizer that drops white space: words, and the marks after them."""
    starts, ends, _ = bt.find_words(data, offsets, bt.NOT_SPACE)
    return _marks_apart(data, offsets, starts, ends)


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Pieces of a tokenizer that keeps white space with the word after it.

    A text is cut before one white-space byte that stands between two characters
    known not to be white space; elsewhere pieces just stay longer.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n, dtype=bool)
    before = _PLAIN[data[:-2]]
    before[1:] |= (data[1:-2] >= 0x80) & _TWO_BYTE[data[:-3]]
    cut[1:-1] = bt.SPACE[data[1:-1]] & before & _SAFE_NEXT[data[2:]]
    filled = offsets[:-1][np.diff(offsets) > 0]
    # Neighbours must belong to the same text: its first two and its last byte are never cut.
    ends = np.append(filled[1:], n)
    for at in (filled, filled + 1, ends - 1):
        cut[at[at < n]] = False
    cut[filled] = True
    starts = np.flatnonzero(cut)
    return _marks_apart(data, offsets, starts, np.append(starts[1:], n))


class PieceEncoder:
    """Ids of whole texts, piece by piece; ids of distinct pieces are remembered by a 64-bit hash.

    The memory has a place for each value of a hash's first bits; a piece takes the place of another one there.
    """

    def __init__(self, path: str, pieces: Callable[[np.ndarray, np.ndarray], Pieces], lower: bool = False):
        """``lower``: the tokenizer lower-cases, so pieces that differ in that are one."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pieces, self.lower = Tokenizer.from_file(path), pieces, lower
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A tokenizer of bytes starts anew at every blank, and its tokens have a character for each byte.
        before = self.tokenizer.pre_tokenizer
        self.sizes = None
        if isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and not self.tokenizer.normalizer:
            known = range(self.tokenizer.get_vocab_size())
            self.sizes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in known], np.int64)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << _PLACE_BITS, np.uint64)
        # The key 0 belongs to the first place, so that one must not seem to hold it.
        self.keys[0] = ~np.uint64(0)
        self.first, self.counts = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32)
        self.ids, self.used, self.learned = np.zeros(1 << 16, np.uint32), 0, 0

    def _add(self, new: np.ndarray) -> None:
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(new)] = new
        self.used += len(new)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of pieces.

        Pieces that begin with one blank and end with none are given to the
        library in rows, which are parted by the bytes of the ids.
        """
        raw, lengths = data.tobytes(), ends - starts
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        first, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        in_rows = np.zeros(len(starts), bool)
        if self.sizes is not None:
            before, last = data[np.maximum(ends - 2, 0)], data[ends - 1]
            in_rows = (lengths > 2) & bt.SPACE[data[starts]] & _SAFE_NEXT[data[np.minimum(starts + 1, len(data) - 1)]]
            in_rows &= _PLAIN[last] | ((last >= 0x80) & _TWO_BYTE[before])
        rows, alone = np.flatnonzero(in_rows), [np.flatnonzero(~in_rows)]
        for a in range(0, len(rows), ENCODED_AT_ONCE):
            groups = [rows[b:b + IN_A_ROW] for b in range(a, min(a + ENCODED_AT_ONCE, len(rows)), IN_A_ROW)]
            texts = [b"".join([raw[slice(*spans[k])] for k in group.tolist()]).decode() for group in groups]
            for group, text, found in zip(groups, texts, self._encoded(texts), strict=True):
                ids, bounds = np.array(found, np.uint32), np.cumsum(lengths[group])
                at = np.cumsum(self.sizes[ids])
                last = np.minimum(np.searchsorted(at, bounds), len(at) - 1)
                if any(x in text for x in self.special) or (at[last] != bounds).any():
                    alone.append(group)
                    continue
                counts[group] = np.diff(last, prepend=-1)
                first[group] = self.used + last + 1 - counts[group]
                self._add(ids)
        rest = np.concatenate(alone)
        for a in range(0, len(rest), ENCODED_AT_ONCE):
            group = rest[a:a + ENCODED_AT_ONCE]
            found = self._encoded([raw[slice(*spans[k])].decode() for k in group.tolist()])
            counts[group] = [len(x) for x in found]
            first[group] = self.used + np.cumsum(counts[group]) - counts[group]
            self._add(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[group].sum())))
        self.learned += len(starts)
        return first, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        starts, ends, bounds = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = bt.word_hashes(bt.LOWER[data] if self.lower else data, starts, ends)
        if self.learned > REMEMBERED or self.used > REMEMBERED_IDS:
            self.forget()
        place = (hashes >> np.uint64(64 - _PLACE_BITS)).view(np.int64)
        first, counts = self.first[place].astype(np.int64), self.counts[place].astype(np.int64)
        unknown = np.flatnonzero(self.keys[place] != hashes)
        if len(unknown):
            keys, example, which = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            spans = unknown[example]
            new_first, new_counts = self._learn(data, starts[spans], ends[spans])
            first[unknown], counts[unknown] = new_first[which], new_counts[which]
            place = (keys >> np.uint64(64 - _PLACE_BITS)).view(np.int64)
            self.keys[place], self.first[place], self.counts[place] = keys, new_first, new_counts
        total = np.concatenate([[0], np.cumsum(counts)])
        index = np.arange(total[-1]) + np.repeat(first - total[:-1], counts)
        return self.ids[index], total[bounds]


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path, spaced_pieces) if spaced else PieceEncoder(path, word_pieces, lower=True)


def with_ends(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with END_ID after each text, and the new bounds."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], END_ID), bounds + np.arange(n + 1)
