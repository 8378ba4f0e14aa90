"""Ids of the pieces of texts, looked up many at once.

Texts are cut before single spaces between visible characters, where a byte-level pre-tokenizer always
cuts. A piece of at most ``SHORT`` bytes and its length fill two 64-bit words; these are compared with
an open-addressing table held in numpy arrays, so one step looks up thousands of pieces, exactly.
Longer pieces are kept in a dict. A piece that is in neither is resolved, and kept while there is room.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

SHORT = 15
#: Pieces looked up in one step.
STEP = 1 << 16
_BITS = 22
#: Pieces kept by a worker: a third of the places of its table; their ids; and the bytes of the longest.
KEPT, KEPT_IDS, KEPT_BYTES = (1 << _BITS) // 3, 1 << 24, 64
_U = np.uint64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_SPACE = 32
_byte = np.arange(256)
_VISIBLE = (_byte > 0x20) & (_byte < 0x7F)
#: First bytes of two-byte characters, none of which is white space.
_TWO_BYTES = (_byte >= 0xC3) & (_byte <= 0xDF)
_OPENS = _VISIBLE | _TWO_BYTES


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, padded to whole words and two more, and the edges of the texts."""
    whole = column.fill_null("").cast(pa.large_string())
    _, edges, data = whole.buffers()
    edges = np.frombuffer(edges, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    n = int(edges[-1] - edges[0])
    padded = np.zeros((n // 8 + 3) * 8, np.uint8)
    if n:
        padded[:n] = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    return padded, edges - edges[0]


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pieces start. All but the first of a text start with their space."""
    n = int(edges[-1])
    starts = np.zeros(n + 1, bool)
    starts[edges] = True
    at = np.flatnonzero(data[:n] == _SPACE)
    at = at[~(starts[at] | starts[at + 1])]  # neither the first nor the last byte of a text
    before = data[at - 1]
    closes = _VISIBLE[before] | ((before >= 0x80) & _TWO_BYTES[data[np.maximum(at - 2, 0)]])
    starts[at[closes & _OPENS[data[at + 1]]]] = True
    return np.flatnonzero(starts[:n])


class PieceTable:
    """``resolve`` gives the ids of a piece as little-endian unsigned 32-bit integers."""

    def __init__(self, resolve: Callable[[str], bytes], kept: int = KEPT):
        self.resolve, self.kept = resolve, min(kept, KEPT)
        self.key0, self.key1 = np.zeros(1 << _BITS, _U), np.zeros(1 << _BITS, _U)  # a free place has key1 0
        self.entry = np.zeros(1 << _BITS, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])  # entry e has the ids from ends[e] to ends[e + 1]

    def _add(self, ids: bytes) -> int:
        self.ids.frombytes(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    @property
    def entries(self) -> int:
        return len(self.ends) - 1

    def _forget(self, entries: int) -> None:
        del self.ends[entries + 1 :]
        del self.ids[self.ends[-1] :]

    @staticmethod
    def _word(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The eight bytes from each start on."""
        at, shift = starts >> 3, ((starts & 7) << 3).astype(_U)
        return (words.take(at) >> shift) | ((words.take(at + 1) << _U(1)) << (_U(63) - shift))

    def _look(self, words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries of pieces, -1 for unknown ones, and their keys and places."""
        key0 = self._word(words, starts) & _MASKS.take(np.minimum(size, 8))
        key1 = self._word(words, starts + 8) & _MASKS.take(np.clip(size - 8, 0, 7))
        key1 |= size.astype(_U) << _U(56)
        place = (key0 ^ (key1 * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
        place = (((place ^ (place >> _U(32))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - _BITS)).astype(np.int64)
        there = self.key1.take(place)
        same = (there == key1) & (self.key0.take(place) == key0)
        found = np.where(same & (size <= SHORT), self.entry.take(place), np.int32(-1))
        rest = np.flatnonzero(~same & (there != 0))
        while len(rest):
            place[rest] = (place[rest] + 1) & ((1 << _BITS) - 1)
            at = place[rest]
            there = self.key1[at]
            same = (there == key1[rest]) & (self.key0[at] == key0[rest])
            hit = same & (size[rest] <= SHORT)
            found[rest[hit]] = self.entry[at[hit]]
            rest = rest[~same & (there != 0)]
        return found, key0, key1, place

    def _resolve(self, raw: bytes, starts: np.ndarray, size: np.ndarray, found: np.ndarray, key0: np.ndarray,
                 key1: np.ndarray, place: np.ndarray) -> int:
        """Settles the pieces that were not found. Entries from the returned number on are for this step only."""
        fresh: dict[bytes, int] = {}
        passing: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(found < 0).tolist():
            piece = raw[starts[i] : starts[i] + size[i]]
            own = self.long if len(piece) > SHORT else fresh
            e = own.get(piece, -1)
            if e < 0:
                if len(self.ends) > self.kept or len(self.ids) >= KEPT_IDS or len(piece) > KEPT_BYTES:
                    passing.setdefault(piece, []).append(i)
                    continue
                own[piece] = e = self._add(self.resolve(piece.decode()))
                if own is fresh:
                    at = int(place[i])
                    while self.key1[at]:
                        at = (at + 1) & ((1 << _BITS) - 1)
                    self.key0[at], self.key1[at], self.entry[at] = key0[i], key1[i], e
            found[i] = e
        kept = self.entries
        for piece, where in passing.items():
            found[where] = self._add(self.resolve(piece.decode()))
        return kept

    def _ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each entry has, and the ids of all."""
        ends = np.frombuffer(self.ends, np.int64)
        first = ends.take(found)
        count = ends.take(found + 1) - first
        after = np.cumsum(count)
        at = np.repeat(first - after + count, count) + np.arange(after[-1])
        return count, np.frombuffer(self.ids, np.uint32).take(at).astype("<u4", copy=False)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. Null counts as empty."""
        data, edges = _bytes(column)
        words, raw = data.view("<u8"), data.tobytes()
        starts = cuts(data, edges)
        sizes = np.diff(starts, append=edges[-1])
        made, before = [], np.zeros(len(starts) + 1, np.int64)
        for k in range(0, len(starts), STEP):
            own, size = starts[k : k + STEP], sizes[k : k + STEP]
            found, *keys = self._look(words, own, size)
            kept = self._resolve(raw, own, size, found, *keys)
            count, ids = self._ids(found)
            made.append(ids)
            before[k + 1 : k + 1 + len(own)] = before[k] + np.cumsum(count)
            self._forget(kept)
        of_text = before[np.searchsorted(starts, edges)]
        return np.concatenate(made) if made else np.zeros(0, "<u4"), np.diff(of_text)
