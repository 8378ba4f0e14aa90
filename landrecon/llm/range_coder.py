"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A block of at most ``BLOCK`` ids is coded on its own from a model that is empty but for a prior, so any block can be read
alone. The prior holds the quantised counts of the ids of the block's segment and is stored once for it. Blocks are the lanes
of numpy arrays: one step codes one id of every block, and each lane has tables of its own.

The model predicts an id in three ways. Order 2 (the two ids before it) and order 1 (the id before
it) each name the id last seen in that context, with a count of how often it was right in a row.
Order 0 is the prior. The pair of counts picks an
adaptive distribution over "order 2 is right, order 1 is right, order 0 tells": that is how
the orders are weighed against each other. The interval of a prediction is its share of the range;
that of order 0 is split in proportion to the counts. Then a 64-bit range coder without carry writes 32-bit words.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
SLOT_BITS = 8
SLOTS = 1 << SLOT_BITS
#: More lanes than this are coded in turns, so that their tables stay in a fast cache.
LANES = 4096
ID_BITS = 17
#: Adaptive shares are out of 2**12; an interval is that share of 2**29 in all.
SHARE_BITS = 12
TOTAL_BITS = SHARE_BITS + ID_BITS
_RATE = 5
_LEAST = 24
_LOW32 = np.uint64(0xFFFFFFFF)
_U = np.uint64


class Prior:
    """Counts of the ids of a segment, quantised to a sum of 2**ID_BITS; every id that occurs has at least one."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = np.asarray(ids, np.int64), np.asarray(share, np.int64)

    @classmethod
    def of(cls, ids: np.ndarray) -> "Prior":
        held, counts = np.unique(np.asarray(ids, np.int64), return_counts=True)
        if len(held) and int(held[-1]) >= 1 << ID_BITS:
            raise ValueError("an id needs more than 17 bits")
        share = counts * ((1 << ID_BITS) - len(held)) // max(1, int(counts.sum())) + 1
        if len(held):
            share[share.argmax()] += (1 << ID_BITS) - int(share.sum())
        return cls(held, share)

    @classmethod
    def even(cls) -> "Prior":
        """All ids alike, for blocks without a segment."""
        return cls(np.arange(1 << ID_BITS), np.ones(1 << ID_BITS, np.int64))

    def pack(self) -> bytes:
        steps = np.diff(self.ids, prepend=-1) - 1
        low = np.concatenate([steps & 255, self.share & 255]).astype(np.uint8)
        high = np.concatenate([steps >> 8, self.share >> 8]).astype("<u4")
        return zlib.compress(low.tobytes() + high.tobytes(), 6)

    @classmethod
    def unpack(cls, packed: bytes) -> "Prior":
        raw = zlib.decompress(packed)
        n = len(raw) // 10
        low, high = np.frombuffer(raw, np.uint8, 2 * n), np.frombuffer(raw, "<u4", 2 * n, 2 * n)
        both = low.astype(np.int64) | high.astype(np.int64) << 8
        return cls(np.cumsum(both[:n] + 1) - 1, both[n:])


class _Priors:
    """Several priors side by side. An entry is the place of an id in one of them."""

    def __init__(self, priors: list[Prior]):
        sizes = np.array([len(p.ids) for p in priors], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.ids = np.concatenate([p.ids for p in priors])
        #: The last entry is the whole range.
        self.whole = int(sizes.sum())
        self.share = np.concatenate([*(p.share for p in priors), [1 << ID_BITS]])
        self.start = np.concatenate([*(np.cumsum(p.share) - p.share for p in priors), [0]])
        self.priors = priors

    def entries(self, ids: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The entry of every id; block k, of the given length, has the prior ``of[k]``."""
        out, ends = np.empty(len(ids), np.int32), np.cumsum(lengths)
        runs = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for a, b in zip(runs, [*runs[1:], len(of)]):
            own, mine = self.priors[of[a]].ids, slice(int(ends[a] - lengths[a]), int(ends[b - 1]))
            place = np.zeros(int(own[-1]) + 1, np.int32)
            place[own] = np.arange(self.first[of[a]], self.first[of[a]] + len(own))
            out[mine] = place.take(ids[mine])
        return out

    def table(self) -> np.ndarray:
        """The entry at every place of the range of every prior."""
        return np.concatenate([np.repeat(np.arange(f, f + len(p.ids), dtype=np.int32), p.share) for f, p in zip(self.first.tolist(), self.priors)])


class _Model:
    """Tables of all lanes, flat. A place is the hash of the id before, or of the two before."""

    def __init__(self, lanes: int):
        self.order2 = np.zeros(lanes * SLOTS, np.int32)  # id * 4 + count
        self.order1 = np.zeros(lanes * SLOTS, np.int32)
        whole = 1 << SHARE_BITS
        #: Cuts of 16 bits, the last ones the whole, in one number, so that a row moves at once.
        self.cuts = _rows(np.tile(np.array([whole * 2 // 10, whole * 4 // 10, whole, whole], np.int16), (lanes * 16, 1)))
        #: Where the cuts move after each outcome.
        self.goal = _rows(np.array([[*(whole - (2 - j) * _LEAST if j >= k else (j + 1) * _LEAST for j in range(2)), whole, whole]
                                    for k in range(3)], np.int16))
        self.lane16 = np.arange(lanes, dtype=np.int64) * 16
        self.at = np.arange(lanes, dtype=np.int64) * SLOTS
        self.near1 = np.zeros(lanes, np.int64)
        self.near2 = np.zeros(lanes, np.int64)

    def look(self, n: int) -> None:
        """Predictions for the next id of the first n lanes."""
        self.i1 = self.at[:n] + self.near1[:n]
        self.i2 = self.at[:n] + ((self.near1[:n] * 173 + self.near2[:n]) & (SLOTS - 1))
        self.v2, self.v1 = self.order2.take(self.i2), self.order1.take(self.i1)
        self.guess2, self.guess1 = self.v2 >> 2, self.v1 >> 2
        self.sure2, self.sure1 = self.v2 & 3, self.v1 & 3
        self.row = self.lane16[:n] + (self.sure2 * 4 + self.sure1)
        self.cut = self.cuts.take(self.row).view(np.int16)

    def learn(self, ids: np.ndarray, kind: np.ndarray, near: np.ndarray) -> None:
        """``ids`` in 32 bits, and what was coded for them."""
        n, fresh = len(ids), ids << 2
        self.cuts[self.row] = (self.cut + ((self.goal.take(kind).view(np.int16) - self.cut) >> _RATE)).view(np.int64)
        self.order2[self.i2] = np.where(kind == 0, np.minimum(self.v2 + 1, fresh | 3), fresh)
        self.order1[self.i1] = np.where(self.guess1 == ids, np.minimum(self.v1 + 1, fresh | 3), fresh)
        self.near2[:n] = self.near1[:n]
        self.near1[:n] = near


def _rows(cuts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(cuts).view(np.int64).ravel()


_STARTS = np.arange(1 << 16, dtype=np.int64) * 4
_BELOW = (1 << SHARE_BITS) - 1


def _slot_of(ids: np.ndarray) -> np.ndarray:
    return (ids * 40503 >> 4) & (SLOTS - 1)


def _interval(model: _Model, kind: np.ndarray, priors: _Priors, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width, out of 2**TOTAL_BITS. ``entry`` counts only where order 0 tells; elsewhere the whole share is taken."""
    at = _STARTS[: len(kind)] + kind
    start = (model.cut.take(at - 1) & _BELOW).astype(np.int64)  # the cut before the first is the whole: 0 in these bits
    width = model.cut.take(at) - start
    told = np.where(kind == 2, entry, priors.whole)
    start <<= ID_BITS
    start += priors.start.take(told) * width
    width *= priors.share.take(told)
    return start.view(_U), width.view(_U)


def _shrink(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose range is below 2**32. Their top word is settled: a range that straddles two is cut."""
    lanes = np.flatnonzero(span <= _LOW32)
    if len(lanes):
        a, s = low[lanes], span[lanes]
        split = (a >> _U(32)) != ((a + s - _U(1)) >> _U(32))
        span[lanes] = np.where(split, (_U(1) << _U(32)) - (a & _LOW32), s)
    return lanes


def _encode(ids: np.ndarray, lengths: np.ndarray, priors: _Priors, of: np.ndarray) -> list[bytes]:
    """The blocks of ``ids``, which lie one after another, as bytes each."""
    if len(lengths) == 0:
        return []
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    lanes, most = len(order), int(size[0])
    model = _Model(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out = np.zeros((lanes, most + 3), np.uint32)
    used = np.zeros(lanes, np.int64)
    source = np.asarray(ids, np.int32)
    entries = priors.entries(source, lengths, of)
    active = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    for step, n in enumerate(active.tolist()):
        at = starts[:n] + step
        short, entry = source.take(at), entries.take(at)
        model.look(n)
        near = _slot_of(short.astype(np.int64))
        kind = (((model.guess1 != short).view(np.int8) + np.int8(1)) * (model.guess2 != short)).astype(np.int64)
        start, width = _interval(model, kind, priors, entry)
        unit = span[:n] >> _U(TOTAL_BITS)
        low[:n] += unit * start
        span[:n] = unit * width
        for_write = _shrink(low[:n], span[:n])
        if len(for_write):
            out[for_write, used[for_write]] = low[for_write] >> _U(32)
            used[for_write] += 1
            low[for_write] <<= _U(32)
            span[for_write] <<= _U(32)
        model.learn(short, kind, near)
    rows = np.arange(lanes)
    for shift in (32, 0):
        out[rows, used] = (low >> _U(shift)) & _LOW32
        used += 1
    made: list[bytes] = [b""] * lanes
    little = out.astype("<u4", copy=False)
    for k, (i, n) in enumerate(zip(order.tolist(), used.tolist())):
        made[i] = little[k, :n].tobytes()
    return made


def _decode(blocks: list[bytes], lengths: np.ndarray, priors: _Priors, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of blocks of the given lengths, one after another."""
    if len(lengths) == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    lanes, most = len(order), int(size[0])
    words = np.array([len(b) // 4 for b in blocks], np.int64)[order]
    data = np.zeros((lanes, int(words.max()) + 1), np.uint32)
    for k, i in enumerate(order.tolist()):
        data[k, : words[k]] = np.frombuffer(blocks[i], "<u4")
    model = _Model(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    code = (data[:, 0].astype(_U) << _U(32)) | data[:, 1]
    used = np.full(lanes, 2, np.int64)
    result = np.zeros(int(lengths.sum()), np.int64)
    base = of[order].astype(np.int64) << ID_BITS
    active = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    for step, n in enumerate(active.tolist()):
        model.look(n)
        unit = span[:n] >> _U(TOTAL_BITS)
        value = ((code[:n] - low[:n]) // unit).astype(np.int64)
        share = (value >> ID_BITS).astype(np.int16)
        cut = model.cut.reshape(n, 4)
        kind = ((share >= cut[:, 0]).view(np.int8) + (share >= cut[:, 1])).astype(np.int64)
        x = np.where(kind == 0, model.guess2, model.guess1).astype(np.int64)
        other, entry = np.flatnonzero(kind == 2), np.zeros(n, np.int64)
        if len(other):
            edge = cut[:, 1].take(other).astype(np.int64)
            told = table.take(base.take(other) + (value.take(other) - (edge << ID_BITS)) // ((1 << SHARE_BITS) - edge))
            entry[other] = told
            x[other] = priors.ids.take(told)
        near = _slot_of(x)
        start, span_of = _interval(model, kind, priors, entry)
        low[:n] += unit * start
        span[:n] = unit * span_of
        lanes_in = _shrink(low[:n], span[:n])
        if len(lanes_in):
            at = np.minimum(used[lanes_in], data.shape[1] - 1)
            code[lanes_in] = (code[lanes_in] << _U(32)) | data[lanes_in, at]
            used[lanes_in] += 1
            low[lanes_in] <<= _U(32)
            span[lanes_in] <<= _U(32)
        model.learn(x.astype(np.int32), kind, near)
        result[starts[:n] + step] = x
    return result


def encode(ids: np.ndarray, lengths: np.ndarray, priors: list[Prior] | None = None, of: np.ndarray | None = None) -> list[bytes]:
    """The blocks of ``ids``, which lie one after another, as bytes each; block k has the prior ``of[k]``."""
    if len(ids) and int(ids.max()) >= 1 << ID_BITS:
        raise ValueError("an id needs more than 17 bits")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    held, of = _Priors(priors or [Prior.even()]), np.zeros(len(lengths), np.int64) if of is None else of
    return [b for k in range(0, len(lengths), LANES)
            for b in _encode(ids[ends[k] : ends[min(k + LANES, len(lengths))]], lengths[k : k + LANES], held, of[k : k + LANES])]


def decode(blocks: list[bytes], lengths: np.ndarray, priors: list[Prior] | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """The ids of blocks of the given lengths, one after another."""
    held, of = _Priors(priors or [Prior.even()]), np.zeros(len(lengths), np.int64) if of is None else of
    table = held.table()
    return np.concatenate([np.zeros(0, np.int64), *(_decode(blocks[k : k + LANES], lengths[k : k + LANES], held, of[k : k + LANES], table)
                                                    for k in range(0, len(lengths), LANES))])
