"""Byte-level BPE encoding and decoding.

A pre-token is looked up in two tiers. The first is a minimal perfect hash over the vocabulary (hash
and displace: every bucket of keys has a seed that sends its keys to free places of an array exactly
as long as the vocabulary, or the place of its only key); it resolves a pre-token that is itself an entry. The second, for misses, merges pairs by rank with a heap of (rank, place) over a doubly linked
list of the bytes; entries whose pair has changed meanwhile are passed over.

Texts are cut at single spaces between visible characters, where the pattern never matches across;
the pieces repeat, so they are remembered, up to a fixed number, and others are resolved again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from landrecon.llm.frames import arrow_map, plain, texts

#: Pieces remembered by a worker, about 200 bytes each.
KEPT_PIECES = 300_000
#: Latin letters, then marks: two pre-tokens, which need not be searched for.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Other white space next to a space.
_MIXED = re.compile(r"[^\S ] | [^\S ]")
_MIX, _SPREAD, _ALL, _U = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 2**64 - 1, np.uint64


def pieces(text: str) -> list[str]:
    """Parts whose pre-tokens are those of the text. All but the first lack the space before them."""
    plain_spaces = "  " not in text and text[-1:] != " " and text[:1] != " " and not _MIXED.search(text)
    return text.split(" ") if plain_spaces else _SAFE_CUT.split(text)


def plain_parts(piece: str) -> tuple[str, ...] | None:
    """The pre-tokens of a piece of Latin letters and marks; None for any other."""
    found = _PLAIN.fullmatch(piece)
    return None if found is None else found.groups() if found[2] else (found[1],)


class MinimalPerfectHash:
    """Places for n given keys in an array of n; other keys get some place, so compare the key there."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        h = self.hashes(keys)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.index = np.full(self.n, -1, np.int64)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if self.n else np.array([], int)
        groups = sorted((order[a:b] for a, b in zip(starts, np.r_[starts[1:], self.n])), key=len, reverse=True)
        free = np.ones(self.n, bool)
        tries = np.arange(64, dtype=np.uint64)[:, None]
        for rows in groups:  # the largest first, while there is room; single keys take what is left
            if len(rows) == 1:
                break
            at, base = -1, 0
            while at < 0:
                place = self._place(h[rows][None, :], tries + np.uint64(base))
                good = free[place].all(1) & (np.diff(np.sort(place, 1), axis=1) > 0).all(1)
                at, base = (int(good.argmax()), base) if good.any() else (-1, base + 64)
            self.seeds[bucket[rows[0]]] = base + at
            free[place[at]] = False
            self.index[place[at]] = rows
        single = np.array([r[0] for r in groups if len(r) == 1], np.int64)
        left = np.flatnonzero(free)[: len(single)]
        self.index[left] = single
        self.seeds[bucket[single]] = -1 - left  # the place itself

        self.seeds, self.index = self.seeds.tolist(), self.index.tolist()  # single keys are looked up from here on

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _place(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        x = (h ^ (seed * _U(_MIX))) * _U(_SPREAD)
        return (x ^ (x >> _U(29))) % _U(self.n)

    def lookup(self, key: bytes) -> int:
        """The number of the only given key that this one can equal."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[(h >> 32) % self.buckets]
        if seed < 0:
            return self.index[-1 - seed]
        x = (h ^ (seed * _MIX & _ALL)) * _SPREAD & _ALL
        return self.index[(x ^ (x >> 29)) % self.n]


class Pieces(dict):
    """What a piece of text stands for; frequent pieces are kept, others are resolved each time."""

    def __init__(self, resolve: Callable[[str], object], before: str = ""):
        self.resolve, self.before = resolve, before

    def __missing__(self, piece: str):
        made = self.resolve(self.before + piece)
        if len(self) < KEPT_PIECES:
            self[piece] = made
        return made


class Codec:
    """Encodes and decodes by a rank file; one for each worker and file."""

    _made: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocabulary = list(self.ranks)
        self.id_of = list(self.ranks.values())
        self.table = MinimalPerfectHash(self.vocabulary)
        self.pattern = regex.compile(pattern)
        size = max(self.id_of) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for key, i in self.ranks.items():
            self.bytes_of[i] = key
        self.text_of = list(map(str, range(size)))
        self.first, self.later = Pieces(self.resolve), Pieces(self.resolve, " ")
        self.parts = Pieces(lambda word: tuple(self.pre_token(word.encode())))

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is not an entry: always the lowest rank, the leftmost of equals."""
        ranks, n = self.ranks, len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            a = parts[i]
            if a is None or (j := right[i]) >= n or len(a) + len(parts[j]) != length:  # type: ignore[arg-type]
                continue
            parts[i] = a = a + parts[j]  # type: ignore[operator]
            parts[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(a + parts[k])) is not None:  # type: ignore[operator]
                    heapq.heappush(heap, (r, i, length + len(parts[k])))  # type: ignore[arg-type]
            if (p := left[i]) >= 0 and (r := ranks.get(parts[p] + a)) is not None:  # type: ignore[operator]
                heapq.heappush(heap, (r, p, len(parts[p]) + length))  # type: ignore[arg-type]
        return [ranks[p] for p in parts if p is not None]

    def pre_token(self, word: bytes) -> list[int]:
        """Ids of a pre-token: by the perfect hash if it is an entry, else by merges."""
        k = self.table.lookup(word)
        return [self.id_of[k]] if self.vocabulary[k] == word else self.merge(word)

    def resolve(self, piece: str) -> tuple[int, ...]:
        words = plain_parts(piece) or self.pattern.findall(piece)
        return self.parts[words[0]] if len(words) == 1 else tuple([i for w in words for i in self.parts[w]])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        first, *rest = pieces(text)
        ids = list(self.first[first])
        ids.extend(chain.from_iterable(map(self.later.__getitem__, rest)))
        return ids

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text. Null and empty texts give an empty list.

    Rows stay one to one: repeated rows and null doc_ids are kept as they are. There is no shuffle; a
    task holds one Arrow batch and at most ``KEPT_PIECES`` remembered pieces.
    """
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"), "ids": list(map(Codec.of(path, pattern).encode, texts(batch)))}

    return arrow_map(plain(docs, "doc_id", "text"), step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows of ``encode``; bytes that are no UTF-8 become U+FFFD."""
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        codec = Codec.of(path, pattern)
        return {"doc_id": batch.column("doc_id"),
                "text": [codec.decode(i or []).decode(errors="replace") for i in batch.column("ids").to_pylist()]}

    return arrow_map(plain(encoded, "doc_id", "ids"), step, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes (of the decoded text) of each row.

    The digests are of what ``encode`` and ``decode`` give, taken in one pass so that ids need not
    travel. Null and empty texts have no tokens and the digests of nothing.
    """
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        codec = Codec.of(path, pattern)
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [],
                                "decoded_sha256": [], "n_bytes": []}
        for text in texts(batch):
            ids = codec.encode(text)
            decoded = codec.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(codec.joined(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            out["n_bytes"].append(len(decoded))
        return out

    return arrow_map(plain(docs, "doc_id", "text"), step,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
