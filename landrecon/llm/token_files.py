"""Token-id files: ids of whole documents in ascending doc_id order, coded by ``range_coder``.

A file is a Parquet part of rows called segments. A segment holds whole consecutive documents, its
ids in blocks of ``range_coder.BLOCK`` (the last one shorter), the prior of its blocks, and for each block its bytes and
their CRC-32. A block starts from the prior alone and a segment needs no other row, so readers may
split files as they like. Part k holds the k-th range of doc_ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landrecon.llm import range_coder
from landrecon.llm.bpe import Pieces, plain_parts
from landrecon.llm.frames import arrow_map, arrow_schema, bounds, bucket_of, order_key, plain, shuffle_parts, slices
from landrecon.llm.piece_table import PieceTable

SEGMENT = 1024 * range_coder.BLOCK
SCHEMA = ("shard int, segment int, first long, doc_ids array<long>, counts array<int>, block_bytes array<int>, "
          "block_crc32 array<long>, prior binary, payload binary")


class LibraryEncoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit integers; one for each worker and file.

    Texts are cut where the pre-tokenizer always cuts. A piece goes through the library's
    pre-tokenizer and model and is then remembered in a ``PieceTable``. Strings of added tokens in a
    text have the ids of those tokens with ``added``, as the library's encode gives them; otherwise
    they are ordinary text, as with its ``encode_special_tokens``.
    """

    _made: dict[tuple[str, bool], "LibraryEncoder"] = {}

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        if whole.normalizer is not None:
            raise ValueError("a normalizer may join pieces")
        tokens = whole.get_added_tokens_decoder() if added else {}
        for t in tokens.values():
            if t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content):
                raise ValueError(f"the added token {t.content!r} may reach beyond a piece")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in tokens.items()}
        #: At one place the longest token is taken.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if tokens else None
        self.split, self.model = whole.pre_tokenizer.pre_tokenize_str, whole.model
        self.table = PieceTable(self.resolve)
        self.words = Pieces(lambda word: array("I", [t.id for t in self.model.tokenize(word)]).tobytes())
        #: How the library writes Latin letters and the space in its byte-level alphabet; empty for another pre-tokenizer.
        byte_level = whole.pre_tokenizer.__class__.__name__ == "ByteLevel"
        self.alphabet = {k: self.split(chr(k))[0][0] for k in (32, *range(0xC0, 0x250))} if byte_level else {}

    @classmethod
    def of(cls, path: str, added: bool = False) -> "LibraryEncoder":
        if (path, added) not in cls._made:
            cls._made[path, added] = cls(path, added)
        return cls._made[path, added]

    def resolve(self, piece: str) -> bytes:
        """Ids of a piece. No added token has white space in it, so none reaches beyond a piece."""
        if self.cut is None or not self.cut.search(piece):
            return self.ordinary(piece)
        return b"".join([self.added.get(part) or self.ordinary(part) for part in self.cut.split(piece) if part])

    def ordinary(self, piece: str) -> bytes:
        parts = plain_parts(piece) if self.alphabet else None
        if parts is None:
            return b"".join([self.words[word] for word, _ in self.split(piece)])
        word = self.words[parts[0].translate(self.alphabet)]
        return word + self.words[parts[1]] if len(parts) > 1 else word

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each has with it. A null text is an empty one."""
        found, counts = self.table.encode(column)
        counts = counts + 1
        ids = np.full(len(found) + len(counts), end_id, "<u4")
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(counts) - 1] = False
        ids[inside] = found
        return ids, counts


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, added: bool = False) -> None:
    """Write the ids of every whole text, each document followed by ``end_id``, to ``folder``. ``added``: see ``LibraryEncoder``.

    Null texts count as empty and give the end id alone. Null doc_ids come first, equal ones in the
    order of their texts; repeated rows are written as often as they occur; an empty table gives
    files without rows. The only shuffle deals the texts to ranges of doc_id. A task holds a few
    thousand blocks at a time, and at least one whole document.
    """
    rows = plain(docs, "doc_id", "text").withColumn("_key", order_key())
    cuts = bounds(rows, shuffle_parts(docs))
    dealt = (rows.withColumn("_shard", bucket_of(F.col("_key"), cuts)).repartitionById(len(cuts) + 1, F.col("_shard"))
             .sortWithinPartitions("_shard", "_key", "text").select("doc_id", "text", "_shard"))
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of(tokenizer, added)
        waiting: list[tuple[list, list[int], np.ndarray, int, int]] = []
        shard, segment, first = -1, 0, 0
        ids, counts, parts, blocks, room = [], [], [], 0, SEGMENT

        def close() -> None:
            nonlocal ids, counts, parts, room, segment, first, blocks
            if ids:
                codes = np.concatenate(parts)
                waiting.append((ids, counts, codes, segment, first, shard))
                segment, first, blocks = segment + 1, first + len(codes), blocks + -(-len(codes) // range_coder.BLOCK)
                ids, counts, parts, room = [], [], [], SEGMENT

        for batch in batches:
            for part in slices(batch):
                made, sizes = encoder.encode(part.column("text"), end_id)
                ends = np.cumsum(sizes).tolist()
                for i, of, n, to in zip(part.column("doc_id").to_pylist(), part.column("_shard").to_pylist(), sizes.tolist(), ends):
                    if of != shard:
                        close()
                        shard, segment, first = of, 0, 0
                    ids.append(i)
                    counts.append(n)
                    parts.append(made[to - n : to])
                    room -= n
                    if room <= 0:
                        close()
                        if blocks >= range_coder.LANES:
                            yield _coded(waiting, schema)
                            waiting, blocks = [], 0
        close()
        if waiting:
            yield _coded(waiting, schema)

    dealt.mapInArrow(run, SCHEMA).write.parquet(folder)


def _block_lengths(n: int) -> list[int]:
    full, rest = divmod(n, range_coder.BLOCK)
    return [range_coder.BLOCK] * full + [rest] * (rest > 0)


def _coded(segments: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of the waiting segments, all their blocks coded side by side."""
    lengths = [_block_lengths(len(s[2])) for s in segments]
    priors = [range_coder.Prior.of(s[2]) for s in segments]
    blocks = iter(range_coder.encode(np.concatenate([s[2] for s in segments]), np.array([n for own in lengths for n in own], np.int64),
                                     priors, np.repeat(np.arange(len(segments)), [len(own) for own in lengths])))
    rows: dict[str, list] = {f.name: [] for f in schema}
    for (ids, counts, _, segment, first, shard), own, prior in zip(segments, lengths, priors):
        coded = [next(blocks) for _ in own]
        for name, value in (("shard", shard), ("segment", segment), ("first", first), ("doc_ids", ids), ("counts", counts),
                            ("block_bytes", [len(b) for b in coded]), ("block_crc32", [zlib.crc32(b) for b in coded]),
                            ("prior", prior.pack()), ("payload", b"".join(coded))):
            rows[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """doc_id, shard, start in the shard and ids of each document of some segments."""
    segments = batch.to_pylist()
    blocks, lengths, of = [], [], []
    priors = [range_coder.Prior.unpack(s["prior"]) for s in segments]
    for k, s in enumerate(segments):
        at = 0
        for size, crc in zip(s["block_bytes"], s["block_crc32"]):
            block = s["payload"][at : at + size]
            if zlib.crc32(block) != crc:
                raise ValueError(f"shard {s['shard']}, segment {s['segment']}: a block does not match its checksum")
            blocks.append(block)
            at += size
            of.append(k)
        lengths += _block_lengths(sum(s["counts"]))
    ids, at = range_coder.decode(blocks, np.array(lengths, np.int64), priors, np.array(of, np.int64)).astype("<u4"), 0
    for s in segments:
        start = s["first"]
        for doc, n in zip(s["doc_ids"], s["counts"]):
            yield doc, s["shard"], start, ids[at : at + n]
            at, start = at + n, start + n


#: Bytes of coded segments decoded at a time: about as many blocks as there are lanes.
_READ = 6_000_000


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids (array<long>) of the documents in files of ``write``."""
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        found = list(_documents(batch))
        return {"doc_id": [d for d, *_ in found], "ids": [ids.astype(np.int64) for *_, ids in found]}

    return arrow_map(spark.read.parquet(folder), step, "doc_id long, ids array<long>", _READ)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files."""
    stored = spark.read.parquet(folder)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shard, of which there are at most as many as shuffle partitions.
    shards = (stored.groupBy("shard").agg(F.sum(total).alias("n"))
              .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "shard": [], "within": [], "n_tokens": [], "ids_crc32": []}
        for doc, shard, start, ids in _documents(batch):
            for name, value in zip(out, (doc, shard, start, len(ids), zlib.crc32(ids.tobytes()))):
                out[name].append(value)
        return out

    found = arrow_map(stored, step, "doc_id long, shard int, within long, n_tokens long, ids_crc32 long", _READ)
    return (found.join(F.broadcast(shards), "shard")
            .select("doc_id", (F.col("_before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"))
