"""SHA-256 of files of any size, read by byte ranges.

A file is read by Spark's text source as records that end at one byte, so it may lie in any store that Spark reads, and no
task holds more of it than a few records. A file that is one range is hashed where it is read. The ranges of larger ones are
brought, as chunks in order, to one task of the file: the digest is a chain over all bytes.

The reader drops a byte order mark at the start of a file and does not tell whether the last record was closed. Both follow
from the length of the file, by which every digest is checked. The reader also skips records of ``LONGEST`` bytes or more;
such a file misses bytes and is read again with the next separator.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.operators.rounds import Rounds

#: Bytes that end a record, in the order in which they are tried, and endings that Spark would decompress.
SEPARATORS = ("\n", ",", "\0", ">")
CODECS = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")
MARK = b"\xef\xbb\xbf"
LONGEST = 16 << 20
CHUNK = 1 << 20

_PART = "file string, length long, block long, place int, data binary, sha256 string"


class _Digest:
    """Of bytes that come piece by piece, each with a separator at its end that the last one need not have."""

    def __init__(self) -> None:
        self.plain, self.marked, self.held, self.bytes = hashlib.sha256(), hashlib.sha256(MARK), b"", 0

    def add(self, data: memoryview) -> None:
        for digest in (self.plain, self.marked):
            digest.update(self.held)
            digest.update(data[:-1])
        self.held = bytes(data[-1:])
        self.bytes += len(data)

    def of(self, length: int) -> str | None:
        """The digest of a file of this length, or None where bytes are missing."""
        for digest, start in ((self.plain, 0), (self.marked, len(MARK))):
            if self.bytes + start - length in (0, 1):
                if self.bytes + start == length:
                    digest.update(self.held)
                return digest.hexdigest()
        return None


def _records(spark: SparkSession, paths: str | list[str], separator: str, options: dict[str, str]) -> DataFrame:
    """file, length, block (where the range starts), whole (the range is the file) and the bytes of each record with its separator."""
    text = (spark.read.options(**options).option("lineSep", separator)
            .option("mapreduce.input.linerecordreader.line.maxlength", LONGEST).text(paths))
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("file"), meta["file_size"].alias("length"), meta["file_block_start"].alias("block"),
        (meta["file_block_length"] == meta["file_size"]).alias("whole"),
        F.concat(F.col("value").cast("binary"), F.lit(separator.encode())).alias("data"), meta["file_name"].alias("_name"))


def _all_records(spark: SparkSession, files: DataFrame, paths: str | list[str], separator: str, options: dict[str, str]) -> DataFrame:
    """Records of plain files, and of each kind of compressed ones as the bytes that they have."""
    ending = F.regexp_extract(F.lower("file"), f"({'|'.join(map(re.escape, CODECS))})$", 1)
    found = sorted(r[0] for r in files.select(ending).distinct().collect() if r[0])
    rows = _records(spark, paths, separator, options)
    if found:
        rows = rows.where(~F.col("_name").rlike(f"(?i)({'|'.join(map(re.escape, found))})$"))
    for one in found:
        as_is = {f"{prefix}io.compress.passthrough.extension": one for prefix in ("", "org.apache.hadoop.shaded.")}  # either client
        as_is |= {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "pathGlobFilter": "*" + "".join(f"[{c}{c.upper()}]" for c in one)}
        rows = rows.unionByName(_records(spark, paths, separator, options | as_is))
    return rows.drop("_name")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, memoryview]]:
    """Consecutive records of one range: file, length, block, whole, and their bytes."""
    for batch in batches:
        codes = batch.column("file").dictionary_encode().indices.to_numpy()
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        data = batch.column("data")
        wide = np.int64 if pa.types.is_large_binary(data.type) else np.int32
        places = np.frombuffer(data.buffers()[1], wide)[data.offset:data.offset + len(data) + 1]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield (tuple(batch.column(n)[a].as_py() for n in ("file", "length", "block", "whole")),
                       memoryview(data.buffers()[2])[places[a]:places[b]])


def _parts(rows: DataFrame) -> DataFrame:
    """A row with the digest of each file that is one range, rows of chunks of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, place = None, _Digest(), 0

        def row(data: bytes | None, sha256: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()),
                 pa.array([place], pa.int32()), pa.array([data], pa.binary()), pa.array([sha256], pa.string())],
                names=["file", "length", "block", "place", "data", "sha256"])

        for now, data in _runs(batches):
            if now != key:
                if key and key[3]:
                    yield row(None, digest.of(key[1]))
                key, digest, place = now, _Digest(), 0
            if key[3]:
                digest.add(data)
                continue
            for at in range(0, len(data), CHUNK):
                yield row(bytes(data[at:at + CHUNK]), None)
                place += 1
        if key and key[3]:
            yield row(None, digest.of(key[1]))

    return rows.mapInArrow(run, _PART)


def _joined(parts: DataFrame) -> DataFrame:
    """file and sha256; null where bytes are missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, _Digest()

        def row(file: str, sha256: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), "sha256": pa.array([sha256], pa.string())})

        for batch in batches:
            for i in range(batch.num_rows):
                now, data = (batch.column("file")[i].as_py(), batch.column("length")[i].as_py()), batch.column("data")[i]
                if now != key and key:
                    yield row(key[0], digest.of(key[1]))
                    key = None
                if not data.is_valid:
                    yield row(now[0], batch.column("sha256")[i].as_py())
                    continue
                if key is None:
                    key, digest = now, _Digest()
                digest.add(memoryview(data.as_buffer()))
        if key:
            yield row(key[0], digest.of(key[1]))

    return parts.repartition("file").sortWithinPartitions("file", "block", "place").mapInArrow(run, "file string, sha256 string")


def file_digests(spark: SparkSession, files: DataFrame, path: str, options: dict[str, str]) -> DataFrame:
    """file and sha256 of ``files (file, path, length)``, which are those of ``path`` read with ``options``."""
    rounds, paths, left, done = Rounds(spark), path, files, []
    for separator in SEPARATORS:
        found = rounds.keep(_joined(_parts(_all_records(spark, left, paths, separator, options))))
        done.append(found.where("sha256 is not null"))
        left = left.join(done[-1], "file", "left_anti")
        # Each has a record of LONGEST bytes or more, so they are few. A name is no pattern.
        paths = [re.sub(r"([\\*?\[\]{}^,])", r"\\\1", r.path) for r in left.select("path").collect()]
        if not paths:
            break
    else:
        whole = spark.read.format("binaryFile").load(paths)
        done.append(whole.select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, done)
