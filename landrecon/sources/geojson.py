"""Features of GeoJSON files of any size, read by byte ranges.

A file is read by Spark's text source as records that end at each closing brace, so it is split like any other text and
may lie in any store that Spark reads. Whether a range starts inside a string, and how deep, depends
on all that comes before it. So the file is read twice:

1. Each range reports, for both cases (it starts outside or inside a string), how its nesting depth changes, and
   whether its number of quotes is odd. Running sums over the ranges of a file give every range its true start.
2. Each range now knows where it is and cuts out the features that lie in it. Pieces of features that cross ranges
   are put together by a window over the few pieces of a file.

The ordinal of a feature is its place in the bytes of all files in the order of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from landrecon.operators import skew
from landrecon.operators.rounds import Rounds

#: Ranges whose states are broadcast (a row of some 150 bytes each); more are joined by shuffle.
BROADCAST_RANGES = 200_000
QUOTE, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST = range(1, 6)
_MARK = np.zeros(256, np.uint8)
_MARK[list(b'"{}[]')] = [QUOTE, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST]
_STEP = np.array([0, 0, 1, -1, 1, -1], np.int64)
OBJECT, HEAD, TAIL, LIST, LIST_END, MEMBERS = range(6)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the range starts) and value: the text up to each closing brace, in order within a range."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, dict[str, object]]]:
    """Consecutive records of one range: its key, their bytes with the braces put back, and the first row of further columns."""
    for batch in batches:
        codes = batch.column("file").dictionary_encode().indices.to_numpy()
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                part = batch.slice(a, b - a)
                values = part.column("value").cast(pa.binary()).to_pylist()
                first = {n: part.column(n)[0].as_py() for n in part.schema.names if n != "value"}
                yield (first["file"], first["block"]), np.frombuffer(b"}".join([*values, b""]), np.uint8), first


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and kinds of brackets, whether an odd number of quotes stands before each, and whether in all."""
    places = np.flatnonzero(_MARK[data])
    kinds = _MARK[data[places]]
    if (slashes := data == 92).any():
        plain = np.concatenate([[-1], np.flatnonzero(~slashes)])
        before = plain[np.searchsorted(plain, places) - 1]
        keep = (kinds != QUOTE) | ((places - 1 - before) % 2 == 0)
        places, kinds = places[keep], kinds[keep]
    odd = np.cumsum(kinds == QUOTE) & 1
    bracket = kinds != QUOTE
    return places[bracket], kinds[bracket], odd[bracket], int(odd[-1]) if len(odd) else 0


def _starts_with_feature(data: np.ndarray) -> bool:
    """Whether the first object of a file is a feature, by what is directly in it."""
    places, kinds, odd, _ = structure(data)
    places, kinds = places[odd == 0], kinds[odd == 0]
    depth = np.cumsum(_STEP[kinds])
    end = np.flatnonzero(depth <= 0)
    last = int(end[0]) if len(end) else len(depth)
    starts, ends = places + 1, np.append(places[1:], len(data))
    own = b" ".join(data[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(depth[:last] == 1))
    return bool(re.search(rb'"type"\s*:\s*"Feature"', own)) and not re.search(rb'"features"\s*:', own)


_RANGE = "file string, block long, bytes long, odd int, outside long, inside long, by_object boolean"


def range_states(rows: DataFrame) -> DataFrame:
    """file, block, start (in bytes), odd (1 inside a string), depth and by_object (a row of features and no collection) at
    the start of each range, and the bytes of the file before it in the order of names."""
    out = to_arrow_schema(StructType.fromDDL(_RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [0, 0, 0, 0, None]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip([*key, *held], out)], schema=out)

        for now, data, _ in _ranges(batches):
            if now != key:
                if key:
                    yield row()
                key, held = now, [0, 0, 0, 0, _starts_with_feature(data) if now[1] == 0 else None]
            _, kinds, odd, flips = structure(data)
            steps = _STEP[kinds]
            change = int(steps[odd == 0].sum()), int(steps[odd == 1].sum())
            held[2] += change[held[1]]
            held[3] += change[1 - held[1]]
            held[0], held[1] = held[0] + len(data), held[1] ^ flips
        if key:
            yield row()

    found = Rounds(rows.sparkSession).keep(rows.mapInArrow(run, _RANGE))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    odd = found.select("*", F.coalesce(F.sum("odd").over(before), F.lit(0)).bitwiseAND(1).cast("int").alias("inside_at"),
                       F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
                       F.max("by_object").over(whole).alias("of_file"))
    change = odd.withColumn("change", F.when(F.col("inside_at") == 1, F.col("inside")).otherwise(F.col("outside")))
    return change.select("file", "block", "bytes", "start", F.col("inside_at").alias("odd"),
                         F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), F.col("of_file").alias("by_object"))


class _Cutter:
    """Goes over one range and gives rows (kind, place, closed, text)."""

    def __init__(self, start: int, odd: int, depth: int, by_object: bool):
        self.at, self.odd, self.depth, self.by_object = start, odd, depth, by_object
        self.level = 0 if by_object else 2
        self.open_at: int | None = None
        self.kind = TAIL if depth > self.level else OBJECT
        self.held: list[bytes] = []
        self.start = start

    def feed(self, data: np.ndarray) -> Iterator[tuple]:
        raw = data.tobytes()
        places, kinds, odd, flips = structure(data)
        real = odd == self.odd
        places, kinds = places[real], kinds[real]
        after = self.depth + np.cumsum(_STEP[kinds])
        before = after - _STEP[kinds]
        opens = (kinds == OPEN) & (before == self.level)
        closes = (kinds == CLOSE) & (after == self.level)
        done = 0
        for i in np.flatnonzero(opens | closes).tolist():
            p = int(places[i])
            if opens[i]:
                self.held, self.open_at, self.kind, done = [], self.at + p, OBJECT, p  # a tail that is still open was no feature
            elif self.open_at is not None or self.kind == TAIL:
                text = b"".join([*self.held, raw[done : p + 1]])
                yield (self.kind, self.start if self.kind == TAIL else self.open_at, True, text)
                self.held, self.open_at, self.kind, done = [], None, OBJECT, p + 1
        if self.open_at is not None or self.kind == TAIL:
            self.held.append(raw[done:])
        if not self.by_object:
            for i in np.flatnonzero((kinds == OPEN_LIST) & (before == 1)).tolist():
                if re.search(rb'"features"\s*:\s*$', raw[max(0, int(places[i]) - 64) : int(places[i])]):
                    yield (LIST, self.at + int(places[i]), None, None)
            for i in np.flatnonzero((kinds == CLOSE_LIST) & (after == 1)).tolist():
                yield (LIST_END, self.at + int(places[i]), None, None)
            edges = [0, *(places + 1).tolist()], [*places.tolist(), len(raw)]
            own = b" ".join(raw[edges[0][i] : edges[1][i]] for i in np.flatnonzero(np.concatenate([[self.depth], after]) == 1).tolist())
            if own.strip(b" ,\n\r\t"):
                yield (MEMBERS, self.at, None, own)
        self.depth = int(after[-1]) if len(after) else self.depth
        self.odd ^= flips
        self.at += len(raw)

    def end(self) -> Iterator[tuple]:
        if self.held and (self.open_at is not None or self.kind == TAIL):
            yield (HEAD, self.open_at, False, b"".join(self.held)) if self.open_at is not None else (TAIL, self.start, False, b"".join(self.held))


_PIECE = "file string, kind int, place long, closed boolean, value string"


def _cut(rows: DataFrame) -> DataFrame:
    """Pieces of the files, from records with the states of their ranges."""
    out = to_arrow_schema(StructType.fromDDL(_PIECE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter = None, None

        def table(pieces) -> Iterator[pa.RecordBatch]:
            made = list(zip(*pieces))
            if made:
                columns = [[key[0]] * len(made[0]), *made]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for now, data, first in _ranges(batches):
            if now != key:
                if cutter:
                    yield from table(cutter.end())
                key, cutter = now, _Cutter(first["start"], first["odd"], first["depth"], bool(first["by_object"]))
            yield from table(cutter.feed(data))
        if cutter:
            yield from table(cutter.end())

    return rows.mapInArrow(run, _PIECE)


def _joined(pieces: DataFrame) -> DataFrame:
    """Features that cross ranges: a head and the tails after it, up to the one that closes it."""
    upto = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = pieces.where(F.col("kind").isin(HEAD, TAIL)).withColumn(
        "head", F.last(F.when(F.col("kind") == HEAD, F.col("place")), ignorenulls=True).over(upto))
    parts = spread.where("head is not null").groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("place", "closed", "value"))).alias("p"))
    last = F.array_position(F.transform("p", lambda x: x.closed), True)
    return parts.where(last > 0).select("file", F.col("head").alias("place"), F.array_join(
        F.transform(F.slice("p", F.lit(1), last.cast("int")), lambda x: x.value), "").alias("value"))


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, hint (the file's crs_hint, if any) and value: the text of every feature of the files at ``path``.

    A file is a FeatureCollection, or a row of features (one a line, or any white space between). Anything else raises.
    """
    rounds = Rounds(spark)
    rows = records(spark, path)
    states = rounds.keep(range_states(rows))
    if states.count() <= BROADCAST_RANGES:
        known = rows.join(F.broadcast(states), ["file", "block"])
    else:
        known = (rows.withColumn("_n", F.monotonically_increasing_id()).join(states, ["file", "block"])
                 .repartition("file", "block").sortWithinPartitions("file", "block", "_n"))
    pieces = rounds.keep(_cut(known.select("file", "block", "value", "start", "odd", "depth", "by_object")))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = states.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("by_object").alias("by_object")).withColumn(
        "base", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    found = pieces.where(F.col("kind").isin(LIST, LIST_END, MEMBERS)).groupBy("file").agg(
        F.min(F.when(F.col("kind") == LIST, F.col("place"))).alias("first"),
        F.collect_list(F.when(F.col("kind") == LIST_END, F.col("place"))).alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == MEMBERS, F.struct("place", "value")))),
                                 lambda x: x.value), " ").alias("own"))
    member = lambda name: F.nullif(F.regexp_extract("own", f'"{name}"\\s*:\\s*"([^"]*)"', 1), F.lit(""))
    wanted = (F.when(F.col("by_object"), True).when(member("type") == "FeatureCollection", False)
              .otherwise(F.raise_error(F.lit("file must be a GeoJSON FeatureCollection"))))
    files = rounds.keep(files.join(found, "file", "left").select(
        "file", "base", wanted.cast("boolean").alias("by_object"), member("crs_hint").alias("hint"), "first",
        F.array_min(F.filter("ends", lambda x: x > F.col("first"))).alias("end")))
    every = pieces.where(F.col("kind") == OBJECT).select("file", "place", "value").unionByName(_joined(pieces))
    inside = F.col("by_object") | ((F.col("place") > F.col("first")) & (F.col("place") < F.coalesce("end", F.lit(2**62))))
    return skew.lookup_join(every, files, ["file"], F.col("place")).where(inside).select(
        "file", (F.col("base") + F.col("place")).alias("ordinal"), F.when(~F.col("by_object"), F.col("hint")).alias("hint"), "value")
