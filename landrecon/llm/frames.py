"""What several of the operators need: column names, Arrow batches and rows in a global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from landrecon.operators.rounds import Rounds


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [t or "" for t in batch.column(name).to_pylist()]


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes, so that what a step makes of them stays small."""
    step = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
    start = 0
    while start < batch.num_rows:
        part = batch.slice(start, step)
        while part.num_rows > 1 and part.nbytes > 4 * size:
            part = part.slice(0, part.num_rows // 2)
        yield part
        start += part.num_rows


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: str,
              size: int = 2_000_000) -> DataFrame:
    """Each Arrow batch of ``df``, in runs of about ``size`` bytes, through ``step``, which returns columns by name."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size):
                made = step(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Rows of a few ids, digests or places (up to some 200 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def neutral(docs: DataFrame, *needed: str) -> dict[str, str]:
    """A name for each column of ``docs`` that no step uses: its own for the needed ones, a number for others."""
    return {c: c if c in needed else f"_column_{i}" for i, c in enumerate(docs.columns)}


def renamed(docs: DataFrame, names: dict[str, str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(n) for c, n in names.items()]


def restored(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def located(docs: DataFrame, rounds: Rounds) -> DataFrame:
    """``docs`` with _file and _row, the place of each row. What is not read from files is written first.

    Columns other than doc_id and text have the names of ``neutral(docs, "doc_id", "text")``, so that none clashes.
    """
    own, place = renamed(docs, neutral(docs, "doc_id", "text")), [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select(*own, *place)
    except Exception as error:  # no files behind these rows
        if "_metadata" not in str(error):
            raise
        return rounds.keep(docs.select(*own)).select("*", *place)


def order_key(name: str = "doc_id") -> Column:
    """A key that sorts null ids first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))


def bounds(df: DataFrame, parts: int, error: float = 0.002) -> list[int]:
    """Ascending cuts that deal the ids of ``df`` into at most ``parts`` ranges of similar size.

    Only the id column is read. The cuts are the only thing that reaches the driver.
    """
    if parts < 2:
        return []
    found = df.select(order_key().cast("double").alias("k")).approxQuantile(
        "k", [i / parts for i in range(1, parts)], min(error, 0.2 / parts))
    return sorted({int(x) for x in found})


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of the range a key is in: how many cuts are not above it."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
