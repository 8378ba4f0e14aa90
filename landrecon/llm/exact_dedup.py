"""Exact deduplication as a stateful stream.

Arrivals are rows (digest, doc_id, file, row): the SHA-256 of the normalised text, the stable
identifier, and where the content lies. A Structured Streaming query keeps, for every digest ever
seen, how many rows had it and the identifier and place of the row that stays; there is no watermark,
so nothing expires. The state is held by the RocksDB provider, on the executors' disks with a copy in
the query's checkpoint, and is read back from there by the state data source. Arrivals may be added
and the stream run again with the same checkpoint: earlier texts are still known.

A digest seen more than once is only a hit. Texts of hits are grouped by their full bytes; where a
digest stands for several texts, each is its own class. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.llm.frames import BROADCAST_ROWS, few, located, neutral, restored
from landrecon.operators.rounds import Rounds

#: Input files of arrivals that one micro-batch takes.
FILES_PER_BATCH = 1000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # Many small stores: no disk set aside for each one's manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def normalised(column: str = "text") -> Column:
    """Null counts as empty; nothing else is changed."""
    return F.coalesce(F.col(column), F.lit(""))


def keep_state(arrivals: str, checkpoint: str, spark: SparkSession) -> DataFrame:
    """Run the stream over all new files of ``arrivals``; digest, rows, keep_id, keep_file, keep_row from its state."""
    session = spark.newSession()
    for name, value in _CONF.items():
        session.conf.set(name, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(arrivals).schema
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(arrivals)
    kept = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    run = (kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    run.awaitTermination()
    if run.lastProgress is None and not session.read.parquet(arrivals).head(1):
        return session.createDataFrame([], "digest binary, n long, keep_id long, keep_file string, keep_row long")
    state = session.read.format("statestore").load(checkpoint)
    count, keep = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{count}`").alias("n"),
                        F.col(f"value.`{keep}`.doc_id").alias("keep_id"), F.col(f"value.`{keep}`.file").alias("keep_file"),
                        F.col(f"value.`{keep}`.row").alias("keep_row"))


def classes(docs: DataFrame, text: Column | None = None, digest=sha256) -> tuple[DataFrame, DataFrame, Rounds]:
    """Rows (doc_id, _file, _row, digest, keep_id, group_size, kept) of ``docs``, and the located documents.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and
    of equal ids the last place in the files stays. ``text`` is the normalised text, ``digest`` a
    function of it to binary.
    """
    rounds = Rounds(docs.sparkSession)
    spark = docs.sparkSession
    whole = text if text is not None else normalised()
    here = located(docs, rounds)
    table = rounds.path()
    here.select(digest(whole).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_file").alias("file"),
                F.col("_row").alias("row")).write.parquet(table)
    arrivals = spark.read.parquet(table)
    state = rounds.path()
    keep_state(table, rounds.path(), spark).write.parquet(state)
    known = spark.read.parquet(state)
    hits = known.where("n > 1")
    # Hits with their whole bytes. Copies are merged within each task, so a group of any size is one row a task.
    content = (here.select(digest(whole).alias("digest"), whole.alias("content"))
               .join(few(hits.select("digest"), BROADCAST_ROWS), "digest", "left_semi"))
    bytes_of = rounds.keep(content.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))
                           .groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")))
    clashes = bytes_of.where("texts > 1").select("digest")
    rows = arrivals.join(known.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest")).select(
        "doc_id", F.col("file").alias("_file"), F.col("row").alias("_row"), "digest", "keep_id", F.col("n").alias("group_size"),
        (F.col("n").eqNullSafe(1) | (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"))
    if clashes.head(1):  # a digest of several texts: those rows by their whole bytes
        apart = here.select(digest(whole).alias("digest"), whole.alias("content"), F.col("doc_id").cast("long").alias("doc_id"),
                            "_file", "_row").join(clashes, "digest", "left_semi")
        best = apart.groupBy("digest", "content").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("k"),
                                                      F.count(F.lit(1)).alias("group_size"))
        exact = apart.join(best, ["digest", "content"]).select(
            "doc_id", "_file", "_row", "digest", F.col("k.doc_id").alias("keep_id"), "group_size",
            ((F.col("_file") == F.col("k._file")) & (F.col("_row") == F.col("k._row"))).alias("kept"))
        rows = rows.join(clashes, "digest", "left_anti").unionByName(exact.select(*rows.columns))
    return rows, here, rounds


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row; ``docs`` needs doc_id and text."""
    rows, _, _ = classes(docs)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one for each text."""
    rows, here, rounds = classes(docs)
    gone = rounds.keep(rows.where("not kept").select("_file", "_row"))
    return here.join(few(gone, BROADCAST_ROWS), ["_file", "_row"], "left_anti").select(*restored(neutral(docs, "doc_id", "text")))
