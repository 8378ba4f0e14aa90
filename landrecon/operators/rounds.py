"""Intermediate tables that later steps read several times, and loops that end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Writes intermediate tables to the session's checkpoint folder and reads them back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where none is set and
    driver and executors are one process (``local`` or ``local[...]``) a temporary one is used.
    Written tables cut the lineage of loops, live in shared storage, so a lost executor costs a
    re-read and not the loop, and have a known size, so small ones are broadcast and large ones are
    not. ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        context = spark.sparkContext
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="rounds-")
            context.setCheckpointDir(folder)
        self.folder = f"{folder}/tables-{uuid.uuid4().hex}"
        self.tables = 0

    def path(self) -> str:
        """A new place for a table."""
        self.tables += 1
        return f"{self.folder}/{self.tables:05d}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove kept tables. Their readers must have ended."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                if folder.startswith("file:") or "/tables-" in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    if path.toString().rsplit("/", 2)[1] == self.folder.rsplit("/", 1)[1]:
                        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
