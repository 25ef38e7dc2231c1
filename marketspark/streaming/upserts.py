"""A table that micro-batches in update mode are written into, by key.

Every batch is a folder of its own, named by its id: a batch that is run again after a failure replaces
what it wrote before, so each batch counts once. A reader takes the latest row of each key.
``compact`` writes the table as of a batch beside the batches; readers then start from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Ids of the finished folders ``<prefix>=<id>`` of ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith(f"{prefix}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


class KeyedTable:
    """Rows by ``keys`` at ``path``; the last batch that has a key decides on its row."""

    def __init__(self, path: str, keys: Sequence[str], schema: T.StructType):
        self.path, self.keys = path, list(keys)
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        kept, batches = _folders(spark, f"{self.path}/whole", "upto"), _folders(spark, f"{self.path}/batches", "batch")
        first = kept[-1] if kept else -1
        parts = [spark.read.schema(self.schema).parquet(f"{self.path}/batches/batch={b}").withColumn("_batch", F.lit(b).cast("long")) for b in batches if b > first]
        if kept:
            parts.append(spark.read.schema(self.schema).parquet(f"{self.path}/whole/upto={first}").withColumn("_batch", F.lit(first).cast("long")))
        if not parts:
            return spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"))
        return rows.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at", "_batch")

    def compact(self, spark: SparkSession) -> None:
        """Writes the table as it is now; batches up to the last one are not read any more."""
        batches = _folders(spark, f"{self.path}/batches", "batch")
        kept = _folders(spark, f"{self.path}/whole", "upto")
        if batches and (not kept or kept[-1] < batches[-1]):
            self.read(spark).write.mode("overwrite").parquet(f"{self.path}/whole/upto={batches[-1]}")


def start_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 100) -> StreamingQuery:
    """Runs ``stream`` in update mode into ``table`` over what is there now."""

    def into(rows: DataFrame, batch_id: int) -> None:
        table.write(rows, batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(rows.sparkSession)

    return stream.writeStream.outputMode("update").foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stream: DataFrame, keys: Sequence[str], folder: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The table of ``stream`` once all that is there now is taken in; ``then`` completes rows when they are read."""
    table = KeyedTable(f"{folder}/table", keys, stream.schema)
    start_upserts(stream, table, f"{folder}/checkpoint").awaitTermination()
    rows = table.read(stream.sparkSession)
    return then(rows) if then else rows
