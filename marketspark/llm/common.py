"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.session import shared_folder

#: A word is a run of bytes other than ASCII white space. ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order: str | Column, to: str = "pos", partitions: int | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the global order, without one task that sees all rows.

    Rows are range-partitioned and sorted inside the partitions; a partition's first place is the
    number of rows in the partitions before it. Only that list, one row a partition, is broadcast.
    With ``partitions`` Spark doesn't merge small ones, which would put rows of unlike sizes together.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stored(
        (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys))
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return dealt.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(to, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")
