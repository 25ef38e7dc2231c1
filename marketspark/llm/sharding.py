"""Sharding by Hilbert curve: rows close in several metadata dimensions land in the same file.

Language, source and length are quantised to cells of a cube, the cells are numbered along a
Hilbert curve, rows are sorted by (curve index, text hash, doc_id), and the order is cut into runs
of equal row counts. DataFrame operations only. Nothing but one row a partition and the few
category codes is broadcast; the sort is a range partitioning whose keys end in doc_id, so neither a
hot source nor a group of equal texts stays in one task.

Defined results: a null text is empty (size 8, checksum 0); null language or source is a category of
its own, the last; equal texts with equal metadata are neighbours in the order and share a shard
unless a cut falls among them; rows equal in all keys are interchangeable; an empty table gives no
rows; other columns ride along untouched, also those named like the result columns in ``shard_table``'s
input, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import positions

SHARDS = 24
#: Bits of a dimension; three dimensions make an index of 18 bits.
BITS = 6


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve (Skilling's transposed form, 2004); coordinates are longs below 2**bits.

    Higher-order functions carry the point as an array, so the expression's size doesn't depend on ``bits``.
    """
    dims = len(coordinates)
    point = F.array(*[c.cast("long") for c in coordinates])
    axes = F.array(*[F.lit(i) for i in range(dims)])

    def put(x: Column, first: Column, at: Column, value: Column) -> Column:
        return F.transform(x, lambda old, j: F.when(j == at, value).when(j == 0, first).otherwise(old))

    def turn(x: Column, bit: Column) -> Column:
        low = bit - 1

        def step(y: Column, i: Column) -> Column:
            mine, first = F.get(y, i), F.get(y, F.lit(0))
            swap = first.bitwiseXOR(mine).bitwiseAND(low)
            set_ = mine.bitwiseAND(bit) != 0
            flipped = first.bitwiseXOR(low)
            return put(
                y,
                F.when(set_, flipped).otherwise(first.bitwiseXOR(swap)),
                i,
                # on axis 0 only the inversion acts: there ``swap`` is 0
                F.when(set_, F.when(i == 0, flipped).otherwise(mine)).otherwise(mine.bitwiseXOR(swap)),
            )

        return F.aggregate(axes, x, step)

    bit_values = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def gray_coded(turned: Column) -> Column:
        # each axis takes on the bits of those before it
        return F.aggregate(
            axes,
            F.array().cast("array<long>"),
            lambda acc, i: F.concat(acc, F.array(F.when(i == 0, F.get(turned, i)).otherwise(F.get(turned, i).bitwiseXOR(F.get(acc, i - 1))))),
        )

    def corrected(gray: Column) -> Column:
        last = F.get(gray, F.lit(dims - 1))
        fix = F.aggregate(bit_values, F.lit(0).cast("long"), lambda acc, bit: F.when(last.bitwiseAND(bit) != 0, acc.bitwiseXOR(bit - 1)).otherwise(acc))
        return _once(fix, lambda f: F.transform(gray, lambda g: g.bitwiseXOR(f)))

    def interleaved(axes_bits: Column) -> Column:
        return F.aggregate(
            levels,
            F.lit(0).cast("long"),
            lambda acc, b: F.aggregate(axes_bits, acc, lambda a, g: a * 2 + F.call_function("shiftright", g, b).bitwiseAND(F.lit(1))),
        )

    turned = F.aggregate(bit_values, point, turn)
    return _once(turned, lambda t: _once(gray_coded(t), lambda g: _once(corrected(g), interleaved)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def category_codes(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, code): distinct values in order, null last, spread over 2**bits codes."""
    ranked = positions(df.select(F.col(column).alias("_value")).distinct(), F.col("_value").asc_nulls_last())
    total = ranked.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).select("_value", F.when(F.col("_n") <= 1 << bits, F.col("pos")).otherwise(F.floor(F.col("pos") * (1 << bits) / F.col("_n"))).alias("_code"))


def shard_table(docs: DataFrame, n_shards: int = SHARDS, payload: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``payload`` columns of every row with size, text_crc32, law, shard, slot and grown_shard.

    Law ``rows``: shards hold the same number of rows, or one more.
    """
    kept = [c for c in payload if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *kept,
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.col("doc_id").alias("_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_hash"),
    )
    languages = category_codes(docs, "lang").withColumnRenamed("_code", "_lang_code")
    sources = category_codes(docs, "source").withColumnRenamed("_code", "_source_code")
    length_class = F.least(F.floor(F.log2(F.col("size")) * 4).cast("long"), F.lit((1 << BITS) - 1))
    placed = (
        rows.join(languages, rows["_lang"].eqNullSafe(languages["_value"])).drop("_value", "_lang")
        .join(sources, rows["_source"].eqNullSafe(sources["_value"])).drop("_value", "_source")
        .withColumn("_curve", hilbert_index([F.col("_lang_code"), F.col("_source_code"), length_class]))
        .drop("_lang_code", "_source_code")
    )
    ordered = positions(placed, "_curve", "_hash", "_id", to="_pos", partitions=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = docs.agg(F.count("*").alias("_total"))
    with_total = ordered.crossJoin(F.broadcast(total))
    # shard k holds places ceil(k*total/n) .. ceil((k+1)*total/n) - 1
    shard = F.expr(f"(_pos * {n_shards}) div _total").cast("int")
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    return (
        with_total.withColumn("shard", shard).withColumn("slot", F.col("_pos") - first)
        .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*kept, "size", "text_crc32", "law", "shard", "slot", "grown_shard", F.col("_curve").alias("curve_index"))
    )
