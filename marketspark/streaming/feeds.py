"""Streaming forms of tape, bars, order flow, quotes and collection on event time with watermarks.

The batch forms are in ``operators.flow`` and ``operators.bars``; on the same rows both give the same
result, open windows included: streams write in update mode into a table by key (``upserts``). Rows
later than the watermark are dropped (counted by ``LateCounter``, kept by ``late_rows_of``).
Streams carry ``time`` (timestamp) next to ``ts`` (epoch ms).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marketspark.functions.timefn import HOUR_MS, interval_ms
from marketspark.operators.bars import moment
from marketspark.operators.flow import depth_of, quote_columns, size_counts
from marketspark.session import shared_folder
from marketspark.streaming.ordered import OrderedFold, folded


def _windowed(stream: DataFrame, tf: str, delay: str):
    return stream.withWatermark("time", delay).groupBy("symbol", F.window("time", tf).alias("w"))


def tape_stream(trades: DataFrame, tf: str = "1 minute", delay: str = "2 minutes", buy_side: str = "B") -> DataFrame:
    """Trades of each symbol and window by distinct size, which ``flow.tape_of_sizes`` makes a tape of.

    State is a row for each size, not a list in the window's row: a window of any number of trades is spread
    over tasks and holds as many rows as there are sizes. Write it in update mode by (symbol, bar_ts, size).
    """
    grouped = trades.withWatermark("time", delay).groupBy("symbol", F.window("time", tf).alias("w"), "size")
    return size_counts(grouped, buy_side).withColumn("bar_ts", F.unix_millis("w.start")).drop("w")


def bars_stream(ticks: DataFrame, tf: str = "1 hour", delay: str = "2 hours", tie: str = "seq") -> DataFrame:
    """OHLCV bars per symbol and window; write it in update mode by (symbol, ts)."""
    order = moment("ts", tie)
    agg = _windowed(ticks, tf, delay).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("num_trades"),
    )
    return agg.withColumn("ts", F.unix_millis("w.start")).drop("w")


def with_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Stream–static join: the funding rate of the bar's hour, 0 where unknown."""
    rates = funding.groupBy("symbol", (F.col("ts") - F.pmod("ts", F.lit(HOUR_MS))).alias("_hour")).agg(F.max_by("funding_rate", "ts").alias("funding_rate"))
    out = bars.withColumn("_hour", F.col("ts") - F.pmod("ts", F.lit(HOUR_MS))).join(rates, ["symbol", "_hour"], "left").drop("_hour")
    return out.withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First row per (symbol, ts) that arrives within the delay."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def latest_quote_stream(books: DataFrame) -> DataFrame:
    """Latest best bid and offer per symbol; write it in update mode."""
    last = books.groupBy("symbol").agg(F.max_by(F.struct("ts", "bids", "asks"), F.col("ts")).alias("q"))
    return last.select("symbol", "q.ts", *quote_columns("q.bids", "q.asks"))


def _vanished(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Depth lost since the symbol's snapshot before, whose depths are the state."""
    out = rows[["ts", "bid_depth", "ask_depth", "spread"]].copy()
    for side, before in zip(("bid", "ask"), state, strict=True):
        was = rows[f"{side}_depth"].shift(1, fill_value=before)
        out[f"{side}_gone"] = (was - rows[f"{side}_depth"]).clip(lower=0.0).where(was > 0, 0.0)
    return out, (float(rows["bid_depth"].iat[-1]), float(rows["ask_depth"].iat[-1])) if len(rows) else state


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


_TS = T.StructField("ts", T.LongType())
_DEPTHS = T.StructType([_TS, *_doubles("bid_depth", "ask_depth", "spread")])


def orderflow_diffs(books: DataFrame, levels: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Depth and vanished depth of every snapshot, in the order of their times; write it in update mode by (symbol, ts).
    Window summaries follow with ``flow.summarise_orderflow``."""
    depth = depth_of(books.withWatermark("time", delay), levels)
    processor = OrderedFold(_vanished, _DEPTHS, T.StructType(_doubles("bid", "ask")), (0.0, 0.0))
    return folded(depth, processor, "ts long, bid_depth double, ask_depth double, spread double, bid_gone double, ask_gone double", _DEPTHS.names[1:])


#: Windows that relative volume looks back on, and how many it needs.
RING, LEAST = 60, 5


def _running(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Running volume delta, and volume against the last windows, of one symbol; state is the sum and the ring."""
    total, ring = state[0], list(state[1])
    cvd, relative = [], []
    for delta, volume in zip(rows["volume_delta"], rows["total_volume"], strict=True):
        total += delta
        ring = [*ring, float(volume)][-RING:]
        mean = sum(ring) / len(ring)
        cvd.append(total)
        relative.append(volume / mean if len(ring) >= LEAST and mean > 0 else 1.0)
    out = rows[["ts", "volume_delta", "total_volume"]].assign(cvd=cvd, relative_volume=relative)
    return out.astype({"cvd": "float64", "relative_volume": "float64"}), (float(total), ring)


_VOLUMES = T.StructType([_TS, *_doubles("volume_delta", "total_volume")])


def running_tape(trades: DataFrame, tf: str = "1m", delay: str = "2 minutes", buy_side: str = "B") -> DataFrame:
    """Volume delta, its running sum and relative volume of the tape windows of a stream of trades; write it in update mode
    by (symbol, ts).

    Trades are summed by window inside each task before they go to their symbol's state, so that a busy symbol
    sends a few rows a batch. A sum is as late as its latest trade.
    """
    width = interval_ms(tf)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            if len(rows):
                rows["ts"] -= rows["ts"] % width
                sums = rows.groupby(["symbol", "ts"], as_index=False).agg(time=("time", "max"), volume_delta=("delta", "sum"), total_volume=("size", "sum"))
                yield pa.RecordBatch.from_pandas(sums, schema=kept, preserve_index=False)

    signed = F.when(F.col("side") == buy_side, F.col("size")).otherwise(-F.col("size"))
    slim = trades.select("symbol", "ts", F.unix_millis("time").alias("time"), "size", signed.alias("delta"))
    kept = pa.schema([("symbol", pa.string()), ("ts", pa.int64()), ("time", pa.int64()), ("volume_delta", pa.float64()), ("total_volume", pa.float64())])
    sums = slim.mapInArrow(summed, "symbol string, ts long, time long, volume_delta double, total_volume double")
    timed = sums.withColumn("time", F.timestamp_millis("time")).withWatermark("time", delay)
    processor = OrderedFold(_running, _VOLUMES, T.StructType([*_doubles("total"), T.StructField("ring", T.ArrayType(T.DoubleType()))]), (0.0, []), combine=True, span=width)
    return folded(timed, processor, "ts long, volume_delta double, total_volume double, cvd double, relative_volume double", _VOLUMES.names[1:])


def events_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder (or one file of it) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now into a Parquet table, and stop. The checkpoint makes reruns continue, also after
    a lost driver or executor."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class LateCounter(StreamingQueryListener):
    """Rows that stateful operators dropped behind the watermark, by query id. Register it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.id)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows_of(stream: DataFrame, delay_ms: int, folder: str) -> DataFrame:
    """The rows of ``stream`` that come behind the watermark, as a table: what stateful operators with that delay drop.

    A batch's watermark is the latest time of all batches before it less the delay. Each batch leaves its latest time
    in a folder named by its id, and its late rows likewise, so that a batch that is run again replaces both.
    """
    spark = stream.sparkSession
    late, times = f"{folder}/late", f"{folder}/times"

    def split(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        rows.agg(F.max(F.unix_millis("time")).alias("latest")).write.mode("overwrite").parquet(f"{times}/batch={batch_id}")
        seen = session.read.schema("latest long, batch long").parquet(times).where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        found = rows.where(F.unix_millis("time") <= F.lit(seen - delay_ms)) if seen is not None else rows.where(F.lit(False))
        found.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(late)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for tables and checkpoints of a stream, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
