"""Streams against their batch forms: rows out of order, open windows, batches that are run again, late rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketspark.operators import flow
from marketspark.streaming import feeds, upserts

TRADES = "symbol string, ts long, price double, size double, side string"
MINUTE = 60_000
BASE = 1_800_000 * 900_000


def feed(spark, rows, folder, files):
    """``rows`` as a stream of ``files`` files in the order given."""
    rows = rows.withColumn("time", F.timestamp_millis("ts")) if "time" not in rows.columns else rows
    parts = rows.count() // files + 1
    everything = rows.collect()
    for k in range(files):
        part = everything[k * parts : (k + 1) * parts]
        if part:
            spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def trades(spark, seed, n=400, jitter=8 * MINUTE):
    rng = random.Random(seed)
    rows = [(rng.choice("AB"), BASE + rng.randrange(120 * MINUTE), 100.0 + rng.randrange(50) / 10, float(rng.choice([1, 1, 2, 3, 50])), rng.choice("BA")) for _ in range(n)]
    rows.sort(key=lambda r: r[1] + rng.random() * jitter)
    return spark.createDataFrame(rows, TRADES)


def rounded(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_tape_of_open_windows(spark, tmp_path):
    rows = trades(spark, 1)
    stream = feed(spark, rows, str(tmp_path / "feed"), 5)
    table = upserts.upserted(feeds.tape_stream(stream, "5 minutes", "10 minutes"), ["symbol", "bar_ts", "size"], str(tmp_path / "out"), flow.tape_of_sizes)
    want = flow.trade_tape(rows, "5m")
    assert rounded(table, *want.columns) == rounded(want, *want.columns)


@pytest.mark.parametrize("files", [1, 6])
def test_running_tape_of_shuffled_batches(spark, tmp_path, files):
    rows = trades(spark, 2)
    stream = feed(spark, rows, str(tmp_path / "feed"), files)
    got = upserts.upserted(feeds.running_tape(stream, "5m", "10 minutes"), ["symbol", "ts"], str(tmp_path / "out"))
    tape = flow.trade_tape(rows, "5m")
    want = flow.cumulative_delta(tape).join(flow.relative_tape_volume(tape).select("symbol", "ts", "relative_volume"), ["symbol", "ts"])
    columns = ("symbol", "ts", "volume_delta", "total_volume", "cvd", "relative_volume")
    assert rounded(got, *columns) == rounded(want, *columns)


def test_order_flow_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(3)
    levels = lambda px: [(px + k, float(rng.randrange(1, 9))) for k in range(rng.randrange(3))]
    rows = [(s, BASE + t * MINUTE, levels(99.0), levels(101.0)) for s in "AB" for t in range(90)]
    rows.sort(key=lambda r: r[1] + rng.random() * 8 * MINUTE)
    books = spark.createDataFrame(rows, "symbol string, ts long, bids array<struct<px: double, sz: double>>, asks array<struct<px: double, sz: double>>")
    stream = feed(spark, books, str(tmp_path / "feed"), 6)
    diffs = upserts.upserted(feeds.orderflow_diffs(stream, delay="10 minutes"), ["symbol", "ts"], str(tmp_path / "out"))
    assert diffs.count() == 180
    got = flow.summarise_orderflow(diffs.groupBy("symbol", (F.floor(F.col("ts") / (30 * MINUTE)) * 30 * MINUTE).alias("bar_ts")), "bar_ts")
    want = flow.orderflow_windows(books, "30m")
    assert rounded(got, *want.columns) == rounded(want, *want.columns)


def test_settled_rows_leave_the_state(spark, tmp_path):
    # one row a minute for a day, in 6 files: what waits is what lies within the delay
    rows = spark.range(1440).select(F.lit("A").alias("symbol"), (F.col("id") * MINUTE + BASE).alias("ts"), F.lit(1.0).alias("price"), F.lit(1.0).alias("size"), F.lit("B").alias("side"))
    stream = feed(spark, rows, str(tmp_path / "feed"), 6)
    table = upserts.KeyedTable(str(tmp_path / "out"), ["symbol", "ts"], feeds.running_tape(stream, "1m", "10 minutes").schema)
    upserts.start_upserts(feeds.running_tape(stream, "1m", "10 minutes"), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert table.read(spark).agg(F.max("cvd")).first()[0] == 1440.0
    last = spark.read.parquet(str(tmp_path / "out" / "batches" / "batch=5")).count()
    # a batch rewrites its own 240 minutes and those that waited: the file before it, which only then falls behind the watermark
    assert last <= 2 * 240 + 11


def test_window_of_many_trades_keeps_a_state_row_a_size(spark, tmp_path):
    rows = spark.range(1_000_000).select(
        F.lit("A").alias("symbol"), (F.col("id") % MINUTE + BASE).alias("ts"), F.lit(1.0).alias("price"), (F.col("id") % 20 + 1).cast("double").alias("size"), F.lit("B").alias("side"), F.timestamp_millis(F.col("id") % MINUTE + BASE).alias("time")
    )
    rows.repartition(2).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    table = upserts.KeyedTable(str(tmp_path / "out"), ["symbol", "bar_ts", "size"], feeds.tape_stream(stream).schema)
    run = upserts.start_upserts(feeds.tape_stream(stream), table, str(tmp_path / "checkpoint"))
    run.awaitTermination()
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) == 20
    tape = flow.tape_of_sizes(table.read(spark)).collect()
    assert len(tape) == 1 and tape[0]["buy_count"] == 1_000_000


def test_batch_run_again_counts_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    table = upserts.KeyedTable(str(tmp_path), ["k"], rows(("a", 1)).schema)
    read = lambda: {r["k"]: r["v"] for r in table.read(spark).collect()}
    assert read() == {}
    table.write(rows(("a", 1), ("b", 1)), 0)
    table.write(rows(("a", 2), ("c", 2)), 1)
    table.write(rows(("a", 2), ("c", 2)), 1)  # the driver was lost after the write
    assert read() == {"a": 2, "b": 1, "c": 2}
    table.compact(spark)
    assert read() == {"a": 2, "b": 1, "c": 2}
    table.write(rows(("b", 3)), 2)
    assert read() == {"a": 2, "b": 3, "c": 2}
    (tmp_path / "batches" / "batch=2" / "_SUCCESS").unlink()  # a batch that didn't finish isn't read
    assert read() == {"a": 2, "b": 1, "c": 2}


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    on_time = [("A", BASE + k * MINUTE, k) for k in range(120)]
    late = [("A", BASE + k * MINUTE, 1000 + k) for k in range(7)]
    rows = spark.createDataFrame([*on_time[:100], *on_time[100:], *late], "symbol string, ts long, seq long").coalesce(1)
    stream = feed(spark, rows, str(tmp_path / "feed"), 4)
    counter = feeds.LateCounter()
    spark.streams.addListener(counter)
    once = stream.withWatermark("time", "10 minutes").dropDuplicatesWithinWatermark(["symbol", "seq"])
    run = feeds.run_available(once, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(counter)
    kept = feeds.late_rows_of(stream, 10 * MINUTE, str(tmp_path / "side"))
    assert counter.dropped[str(run.id)] == 7 and sorted(r["seq"] for r in kept.collect()) == [1000 + k for k in range(7)]
