"""What used to have a bound or lose rows: long series, late files, plans without sorts."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import bars, regress, stats
from marketspark.sources import readers, sinks
from marketspark.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"


def block_by_numpy(x):
    n, x = len(x), x - x.mean()
    most = int(min(n - 1, np.floor(10 * np.log10(n))))
    acf = [(x[k:] * x[:-k]).sum() / (x * x).sum() for k in range(1, most + 1)]
    m = next((k for k, r in enumerate(acf, 1) if abs(r) < 1.96 / np.sqrt(n)), most)
    return max(2, min(int(np.ceil((2.0 * m) ** (1 / 3) * n ** (1 / 3))), max(2, n // 4)))


def test_block_length_of_long_series(spark):
    rng = np.random.default_rng(1)
    series = {"walk": np.cumsum(rng.normal(size=50_000)), "noise": rng.normal(size=50_000), "short": rng.normal(size=7), "flat": np.ones(20)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    got = {r["symbol"]: r["block"] for r in stats.block_length(spark.createDataFrame(rows, "symbol string, ts long, ret double")).collect()}
    assert got.pop("flat") == 2
    assert got == {k: block_by_numpy(series[k]) for k in got}
    # all 46 lags of the walk are significant: a bound of 40 would have shortened its blocks
    assert got["walk"] == int(np.ceil((2 * 46) ** (1 / 3) * 50_000 ** (1 / 3)))


@pytest.mark.parametrize("n", [12, 50_000])
def test_newey_west_of_long_series(spark, n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    noise = rng.normal(size=n)
    y = 0.1 + x @ [0.5, -0.2] + noise + 0.6 * np.roll(noise, 1)
    frame = spark.createDataFrame([("a", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "symbol string, ts long, y double, u double, v double")
    row = regress.ols_newey_west(frame, "y", ["u", "v"], keys=["symbol"]).first()
    design = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(design.T @ design)
    scores = design * (y - design @ (inv @ design.T @ y))[:, None]
    lag = int(np.floor(4 * (n / 100) ** (2 / 9)))
    meat = scores.T @ scores
    for j in range(1, lag + 1):
        g = scores[j:].T @ scores[:-j]
        meat += (1 - j / (lag + 1)) * (g + g.T)
    assert row["lag"] == lag and (n < 100 or lag > 12)
    assert row["se"] == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)), rel=1e-6)


def fill(ts, px, sz=1.0, **more):
    return {"coin": "X", "time": str(ts), "px": str(px), "sz": str(sz), "side": "B", "dir": "Open Long", "crossed": True, "closedPnl": "0", "fee": "0.1", "startPosition": "0"} | more


def lines(spark, *fills):
    return spark.createDataFrame([(json.dumps({"events": [["who", f] for f in fills]}),)], "value string")


DAY = 86_400_000


def test_late_file_loses_no_row(spark, tmp_path):
    fills, made = str(tmp_path / "fills"), str(tmp_path / "bars")
    monday = 4 * DAY
    twin = fill(monday + 5, 10)
    sinks.ingest_fills(lines(spark, twin, twin, fill(monday + 9, 11)), fills, made, "1w")
    sinks.ingest_fills(lines(spark, fill(monday + 7, 14)), fills, made, "1w")  # same day, later file
    sinks.ingest_fills(lines(spark, fill(monday + 3 * DAY, 8), twin), fills, made, "1w")  # same week, another day; one fill again
    sinks.ingest_fills(lines(spark, fill(monday + 9 * DAY, 20)), fills, made, "1w")  # next week
    stored = sinks.read_daily(spark, fills)
    assert sorted(r["ts"] - monday for r in stored.collect()) == [5, 5, 7, 9, 3 * DAY, 9 * DAY]
    got = sorted((r["ts"] - monday, r["open"], r["high"], r["low"], r["close"], r["num_trades"]) for r in sinks.read_daily(spark, made).collect())
    assert got == [(0, 10, 14, 8, 8, 5), (7 * DAY, 20, 20, 20, 20, 1)]


def test_merge_reads_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("X", d * DAY + k, float(k)) for d in range(9) for k in range(3)], "symbol string, ts long, v double")
    sinks.merge_daily(None, rows, path)
    late = spark.createDataFrame([("X", 4 * DAY + 1, 9.0), ("X", 4 * DAY + 7, 7.0)], "symbol string, ts long, v double")
    days = late.select("symbol", F.to_date(F.timestamp_millis("ts")).alias("date")).distinct()
    old = spark.createDataFrame([("X", 0, 1.0), ("X", 8 * DAY, 1.0)], "symbol string, ts long, v double").select("symbol", F.to_date(F.timestamp_millis("ts")).alias("date"))
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    # one fill of long ago doesn't make the merge read what lies between
    for touched, filters in ((days, {"1970-01-05"}), (old, {"1970-01-01", "1970-01-09"})):
        plan = sinks.touched_part(sinks.read_daily(spark, path), touched)._jdf.queryExecution().executedPlan().toString()
        cut = next(x for x in plan.split("\n") if re.search(r"PartitionFilters: \[[^\]]*date#", x)).split("PartitionFilters: [")[1].split("], ")[0]
        assert set(re.findall(r"1970-01-\d\d", cut)) == filters and (">=" not in cut)
    spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    sinks.merge_daily(sinks.read_daily(spark, path), late, path)
    after = {r["ts"]: r["v"] for r in sinks.read_daily(spark, path).collect()}
    assert len(after) == 28 and after[4 * DAY + 1] == 9.0 and after[4 * DAY] == 0.0
    sinks.merge_daily(sinks.read_daily(spark, path), late.withColumn("v", F.lit(0.5)), path, keep="first")
    assert {r["ts"]: r["v"] for r in sinks.read_daily(spark, path).collect()} == after


def test_bars_are_hash_aggregations(spark):
    t = Tables(spark, SMALL)
    for frame in (bars.bars_from_fills(t.fills, "1h"), t.bars, bars.bars_from_ticks(t.ticks, "1h"), bars.resample(t.type_bars, "4h"), bars.bars_from_books(t.books, "1h")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_latest_is_decided_on_ties(spark):
    log = spark.createDataFrame([(1, i) for i in range(50)], "ts long, seq long").repartition(7)
    assert [r["seq"] for r in readers.latest(log, 3, ties=["seq"]).collect()] == [49, 48, 47]
