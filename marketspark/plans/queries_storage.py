"""Time ranges, incremental ingest, snapshot lines and the experiment log: each written, read back and compared."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.plans.queries_sources import _fill_lines
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import flow_bars_sql, with_
from marketspark.sources import readers, sinks
from marketspark.sources.tables import Tables
from marketspark.streaming.feeds import scratch_folder

_RANGE = ("1997-03-01", "1998-06-30T00:00:00Z")


@query(
    "src_02_time_range",
    "symbol ts num_trades",
    "close volume",
    with_("bars", "SELECT * FROM bars WHERE ts >= epoch_ms(TIMESTAMP '1997-03-01') AND ts <= epoch_ms(TIMESTAMP '1998-06-30')"),
)
def _(t: Tables) -> DataFrame:
    return readers.in_time(t.bars, *_RANGE)


@query(
    "snk_06_ingest_bars",
    "symbol ts tf num_trades",
    "open high low close volume buy_volume sell_volume total_pnl total_fees",
    with_("fills", flow_bars_sql("few", 604_800_000, 345_600_000).replace("row(ts, seq)", "row(ts, round(price * 1e8))").replace("SELECT *, 1.0", "SELECT *, '1w' AS tf, 1.0"),
        few="SELECT * REPLACE ('V' || (CAST(substr(symbol, 2) AS BIGINT) % 4) AS symbol) FROM fills WHERE seq % 10 <> 9"),
)
def _(t: Tables) -> DataFrame:
    """Two files of the same days, the second one twice."""
    folder = scratch_folder(t.spark)
    few = F.concat(F.lit("V"), F.pmod(F.substring("symbol", 2, 20).cast("long"), F.lit(4)))
    lines = _fill_lines(SimpleNamespace(fills=t.fills.withColumn("symbol", few)))
    late = F.pmod(F.xxhash64("value"), F.lit(3)) == 0
    for part in (lines.where(~late), lines.where(late), lines.where(late)):
        sinks.ingest_fills(part, f"{folder}/fills", f"{folder}/bars", "1w")
    return sinks.read_daily(t.spark, f"{folder}/bars")


@query(
    "src_09_snapshot_lines",
    "symbol ts n",
    "price",
    with_("type_ticks", "SELECT symbol, ts // 3600000 * 3600000 AS ts, count(*) AS n, max(price) AS price FROM type_ticks GROUP BY symbol, type_ticks.ts // 3600000"),
)
def _(t: Tables) -> DataFrame:
    """Snapshots appended in two batches that overlap (SNK-04), read without repeats."""
    path = f"{scratch_folder(t.spark)}/snapshots"
    hours = t.type_ticks.groupBy("symbol", (F.col("ts") - F.pmod("ts", F.lit(3_600_000))).alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("price"))
    sinks.append_lines(hours.where(F.pmod(F.xxhash64("symbol", "ts"), F.lit(4)) < 3), path)
    sinks.append_lines(hours.where(F.pmod(F.xxhash64("symbol", "ts"), F.lit(4)) > 1), path)
    return readers.read_lines(t.spark, path, "symbol string, ts long, n long, price double")


_RUNS = "SELECT o_orderpriority AS strategy, o_orderkey AS run_id, epoch_ms(o_orderdate) AS ts, o_totalprice AS sharpe, o_custkey AS trades FROM orders"
_NEWEST = "SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, run_id DESC) AS age FROM runs"


def _logged(t: Tables) -> DataFrame:
    path = f"{scratch_folder(t.spark)}/runs"
    runs = t.raw("orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("run_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").alias("sharpe"), F.col("o_custkey").alias("trades"))
    for part in (0, 1):
        sinks.log_runs(runs.where(F.pmod("run_id", F.lit(2)) == part), path)
    return t.spark.read.parquet(path)


@query("snk_07_last_runs", "strategy run_id ts age trades", "sharpe", f"WITH runs AS ({_RUNS}), newest AS ({_NEWEST}) SELECT * FROM newest WHERE age <= 20")
def _(t: Tables) -> DataFrame:
    return sinks.last_runs(_logged(t), 20)


@query(
    "snk_07_run_deltas",
    "strategy run_id before_id",
    "d_sharpe d_trades",
    f"WITH runs AS ({_RUNS}), newest AS ({_NEWEST}) SELECT a.strategy, a.run_id, b.run_id AS before_id, a.sharpe - b.sharpe AS d_sharpe, a.trades - b.trades AS d_trades FROM newest a JOIN newest b USING (strategy) WHERE a.age = 1 AND b.age = 2",
)
def _(t: Tables) -> DataFrame:
    return sinks.run_deltas(_logged(t), ["sharpe", "trades"])
