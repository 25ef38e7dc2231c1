"""Bar construction: fills, ticks, coarser bars, volume and dollar bars, book bars.

Everything from ticks to bars is one hash aggregation with map-side partials, so a symbol that
holds a third of all ticks costs no single task more than its share of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.functions.timefn import bucket
from marketspark.operators.series import ordered_fold, series_window, through_now


def _sum_if(value: str, cond: Column) -> Column:
    return F.sum(F.when(cond, F.col(value)).otherwise(0.0))


def moment(ts: str = "ts", seq: str = "seq") -> Column:
    """Time and order number (a whole number of at most 25 digits, not negative) as one number.

    ``min_by``/``max_by`` over a struct would need a sort of all rows before and after the
    shuffle, over a number they are a hash aggregation.
    """
    return F.col(ts).cast("decimal(13,0)").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") * F.lit(10**13).cast("decimal(14,0)") + F.coalesce(F.col(seq).cast("decimal(25,0)"), F.lit(0))


def _first(value: str, *order: str) -> Column:
    return F.min_by(value, moment(*order) if len(order) > 1 else order[0])


def _last(value: str, *order: str) -> Column:
    return F.max_by(value, moment(*order) if len(order) > 1 else order[0])


def bars_from_fills(fills: DataFrame, tf: str) -> DataFrame:
    """Fills → bars with order flow. Only taker fills count, since both sides of a trade are
    recorded. ``seq`` orders fills of the same millisecond (see ``moment``)."""
    opens, longs = F.col("is_open"), F.col("is_long")
    buys = opens == longs
    out = (
        fills.where("crossed")
        .groupBy("symbol", bucket("ts", tf).alias("bar_ts"))
        .agg(
            _first("price", "ts", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            _last("price", "ts", "seq").alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
            _sum_if("size", buys).alias("buy_volume"),
            _sum_if("size", ~buys).alias("sell_volume"),
            _sum_if("size", opens & longs).alias("opens_long"),
            _sum_if("size", ~opens & longs).alias("closes_long"),
            _sum_if("size", opens & ~longs).alias("opens_short"),
            _sum_if("size", ~opens & ~longs).alias("closes_short"),
            F.sum("closed_pnl").alias("total_pnl"),
            F.sum("fee").alias("total_fees"),
        )
    )
    return out.withColumnRenamed("bar_ts", "ts").withColumns(
        {
            "taker_ratio": F.lit(1.0),
            "volume_delta": F.col("buy_volume") - F.col("sell_volume"),
            "net_flow": F.col("opens_long") - F.col("closes_long") - F.col("opens_short") + F.col("closes_short"),
        }
    )


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """Plain price/size ticks → OHLCV."""
    return (
        ticks.groupBy("symbol", bucket("ts", tf).alias("bar_ts"))
        .agg(
            _first("price", "ts", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            _last("price", "ts", "seq").alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Bars → coarser bars (left-closed; weeks start on Monday). Absent columns stay absent."""
    rules = {
        "open": _first("open", "ts"),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": _last("close", "ts"),
        "volume": F.sum("volume"),
        "num_trades": F.sum("num_trades"),
    }
    aggs = [agg.alias(n) for n, agg in rules.items() if n in bars.columns]
    return bars.groupBy("symbol", bucket("ts", tf).alias("bar_ts")).agg(*aggs).withColumnRenamed("bar_ts", "ts")


def threshold_bars(bars: DataFrame, threshold: float, *, dollar: bool = False, mode: str = "reset") -> DataFrame:
    """Volume bars (or dollar bars, on close × volume) from fine time bars.

    ``reset``: the running amount restarts at zero when a bar closes, the overshoot is lost.
    Sequential per symbol, hence on bars (calendar-bounded), not on raw ticks.
    ``carry``: the overshoot counts towards the next bar, which makes the bar number a function
    of the running total and needs no state.
    A trailing partial bar is kept. The bar time is that of its last row.
    """
    if threshold <= 0:
        raise ValueError(f"threshold must be positive; got {threshold}")
    amount = F.col("close") * F.col("volume") if dollar else F.col("volume")
    work = bars.withColumn("_amt", amount)
    if mode == "carry":
        # exact sums: totals that just reach a multiple of the threshold are common, and binary sums miss it by a digit
        before = F.sum("_exact").over(through_now(series_window())) - F.col("_exact")
        work = work.withColumn("_exact", F.col("_amt").cast("decimal(28,9)")).withColumns({"_before": before, "_thr": F.lit(str(threshold)).cast("decimal(28,9)")})
        work = work.withColumn("bar", F.expr("_before div _thr - CASE WHEN _before % _thr < 0 THEN 1 ELSE 0 END"))
    elif mode == "reset":

        def step(state: tuple[int, float], row: tuple) -> tuple[tuple[int, float], tuple]:
            number, filled = state
            filled += row[0]
            return ((number + 1, 0.0) if filled >= threshold else (number, filled)), (number,)

        work = ordered_fold(work, lambda: (0, 0.0), step, ["_amt"], T.StructType([T.StructField("bar", T.LongType())]))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return work.groupBy("symbol", "bar").agg(
        F.max("ts").alias("ts"),
        _first("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        _last("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )


def _notional(levels: Column) -> Column:
    return F.transform(levels, lambda x: x["px"] * x["sz"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def book_features(snapshots: DataFrame, levels: int = 10) -> DataFrame:
    """Depth, imbalance, spread and walls of each snapshot; one-sided books are dropped."""
    if levels < 1:
        raise ValueError(f"levels must be at least 1; got {levels}")
    two_sided = snapshots.where((F.size("bids") > 0) & (F.size("asks") > 0)).withColumns(
        {
            "mid": (F.col("bids")[0]["px"] + F.col("asks")[0]["px"]) / 2,
            "_b": _notional(F.slice("bids", 1, levels)),
            "_a": _notional(F.slice("asks", 1, levels)),
        }
    )
    with_depth = two_sided.where("mid > 0").withColumns({"bid_depth": _total(F.col("_b")), "ask_depth": _total(F.col("_a"))})
    depth = F.col("bid_depth") + F.col("ask_depth")
    return with_depth.withColumns(
        {
            "imbalance": F.when(depth > 0, (F.col("bid_depth") - F.col("ask_depth")) / depth).otherwise(0.0),
            "spread_bps": (F.col("asks")[0]["px"] - F.col("bids")[0]["px"]) / F.col("mid") * 10_000,
            "bid_wall": F.array_max("_b"),
            "ask_wall": F.array_max("_a"),
        }
    ).drop("_b", "_a")


def bars_from_books(snapshots: DataFrame, tf: str, levels: int = 10) -> DataFrame:
    """Book snapshots → mid-price bars with mean depth, imbalance and spread, and the largest walls."""
    return (
        book_features(snapshots, levels)
        .groupBy("symbol", bucket("ts", tf).alias("bar_ts"))
        .agg(
            _first("mid", "ts").alias("open"),
            F.max("mid").alias("high"),
            F.min("mid").alias("low"),
            _last("mid", "ts").alias("close"),
            F.avg("bid_depth").alias("bid_depth"),
            F.avg("ask_depth").alias("ask_depth"),
            F.avg("imbalance").alias("imbalance"),
            F.avg("spread_bps").alias("spread_bps"),
            F.max("bid_wall").alias("max_bid_wall"),
            F.max("ask_wall").alias("max_ask_wall"),
            F.count(F.lit(1)).alias("n_snapshots"),
        )
        .withColumnRenamed("bar_ts", "ts")
        .withColumns({"volume": F.lit(None).cast("double"), "num_trades": F.lit(None).cast("long")})
    )


def merge_book_bars(bars: DataFrame, tf: str) -> DataFrame:
    """Roll book bars up to ``tf``; means are weighted by the number of snapshots."""
    means = ["bid_depth", "ask_depth", "imbalance", "spread_bps"]
    n = F.sum("n_snapshots")
    return (
        bars.groupBy("symbol", bucket("ts", tf).alias("bar_ts"))
        .agg(
            _first("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            _last("close", "ts").alias("close"),
            *[(F.sum(F.col(m) * F.col("n_snapshots")) / n).alias(m) for m in means],
            F.max("max_bid_wall").alias("max_bid_wall"),
            F.max("max_ask_wall").alias("max_ask_wall"),
            n.alias("n_snapshots"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), keep: str = "last") -> DataFrame:
    """Keyed merge of two row sets, one row per key. ``last``: incoming rows win; ``first``: existing rows win.
    Columns of one side only are kept and filled with NULL."""
    rank = {"last": F.col("_side").desc(), "first": F.col("_side").asc()}[keep]
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in both.columns if c not in (*keys, "_side")]
    w = Window.partitionBy(*keys).orderBy(rank, *rest)
    return both.withColumn("_pick", F.row_number().over(w)).where("_pick = 1").drop("_side", "_pick")
