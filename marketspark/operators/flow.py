"""Trade tape and order-book flow in time windows: the batch forms. The streaming forms in
``marketspark.streaming`` give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import bucket
from marketspark.operators.series import day_of, lookback, running_sums, windowed


def tape_columns() -> dict[str, Column]:
    """Derived columns over buy/sell volume and count, notional, and large volume."""
    total = F.col("buy_volume") + F.col("sell_volume")
    buy_ratio = F.col("buy_volume") / total
    return {
        "total_volume": total,
        "trade_count": F.col("buy_count") + F.col("sell_count"),
        "vwap": F.col("notional") / total,
        "imbalance": (F.col("buy_volume") - F.col("sell_volume")) / total,
        "large_buy_volume": F.col("large_volume") * buy_ratio,
        "large_sell_volume": F.col("large_volume") * (1 - buy_ratio),
        "volume_delta": F.col("buy_volume") - F.col("sell_volume"),
    }


# A trade is large above 10 medians, and above this size.
LARGE_MULTIPLE = 10
LARGE_FLOOR = 0.001


def size_counts(grouped, buy_side: str = "B") -> DataFrame:
    """Counts and price sum of trades grouped by size (and symbol and window)."""
    buy = F.col("side") == buy_side
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(buy, 1)).alias("buy_count"),
        F.count(F.when(~buy, 1)).alias("sell_count"),
        F.sum("price").alias("px_sum"),
    )


def trade_tape(trades: DataFrame, tf: str = "1m", buy_side: str = "B") -> DataFrame:
    """Per symbol and window: buy and sell volume and count, VWAP, imbalance, large volume.

    Large means above ten times the median size (the upper one of two). The median comes from
    counts per distinct size, so no window's trades are ever collected in one place.
    """
    return tape_of_sizes(size_counts(trades.groupBy("symbol", bucket("ts", tf).alias("bar_ts"), "size"), buy_side))


def tape_of_sizes(sizes: DataFrame) -> DataFrame:
    """The tape of trades counted by (symbol, bar_ts, size)."""
    w = Window.partitionBy("symbol", "bar_ts")
    upto = w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumns({"_cum": F.sum("n").over(upto), "_all": F.sum("n").over(w)})
    middle = F.floor(F.col("_all") / 2)
    holds_middle = (F.col("_cum") > middle) & (F.col("_cum") - F.col("n") <= middle)
    ranked = ranked.withColumn("_median", F.max(F.when(holds_middle, F.col("size"))).over(w))
    large = F.col("size") > F.greatest(F.col("_median") * LARGE_MULTIPLE, F.lit(LARGE_FLOOR))
    tape = ranked.groupBy("symbol", F.col("bar_ts").alias("ts")).agg(
        F.sum(F.col("size") * F.col("buy_count")).alias("buy_volume"),
        F.sum(F.col("size") * F.col("sell_count")).alias("sell_volume"),
        F.sum("buy_count").alias("buy_count"),
        F.sum("sell_count").alias("sell_count"),
        F.sum(F.col("size") * F.col("px_sum")).alias("notional"),
        F.sum(F.when(large, F.col("size") * F.col("n")).otherwise(0.0)).alias("large_volume"),
    )
    return tape.where(F.col("buy_volume") + F.col("sell_volume") > 0).withColumns(tape_columns())


def cumulative_delta(tape: DataFrame) -> DataFrame:
    """Running volume delta over the tape windows of each symbol."""
    return running_sums(tape, {"cvd": F.col("volume_delta")}, slice_by=day_of())


def relative_tape_volume(tape: DataFrame, window: int = 60, least: int = 5) -> DataFrame:
    """Volume of the window over the mean of the last ``window`` ones; 1 while fewer than ``least``."""

    def build(df: DataFrame, w) -> DataFrame:
        frame = lookback(w, window)
        mean = F.avg("total_volume").over(frame)
        ready = (F.count("total_volume").over(frame) >= least) & (mean > 0)
        return df.withColumn("relative_volume", F.when(ready, F.col("total_volume") / mean).otherwise(1.0))

    return windowed(tape, build, reach=window, slice_by=day_of())


def depth_of(snapshots: DataFrame, levels: int = 10) -> DataFrame:
    """Size depth of the first levels on each side and the relative spread of each snapshot."""

    def side(name: str) -> Column:
        return F.aggregate(F.slice(name, 1, levels), F.lit(0.0), lambda acc, x: acc + x["sz"])

    bid = F.when(F.size("bids") > 0, F.col("bids")[0]["px"]).otherwise(0.0)
    ask = F.when(F.size("asks") > 0, F.col("asks")[0]["px"]).otherwise(0.0)
    return snapshots.withColumns(
        {"bid_depth": side("bids"), "ask_depth": side("asks"), "spread": F.when((bid > 0) & (ask > 0), (ask - bid) / bid).otherwise(0.0)}
    )


def orderflow_windows(snapshots: DataFrame, tf: str = "5m", levels: int = 10) -> DataFrame:
    """Mean depth, depth that vanished since the snapshot before, phantom ratios and spread per window."""

    def build(df: DataFrame, w) -> DataFrame:
        gone = {}
        for side in ("bid", "ask"):
            before = F.lag(f"{side}_depth").over(w)
            gone[f"{side}_gone"] = F.when(before > 0, F.greatest(F.lit(0.0), before - F.col(f"{side}_depth"))).otherwise(0.0)
        return df.withColumns(gone)

    diffs = windowed(depth_of(snapshots, levels).select("symbol", "ts", "bid_depth", "ask_depth", "spread"), build, reach=1, slice_by=day_of())
    return summarise_orderflow(diffs.groupBy("symbol", bucket("ts", tf).alias("bar_ts")), "bar_ts")


def summarise_orderflow(grouped, ts: str) -> DataFrame:
    sums = grouped.agg(
        F.avg("bid_depth").alias("avg_bid_depth"),
        F.avg("ask_depth").alias("avg_ask_depth"),
        F.sum("bid_gone").alias("bid_vanished"),
        F.sum("ask_gone").alias("ask_vanished"),
        (F.avg("spread") * 10_000).alias("avg_spread_bps"),
        F.count(F.lit(1)).alias("snapshots"),
    )
    total = F.col("avg_bid_depth") + F.col("avg_ask_depth")

    def phantom(side: str) -> Column:
        mean = F.col(f"avg_{side}_depth")
        return F.when(mean > 0, F.col(f"{side}_vanished") / (mean * F.col("snapshots"))).otherwise(0.0)

    out = sums.withColumns(
        {"bid_ratio": F.when(total > 0, F.col("avg_bid_depth") / total).otherwise(0.5), "phantom_bid": phantom("bid"), "phantom_ask": phantom("ask")}
    )
    return out.withColumnRenamed(ts, "ts") if ts != "ts" else out


def latest_quotes(snapshots: DataFrame) -> DataFrame:
    """Latest best bid and offer of each symbol."""
    last = snapshots.groupBy("symbol").agg(F.max_by(F.struct("ts", "bids", "asks"), F.col("ts")).alias("q"))
    return last.select("symbol", "q.ts", *quote_columns("q.bids", "q.asks"))


def quote_columns(bids: str, asks: str) -> list[Column]:
    def top(levels: str, field: str) -> Column:
        return F.when(F.size(levels) > 0, F.col(levels)[0][field]).otherwise(0.0)

    bid_px, bid_sz, ask_px, ask_sz = top(bids, "px"), top(bids, "sz"), top(asks, "px"), top(asks, "sz")
    return [
        bid_px.alias("bid_px"),
        bid_sz.alias("bid_sz"),
        ask_px.alias("ask_px"),
        ask_sz.alias("ask_sz"),
        F.when(bid_sz + ask_sz > 0, bid_sz / (bid_sz + ask_sz)).otherwise(0.5).alias("bid_ratio"),
        F.when((bid_px > 0) & (ask_px > 0), (ask_px - bid_px) / bid_px * 10_000).otherwise(0.0).alias("spread_bps"),
    ]


def vault_positions(vaults: DataFrame, positions: DataFrame, top: int = 20) -> DataFrame:
    """Of the ``top`` vaults by equity: how many are long and short each symbol, and their net notional."""
    leaders = vaults.where("equity > 0").orderBy(F.desc("equity"), "vault").limit(top)
    held = positions.where("size <> 0").join(leaders.select("vault"), "vault")
    return held.groupBy("symbol").agg(
        F.count(F.when(F.col("size") > 0, 1)).alias("num_long"),
        F.count(F.when(F.col("size") < 0, 1)).alias("num_short"),
        F.count(F.lit(1)).alias("total_vaults"),
        F.sum(F.col("size") * F.col("entry_px")).alias("net_notional"),
    )
