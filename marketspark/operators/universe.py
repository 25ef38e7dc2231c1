"""Universes of symbols: selection, set algebra, browsing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_universe(assets: DataFrame, *, min_volume: float = 0.0, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Assets with enough volume, on the list (if any) and not excluded."""
    df = assets.where(F.coalesce("volume", F.lit(0.0)) >= min_volume)
    if include is not None:
        df = df.where(F.col("symbol").isin([s.upper() for s in include]))
    return df.where(~F.col("symbol").isin([s.upper() for s in exclude])) if exclude else df


def by_sector(assets: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Assets with any of the tags, whatever the case."""
    wanted = [s.lower() for s in sectors]
    return assets.where(F.exists("tags", lambda t: F.lower(t).isin(wanted)))


def top_by_volume(assets: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest by volume (a missing one counts lowest), in alphabetical order."""
    return assets.orderBy(F.desc(F.coalesce("volume", F.lit(-1.0))), "symbol").limit(n).orderBy("symbol")


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Union, intersection or difference by symbol; metadata comes from the first set that has it."""
    if how == "difference":
        return left.join(right.select("symbol"), "symbol", "left_anti")
    if how == "intersection":
        return left.join(right.select("symbol").distinct(), "symbol", "left_semi")
    if how != "union":
        raise ValueError(f"unknown set operation {how!r}")
    both = left.withColumn("_set", F.lit(0)).unionByName(right.withColumn("_set", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_set")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_set")


def funding_browser(funding: DataFrame, since_ts: int, top: int = 20) -> DataFrame:
    """Current rate of each symbol with mean, range, population deviation and z-score of the lookback; most extreme first."""
    current = funding.groupBy("symbol").agg(F.max_by("funding_rate", "ts").alias("current"))
    r = F.col("funding_rate")
    recent = funding.where(F.col("ts") >= since_ts).groupBy("symbol").agg(
        F.avg(r).alias("mean"), F.max(r).alias("max"), F.min(r).alias("min"), F.stddev_pop(r).alias("std"), F.count(r).alias("samples")
    )
    df = recent.join(current, "symbol")
    z = F.when(F.col("std") > 1e-12, (F.col("current") - F.col("mean")) / F.when(F.col("std") > 1e-12, F.col("std"))).otherwise(0.0)
    return df.withColumn("zscore", z).orderBy(F.desc(F.abs("current")), "symbol").limit(top)


def order_flow(fills: DataFrame, since_ts: int, top: int = 20) -> DataFrame:
    """Buying against selling per symbol since a time; most one-sided first."""
    buy, size = F.col("side") == "B", F.col("size")
    agg = fills.where(F.col("ts") >= since_ts).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("fills"),
        F.sum(F.when(buy, size).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "A", size).otherwise(0.0)).alias("sell_volume"),
        F.avg(F.col("crossed").cast("double")).alias("taker_ratio"),
        F.sum(F.when(F.col("is_open"), size).otherwise(-size)).alias("net_flow"),
    )
    total = F.col("buy_volume") + F.col("sell_volume")
    agg = agg.where(total >= 1e-9).withColumn("imbalance", (F.col("buy_volume") - F.col("sell_volume")) / total)
    return agg.orderBy(F.desc(F.abs("imbalance")), "symbol").limit(top)


def market_breadth(contexts: DataFrame, top: int = 20) -> DataFrame:
    """Overbought and oversold share and mean of an RSI proxy (50 + 3 × percent change, clipped) over the largest symbols."""
    valid = contexts.where("mark > 0 and previous > 0 and day_volume > 0").orderBy(F.desc("day_volume"), "symbol").limit(top)
    rsi = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 3 * (F.col("mark") - F.col("previous")) / F.col("previous") * 100))
    agg = valid.withColumn("_r", rsi).agg(
        F.count(F.lit(1)).alias("_n"), (F.avg((F.col("_r") > 70).cast("double")) * 100).alias("ob"), (F.avg((F.col("_r") < 30).cast("double")) * 100).alias("os"), F.avg("_r").alias("avg")
    )
    few = F.col("_n") < 5
    return agg.select(F.when(few, 0.0).otherwise(F.col("ob")).alias("overbought_pct"), F.when(few, 0.0).otherwise(F.col("os")).alias("oversold_pct"), F.when(few, 50.0).otherwise(F.col("avg")).alias("avg_rsi"))


def collector_stats(snapshots: DataFrame) -> DataFrame:
    """Rows, first and last time, number of symbols."""
    return snapshots.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("symbol").alias("symbols"))


def value_statistics(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",), *, quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), above: float | None = None, below: float | None = None) -> DataFrame:
    """Count, extremes, mean, deviation, exact percentiles and shares beyond thresholds (percent) of an indicator."""
    from marketspark.operators.ranks import percentiles

    v = F.col(value)
    valid = df.where(v.isNotNull())
    shares = []
    if above is not None:
        shares.append((F.avg(F.when(v > above, 100.0).otherwise(0.0))).alias("pct_above"))
    if below is not None:
        shares.append((F.avg(F.when(v < below, 100.0).otherwise(0.0))).alias("pct_below"))
    base = valid.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *shares)
    return base.join(percentiles(valid, keys, value, {f"p{round(q * 100)}": q for q in quantiles}), list(keys))
