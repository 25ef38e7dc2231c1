"""Book pressure per snapshot: imbalance, concentration in walls, spread against normal, imbalance z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.series import day_of, lookback, windowed


def imbalance_zscore(df: DataFrame, window: int = 24, value: str = "imbalance", out: str = "z") -> DataFrame:
    """z-score in the trailing frame (sample deviation), from the first full frame on; NULLs in the frame are skipped."""

    def build(d: DataFrame, w) -> DataFrame:
        frame = lookback(w, window)
        sd = F.stddev_samp(value).over(frame)
        ready = (F.count(F.lit(1)).over(frame) == window) & (F.count(value).over(frame) >= 2) & (sd > 0)
        return d.withColumn(out, F.when(ready, (F.col(value) - F.avg(value).over(frame)) / F.when(sd > 0, sd)))

    return windowed(df, build, reach=window, slice_by=day_of())


def book_pressure(features: DataFrame, typical_spread_bps: float = 5.0, window: int = 24) -> DataFrame:
    if typical_spread_bps <= 0:
        raise ValueError("the typical spread must be positive")

    def share(wall: str, depth: str):
        return F.when(F.col(depth) > 0, F.col(wall) / F.when(F.col(depth) > 0, F.col(depth)))

    df = features.withColumns(
        {"bid_wall_share": share("bid_wall", "bid_depth"), "ask_wall_share": share("ask_wall", "ask_depth"), "pressure": F.col("spread_bps") / typical_spread_bps}
    )
    return imbalance_zscore(df, window)
