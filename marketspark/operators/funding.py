"""Funding series: rolling z-score, next rate, accrual and browser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEEK_HOURS = 168


def funding_features(funding: DataFrame, window: int = WEEK_HOURS, lookahead: bool = False) -> DataFrame:
    """z-score of each rate against the ``window`` rates before it. ``lookahead`` adds the *next* rate as
    ``predicted_funding``: it looks into the future, so it is off by default."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = w.rowsBetween(-window, -1)
    mean, sd, n = F.avg("funding_rate").over(before), F.stddev_pop("funding_rate").over(before), F.count("funding_rate").over(before)
    out = funding.withColumn("funding_zscore", F.when((n == window) & (sd > 0), (F.col("funding_rate") - mean) / sd))
    return out.withColumn("predicted_funding", F.lead("funding_rate").over(w)) if lookahead else out
