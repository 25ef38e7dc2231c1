"""What past trades say about the signals behind them: hit rates, timing, sizing.

Outcome rows carry ``symbol, direction, signals (sorted array), pnl_pct, hold_minutes, time_to_peak_minutes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.ranks import value_at_rank


def _won() -> Column:
    return F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0)


def _n() -> Column:
    return F.count(F.lit(1))



def signal_stats(outcomes: DataFrame, least: int = 3) -> DataFrame:
    """Wins, trades and hit rate of each signal and direction with at least ``least`` trades."""
    per = outcomes.select("direction", "pnl_pct", F.explode("signals").alias("signal")).groupBy("signal", "direction")
    return per.agg(F.count(F.when(F.col("pnl_pct") > 0, 1)).alias("wins"), _n().alias("total"), F.avg(_won()).alias("hit_rate")).where(F.col("total") >= least)


def _rate(outcomes: DataFrame, keys: Sequence[str], least: int, out: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(F.avg(_won()).alias(out), _n().alias("_n")).where(F.col("_n") >= least).drop("_n")


def hit_rates(asked: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """Historical hit rate for each asked (symbol, direction, signals): that of the exact combination, else
    the mean over its single signals, else that of the symbol and direction, else NULL."""
    combo = _rate(outcomes, ["symbol", "direction", "signals"], least, "_c")
    single = _rate(outcomes.withColumn("signal", F.explode("signals")), ["signal", "direction"], least, "_s")
    side = _rate(outcomes, ["symbol", "direction"], least, "_d")
    key = ["symbol", "direction", "signals"]
    by_signal = asked.withColumn("signal", F.explode("signals")).join(single, ["signal", "direction"]).groupBy(*key).agg(F.avg("_s").alias("_i"))
    joined = asked.join(combo, key, "left").join(by_signal, key, "left").join(side, ["symbol", "direction"], "left")
    return joined.withColumn("hit_rate", F.coalesce("_c", "_i", "_d")).drop("_c", "_i", "_d")


def signal_decay(outcomes: DataFrame, least: int = 5) -> DataFrame:
    """Mean, median and 90th percentile of the time to peak of each signal (order statistics, not
    interpolated), and its mean hold."""
    rows = outcomes.select(F.explode("signals").alias("signal"), F.col("time_to_peak_minutes").alias("p"), F.col("hold_minutes").alias("h"))
    base = rows.groupBy("signal").agg(
        F.count(F.when(F.col("p") > 0, 1)).alias("observations"),
        F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("avg_time_to_peak"),
        F.coalesce(F.avg(F.when(F.col("h") > 0, F.col("h"))), F.lit(0.0)).alias("avg_hold"),
    )
    n = F.col("n")
    picks = value_at_rank(rows.where("p > 0"), ["signal"], "p", {"median": F.floor(n / 2) + 1, "p90": F.least(n - 1, F.floor(n * 0.9)) + 1})
    return base.where(F.col("observations") >= least).join(picks, "signal")


def kelly_fraction(win_rate: Column, avg_win: Column, avg_loss: Column, fraction: float = 0.5, floor: float = 0.005, cap: float = 0.05) -> Column:
    """Fractional Kelly risk from win rate and payoff, clipped."""
    payoff = avg_win / avg_loss
    kelly = (win_rate * payoff - (1 - win_rate)) / payoff
    usable = (avg_win > 0) & (avg_loss > 0)
    return F.when(usable, F.greatest(F.lit(floor), F.least(F.lit(cap), kelly * fraction)))


def kelly_sizing(outcomes: DataFrame, signals: Sequence[str], fraction: float = 0.5, least: int = 10) -> DataFrame:
    """Kelly risk per direction from the outcomes that share any of ``signals``."""
    match = outcomes.where(F.arrays_overlap("signals", F.array(*[F.lit(s) for s in signals])))
    size = F.abs("pnl_pct")
    stats = match.groupBy("direction").agg(
        _n().alias("observations"),
        F.avg(_won()).alias("win_rate"),
        F.avg(F.when(F.col("pnl_pct") > 0, size)).alias("avg_win"),
        F.avg(F.when(F.col("pnl_pct") <= 0, size)).alias("avg_loss"),
    )
    out = stats.where(F.col("observations") >= least).withColumn("risk_pct", kelly_fraction(F.col("win_rate"), F.col("avg_win"), F.col("avg_loss"), fraction))
    return out.where("risk_pct is not null")


def recent_kelly(trades: DataFrame, keys: Sequence[str], recent: int = 50, least: int = 20, fallback: float = 0.02, cap: float = 0.05) -> DataFrame:
    """Half-Kelly risk before each trade from the ``recent`` trades before it; ``fallback`` with fewer than ``least``."""
    w = Window.partitionBy(*keys).orderBy("entry_ts").rowsBetween(-recent, -1)
    n = F.count(F.lit(1)).over(w)
    win = F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).over(w)
    avg_win = F.avg(F.when(F.col("pnl") > 0, F.abs("pnl_pct"))).over(w)
    avg_loss = F.avg(F.when(F.col("pnl") <= 0, F.abs("pnl_pct"))).over(w)
    risk = kelly_fraction(win, avg_win, avg_loss, 0.5, 0.005, cap)
    return trades.withColumn("kelly_risk", F.when(n < least, fallback).otherwise(F.coalesce(risk, F.lit(fallback))))
