"""Several runs together: robustness over symbols, portfolio curves, validated edge, pairs trading."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.operators.series import ordered_fold, series_window, through_now


def parameter_grid(df: DataFrame, grid: dict[str, Sequence], keep: Callable[[dict], bool] | None = None) -> DataFrame:
    """Every row once per distinct parameter combination: the grid is a literal array that is exploded, not a join."""
    combos = list(dict.fromkeys(product(*grid.values())))
    wanted = [c for c in combos if keep is None or keep(dict(zip(grid, c)))]
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(grid, c)]) for c in wanted]
    return df.withColumn("_g", F.explode(F.array(*structs))).select(*df.columns, "_g.*")


def robustness(metrics: DataFrame, default: str) -> DataFrame:
    """Per strategy: symbols, profitable ones, mean return and Sharpe, and the Sharpe gained over ``default``."""
    per = metrics.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count(F.when(F.col("total_return_pct") > 0, 1)).alias("profitable"),
        F.avg("total_return_pct").alias("avg_return"),
        F.avg("sharpe").alias("avg_sharpe"),
    )
    base = per.where(F.col("strategy") == default).select(F.col("avg_sharpe").alias("_base"))
    # one row against one row per strategy
    return per.join(F.broadcast(base), how="left").withColumn("improvement", F.col("avg_sharpe") - F.col("_base")).drop("_base")


def portfolio_curve(curves: DataFrame, capital: float, unallocated: float = 0.0, *, by: str = "strategy") -> DataFrame:
    """Sum of the strategies' equity by position in the series, as far as all of them reach, plus idle cash."""
    numbered = curves.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy("ts")) - 1)
    runs = curves.agg(F.count_distinct(by).alias("_runs"))
    total = numbered.groupBy("idx").agg(F.sum("equity").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    full = total.join(F.broadcast(runs), F.col("_n") == F.col("_runs"))  # one row
    return full.select("idx", (F.col("_sum") + unallocated).alias("equity"), (F.col("_sum") + unallocated - capital).alias("pnl"))


def portfolio_metrics(curve: DataFrame, periods: float) -> DataFrame:
    """Return, Sharpe (population deviation) and drawdown of one curve: one row per calendar step."""
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    before = F.lag("equity").over(w)
    df = curve.withColumns({"_r": F.when(before > 0, F.col("equity") / before - 1), "_pk": F.max("equity").over(through_now(w))})
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("equity", "idx").alias("_from"),
        F.max_by("equity", "idx").alias("final_equity"),
        F.avg("_r").alias("_m"),
        F.stddev_pop("_r").alias("_s"),
        F.min((F.col("equity") - F.col("_pk")) / F.col("_pk") * 100).alias("max_drawdown_pct"),
    )
    return agg.select(
        "n",
        "final_equity",
        ((F.col("final_equity") / F.col("_from") - 1) * 100).alias("total_return_pct"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * float(periods) ** 0.5).otherwise(0.0).alias("sharpe"),
        "max_drawdown_pct",
    )


def validated_edge(metrics: DataFrame, min_sharpe: float = 0.2) -> DataFrame:
    """Runs with a positive return and a Sharpe above ``min_sharpe``, best first within the strategy."""
    kept = metrics.where((F.col("total_return_pct") > 0) & (F.col("sharpe") > min_sharpe))
    w = Window.partitionBy("strategy").orderBy(F.desc("sharpe"), "symbol")
    return kept.withColumn("rank", F.row_number().over(w))


def blacklist(metrics: DataFrame) -> DataFrame:
    """Symbols that lost under every strategy."""
    per = metrics.groupBy("symbol").agg(F.max("total_return_pct").alias("best_return"), F.count(F.lit(1)).alias("strategies"))
    return per.where(F.col("best_return") < 0)


def monthly_matrix(monthly: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Month × strategy: mean monthly return over symbols. The strategies are given, so that the pivot
    needs no extra pass to find them."""
    return monthly.groupBy("month").pivot("strategy", list(strategies)).agg(F.avg("return_pct"))


def pair_bars(bars: DataFrame, first: str, second: str) -> DataFrame:
    """Two symbols' bars side by side at common times, with their price ratio."""
    a = bars.where(F.col("symbol") == first).select("ts", F.col("close").alias("close_a"))
    b = bars.where(F.col("symbol") == second).select("ts", F.col("close").alias("close_b"))
    return a.join(b, "ts").withColumn("pair", F.lit(f"{first}/{second}"))


def ratio_zscore(pairs: DataFrame, window: int = 168) -> DataFrame:
    """z-score of the price ratio against the ``window`` bars before it (population deviation)."""
    w = series_window(("pair",))
    before = w.rowsBetween(-window, -1)
    df = pairs.withColumn("ratio", F.when(F.col("close_b") > 0, F.col("close_a") / F.col("close_b")))
    sd, n = F.stddev_pop("ratio").over(before), F.count("ratio").over(before)
    return df.withColumn("z", F.when((n == window) & (sd > 0), (F.col("ratio") - F.avg("ratio").over(before)) / sd))


def pairs_position(
    scored: DataFrame, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0, max_bars: int = 72
) -> DataFrame:
    """``pos`` held after each bar (+1 long the ratio, −1 short) and ``reason`` codes of exits:
    1 target, 2 stop, 3 timeout. Enter beyond ``enter``, leave within ``leave``."""

    def step(state, row):
        (z,) = row
        pos, held = state
        if z is None:
            return (pos, held + 1 if pos else 0), (pos, 0)
        if pos:
            held += 1
            away = -pos * z
            reason = 1 if away < leave else 2 if away > stop else 3 if held >= max_bars else 0
            return ((0, 0), (0, reason)) if reason else ((pos, held), (pos, 0))
        if enter < abs(z) < stop:
            pos = -1 if z > 0 else 1
        return (pos, 0), (pos, 0)

    out = T.StructType([T.StructField("pos", T.LongType()), T.StructField("reason", T.LongType())])
    return ordered_fold(scored, lambda: (0, 0), step, ["z"], out, keys=("pair",))


def pairs_trades(positions: DataFrame, capital: float = 10_000.0, fee: float = 0.00034) -> DataFrame:
    """One row per pairs trade, half the capital on each leg, fees on four fills."""
    w = series_window(("pair",))
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    df = positions.withColumn("_was", before)
    df = df.withColumn("_run", F.sum(F.when((F.col("pos") != 0) & (F.col("_was") == 0), 1).otherwise(0)).over(through_now(w)))
    inside = df.where((F.col("pos") != 0) | (F.col("_was") != 0))
    t = inside.groupBy("pair", "_run").agg(
        F.min("ts").alias("entry_ts"),
        F.max("ts").alias("exit_ts"),
        F.min_by("pos", "ts").alias("side"),
        F.min_by("close_a", "ts").alias("a0"),
        F.min_by("close_b", "ts").alias("b0"),
        F.max_by("close_a", "ts").alias("a1"),
        F.max_by("close_b", "ts").alias("b1"),
        F.max("reason").alias("reason"),
        (F.count(F.lit(1)) - 1).alias("bars_held"),
    )
    leg = capital / 2
    gross = F.col("side") * leg * ((F.col("a1") / F.col("a0") - 1) - (F.col("b1") / F.col("b0") - 1))
    cost = fee * leg * (2 + F.col("a1") / F.col("a0") + F.col("b1") / F.col("b0"))
    return t.withColumn("pnl", gross - cost).drop("_run")
