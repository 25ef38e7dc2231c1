"""Trade ledgers from target positions, equity curves and their metrics.

A strategy is a ``target`` column (−1, 0, 1) on bars. A run of equal targets is a position; the
ledger has one row per run. Size is a fixed fraction of equity at entry, so a trade multiplies
equity by a factor that needs nothing but its own bars, and equity is a running product. All runs
(symbols, strategies, parameter sets) are rows of one job, kept apart by ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import HOUR_MS
from marketspark.operators.series import series_window, through_now


@dataclass(frozen=True)
class Costs:
    fee: float = 0.00034
    slippage: float = 0.0005
    leverage: float = 1.0
    fraction: float = 1.0
    stop_loss: float | None = None
    legacy_close_slippage: bool = False


def ledger(
    bars: DataFrame,
    costs: Costs = Costs(),
    *,
    keys: Sequence[str] = ("symbol",),
    initial: float = 10_000.0,
    funding: str | None = None,
    snapshot: Sequence[str] = (),
) -> DataFrame:
    """One row per trade.

    Entry at the close of the first bar of a run, exit at the close of the bar after it (or at the
    last close, reason ``end``, fee but no slippage). With ``stop_loss`` the exit is at the stop on the
    first later bar that touches it; there is no re-entry until the target changes. ``funding`` names a
    rate column: paid on close × rate at the first bar of each hour while in position. ``snapshot``
    columns are kept as a map of their values at entry.
    """
    w = series_window(keys)
    side = F.col("target").cast("double")
    before = F.coalesce(F.lag("target").over(w), F.lit(0))
    df = bars.withColumns(
        {
            "_new": F.when(F.col("target") != before, 1).otherwise(0),
            "_next_ts": F.lead("ts").over(w),
            "_next_close": F.lead("close").over(w),
            "_next_low": F.lead("low").over(w),
            "_next_high": F.lead("high").over(w),
        }
    )
    if funding:
        hour = F.floor(F.col("ts") / HOUR_MS)
        first_of_hour = F.lag(hour).over(w).isNull() | (F.lag(hour).over(w) != hour)
        df = df.withColumn("_pay", F.when(first_of_hour, F.col("close") * F.coalesce(F.col(funding), F.lit(0.0))).otherwise(0.0))
        df = df.withColumn("_pay", F.coalesce(F.lead("_pay").over(w), F.lit(0.0)))
    else:
        df = df.withColumn("_pay", F.lit(0.0))
    df = df.withColumn("_run", F.sum("_new").over(through_now(w))).where("target <> 0")
    run = Window.partitionBy(*keys, "_run").orderBy("ts")
    entry = F.first("close").over(through_now(run)) * (1 + side * costs.slippage)
    df = df.withColumn("_entry", entry)
    touched = F.lit(None).cast("long")
    if costs.stop_loss:
        stop = F.col("_entry") * (1 - side * costs.stop_loss)
        touched = F.when(F.when(side > 0, F.col("_next_low") <= stop).otherwise(F.col("_next_high") >= stop), F.col("_next_ts"))
    df = df.withColumn("_touched", touched)
    snap = F.map_from_arrays(F.array(*[F.lit(c) for c in snapshot]), F.array(*[F.col(c).cast("double") for c in snapshot])) if snapshot else F.lit(None).cast("map<string,double>")
    df = df.withColumn("_snap", snap)
    runs = df.groupBy(*keys, "_run").agg(
        F.min("ts").alias("entry_ts"),
        F.first("target").alias("side"),
        F.first("_entry").alias("entry_price"),
        F.max_by("_next_ts", "ts").alias("_exit_ts"),
        F.max_by("_next_close", "ts").alias("_exit_close"),
        F.max("ts").alias("_last_ts"),
        F.max_by("close", "ts").alias("_last_close"),
        F.min("_touched").alias("_stop_ts"),
        F.sum("_pay").alias("_paid"),
        F.count(F.lit(1)).alias("bars_held"),
        F.min_by("_snap", "ts").alias("indicators_at_entry"),
    )
    s = F.col("side").cast("double")
    stopped, open_end = F.col("_stop_ts").isNotNull(), F.col("_exit_ts").isNull()
    close_side = F.lit(1.0) if costs.legacy_close_slippage else -s
    runs = runs.withColumns(
        {
            "exit_reason": F.when(stopped, "stop_loss").when(open_end, "end").otherwise("signal"),
            "exit_ts": F.when(stopped, F.col("_stop_ts")).when(open_end, F.col("_last_ts")).otherwise(F.col("_exit_ts")),
            "exit_price": F.when(stopped, F.col("entry_price") * (1 - s * (costs.stop_loss or 0.0)))
            .when(open_end, F.col("_last_close"))
            .otherwise(F.col("_exit_close") * (1 + close_side * costs.slippage)),
        }
    )
    if funding and costs.stop_loss:
        # a stop ends the payments early; they are summed again up to the stop only for stopped trades
        pays = df.select(*keys, "_run", F.col("_next_ts").alias("_pay_ts"), "_pay")
        cut = pays.join(runs.where(stopped).select(*keys, "_run", "_stop_ts"), [*keys, "_run"]).where("_pay_ts <= _stop_ts")
        cut = cut.groupBy(*keys, "_run").agg(F.sum("_pay").alias("_cut"))
        runs = runs.join(cut, [*keys, "_run"], "left").withColumn("_paid", F.when(stopped, F.coalesce("_cut", F.lit(0.0))).otherwise(F.col("_paid"))).drop("_cut")
    return _money(runs, costs, keys, initial)


def _money(runs: DataFrame, costs: Costs, keys: Sequence[str], initial: float) -> DataFrame:
    f, lev, fee = costs.fraction, costs.leverage, costs.fee
    s, move = F.col("side").cast("double"), F.col("exit_price") / F.col("entry_price")
    gross = f * lev * (s * (move - 1) - move * fee)
    paid = s * f * lev * F.col("_paid") / F.col("entry_price")
    factor = F.greatest(F.lit(0.0), 1 - f * lev * fee + gross - paid)
    runs = runs.withColumns({"multiplier": factor, "_gross": gross, "_fund": paid})
    w = Window.partitionBy(*keys).orderBy("entry_ts")
    runs = runs.withColumn("equity", initial * running_product(F.col("multiplier"), w))
    start = F.coalesce(F.lag("equity").over(w), F.lit(initial))
    runs = runs.withColumn("_start", start)
    after_fee = F.col("_start") * (1 - f * lev * fee) - F.col("_start") * F.col("_fund")
    return runs.select(
        *keys,
        "entry_ts",
        "exit_ts",
        "side",
        "entry_price",
        "exit_price",
        (F.col("_start") * f / F.col("entry_price")).alias("size"),
        (F.col("_start") * F.col("_gross")).alias("pnl"),
        F.when(after_fee > 0, F.col("_start") * F.col("_gross") / after_fee * 100).alias("pnl_pct"),
        (F.col("_start") * f * lev * fee).alias("entry_fee"),
        (-F.col("_start") * F.col("_fund")).alias("funding"),
        "exit_reason",
        "bars_held",
        "multiplier",
        "equity",
        "indicators_at_entry",
    )


def running_product(factor: Column, w) -> Column:
    """Product of non-negative factors so far; 0 from the first 0 on."""
    upto = through_now(w)
    ruined = F.min(factor).over(upto) <= 0
    return F.when(ruined, 0.0).otherwise(F.exp(F.sum(F.log(F.when(factor > 0, factor))).over(upto)))


def equity_on_bars(bars: DataFrame, trades: DataFrame, *, keys: Sequence[str] = ("symbol",), initial: float = 10_000.0, parts: int | None = None) -> DataFrame:
    """Realised equity at each bar: the product of the trades closed so far, and the bar's return.

    Bars and closes go through one exchange by ``keys`` (of ``parts`` partitions, if given) and one sort, instead of a join.
    """
    none = F.lit(None).cast("double")
    factor = F.col("multiplier")
    closes = trades.select(*keys, F.col("exit_ts").alias("ts"), none.alias("close"), F.log(F.when(factor > 0, factor)).alias("_lm"), factor.alias("_least"), F.lit(False).alias("_bar"))
    df = bars.select(*keys, "ts", "close", none.alias("_lm"), none.alias("_least"), F.lit(True).alias("_bar")).unionByName(closes)
    if parts:
        df = df.repartition(parts, *keys)
    w = series_window(keys)
    # frames by time: what closes at a bar's time is in its equity, whichever row comes first
    upto, here = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.currentRow)
    ruined = F.coalesce(F.min("_least").over(upto), F.lit(1.0)) <= 0
    df = df.withColumns({"equity": F.when(ruined, 0.0).otherwise(initial * F.exp(F.coalesce(F.sum("_lm").over(upto), F.lit(0.0)))), "_closed": F.count("_least").over(here)})
    df = df.where("_bar")
    before = F.coalesce(F.lag("equity").over(w), F.lit(initial))
    # exactly 0 where nothing closed, whatever the rounding of the running product
    ret = F.when(F.col("_closed") == 0, 0.0).when(before > 0, F.col("equity") / before - 1)
    return df.withColumn("ret", ret).drop("_lm", "_least", "_bar", "_closed")


def equity_metrics(curve: DataFrame, periods: float, *, keys: Sequence[str] = ("symbol",), initial: float = 10_000.0) -> DataFrame:
    """Total return, drawdown, Sharpe and Sortino (population deviations), Calmar on simple annual
    return, recovery factor; percent where the name says so."""
    w = series_window(keys)
    peak = F.greatest(F.max("equity").over(through_now(w)), F.lit(initial))
    df = curve.withColumn("_dd", (F.col("equity") - peak) / peak * 100)
    down = F.when(F.col("ret") < 0, F.col("ret"))
    out = df.groupBy(*keys).agg(
        F.count("ret").alias("n"),
        F.max_by("equity", "ts").alias("final_equity"),
        F.min("_dd").alias("max_drawdown_pct"),
        F.avg("ret").alias("_m"),
        F.stddev_pop("ret").alias("_s"),
        F.stddev_pop(down).alias("_ds"),
        F.count(down).alias("_nd"),
        ((F.max("ts") - F.min("ts")) / (365.25 * 24 * HOUR_MS)).alias("_years"),
    )
    root = float(periods) ** 0.5
    out = out.withColumn("total_return_pct", (F.col("final_equity") / initial - 1) * 100)
    dd = F.col("max_drawdown_pct")
    out = out.withColumns(
        {
            "sharpe": F.when((F.col("n") > 1) & (F.col("_s") > 0), F.col("_m") / F.col("_s") * root).otherwise(0.0),
            "sortino": F.when((F.col("_nd") > 1) & (F.col("_ds") > 0), F.col("_m") / F.col("_ds") * root).otherwise(0.0),
            "calmar": F.when((F.col("_years") > 0) & (dd != 0), F.col("total_return_pct") / F.col("_years") / F.abs(dd)).otherwise(0.0),
            "recovery_factor": F.when(dd != 0, F.abs(F.col("total_return_pct") / dd)).otherwise(0.0),
        }
    )
    return out.drop("_m", "_s", "_ds", "_nd", "_years")


def trade_summary(trades: DataFrame, keys: Sequence[str] = ("symbol",), bar_ms: int = HOUR_MS) -> DataFrame:
    """Counts, win rates, averages, profit factor, expectancy, payoff, durations, best and worst."""
    won, pnl, pct = F.col("pnl") > 0, F.col("pnl"), F.col("pnl_pct")

    def rate(cond: Column) -> Column:
        return F.coalesce(F.avg(F.when(cond, F.when(won, 100.0).otherwise(0.0))), F.lit(0.0))

    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count(F.when(won, 1)).alias("wins"),
        rate(F.lit(True)).alias("win_rate"),
        F.coalesce(F.avg(F.when(won, pct)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~won, pct)), F.lit(0.0)).alias("avg_loss_pct"),
        F.coalesce(F.sum(F.when(won, pnl)), F.lit(0.0)).alias("_gain"),
        F.coalesce(F.abs(F.sum(F.when(~won, pnl))), F.lit(1.0)).alias("_loss"),
        F.avg(pnl).alias("expectancy"),
        rate(F.col("side") > 0).alias("long_win_rate"),
        rate(F.col("side") < 0).alias("short_win_rate"),
        F.avg((F.col("exit_ts") - F.col("entry_ts")) / bar_ms).alias("avg_duration"),
        F.max(pct).alias("best_pct"),
        F.min(pct).alias("worst_pct"),
    )
    return out.withColumns(
        {
            "profit_factor": F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).otherwise(0.0),
            "payoff": F.when(F.col("avg_loss_pct") != 0, F.abs(F.col("avg_win_pct") / F.col("avg_loss_pct"))).otherwise(0.0),
        }
    ).drop("_gain", "_loss")


def streaks(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longest run of winning and of losing trades."""
    w = Window.partitionBy(*keys).orderBy("entry_ts")
    won = (F.col("pnl") > 0).cast("int")
    df = trades.withColumns({"_won": won, "_rn": F.row_number().over(w)})
    same = F.row_number().over(Window.partitionBy(*keys, "_won").orderBy("entry_ts"))
    runs = df.withColumn("_isle", F.col("_rn") - same).groupBy(*keys, "_won", "_isle").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_won") == 1, F.col("_len"))), F.lit(0)).alias("max_wins"),
        F.coalesce(F.max(F.when(F.col("_won") == 0, F.col("_len"))), F.lit(0)).alias("max_losses"),
    )


def monthly_returns(curve: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equity at the start of a month against that of the next; the last month against the final equity."""
    month = F.date_format(F.timestamp_millis("ts"), "yyyy-MM")
    months = curve.groupBy(*keys, month.alias("month")).agg(F.min_by("equity", "ts").alias("_from"), F.max_by("equity", "ts").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("month")
    to = F.coalesce(F.lead("_from").over(w), F.col("_last"))
    return months.withColumn("return_pct", F.when(F.col("_from") > 0, (to - F.col("_from")) / F.col("_from") * 100)).drop("_from", "_last")


def without_best(trades: DataFrame, keys: Sequence[str] = ("symbol",), best: int = 5, initial: float = 10_000.0, bars_per_key: str | None = None) -> DataFrame:
    """Return and Sharpe without the ``best`` trades; dependent when they made over half of a gain."""
    w = Window.partitionBy(*keys).orderBy(F.desc("pnl"), "entry_ts")
    df = trades.withColumn("_rk", F.row_number().over(w))
    rest = F.col("_rk") > best
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("pnl").alias("total_pnl"),
        F.sum(F.when(~rest, F.col("pnl"))).alias("best_pnl"),
        F.avg(F.when(rest, F.col("pnl_pct") / 100)).alias("_m"),
        F.stddev_samp(F.when(rest, F.col("pnl_pct") / 100)).alias("_s"),
        *([F.max(bars_per_key).alias("_bars")] if bars_per_key else []),
    )
    per_trade = F.greatest(F.lit(1.0), F.col("_bars") / F.greatest(F.lit(1), F.col("trades"))) if bars_per_key else F.lit(1.0)
    return out.where(F.col("trades") > best).select(
        *keys,
        "trades",
        ((F.col("total_pnl") - F.col("best_pnl")) / initial * 100).alias("return_without_pct"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(8760 / per_trade)).otherwise(0.0).alias("sharpe_without"),
        ((F.col("total_pnl") > 0) & (F.col("best_pnl") > 0.5 * F.col("total_pnl"))).alias("dependent"),
    )


def by_regime(trades: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("symbol",), longest: int = 720, threshold: float = 0.05, parts: int | None = None) -> DataFrame:
    """Trades per market regime at entry: the trailing return over ``longest`` bars, or a quarter of the
    series if that is shorter, above, below or within ±``threshold``. A trade takes the first bar at or after its entry.

    Bars and trades go through one exchange by ``keys`` (of ``parts`` partitions, if given).
    """
    none, w = F.lit(None).cast("double"), series_window(keys)
    entered = trades.select(*keys, F.col("entry_ts").alias("ts"), none.alias("close"), F.col("pnl").cast("double").alias("pnl"), F.col("pnl_pct").cast("double").alias("pnl_pct"), F.lit(0).alias("_bar"))
    both = bars.select(*keys, "ts", "close", none.alias("pnl"), none.alias("pnl_pct"), F.lit(1).alias("_bar")).unionByName(entered)
    both = both.repartition(parts, *keys) if parts else both
    everyone = Window.partitionBy(*keys)
    # a bar's number counts bars; a trade's is that of the first bar at or after it
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    df = both.withColumns({"_i": F.coalesce(F.sum("_bar").over(before), F.lit(0)) + 1, "_n": F.sum("_bar").over(everyone)})
    df = df.withColumn("_k", F.least(F.lit(longest), F.floor(F.col("_n") / 4))).where((F.col("_k") >= 10) & (F.col("_n") >= 100) & (F.col("_i") <= F.col("_n")))
    # every bar stands a second time where it is the past one, so that both prices meet at one number
    is_bar = F.col("_bar") == 1
    at = F.explode(F.when(is_bar, F.array(F.col("_i"), F.col("_i") + F.col("_k"))).otherwise(F.array(F.col("_i"))))
    df = df.select(*keys, "pnl", "pnl_pct", "_bar", "_i", "close", at.alias("_at"))
    here = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.currentRow, Window.currentRow)
    now = F.max(F.when(is_bar & (F.col("_i") == F.col("_at")), F.col("close"))).over(here)
    past = F.max(F.when(is_bar & (F.col("_i") < F.col("_at")), F.col("close"))).over(here)
    df = df.withColumns({"_now": now, "_past": past}).where("_bar = 0")
    move = F.when(F.col("_past") > 0, (F.col("_now") - F.col("_past")) / F.col("_past")).when(F.col("_past").isNotNull(), 0.0)
    placed = df.withColumn("regime", F.when(move > threshold, "bull").when(move < -threshold, "bear").when(move.isNotNull(), "sideways"))
    return placed.where("regime is not null").groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(F.when(F.col("pnl") > 0, 100.0).otherwise(0.0)).alias("win_rate"),
        F.avg("pnl_pct").alias("avg_pnl_pct"),
        F.sum("pnl_pct").alias("total_pnl_pct"),
    )


def drawdowns(curve: DataFrame, keys: Sequence[str] = ("symbol",), deep: float = 0.05, slack: float = 0.001) -> DataFrame:
    """Worst drawdown with its peak and trough positions, time under water, number of distinct deep
    drawdowns, and the lengths of spells below the peak by more than ``slack``."""
    w = series_window(keys)
    df = curve.withColumns({"_i": F.row_number().over(w) - 1, "_peak": F.max("equity").over(through_now(w))})
    df = df.withColumn("_dd", (F.col("equity") - F.col("_peak")) / F.col("_peak"))
    wet = F.col("_dd") < 0
    df = df.withColumns(
        {
            "_spell": F.sum(F.when(wet, 0).otherwise(1)).over(through_now(w)),
            "_low": (F.col("equity") < F.col("_peak") * (1 - slack)).cast("int"),
            "_at_peak": F.first("_i").over(Window.partitionBy(*keys, "_peak").orderBy("ts")),
        }
    )
    df = df.withColumn("_lowspell", F.sum(1 - F.col("_low")).over(through_now(w)))
    worst = F.min_by(F.struct("_i", "_at_peak"), F.struct("_dd", "_i"))
    base = df.groupBy(*keys).agg(F.min("_dd").alias("max_dd"), worst.alias("_w"), F.avg(wet.cast("double")).alias("time_in_drawdown"))
    spells = df.where(wet).groupBy(*keys, "_spell").agg(F.min("_dd").alias("_d")).groupBy(*keys).agg(F.count(F.when(F.col("_d") < -deep, 1)).alias("n_deep"))
    low = df.where("_low = 1").groupBy(*keys, "_lowspell").agg(F.count(F.lit(1)).alias("_len"))
    low = low.groupBy(*keys).agg(F.max("_len").alias("max_dd_bars"), F.avg("_len").alias("avg_recovery"))
    out = base.join(spells, list(keys), "left").join(low, list(keys), "left")
    zero = F.lit(0)
    return out.select(
        *keys,
        "max_dd",
        F.col("_w._at_peak").alias("peak_idx"),
        F.col("_w._i").alias("trough_idx"),
        (F.col("_w._i") - F.col("_w._at_peak")).alias("dd_bars"),
        "time_in_drawdown",
        F.coalesce("n_deep", zero).alias("n_deep"),
        F.coalesce("max_dd_bars", zero).alias("max_dd_bars"),
        F.coalesce("avg_recovery", F.lit(0.0)).alias("avg_recovery"),
    )


def compare(metrics: DataFrame, by: str, n: int, within: Sequence[str] = ()) -> DataFrame:
    """Best ``n`` runs by a metric, overall (a distributed top-n) or within groups."""
    if not within:
        return metrics.orderBy(F.desc(by), *[c for c in ("strategy", "symbol") if c in metrics.columns]).limit(n)
    ties = [c for c in ("strategy", "symbol") if c in metrics.columns and c not in within]
    w = Window.partitionBy(*within).orderBy(F.desc(by), *ties)
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
