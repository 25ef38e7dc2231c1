"""Portfolio risk: exposure and gates, position limits, sizing, drawdown scaling, stops, grades."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.asof import lookback_matches
from marketspark.operators.series import lookback, series_window

# Fixed values: (drawdown, share of the base size kept).
DRAWDOWN_SCHEDULE = [(0.0, 1.0), (0.05, 0.75), (0.10, 0.50), (0.15, 0.25), (0.20, 0.0)]


def drawdown_scaler(drawdown: Column, schedule: Sequence[tuple[float, float]] = DRAWDOWN_SCHEDULE, interpolate: bool = True) -> Column:
    """Size factor at a drawdown (positive fraction): piecewise linear, or the lower step."""
    first, last = schedule[0], schedule[-1]
    chain = F.when(drawdown <= first[0], first[1]).when(drawdown >= last[0], last[1])
    for (d0, s0), (d1, s1) in zip(schedule, schedule[1:]):
        value = F.lit(s0) + (drawdown - d0) / (d1 - d0) * (s1 - s0) if interpolate else F.lit(s0)
        chain = chain.when(drawdown <= d1, value)
    return chain


# Exposure limits in percent of equity.
LIMITS = {"net": 150.0, "gross": 300.0, "long": 200.0, "short": 200.0, "asset": 50.0}


def exposure(positions: DataFrame, equity: float) -> DataFrame:
    """Net, gross, long and short exposure in percent; one row. ``positions``: strategy, symbol, side, notional."""
    long = F.sum(F.when(F.col("side") == "long", F.col("notional")).otherwise(0.0))
    short = F.sum(F.when(F.col("side") == "short", F.col("notional")).otherwise(0.0))
    e = max(equity, 1.0)
    return positions.agg(long.alias("long_usd"), short.alias("short_usd")).select(
        "long_usd",
        "short_usd",
        ((F.col("long_usd") - F.col("short_usd")) / e * 100).alias("net_pct"),
        ((F.col("long_usd") + F.col("short_usd")) / e * 100).alias("gross_pct"),
        (F.col("long_usd") / e * 100).alias("long_pct"),
        (F.col("short_usd") / e * 100).alias("short_pct"),
    )


def exposure_by(positions: DataFrame, key: str) -> DataFrame:
    """Signed notional per asset or per strategy."""
    signed = F.when(F.col("side") == "long", F.col("notional")).otherwise(-F.col("notional"))
    return positions.groupBy(key).agg(F.sum(signed).alias("signed_usd"))


def gate(requests: DataFrame, positions: DataFrame, equity: float, limits: dict[str, float] = LIMITS) -> DataFrame:
    """For each request (symbol, side, requested): the headroom under every limit, whether it is
    allowed, and what is permitted."""
    e = max(equity, 1.0)
    total = exposure(positions, equity).select("long_usd", "short_usd")
    asset = exposure_by(positions, "symbol").withColumnRenamed("signed_usd", "_asset")
    df = requests.join(F.broadcast(total)).join(asset, "symbol", "left")  # total is one row
    is_long = F.col("side") == "long"
    net = F.col("long_usd") - F.col("short_usd")
    rooms = [
        e * limits["net"] / 100 - F.when(is_long, net).otherwise(-net),
        e * limits["gross"] / 100 - (F.col("long_usd") + F.col("short_usd")),
        F.when(is_long, e * limits["long"] / 100 - F.col("long_usd")).otherwise(e * limits["short"] / 100 - F.col("short_usd")),
        e * limits["asset"] / 100 - F.abs(F.coalesce("_asset", F.lit(0.0))),
    ]
    df = df.withColumn("headroom", F.greatest(F.lit(0.0), F.least(*rooms)))
    allowed = (F.col("requested") > 0) & (F.col("headroom") > 0)
    permitted = F.when(allowed, F.least("requested", "headroom")).otherwise(0.0)
    df = df.withColumns({"allowed": allowed, "permitted": permitted})
    return df.withColumn("scale", F.when(F.col("requested") > 0, F.col("permitted") / F.col("requested")).otherwise(0.0)).drop("long_usd", "short_usd", "_asset")


def sector_guard(trades: DataFrame, max_age: str = "4h") -> DataFrame:
    """Per trade (sector, direction, symbol, ts): recent trades of other symbols in the same sector and
    direction; two or more block it, one halves it. No sector, no guard."""
    df = lookback_matches(trades, group=["sector", "direction"], entity="symbol", ts="ts", max_age=max_age)
    matches = F.when(F.col("sector").isNull(), 0).otherwise(F.col("matches"))
    df = df.withColumn("matches", matches)
    return df.withColumns({"blocked": F.col("matches") >= 2, "size_factor": F.when(F.col("matches") >= 2, 0.0).when(F.col("matches") == 1, 0.5).otherwise(1.0)})


def apply_limits(
    weights: DataFrame,
    *,
    keys: Sequence[str] = ("portfolio",),
    max_single: float | None = None,
    max_sector: float | None = None,
    max_gross: float | None = None,
    max_net: float | None = None,
) -> DataFrame:
    """Project weights (portfolio, symbol, sector, w) on the limits, in order: single positions are cut,
    sectors and the gross are scaled, the net is shifted by the same amount for all. ``triggered`` lists what fired.

    Every step reads totals of the step before, so each is one aggregate joined back on its group."""
    df = weights.withColumn("triggered", F.array().cast("array<string>"))

    def fire(df: DataFrame, hit: Column, label: Column | str) -> Column:
        text = F.lit(label) if isinstance(label, str) else label
        return F.when(hit, F.concat("triggered", F.array(text))).otherwise(F.col("triggered"))

    if max_single is not None:
        over = F.abs("w") > max_single
        df = df.withColumns({"triggered": fire(df, over, "single"), "w": F.when(over, F.signum("w") * max_single).otherwise(F.col("w"))})
    if max_sector is not None:
        df = _with_total(df, [*keys, "sector"], F.sum(F.abs("w")), "_t")
        over = F.col("sector").isNotNull() & (F.col("_t") > max_sector)
        df = df.withColumns({"triggered": fire(df, over, "sector"), "w": F.when(over, F.col("w") * max_sector / F.col("_t")).otherwise(F.col("w"))}).drop("_t")
    if max_gross is not None:
        df = _with_total(df, keys, F.sum(F.abs("w")), "_t")
        over = F.col("_t") > max_gross
        df = df.withColumns({"triggered": fire(df, over, "gross"), "w": F.when(over, F.col("w") * max_gross / F.col("_t")).otherwise(F.col("w"))}).drop("_t")
    if max_net is not None:
        df = _with_total(df, keys, F.struct(F.sum("w").alias("net"), F.count(F.lit(1)).alias("n")), "_t")
        over = F.abs(F.col("_t.net")) > max_net
        shift = (F.col("_t.net") - max_net * F.signum("_t.net")) / F.col("_t.n")
        df = df.withColumns({"triggered": fire(df, over, "net"), "w": F.when(over, F.col("w") - shift).otherwise(F.col("w"))}).drop("_t")
    return df


def _with_total(df: DataFrame, keys: Sequence[str], total: Column, out: str) -> DataFrame:
    """The total of each group on its rows, through an aggregate and a join (null-safe on the keys)."""
    totals = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(total.alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(totals, cond).drop(*[f"_k_{k}" for k in keys])


def vol_target_scaler(returns: DataFrame, target: float, periods: float, *, window: int = 60, cap: float = 5.0, keys: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    """``scaler`` that brings the realised volatility of the last ``window`` returns to ``target``, at most ``cap``."""
    w = lookback(series_window(keys), window)
    realised = F.coalesce(F.stddev_samp(ret).over(w), F.lit(0.0)) * math.sqrt(periods)
    df = returns.withColumn("realised_vol", realised)
    vol = F.col("realised_vol")
    return df.withColumn("scaler", F.when(vol < 1e-6, cap).otherwise(F.least(F.lit(cap), target / F.when(vol >= 1e-6, vol))))


def kelly_single(mean: Column, variance: Column, fraction: float = 0.5, cap: float = 1.0) -> Column:
    """Fractional Kelly μ/σ², clipped to ±cap; 0 without variance."""
    return F.coalesce(F.when(variance > 0, F.greatest(F.lit(-cap), F.least(F.lit(cap), fraction * mean / variance))), F.lit(0.0))


def size_position(
    df: DataFrame, capital: float, method: str, *, max_single: float = 1.0, max_base: float = 1.0, kelly_fraction: float = 0.5, fixed: float = 0.01
) -> DataFrame:
    """``position_usd`` of rows with ``side`` (±1, 0), ``drawdown``, and what the method reads: ``scaler``
    (vol_target) or ``mean`` and ``variance`` (kelly). Kelly does not trade against its own forecast."""
    side = F.col("side")
    if method == "vol_target":
        base = side * F.col("scaler")
    elif method == "kelly":
        k = kelly_single(F.col("mean"), F.col("variance"), kelly_fraction, max_base)
        base = F.when(F.signum(k) == -F.signum(side), 0.0).otherwise(F.abs(k) * side)
    elif method == "fixed_fraction":
        base = side * abs(fixed)
    else:
        raise ValueError(f"unknown sizing method {method!r}")
    base = F.greatest(F.lit(-max_base), F.least(F.lit(max_base), base))
    limited = F.greatest(F.lit(-max_single), F.least(F.lit(max_single), F.col("base_fraction")))
    df = df.withColumns({"base_fraction": base.cast("double"), "dd_scaler": drawdown_scaler(F.col("drawdown"))})
    df = df.withColumn("position_fraction", limited * F.col("dd_scaler"))
    return df.withColumn("position_usd", F.col("position_fraction") * capital)


# Exit policies. Distances are multiples of the ATR, times are seconds.
EXIT = {
    "momentum": {"breakeven": 1.0, "trail": 1.5, "max_hold": 4 * 3600},
    "funding": {"widen_after": 2 * 3600, "widen": 1.5, "max_hold": 8 * 3600},
    "mean_reversion": {"tighten_after": 0.5, "tighten": 0.5, "max_hold": 30 * 60},
}


def exit_update(positions: DataFrame) -> DataFrame:
    """Next stop of every open position by its policy: ``new_stop`` (NULL: unchanged), ``breakeven`` and
    ``expired``. Reads policy, side, entry_price, price, stop, peak, atr, elapsed_s, funding, breakeven."""
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    entry, atr, stop = F.col("entry_price"), F.col("atr"), F.col("stop")
    m, f, r = EXIT["momentum"], EXIT["funding"], EXIT["mean_reversion"]
    policy, armed = F.col("policy"), F.col("breakeven")
    gain = sign * (F.col("price") - entry)
    arm = (policy == "momentum") & ~armed & (gain > 0) & (gain >= atr * m["breakeven"]) & (entry > 0)
    trail, widened, tight = F.col("peak") - sign * atr * m["trail"], entry - sign * atr * f["widen"], entry - sign * atr * r["tighten"]
    late = (policy == "mean_reversion") & ~armed & (F.col("elapsed_s") > r["max_hold"] * r["tighten_after"])
    move = (
        F.when(arm, entry)
        .when((policy == "momentum") & armed & (sign * (trail - stop) > 0), trail)
        .when((policy == "funding") & (F.col("elapsed_s") > f["widen_after"]) & (F.abs("funding") > 0) & (sign * (widened - stop) < 0), widened)
        .when(late & (sign * (tight - stop) > 0), tight)
    )
    hold = F.when(policy == "funding", f["max_hold"]).when(policy == "mean_reversion", r["max_hold"]).otherwise(m["max_hold"])
    return positions.withColumns({"new_stop": move, "breakeven": armed | arm | late, "expired": F.col("elapsed_s") >= hold})


def research_grade(df: DataFrame) -> DataFrame:
    """A–F from Sharpe, return, drawdown, walk-forward degradation and Monte Carlo shares (percent)."""
    ret, dd, deg = F.col("return_pct"), F.col("max_drawdown_pct"), F.col("degradation")
    profit, ruin = F.col("prob_profit"), F.col("prob_ruin")
    grade = (
        F.when((deg >= 0.7) & (profit >= 90) & (dd > -15) & (ret > 10) & (ruin == 0) & (F.col("sharpe") > 1), "A")
        .when((deg >= 0.4) & (profit >= 75) & (dd > -25) & (ret > 0) & (ruin <= 5), "B")
        .when((ret > 0) & (profit >= 50) & (ruin <= 20), "C")
        .when((ret > -10) & (F.col("trades") > 0), "D")
        .otherwise("F")
    )
    return df.withColumn("grade", grade)


# Least acceptable values of the promotion gates.
GATES = {"deflated_sharpe": 0.95, "cv_pass_rate": 0.7, "capacity": 10_000.0, "observations": 252, "trades": 100, "max_drawdown": 0.20}


def promotion_gates(df: DataFrame, keys: Sequence[str], limits: dict[str, float] = GATES) -> DataFrame:
    """One row per gate: (gate, metric, threshold, passed), from columns dsr, cv_pass_rate, capacity_usd,
    n_obs, n_trades, max_drawdown. A missing metric fails."""
    obs_ok, trades_ok = F.col("n_obs") >= limits["observations"], F.col("n_trades") >= limits["trades"]
    short_trades = obs_ok & ~trades_ok
    rows = [
        ("deflated_sharpe", F.col("dsr"), F.lit(limits["deflated_sharpe"])),
        ("cv_pass_rate", F.col("cv_pass_rate"), F.lit(limits["cv_pass_rate"])),
        ("capacity", F.col("capacity_usd"), F.lit(limits["capacity"])),
        (
            "track_record",
            F.when(short_trades, F.col("n_trades")).otherwise(F.col("n_obs")).cast("double"),
            F.when(short_trades, F.lit(float(limits["trades"]))).otherwise(F.lit(float(limits["observations"]))),
        ),
        ("max_drawdown", F.col("max_drawdown"), F.lit(-limits["max_drawdown"])),
    ]
    gates = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(m, F.lit(0.0)).alias("metric"), t.alias("threshold"), F.coalesce(m >= t, F.lit(False)).alias("passed")) for n, m, t in rows])
    return df.select(*keys, F.explode(gates).alias("_g")).select(*keys, "_g.*")


def promotion_verdict(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Promoted only if every gate passed."""
    return gates.groupBy(*keys).agg(F.bool_and("passed").alias("promoted"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))


def pair_alerts(curves: DataFrame, *, window: int = 48, alert: float = 0.7, reduce: float = 0.85, blocks: int | None = None) -> DataFrame:
    """Correlation of the last returns of equity curves that share times, with the advice it leads to."""
    from marketspark.operators.panel import correlations

    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    tail = curves.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= window)
    c = correlations(tail, "ret", least=5, blocks=blocks)
    size = F.abs("corr")
    return c.withColumns({"exceeds": size > alert, "advice": F.when(size > reduce, "reduce_weaker").when(size > alert, "alert").otherwise("none")})
