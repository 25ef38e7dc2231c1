"""Technical indicators over bar series.

Each indicator is registered with its category and default parameters and adds one column to a
bar table. Windows and linear recursions (``affine_scan``) carry all but two of them; Supertrend
and the parabolic SAR ratchet on their own output and use ``ordered_fold``. "Undefined" is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.operators.series import KEYS, ORDER, Then, affine_scan, correlation, full_frame, lookback, ordered_fold, series_window, then_affine, then_fold, then_seeded, through_now


@dataclass(frozen=True)
class Axis:
    """What a series is: its keys and its order."""

    keys: tuple[str, ...] = KEYS
    order: tuple[str, ...] = ORDER

    @property
    def w(self) -> WindowSpec:
        return series_window(self.keys, self.order)


@dataclass(frozen=True)
class Spec:
    name: str
    category: str
    add: Callable
    defaults: dict
    about: str


INDICATORS: dict[str, Spec] = {}


def indicator(category: str, **defaults) -> Callable:
    def register(fn: Callable) -> Callable:
        INDICATORS[fn.__name__] = Spec(fn.__name__, category, fn, defaults, (fn.__doc__ or "").strip().split("\n")[0])
        return fn

    return register


def add(bars: DataFrame, wanted: dict[str, tuple[str, dict] | str], axis: Axis = Axis()) -> DataFrame:
    """Add indicator columns: ``{"fast": ("ema", {"period": 12}), "obv": "obv"}``."""
    df = bars
    for out, want in wanted.items():
        name, params = (want, {}) if isinstance(want, str) else want
        spec = INDICATORS.get(name)
        if spec is None:
            raise ValueError(f"unknown indicator {name!r}; known: {', '.join(sorted(INDICATORS))}")
        unknown = set(params) - set(spec.defaults)
        if unknown:
            raise ValueError(f"indicator {name!r} has no parameter {', '.join(sorted(unknown))}")
        df = spec.add(df, axis, out, **{**spec.defaults, **params})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def catalogue(spark: SparkSession, category: str | None = None, search: str = "") -> DataFrame:
    rows = [
        (s.name, s.category, s.about, {k: str(v) for k, v in s.defaults.items()})
        for s in INDICATORS.values()
        if (category is None or s.category == category) and search.lower() in (s.name + " " + s.about).lower()
    ]
    return spark.createDataFrame(rows, "name string, category string, about string, defaults map<string,string>")


# ── building blocks ────────────────────────────────────────────────────────────────────────


def _close() -> Column:
    return F.col("close")


def _high() -> Column:
    return F.col("high")


def _low() -> Column:
    return F.col("low")


def _volume() -> Column:
    return F.col("volume")


def _typical() -> Column:
    return (_high() + _low() + _close()) / 3.0


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.when(before.isNotNull(), F.greatest(_high() - _low(), F.abs(_high() - before), F.abs(_low() - before)))


def seeded(value: Column, period: int, w: WindowSpec, keep: float, gain: float, seed: str = "avg") -> tuple[Column, Column]:
    """Coefficients of y = keep·y₋₁ + gain·x, started at the ``period``-th value of x with the
    mean (or sum) of those values; NULL before."""
    met = F.count(value).over(through_now(w))
    start = getattr(F, seed)(value).over(lookback(w, period))
    a = F.when(met == period, 0.0).when(met > period, keep)
    b = F.when(met == period, start).when(met > period, gain * value)
    return a, b


def _emas_of(df: DataFrame, ax: Axis, wanted: dict[str, tuple[Column, int]], then: Sequence[Then] = ()) -> DataFrame:
    scans = {}
    for out, (value, period) in wanted.items():
        alpha = 2.0 / (period + 1)
        scans[out] = seeded(value, period, ax.w, 1 - alpha, alpha)
    return affine_scan(df, scans, keys=ax.keys, order=ax.order, then=then)


def _ema_of(df: DataFrame, ax: Axis, out: str, value: Column, period: int) -> DataFrame:
    return _emas_of(df, ax, {out: (value, period)})


def _then_ema(out: str, inputs: Sequence[str], value: Callable[..., np.ndarray], period: int) -> Then:
    alpha = 2.0 / (period + 1)
    return then_seeded(out, inputs, value, period, 1 - alpha, alpha)


def _itself(x: np.ndarray) -> np.ndarray:
    return x


def _wilder_of(df: DataFrame, ax: Axis, columns: dict[str, Column], period: int, total: bool = False) -> DataFrame:
    keep = (period - 1) / period
    gain, seed = (1.0, "sum") if total else (1.0 / period, "avg")
    scans = {n: seeded(c, period, ax.w, keep, gain, seed) for n, c in columns.items()}
    return affine_scan(df, scans, keys=ax.keys, order=ax.order)


def _range_mid(period: int, w: WindowSpec) -> Column:
    return (full_frame(F.max("high"), _high(), w, period) + full_frame(F.min("low"), _low(), w, period)) / 2


def _share_at_or_below(value: str, rows: int, w: WindowSpec) -> tuple[Column, Column]:
    """(share of the frame's values ≤ the current one, number of values in the frame)."""
    seen = F.collect_list(value).over(lookback(w, rows))
    below = F.size(F.filter(seen, lambda x: x <= F.col(value)))
    return F.when(F.size(seen) > 0, below / F.size(seen)), F.size(seen)


# ── trend ──────────────────────────────────────────────────────────────────────────────────


@indicator("trend", period=20)
def sma(df, ax, out, period):
    """Simple moving average."""
    return df.withColumn(out, full_frame(F.avg("close"), _close(), ax.w, period))


@indicator("trend", period=20)
def ema(df, ax, out, period):
    """Exponential moving average, started with the simple mean."""
    return _ema_of(df, ax, out, _close(), period)


@indicator("trend", period=20)
def dema(df, ax, out, period):
    """Double exponential moving average."""
    df = _emas_of(df, ax, {"_e1": (_close(), period)}, [_then_ema("_e2", ["_e1"], _itself, period)])
    return df.withColumn(out, 2 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2")


@indicator("trend", period=20)
def tema(df, ax, out, period):
    """Triple exponential moving average."""
    then = [_then_ema("_e2", ["_e1"], _itself, period), _then_ema("_e3", ["_e2"], _itself, period)]
    df = _emas_of(df, ax, {"_e1": (_close(), period)}, then)
    return df.withColumn(out, 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")


def weighted_mean(value: Column, period: int, w: WindowSpec, position: Column) -> Column:
    """Linear weights 1…period, newest heaviest, from two frame sums."""
    frame = lookback(w, period)
    s = F.sum(value).over(frame)
    s_pos = F.sum(value * position).over(frame)
    weights = period * (period + 1) / 2
    return F.when(F.count(value).over(frame) == period, (s_pos - (position - period) * s) / weights)


@indicator("trend", period=20)
def wma(df, ax, out, period):
    """Linearly weighted moving average."""
    df = df.withColumn("_i", F.row_number().over(ax.w))
    return df.withColumn(out, weighted_mean(_close(), period, ax.w, F.col("_i"))).drop("_i")


@indicator("trend", period=20)
def hma(df, ax, out, period):
    """Hull moving average."""
    half, root = max(1, period // 2), max(1, math.isqrt(period))
    i = F.col("_i")
    df = df.withColumn("_i", F.row_number().over(ax.w))
    df = df.withColumn("_d", 2 * weighted_mean(_close(), half, ax.w, i) - weighted_mean(_close(), period, ax.w, i))
    return df.withColumn(out, weighted_mean(F.col("_d"), root, ax.w, i)).drop("_i", "_d")


@indicator("trend", period=20)
def linreg_slope(df, ax, out, period):
    """Least-squares slope of the last closes."""
    df = df.withColumn("_i", F.row_number().over(ax.w).cast("double"))
    frame = lookback(ax.w, period)
    return df.withColumn(out, F.when(F.count("close").over(frame) == period, F.regr_slope("close", "_i").over(frame))).drop("_i")


@indicator("trend", period=14)
def adx(df, ax, out, period):
    """Average directional index."""
    df = _directional(df, ax, period)
    p, m = F.coalesce(F.col(f"_pdi_{period}"), F.lit(0.0)), F.coalesce(F.col(f"_mdi_{period}"), F.lit(0.0))
    df = df.withColumn("_i", F.row_number().over(ax.w))
    dx = F.when(F.col("_i") > period + 1, F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).otherwise(0.0))
    df = df.withColumn("_dx", dx)
    return _wilder_of(df, ax, {out: F.col("_dx")}, period).drop("_dx", "_i")


@indicator("trend", period=14)
def plus_di(df, ax, out, period):
    """Positive directional indicator."""
    return _directional(df, ax, period).withColumn(out, F.col(f"_pdi_{period}"))


@indicator("trend", period=14)
def minus_di(df, ax, out, period):
    """Negative directional indicator."""
    return _directional(df, ax, period).withColumn(out, F.col(f"_mdi_{period}"))


def _directional(df: DataFrame, ax: Axis, period: int) -> DataFrame:
    """``_pdi_<period>`` and ``_mdi_<period>``, computed once for all indicators of one ``add`` that read them."""
    if f"_pdi_{period}" in df.columns:
        return df
    w = ax.w
    up, down = _high() - F.lag("high").over(w), F.lag("low").over(w) - _low()
    df = df.withColumns({"_tr": true_range(w), "_up": up, "_dn": down})
    up, down = F.col("_up"), F.col("_dn")
    known = up.isNotNull()
    moves = {
        "_tr_s": F.col("_tr"),
        "_pdm_s": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_mdm_s": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }
    df = _wilder_of(df, ax, moves, period, total=True)
    positive = F.col("_tr_s") > 0
    sides = {f"_pdi_{period}": "_pdm_s", f"_mdi_{period}": "_mdm_s"}
    df = df.withColumns({n: F.when(positive, 100 * F.col(s) / F.col("_tr_s")) for n, s in sides.items()})
    return df.drop("_tr", "_up", "_dn", "_tr_s", "_pdm_s", "_mdm_s")


@indicator("trend", period=14)
def aroon_up(df, ax, out, period):
    """Aroon up: how recent the highest high is (the earliest of equals)."""
    return _aroon(df, ax, out, "high", F.array_max, period)


@indicator("trend", period=14)
def aroon_down(df, ax, out, period):
    """Aroon down: how recent the lowest low is (the earliest of equals)."""
    return _aroon(df, ax, out, "low", F.array_min, period)


def _aroon(df, ax, out, column, extreme, period):
    seen = F.collect_list(column).over(lookback(ax.w, period + 1))
    df = df.withColumn("_l", seen)
    at = F.array_position("_l", extreme("_l")) - 1
    return df.withColumn(out, F.when(F.size("_l") == period + 1, at / period * 100.0)).drop("_l")


@indicator("trend", period=10, mult=3.0)
def supertrend(df, ax, out, period, mult):
    """Supertrend direction: 1 up, −1 down."""
    df = atr(df, ax, "_atr", period)
    schema = T.StructType([T.StructField(out, T.DoubleType())])
    return ordered_fold(df, _trend_start, _trend_step(mult), ["high", "low", "close", "_atr"], schema, keys=ax.keys, order=ax.order).drop("_atr")


def _trend_start() -> tuple:
    return (1.0, None, None, None)


def _trend_step(mult: float) -> Callable[[tuple, tuple], tuple[tuple, tuple]]:
    def step(state, row):
        high, low, close, width = row
        if width is None:
            return (state[0], None, None, close), (None,)
        direction, upper, lower, last = state
        new_up, new_low = (high + low) / 2 + mult * width, (high + low) / 2 - mult * width
        if lower is not None:
            # a band may only tighten while the last close respects it
            if last > lower:
                new_low = max(new_low, lower)
            if last < upper:
                new_up = min(new_up, upper)
            if direction > 0:
                direction = -1.0 if close < new_low else 1.0
            else:
                direction = 1.0 if close > new_up else -1.0
        return (direction, new_up, new_low, close), (direction,)

    return step


@indicator("trend", af_start=0.02, af_step=0.02, af_max=0.2)
def psar(df, ax, out, af_start, af_step, af_max):
    """Parabolic stop and reverse."""

    def step(state, row):
        high, low = row
        history, trend, sar, extreme, speed = state
        if len(history) < 2:
            if not history:
                sar, extreme = high, low
            return ([*history, row], trend, sar, extreme, speed), (None,)
        sar += speed * (extreme - sar)
        reach, other = (high, low) if trend > 0 else (low, high)
        bound = [h[1] if trend > 0 else h[0] for h in history]
        sar = min(sar, *bound) if trend > 0 else max(sar, *bound)
        if trend * (reach - extreme) > 0:
            extreme, speed = reach, min(speed + af_step, af_max)
        if trend * (other - sar) < 0:
            trend, sar, extreme, speed = -trend, extreme, other, af_start
        return ([history[1], row], trend, sar, extreme, speed), (sar,)

    schema = T.StructType([T.StructField(out, T.DoubleType())])
    start = lambda: ([], 1, None, None, af_start)
    return ordered_fold(df, start, step, ["high", "low"], schema, keys=ax.keys, order=ax.order)


@indicator("trend", period=9)
def ichimoku_tenkan(df, ax, out, period):
    """Ichimoku conversion line: middle of the range."""
    return df.withColumn(out, _range_mid(period, ax.w))


@indicator("trend", period=26)
def ichimoku_kijun(df, ax, out, period):
    """Ichimoku base line: middle of the range."""
    return df.withColumn(out, _range_mid(period, ax.w))


@indicator("trend", tenkan=9, kijun=26)
def ichimoku_senkou_a(df, ax, out, tenkan, kijun):
    """Leading span A: mean of conversion and base line, shifted by the base period."""
    df = df.withColumn("_m", (_range_mid(tenkan, ax.w) + _range_mid(kijun, ax.w)) / 2)
    return df.withColumn(out, F.lag("_m", kijun).over(ax.w)).drop("_m")


@indicator("trend", period=52, shift=26)
def ichimoku_senkou_b(df, ax, out, period, shift):
    """Leading span B: middle of the long range, shifted."""
    df = df.withColumn("_m", _range_mid(period, ax.w))
    return df.withColumn(out, F.lag("_m", shift).over(ax.w)).drop("_m")


# ── momentum ───────────────────────────────────────────────────────────────────────────────


@indicator("momentum", period=14)
def rsi(df, ax, out, period):
    """Relative strength index (Wilder); a series without losses gives rs = 100."""
    move = F.col("_mv")
    df = df.withColumn("_mv", _close() - F.lag("close").over(ax.w))
    parts = {"_g": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_l": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))}
    df = _wilder_of(df, ax, parts, period)
    emitted = F.count("_mv").over(through_now(ax.w)) > period
    rs = F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).otherwise(100.0)
    return df.withColumn(out, F.when(emitted, 100.0 - 100.0 / (1.0 + rs))).drop("_mv", "_g", "_l")


@indicator("momentum", period=14)
def rsi_simple(df, ax, out, period):
    """RSI from plain means of the last moves; 50 while there are too few, 100 without losses."""
    df = df.withColumn("_mv", _close() - F.lag("close").over(ax.w))
    frame = lookback(ax.w, period)
    gain = F.sum(F.greatest(F.col("_mv"), F.lit(0.0))).over(frame) / period
    loss = F.sum(F.greatest(-F.col("_mv"), F.lit(0.0))).over(frame) / period
    value = F.when(F.count("_mv").over(frame) < period, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return df.withColumn(out, value).drop("_mv")


def _macd_of(df: DataFrame, ax: Axis, fast: int, slow: int, signal: int) -> tuple[DataFrame, Column, Column]:
    """The bars with MACD line and signal, computed in one pass for all indicators of one ``add`` that read them."""
    line, smooth = f"_macd_{fast}_{slow}_{signal}", f"_macds_{fast}_{slow}_{signal}"
    if line not in df.columns:
        df = _emas_of(df, ax, {"_f": (_close(), fast), "_s": (_close(), slow)}, [_then_ema(smooth, ["_f", "_s"], np.subtract, signal)])
        df = df.withColumn(line, F.col("_f") - F.col("_s")).drop("_f", "_s")
    return df, F.col(line), F.col(smooth)


@indicator("momentum", fast=12, slow=26, signal=9)
def macd(df, ax, out, fast, slow, signal):
    """MACD line."""
    df, line, _ = _macd_of(df, ax, fast, slow, signal)
    return df.withColumn(out, line)


@indicator("momentum", fast=12, slow=26, signal=9)
def macd_signal(df, ax, out, fast, slow, signal):
    """EMA of the MACD line."""
    df, _, smooth = _macd_of(df, ax, fast, slow, signal)
    return df.withColumn(out, smooth)


@indicator("momentum", fast=12, slow=26, signal=9)
def macd_histogram(df, ax, out, fast, slow, signal):
    """MACD line minus its signal."""
    df, line, smooth = _macd_of(df, ax, fast, slow, signal)
    return df.withColumn(out, line - smooth)


def _raw_k(period: int, w: WindowSpec) -> Column:
    top, bottom = full_frame(F.max("high"), _high(), w, period), full_frame(F.min("low"), _low(), w, period)
    return F.when(top != bottom, 100.0 * (_close() - bottom) / (top - bottom)).when(top == bottom, 50.0)


@indicator("momentum", period=14, smooth=3)
def stoch_k(df, ax, out, period, smooth):
    """Smoothed stochastic %K; 50 in a flat range."""
    df = df.withColumn("_k", _raw_k(period, ax.w))
    return df.withColumn(out, full_frame(F.avg("_k"), F.col("_k"), ax.w, smooth)).drop("_k")


@indicator("momentum", period=14, smooth=3)
def stoch_d(df, ax, out, period, smooth):
    """Mean of %K."""
    df = stoch_k(df, ax, "_sk", period, smooth)
    return df.withColumn(out, full_frame(F.avg("_sk"), F.col("_sk"), ax.w, smooth)).drop("_sk")


@indicator("momentum", period=14)
def williams_r(df, ax, out, period):
    """Williams %R; −50 in a flat range."""
    top, bottom = full_frame(F.max("high"), _high(), ax.w, period), full_frame(F.min("low"), _low(), ax.w, period)
    return df.withColumn(out, F.when(top != bottom, -100.0 * (top - _close()) / (top - bottom)).when(top == bottom, -50.0))


@indicator("momentum", period=20)
def cci(df, ax, out, period):
    """Commodity channel index: the mean deviation is about the frame's own mean."""
    df = df.withColumn("_tp", _typical())
    df = df.withColumns({"_l": F.collect_list("_tp").over(lookback(ax.w, period)), "_m": full_frame(F.avg("_tp"), F.col("_tp"), ax.w, period)})
    dev = F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / period
    return df.withColumn(out, F.when(dev > 0, (F.col("_tp") - F.col("_m")) / (0.015 * dev))).drop("_tp", "_l", "_m")


@indicator("momentum", period=10)
def roc(df, ax, out, period):
    """Rate of change in percent."""
    past = F.lag("close", period).over(ax.w)
    return df.withColumn(out, F.when(past != 0, (_close() - past) / past * 100.0))


@indicator("momentum", period=14)
def mfi(df, ax, out, period):
    """Money flow index; 100 without negative flow."""
    df = df.withColumn("_tp", _typical())
    df = df.withColumn("_ch", F.col("_tp") - F.lag("_tp").over(ax.w))
    flow, frame = F.col("_tp") * _volume(), lookback(ax.w, period)
    df = df.withColumns({"_pf": F.when(F.col("_ch") > 0, flow).otherwise(0.0), "_nf": F.when(F.col("_ch") < 0, flow).otherwise(0.0)})
    pos, neg = F.sum("_pf").over(frame), F.sum("_nf").over(frame)
    value = F.when(neg > 0, 100.0 - 100.0 / (1.0 + pos / neg)).otherwise(100.0)
    return df.withColumn(out, F.when(F.count("_ch").over(frame) == period, value)).drop("_tp", "_ch", "_pf", "_nf")


# ── volatility ─────────────────────────────────────────────────────────────────────────────


@indicator("volatility", period=14)
def atr(df, ax, out, period):
    """Average true range (Wilder)."""
    df = df.withColumn("_tr", true_range(ax.w))
    return _wilder_of(df, ax, {out: F.col("_tr")}, period).drop("_tr")


@indicator("volatility", period=14, atr_period=14)
def atr_sma(df, ax, out, period, atr_period):
    """Mean of the valid ATR values in the frame."""
    df = atr(df, ax, "_at", atr_period)
    full = F.count("close").over(lookback(ax.w, period)) == period
    return df.withColumn(out, F.when(full, F.avg("_at").over(lookback(ax.w, period)))).drop("_at")


@indicator("volatility", period=20)
def stddev(df, ax, out, period):
    """Population standard deviation of closes."""
    return df.withColumn(out, full_frame(F.stddev_pop("close"), _close(), ax.w, period))


@indicator("volatility", period=20, std=2.0)
def bb_upper(df, ax, out, period, std):
    """Bollinger upper band."""
    return df.withColumn(out, _band(period, std, ax.w))


@indicator("volatility", period=20, std=2.0)
def bb_lower(df, ax, out, period, std):
    """Bollinger lower band."""
    return df.withColumn(out, _band(period, -std, ax.w))


def _band(period: int, std: float, w: WindowSpec) -> Column:
    return full_frame(F.avg("close"), _close(), w, period) + std * full_frame(F.stddev_pop("close"), _close(), w, period)


@indicator("volatility", period=20, std=2.0)
def bb_width(df, ax, out, period, std):
    """Bollinger width relative to the mean."""
    mean = full_frame(F.avg("close"), _close(), ax.w, period)
    return df.withColumn(out, F.when(mean > 0, 2 * std * F.stddev_pop("close").over(lookback(ax.w, period)) / mean))


@indicator("volatility", period=20)
def donchian_upper(df, ax, out, period):
    """Highest high, the current bar included."""
    return df.withColumn(out, full_frame(F.max("high"), _high(), ax.w, period))


@indicator("volatility", period=20)
def donchian_lower(df, ax, out, period):
    """Lowest low, the current bar included."""
    return df.withColumn(out, full_frame(F.min("low"), _low(), ax.w, period))


@indicator("volatility", period=20, atr_period=14, mult=2.0)
def keltner_upper(df, ax, out, period, atr_period, mult):
    """EMA plus a multiple of the ATR (0 while the ATR is undefined)."""
    return _keltner(df, ax, out, period, atr_period, mult)


@indicator("volatility", period=20, atr_period=14, mult=2.0)
def keltner_lower(df, ax, out, period, atr_period, mult):
    """EMA minus a multiple of the ATR (0 while the ATR is undefined)."""
    return _keltner(df, ax, out, period, atr_period, -mult)


def _keltner(df, ax, out, period, atr_period, mult):
    df = atr(_ema_of(df, ax, "_em", _close(), period), ax, "_at", atr_period)
    return df.withColumn(out, F.col("_em") + mult * F.coalesce("_at", F.lit(0.0))).drop("_em", "_at")


@indicator("volatility", period=20, per_year=8760.0)
def histvol(df, ax, out, period, per_year):
    """Annualised population deviation of the last log returns."""
    past = F.lag("close").over(ax.w)
    df = df.withColumn("_lr", F.when((past > 0) & (_close() > 0), F.log(_close() / past)))
    return df.withColumn(out, full_frame(F.stddev_pop("_lr"), F.col("_lr"), ax.w, period) * math.sqrt(per_year)).drop("_lr")


@indicator("volatility", atr_period=14, lookback=100)
def vol_regime(df, ax, out, atr_period, lookback):
    """0 calm, 1 normal, 2 wild, by the rank of the ATR among the last ones."""
    df = atr(df, ax, "_at", atr_period)
    df = df.withColumn("_i", F.row_number().over(ax.w))
    share, seen = _share_at_or_below("_at", lookback, ax.w)
    df = df.withColumns({"_sh": share, "_n": seen})
    ready = (F.col("_i") > lookback) & F.col("_at").isNotNull() & (F.col("_n") >= 10)
    return df.withColumn(out, F.when(ready, F.when(F.col("_sh") < 0.25, 0.0).when(F.col("_sh") > 0.75, 2.0).otherwise(1.0))).drop("_at", "_i", "_sh", "_n")


# ── volume ─────────────────────────────────────────────────────────────────────────────────


@indicator("volume", period=20)
def vol_ratio(df, ax, out, period):
    """Volume over its mean."""
    mean = full_frame(F.avg("volume"), _volume(), ax.w, period)
    return df.withColumn(out, F.when(mean > 0, _volume() / mean))


@indicator("volume", period=20)
def relative_volume(df, ax, out, period):
    """Volume over the mean of the bars so far, at most ``period`` of them."""
    mean = F.avg("volume").over(lookback(ax.w, period))
    return df.withColumn(out, F.when(mean > 0, _volume() / mean).otherwise(1.0))


def _rolling_vwap(period: int, w: WindowSpec, flat_mean: bool) -> Column:
    total = full_frame(F.sum("volume"), _volume(), w, period)
    weighted = F.sum(_close() * _volume()).over(lookback(w, period)) / total
    flat = full_frame(F.avg("close"), _close(), w, period) if flat_mean else F.lit(None)
    return F.when(total > 0, weighted).when(total == 0, flat)


@indicator("volume", period=20)
def vwap(df, ax, out, period):
    """Rolling volume-weighted price; the plain mean where nothing traded."""
    return df.withColumn(out, _rolling_vwap(period, ax.w, True))


@indicator("volume", period=20)
def vwap_std(df, ax, out, period):
    """Population deviation of close − VWAP, from at least three values."""
    df = df.withColumn("_dv", _close() - _rolling_vwap(period, ax.w, False))
    frame = lookback(ax.w, period)
    return df.withColumn(out, F.when(F.count("_dv").over(frame) > 2, F.stddev_pop("_dv").over(frame))).drop("_dv")


@indicator("volume", period=20)
def vwap_zscore(df, ax, out, period):
    """Distance to the VWAP in deviations."""
    df = vwap_std(vwap(df, ax, "_vw", period), ax, "_vs", period)
    return df.withColumn(out, F.when(F.col("_vs") > 0, (_close() - F.col("_vw")) / F.col("_vs"))).drop("_vw", "_vs")


@indicator("volume")
def session_vwap(df, ax, out):
    """Volume-weighted typical price since the start of the series."""
    frame = through_now(ax.w)
    total = F.sum("volume").over(frame)
    return df.withColumn(out, F.when(total > 0, F.sum(_typical() * _volume()).over(frame) / total))


@indicator("volume")
def obv(df, ax, out):
    """On-balance volume."""
    df = df.withColumn("_sg", F.coalesce(F.signum(_close() - F.lag("close").over(ax.w)), F.lit(0.0)) * _volume())
    return df.withColumn(out, F.sum("_sg").over(through_now(ax.w))).drop("_sg")


@indicator("volume", period=20)
def cmf(df, ax, out, period):
    """Chaikin money flow."""
    spread = _high() - _low()
    df = df.withColumn("_mf", F.when(spread > 0, (2 * _close() - _low() - _high()) / spread).otherwise(0.0) * _volume())
    total = full_frame(F.sum("volume"), _volume(), ax.w, period)
    return df.withColumn(out, F.when(total > 0, F.sum("_mf").over(lookback(ax.w, period)) / total)).drop("_mf")


# ── structure ──────────────────────────────────────────────────────────────────────────────


@indicator("structure", period=20)
def swing_high(df, ax, out, period):
    """Highest high of period + 1 bars."""
    return df.withColumn(out, full_frame(F.max("high"), _high(), ax.w, period + 1))


@indicator("structure", period=20)
def swing_low(df, ax, out, period):
    """Lowest low of period + 1 bars."""
    return df.withColumn(out, full_frame(F.min("low"), _low(), ax.w, period + 1))


@indicator("structure", period=1)
def pivot_point(df, ax, out, period):
    """Typical price of an earlier bar."""
    return df.withColumn(out, F.lag(_typical(), period).over(ax.w))


# ── adaptive ───────────────────────────────────────────────────────────────────────────────


@indicator("adaptive", period=10, fast=2, slow=30)
def kama(df, ax, out, period, fast, slow):
    """Kaufman's adaptive average: the smoothing follows the efficiency of the move."""
    quick, lazy = 2.0 / (fast + 1), 2.0 / (slow + 1)
    df = df.withColumn("_ab", F.abs(_close() - F.lag("close").over(ax.w)))
    df = df.withColumns({"_path": F.sum("_ab").over(lookback(ax.w, period)), "_i": F.row_number().over(ax.w)})
    direct = F.abs(_close() - F.lag("close", period).over(ax.w))
    ratio = F.when(F.col("_path") > 0, direct / F.col("_path")).otherwise(0.0)
    df = df.withColumn("_sc", F.pow(ratio * (quick - lazy) + lazy, F.lit(2.0)))
    i, sc = F.col("_i"), F.col("_sc")
    a = F.when(i == period, 0.0).when(i > period, 1 - sc)
    b = F.when(i == period, F.avg("close").over(lookback(ax.w, period))).when(i > period, sc * _close())
    return affine_scan(df, {out: (a, b)}, keys=ax.keys, order=ax.order).drop("_ab", "_path", "_i", "_sc")


def _adaptive_period(df: DataFrame, ax: Axis, base: int, atr_period: int, least: int, most: int, need_previous: bool) -> DataFrame:
    """``_i`` and ``_per``: a short period when the ATR ranks high among the last 101 values."""
    df = atr(df, ax, "_at", atr_period)
    share, seen = _share_at_or_below("_at", 101, ax.w)
    df = df.withColumns({"_sh": share, "_n": seen, "_i": F.row_number().over(ax.w), "_before": F.lag("_at").over(ax.w)})
    known = F.col("_at").isNotNull() & (F.col("_n") > 5)
    if need_previous:
        known = known & F.col("_before").isNotNull()
    period = F.floor(least + (1 - F.col("_sh")) * (most - least))
    return df.withColumn("_per", F.when(known, period).otherwise(base)).drop("_at", "_sh", "_n", "_before")


@indicator("adaptive", base_period=20, atr_period=14, min_period=5, max_period=50)
def adaptive_ema(df, ax, out, base_period, atr_period, min_period, max_period):
    """EMA whose period shrinks as volatility ranks higher."""
    df = _adaptive_period(df, ax, base_period, atr_period, min_period, max_period, True)
    warm = max(base_period, atr_period) + 10
    alpha, i = 2.0 / (F.col("_per") + 1), F.col("_i")
    a = F.when(i == warm, 0.0).when(i > warm, 1 - alpha)
    b = F.when(i == warm, F.avg("close").over(lookback(ax.w, warm))).when(i > warm, alpha * _close())
    return affine_scan(df, {out: (a, b)}, keys=ax.keys, order=ax.order).drop("_i", "_per")


@indicator("adaptive", base_period=14, atr_period=14, min_period=7, max_period=28)
def adaptive_rsi(df, ax, out, base_period, atr_period, min_period, max_period):
    """RSI whose period shrinks as volatility ranks higher."""
    df = _adaptive_period(df, ax, base_period, atr_period, min_period, max_period, False)
    warm = max(max_period, atr_period) + 10
    df = df.withColumn("_mv", _close() - F.lag("close").over(ax.w))
    alpha, i, scans = 1.0 / F.col("_per"), F.col("_i"), {}
    for name, part in {"_g": F.greatest(F.col("_mv"), F.lit(0.0)), "_l": F.greatest(-F.col("_mv"), F.lit(0.0))}.items():
        start = F.sum(F.when(F.col("_mv").isNotNull(), part)).over(lookback(ax.w, warm)) / (warm - 1)
        scans[name] = (F.when(i == warm, 0.0).when(i > warm, 1 - alpha), F.when(i == warm, start).when(i > warm, alpha * part))
    df = affine_scan(df, scans, keys=ax.keys, order=ax.order)
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).otherwise(100.0)
    return df.withColumn(out, F.when(F.col("_i") > warm, value)).drop("_i", "_per", "_mv", "_g", "_l")


# ── order flow ─────────────────────────────────────────────────────────────────────────────


@indicator("order_flow", period=20, column="taker_ratio")
def taker_ratio_mean(df, ax, out, period, column):
    """Mean taker share."""
    return df.withColumn(out, full_frame(F.avg(column), F.col(column), ax.w, period))


@indicator("order_flow", period=14)
def buy_sell_imbalance(df, ax, out, period):
    """(buys − sells) / (buys + sells) of the frame; 0 without volume."""
    frame = lookback(ax.w, period)
    buys, sells = F.sum("buy_volume").over(frame), F.sum("sell_volume").over(frame)
    full = F.count(F.lit(1)).over(frame) == period
    return df.withColumn(out, F.when(full, F.when(buys + sells > 0, (buys - sells) / (buys + sells)).otherwise(0.0)))


@indicator("order_flow", period=20)
def position_flow(df, ax, out, period):
    """Net position flow of the frame."""
    return df.withColumn(out, _frame_sum("net_flow", period, ax.w))


@indicator("order_flow", period=20)
def pnl_flow(df, ax, out, period):
    """Realised profit of the frame."""
    return df.withColumn(out, _frame_sum("total_pnl", period, ax.w))


def _frame_sum(column: str, period: int, w: WindowSpec) -> Column:
    frame = lookback(w, period)
    return F.when(F.count(F.lit(1)).over(frame) == period, F.coalesce(F.sum(column).over(frame), F.lit(0.0)))


@indicator("order_flow", period=10, column="taker_ratio")
def trade_intensity(df, ax, out, period, column):
    """EMA of the taker share that holds its value on gaps."""
    alpha, value = 2.0 / (period + 1), F.col(column)
    df = df.withColumn("_i", F.row_number().over(ax.w))
    i = F.col("_i")
    a = F.when(i == period, 0.0).when(i > period, F.when(value.isNull(), 1.0).otherwise(1 - alpha))
    b = F.when(i == period, F.avg(column).over(lookback(ax.w, period))).when(i > period, F.when(value.isNull(), 0.0).otherwise(alpha * value))
    return affine_scan(df, {out: (a, b)}, keys=ax.keys, order=ax.order).drop("_i")


# ── several timeframes, several assets ─────────────────────────────────────────────────────


def higher_timeframe(bars: DataFrame, out: str, inner: tuple[str, dict], ratio: int, *, lookahead: bool = False, axis: Axis = Axis()) -> DataFrame:
    """``inner`` on bars merged ``ratio`` by ``ratio``, joined back.

    By default a bar sees the last *completed* merged bar. ``lookahead`` gives every bar of a
    merged bar its final value.
    """
    numbered = bars.withColumn("_k", F.floor((F.row_number().over(axis.w) - 1) / ratio).cast("long"))
    rank = F.struct(*axis.order)
    merged = numbered.groupBy(*axis.keys, "_k").agg(
        F.max_by("close", rank).alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("_rows"),
    )
    merged = merged.where(F.col("_rows") == ratio).withColumnRenamed("_k", "k").drop("_rows")
    values = add(merged, {out: inner}, Axis(axis.keys, ("k",)))
    shift = 0 if lookahead else 1
    values = values.select(*axis.keys, (F.col("k") + shift).alias("_k"), out)
    return numbered.join(values, [*axis.keys, "_k"], "left").drop("_k")


def rolling_comovement(df: DataFrame, ref: str, period: int, axis: Axis = Axis()) -> DataFrame:
    """``corr`` and ``beta`` of the last price differences against the column ``ref``, from at least
    half of them. The beta divides a sample covariance by a population variance."""
    w = axis.w
    df = df.withColumns({"_a": _close() - F.lag("close").over(w), "_b": F.col(ref) - F.lag(ref).over(w), "_i": F.row_number().over(w)})
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    df = df.withColumns({"_x": F.when(both, F.col("_a")), "_y": F.when(both, F.col("_b"))})
    frame = lookback(w, period)
    n = F.count("_x").over(frame)
    ready = (F.col("_i") > period) & (n >= period // 2) & (n > 1)
    sx, sy = F.stddev_pop("_x").over(frame), F.stddev_pop("_y").over(frame)
    return df.withColumns(
        {
            "corr": F.when(ready & (sx > 0) & (sy > 0), correlation(F.col("_x"), F.col("_y"), frame)),
            "beta": F.when(ready & (sy > 0), F.try_divide(F.covar_samp("_x", "_y").over(frame), sy * sy)),
        }
    ).drop("_a", "_b", "_x", "_y", "_i")


def running_flow(df: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """Cumulative volume delta and net positioning from recorded flow; where a bar has no recorded
    volume split its colour decides. Needs ``oi`` for the inferred positioning (see below)."""
    w = through_now(axis.w)
    delta = F.coalesce(F.col("buy_volume") - F.col("sell_volume"), _bar_colour() * _volume())
    zero = F.lit(0.0)
    longs = F.coalesce("opens_long", zero) - F.coalesce("closes_long", zero)
    shorts = F.coalesce("opens_short", zero) - F.coalesce("closes_short", zero)
    df = df.withColumns({"cvd": F.sum(delta).over(w), "net_longs": F.sum(longs).over(w), "net_shorts": F.sum(shorts).over(w)})
    return df.withColumn("net_delta", F.col("net_longs") - F.col("net_shorts"))


def _bar_colour() -> Column:
    return F.signum(_close() - F.col("open"))


def inferred_positioning(df: DataFrame, oi: str = "oi", axis: Axis = Axis()) -> DataFrame:
    """Net longs and shorts from open-interest change and bar colour: growing interest opens
    positions in the bar's direction, shrinking interest closes those against it."""
    w = axis.w
    df = df.withColumn("_known", F.when(F.col(oi) > 0, F.col(oi)))
    before = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_chg", F.when(F.col("_known").isNotNull(), F.col("_known") - before))
    colour, change = _bar_colour(), F.coalesce(F.col("_chg"), F.lit(0.0))
    longs = F.when((change > 0) & (colour > 0), change).when((change < 0) & (colour < 0), change).otherwise(0.0)
    shorts = F.when((change > 0) & (colour < 0), change).when((change < 0) & (colour > 0), change).otherwise(0.0)
    df = df.withColumns({"net_longs": F.sum(longs).over(through_now(w)), "net_shorts": F.sum(shorts).over(through_now(w))})
    return df.withColumn("net_delta", F.col("net_longs") - F.col("net_shorts")).drop("_known", "_chg")


def regime_labels(bars: DataFrame, axis: Axis = Axis(), *, vol_short: int = 14, vol_long: int = 100, trend_period: int = 14) -> DataFrame:
    """Volatility label (ATR against the 33rd and 67th percentile of the trailing frame) and trend
    label (ADX and directional indicators) of each bar; here the averages start from the first
    rows, which all share the seed."""
    w = axis.w
    before = F.coalesce(F.lag("close").over(w), _close())
    up = F.coalesce(_high() - F.lag("high").over(w), F.lit(0.0))
    down = F.coalesce(F.lag("low").over(w) - _low(), F.lit(0.0))
    df = bars.withColumns(
        {
            "_tr": F.greatest(_high() - _low(), F.abs(_high() - before), F.abs(_low() - before)),
            "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "_i": F.row_number().over(w),
        }
    )

    def flat_start(value: str, period: int, agg: Callable, keep: float, gain: float) -> tuple[Column, Column]:
        seed = agg(F.when(F.col("_i") <= period, F.col(value))).over(Window.partitionBy(*axis.keys))
        early = F.col("_i") <= period
        return F.when(early, 0.0).otherwise(keep), F.when(early, seed).otherwise(gain * F.col(value))

    p, v = trend_period, vol_short
    scans = {"atr": flat_start("_tr", v, F.avg, (v - 1) / v, 1 / v)}
    scans |= {f"{n}_s": flat_start(n, p, F.sum, (p - 1) / p, 1.0) for n in ("_tr", "_pdm", "_mdm")}
    df = affine_scan(df, scans, keys=axis.keys, order=axis.order)
    strength = F.col("_tr_s")
    df = df.withColumns({n: F.when(strength > 0, 100 * F.col(s) / strength).otherwise(0.0) for n, s in {"plus_di": "_pdm_s", "minus_di": "_mdm_s"}.items()})
    total = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("_dx", F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total).otherwise(0.0))
    df = affine_scan(df, {"adx": flat_start("_dx", 2 * p, F.avg, (p - 1) / p, 1 / p)}, keys=axis.keys, order=axis.order)
    frame = lookback(w, vol_long + 1)
    cuts = F.percentile("atr", F.array(F.lit(0.33), F.lit(0.67))).over(frame)
    df = df.withColumns({"_cuts": cuts, "_n": F.count("atr").over(frame)})
    vol = F.when(F.col("_n") < 10, "warmup").when(F.col("atr") < F.col("_cuts")[0], "low").when(F.col("atr") < F.col("_cuts")[1], "normal").otherwise("high")
    trend = F.when(F.col("_i") <= 2 * p, "warmup").when(F.col("adx") <= 20, "chop").when(F.col("plus_di") > F.col("minus_di"), "bull").otherwise("bear")
    df = df.withColumns({"vol_regime": vol, "trend_regime": trend})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def label_shares(labelled: DataFrame, label: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of bars per label in percent, warm-up excluded."""
    counts = labelled.where(F.col(label) != "warmup").groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", F.col("n") / total * 100)


#: Indicators that ``add_recursions`` makes in one pass.
RECURSIONS = ("rsi", "ema", "atr", "adx", "supertrend")


def _adx_index(period: int) -> Callable[..., np.ndarray]:
    """The directional index from row numbers and directional sums."""

    def index(i: np.ndarray, width: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            p, m = (np.where(width > 0, np.nan_to_num(100 * x / width), 0.0) for x in (up, down))
            return np.where(i > period + 1, np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), 0.0), np.nan)

    return index


def _directed(move: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A move where it is the larger one and positive, else 0; unknown where the move is."""
    return np.where(np.isnan(move), np.nan, np.where((move > other) & (move > 0), move, 0.0))


def add_recursions(bars: DataFrame, wanted: dict[str, tuple[str, dict]], axis: Axis = Axis()) -> DataFrame:
    """``add`` for the recursions of ``RECURSIONS``: all windows first, all recursions in one pass behind them, so one
    exchange and one sort of the bars however many there are."""
    w, kept = axis.w, bars.columns
    up, down = _high() - F.lag("high").over(w), F.lag("low").over(w) - _low()
    move = _close() - F.lag("close").over(w)
    df = bars.withColumns({"_mv": move, "_tr": true_range(w), "_up": up, "_dn": down, "_i": F.row_number().over(w)})
    df = df.withColumn("_moves", F.count("_mv").over(through_now(w)))
    then, made = [], {}

    def wilder(n: str, inputs: Sequence[str], value: Callable[..., np.ndarray], period: int, total: bool = False) -> str:
        then.append(then_seeded(n, inputs, value, period, (period - 1) / period, 1.0 if total else 1.0 / period, total))
        return n

    for out, (name, params) in wanted.items():
        spec = {**INDICATORS[name].defaults, **params}
        period = spec["period"]
        if name == "ema":
            then.append(_then_ema(out, ["close"], _itself, period))
        elif name == "atr":
            wilder(out, ["_tr"], _itself, period)
        elif name == "rsi":
            gain = wilder(f"_g_{out}", ["_mv"], lambda x: np.maximum(x, 0.0), period)
            loss = wilder(f"_l_{out}", ["_mv"], lambda x: np.maximum(-x, 0.0), period)
            rs = F.when(F.col(loss) > 0, F.col(gain) / F.col(loss)).otherwise(100.0)
            made[out] = F.when(F.col("_moves") > period, 100.0 - 100.0 / (1.0 + rs))
        elif name == "adx":
            width = wilder(f"_w_{out}", ["_tr"], _itself, period, total=True)
            rises = wilder(f"_u_{out}", ["_up", "_dn"], _directed, period, total=True)
            falls = wilder(f"_d_{out}", ["_dn", "_up"], _directed, period, total=True)
            wilder(out, ["_i", width, rises, falls], _adx_index(period), period)
        elif name == "supertrend":
            width = wilder(f"_t_{out}", ["_tr"], _itself, period)
            then.append(then_fold([out], ["high", "low", "close", width], _trend_start, _trend_step(spec["mult"])))
        else:
            raise ValueError(f"no recursion {name!r}; known: {', '.join(RECURSIONS)}")
    # seeds are taken in the pass too: a window for each would go over its whole frame at every row
    return affine_scan(df, {}, keys=axis.keys, order=axis.order, then=then).withColumns(made).select(*kept, *wanted)


# ── library conventions ────────────────────────────────────────────────────────────────────
#
# The same indicators under the conventions of common indicator libraries: EMA and Wilder
# averages start from an SMA seed or from the first value, deviations are samples.


def _library_adx(rsi_length: int) -> Then:
    """Average of the directional index from where it is first shown."""
    keep, gain = (rsi_length - 1) / rsi_length, 1 / rsi_length

    def coefficients(i: np.ndarray, up: np.ndarray, down: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shown = i > rsi_length
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = (np.where(shown & (width != 0), 100 * (x / width), np.nan) for x in (up, down))
            total = plus + minus
            dx = np.where(total != 0, 100 * (np.abs(plus - minus) / total), np.nan)
        first = i == rsi_length + 1
        return np.where(first, 0.0, np.where(shown, keep, np.nan)), np.where(first, dx, np.where(shown, gain * dx, np.nan))

    return then_affine("_adx", ["_i", "_us", "_ds", "_as"], coefficients)


def _library_supertrend(multiplier: float, trend_length: int) -> Then:
    """Band that trails the trend, and its direction: a close beyond the band of the bar before turns it."""

    def step(state, row):
        direction, upper, lower = state
        i, high, low, close, width = row
        if i <= trend_length:
            width = None
        new_up = None if width is None else (high + low) / 2 + multiplier * width
        new_low = None if width is None else (high + low) / 2 - multiplier * width
        if upper is not None:
            if close > upper:
                direction = 1.0
            elif close < lower:
                direction = -1.0
            elif direction > 0:
                new_low = max(new_low, lower)
            else:
                new_up = min(new_up, upper)
        return (direction, new_up, new_low), (new_low if direction > 0 else new_up, direction)

    return then_fold(["supertrend", "supertrend_direction"], ["_i", "high", "low", "close", "_ws"], lambda: (1.0, None, None), step)


def library_set(bars: DataFrame, axis: Axis = Axis(), *, length: int = 20, rsi_length: int = 14, trend_length: int = 7, multiplier: float = 3.0) -> DataFrame:
    """Stable-named columns: sma, ema, wma, rsi, macd*, stoch*, atr, bb_*, obv, zscore, adx with dmp and dmn, supertrend with supertrend_direction.

    All windows come first and all recursions in one pass behind them: one exchange and one sort of the bars."""
    df = add(bars, {"sma": ("sma", {"period": length}), "wma": ("wma", {"period": length}), "stoch_k": "stoch_k", "stoch_d": "stoch_d", "obv": "obv"}, axis)
    w = axis.w
    up, down = _high() - F.lag("high").over(w), F.lag("low").over(w) - _low()
    df = df.withColumns(
        {
            "_mv": _close() - F.lag("close").over(w),
            "_tr": true_range(w),
            "_i": F.row_number().over(w),
            "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "_mean": full_frame(F.avg("close"), _close(), w, length),
            "_sd": full_frame(F.stddev_samp("close"), _close(), w, length),
        }
    )
    # Wilder averages from the first value on (adjust=False), shown once ``length`` values are in
    keep, gain, k = (rsi_length - 1) / rsi_length, 1 / rsi_length, F.col("_i")
    raw = {"_g": F.greatest(F.col("_mv"), F.lit(0.0)), "_l": F.greatest(-F.col("_mv"), F.lit(0.0)), "_a": F.col("_tr"), "_u": F.col("_up"), "_d": F.col("_dn")}
    scans = {f"{n}s": (F.when(k == 2, 0.0).when(k > 2, keep), F.when(k == 2, c).when(k > 2, gain * c)) for n, c in raw.items()}
    slow, width = (trend_length - 1) / trend_length, F.col("_tr")
    scans["_ws"] = (F.when(k == 2, 0.0).when(k > 2, slow), F.when(k == 2, width).when(k > 2, width / trend_length))
    spec = INDICATORS["macd"].defaults
    for n, period in {"ema": length, "_fast": spec["fast"], "_slow": spec["slow"]}.items():
        alpha = 2.0 / (period + 1)
        scans[n] = seeded(_close(), period, w, 1 - alpha, alpha)
    then = [_then_ema("macd_signal", ["_fast", "_slow"], np.subtract, spec["signal"]), _library_adx(rsi_length), _library_supertrend(multiplier, trend_length)]
    df = affine_scan(df, scans, keys=axis.keys, order=axis.order, then=then)
    shown = F.col("_i") > rsi_length
    mid, sd = F.col("_mean"), F.col("_sd")
    line = F.col("_fast") - F.col("_slow")
    df = df.withColumns(
        {
            "macd": line,
            "macd_hist": line - F.col("macd_signal"),
            # directional lines over the average range; their index is averaged from where it is first shown
            "dmp": F.when(shown, 100 * F.try_divide(F.col("_us"), F.col("_as"))),
            "dmn": F.when(shown, 100 * F.try_divide(F.col("_ds"), F.col("_as"))),
            "adx": F.when(F.col("_i") >= 2 * rsi_length, F.col("_adx")),
            "rsi": F.when(shown, 100 * F.col("_gs") / (F.col("_gs") + F.col("_ls"))),
            "atr": F.when(shown, F.col("_as")),
            "bb_lower": mid - 2 * sd,
            "bb_mid": mid,
            "bb_upper": mid + 2 * sd,
            "bb_bandwidth": 100 * 4 * sd / mid,
            "bb_percent": F.when(sd > 0, (_close() - (mid - 2 * sd)) / (4 * sd)),
            "zscore": F.when(sd > 0, (_close() - mid) / sd),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])
