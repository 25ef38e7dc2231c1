"""The wide state panel the signals read: indicators, price history features and market context per bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import HOUR_MS
from marketspark.operators.indicators import Axis, add, true_range
from marketspark.operators.series import affine_scan, full_frame, lookback, through_now


def _close() -> Column:
    return F.col("close")


def _running_ema(df: DataFrame, ax: Axis, periods: dict[str, int]) -> DataFrame:
    """EMA from the first close on; the last close while there are fewer than ``period`` bars."""
    i = F.col("_i")
    df = df.withColumn("_i", F.row_number().over(ax.w))
    scans = {}
    for out, p in periods.items():
        alpha = 2 / (p + 1)
        scans[out] = (F.when(i == 1, 0.0).otherwise(1 - alpha), F.when(i == 1, _close()).otherwise(alpha * _close()))
    df = affine_scan(df, scans, keys=ax.keys, order=ax.order)
    return df.withColumns({o: F.when(i < p, _close()).otherwise(F.col(o)) for o, p in periods.items()}).drop("_i")


def _mean_range(ax: Axis, period: int) -> Column:
    """Mean true range of the last bars (the bar's own range while there are too few)."""
    n = F.count("_tr").over(lookback(ax.w, period))
    return F.when(n >= period, F.avg("_tr").over(lookback(ax.w, period))).otherwise(F.col("high") - F.col("low"))


def price_state(bars: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """RSI, EMAs, ATR, Bollinger, Keltner, CVD of the last 10 bars, relative volume."""
    ax, w = axis, axis.w
    df = add(bars, {"rsi": "rsi_simple", "relative_volume": "relative_volume"}, ax)
    df = _running_ema(df, ax, {"ema_fast": 20, "ema_slow": 50})
    delta = F.signum(_close() - F.col("open")) * F.col("volume")
    df = df.withColumns({"_tr": true_range(w), "volume_delta": delta})
    n20 = F.count("close").over(lookback(w, 20)) == 20
    mean, sd = F.avg("close").over(lookback(w, 20)), F.stddev_pop("close").over(lookback(w, 20))
    df = df.withColumns(
        {
            "atr": _mean_range(ax, 14),
            "_a20": _mean_range(ax, 20),
            "bb_upper": F.when(n20, mean + 2 * sd).otherwise(_close()),
            "bb_lower": F.when(n20, mean - 2 * sd).otherwise(_close()),
            "cvd": F.sum("volume_delta").over(lookback(w, 10)),
            "price": _close(),
        }
    )
    return df.withColumns(
        {
            "atr": F.when(F.col("atr") > 0, F.col("atr")).otherwise(_close() * 0.01),
            "kelt_upper": F.col("ema_fast") + 1.5 * F.col("_a20"),
            "kelt_lower": F.col("ema_fast") - 1.5 * F.col("_a20"),
            "ema_trend": F.col("ema_slow"),
        }
    ).drop("_tr", "_a20")


def history_features(df: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """Lagged prices and the statistics of the last returns: R/S Hurst exponent and kurtosis over 20
    prices, lag-1 autocorrelation over 15, volume-weighted RSI over 15. NULL with too little history."""
    w = axis.w
    before = F.lag("close").over(w)
    df = df.withColumns({"_r": F.when(before != 0, (_close() - before) / before), "_d": F.col("close") - before})
    lags = {f"p{k}": F.lag("close", k).over(w) for k in (2, 4, 9)}
    df = df.withColumns(lags)
    df = df.withColumns({f"momentum{k}": F.when(F.col(f"p{k}") != 0, (_close() - F.col(f"p{k}")) / F.col(f"p{k}")) for k in (2, 4, 9)})
    full20 = F.count("close").over(lookback(w, 20)) == 20
    full15 = F.count("close").over(lookback(w, 15)) == 15
    df = df.withColumns(
        {
            "_l19": F.when(full20, F.collect_list("_r").over(lookback(w, 19))),
            "_l14": F.when(full15, F.collect_list("_r").over(lookback(w, 14))),
            "_mv": F.avg("volume").over(lookback(w, 15)),
            "_sv": F.sum("volume").over(lookback(w, 15)),
        }
    )
    weighted = F.col("_r") * F.col("volume")
    df = df.withColumns(
        {
            "_up": F.sum(F.when(F.col("_r") > 0, weighted).otherwise(0.0)).over(lookback(w, 14)),
            "_down": F.sum(F.when(F.col("_r") <= 0, -weighted).otherwise(0.0)).over(lookback(w, 14)),
        }
    )

    def mean(a: str) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)

    def moment(a: str, m: str, power: int) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.pow(x - F.col(m), F.lit(power))) / F.size(a)

    def enough(a: str) -> Column:
        return F.size(a) >= 10

    df = df.withColumns({"_m19": F.when(enough("_l19"), mean("_l19")), "_m14": F.when(enough("_l14"), mean("_l14"))})
    df = df.withColumns({"_v19": F.when(enough("_l19"), moment("_l19", "_m19", 2)), "_v14": F.when(enough("_l14"), moment("_l14", "_m14", 2))})
    zero = F.lit(0.0)
    # running deviation with its lowest and highest point, both over the points after the first step
    walk = F.aggregate(
        "_l19",
        F.struct(zero.alias("s"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi")),
        lambda acc, x: F.struct(
            (acc["s"] + (x - F.col("_m19"))).alias("s"),
            F.least(acc["lo"], acc["s"] + (x - F.col("_m19"))).alias("lo"),
            F.greatest(acc["hi"], acc["s"] + (x - F.col("_m19"))).alias("hi"),
        ),
    )
    df = df.withColumn("_walk", F.when(F.col("_v19") > 0, walk))
    rs = (F.col("_walk.hi") - F.col("_walk.lo")) / F.sqrt("_v19")
    df = df.withColumn("_rs", F.when(F.col("_v19") > 0, rs))
    pairs = F.zip_with(F.slice("_l14", 1, F.size("_l14") - 1), F.slice("_l14", 2, F.size("_l14") - 1), lambda a, b: (a - F.col("_m14")) * (b - F.col("_m14")))
    cov = F.aggregate(pairs, zero, lambda acc, x: acc + x) / (F.size("_l14") - 1)
    df = df.withColumns(
        {
            "hurst": F.when(F.col("_rs") > 0, F.greatest(zero, F.least(F.lit(1.0), F.log("_rs") / F.log(F.size("_l19"))))),
            "kurt": F.when(F.col("_v19") > 0, moment("_l19", "_m19", 4) / (F.col("_v19") * F.col("_v19")) - 3),
            "autocorr": F.when(F.col("_v14") > 0, cov / F.col("_v14")),
            "vwrsi": F.when(full15, F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def clock_features(df: DataFrame, axis: Axis = Axis(), ts: str = "ts") -> DataFrame:
    """Hour of day, minutes to the next hour and age since the first bar, all from event time."""
    minute = F.floor(F.pmod(F.col(ts), F.lit(HOUR_MS)) / 60_000)
    first = F.min(ts).over(through_now(axis.w))
    return df.withColumns(
        {
            "hour": F.pmod(F.floor(F.col(ts) / HOUR_MS), F.lit(24)).cast("int"),
            "minutes_to_hour": (60 - minute).cast("double"),
            "listing_age_h": (F.col(ts) - first) / HOUR_MS,
        }
    )


def cross_section(state: DataFrame, leader: str, ts: str = "ts") -> DataFrame:
    """Add market breadth and the leader's momentum at the same time; one row per symbol and time, so
    a group is as large as the universe."""
    now = Window.partitionBy(ts)
    share = {"breadth_ob": F.col("rsi") > 70, "breadth_os": F.col("rsi") < 30}
    cols = {n: F.avg(F.when(c, 100.0).otherwise(0.0)).over(now) for n, c in share.items()}
    is_leader = F.col("symbol") == leader
    cols |= {"rsi_market": F.avg("rsi").over(now), "leader_momentum": F.max(F.when(is_leader, F.col("momentum2"))).over(now), "is_leader": is_leader}
    return state.withColumns(cols)
