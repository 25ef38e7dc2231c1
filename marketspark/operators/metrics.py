"""Statistics of return series, many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.ranks import value_at_rank
from marketspark.operators.series import lookback, series_window, through_now


def compounded(ret: str, w) -> Column:
    """Growth of 1 so far; 0 from a total loss on."""
    upto = through_now(w)
    return F.when(F.min(ret).over(upto) <= -1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(ret) > -1, F.col(ret)))).over(upto)))


def return_metrics(returns: DataFrame, periods: float, *, keys: Sequence[str] = ("symbol",), ret: str = "ret", rf: float = 0.0) -> DataFrame:
    """Annual return and volatility, Sharpe (sample deviation), Sortino, maximum drawdown, Calmar,
    skewness, Pearson kurtosis and lag-1 autocorrelation. NULL returns are left out; undefined is NULL."""
    w = series_window(keys)
    df = returns.where(F.col(ret).isNotNull()).withColumns({"_eq": compounded(ret, w), "_lag": F.lag(ret).over(w)})
    df = df.withColumn("_dd", F.col("_eq") / F.when(F.max("_eq").over(through_now(w)) > 0, F.max("_eq").over(through_now(w))) - 1)
    r = F.col(ret)
    root = math.sqrt(periods)
    agg = df.groupBy(*keys).agg(
        F.count(r).alias("n"),
        F.sum(F.log1p(F.when(r > -1, r))).alias("_lg"),
        F.min(r).alias("_least"),
        F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_s"),
        F.var_pop(r).alias("_vp"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("_dn"),
        F.min("_dd").alias("max_drawdown"),
        F.skewness(r).alias("_sk"),
        F.kurtosis(r).alias("_ku"),
        F.sum(r * F.col("_lag")).alias("_xx"),
        F.sum(F.when(F.col("_lag").isNotNull(), r)).alias("_late"),
        F.sum("_lag").alias("_early"),
    )
    n, m, s = F.col("n"), F.col("_m"), F.col("_s")
    excess = m - rf
    out = agg.withColumns(
        {
            "annual_return": F.when(F.col("_least") <= -1, -1.0).otherwise(F.exp(F.col("_lg") * periods / n) - 1),
            "annual_vol": F.when(n >= 2, s * root),
            "sharpe": F.when((n >= 2) & (s > 0) & (s >= 1e-12 * F.greatest(F.abs(excess), F.lit(1e-15))), excess / s * root),
            "sortino": F.when((n >= 2) & (F.col("_dn") > 0), m / F.col("_dn") * root),
            "skew": F.when((n >= 3) & (F.col("_vp") > 0), F.col("_sk")),
            "kurtosis": F.when((n >= 4) & (F.col("_vp") > 0), F.col("_ku") + 3),
            "autocorr1": F.when(
                (n > 1) & (F.col("_vp") > 0),
                (F.col("_xx") - m * (F.col("_late") + F.col("_early")) + (n - 1) * m * m) / (n * F.col("_vp")),
            ),
        }
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown"))
    return out.withColumn("calmar", calmar).select(
        *keys, "n", "annual_return", "annual_vol", "sharpe", "sortino", "max_drawdown", "calmar", "skew", "kurtosis", "autocorr1"
    )


def liquidity(bars: DataFrame, bars_per_day: float, *, keys: Sequence[str] = ("symbol",), recent: int | None = None, vol_cap: float | None = None) -> DataFrame:
    """``adv_usd`` (mean bar notional × bars per day) and ``daily_vol`` (sample deviation of log returns,
    scaled to a day), over all bars or the ``recent`` last ones."""
    w = series_window(keys)
    past = F.lag("close").over(w)
    df = bars.withColumns({"_lr": F.when((past > 0) & (F.col("close") > 0), F.log(F.col("close") / past)), "_nv": F.col("close") * F.col("volume")})
    if recent is not None:
        df = df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("_back") <= recent)
    out = df.groupBy(*keys).agg((F.avg("_nv") * bars_per_day).alias("adv_usd"), (F.stddev_samp("_lr") * math.sqrt(bars_per_day)).alias("daily_vol"))
    return out if vol_cap is None else out.withColumn("daily_vol", F.least(F.col("daily_vol"), F.lit(vol_cap)))


# Square-root-of-time multipliers of hourly returns.
HORIZONS = {"1h": 1.0, "4h": 2.0, "24h": math.sqrt(24), "7d": math.sqrt(24 * 7), "30d": math.sqrt(24 * 30)}


def value_at_risk(returns: DataFrame, equity: float, horizon: str = "24h", *, keys: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Historical (order statistic, not interpolated), parametric and Cornish–Fisher VaR and the
    expected shortfall, in money over the horizon. Series with fewer than five returns are left out."""
    r, h = F.col(ret), HORIZONS.get(horizon, HORIZONS["24h"])
    valid = returns.where(r.isNotNull())
    n = F.col("n")
    at = F.floor(n * 0.05)
    picks = value_at_rank(valid, keys, ret, {"_v5": at + 1, "_cut": F.greatest(F.lit(1), at)})
    joined = valid.join(picks, list(keys))
    k = F.greatest(F.lit(1), F.floor(F.max("n") * 0.05))
    below = r < F.col("_cut")
    agg = joined.groupBy(*keys).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("std_return"),
        F.skewness(r).alias("_sk"),
        F.kurtosis(r).alias("_ku"),
        F.max("_v5").alias("_v5"),
        ((F.coalesce(F.sum(F.when(below, r)), F.lit(0.0)) + (k - F.count(F.when(below, 1))) * F.max("_cut")) / k).alias("_tail"),
    )
    agg = agg.where(n >= 5)
    # moments with the sample deviation in the denominator
    shrink = (n - 1) / n
    skew = F.when(F.col("std_return") > 0, F.col("_sk") * F.pow(shrink, F.lit(1.5))).otherwise(0.0)
    kurt = F.when(F.col("std_return") > 0, (F.col("_ku") + 3) * shrink * shrink - 3).otherwise(0.0)
    agg = agg.withColumns({"skew": skew, "kurtosis": kurt})

    def cornish_fisher(z: float) -> Column:
        s, k = F.col("skew"), F.col("kurtosis")
        adjusted = z + (z * z - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
        return F.abs((F.col("mean_return") + adjusted * F.col("std_return")) * h)

    z95, z99 = NormalDist().inv_cdf(0.05), NormalDist().inv_cdf(0.01)
    return agg.select(
        *keys,
        "n",
        "mean_return",
        "std_return",
        "skew",
        "kurtosis",
        (F.abs(F.col("_v5") * h) * equity).alias("historical_var_95"),
        (F.abs((F.col("mean_return") + z95 * F.col("std_return")) * h) * equity).alias("parametric_var_95"),
        (cornish_fisher(z95) * equity).alias("var_95"),
        (cornish_fisher(z99) * equity).alias("var_99"),
        (F.abs(F.col("_tail") * h) * equity).alias("cvar_95"),
    )


def hmm_features(bars: DataFrame, window: int = 24, *, keys: Sequence[str] = ("symbol",), funding: str = "funding_rate") -> DataFrame:
    """Log return, population deviation of the last ``window`` log returns, funding; 0 until defined."""
    w = series_window(keys)
    past = F.lag("close").over(w)
    df = bars.withColumns({"log_ret": F.coalesce(F.when((past > 0) & (F.col("close") > 0), F.log(F.col("close") / past)), F.lit(0.0)), "_i": F.row_number().over(w)})
    vol = F.when(F.col("_i") > window, F.stddev_pop("log_ret").over(lookback(w, window))).otherwise(0.0)
    return df.withColumns({"realised_vol": vol, "funding": F.coalesce(F.col(funding), F.lit(0.0)), "ready": F.col("_i") > window}).drop("_i")


def recent_vol(returns: DataFrame, periods: float, last: int = 20, *, keys: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Annualised population deviation of the last returns of each series: the forecast's fallback."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    tail = returns.where(F.col(ret).isNotNull()).withColumn("_b", back).where(F.col("_b") <= last)
    return tail.groupBy(*keys).agg((F.stddev_pop(ret) * math.sqrt(periods)).alias("current_vol"))
