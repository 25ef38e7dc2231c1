"""Feature importance and regimes with Spark ML, and strategy health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.probability import student_cdf
from marketspark.operators.indicators import RECURSIONS, Axis, add, add_recursions
from marketspark.operators.series import lookback, series_window, through_now
from marketspark.session import cut_lineage


#: The indicators that describe an entry bar.
ENTRY_INDICATORS = {
    "rsi": ("rsi", {"period": 14}),
    "ema_20": ("ema", {"period": 20}),
    "ema_50": ("ema", {"period": 50}),
    "atr": ("atr", {"period": 14}),
    "adx": ("adx", {"period": 14}),
    "bbwidth": ("bb_width", {"period": 20, "std": 2.0}),
    "stoch_k": ("stoch_k", {"period": 14, "smooth": 3}),
    "cci": ("cci", {"period": 20}),
    "roc": ("roc", {"period": 12}),
    "supertrend": ("supertrend", {"period": 10, "mult": 3.0}),
    "vol_ratio": ("vol_ratio", {"period": 20}),
    "cmf": ("cmf", {"period": 20}),
    "williams_r": ("williams_r", {"period": 14}),
    "linreg": ("linreg_slope", {"period": 20}),
    "aroon_up": ("aroon_up", {"period": 25}),
    "aroon_down": ("aroon_down", {"period": 25}),
}
#: Rows of a partition of the booster's input.
BOOST_ROWS = 500_000
DERIVED = ("return_1bar", "return_5bar", "relative_vol")


def entry_features(bars: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """The indicators and three derived features of every bar; undefined ones are 0 (relative volume: 1)."""
    w = axis.w
    before = lambda k: F.lag("close", k).over(w)
    usual = F.avg("volume").over(w.rowsBetween(-20, -1))
    derived = {f"return_{k}bar": F.when(before(k) > 0, F.col("close") / before(k) - 1) for k in (1, 5)}
    df = bars.withColumns(derived | {"relative_vol": F.when(usual > 0, F.col("volume") / usual).otherwise(1.0)})
    # recursions last: what a window reads behind them would be exchanged again
    df = add(df, {n: want for n, want in ENTRY_INDICATORS.items() if want[0] not in RECURSIONS}, axis)
    df = add_recursions(df, {n: want for n, want in ENTRY_INDICATORS.items() if want[0] in RECURSIONS}, axis)
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).otherwise(0.0)
    return df.withColumns({c: finite(c) for c in (*ENTRY_INDICATORS, *DERIVED)})


def entries(bars: DataFrame, trades: DataFrame, axis: Axis = Axis(), *, parts: int | None = None) -> DataFrame:
    """The trades that enter at a bar (keys, ``entry_ts``, ``pnl``) with the features of that bar.

    Bars and trades go through one exchange by series (of ``parts`` partitions, if given); the features are made
    behind it and only those of entries are kept, so none of them is shuffled.
    """
    keys, none = list(axis.keys), F.lit(None).cast("double")
    columns = ["open", "high", "low", "close", "volume"]
    bought = trades.select(*keys, F.col("entry_ts").alias("ts"), *[none.alias(c) for c in columns], F.col("pnl").cast("double").alias("pnl"), F.lit(False).alias("_bar"))
    both = bars.select(*keys, "ts", *[F.col(c).cast("double").alias(c) for c in columns], none.alias("pnl"), F.lit(True).alias("_bar")).unionByName(bought)
    both = both.where(" and ".join(f"{k} is not null" for k in keys))
    both = both.repartition(parts, *keys) if parts else both
    here = axis.w.rangeBetween(Window.currentRow, Window.currentRow)
    marked = both.withColumns({"pnl": F.max("pnl").over(here), "entered": F.count(F.when(~F.col("_bar"), 1)).over(here) > 0}).where("_bar").drop("_bar")
    return entry_features(marked, axis).where("entered").withColumnRenamed("ts", "entry_ts").select(*keys, "entry_ts", "pnl", *ENTRY_INDICATORS, *DERIVED)


def feature_importance(trades: DataFrame, features: Sequence[str], *, trees: int = 100, depth: int = 4, least: int = 20, seed: int = 3) -> DataFrame:
    """(feature, importance) of boosted trees that tell winning from losing trades; empty with too few trades."""
    spark = trades.sparkSession
    labelled = trades.select(*[F.col(f).cast("double") for f in features], F.when(F.col("pnl") > 0, 1.0).otherwise(0.0).alias("label")).dropna()
    labelled = cut_lineage(labelled)  # the booster reads its input once per tree level
    spread = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
    if spread["n"] < least or spread["k"] < 2:
        return spark.createDataFrame([], "feature string, importance double")
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(labelled)
    # hundreds of small passes: a task for each partition of the features would cost more than its rows
    most = max(spark.sparkContext.defaultParallelism, -(-spread["n"] // BOOST_ROWS))
    data = data.coalesce(most)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(data)
    weights = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, weights)), "feature string, importance double")


def regimes(features: DataFrame, columns: Sequence[str], vol: str, *, seed: int = 3) -> DataFrame:
    """Calm, volatile or crisis for every row: a three-part Gaussian mixture, parts ordered by the variance of
    ``vol``. Unlike a hidden Markov model it has no transition matrix."""
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(cut_lineage(features.dropna(subset=list(columns))))
    model = GaussianMixture(k=3, seed=seed, maxIter=50).fit(data)
    at = list(columns).index(vol)
    spread = [g.cov.toArray()[at][at] for g in model.gaussians]
    label = {state: name for state, name in zip(sorted(range(3), key=lambda i: spread[i]), ("calm", "volatile", "crisis"))}
    chain = F.lit(None).cast("string")
    for state, name in label.items():
        chain = F.when(F.col("prediction") == state, name).otherwise(chain)
    return model.transform(data).withColumn("regime", chain).drop("features", "probability", "prediction")


def cusum(df: DataFrame, value: str, *, keys: Sequence[str] = ("symbol",), order: str = "ts", mean: Column | None = None, threshold: float = 4.0, drift: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of the normalised values: ``cusum`` and ``alarm`` per row.

    The recursion s = max(0, s + z − d) is a reflected walk: the prefix sum minus its lowest value so far
    (and not above 0), so windows suffice.
    """
    whole = Window.partitionBy(*keys)
    w = series_window(keys, (order,))
    centre = F.avg(value).over(whole) if mean is None else mean
    sd = F.stddev_pop(value).over(whole)
    df = df.withColumns({"_c": centre, "_sd": sd})
    df = df.where("_sd > 0").withColumn("_z", (F.col(value) - F.col("_c")) / F.col("_sd"))
    zero = F.lit(0.0)
    df = df.withColumns({"_p": F.sum(F.col("_z") - drift).over(through_now(w)), "_n": F.sum(-F.col("_z") - drift).over(through_now(w))})
    up = F.col("_p") - F.least(zero, F.min("_p").over(through_now(w)))
    down = F.col("_n") - F.least(zero, F.min("_n").over(through_now(w)))
    df = df.withColumn("cusum", F.greatest(up, down))
    return df.withColumn("alarm", F.col("cusum") > threshold).drop("_c", "_sd", "_z", "_p", "_n")


def segments(df: DataFrame, value: str, *, keys: Sequence[str] = ("symbol",), **options) -> DataFrame:
    """Runs of equal alarm state: (segment, start, end, n, mean, alarm) of each series."""
    flagged = cusum(df, value, keys=keys, **options)
    w = series_window(keys)
    change = F.when(F.lag("alarm").over(w) == F.col("alarm"), 0).otherwise(1)
    flagged = flagged.withColumn("_ch", change)
    flagged = flagged.withColumn("segment", F.sum("_ch").over(through_now(w)))
    return flagged.groupBy(*keys, "segment").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.first("alarm").alias("alarm")
    )


def health_components(trades: DataFrame, *, keys: Sequence[str] = ("symbol",), recent: int = 30, expected_bps: float = 5.0) -> DataFrame:
    """Per strategy, its last ``recent`` trades against the earlier ones: CUSUM, win-rate ratio, pooled one-sided t
    statistics over 10, 20 and 30 trades with degrees of freedom, slippage and its trend."""
    back = Window.partitionBy(*keys).orderBy(F.desc("entry_ts"))
    df = trades.withColumn("_b", F.row_number().over(back))
    late = F.col("_b") <= recent
    base = df.where(~late).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n0"), F.avg("pnl_pct").alias("m0"), F.var_samp("pnl_pct").alias("v0"), F.avg(F.when(F.col("pnl") > 0, 100.0).otherwise(0.0)).alias("base_win_rate")
    )
    tail = df.where(late).join(base, list(keys)).where(F.col("n0") >= 10)
    flagged = cusum(tail.withColumn("ts", F.col("entry_ts")), "pnl_pct", keys=keys, mean=F.col("m0"))
    slip = F.abs(F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100
    aggs = [
        F.max("cusum").alias("cusum"),
        F.count(F.lit(1)).alias("n1"),
        F.avg(F.when(F.col("pnl") > 0, 100.0).otherwise(0.0)).alias("win_rate"),
        F.avg(slip).alias("slippage_bps"),
        F.avg(F.when(F.col("_b") <= 5, slip)).alias("_late_slip"),
        F.avg(F.when(F.col("_b") > F.col("_n1") - 5, slip)).alias("_early_slip"),
        *[F.first(c).alias(c) for c in ("n0", "m0", "v0", "base_win_rate")],
    ]
    for k in (10, 20, 30):
        inside = F.when(F.col("_b") <= k, F.col("pnl_pct"))
        aggs += [F.avg(inside).alias(f"_m{k}"), F.var_samp(inside).alias(f"_v{k}"), F.count(inside).alias(f"_k{k}")]
    agg = flagged.withColumn("_n1", F.count(F.lit(1)).over(Window.partitionBy(*keys))).groupBy(*keys).agg(*aggs).where("n1 >= 10")
    cols = {"ratio": F.when(F.col("base_win_rate") > 0, F.col("win_rate") / F.col("base_win_rate")).otherwise(1.0), "slippage_gap": F.col("slippage_bps") - expected_bps, "slippage_widening": F.col("_late_slip") > 1.5 * F.col("_early_slip")}
    for k in (10, 20, 30):
        n, m, v = F.lit(float(k)), F.col(f"_m{k}"), F.col(f"_v{k}")
        pooled = ((n - 1) * v + (F.col("n0") - 1) * F.col("v0")) / (n + F.col("n0") - 2)
        full = (F.col(f"_k{k}") == k) & (pooled > 0)
        cols[f"t{k}"] = F.when(full, (m - F.col("m0")) / F.sqrt(F.when(full, pooled) * (1 / n + 1 / F.col("n0"))))
    return agg.withColumns(cols).drop(*[c for c in agg.columns if c.startswith("_")])


def alpha_trend(returns: DataFrame, *, keys: Sequence[str] = ("symbol",), window: int = 20, y: str = "ret", x: str = "mkt") -> DataFrame:
    """Alpha and beta to the market, and whether the rolling alpha of the last five windows fell below half of
    the first five."""
    w = series_window(keys)
    frame = lookback(w, window)
    df = returns.withColumns({"_i": F.row_number().over(w), "_a": F.regr_intercept(y, x).over(frame)})
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    i, n = F.col("_i"), F.col("_n")
    # windows end before the current row, so the last complete one ends one row before the end
    agg = df.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.regr_intercept(y, x).alias("alpha"),
        F.regr_slope(y, x).alias("beta"),
        F.regr_r2(y, x).alias("r2"),
        F.avg(F.when((i >= window) & (i < window + 5), F.col("_a"))).alias("_first"),
        F.avg(F.when((i < n) & (i >= n - 5), F.col("_a"))).alias("_last"),
    )
    decaying = (F.col("n") >= 2 * window) & (F.col("_last") < 0.5 * F.col("_first"))
    return agg.where("n >= 20").withColumn("alpha_decaying", F.coalesce(decaying, F.lit(False))).drop("_first", "_last")


def health_score(components: DataFrame, alphas: DataFrame | None = None, *, keys: Sequence[str] = ("symbol",), threshold: float = 4.0, level: float = 0.05) -> DataFrame:
    """0–100 score, grade and action from the components: distribution shift 20, win rate 25, decay test 25, alpha 20,
    execution 10."""
    c = F.col("cusum")
    half = threshold / 2
    shift = F.when(c < half, 20.0).when(c < threshold, 20 * (1 - (c - half) / half)).otherwise(0.0)
    df = components
    for k in (10, 20, 30):
        df = df.withColumn(f"_p{k}", student_cdf(F.col(f"t{k}"), F.col("n0") + k - 2))
    significant = sum((F.when(F.col(f"_p{k}") < level, 1).otherwise(0) for k in (10, 20, 30)), F.lit(0))
    least = F.least(*[F.col(f"_p{k}") for k in (10, 20, 30)])
    decay = F.when(significant == 0, 25.0).when(significant < 2, 15.0).otherwise(F.greatest(F.lit(0.0), least * 25))
    gap = F.col("slippage_gap")
    execution = F.when(gap < 2, 10.0).when(gap < 20, 10 * (1 - (gap - 2) / 18)).otherwise(0.0)
    if alphas is not None:
        df = df.join(alphas.select(*keys, "alpha", "alpha_decaying"), list(keys), "left")
        good, worse = F.col("alpha") > 0, F.col("alpha_decaying")
        alpha = F.when(F.col("alpha").isNull(), 20.0).when(good & ~worse, 20.0).when(good, 10.0).when(~worse, 5.0).otherwise(0.0)
    else:
        alpha = F.lit(20.0)
    df = df.withColumns({"p_value": F.coalesce(least, F.lit(1.0)), "windows_significant": significant, "_pts": shift + F.least(F.lit(25.0), F.col("ratio") * 25) + decay + alpha + execution})
    df = df.withColumn("score", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_pts")))).cast("int"))
    s = F.col("score")
    grade = F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").when(s >= 20, "D").otherwise("F")
    action = F.when(s >= 70, "continue").when(s >= 50, "reduce_size").when(s >= 25, "pause").otherwise("stop")
    return df.withColumns({"grade": grade, "action": action}).drop("_p10", "_p20", "_p30", "_pts")
