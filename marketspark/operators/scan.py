"""Market scan over a bias and an entry timeframe, and back-fill of signal outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.signals import aggregate_signals
from marketspark.operators.series import series_window

# Fixed values of the scan.
MIN_CATEGORIES = 3
FUNDING_VETO = 2e-4
MIN_DAY_VOLUME = 1e6
MIN_HIT_RATE = 0.45
BIAS_SHARE, ENTRY_SHARE = 0.6, 0.4
PULLBACK_SCORE = 0.3
STOP_ATR, TARGET_STOPS = 2.0, 2.0


def scan(
    bias: DataFrame,
    entry: DataFrame,
    *,
    min_score: float = 0.15,
    min_signals: int = 2,
    min_categories: int = MIN_CATEGORIES,
    min_volume: float = MIN_DAY_VOLUME,
    edges: DataFrame | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Opportunities from two state panels of the same symbols (one row per symbol each).

    ``bias`` also carries day_volume and optionally hit_rate and kelly_risk. A weak opposite signal on
    the entry timeframe counts as a pullback, a strong one drops the symbol. ``edges``: (symbol,
    months_positive) of symbols with a validated strategy; the others are marked down.
    """
    for column in ("hit_rate", "kelly_risk"):
        if column not in bias.columns:
            bias = bias.withColumn(column, F.lit(None).cast("double"))
    names = None if names is None else list(names)
    b = aggregate_signals(bias, names)
    keep = (F.col("score") >= min_score) & (F.col("num_signals") >= min_signals) & (F.size("agreeing_categories") >= min_categories) & (F.col("day_volume") >= min_volume)
    fights = ((F.col("direction") == "LONG") & (F.col("funding_rate") > FUNDING_VETO)) | ((F.col("direction") == "SHORT") & (F.col("funding_rate") < -FUNDING_VETO))
    b = b.where(keep & ~F.coalesce(fights, F.lit(False)) & (F.coalesce("hit_rate", F.lit(1.0)) >= MIN_HIT_RATE))
    e = aggregate_signals(entry, names).select("symbol", F.col("direction").alias("_ed"), F.col("score").alias("_es"))
    atr = entry.select("symbol", F.col("atr").alias("_atr"))
    df = b.join(e, "symbol", "left").join(atr, "symbol", "left")
    same, opposed = F.col("_ed") == F.col("direction"), F.col("_ed") != F.col("direction")
    weak = F.col("_es") < 0.5 * F.col("score")
    df = df.where(~F.coalesce(opposed & ~weak, F.lit(False)))
    entry_score = F.when(same, F.col("_es")).when(opposed, PULLBACK_SCORE).otherwise(0.0)
    combined = BIAS_SHARE * F.col("score") + ENTRY_SHARE * entry_score
    combined = F.when(F.col("hit_rate") > 0.6, F.least(F.lit(1.0), combined + 0.10)).otherwise(combined)
    df = df.withColumn("_c", combined)
    if edges is not None:
        df = df.join(edges.select("symbol", F.col("months_positive").alias("_edge")), "symbol", "left")
        boosted = F.least(F.lit(1.0), F.col("_c") + F.least(F.lit(0.15), F.col("_edge") / 100 * 0.15))
        df = df.withColumn("_c", F.when(F.col("_edge").isNotNull(), boosted).otherwise(F.col("_c") * 0.7)).drop("_edge")
    else:
        df = df.withColumn("_c", F.col("_c") * 0.7)
    price, way = F.col("price"), F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    stop = F.when(F.col("_atr") > 0, F.col("_atr")).otherwise(price * 0.01) * STOP_ATR
    cats = F.size("agreeing_categories")
    tier = F.when((cats >= 5) & (F.col("hit_rate") > 0.6), "high").when(cats >= 4, "medium").otherwise("low")
    df = df.withColumns({"combined_score": F.col("_c"), "tier": tier, "stop_price": price - way * stop, "target_price": price + way * stop * TARGET_STOPS})
    lever = F.when((F.col("tier") == "high") & (F.col("_c") >= 0.5), 3).when((F.col("tier") == "medium") & (F.col("_c") >= 0.35), 2).otherwise(1)
    size = F.greatest(F.lit(0.005), F.least(F.lit(0.05), F.coalesce("kelly_risk", F.lit(0.02)) * (0.5 + F.col("confluence"))))
    return df.withColumns({"leverage": lever, "size_pct": size}).drop("_c", "_ed", "_es", "_atr").orderBy(F.desc("combined_score"), "symbol")


def backfill(state: DataFrame, hold: int, step: int, *, warm: int = 50, names: Sequence[str] | None = None, min_signals: int = 2) -> DataFrame:
    """Signal outcomes over history: every ``step`` bars after the warm-up, the direction and the move after
    ``hold`` bars, as outcome rows."""
    w = series_window()
    df = state.withColumns({"_i": F.row_number().over(w) - 1, "_later": F.lead("close", hold).over(w)})
    sampled = df.where((F.col("_i") >= warm) & (F.pmod(F.col("_i") - warm, F.lit(step)) == 0) & F.col("_later").isNotNull() & (F.col("close") > 0))
    opp = aggregate_signals(sampled, None if names is None else list(names)).where(F.col("num_signals") >= min_signals)
    move = (F.col("_later") - F.col("close")) / F.col("close") * 100
    pnl = F.when(F.col("direction") == "LONG", move).otherwise(-move)
    return opp.select("symbol", "ts", F.lower("direction").alias("direction"), F.col("names").alias("signals"), pnl.alias("pnl_pct"), F.when(pnl > 0, "win").otherwise("loss").alias("result"))
