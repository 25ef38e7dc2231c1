"""Market signals as tables of rules over a wide state row.

A signal is a list of ``(condition, score, confidence)`` in SQL text; the first condition that holds
decides. Score runs from −1 (short) to +1 (long); a signal without opinion scores 0. Missing state
is NULL and satisfies no condition. Nothing here is evaluated row by row in Python: the rules
become one ``CASE`` column each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    name: str
    category: str
    rules: tuple[tuple[str, str, str], ...]
    weight: float = 1.0
    about: str = ""


SIGNALS: dict[str, Signal] = {}


def signal(name: str, category: str, *rules: tuple[str, str, str], weight: float = 1.0, about: str = "") -> Signal:
    """Register a signal; users add their own the same way."""
    SIGNALS[name] = Signal(name, category, tuple((c, str(s), str(k)) for c, s, k in rules), weight, about)
    return SIGNALS[name]


# ── fixed values: thresholds, scores and confidences of the built-in signals ───────────────

signal(
    "hurst_exponent",
    "computed",
    ("hurst > 0.6 AND price > p4", "0.4", "0.5"),
    ("hurst > 0.6", "-0.4", "0.5"),
    ("hurst < 0.4 AND price > p4", "-0.3", "0.4"),
    ("hurst < 0.4", "0.3", "0.4"),
    about="Trend persistence: follow the move when trending, fade it when reverting",
)
signal(
    "return_autocorrelation",
    "computed",
    ("autocorr > 0.3 AND price > p2", "0.4", "0.4"),
    ("autocorr > 0.3", "-0.4", "0.4"),
    ("autocorr < -0.3 AND price > p2", "-0.3", "0.4"),
    ("autocorr < -0.3", "0.3", "0.4"),
    about="Serial correlation of returns",
)
signal("return_kurtosis", "computed", ("kurt > 3", "0", "0.2"), ("kurt > 1", "0", "0.1"), about="Fat tails (no direction)")
signal(
    "oi_acceleration",
    "computed",
    ("oi_roc > 10 AND price > p2", "0.5", "0.5"),
    ("oi_roc > 10 AND price < p2", "-0.5", "0.5"),
    ("oi_roc < -10 AND p2 IS NOT NULL", "0", "0.3"),
    about="Rapid change of open interest with the price move",
)
signal(
    "cvd_momentum",
    "computed",
    ("cvd > 0 AND volume_delta > 0", "0.4", "0.4"),
    ("cvd > 0 AND volume_delta < 0", "-0.2", "0.3"),
    ("cvd < 0 AND volume_delta < 0", "-0.4", "0.4"),
    ("cvd < 0 AND volume_delta > 0", "0.2", "0.3"),
    about="Is cumulative buying sustained or fading",
)
signal(
    "price_oracle_gap",
    "computed",
    ("price <> 0 AND oracle_price <> 0 AND (price - oracle_price) / nullif(oracle_price, 0) > 0.005", "-least(0.6, (price - oracle_price) / nullif(oracle_price, 0) / 0.01)", "0.5"),
    ("price <> 0 AND oracle_price <> 0 AND (price - oracle_price) / nullif(oracle_price, 0) < -0.005", "least(0.6, abs(price - oracle_price) / nullif(oracle_price, 0) / 0.01)", "0.5"),
    about="Contract price against the oracle",
)
signal(
    "predicted_actual_divergence",
    "computed",
    ("predicted_funding > 1e-5 AND funding_rate < -1e-5", "-0.4", "0.5"),
    ("predicted_funding < -1e-5 AND funding_rate > 1e-5", "0.4", "0.5"),
    ("abs(predicted_funding) > 3 * abs(funding_rate) AND predicted_funding > 1e-5", "-0.3", "0.4"),
    ("abs(predicted_funding) > 3 * abs(funding_rate) AND predicted_funding < -1e-5", "0.3", "0.4"),
    about="Predicted funding flips or runs ahead of the actual rate",
)
signal(
    "volume_weighted_rsi",
    "computed",
    ("vwrsi < 25", "least(0.6, (30 - vwrsi) / 30)", "0.5"),
    ("vwrsi > 75", "-least(0.6, (vwrsi - 70) / 30)", "0.5"),
    about="RSI with moves weighted by volume",
)
signal(
    "market_breadth",
    "cross_pair",
    ("breadth_ob > 60", "-least(0.7, (breadth_ob - 50) / 50)", "0.5"),
    ("breadth_os > 60", "least(0.7, (breadth_os - 50) / 50)", "0.5"),
    ("breadth_ob > 40", "-0.2", "0.3"),
    ("breadth_os > 40", "0.2", "0.3"),
    about="Share of the market overbought or oversold",
)
signal(
    "avg_rsi_deviation",
    "cross_pair",
    ("rsi <> 0 AND rsi_market <> 0 AND rsi - rsi_market > 15", "0.5", "0.4"),
    ("rsi <> 0 AND rsi_market <> 0 AND rsi - rsi_market < -15", "-0.5", "0.4"),
    about="Relative strength against the market's mean RSI",
)
signal(
    "btc_lead_lag",
    "cross_pair",
    ("NOT is_leader AND p4 IS NOT NULL AND leader_momentum > 0.01 AND leader_momentum - momentum2 > 0.005", "least(0.6, (leader_momentum - momentum2) * 20)", "0.5"),
    ("NOT is_leader AND p4 IS NOT NULL AND leader_momentum < -0.01 AND leader_momentum - momentum2 < -0.005", "greatest(-0.6, (leader_momentum - momentum2) * 20)", "0.5"),
    about="The leader moved and this symbol has not followed yet",
)
signal(
    "correlation_breakdown",
    "cross_pair",
    ("rsi <> 0 AND rsi_market <> 0 AND rsi - rsi_market > 25", "-least(0.5, (rsi - rsi_market - 20) / 40)", "0.4"),
    ("rsi <> 0 AND rsi_market <> 0 AND rsi - rsi_market < -25", "least(0.5, (abs(rsi - rsi_market) - 20) / 40)", "0.4"),
    about="Convergence after a strong departure from the market",
)
signal(
    "funding_extreme",
    "funding",
    ("predicted_funding > 3e-5", "-least(1.0, predicted_funding / 1e-4)", "0.7"),
    ("predicted_funding < -3e-5", "least(1.0, abs(predicted_funding) / 1e-4)", "0.7"),
    ("predicted_funding > 1.5e-5", "-0.3", "0.4"),
    ("predicted_funding < -1.5e-5", "0.3", "0.4"),
    about="Extreme predicted funding: one side is crowded",
)
signal(
    "funding_divergence",
    "funding",
    ("funding_divergence > 5e-4", "-least(1.0, funding_divergence / 2e-3)", "0.5"),
    ("funding_divergence < -5e-4", "least(1.0, abs(funding_divergence) / 2e-3)", "0.5"),
    ("funding_divergence > 2e-4", "-0.2", "0.3"),
    ("funding_divergence <= -2e-4", "0.2", "0.3"),
    about="Funding against the mean of other venues",
)
signal(
    "funding_zscore",
    "funding",
    ("funding_zscore > 2", "-least(1.0, funding_zscore / 4)", "0.6"),
    ("funding_zscore < -2", "least(1.0, abs(funding_zscore) / 4)", "0.6"),
    ("funding_zscore > 1", "-0.2", "0.3"),
    ("funding_zscore = 1 OR funding_zscore <= -1", "0.2", "0.3"),
    about="Funding against its last week",
)
signal(
    "ls_ratio_extreme",
    "hyperstats",
    ("ls_ratio <> 0 AND ls_ratio / nullif(1 + ls_ratio, 0) * 100 > 75", "-least(0.6, (ls_ratio / nullif(1 + ls_ratio, 0) * 100 - 65) / 50)", "0.5"),
    ("ls_ratio <> 0 AND ls_ratio / nullif(1 + ls_ratio, 0) * 100 < 25", "least(0.6, (65 - ls_ratio / nullif(1 + ls_ratio, 0) * 100) / 50)", "0.5"),
    about="Share of traders that are long",
)
signal("leverage_extreme", "hyperstats", ("avg_leverage > 10", "0", "0.2"), ("avg_leverage > 7", "0", "0.1"), about="Average leverage (no direction)")
signal("unrealized_pnl", "hyperstats", ("unrealized > 0", "-0.3", "0.4"), ("unrealized < 0", "0.3", "0.4"), about="Aggregate open profit")
signal(
    "oi_divergence",
    "microstructure",
    ("oi_roc > 5 AND momentum4 > 0.01", "0.5", "0.5"),
    ("oi_roc > 5 AND momentum4 < -0.01", "-0.6", "0.6"),
    ("oi_roc < -5 AND momentum4 > 0.01", "0.3", "0.4"),
    ("oi_roc < -5 AND momentum4 < -0.01", "-0.4", "0.5"),
    about="Direction of open interest against direction of price",
)
signal(
    "volume_imbalance",
    "microstructure",
    ("cvd > 0", "least(0.6, 0.3 * least(1.5, greatest(0.5, relative_volume)))", "0.4"),
    ("cvd < 0", "-least(0.6, 0.3 * least(1.5, greatest(0.5, relative_volume)))", "0.4"),
    about="Buyers or sellers dominate, scaled by relative volume",
)
signal(
    "volume_surge",
    "microstructure",
    ("relative_volume > 3 AND price > p2", "0.7", "0.7"),
    ("relative_volume > 3 AND p2 IS NOT NULL", "-0.7", "0.7"),
    ("relative_volume > 2 AND price > p2", "0.5", "0.5"),
    ("relative_volume > 2 AND p2 IS NOT NULL", "-0.5", "0.5"),
    ("relative_volume >= 1.5 AND price > p2", "0.2", "0.3"),
    ("relative_volume >= 1.5 AND p2 IS NOT NULL", "-0.2", "0.3"),
    about="Abnormal volume in the direction of the move",
)
signal("oi_zscore", "microstructure", ("oi_zscore > 2", "-least(0.7, oi_zscore / 4)", "0.5"), ("oi_zscore < -2", "least(0.7, abs(oi_zscore) / 4)", "0.5"), about="Extreme open interest, contrarian")
signal("net_positioning", "microstructure", ("net_delta > 0", "-least(0.5, net_delta / 1000)", "0.4"), ("net_delta < 0", "least(0.5, abs(net_delta) / 1000)", "0.4"), about="Net positioning, contrarian")
signal(
    "liquidation_proximity",
    "microstructure",
    ("oi_zscore > 1.5 AND funding_rate > 1e-5 AND premium > 0.001", "0.5", "0.5"),
    ("oi_zscore > 1.5 AND funding_rate < -1e-5 AND premium < -0.001", "-0.5", "0.5"),
    about="Crowded side near liquidation",
)
signal(
    "whale_activity",
    "microstructure",
    ("relative_volume > 3 AND volume_delta > 0", "0.6", "0.6"),
    ("relative_volume > 3 AND volume_delta < 0", "-0.6", "0.6"),
    ("relative_volume >= 2.5 AND volume_delta > 0", "0.3", "0.4"),
    ("relative_volume >= 2.5 AND volume_delta < 0", "-0.3", "0.4"),
    about="Large one-sided volume",
)
signal(
    "orderbook_imbalance",
    "microstructure",
    ("bids_depth + asks_depth > 0 AND bids_depth / nullif(bids_depth + asks_depth, 0) > 0.65", "least(0.5, (bids_depth / nullif(bids_depth + asks_depth, 0) - 0.5) * 2)", "0.5"),
    ("bids_depth + asks_depth > 0 AND bids_depth / nullif(bids_depth + asks_depth, 0) < 0.35", "-least(0.5, (0.5 - bids_depth / nullif(bids_depth + asks_depth, 0)) * 2)", "0.5"),
    about="Depth on one side of the book",
)
signal(
    "rsi_extreme",
    "momentum",
    ("rsi <> 0 AND rsi < 25", "least(1.0, (25 - rsi) / 25)", "0.6"),
    ("rsi <> 0 AND rsi < 30", "0.4", "0.4"),
    ("rsi > 75", "-least(1.0, (rsi - 75) / 25)", "0.6"),
    ("rsi > 70", "-0.4", "0.4"),
    about="RSI extremes",
)
signal(
    "ema_trend",
    "momentum",
    ("ema_trend <> 0 AND price <> 0 AND (price - ema_trend) / nullif(ema_trend, 0) > 0.05", "0.6", "0.5"),
    ("ema_trend <> 0 AND price <> 0 AND (price - ema_trend) / nullif(ema_trend, 0) > 0.01", "0.3", "0.4"),
    ("ema_trend <> 0 AND price <> 0 AND (price - ema_trend) / nullif(ema_trend, 0) < -0.05", "-0.6", "0.5"),
    ("ema_trend <> 0 AND price <> 0 AND (price - ema_trend) / nullif(ema_trend, 0) < -0.01", "-0.3", "0.4"),
    about="Price against its trend average",
)
signal(
    "price_momentum",
    "momentum",
    ("momentum9 > 0.05", "0.7", "0.5"),
    ("momentum9 > 0.02", "0.4", "0.4"),
    ("momentum9 < -0.05", "-0.7", "0.5"),
    ("momentum9 < -0.02", "-0.4", "0.4"),
    about="Ten-bar return",
)
_TAPE = "(tape_imbalance + 2 * CASE WHEN tape_large_buy + tape_large_sell > 0 THEN (tape_large_buy - tape_large_sell) / nullif(tape_large_buy + tape_large_sell, 0) ELSE 0 END) / 3"
_SPEED = "least(1.5, greatest(0.5, tape_speed / 100))"
signal(
    "trade_tape_imbalance",
    "realtime",
    (f"tape_volume > 0 AND abs({_TAPE}) > 0.3", f"round(greatest(-0.8, least(0.8, {_TAPE} * 0.6 * {_SPEED})), 3)", f"round(least(0.7, abs({_TAPE}) * {_SPEED}), 2)"),
    about="Tape imbalance, large trades counted double, amplified by tape speed",
)
signal(
    "spoofing_detection",
    "realtime",
    ("phantom_bid > 0.3 AND phantom_ask < 0.15", "round(-least(0.6, phantom_bid * 1.5), 3)", "0.5"),
    ("phantom_ask > 0.3 AND phantom_bid < 0.15", "round(least(0.6, phantom_ask * 1.5), 3)", "0.5"),
    ("phantom_bid > 0.25 AND phantom_ask > 0.25", "0", "0.2"),
    about="Depth that vanishes unfilled on one side",
)
signal(
    "vault_smart_money",
    "realtime",
    ("vault_total > 0 AND vault_long / nullif(vault_total, 0) > 0.6 AND vault_long >= 3 AND vault_change > 5", "round(least(0.8, least(0.7, vault_long / nullif(vault_total, 0) * 0.8) + 0.15), 3)", "0.6"),
    ("vault_total > 0 AND vault_long / nullif(vault_total, 0) > 0.6 AND vault_long >= 3", "round(least(0.7, vault_long / nullif(vault_total, 0) * 0.8), 3)", "0.6"),
    ("vault_total > 0 AND vault_long / nullif(vault_total, 0) < 0.4 AND vault_short >= 3 AND vault_change < -5", "round(greatest(-0.8, -least(0.7, (1 - vault_long / nullif(vault_total, 0)) * 0.8) - 0.15), 3)", "0.6"),
    ("vault_total > 0 AND vault_long / nullif(vault_total, 0) < 0.4 AND vault_short >= 3", "round(-least(0.7, (1 - vault_long / nullif(vault_total, 0)) * 0.8), 3)", "0.6"),
    ("vault_total > 0 AND vault_long > 0 AND vault_short > 0", "0", "0.1"),
    about="Consensus of the largest vaults",
)
signal(
    "funding_settlement_window",
    "seasonality",
    ("minutes_to_hour <= 15 AND funding_rate > 1e-5", "-0.3", "0.4"),
    ("minutes_to_hour <= 15 AND funding_rate < -1e-5", "0.3", "0.4"),
    ("minutes_to_hour > 15 AND minutes_to_hour <= 30 AND funding_rate > 2e-5", "-0.15", "0.2"),
    ("minutes_to_hour > 15 AND minutes_to_hour <= 30 AND funding_rate < -2e-5", "0.15", "0.2"),
    about="Drift before settlement; time is that of the event",
)
signal(
    "session_transition",
    "seasonality",
    ("p4 IS NOT NULL AND hour IN (13, 14) AND price > p2", "0.3", "0.4"),
    ("p4 IS NOT NULL AND hour IN (13, 14) AND price < p2", "-0.3", "0.4"),
    ("p4 IS NOT NULL AND hour IN (7, 8) AND price > p2", "0.2", "0.3"),
    ("p4 IS NOT NULL AND hour IN (7, 8) AND price < p2", "-0.2", "0.3"),
    ("p4 IS NOT NULL AND hour IN (0, 1) AND price > p2", "-0.15", "0.2"),
    ("p4 IS NOT NULL AND hour IN (0, 1) AND price < p2", "0.15", "0.2"),
    about="Session openings: US and Europe follow the move, Asia fades it",
)
signal(
    "new_listing_spike",
    "seasonality",
    ("listing_age_h <= 24 AND funding_rate > 1e-4", "-0.7", "0.6"),
    ("listing_age_h <= 24 AND funding_rate < -1e-4", "0.7", "0.6"),
    ("listing_age_h <= 24 AND relative_volume > 5", "0", "0.1"),
    ("listing_age_h > 24 AND listing_age_h <= 72 AND funding_rate > 5e-5", "-0.4", "0.4"),
    ("listing_age_h > 24 AND listing_age_h <= 72 AND funding_rate < -5e-5", "0.4", "0.4"),
    about="Crowded funding in the first days of a listing",
)
signal(
    "vol_mean_reversion",
    "volatility",
    ("bb_upper > bb_lower AND price <> 0 AND (price - bb_lower) / nullif(bb_upper - bb_lower, 0) > 0.9", "-0.5", "0.4"),
    ("bb_upper > bb_lower AND price <> 0 AND (price - bb_lower) / nullif(bb_upper - bb_lower, 0) < 0.1", "0.5", "0.4"),
    about="Price at the edge of the Bollinger band",
)
signal(
    "squeeze_detection",
    "volatility",
    ("bb_upper < kelt_upper AND bb_lower > kelt_lower AND ema_trend > 0 AND price > ema_trend", "0.4", "0.5"),
    ("bb_upper < kelt_upper AND bb_lower > kelt_lower AND ema_trend > 0", "-0.4", "0.5"),
    ("bb_upper < kelt_upper AND bb_lower > kelt_lower", "0.1", "0.3"),
    about="Bollinger band inside the Keltner channel",
)
signal(
    "premium_extreme",
    "volatility",
    ("premium > 0.003", "-least(0.8, premium / 0.005)", "0.6"),
    ("premium < -0.003", "least(0.8, abs(premium) / 0.005)", "0.6"),
    ("premium > 0.001", "-0.2", "0.3"),
    ("premium <= -0.001 OR premium = 0.001", "0.2", "0.3"),
    about="Mark price against the oracle",
)

# Fixed value: every state column the built-in signals read.
STATE_COLUMNS = (
    "price p2 p4 momentum2 momentum4 momentum9 hurst autocorr kurt vwrsi rsi rsi_market ema_trend bb_upper bb_lower kelt_upper kelt_lower "
    "cvd volume_delta relative_volume funding_rate predicted_funding premium oracle_price funding_divergence funding_zscore oi_roc oi_zscore "
    "net_delta bids_depth asks_depth breadth_ob breadth_os leader_momentum tape_imbalance tape_large_buy tape_large_sell tape_speed tape_volume "
    "phantom_bid phantom_ask vault_long vault_short vault_total vault_change ls_ratio avg_leverage unrealized minutes_to_hour hour listing_age_h"
).split()


def rule_case(s: Signal, part: int) -> str:
    """SQL ``CASE`` for the score (1) or the confidence (2) of a signal; 0 where no rule holds."""
    whens = " ".join(f"WHEN {r[0]} THEN CAST({r[part]} AS DOUBLE)" for r in s.rules)
    return f"CASE {whens} ELSE CAST(0 AS DOUBLE) END"


def with_state_columns(state: DataFrame) -> DataFrame:
    """Add absent state columns as NULL, so that signals over missing sources stay silent."""
    missing = {c: F.lit(None).cast("double") for c in STATE_COLUMNS if c not in state.columns}
    if "is_leader" not in state.columns:
        missing["is_leader"] = F.lit(False)
    return state.withColumns(missing) if missing else state


def score_columns(state: DataFrame, names: list[str]) -> DataFrame:
    """One ``<name>`` score and one ``<name>_conf`` column per signal."""
    ready = with_state_columns(state)
    unknown = set(names) - set(SIGNALS)
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(sorted(unknown))}")
    cols = {}
    for n in names:
        cols[f"s_{n}"] = F.expr(rule_case(SIGNALS[n], 1))
        cols[f"c_{n}"] = F.expr(rule_case(SIGNALS[n], 2))
    return ready.withColumns(cols)


def fired(state: DataFrame, names: list[str] | None = None, hit_rates: dict[str, float] | None = None) -> DataFrame:
    """``signals``: array of (name, category, score, confidence, weight) with a non-zero score.

    ``weight`` is base weight × confidence × (0.5 + historical hit rate), the last factor 1 when unknown.
    """
    names = list(SIGNALS) if names is None else names
    scored = score_columns(state, names)
    rates = hit_rates or {}

    def item(n: str) -> Column:
        s = SIGNALS[n]
        factor = s.weight * (0.5 + rates[n] if n in rates else 1.0)
        return F.struct(
            F.lit(n).alias("name"),
            F.lit(s.category).alias("category"),
            F.col(f"s_{n}").alias("score"),
            F.col(f"c_{n}").alias("confidence"),
            (F.col(f"c_{n}") * factor).alias("weight"),
        )

    packed = scored.withColumn("signals", F.filter(F.array(*[item(n) for n in names]), lambda x: x["score"] != 0))
    return _barrier(packed.drop(*[f"s_{n}" for n in names], *[f"c_{n}" for n in names]))


def _barrier(df: DataFrame) -> DataFrame:
    """Pass the rows through unchanged as Arrow batches. The optimiser copies the rules of all signals into every
    filter and column that reads the array, until the plan no longer compiles; it does not look through this."""

    def same(batches):
        yield from batches

    return df.mapInArrow(same, df.schema)


def _total(signals: str, value) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda acc, x: acc + value(x))


def aggregate_signals(state: DataFrame, names: list[str] | None = None, hit_rates: dict[str, float] | None = None, min_raw: float = 0.1) -> DataFrame:
    """One opportunity per state row with a weighted mean score of at least ``min_raw``: direction,
    score, counts, confluence, categories and hold type. Narrow: no shuffle, the array holds one
    row's signals."""
    df = fired(state, names, hit_rates)
    df = df.withColumns({"_w": _total("signals", lambda x: x["weight"]), "_ws": _total("signals", lambda x: x["weight"] * x["score"])})
    df = df.withColumn("raw_score", F.when(F.col("_w") > 0, F.col("_ws") / F.col("_w"))).where(F.abs("raw_score") >= min_raw)
    agreeing = F.filter("signals", lambda x: (x["score"] > 0) == (F.col("raw_score") > 0))
    df = df.withColumn("_agree", agreeing)

    def in_categories(*wanted: str) -> Column:
        return F.size(F.filter("_agree", lambda x: x["category"].isin(*wanted)))

    hold = F.when(in_categories("funding", "seasonality") >= 2, "funding").when(in_categories("volatility") >= 2, "mean_reversion").otherwise("momentum")
    return df.withColumns(
        {
            "direction": F.when(F.col("raw_score") > 0, "LONG").otherwise("SHORT"),
            "score": F.abs("raw_score"),
            "num_signals": F.size("signals"),
            "num_agreeing": F.size("_agree"),
            "confluence": F.round(F.size("_agree") / F.size("signals"), 2),
            "categories": F.array_sort(F.array_distinct(F.transform("signals", lambda x: x["category"]))),
            "agreeing_categories": F.array_sort(F.array_distinct(F.transform("_agree", lambda x: x["category"]))),
            "names": F.array_sort(F.transform("signals", lambda x: x["name"])),
            "hold_type": hold,
        }
    ).drop("_w", "_ws", "_agree")


def rank_opportunities(opportunities: DataFrame, min_score: float = 0.15, min_signals: int = 2) -> DataFrame:
    """Opportunities worth a look, best first."""
    return opportunities.where((F.col("score") >= min_score) & (F.col("num_signals") >= min_signals)).orderBy(F.desc("score"), "symbol")
