"""Signals over the hourly state of every event type, their aggregation, scan and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import signals as S
from marketspark.operators import asof, flow, memory, state
from marketspark.operators.funding import funding_features
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import TR, lag, over, prior, recursion, with_
from marketspark.sources.tables import Tables

LEADER = "click"


def trades(t: Tables) -> DataFrame:
    side = F.when(F.pmod("seq", F.lit(2)) == 0, "B").otherwise("A")
    return t.type_ticks.withColumns({"side": side, "size": F.pow(F.col("size"), F.lit(2.0)) + 1})


def market_state(t: Tables) -> DataFrame:
    st = state.clock_features(state.history_features(state.price_state(t.type_bars)))
    st = state.cross_section(st, LEADER)
    st = st.withColumn("oracle_price", (F.col("high") + F.col("low")) / 2)
    rates = funding_features(t.event_funding, window=24, lookahead=True)
    st = asof.bucket_lookup(st, rates, {"funding_rate": 0.0, "premium": 0.0, "funding_zscore": 0.0, "predicted_funding": 0.0}, "1h")
    oi = asof.oi_features(t.open_interest, window=5)
    st = asof.bucket_lookup(st, oi, {"oi_roc": 0.0, "oi_zscore": 0.0}, "1d")
    tape = flow.trade_tape(trades(t), "1h").select(
        "symbol",
        "ts",
        F.col("imbalance").alias("tape_imbalance"),
        F.col("large_buy_volume").alias("tape_large_buy"),
        F.col("large_sell_volume").alias("tape_large_sell"),
        F.col("trade_count").cast("double").alias("tape_speed"),
        F.col("total_volume").alias("tape_volume"),
    )
    book = flow.orderflow_windows(t.books, "1h").select("symbol", "ts", "phantom_bid", "phantom_ask", F.col("avg_bid_depth").alias("bids_depth"), F.col("avg_ask_depth").alias("asks_depth"))
    st = st.join(tape, ["symbol", "ts"], "left").join(book, ["symbol", "ts"], "left")
    mean_rate = (F.sum("funding_rate").over(state.Window.partitionBy("ts")) - F.col("funding_rate")) / F.greatest(F.lit(1), F.count(F.lit(1)).over(state.Window.partitionBy("ts")) - 1)
    return st.withColumns({"funding_divergence": F.col("funding_rate") - mean_rate, "net_delta": F.col("volume_delta") * 10})


_W20 = over(20)
_STATE: dict[str, str] = {
    "b": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM type_bars",
    "m": f"""SELECT *, {TR} AS tr, close - {lag('close')} AS d, CASE WHEN {lag('close')} <> 0 THEN close / {lag('close')} - 1 END AS r,
    CASE WHEN close > open THEN volume WHEN close < open THEN -volume ELSE 0 END AS volume_delta, {lag('close', 2)} AS p2, {lag('close', 4)} AS p4, {lag('close', 9)} AS p9 FROM b""",
    "e": recursion(
        "m",
        ef=("CASE WHEN rn = 1 THEN 0 ELSE 19.0::DOUBLE / 21 END", "CASE WHEN rn = 1 THEN close ELSE 2.0::DOUBLE / 21 * close END"),
        es=("CASE WHEN rn = 1 THEN 0 ELSE 49.0::DOUBLE / 51 END", "CASE WHEN rn = 1 THEN close ELSE 2.0::DOUBLE / 51 * close END"),
    ),
    "g": f"""SELECT *, close AS price, CASE WHEN rn < 20 THEN close ELSE ef END AS ema_fast, CASE WHEN rn < 50 THEN close ELSE es END AS ema_slow,
    CASE WHEN rn < 15 THEN 50 WHEN sum(greatest(-d, 0)) {over(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(d, 0)) {over(14)} / sum(greatest(-d, 0)) {over(14)}) END AS rsi,
    CASE WHEN avg(volume) {_W20} > 0 THEN volume / avg(volume) {_W20} ELSE 1 END AS relative_volume,
    CASE WHEN rn > 14 THEN avg(tr) {over(14)} ELSE high - low END AS atr0, CASE WHEN rn > 20 THEN avg(tr) {_W20} ELSE high - low END AS a20,
    CASE WHEN rn >= 20 THEN avg(close) {_W20} + 2 * stddev_pop(close) {_W20} ELSE close END AS bb_upper,
    CASE WHEN rn >= 20 THEN avg(close) {_W20} - 2 * stddev_pop(close) {_W20} ELSE close END AS bb_lower,
    sum(volume_delta) {over(10)} AS cvd, (close - p2) / nullif(p2, 0) AS momentum2, (close - p4) / nullif(p4, 0) AS momentum4, (close - p9) / nullif(p9, 0) AS momentum9,
    CASE WHEN rn >= 20 THEN list(r) FILTER (r IS NOT NULL) {over(19)} END AS l19, CASE WHEN rn >= 15 THEN list(r) FILTER (r IS NOT NULL) {over(14)} END AS l14,
    sum(CASE WHEN r > 0 THEN r * volume ELSE 0 END) {over(14)} AS up, sum(CASE WHEN r <= 0 THEN -r * volume ELSE 0 END) {over(14)} AS down,
    (ts // 3600000) % 24 AS hour, 60 - (ts % 3600000) // 60000 AS minutes_to_hour, (ts - min(ts) {over()}) / 3600000 AS listing_age_h FROM e""",
    "h": """SELECT *, CASE WHEN atr0 > 0 THEN atr0 ELSE close * 0.01::DOUBLE END AS atr, ema_fast + 1.5 * a20 AS kelt_upper, ema_fast - 1.5 * a20 AS kelt_lower, ema_slow AS ema_trend,
    CASE WHEN len(l19) >= 10 THEN list_avg(l19) END AS m19, CASE WHEN len(l14) >= 10 THEN list_avg(l14) END AS m14 FROM g""",
    "i": """SELECT *, list_avg(list_transform(l19, lambda x: pow(x - m19, 2))) AS v19, list_avg(list_transform(l14, lambda x: pow(x - m14, 2))) AS v14,
    list_avg(list_transform(l19, lambda x: pow(x - m19, 4))) AS f19, list_transform(l19, lambda x, k: list_sum(l19[1:k]) - k * m19) AS walk,
    list_sum(list_transform(l14[2:], lambda x, k: (x - m14) * (l14[k] - m14))) / (len(l14) - 1) AS cov FROM h""",
    "j": """SELECT *, CASE WHEN v19 > 0 AND (list_max(walk) - list_min(walk)) > 0 THEN greatest(0, least(1, ln((list_max(walk) - list_min(walk)) / sqrt(v19)) / ln(len(l19)))) END AS hurst,
    CASE WHEN v19 > 0 THEN f19 / (v19 * v19) - 3 END AS kurt, CASE WHEN v14 > 0 THEN cov / v14 END AS autocorr,
    CASE WHEN rn >= 15 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END AS vwrsi FROM i""",
}
_HIST = "p2 p4 p9 momentum2 momentum4 momentum9 hurst kurt autocorr vwrsi"
_PRICE = "price rsi ema_fast ema_slow atr bb_upper bb_lower kelt_upper kelt_lower cvd volume_delta relative_volume"


@query("sig_40_state_panel", "symbol ts", f"{_PRICE} {_HIST} listing_age_h minutes_to_hour", with_("type_bars", "SELECT * FROM j", **_STATE), digits=5)
def _(t: Tables) -> DataFrame:
    return state.clock_features(state.history_features(state.price_state(t.type_bars)))


TAPE_SQL = """SELECT symbol, ts // {ms} * {ms} AS ts, sum(CASE WHEN buy THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN buy THEN 0 ELSE size END) AS sell_volume,
    count(*) FILTER (buy) AS buy_count, count(*) FILTER (NOT buy) AS sell_count, sum(price * size) AS notional, list_sort(list(size)) AS sizes
    FROM (SELECT symbol, ts, price, size * size + 1 AS size, seq % 2 = 0 AS buy FROM type_ticks) GROUP BY symbol, type_ticks_ts // {ms}"""
TAPE_CTES = {
    "tp0": TAPE_SQL.format(ms=3_600_000).replace("type_ticks_ts", "ts"),
    "tp": """SELECT *, buy_volume + sell_volume AS total_volume, buy_count + sell_count AS trade_count, buy_volume - sell_volume AS delta,
    coalesce(list_sum(list_filter(sizes, lambda x: x > greatest(10 * sizes[len(sizes) // 2 + 1], 0.001))), 0) AS large FROM tp0""",
}
DEPTH_CTES = {
    "dp0": """SELECT symbol, ts, coalesce(sum(sz) FILTER (side = 'bid' AND lvl <= 10), 0) AS bid_depth, coalesce(sum(sz) FILTER (side = 'ask' AND lvl <= 10), 0) AS ask_depth,
    coalesce(max(px) FILTER (side = 'bid'), 0) AS bb, coalesce(min(px) FILTER (side = 'ask'), 0) AS ba FROM levels_ranked GROUP BY 1, 2""",
    "dp": f"""SELECT *, CASE WHEN bb > 0 AND ba > 0 THEN (ba - bb) / bb ELSE 0 END AS spread, coalesce(greatest(0, {lag('bid_depth')} - bid_depth), 0) AS bid_gone,
    coalesce(greatest(0, {lag('ask_depth')} - ask_depth), 0) AS ask_gone FROM dp0""",
}


def flow_sql(ms: int) -> str:
    return f"""SELECT symbol, ts // {ms} * {ms} AS ts, avg(bid_depth) AS avg_bid_depth, avg(ask_depth) AS avg_ask_depth, sum(bid_gone) AS bid_vanished, sum(ask_gone) AS ask_vanished,
    avg(spread) * 10000 AS avg_spread_bps, count(*) AS snapshots, CASE WHEN avg(bid_depth) > 0 THEN sum(bid_gone) / (avg(bid_depth) * count(*)) ELSE 0 END AS phantom_bid,
    CASE WHEN avg(ask_depth) > 0 THEN sum(ask_gone) / (avg(ask_depth) * count(*)) ELSE 0 END AS phantom_ask, avg(bid_depth) / (avg(bid_depth) + avg(ask_depth)) AS bid_ratio
    FROM dp GROUP BY symbol, dp.ts // {ms}"""


_CONTEXT = {
    **TAPE_CTES,
    **DEPTH_CTES,
    "ofl": flow_sql(3_600_000),
    "fr": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM event_funding",
    "fz": f"""SELECT *, lead(funding_rate) OVER (PARTITION BY symbol ORDER BY ts) AS predicted_funding, CASE WHEN rn > 24 AND stddev_pop(funding_rate) {prior(24)} > 0
    THEN (funding_rate - avg(funding_rate) {prior(24)}) / stddev_pop(funding_rate) {prior(24)} END AS funding_zscore FROM fr""",
    "ofe": f"""SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) > 5 AND stddev_pop(oi_close) {prior(5)} > 0
    THEN (oi_close - avg(oi_close) {prior(5)}) / stddev_pop(oi_close) {prior(5)} END AS oi_zscore, (oi_close - {lag('oi_close')}) / {lag('oi_close')} * 100 AS oi_roc FROM open_interest""",
    "st": f"""SELECT j.*, (high + low) / 2 AS oracle_price, avg(CASE WHEN rsi > 70 THEN 100 ELSE 0 END) OVER (PARTITION BY j.ts) AS breadth_ob,
    avg(CASE WHEN rsi < 30 THEN 100 ELSE 0 END) OVER (PARTITION BY j.ts) AS breadth_os, avg(rsi) OVER (PARTITION BY j.ts) AS rsi_market,
    max(CASE WHEN j.symbol = '{LEADER}' THEN momentum2 END) OVER (PARTITION BY j.ts) AS leader_momentum, j.symbol = '{LEADER}' AS is_leader,
    coalesce(fz.funding_rate, 0) AS funding_rate, coalesce(fz.premium, 0) AS premium, coalesce(fz.funding_zscore, 0) AS funding_zscore, coalesce(fz.predicted_funding, 0) AS predicted_funding,
    coalesce(oi_roc, 0) AS oi_roc, coalesce(oi_zscore, 0) AS oi_zscore, tp.delta / tp.total_volume AS tape_imbalance, large * tp.buy_volume / tp.total_volume AS tape_large_buy,
    large * tp.sell_volume / tp.total_volume AS tape_large_sell, tp.trade_count AS tape_speed, tp.total_volume AS tape_volume, phantom_bid, phantom_ask, avg_bid_depth AS bids_depth, avg_ask_depth AS asks_depth,
    volume_delta * 10 AS net_delta FROM j LEFT JOIN fz USING (symbol, ts) LEFT JOIN ofe ON ofe.symbol = j.symbol AND ofe.ts = j.ts // 86400000 * 86400000
    LEFT JOIN tp USING (symbol, ts) LEFT JOIN ofl USING (symbol, ts)""",
    "stt": """SELECT *, funding_rate - (sum(funding_rate) OVER (PARTITION BY ts) - funding_rate) / greatest(1, count(*) OVER (PARTITION BY ts) - 1) AS funding_divergence FROM st""",
}
_NEEDS = "type_bars event_funding open_interest levels_ranked"
# signals whose sources the test tables do not carry read NULL columns on both sides
_ABSENT = "vault_long vault_short vault_total vault_change ls_ratio avg_leverage unrealized".split()
_CONTEXT["state"] = "SELECT *, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in _ABSENT) + " FROM stt"
_SOCIAL = {"hyperstats": {"ls_ratio", "avg_leverage", "unrealized"}}
_NUMBERED = [
    *"hurst_exponent return_autocorrelation return_kurtosis oi_acceleration cvd_momentum price_oracle_gap predicted_actual_divergence volume_weighted_rsi".split(),
    *"market_breadth avg_rsi_deviation btc_lead_lag correlation_breakdown funding_extreme funding_divergence funding_zscore".split(),
    *"ls_ratio_extreme leverage_extreme unrealized_pnl oi_divergence volume_imbalance volume_surge oi_zscore net_positioning liquidation_proximity".split(),
    *"whale_activity orderbook_imbalance rsi_extreme ema_trend price_momentum trade_tape_imbalance spoofing_detection vault_smart_money".split(),
    *"funding_settlement_window session_transition new_listing_spike vol_mean_reversion squeeze_detection premium_extreme".split(),
]
# crowd statistics stand in from the flow of the bar itself, so that their rules see values
_CROWD_SQL = """SELECT * REPLACE (CASE WHEN asks_depth > 0 THEN bids_depth / asks_depth END AS ls_ratio, tape_speed AS avg_leverage, cvd AS unrealized,
    trade_long AS vault_long, trade_short AS vault_short, trade_long + trade_short AS vault_total, 100 * momentum2 AS vault_change)
    FROM (SELECT state.*, tp.buy_count AS trade_long, tp.sell_count AS trade_short FROM state LEFT JOIN tp USING (symbol, ts))"""


def crowd_state(t: Tables) -> DataFrame:
    st = market_state(t)
    counts = flow.trade_tape(trades(t), "1h").select("symbol", "ts", "buy_count", "sell_count")
    st = st.join(counts, ["symbol", "ts"], "left")
    return st.withColumns(
        {
            "ls_ratio": F.when(F.col("asks_depth") > 0, F.col("bids_depth") / F.col("asks_depth")),
            "avg_leverage": F.col("tape_speed"),
            "unrealized": F.col("cvd"),
            "vault_long": F.col("buy_count"),
            "vault_short": F.col("sell_count"),
            "vault_total": F.col("buy_count") + F.col("sell_count"),
            "vault_change": 100 * F.col("momentum2"),
        }
    )


def _register_group(first: int, last: int, category: str) -> None:
    names = _NUMBERED[first - 1 : last]
    cols = [f"{p}_{n}" for n in names for p in "sc"]
    cases = ", ".join(f"{S.rule_case(S.SIGNALS[n], 1)} AS s_{n}, {S.rule_case(S.SIGNALS[n], 2)} AS c_{n}" for n in names)
    sql = with_(_NEEDS, f"SELECT symbol, ts, {cases} FROM crowd", **_STATE, **_CONTEXT, crowd=_CROWD_SQL)

    @query(f"sig_{first:02d}_{last:02d}_{category}", "symbol ts", " ".join(cols), sql, digits=4)
    def _(t: Tables) -> DataFrame:
        return S.score_columns(crowd_state(t), names)


_register_group(1, 8, "computed")
_register_group(9, 12, "cross_pair")
_register_group(13, 15, "funding")
_register_group(16, 18, "crowd")
_register_group(19, 26, "microstructure")
_register_group(27, 29, "momentum")
_register_group(30, 32, "realtime")
_register_group(33, 35, "seasonality")
_register_group(36, 38, "volatility")

_FIRED = " UNION ALL ".join(
    f"SELECT symbol, ts, '{n}' AS name, '{S.SIGNALS[n].category}' AS category, {S.rule_case(S.SIGNALS[n], 1)} AS score, {S.rule_case(S.SIGNALS[n], 2)} AS conf FROM state" for n in _NUMBERED
)
_AGG_CTES = {
    "fired": f"SELECT *, conf * CASE name WHEN 'cvd_momentum' THEN 1.1::DOUBLE WHEN 'ema_trend' THEN 0.8::DOUBLE ELSE 1 END AS wt FROM ({_FIRED}) WHERE score <> 0",
    "raw": "SELECT symbol, ts, sum(score * wt) / sum(wt) AS raw_score FROM fired GROUP BY 1, 2 HAVING sum(wt) > 0",
    "opp": """SELECT f.symbol, f.ts, any_value(raw_score) AS raw_score, abs(any_value(raw_score)) AS score, CASE WHEN any_value(raw_score) > 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
    CAST(count(*) AS INT) AS num_signals, CAST(count(*) FILTER ((f.score > 0) = (raw_score > 0)) AS INT) AS num_agreeing,
    string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(name, ',' ORDER BY name) AS names,
    string_agg(DISTINCT category, ',' ORDER BY category) FILTER ((f.score > 0) = (raw_score > 0)) AS agreeing_categories,
    CASE WHEN count(*) FILTER ((f.score > 0) = (raw_score > 0) AND category IN ('funding', 'seasonality')) >= 2 THEN 'funding'
    WHEN count(*) FILTER ((f.score > 0) = (raw_score > 0) AND category = 'volatility') >= 2 THEN 'mean_reversion' ELSE 'momentum' END AS hold_type
    FROM fired f JOIN raw USING (symbol, ts) WHERE abs(raw_score) >= 0.1003 GROUP BY 1, 2""",
}
HIT_RATES = {"cvd_momentum": 0.6, "ema_trend": 0.3}


def opportunities(t: Tables) -> DataFrame:
    opp = S.aggregate_signals(market_state(t), _NUMBERED, HIT_RATES, min_raw=0.1003)
    return opp.withColumns({c: F.array_join(c, ",") for c in ("categories", "agreeing_categories", "names")})


@query(
    "sig_39_aggregate",
    "symbol ts direction num_signals num_agreeing categories names hold_type",
    "raw_score score confluence",
    with_(_NEEDS, "SELECT *, round(num_agreeing / num_signals, 2) AS confluence FROM opp", **_STATE, **_CONTEXT, **_AGG_CTES),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return opportunities(t)


@query(
    "srt_03_rank_opportunities",
    "symbol ts direction num_signals",
    "score",
    with_(_NEEDS, "SELECT * FROM opp WHERE score >= 0.3 AND num_signals >= 8 ORDER BY score DESC, symbol", **_STATE, **_CONTEXT, **_AGG_CTES),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return S.rank_opportunities(opportunities(t), 0.3, 8)


# ── outcomes of signal sets ────────────────────────────────────────────────────────────────

_OUTCOMES = """SELECT 'U' || user_id AS symbol, CASE WHEN count(*) % 2 = 0 THEN 'long' ELSE 'short' END AS direction, list_sort(list(DISTINCT event_type)) AS signals, day,
    avg(value) - 20 AS pnl_pct, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 60000 AS hold_minutes, (arg_max((epoch_us(ts) // 1000), row(value, event_id)) - min((epoch_us(ts) // 1000))) / 60000 AS time_to_peak_minutes
    FROM (SELECT *, epoch_us(ts) // 86400000000 AS day FROM events) GROUP BY user_id, day"""


def outcomes(t: Tables) -> DataFrame:
    """A trade per user and day: the signals are the event types seen."""
    e = t.ticks.withColumn("day", F.floor(F.col("ts") / 86_400_000))
    return (
        e.groupBy("symbol", "day")
        .agg(
            F.when(F.count(F.lit(1)) % 2 == 0, "long").otherwise("short").alias("direction"),
            F.array_sort(F.collect_set("event_type")).alias("signals"),
            (F.avg("price") - 20).alias("pnl_pct"),
            ((F.max("ts") - F.min("ts")) / 60_000).alias("hold_minutes"),
            ((F.max_by("ts", F.struct("price", "seq")) - F.min("ts")) / 60_000).alias("time_to_peak_minutes"),
        )
    )


@query(
    "agg_23_signal_stats",
    "signal direction wins total",
    "hit_rate",
    f"""SELECT signal, direction, count(*) FILTER (pnl_pct > 0) AS wins, count(*) AS total, count(*) FILTER (pnl_pct > 0) / count(*) AS hit_rate
    FROM (SELECT *, unnest(signals) AS signal FROM ({_OUTCOMES})) GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(t: Tables) -> DataFrame:
    return memory.signal_stats(outcomes(t))


_HIT_SQL = f"""WITH o AS ({_OUTCOMES}), s AS (SELECT direction, signal, avg(CASE WHEN pnl_pct > 0 THEN 1 ELSE 0 END) AS rate FROM
    (SELECT *, unnest(signals) AS signal FROM o) GROUP BY 1, 2 HAVING count(*) >= 5),
    c AS (SELECT symbol, direction, signals, avg(CASE WHEN pnl_pct > 0 THEN 1 ELSE 0 END) AS rate FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 5),
    d AS (SELECT symbol, direction, avg(CASE WHEN pnl_pct > 0 THEN 1 ELSE 0 END) AS rate FROM o GROUP BY 1, 2 HAVING count(*) >= 5),
    q AS (SELECT DISTINCT symbol, direction, signals FROM o),
    i AS (SELECT q.symbol, q.direction, q.signals, avg(s.rate) AS rate FROM (SELECT *, unnest(signals) AS signal FROM q) q JOIN s ON s.signal = q.signal AND s.direction = q.direction GROUP BY 1, 2, 3)
    SELECT q.symbol, q.direction, array_to_string(q.signals, ',') AS combo, coalesce(c.rate, i.rate, d.rate) AS hit_rate FROM q
    LEFT JOIN c ON c.symbol = q.symbol AND c.direction = q.direction AND c.signals = q.signals LEFT JOIN i ON i.symbol = q.symbol AND i.direction = q.direction AND i.signals = q.signals
    LEFT JOIN d ON d.symbol = q.symbol AND d.direction = q.direction"""


@query("agg_23_hit_rate", "symbol direction combo", "hit_rate", _HIT_SQL)
def _(t: Tables) -> DataFrame:
    o = outcomes(t)
    asked = o.select("symbol", "direction", "signals").distinct()
    return memory.hit_rates(asked, o).withColumn("combo", F.array_join("signals", ","))


@query(
    "agg_24_signal_decay",
    "signal observations",
    "avg_time_to_peak median p90 avg_hold",
    f"""SELECT signal, count(*) FILTER (p > 0) AS observations, avg(p) FILTER (p > 0) AS avg_time_to_peak, l[len(l) // 2 + 1] AS median,
    l[least(len(l) - 1, CAST(floor(len(l) * 0.9::DOUBLE) AS BIGINT)) + 1] AS p90, coalesce(avg(h) FILTER (h > 0), 0) AS avg_hold
    FROM (SELECT *, list_sort(list(p) FILTER (p > 0) OVER (PARTITION BY signal)) AS l FROM (SELECT unnest(signals) AS signal, time_to_peak_minutes AS p, hold_minutes AS h FROM ({_OUTCOMES})))
    GROUP BY signal, l HAVING count(*) FILTER (p > 0) >= 5""",
)
def _(t: Tables) -> DataFrame:
    return memory.signal_decay(outcomes(t))


@query(
    "agg_25_kelly_sizing",
    "direction observations",
    "win_rate avg_win avg_loss risk_pct",
    f"""SELECT direction, observations, win_rate, avg_win, avg_loss, greatest(0.005, least(0.05, (win_rate * avg_win / avg_loss - (1 - win_rate)) / (avg_win / avg_loss) * 0.5)) AS risk_pct FROM (
    SELECT direction, count(*) AS observations, avg(CASE WHEN pnl_pct > 0 THEN 1 ELSE 0 END) AS win_rate, avg(abs(pnl_pct)) FILTER (pnl_pct > 0) AS avg_win, avg(abs(pnl_pct)) FILTER (pnl_pct <= 0) AS avg_loss
    FROM ({_OUTCOMES}) WHERE list_has_any(signals, ['purchase', 'view']) GROUP BY 1 HAVING count(*) >= 10)""",
)
def _(t: Tables) -> DataFrame:
    return memory.kelly_sizing(outcomes(t), ["purchase", "view"])
