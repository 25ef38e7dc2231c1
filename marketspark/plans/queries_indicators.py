"""Technical indicators on weekly bars of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import asof
from marketspark.operators import indicators as I
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import TR, ema_coef, full, lag, over, prior, recursion, wilder_coef, with_
from marketspark.sources.tables import Tables

K = "symbol ts"


def _plain(name: str, wanted: dict, needs: str, sql: str, **ctes: str) -> None:
    """Register indicators that are added one by one to ``bars``."""

    @query(name, K, " ".join(wanted), with_(needs, sql, **ctes), digits=5)
    def _(t: Tables) -> DataFrame:
        return I.add(t.bars, wanted)


_plain(
    "win_01_moving_bands",
    {
        "sma": ("sma", {"period": 20}),
        "sd": ("stddev", {"period": 20}),
        "bb_up": "bb_upper",
        "bb_lo": "bb_lower",
        "bb_width": "bb_width",
        "don_hi": "donchian_upper",
        "don_lo": "donchian_lower",
    },
    "bn",
    f"""SELECT symbol, ts, {full('avg(close)', 20)} AS sma, {full('stddev_pop(close)', 20)} AS sd,
    {full('avg(close)', 20)} + 2 * {full('stddev_pop(close)', 20)} AS bb_up, {full('avg(close)', 20)} - 2 * {full('stddev_pop(close)', 20)} AS bb_lo,
    4 * {full('stddev_pop(close)', 20)} / {full('avg(close)', 20)} AS bb_width,
    {full('max(high)', 20)} AS don_hi, {full('min(low)', 20)} AS don_lo FROM bn""",
)
_plain(
    "win_02_swings",
    {"swing_hi": ("swing_high", {"period": 10}), "swing_lo": ("swing_low", {"period": 10})},
    "bn",
    f"SELECT symbol, ts, {full('max(high)', 11)} AS swing_hi, {full('min(low)', 11)} AS swing_lo FROM bn",
)
_VW = f"CASE WHEN {full('sum(volume)', 20)} > 0 THEN {full('sum(close * volume)', 20)} / {full('sum(volume)', 20)} ELSE {full('avg(close)', 20)} END"
_plain(
    "win_03_rolling_vwap",
    {"vwap": "vwap", "vwap_sd": "vwap_std", "vwap_z": "vwap_zscore"},
    "bn",
    """SELECT symbol, ts, vwap, vwap_sd, CASE WHEN vwap_sd > 0 THEN (close - vwap) / vwap_sd END AS vwap_z FROM d""",
    v=f"SELECT *, {_VW} AS vwap FROM bn",
    d=f"SELECT *, CASE WHEN count(close - vwap) {over(20)} > 2 THEN stddev_pop(close - vwap) {over(20)} END AS vwap_sd FROM v",
)
_plain(
    "win_04_session_vwap",
    {"svwap": "session_vwap"},
    "bn",
    f"SELECT symbol, ts, sum((high + low + close) / 3 * volume) {over()} / sum(volume) {over()} AS svwap FROM bn",
)
_plain(
    "win_05_volume_ratio",
    {"ratio": "vol_ratio", "rvol": "relative_volume"},
    "bn",
    f"SELECT symbol, ts, volume / {full('avg(volume)', 20)} AS ratio, volume / avg(volume) {over(20)} AS rvol FROM bn",
)
_plain(
    "win_06_ema",
    {"ema12": ("ema", {"period": 12}), "ema50": ("ema", {"period": 50})},
    "bn",
    "SELECT symbol, ts, ema12, ema50 FROM e",
    e=recursion("bn", ema12=ema_coef("close", 12), ema50=ema_coef("close", 50)),
)
_plain(
    "win_07_macd",
    {"macd": "macd", "sig": "macd_signal", "hist": "macd_histogram"},
    "bn",
    "SELECT symbol, ts, macd, sig, macd - sig AS hist FROM s",
    e=recursion("bn", f=ema_coef("close", 12), s=ema_coef("close", 26)),
    m="SELECT *, f - s AS macd FROM e",
    s=recursion("m", sig=ema_coef("macd", 9)),
)
_plain(
    "win_08_dema_tema",
    {"dema": ("dema", {"period": 10}), "tema": ("tema", {"period": 10})},
    "bn",
    "SELECT symbol, ts, 2 * e1 - e2 AS dema, 3 * e1 - 3 * e2 + e3 AS tema FROM z",
    x=recursion("bn", e1=ema_coef("close", 10)),
    y=recursion("x", e2=ema_coef("e1", 10)),
    z=recursion("y", e3=ema_coef("e2", 10)),
)
_TR_CTE = f"SELECT *, {TR} AS tr FROM bn"
_plain(
    "win_09_atr",
    {"atr": "atr", "atr_sma": ("atr_sma", {"period": 20})},
    "bn",
    f"SELECT symbol, ts, atr, CASE WHEN rn >= 20 THEN avg(atr) {over(20)} END AS atr_sma FROM a",
    tr=_TR_CTE,
    a=recursion("tr", atr=wilder_coef("tr", 14)),
)
_RSI_CTES = {
    "mv": f"SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT *, close - {lag('close')} AS d FROM bn)",
    "mv2": "SELECT * REPLACE (CASE WHEN d IS NOT NULL THEN g END AS g, CASE WHEN d IS NOT NULL THEN l END AS l) FROM mv",
    "gl": recursion("mv2", ag=wilder_coef("g", 14), al=wilder_coef("l", 14)),
}
_RSI = "CASE WHEN rn > 15 THEN 100 - 100 / (1 + CASE WHEN al > 0 THEN ag / al ELSE 100 END) END"
_plain(
    "win_10_rsi",
    {"rsi": "rsi", "rsi_s": "rsi_simple"},
    "bn",
    f"""SELECT symbol, ts, {_RSI} AS rsi, CASE WHEN rn <= 14 THEN 50 WHEN sum(l) {over(14)} = 0 THEN 100
    ELSE 100 - 100 / (1 + sum(g) {over(14)} / sum(l) {over(14)}) END AS rsi_s FROM gl""",
    **_RSI_CTES,
)
_DI_CTES = {
    "dm0": f"SELECT *, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bn",
    "dm": """SELECT *, CASE WHEN rn > 1 THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS pdm,
    CASE WHEN rn > 1 THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS mdm FROM dm0""",
    "ds": recursion("dm", trs=wilder_coef("tr", 14, True), ps=wilder_coef("pdm", 14, True), ms=wilder_coef("mdm", 14, True)),
    "di": "SELECT *, CASE WHEN trs > 0 THEN 100 * ps / trs END AS pdi, CASE WHEN trs > 0 THEN 100 * ms / trs END AS mdi FROM ds",
    "dx": """SELECT *, CASE WHEN rn > 15 THEN CASE WHEN coalesce(pdi, 0) + coalesce(mdi, 0) > 0
    THEN 100 * abs(coalesce(pdi, 0) - coalesce(mdi, 0)) / (coalesce(pdi, 0) + coalesce(mdi, 0)) ELSE 0 END END AS dx FROM di""",
    "ad": recursion("dx", adx=wilder_coef("dx", 14)),
}
_plain("win_11_adx", {"adx": "adx", "pdi": "plus_di", "mdi": "minus_di"}, "bn", "SELECT symbol, ts, adx, pdi, mdi FROM ad", **_DI_CTES)
_TOP, _BOT = full("max(high)", 14), full("min(low)", 14)
_plain(
    "win_12_stochastics",
    {"k": "stoch_k", "d": "stoch_d", "willr": "williams_r"},
    "bn",
    f"SELECT symbol, ts, k, CASE WHEN rn >= 18 THEN avg(k) {over(3)} END AS d, willr FROM s",
    r=f"""SELECT *, CASE WHEN hi <> lo THEN 100 * (close - lo) / (hi - lo) WHEN hi = lo THEN 50 END AS rk,
    CASE WHEN hi <> lo THEN -100 * (hi - close) / (hi - lo) WHEN hi = lo THEN -50 END AS willr FROM (SELECT *, {_TOP} AS hi, {_BOT} AS lo FROM bn)""",
    s=f"SELECT *, CASE WHEN rn >= 16 THEN avg(rk) {over(3)} END AS k FROM r",
)
_plain(
    "win_13_cci",
    {"cci": "cci"},
    "bn",
    """SELECT symbol, ts, CASE WHEN rn >= 20 AND dev > 0 THEN (tp - m) / (0.015::DOUBLE * dev) END AS cci
    FROM (SELECT *, list_avg(list_transform(l, lambda x: abs(x - m))) AS dev FROM t)""",
    t0="SELECT *, (high + low + close) / 3 AS tp FROM bn",
    t=f"SELECT *, list(tp) {over(20)} AS l, avg(tp) {over(20)} AS m FROM t0",
)
_plain(
    "win_14_roc_pivot",
    {"roc": "roc", "pivot_px": ("pivot_point", {"period": 2})},
    "bn",
    f"""SELECT symbol, ts, (close - {lag('close', 10)}) / {lag('close', 10)} * 100 AS roc,
    ({lag('high', 2)} + {lag('low', 2)} + {lag('close', 2)}) / 3 AS pivot_px FROM bn""",
)
_plain(
    "win_15_money_flow",
    {"mfi": "mfi", "obv": "obv", "cmf": "cmf"},
    "bn",
    f"""SELECT symbol, ts, CASE WHEN rn > 14 THEN CASE WHEN sum(nf) {over(14)} > 0 THEN 100 - 100 / (1 + sum(pf) {over(14)} / sum(nf) {over(14)}) ELSE 100 END END AS mfi,
    sum(coalesce(sg, 0) * volume) {over()} AS obv, CASE WHEN rn >= 20 AND sum(volume) {over(20)} > 0 THEN sum(mf) {over(20)} / sum(volume) {over(20)} END AS cmf
    FROM f""",
    f0=f"SELECT *, (high + low + close) / 3 AS tp, sign(close - {lag('close')}) AS sg, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mf FROM bn",
    f=f"""SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0 END AS pf, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0 END AS nf FROM f0""",
)
_plain(
    "win_16_keltner",
    {"kc_up": "keltner_upper", "kc_lo": "keltner_lower"},
    "bn",
    "SELECT symbol, ts, e + 2 * coalesce(a, 0) AS kc_up, e - 2 * coalesce(a, 0) AS kc_lo FROM k",
    tr=_TR_CTE,
    k=recursion("tr", e=ema_coef("close", 20), a=wilder_coef("tr", 14)),
)
_plain(
    "win_17_historical_vol",
    {"hv": "histvol"},
    "bn",
    f"SELECT symbol, ts, CASE WHEN rn > 20 THEN stddev_pop(lr) {over(20)} * sqrt(8760) END AS hv FROM l",
    l=f"SELECT *, ln(close / {lag('close')}) AS lr FROM bn",
)
_plain(
    "win_18_supertrend",
    {"st": "supertrend"},
    "bn",
    "SELECT symbol, ts, CASE WHEN atr IS NOT NULL THEN dir END AS st FROM s",
    tr=_TR_CTE,
    a=recursion("tr", atr=wilder_coef("tr", 10)),
    s="""SELECT a.*, 1.0::DOUBLE AS dir, NULL::DOUBLE AS ub, NULL::DOUBLE AS lb, close AS pc FROM a WHERE rn = 1 UNION ALL
    SELECT * EXCLUDE (pdir, c_ub, c_lb, p_lb), CASE WHEN atr IS NULL OR p_lb IS NULL THEN pdir WHEN pdir = 1 THEN CASE WHEN close < c_lb THEN -1 ELSE 1 END
    ELSE CASE WHEN close > c_ub THEN 1 ELSE -1 END END, c_ub, c_lb, close FROM (
    SELECT a.*, s.dir AS pdir, s.lb AS p_lb,
    CASE WHEN a.atr IS NULL THEN NULL WHEN s.ub IS NOT NULL AND s.pc < s.ub AND (a.high + a.low) / 2 + 3 * a.atr > s.ub THEN s.ub ELSE (a.high + a.low) / 2 + 3 * a.atr END AS c_ub,
    CASE WHEN a.atr IS NULL THEN NULL WHEN s.lb IS NOT NULL AND s.pc > s.lb AND (a.high + a.low) / 2 - 3 * a.atr < s.lb THEN s.lb ELSE (a.high + a.low) / 2 - 3 * a.atr END AS c_lb
    FROM s JOIN a ON a.symbol = s.symbol AND a.rn = s.rn + 1)""",
)
_plain(
    "win_19_parabolic_sar",
    {"sar": "psar"},
    "bn",
    "SELECT symbol, ts, CASE WHEN rn > 2 THEN sar END AS sar FROM p",
    h=f"SELECT symbol, ts, rn, high, low, {lag('high')} AS h1, {lag('low')} AS l1, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM bn",
    p="""SELECT *, high AS sar, low AS ep, 1 AS up, 0.02::DOUBLE AS af FROM h WHERE rn = 1 UNION ALL
    SELECT symbol, ts, rn, high, low, h1, l1, h2, l2,
    CASE WHEN rn = 2 THEN sar WHEN up = 1 AND low < s2 THEN e2 WHEN up = -1 AND high > s2 THEN e2 ELSE s2 END,
    CASE WHEN rn = 2 THEN ep WHEN up = 1 AND low < s2 THEN low WHEN up = -1 AND high > s2 THEN high ELSE e2 END,
    CASE WHEN rn > 2 AND ((up = 1 AND low < s2) OR (up = -1 AND high > s2)) THEN -up ELSE up END,
    CASE WHEN rn = 2 THEN af WHEN (up = 1 AND low < s2) OR (up = -1 AND high > s2) THEN 0.02::DOUBLE
    WHEN (up = 1 AND high > ep) OR (up = -1 AND low < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END FROM (
    SELECT h.*, p.sar, p.ep, p.up, p.af,
    CASE WHEN p.up = 1 THEN least(p.sar + p.af * (p.ep - p.sar), h.l1, h.l2) ELSE greatest(p.sar + p.af * (p.ep - p.sar), h.h1, h.h2) END AS s2,
    CASE WHEN p.up = 1 THEN greatest(p.ep, h.high) ELSE least(p.ep, h.low) END AS e2
    FROM p JOIN h ON h.symbol = p.symbol AND h.rn = p.rn + 1)""",
)
_plain(
    "win_20_aroon",
    {"up": "aroon_up", "down": "aroon_down"},
    "bn",
    """SELECT symbol, ts, CASE WHEN rn > 14 THEN (list_position(h, list_max(h)) - 1) / 14 * 100 END AS up,
    CASE WHEN rn > 14 THEN (list_position(l, list_min(l)) - 1) / 14 * 100 END AS down FROM w""",
    w=f"SELECT *, list(high) {over(15)} AS h, list(low) {over(15)} AS l FROM bn",
)


def _wma_sql(x: str, p: int) -> str:
    terms = " + ".join(f"{p - k} * {lag(x, k) if k else x}" for k in range(p))
    return f"({terms}) / {p * (p + 1) / 2}"


_plain(
    "win_21_weighted_means",
    {"wma": ("wma", {"period": 9}), "hma": ("hma", {"period": 9})},
    "bn",
    f"SELECT symbol, ts, wma, {_wma_sql('d', 3)} AS hma FROM h",
    h=f"SELECT *, {_wma_sql('close', 9)} AS wma, 2 * ({_wma_sql('close', 4)}) - {_wma_sql('close', 9)} AS d FROM bn",
)
_plain(
    "win_22_regression_slope",
    {"slope": "linreg_slope"},
    "bn",
    f"SELECT symbol, ts, CASE WHEN rn >= 20 THEN regr_slope(close, rn) {over(20)} END AS slope FROM bn",
)
_ICHI = {p: f"({full('max(high)', p)} + {full('min(low)', p)}) / 2" for p in (9, 26, 52)}
_plain(
    "win_23_ichimoku",
    {"tenkan": "ichimoku_tenkan", "kijun": "ichimoku_kijun", "span_a": "ichimoku_senkou_a", "span_b": "ichimoku_senkou_b"},
    "bn",
    f"SELECT symbol, ts, tenkan, kijun, {lag('(tenkan + kijun) / 2', 26)} AS span_a, {lag('wide', 26)} AS span_b FROM i",
    i=f"SELECT *, {_ICHI[9]} AS tenkan, {_ICHI[26]} AS kijun, {_ICHI[52]} AS wide FROM bn",
)
_plain(
    "win_24_kama",
    {"kama": "kama"},
    "bn",
    "SELECT symbol, ts, kama FROM k",
    d=f"SELECT *, abs(close - {lag('close')}) AS step, abs(close - {lag('close', 10)}) AS way FROM bn",
    e=f"SELECT *, avg(close) {over(10)} AS start, pow(CASE WHEN sum(step) {over(10)} > 0 THEN way / sum(step) {over(10)} ELSE 0 END * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS sc FROM d",
    k=recursion("e", kama=("CASE WHEN rn = 10 THEN 0 WHEN rn > 10 THEN 1 - sc END", "CASE WHEN rn = 10 THEN start WHEN rn > 10 THEN sc * close END")),
)
_ADAPT = {
    "tr": _TR_CTE,
    "a": recursion("tr", atr=wilder_coef("tr", 14)),
    "ap": f"SELECT *, list_filter(l, lambda x: x <= atr) AS below, {lag('atr')} AS before FROM (SELECT *, list(atr) FILTER (atr IS NOT NULL) {over(101)} AS l FROM a)",
}


def _per(base: int, least: int, most: int, extra: str = "") -> str:
    return f"CASE WHEN atr IS NOT NULL {extra} AND len(l) > 5 THEN floor({least} + (1 - len(below)::DOUBLE / len(l)) * {most - least}) ELSE {base} END"


_plain(
    "win_25_adaptive_ema",
    {"aema": "adaptive_ema"},
    "bn",
    "SELECT symbol, ts, aema FROM e",
    **_ADAPT,
    q=f"SELECT *, 2.0::DOUBLE / ({_per(20, 5, 50, 'AND before IS NOT NULL')} + 1) AS alpha, avg(close) {over(30)} AS start FROM ap",
    e=recursion("q", aema=("CASE WHEN rn = 30 THEN 0 WHEN rn > 30 THEN 1 - alpha END", "CASE WHEN rn = 30 THEN start WHEN rn > 30 THEN alpha * close END")),
)
_plain(
    "win_25_adaptive_rsi",
    {"arsi": "adaptive_rsi"},
    "bn",
    "SELECT symbol, ts, CASE WHEN rn > 38 THEN CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) ELSE 100 END END AS arsi FROM e",
    **_ADAPT,
    q=f"SELECT *, 1.0::DOUBLE / {_per(14, 7, 28)} AS alpha, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS lo FROM ap",
    q2=f"SELECT * EXCLUDE (g, lo), CASE WHEN rn > 1 THEN g END AS g, CASE WHEN rn > 1 THEN lo END AS lo FROM q",
    q3=f"SELECT *, avg(g) {over(38)} AS sg, avg(lo) {over(38)} AS sl FROM q2",
    e=recursion(
        "q3",
        ag=("CASE WHEN rn = 38 THEN 0 WHEN rn > 38 THEN 1 - alpha END", "CASE WHEN rn = 38 THEN sg WHEN rn > 38 THEN alpha * g END"),
        al=("CASE WHEN rn = 38 THEN 0 WHEN rn > 38 THEN 1 - alpha END", "CASE WHEN rn = 38 THEN sl WHEN rn > 38 THEN alpha * lo END"),
    ),
)
_plain(
    "win_26_volatility_regime",
    {"regime": "vol_regime"},
    "bn",
    """SELECT symbol, ts, CASE WHEN rn > 100 AND atr IS NOT NULL AND len(l) >= 10 THEN CASE WHEN len(list_filter(l, lambda x: x <= atr))::DOUBLE / len(l) < 0.25 THEN 0
    WHEN len(list_filter(l, lambda x: x <= atr))::DOUBLE / len(l) > 0.75 THEN 2 ELSE 1 END END AS regime FROM v""",
    tr=_TR_CTE,
    a=recursion("tr", atr=wilder_coef("tr", 14)),
    v=f"SELECT *, list(atr) FILTER (atr IS NOT NULL) {over(100)} AS l FROM a",
)


@query(
    "win_27_higher_timeframe",
    K,
    "h_safe h_final",
    with_(
        "bn",
        """SELECT b.symbol, b.ts, p.s AS h_safe, q.s AS h_final FROM nb b LEFT JOIN v p ON p.symbol = b.symbol AND p.k = b.k - 1
        LEFT JOIN v q ON q.symbol = b.symbol AND q.k = b.k""",
        nb="SELECT *, (rn - 1) // 4 AS k FROM bn",
        m="SELECT symbol, k, arg_max(close, ts) AS close FROM nb GROUP BY 1, 2 HAVING count(*) = 4",
        v="SELECT symbol, k, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY k) >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY k ROWS 4 PRECEDING) END AS s FROM m",
    ),
)
def _(t: Tables) -> DataFrame:
    inner = ("sma", {"period": 5})
    return I.higher_timeframe(I.higher_timeframe(t.bars, "h_safe", inner, 4), "h_final", inner, 4, lookahead=True)


def _reference(t: Tables, symbol: str = "S1") -> DataFrame:
    return t.bars.where(F.col("symbol") == symbol).select("ts", F.col("close").alias("ref"))


_ASOF_REF = """SELECT bn.*, r.ref FROM bn ASOF LEFT JOIN (SELECT ts, close AS ref FROM bars WHERE symbol = 'S1') r ON bn.ts >= r.ts"""
_CO_CTES = {
    "j": _ASOF_REF,
    "d": f"SELECT *, CASE WHEN b IS NOT NULL THEN a END AS x, CASE WHEN a IS NOT NULL THEN b END AS y FROM (SELECT *, close - {lag('close')} AS a, ref - {lag('ref')} AS b FROM j)",
    "f": f"SELECT *, count(x) {over(24)} AS k, stddev_pop(x) {over(24)} AS sx, stddev_pop(y) {over(24)} AS sy, corr(x, y) {over(24)} AS c, covar_samp(x, y) {over(24)} AS cv FROM d",
}


@query(
    "win_28_rolling_comovement",
    K,
    "corr beta",
    with_(
        "bn",
        """SELECT symbol, ts, CASE WHEN rn > 24 AND k >= 12 AND sx > 0 AND sy > 0 THEN c END AS corr,
        CASE WHEN rn > 24 AND k >= 12 AND sy > 0 THEN cv / (sy * sy) END AS beta FROM f""",
        **_CO_CTES,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    # a week is the natural slice of weekly bars seen across all symbols
    joined = asof.asof_join(t.bars, _reference(t), ["ref"], keys=())
    return I.rolling_comovement(joined, "ref", 24)


@query("win_14_lead_lag_return", K, "lead_ret", with_("bn", f"SELECT symbol, ts, CASE WHEN {lag('ref', 3)} > 0 THEN ({lag('ref', 2)} - {lag('ref', 3)}) / {lag('ref', 3)} END AS lead_ret FROM j", j=_ASOF_REF))
def _(t: Tables) -> DataFrame:
    joined = asof.asof_join(t.bars, _reference(t), ["ref"], keys=())
    w = I.Axis().w
    now, before = F.lag("ref", 2).over(w), F.lag("ref", 3).over(w)
    return joined.withColumn("lead_ret", F.when(before > 0, (now - before) / before))


@query(
    "win_29_order_flow",
    K,
    "taker imbalance flow pnl intensity",
    with_(
        "bn",
        f"""SELECT symbol, ts, {full('avg(taker_ratio)', 20)} AS taker, CASE WHEN rn >= 14 THEN CASE WHEN sum(buy_volume + sell_volume) {over(14)} > 0
        THEN sum(buy_volume - sell_volume) {over(14)} / sum(buy_volume + sell_volume) {over(14)} ELSE 0 END END AS imbalance,
        {full('sum(net_flow)', 20)} AS flow, {full('sum(total_pnl)', 20)} AS pnl, intensity FROM r""",
        s="SELECT *, CASE WHEN volume > 30 THEN buy_volume / volume END AS share FROM bn",
        r=recursion(
            "s",
            intensity=(
                "CASE WHEN rn = 10 THEN 0 WHEN rn > 10 THEN CASE WHEN share IS NULL THEN 1 ELSE 9.0::DOUBLE / 11 END END",
                f"CASE WHEN rn = 10 THEN avg(share) {over(10)} WHEN rn > 10 THEN CASE WHEN share IS NULL THEN 0 ELSE 2.0::DOUBLE / 11 * share END END",
            ),
        ),
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    bars = t.bars.withColumn("share", F.when(F.col("volume") > 30, F.col("buy_volume") / F.col("volume")))
    return I.add(
        bars,
        {
            "taker": "taker_ratio_mean",
            "imbalance": "buy_sell_imbalance",
            "flow": "position_flow",
            "pnl": "pnl_flow",
            "intensity": ("trade_intensity", {"column": "share"}),
        },
    )


_F_RN = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM event_funding"


@query(
    "win_30_funding_zscore",
    K,
    "z",
    with_(
        "event_funding",
        f"""SELECT symbol, ts, CASE WHEN rn > 168 AND stddev_pop(funding_rate) {prior(168)} > 0 THEN
        (funding_rate - avg(funding_rate) {prior(168)}) / stddev_pop(funding_rate) {prior(168)} END AS z FROM f""",
        f=_F_RN,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.funding import funding_features

    return funding_features(t.event_funding).withColumn("z", F.col("funding_zscore"))


@query(
    "win_31_next_funding",
    K,
    "predicted",
    with_("event_funding", "SELECT symbol, ts, lead(funding_rate) OVER (PARTITION BY symbol ORDER BY ts) AS predicted FROM event_funding"),
    digits=9,
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.funding import funding_features

    return funding_features(t.event_funding, lookahead=True).withColumn("predicted", F.col("predicted_funding"))


@query(
    "win_32_running_flow",
    K,
    "cvd net_longs net_shorts net_delta",
    with_(
        "bars",
        f"""SELECT symbol, ts, sum(buy_volume - sell_volume) {over()} AS cvd, sum(opens_long - closes_long) {over()} AS net_longs,
        sum(opens_short - closes_short) {over()} AS net_shorts, sum(opens_long - closes_long - opens_short + closes_short) {over()} AS net_delta FROM bars""",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return I.running_flow(t.bars)


@query(
    "win_32_inferred_positioning",
    K,
    "net_longs net_shorts net_delta",
    with_(
        "type_bars open_interest",
        f"""SELECT symbol, ts, sum(CASE WHEN c > 0 AND close > open THEN c WHEN c < 0 AND close < open THEN c ELSE 0 END) {over()} AS net_longs,
        sum(CASE WHEN c > 0 AND close < open THEN c WHEN c < 0 AND close > open THEN c ELSE 0 END) {over()} AS net_shorts,
        sum(CASE WHEN c > 0 AND close > open THEN c WHEN c < 0 AND close < open THEN c WHEN c > 0 AND close < open THEN -c
        WHEN c < 0 AND close > open THEN -c ELSE 0 END) {over()} AS net_delta FROM d""",
        d=f"SELECT b.*, o.oi_close - lag(o.oi_close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS c FROM type_bars b JOIN open_interest o ON o.symbol = b.symbol AND o.ts = b.ts // 86400000 * 86400000",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    with_oi = asof.bucket_lookup(t.type_bars, t.open_interest, {"oi_close": None}, "1d")
    return I.inferred_positioning(with_oi, "oi_close")


_LIB = "sma ema wma rsi macd macd_signal macd_hist stoch_k stoch_d atr bb_lower bb_mid bb_upper bb_bandwidth bb_percent zscore obv adx dmp dmn supertrend supertrend_direction"
_SD20 = full("stddev_samp(close)", 20)


@query(
    "win_33_library_set",
    K,
    _LIB,
    with_(
        "bn",
        f"""SELECT symbol, ts, sma, ema, wma, CASE WHEN rn > 14 THEN 100 * ag / (ag + al) END AS rsi, macd, macd_signal, macd - macd_signal AS macd_hist,
        k AS stoch_k, CASE WHEN rn >= 18 THEN avg(k) {over(3)} END AS stoch_d, CASE WHEN rn > 14 THEN aa END AS atr, sma - 2 * sd AS bb_lower, sma AS bb_mid,
        sma + 2 * sd AS bb_upper, 400 * sd / sma AS bb_bandwidth, CASE WHEN sd > 0 THEN (close - sma + 2 * sd) / (4 * sd) END AS bb_percent,
        CASE WHEN sd > 0 THEN (close - sma) / sd END AS zscore, sum(coalesce(sg, 0) * volume) {over()} AS obv,
        CASE WHEN rn >= 28 THEN ax END AS adx, dmp, dmn, CASE WHEN dir = 1 THEN lb ELSE ub END AS supertrend, dir AS supertrend_direction FROM k JOIN x USING (symbol, rn) JOIN st USING (symbol, rn)""",
        b=f"""SELECT *, {TR} AS tr, close - {lag('close')} AS d, sign(close - {lag('close')}) AS sg, {full('avg(close)', 20)} AS sma, {_SD20} AS sd,
        {_wma_sql('close', 20)} AS wma, {_TOP} AS hi, {_BOT} AS lo, high - {lag('high')} AS hm, {lag('low')} - low AS lm FROM bn""",
        r=recursion(
            "b",
            ema=ema_coef("close", 20),
            f=ema_coef("close", 12),
            s=ema_coef("close", 26),
            **{
                o: ("CASE WHEN rn = 2 THEN 0 WHEN rn > 2 THEN 13.0::DOUBLE / 14 END", f"CASE WHEN rn = 2 THEN {x} WHEN rn > 2 THEN 1.0::DOUBLE / 14 * {x} END")
                for o, x in {"ag": "greatest(d, 0)", "al": "greatest(-d, 0)", "aa": "tr", "au": "(CASE WHEN hm > lm AND hm > 0 THEN hm ELSE 0 END)", "ad": "(CASE WHEN lm > hm AND lm > 0 THEN lm ELSE 0 END)"}.items()
            },
            aw=("CASE WHEN rn = 2 THEN 0 WHEN rn > 2 THEN 6.0::DOUBLE / 7 END", "CASE WHEN rn = 2 THEN tr WHEN rn > 2 THEN tr / 7 END"),
        ),
        xr="""SELECT symbol, rn, CASE WHEN aa > 0 THEN 100 * au / aa END AS dmp, CASE WHEN aa > 0 THEN 100 * ad / aa END AS dmn, CASE WHEN au + ad > 0 THEN 100 * abs(au - ad) / (au + ad) END AS dx FROM r WHERE rn > 14""",
        xx="SELECT symbol, rn - 14 AS rn, dmp, dmn, dx FROM xr",
        xs=recursion("xx", ax=("CASE WHEN rn = 1 THEN 0 ELSE 13.0::DOUBLE / 14 END", "CASE WHEN rn = 1 THEN dx ELSE dx / 14 END")),
        x="SELECT bn.symbol, bn.rn, dmp, dmn, ax FROM bn LEFT JOIN xs ON xs.symbol = bn.symbol AND xs.rn + 14 = bn.rn",
        bw="SELECT symbol, rn, close, CASE WHEN rn > 7 THEN (high + low) / 2 + 3 * aw END AS ub, CASE WHEN rn > 7 THEN (high + low) / 2 - 3 * aw END AS lb FROM r",
        st="""SELECT symbol, rn, 1 AS dir, ub, lb FROM bw WHERE rn = 1 UNION ALL SELECT symbol, rn, dir,
        CASE WHEN pu IS NOT NULL AND close <= pu AND close >= pl AND dir = -1 THEN least(ub, pu) ELSE ub END, CASE WHEN pu IS NOT NULL AND close <= pu AND close >= pl AND dir = 1 THEN greatest(lb, pl) ELSE lb END
        FROM (SELECT b.symbol, b.rn, b.close, b.ub, b.lb, s.ub AS pu, s.lb AS pl, CASE WHEN b.close > s.ub THEN 1 WHEN b.close < s.lb THEN -1 ELSE s.dir END AS dir FROM st s JOIN bw b ON b.symbol = s.symbol AND b.rn = s.rn + 1)""",
        m="SELECT *, f - s AS macd, CASE WHEN hi <> lo THEN 100 * (close - lo) / (hi - lo) WHEN hi = lo THEN 50 END AS rk FROM r",
        g=recursion("m", macd_signal=ema_coef("macd", 9)),
        k=f"SELECT *, CASE WHEN rn >= 16 THEN avg(rk) {over(3)} END AS k FROM g",
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return I.library_set(t.bars)


_REG_CTES = {
    "b": f"""SELECT *, coalesce({lag('close')}, close) AS pc, coalesce(high - {lag('high')}, 0) AS up, coalesce({lag('low')} - low, 0) AS dn FROM bn""",
    "c": """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
    CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM b""",
    "r": recursion(
        "c",
        atr=("CASE WHEN rn <= 14 THEN 0 ELSE 13.0::DOUBLE / 14 END", "CASE WHEN rn <= 14 THEN avg(tr) FILTER (rn <= 14) OVER (PARTITION BY symbol) ELSE tr / 14 END"),
        **{
            o: ("CASE WHEN rn <= 14 THEN 0 ELSE 13.0::DOUBLE / 14 END", f"CASE WHEN rn <= 14 THEN sum({x}) FILTER (rn <= 14) OVER (PARTITION BY symbol) ELSE {x} END")
            for o, x in {"ts_": "tr", "ps": "pdm", "ms": "mdm"}.items()
        },
    ),
    "d": "SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM (SELECT *, CASE WHEN ts_ > 0 THEN 100 * ps / ts_ ELSE 0 END AS pdi, CASE WHEN ts_ > 0 THEN 100 * ms / ts_ ELSE 0 END AS mdi FROM r)",
    "e": recursion("d", adx=("CASE WHEN rn <= 28 THEN 0 ELSE 13.0::DOUBLE / 14 END", "CASE WHEN rn <= 28 THEN avg(dx) FILTER (rn <= 28) OVER (PARTITION BY symbol) ELSE dx / 14 END")),
    "lab": f"""SELECT symbol, ts, atr, adx, CASE WHEN k < 10 THEN 'warmup' WHEN atr < q[1] THEN 'low' WHEN atr < q[2] THEN 'normal' ELSE 'high' END AS vol_regime,
    CASE WHEN rn <= 28 THEN 'warmup' WHEN adx <= 20 THEN 'chop' WHEN pdi > mdi THEN 'bull' ELSE 'bear' END AS trend_regime
    FROM (SELECT *, quantile_cont(atr, [0.33, 0.67]) {over(101)} AS q, count(atr) {over(101)} AS k FROM e)""",
}


@query("win_35_regime_labels", "symbol ts vol_regime trend_regime", "atr adx", with_("bn", "SELECT * FROM lab", **_REG_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return I.regime_labels(t.bars)


@query(
    "win_35_regime_shares",
    "symbol label n",
    "pct",
    with_("bn", "SELECT symbol, trend_regime AS label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol) AS pct FROM lab WHERE trend_regime <> 'warmup' GROUP BY 1, 2", **_REG_CTES),
)
def _(t: Tables) -> DataFrame:
    return I.label_shares(I.regime_labels(t.bars), "trend_regime")
