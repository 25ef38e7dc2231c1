"""Ledgers, equity, metrics: a moving-average cross on weekly bars of every supplier."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import asof, metrics, pnl
from marketspark.operators import indicators as I
from marketspark.operators.series import parts_for, series_window
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import ema_coef, full, lag, over, recursion, with_
from marketspark.sources.tables import Tables

COSTS = pnl.Costs(fraction=0.2, leverage=2.0)
WEEK_MS = 604_800_000


def cross_target(t: Tables) -> DataFrame:
    """Long while the fast mean is above the slow one, short below, flat before both exist."""
    df = I.add(t.placed_bars, {"fast": ("sma", {"period": 5}), "slow": ("sma", {"period": 20})})
    target = F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") <= F.col("slow"), -1).otherwise(0)
    return df.withColumn("target", target).select("symbol", "ts", "open", "high", "low", "close", "volume", "fast", "slow", "target")


def trades_of(t: Tables) -> DataFrame:
    return pnl.ledger(cross_target(t), COSTS)


def curve_of(t: Tables) -> DataFrame:
    return pnl.equity_on_bars(t.bars, trades_of(t))


TARGET = f"""SELECT *, CASE WHEN fast > slow THEN 1 WHEN fast <= slow THEN -1 ELSE 0 END AS target
    FROM (SELECT symbol, ts, rn, n, open, high, low, close, volume, {full('avg(close)', 5)} AS fast, {full('avg(close)', 20)} AS slow FROM bn)"""


def ledger_ctes(target: str = "tg", keys: str = "symbol", f: float = 0.2, lev: float = 2.0, fee: float = 0.00034, slip: float = 0.0005, initial: float = 10000, rate: str | None = None, stop: float | None = None) -> dict[str, str]:
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    pay = f"coalesce(lead(close * {rate}) OVER {w}, 0)" if rate else "0"
    touch = f"CASE WHEN (target > 0 AND nlow <= e * (1 - {stop}::DOUBLE)) OR (target < 0 AND nhigh >= e * (1 + {stop}::DOUBLE)) THEN nts END" if stop else "NULL::BIGINT"
    cut = "pay" if not stop else "CASE WHEN st IS NULL OR nts <= st THEN pay ELSE 0 END"
    fl, ph, sl = f"({f}::DOUBLE * {lev}::DOUBLE)", f"{fee}::DOUBLE", f"{slip}::DOUBLE"
    return {
        "l1": f"""SELECT *, CASE WHEN target <> coalesce(lag(target) OVER {w}, 0) THEN 1 ELSE 0 END AS nw, lead(ts) OVER {w} AS nts, lead(close) OVER {w} AS nclose,
        lead(low) OVER {w} AS nlow, lead(high) OVER {w} AS nhigh, {pay} AS pay FROM {target}""",
        "l2": f"SELECT *, sum(nw) OVER {w} AS run FROM l1",
        "l3": f"SELECT *, first_value(close) OVER (PARTITION BY {keys}, run ORDER BY ts) * (1 + target * {sl}) AS e FROM l2 WHERE target <> 0",
        "l4": f"SELECT *, min(t) OVER (PARTITION BY {keys}, run) AS st FROM (SELECT *, {touch} AS t FROM l3)",
        "l5": f"""SELECT {keys}, run, min(ts) AS entry_ts, any_value(target) AS side, any_value(e) AS entry_price, CASE WHEN any_value(st) IS NOT NULL THEN any_value(st) ELSE coalesce(arg_max(nts, ts), max(ts)) END AS exit_ts,
        CASE WHEN any_value(st) IS NOT NULL THEN any_value(e) * (1 - any_value(target) * {stop or 0}::DOUBLE) WHEN max(ts) = max(ts) FILTER (nts IS NULL) THEN arg_max(close, ts)
        ELSE arg_max(nclose, ts) * (1 - any_value(target) * {sl}) END AS exit_price,
        CASE WHEN any_value(st) IS NOT NULL THEN 'stop_loss' WHEN max(ts) = max(ts) FILTER (nts IS NULL) THEN 'end' ELSE 'signal' END AS exit_reason, count(*) AS bars_held, sum({cut}) AS paid FROM l4 GROUP BY {keys}, run""",
        "l6": f"""SELECT *, greatest(0, 1 - {fl} * {ph} + gross - fund) AS multiplier FROM (SELECT *, {fl} * (side * (exit_price / entry_price - 1) - exit_price / entry_price * {ph}) AS gross,
        side * {fl} * paid / entry_price AS fund FROM l5)""",
        "l7": f"SELECT *, {initial} * exp(sum(ln(multiplier)) OVER (PARTITION BY {keys} ORDER BY entry_ts)) AS equity FROM l6",
        "trades": f"""SELECT *, st0 * gross AS pnl, st0 * gross / (st0 * (1 - {fl} * {ph}) - st0 * fund) * 100 AS pnl_pct, st0 * {f}::DOUBLE / entry_price AS size, st0 * {fl} * {ph} AS entry_fee, -st0 * fund AS funding
        FROM (SELECT *, coalesce(lag(equity) OVER (PARTITION BY {keys} ORDER BY entry_ts), {initial}) AS st0 FROM l7)""",
    }


LEDGER = {"tg": TARGET, **ledger_ctes()}
CURVE = {
    **LEDGER,
    "curve": f"""SELECT *, CASE WHEN lm IS NULL THEN 0 ELSE equity / coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 10000) - 1 END AS ret FROM (SELECT b.symbol, b.ts, b.close, x.lm, 10000 * exp(coalesce(sum(x.lm) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0)) AS equity
    FROM bn b LEFT JOIN (SELECT symbol, exit_ts, sum(ln(multiplier)) AS lm FROM trades GROUP BY 1, 2) x ON x.symbol = b.symbol AND x.exit_ts = b.ts)""",
}
_TRADE_KEYS = "symbol entry_ts exit_ts side exit_reason bars_held"
_TRADE_VALS = "entry_price exit_price size pnl pnl_pct entry_fee funding multiplier equity"


@query("pnl_01_trade_ledger", _TRADE_KEYS, _TRADE_VALS, with_("bn", "SELECT * FROM trades", **LEDGER), digits=5)
def _(t: Tables) -> DataFrame:
    return trades_of(t)


_RATE = "SELECT tg.*, fr.funding_rate AS rate FROM tg LEFT JOIN (SELECT ts // 604800000 AS wk, avg(funding_rate) AS funding_rate FROM funding GROUP BY 1) fr ON fr.wk = tg.ts // 604800000"


def _with_rate(t: Tables) -> DataFrame:
    weekly = t.funding.groupBy(F.floor(F.col("ts") / WEEK_MS).alias("wk")).agg(F.avg("funding_rate").alias("rate"))
    return cross_target(t).withColumn("wk", F.floor(F.col("ts") / WEEK_MS)).join(weekly, "wk", "left")


@query(
    "pnl_02_funding_while_held",
    _TRADE_KEYS,
    _TRADE_VALS,
    with_("bn funding", "SELECT * FROM trades", tg=TARGET, tr=_RATE, **ledger_ctes("tr", rate="coalesce(rate, 0)")),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return pnl.ledger(_with_rate(t), COSTS, funding="rate")


@query(
    "pnl_03_stop_loss",
    _TRADE_KEYS,
    _TRADE_VALS,
    with_("bn funding", "SELECT * FROM trades", tg=TARGET, tr=_RATE, **ledger_ctes("tr", rate="coalesce(rate, 0)", stop=0.08)),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    costs = pnl.Costs(fraction=0.2, leverage=2.0, stop_loss=0.08)
    return pnl.ledger(_with_rate(t), costs, funding="rate")


_EQ_METRICS = "final_equity max_drawdown_pct total_return_pct sharpe sortino calmar recovery_factor"
_EQ_SQL = """SELECT *, CASE WHEN n > 1 AND s > 0 THEN m / s * sqrt(52) ELSE 0 END AS sharpe, CASE WHEN nd > 1 AND ds > 0 THEN m / ds * sqrt(52) ELSE 0 END AS sortino,
    CASE WHEN max_drawdown_pct <> 0 AND years > 0 THEN total_return_pct / years / abs(max_drawdown_pct) ELSE 0 END AS calmar,
    CASE WHEN max_drawdown_pct <> 0 THEN abs(total_return_pct / max_drawdown_pct) ELSE 0 END AS recovery_factor FROM (SELECT {keys}, count(ret) AS n, arg_max(equity, ts) AS final_equity,
    (arg_max(equity, ts) / 10000 - 1) * 100 AS total_return_pct, min(dd) AS max_drawdown_pct, avg(ret) AS m, stddev_pop(ret) AS s, stddev_pop(ret) FILTER (ret < 0) AS ds, count(*) FILTER (ret < 0) AS nd,
    (max(ts) - min(ts)) / 31557600000 AS years FROM (SELECT *, (equity - pk) / pk * 100 AS dd FROM (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY {keys} ORDER BY ts)) AS pk FROM curve)) GROUP BY {keys})"""


@query("pnl_04_equity_metrics", "symbol n", _EQ_METRICS, with_("bn", _EQ_SQL.format(keys="symbol"), **CURVE), digits=5)
def _(t: Tables) -> DataFrame:
    return pnl.equity_metrics(curve_of(t), 52.0)


GRID = [(3, 12), (5, 20), (8, 26), (13, 40)]


def grid_target(t: Tables) -> DataFrame:
    """All parameter sets in one plan: the strategy name joins the keys."""
    wanted = {f"m{p}": ("sma", {"period": p}) for p in sorted({p for pair in GRID for p in pair})}
    base = I.add(t.placed_bars, wanted).select("symbol", "ts", "high", "low", "close", *wanted)
    runs = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("strategy"), F.col(f"m{a}").alias("fast"), F.col(f"m{b}").alias("slow")) for a, b in GRID])
    flat = base.withColumn("_r", F.explode(runs)).select("symbol", "ts", "high", "low", "close", "_r.*")
    return flat.withColumn("target", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") <= F.col("slow"), -1).otherwise(0))


RUN_KEYS = ("strategy", "symbol")


def grid_curve(t: Tables) -> DataFrame:
    bars = grid_target(t)
    parts = parts_for(t.spark, len(GRID) * t.deal_count)
    return pnl.equity_on_bars(bars, pnl.ledger(bars.repartition(parts, *RUN_KEYS), COSTS, keys=RUN_KEYS), keys=RUN_KEYS, parts=parts)


def grid_metrics(t: Tables) -> DataFrame:
    return pnl.equity_metrics(grid_curve(t), 52.0, keys=RUN_KEYS)


_GRID_SRC = " UNION ALL ".join(
    f"SELECT '{a}/{b}' AS strategy, symbol, ts, high, low, close, {full('avg(close)', a)} AS fast, {full('avg(close)', b)} AS slow FROM bn" for a, b in GRID
)
GRID_CTES = {
    "gs": _GRID_SRC,
    "gt": "SELECT *, CASE WHEN fast > slow THEN 1 WHEN fast <= slow THEN -1 ELSE 0 END AS target FROM gs",
    **ledger_ctes("gt", keys="strategy, symbol"),
    "curve": """SELECT *, CASE WHEN lm IS NULL THEN 0 ELSE equity / coalesce(lag(equity) OVER (PARTITION BY strategy, symbol ORDER BY ts), 10000) - 1 END AS ret FROM (SELECT b.strategy, b.symbol, b.ts, b.close, x.lm,
    10000 * exp(coalesce(sum(x.lm) OVER (PARTITION BY b.strategy, b.symbol ORDER BY b.ts), 0)) AS equity
    FROM gt b LEFT JOIN (SELECT strategy, symbol, exit_ts, sum(ln(multiplier)) AS lm FROM trades GROUP BY 1, 2, 3) x ON x.strategy = b.strategy AND x.symbol = b.symbol AND x.exit_ts = b.ts)""",
    "met": _EQ_SQL.format(keys="strategy, symbol"),
}


@query("pnl_05_parameter_sweep", "strategy symbol n", _EQ_METRICS, with_("bn", "SELECT * FROM met", **GRID_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return grid_metrics(t)


@query(
    "srt_02_best_runs",
    "strategy symbol",
    "sharpe total_return_pct",
    with_("bn", "SELECT * FROM met ORDER BY sharpe DESC, strategy, symbol LIMIT 10", **GRID_CTES),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return pnl.compare(grid_metrics(t), "sharpe", 10)


@query(
    "srt_02_best_per_symbol",
    "strategy symbol rank",
    "total_return_pct",
    with_("bn", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY total_return_pct DESC, strategy) AS rank FROM met) WHERE rank <= 2", **GRID_CTES),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return pnl.compare(grid_metrics(t), "total_return_pct", 2, within=["symbol"])


@query(
    "pnl_05_robustness",
    "strategy symbols profitable",
    "avg_return avg_sharpe improvement",
    with_(
        "bn",
        """SELECT strategy, count(*) AS symbols, count(*) FILTER (total_return_pct > 0) AS profitable, avg(total_return_pct) AS avg_return, avg(sharpe) AS avg_sharpe,
        avg(sharpe) - max(CASE WHEN strategy = '5/20' THEN avg(sharpe) END) OVER () AS improvement FROM met GROUP BY 1""",
        **GRID_CTES,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.portfolio import robustness

    return robustness(grid_metrics(t), default="5/20")


_EMA_TARGET = {
    "em": recursion("bn", fast=ema_coef("close", 10), slow=ema_coef("close", 30)),
    "tg": "SELECT *, CASE WHEN fast > slow THEN 1 WHEN fast <= slow THEN -1 ELSE 0 END AS target FROM em",
    **ledger_ctes(),
}


def trend_follow(t: Tables) -> DataFrame:
    df = I.add(t.bars, {"fast": ("ema", {"period": 10}), "slow": ("ema", {"period": 30})})
    return df.withColumn("target", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") <= F.col("slow"), -1).otherwise(0))


@query("pnl_07_trend_follow", _TRADE_KEYS, _TRADE_VALS, with_("bn", "SELECT * FROM trades", **_EMA_TARGET), digits=5)
def _(t: Tables) -> DataFrame:
    return pnl.ledger(trend_follow(t), COSTS)


_SUMMARY = "win_rate avg_win_pct avg_loss_pct profit_factor expectancy payoff long_win_rate short_win_rate avg_duration best_pct worst_pct"
SUMMARY_SQL = """SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) AS win_rate,
    coalesce(avg(pnl_pct) FILTER (pnl > 0), 0) AS avg_win_pct, coalesce(avg(pnl_pct) FILTER (pnl <= 0), 0) AS avg_loss_pct,
    coalesce(sum(pnl) FILTER (pnl > 0), 0) / coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 1) AS profit_factor, avg(pnl) AS expectancy,
    coalesce(abs(coalesce(avg(pnl_pct) FILTER (pnl > 0), 0) / nullif(avg(pnl_pct) FILTER (pnl <= 0), 0)), 0) AS payoff,
    coalesce(avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) FILTER (side > 0), 0) AS long_win_rate, coalesce(avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) FILTER (side < 0), 0) AS short_win_rate,
    avg((exit_ts - entry_ts) / 604800000) AS avg_duration, max(pnl_pct) AS best_pct, min(pnl_pct) AS worst_pct FROM trades GROUP BY 1"""


@query("agg_11_trade_summary", "symbol trades wins", _SUMMARY, with_("bn", SUMMARY_SQL, **LEDGER), digits=5)
def _(t: Tables) -> DataFrame:
    return pnl.trade_summary(trades_of(t), bar_ms=WEEK_MS)


@query(
    "agg_12_streaks",
    "symbol max_wins max_losses",
    "",
    with_(
        "bn",
        "SELECT symbol, coalesce(max(c) FILTER (won), 0) AS max_wins, coalesce(max(c) FILTER (NOT won), 0) AS max_losses FROM (SELECT symbol, won, g, count(*) AS c FROM k GROUP BY 1, 2, 3) GROUP BY 1",
        **LEDGER,
        k="SELECT symbol, pnl > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) - row_number() OVER (PARTITION BY symbol, pnl > 0 ORDER BY entry_ts) AS g FROM trades",
    ),
)
def _(t: Tables) -> DataFrame:
    return pnl.streaks(trades_of(t))


@query(
    "agg_13_monthly_returns",
    "symbol month",
    "return_pct",
    with_(
        "bn",
        """SELECT symbol, month, (coalesce(lead(f) OVER (PARTITION BY symbol ORDER BY month), l) - f) / f * 100 AS return_pct FROM
        (SELECT symbol, strftime(make_timestamp_ms(ts), '%Y-%m') AS month, arg_min(equity, ts) AS f, arg_max(equity, ts) AS l FROM curve GROUP BY 1, 2)""",
        **CURVE,
    ),
)
def _(t: Tables) -> DataFrame:
    return pnl.monthly_returns(curve_of(t))


_METRICS = "annual_return annual_vol sharpe sortino max_drawdown calmar skew kurtosis autocorr1"
METRICS_SQL = """SELECT symbol, n, CASE WHEN least <= -1 THEN -1 ELSE exp(lg * {p} / n) - 1 END AS annual_return, s * sqrt({p}) AS annual_vol, m / s * sqrt({p}) AS sharpe, m / dn * sqrt({p}) AS sortino,
    mdd AS max_drawdown, (exp(lg * {p} / n) - 1) / abs(mdd) AS calmar, m3 / pow(v, 1.5) AS skew, m4 / (v * v) AS kurtosis, ac / (n * v) AS autocorr1 FROM (
    SELECT symbol, count(*) AS n, sum(ln(1 + ret)) AS lg, min(ret) AS least, any_value(mu) AS m, stddev_samp(ret) AS s, var_pop(ret) AS v, sqrt(avg(ret * ret) FILTER (ret < 0)) AS dn, min(eq / pk - 1) AS mdd,
    avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4, sum((ret - mu) * (lr - mu)) AS ac FROM (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM (
    SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS lr, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts)) AS eq FROM {src})) GROUP BY 1)"""


@query("agg_10_return_metrics", "symbol n", _METRICS, with_("panel", METRICS_SQL.format(p=13.0, src="panel")), digits=5)
def _(t: Tables) -> DataFrame:
    return metrics.return_metrics(t.panel, 13.0)


@query(
    "agg_14_liquidity",
    "symbol",
    "adv_usd daily_vol adv_recent vol_recent",
    with_(
        "bn",
        """SELECT symbol, avg(nv) / 7 AS adv_usd, stddev_samp(lr) * sqrt(1.0::DOUBLE / 7) AS daily_vol, avg(nv) FILTER (rn > n - 26) / 7 AS adv_recent,
        least(0.5, stddev_samp(lr) FILTER (rn > n - 26) * sqrt(1.0::DOUBLE / 7)) AS vol_recent FROM l GROUP BY 1""",
        l=f"SELECT *, close * volume AS nv, ln(close / {lag('close')}) AS lr FROM bn",
    ),
)
def _(t: Tables) -> DataFrame:
    recent = metrics.liquidity(t.bars, 1 / 7, recent=26, vol_cap=0.5).withColumnsRenamed({"adv_usd": "adv_recent", "daily_vol": "vol_recent"})
    return metrics.liquidity(t.bars, 1 / 7).join(recent, "symbol")


_Z95, _Z99 = NormalDist().inv_cdf(0.05), NormalDist().inv_cdf(0.01)


def _cf(z: float) -> str:
    return f"abs((m + ({z} + {(z * z - 1) / 6} * sk + {(z**3 - 3 * z) / 24} * ku - {(2 * z**3 - 5 * z) / 36} * sk * sk) * s) * sqrt(24)) * 10000"


_VAR_SQL = f"""SELECT symbol, n, m AS mean_return, s AS std_return, sk AS skew, ku AS kurtosis, abs(l[k + 1] * sqrt(24)) * 10000 AS historical_var_95, abs((m + {_Z95} * s) * sqrt(24)) * 10000 AS parametric_var_95,
    {_cf(_Z95)} AS var_95, {_cf(_Z99)} AS var_99, abs(list_avg(l[1:greatest(1, k)]) * sqrt(24)) * 10000 AS cvar_95 FROM (SELECT symbol, count(*) AS n, any_value(mu) AS m, any_value(sd) AS s,
    avg(pow((ret - mu) / sd, 3)) AS sk, avg(pow((ret - mu) / sd, 4)) - 3 AS ku, list_sort(list(ret)) AS l, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS k
    FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM panel) GROUP BY 1) WHERE n >= 5"""


@query("agg_22_value_at_risk", "symbol n", "mean_return std_return skew kurtosis historical_var_95 parametric_var_95 var_95 var_99 cvar_95", with_("panel", _VAR_SQL), digits=5)
def _(t: Tables) -> DataFrame:
    return metrics.value_at_risk(t.panel, 10_000.0)


_DD_SQL = """SELECT symbol, mdd AS max_dd, peak_idx, trough_idx, trough_idx - peak_idx AS dd_bars, wet AS time_in_drawdown, coalesce(nd, 0) AS n_deep, coalesce(ml, 0) AS max_dd_bars, coalesce(al, 0) AS avg_recovery
    FROM (SELECT symbol, min(dd) AS mdd, arg_min(i, row(dd, i)) AS trough_idx, arg_min(ap, row(dd, i)) AS peak_idx, avg(CASE WHEN dd < 0 THEN 1.0::DOUBLE ELSE 0 END) AS wet FROM d2 GROUP BY 1)
    LEFT JOIN (SELECT symbol, count(*) FILTER (d < -0.05) AS nd FROM (SELECT symbol, sp, min(dd) AS d FROM d2 WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1) USING (symbol)
    LEFT JOIN (SELECT symbol, max(c) AS ml, avg(c) AS al FROM (SELECT symbol, ls, count(*) AS c FROM (SELECT *, sum(1 - low) OVER (PARTITION BY symbol ORDER BY ts) AS ls FROM d2) WHERE low = 1 GROUP BY 1, 2) GROUP BY 1) USING (symbol)"""
_DD_CTES = {
    "d1": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, max(equity) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM curve",
    "d2": """SELECT *, (equity - pk) / pk AS dd, min(i) OVER (PARTITION BY symbol, pk) AS ap, CASE WHEN equity < pk * 0.999::DOUBLE THEN 1 ELSE 0 END AS low,
    sum(CASE WHEN equity < pk THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS sp FROM d1""",
}


@query("win_37_drawdowns", "symbol peak_idx trough_idx dd_bars n_deep max_dd_bars", "max_dd time_in_drawdown avg_recovery", with_("bn", _DD_SQL, **CURVE, **_DD_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return pnl.drawdowns(curve_of(t))


@query(
    "win_36_regime_performance",
    "symbol regime trades",
    "win_rate avg_pnl_pct total_pnl_pct",
    with_(
        "bn",
        """SELECT symbol, regime, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) AS win_rate, avg(pnl_pct) AS avg_pnl_pct, sum(pnl_pct) AS total_pnl_pct FROM (
        SELECT t.*, r.regime FROM trades t ASOF JOIN rg r ON r.symbol = t.symbol AND r.ts >= t.entry_ts) WHERE regime IS NOT NULL GROUP BY 1, 2""",
        **LEDGER,
        rg="""SELECT symbol, ts, CASE WHEN m > 0.05 THEN 'bull' WHEN m < -0.05 THEN 'bear' WHEN m IS NOT NULL THEN 'sideways' END AS regime FROM (
        SELECT b.symbol, b.ts, (b.close - p.close) / p.close AS m FROM bn b LEFT JOIN bn p ON p.symbol = b.symbol AND p.rn = b.rn - least(720, b.n // 4) WHERE b.n >= 100)""",
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return pnl.by_regime(trades_of(t), t.bars, parts=parts_for(t.spark, 2 * t.deal_count))


@query(
    "srt_04_without_best_trades",
    "symbol trades dependent",
    "return_without_pct sharpe_without",
    with_(
        "bn",
        """SELECT symbol, count(*) AS trades, sum(pnl) FILTER (k > 5) / 10000 * 100 AS return_without_pct, CASE WHEN stddev_samp(pnl_pct / 100) FILTER (k > 5) > 0 THEN avg(pnl_pct / 100) FILTER (k > 5) / stddev_samp(pnl_pct / 100) FILTER (k > 5) * sqrt(8760) ELSE 0 END AS sharpe_without,
        sum(pnl) > 0 AND sum(pnl) FILTER (k <= 5) > 0.5 * sum(pnl) AS dependent FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, entry_ts) AS k FROM trades) GROUP BY 1 HAVING count(*) > 5""",
        **LEDGER,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return pnl.without_best(trades_of(t))


@query(
    "win_38_regime_features",
    "symbol ts ready",
    "log_ret realised_vol funding",
    with_(
        "type_bars event_funding",
        f"""SELECT symbol, ts, lr AS log_ret, CASE WHEN rn > 24 THEN stddev_pop(lr) {over(24)} ELSE 0 END AS realised_vol, coalesce(f.funding_rate, 0) AS funding, rn > 24 AS ready FROM l LEFT JOIN event_funding f USING (symbol, ts)""",
        l=f"SELECT *, CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) ELSE 0 END AS lr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM type_bars",
    ),
    digits=7,
)
def _(t: Tables) -> DataFrame:
    return metrics.hmm_features(asof.bucket_lookup(t.type_bars, t.event_funding, {"funding_rate": None}, "1h"))


@query(
    "win_39_recent_volatility",
    "symbol",
    "current_vol",
    with_("panel", "SELECT symbol, stddev_pop(ret) * sqrt(13) AS current_vol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM panel) WHERE k <= 20 GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    return metrics.recent_vol(t.panel, 13.0)
