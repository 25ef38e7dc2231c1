"""Resampling, significance, cross-validation and decay."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import pnl, stats
from marketspark.operators import indicators as I
from marketspark.operators.series import parts_for
from marketspark.plans.queries_pnl import COSTS, LEDGER, cross_target, grid_metrics, ledger_ctes, trades_of
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import lag, normal_cdf_sql, normal_ppf_sql, over, with_
from marketspark.sources.tables import Tables

@query(
    "sta_01_block_length",
    "symbol n block",
    "",
    with_(
        "strategies",
        """SELECT symbol, n, CAST(greatest(2, least(ceil(pow(2.0 * m, 1.0::DOUBLE / 3) * pow(n, 1.0::DOUBLE / 3)), greatest(2, n // 4))) AS INT) AS block
        FROM (SELECT symbol, n, coalesce(min(CASE WHEN abs(c) < 1.96 / sqrt(n) * v THEN k END), any_value(most)) AS m FROM c GROUP BY 1, 2)""",
        x="SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM strategies",
        c="""SELECT a.symbol, a.n, t.k, least(a.n - 1, floor(10 * log10(a.n))) AS most, sum(a.x * b.x) AS c, (SELECT sum(x * x) FROM x WHERE x.symbol = a.symbol) AS v
        FROM x AS a, range(1, 190) AS t(k), x AS b WHERE t.k <= least(a.n - 1, floor(10 * log10(a.n))) AND b.symbol = a.symbol AND b.rn = a.rn - t.k GROUP BY a.symbol, a.n, t.k""",
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.block_length(t.strategies)


@query("sta_02_stationary_bootstrap", "symbol draw", "annual_return annual_vol sharpe sortino max_drawdown")
def _(t: Tables) -> DataFrame:
    return stats.bootstrap_metrics(t.strategies, 52.0)


@query("sta_03_confidence_intervals", "symbol", "annual_return_lo annual_return_hi annual_vol_lo annual_vol_hi sharpe_lo sharpe_hi sortino_lo sortino_hi max_drawdown_lo max_drawdown_hi")
def _(t: Tables) -> DataFrame:
    draws = stats.bootstrap_metrics(t.strategies, 52.0)
    return stats.intervals(draws, ["annual_return", "annual_vol", "sharpe", "sortino", "max_drawdown"])


_MOM = """SELECT symbol, count(*) AS n, any_value(mu) / any_value(sd) AS sharpe, avg(pow((ret - mu) / sp, 3)) AS skew, avg(pow((ret - mu) / sp, 4)) AS kurt
    FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd, stddev_pop(ret) OVER (PARTITION BY symbol) AS sp FROM panel) GROUP BY 1 HAVING count(*) >= 2"""


@query(
    "sta_04_sharpe_z",
    "symbol n",
    "sharpe skew kurt z",
    with_("panel", "SELECT *, (sharpe - 0.01) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM m", m=_MOM),
)
def _(t: Tables) -> DataFrame:
    return stats.sharpe_z(stats.sharpe_moments(t.panel), 0.01)


_Z = "sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)"


@query("sta_04_probabilistic_sharpe", "symbol n", "psr", with_("panel", f"SELECT symbol, n, {normal_cdf_sql(f'sharpe * {_Z}')} AS psr FROM m", m=_MOM))
def _(t: Tables) -> DataFrame:
    return stats.probabilistic_sharpe(stats.sharpe_moments(t.panel))


@query(
    "sta_04_deflated_sharpe",
    "symbol n trials",
    "trial_var threshold z dsr",
    with_(
        "panel",
        f"SELECT *, {normal_cdf_sql('z')} AS dsr FROM (SELECT *, (sharpe - threshold) * {_Z} AS z FROM m, h)",
        m=_MOM,
        f="SELECT count(sharpe) AS trials, coalesce(var_samp(sharpe), 0) AS trial_var FROM m",
        h=f"SELECT *, CASE WHEN trials <= 1 THEN 0 ELSE sqrt(trial_var) * ({1 - stats.EULER_MASCHERONI!r}::DOUBLE * {normal_ppf_sql('1 - 1.0::DOUBLE / trials')} + {stats.EULER_MASCHERONI!r}::DOUBLE * {normal_ppf_sql('1 - 1.0::DOUBLE / (trials * exp(1))')}) END AS threshold FROM f",
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.deflated_sharpe(stats.sharpe_moments(t.panel))


@query(
    "sta_18_legacy_dsr",
    "symbol n",
    "deflated",
    with_(
        "panel",
        f"""SELECT symbol, n, CASE WHEN n > 10 AND s > 0 AND i > 0 THEN s * {normal_cdf_sql(f"(s - {NormalDist().inv_cdf(1 - 1 / 17)!r}::DOUBLE / sqrt(n)) / sqrt(CASE WHEN i > 0 THEN i END)")} ELSE 0 END AS deflated
        FROM (SELECT *, (1 + 0.5::DOUBLE * s * s - skew * s + (kurt - 3) / 4 * s * s) / n AS i FROM (SELECT *, sharpe * sqrt(13) AS s FROM m))""",
        m=_MOM,
    ),
)
def _(t: Tables) -> DataFrame:
    m = stats.sharpe_moments(t.panel).withColumns({"sharpe": F.col("sharpe") * 13**0.5, "kurt": F.col("kurt") - 3})
    return stats.legacy_dsr(m)


@query(
    "sta_05_multiple_tests",
    "symbol family discovery",
    "p bonferroni holm bh",
    with_(
        "panel universe",
        """SELECT symbol, family, p, least(1, p * m) AS bonferroni, least(1, max(p * (m - k + 1)) OVER (PARTITION BY family ORDER BY k)) AS holm,
        least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh, coalesce(k <= max(CASE WHEN p <= k / m * 0.4::DOUBLE THEN k END) OVER (PARTITION BY family), false) AS discovery
        FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, symbol) AS k, count(*) OVER (PARTITION BY family) AS m FROM (SELECT m.symbol, u.r_name AS family, 1 / (1 + exp(2 * sharpe * sqrt(n))) AS p FROM m JOIN universe u USING (symbol)))""",
        m=_MOM,
    ),
)
def _(t: Tables) -> DataFrame:
    m = stats.sharpe_moments(t.panel).withColumn("p", 1 / (1 + F.exp(2 * F.col("sharpe") * F.sqrt("n"))))
    tests = m.join(t.universe.select("symbol", F.col("r_name").alias("family")), "symbol")
    return stats.multiple_tests(tests, family=["family"], fdr=0.4)


@query("sta_06_reality_check", "best strategies observations", "best_mean p_value")
def _(t: Tables) -> DataFrame:
    return stats.reality_check(t.strategies.withColumnRenamed("symbol", "strategy"))


_FOLDS5 = "CASE " + " ".join(f"WHEN rn - 1 < {i + 1} * n // 5 THEN {i}" for i in range(5)) + " END"
_FOLDED = f"SELECT *, ts AS t0, ts + 7257600000 AS t1, {_FOLDS5} AS fold FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM panel)"


def _folded(t: Tables) -> DataFrame:
    return stats.folds(t.panel, 5).withColumns({"t0": F.col("ts"), "t1": F.col("ts") + 7_257_600_000})


def _purge_sql(splits: str) -> str:
    return with_(
        "panel",
        """SELECT symbol, split, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT f.*, h.split, CASE WHEN list_contains(h.ids, fold) THEN 'test' ELSE 'train' END AS role FROM f JOIN h USING (symbol)
        WHERE list_contains(h.ids, fold) OR t1 < h.lo OR t0 > h.hi + 0.01::DOUBLE * h.span) GROUP BY 1, 2, 3""",
        f=_FOLDED,
        s=splits,
        h="SELECT symbol, split, ids, min(t0) AS lo, max(t1) AS hi, any_value(sp) AS span FROM (SELECT f.*, s.split, s.ids, max(t0) OVER (PARTITION BY symbol) - min(t0) OVER (PARTITION BY symbol) AS sp FROM f, s) WHERE list_contains(ids, fold) GROUP BY 1, 2, 3",
    )


_ONE = " UNION ALL ".join(f"SELECT '{i}' AS split, [{i}] AS ids" for i in range(5))
_TWO = " UNION ALL ".join(f"SELECT '{i}+{j}' AS split, [{i}, {j}] AS ids" for i, j in combinations(range(5), 2))


def _split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("sta_07_purged_kfold", "symbol split role n first_ts last_ts", "", _purge_sql(_ONE))
def _(t: Tables) -> DataFrame:
    return _split_sizes(stats.purged_split(_folded(t), 5))


@query("sta_08_combinatorial_cv", "symbol split role n first_ts last_ts", "", _purge_sql(_TWO))
def _(t: Tables) -> DataFrame:
    return _split_sizes(stats.purged_split(_folded(t), 5, tests=2))


@query(
    "join_11_purge",
    "symbol ts split role",
    "ret",
    with_(
        "panel",
        """SELECT f.symbol, f.ts, h.split, CASE WHEN h.split = CAST(fold AS VARCHAR) THEN 'test' ELSE 'train' END AS role, ret FROM f JOIN h USING (symbol) WHERE h.split = CAST(fold AS VARCHAR) OR t1 < h.lo OR t0 > h.hi + 0.01::DOUBLE * h.span""",
        f=_FOLDED,
        h="SELECT symbol, CAST(fold AS VARCHAR) AS split, min(t0) AS lo, max(t1) AS hi, any_value(sp) AS span FROM (SELECT *, max(t0) OVER (PARTITION BY symbol) - min(t0) OVER (PARTITION BY symbol) AS sp FROM f) GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.purged_split(_folded(t), 5)


@query(
    "sta_09_fold_sharpes",
    "symbol fold n",
    "sharpe",
    with_("panel", "SELECT symbol, fold, count(*) AS n, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) ELSE 0 END AS sharpe FROM f GROUP BY 1, 2", f=_FOLDED),
)
def _(t: Tables) -> DataFrame:
    return stats.fold_sharpes(_folded(t))


_TRAIN, _TEST = 12 * 2_592_000_000, 6 * 2_592_000_000
_WF_CTES = {
    "e": "SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM bn GROUP BY 1",
    "wn": f"SELECT symbol, k AS win, t0 + k * {_TEST} AS a, t0 + k * {_TEST} + {_TRAIN} AS b, t0 + k * {_TEST} + {_TRAIN} + {_TEST} AS c FROM e, range(0, 40) AS r(k) WHERE t0 + k * {_TEST} + {_TRAIN} + {_TEST} <= t1",
}


def _windows(t: Tables) -> DataFrame:
    return stats.walk_forward_windows(cross_target(t), 12, 6)


@query(
    "sta_10_walk_forward_windows",
    "symbol win role n first_ts last_ts",
    "",
    with_(
        "bn",
        """SELECT symbol, win, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT b.symbol, win, b.ts, CASE WHEN b.ts < w.b THEN 'train' ELSE 'test' END AS role FROM bn b JOIN wn w ON b.symbol = w.symbol AND b.ts >= w.a AND b.ts < w.c) GROUP BY 1, 2, 3""",
        **_WF_CTES,
    ),
)
def _(t: Tables) -> DataFrame:
    return _windows(t).groupBy("symbol", F.col("window").alias("win"), "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


WF_KEYS = ("symbol", "window", "role")


def walk_forward_metrics(t: Tables) -> DataFrame:
    bars = _windows(t)
    # a bar is tested once and trained on in the windows that overlap it
    parts = parts_for(t.spark, (1 + -(-_TRAIN // _TEST)) * t.deal_count)
    trades = pnl.ledger(bars.repartition(parts, *WF_KEYS), COSTS, keys=WF_KEYS)
    return pnl.equity_metrics(pnl.equity_on_bars(bars, trades, keys=WF_KEYS, parts=parts), 52.0, keys=WF_KEYS)


_WF_SQL = {
    **_WF_CTES,
    "tg": LEDGER["tg"],
    "wb": "SELECT t.symbol || '/' || win || '/' || CASE WHEN t.ts < w.b THEN 'train' ELSE 'test' END AS run_id, t.symbol AS sym, win, CASE WHEN t.ts < w.b THEN 'train' ELSE 'test' END AS role, t.* EXCLUDE (symbol, rn, n) FROM tg t JOIN wn w ON t.symbol = w.symbol AND t.ts >= w.a AND t.ts < w.c",
    **ledger_ctes("wb", keys="run_id"),
    "curve": """SELECT *, CASE WHEN lm IS NULL THEN 0 ELSE equity / coalesce(lag(equity) OVER (PARTITION BY run_id ORDER BY ts), 10000) - 1 END AS ret FROM (SELECT b.run_id, b.sym, b.role, b.ts, x.lm, 10000 * exp(coalesce(sum(x.lm) OVER (PARTITION BY b.run_id ORDER BY b.ts), 0)) AS equity
    FROM wb b LEFT JOIN (SELECT run_id, exit_ts, sum(ln(multiplier)) AS lm FROM trades GROUP BY 1, 2) x ON x.run_id = b.run_id AND x.exit_ts = b.ts)""",
    "m": "SELECT sym AS symbol, run_id, role, (arg_max(equity, ts) / 10000 - 1) * 100 AS tr, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(52) ELSE 0 END AS sh FROM curve GROUP BY 1, 2, 3",
}


@query(
    "sta_11_walk_forward_summary",
    "symbol windows",
    "is_return is_sharpe oos_return oos_sharpe combined_oos_return profitable_windows_pct degradation",
    with_(
        "bn",
        """SELECT symbol, count(*) FILTER (role = 'test') AS windows, avg(tr) FILTER (role = 'train') AS is_return, avg(sh) FILTER (role = 'train') AS is_sharpe, avg(tr) FILTER (role = 'test') AS oos_return, avg(sh) FILTER (role = 'test') AS oos_sharpe,
        (exp(sum(ln(1 + tr / 100)) FILTER (role = 'test')) - 1) * 100 AS combined_oos_return, avg(CASE WHEN tr > 0 THEN 100 ELSE 0 END) FILTER (role = 'test') AS profitable_windows_pct, avg(sh) FILTER (role = 'test') / avg(sh) FILTER (role = 'train') AS degradation FROM m GROUP BY 1""",
        **_WF_SQL,
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return stats.walk_forward_summary(walk_forward_metrics(t))


@query("sta_12_sign_flip_test", "symbol n significant", "p_value real_sharpe median_random_sharpe")
def _(t: Tables) -> DataFrame:
    return stats.sign_flip_test(trades_of(t))


@query("sta_13_trade_bootstrap", "symbol", "p5 p10 p25 p50 p75 p90 p95 dd_p5 dd_p25 dd_p50 dd_p75 dd_p95 prob_profit prob_ruin median_sharpe")
def _(t: Tables) -> DataFrame:
    return stats.trade_bootstrap(trades_of(t), 52.0)


_H = (1, 3, 6, 12)
_FWD = ", ".join(f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd_{h}" for h in _H)


@query("sta_14_forward_returns", "symbol ts", " ".join(f"fwd_{h}" for h in _H), with_("bars", f"SELECT symbol, ts, {_FWD} FROM bars"))
def _(t: Tables) -> DataFrame:
    return stats.forward_returns(t.bars, _H)


_SCORES = ("momentum", "flow")
_IC_BASE = f"SELECT *, close / {lag('close', 4)} - 1 AS momentum, net_flow AS flow, {_FWD} FROM bars"
_IC_LONG = " UNION ALL ".join(f"SELECT '{s}' AS signal, {h} AS horizon, {s} AS x, fwd_{h} AS y FROM b" for s in _SCORES for h in _H)
_RANK = "rank() OVER (PARTITION BY signal, horizon ORDER BY {c}) + (count(*) OVER (PARTITION BY signal, horizon, {c}) - 1) / 2"
_IC_CTES = {
    "b": _IC_BASE,
    "l": f"SELECT * FROM ({_IC_LONG}) WHERE x IS NOT NULL AND y IS NOT NULL",
    "r": f"SELECT *, {_RANK.format(c='x')} AS rx, {_RANK.format(c='y')} AS ry FROM l",
    "ic": "SELECT signal, horizon, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY 1, 2",
}


def _scored(t: Tables) -> DataFrame:
    w = I.Axis().w
    df = stats.forward_returns(t.bars, _H)
    return df.withColumns({"momentum": F.col("close") / F.lag("close", 4).over(w) - 1, "flow": F.col("net_flow")})


@query("sta_15_ic_curve", "signal horizon n", "ic", with_("bars", "SELECT * FROM ic", **_IC_CTES), digits=8)
def _(t: Tables) -> DataFrame:
    return stats.ic_curve(_scored(t), _SCORES, _H)


@query(
    "sta_15_ic_pearson_by_symbol",
    "symbol signal horizon n",
    "ic",
    with_(
        "bars",
        "SELECT symbol, signal, horizon, count(*) AS n, corr(x, y) AS ic FROM l GROUP BY 1, 2, 3",
        b=_IC_BASE,
        l="SELECT * FROM (" + " UNION ALL ".join(f"SELECT symbol, '{s}' AS signal, {h} AS horizon, {s} AS x, fwd_{h} AS y FROM b" for s in _SCORES for h in _H) + ") WHERE x IS NOT NULL AND y IS NOT NULL",
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.ic_curve(_scored(t), _SCORES, _H, method="pearson", least=5, by=["symbol"])


@query("sta_15_ic_intervals", "symbol", "ic_lo ic_hi")
def _(t: Tables) -> DataFrame:
    return stats.ic_intervals(_scored(t), "momentum", 1)


@query(
    "sta_16_half_life",
    "signal n_points",
    "tau half_life ic_initial r2",
    with_(
        "bars",
        """SELECT signal, n_points, CASE WHEN s < 0 THEN -1 / s END AS tau, CASE WHEN s < 0 THEN -ln(2) / s END AS half_life, exp(i) AS ic_initial, r2 FROM (
        SELECT signal, count(*) AS n_points, regr_slope(ln(abs(ic)), horizon) AS s, regr_intercept(ln(abs(ic)), horizon) AS i, regr_r2(ln(abs(ic)), horizon) AS r2 FROM ic WHERE ic <> 0 GROUP BY 1)""",
        **_IC_CTES,
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.half_life(stats.ic_curve(_scored(t), _SCORES, _H))


@query(
    "agg_27_histogram",
    "symbol bucket count",
    "low high pct",
    with_(
        "panel",
        """SELECT symbol, bucket, count(*) AS count, any_value(lo) + bucket * any_value(wd) AS low, any_value(lo) + (bucket + 1) * any_value(wd) AS high, count(*) / any_value(total) * 100 AS pct FROM (
        SELECT *, (hi - lo) / 20 AS wd, CAST(least(19, floor((ret - lo) / ((hi - lo) / 20))) AS INT) AS bucket FROM (SELECT *, min(ret) OVER (PARTITION BY symbol) AS lo, max(ret) OVER (PARTITION BY symbol) AS hi FROM q WHERE ret >= p5 AND ret <= p95)) GROUP BY 1, 2""",
        q="SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS p5, quantile_cont(ret, 0.95) OVER (PARTITION BY symbol) AS p95, count(*) OVER (PARTITION BY symbol) AS total FROM panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return stats.histogram(t.panel, "ret")
