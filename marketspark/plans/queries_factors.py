"""Regression, factors, signal combination, feature importance, regimes, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import indicators as I
from marketspark.operators import learn, metrics, regress, stats
from marketspark.operators.asof import bucket_lookup
from marketspark.plans.queries_pnl import LEDGER, cross_target, trades_of
from marketspark.plans.queries_stats import _IC_CTES, _scored
from marketspark.operators.ranks import percentiles
from marketspark.operators.series import correlation, parts_for
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import lag, prior, with_
from marketspark.session import written
from marketspark.sources.tables import Tables

LB, SKIP = 12, 2
FACTORS = ("mkt", "smb", "umd")


def _fit_sql(src: str, key: str, y: str, moments: str = "mm", fit: str = "cf") -> dict[str, str]:
    """CTEs with the regression of ``y`` on the three factors for each ``key``: means and covariances, Cramer's rule."""
    x = dict(zip("123", FACTORS))
    means = ", ".join(f"avg({c}) AS m{k}, var_pop({c}) AS v{k}, covar_pop({y}, {c}) AS c{k}" for k, c in x.items())
    cross = ", ".join(f"covar_pop({x[p]}, {x[q]}) AS c{p}{q}" for p, q in ("12", "13", "23"))
    return {
        moments: f"SELECT {key}, count(*) AS n, avg({y}) AS my, var_pop({y}) AS vy, {means}, {cross} FROM {src} GROUP BY 1",
        fit: f"""SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS alpha, (b1 * c1 + b2 * c2 + b3 * c3) / vy AS r2 FROM (SELECT *,
        (c1 * (v2 * v3 - c23 * c23) - c12 * (c2 * v3 - c23 * c3) + c13 * (c2 * c23 - v2 * c3)) / det AS b1,
        (v1 * (c2 * v3 - c23 * c3) - c1 * (c12 * v3 - c23 * c13) + c13 * (c12 * c3 - c2 * c13)) / det AS b2,
        (v1 * (v2 * c3 - c2 * c23) - c12 * (c12 * c3 - c2 * c13) + c1 * (c12 * c23 - v2 * c13)) / det AS b3
        FROM (SELECT *, v1 * (v2 * v3 - c23 * c23) - c12 * (c12 * v3 - c23 * c13) + c13 * (c12 * c23 - v2 * c13) AS det FROM {moments}))""",
    }


_FACT = {
    "cal": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM panel)",
    "pt": "SELECT p.*, t FROM panel p JOIN cal USING (ts)",
    "mk": "SELECT ts, sum(ret * volume) / sum(volume) AS mkt FROM panel WHERE volume > 0 GROUP BY 1 HAVING count(*) >= 5",
    "sv": f"SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {LB} PRECEDING AND 1 PRECEDING) AS v FROM pt",
    "sc": f"SELECT ts, quantile_cont(v, 0.3) AS lo, quantile_cont(v, 0.7) AS hi FROM sv WHERE t >= {LB} AND v > 0 GROUP BY 1 HAVING count(*) >= 10",
    "sz": f"SELECT s.ts, avg(ret) FILTER (v <= lo) - avg(ret) FILTER (v >= hi) AS smb FROM sv s JOIN sc USING (ts) WHERE t >= {LB} AND v > 0 GROUP BY 1",
    "mv": f"""SELECT *, CASE WHEN count(ret) OVER w = {LB} THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS past FROM pt
    WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {LB + SKIP} PRECEDING AND {SKIP + 1} PRECEDING)""",
    "mc": "SELECT ts, quantile_cont(past, 0.2) AS lo, quantile_cont(past, 0.8) AS hi FROM mv WHERE past IS NOT NULL GROUP BY 1 HAVING count(*) >= 10",
    "mo": "SELECT s.ts, avg(ret) FILTER (past >= hi) - avg(ret) FILTER (past <= lo) AS umd FROM mv s JOIN mc USING (ts) WHERE past IS NOT NULL GROUP BY 1",
    "fx": "SELECT ts, mkt, smb, umd FROM mk JOIN sz USING (ts) JOIN mo USING (ts)",
    "jn": "SELECT p.symbol, p.ts, p.ret, p.volume, mkt, smb, umd FROM panel p JOIN fx USING (ts)",
    **_fit_sql("jn", "symbol", "ret"),
}


@query("fac_01_market_factor", "ts", "mkt", with_("panel", "SELECT * FROM mk", **_FACT))
def _(t: Tables) -> DataFrame:
    return regress.market_factor(t.panel)


@query("fac_02_size_factor", "ts", "smb", with_("panel", "SELECT * FROM sz", **_FACT))
def _(t: Tables) -> DataFrame:
    return regress.size_factor(t.panel, LB)


@query("fac_03_momentum_factor", "ts", "umd", with_("panel", "SELECT * FROM mo", **_FACT))
def _(t: Tables) -> DataFrame:
    return regress.momentum_factor(t.panel, LB, SKIP)


def _factors(t: Tables, panel: DataFrame | None = None) -> DataFrame:
    panel = t.panel if panel is None else panel
    return regress.market_factor(panel).join(regress.size_factor(panel, LB), "ts").join(regress.momentum_factor(panel, LB, SKIP), "ts")


def _joined(t: Tables) -> DataFrame:
    panel = written(t.panel)  # the three factors and the join read it
    return panel.join(_factors(t, panel), "ts")


@query("join_09_factor_alignment", "symbol ts", "ret mkt smb umd", with_("panel", "SELECT * FROM jn", **_FACT))
def _(t: Tables) -> DataFrame:
    return _joined(t)


def _regressed(t: Tables) -> DataFrame:
    return _joined(t).select("symbol", "ts", "ret", *FACTORS)


_B = {f"b{k}": k for k in (1, 2, 3)}


@query("reg_01_ols", "symbol n", "alpha b1 b2 b3 r2", with_("panel", "SELECT * FROM cf", **_FACT))
def _(t: Tables) -> DataFrame:
    fit = regress.ols(_regressed(t), "ret", FACTORS, keys=["symbol"])
    return fit.withColumns({"alpha": F.col("coef")[0]} | {b: F.col("coef")[k] for b, k in _B.items()})


@query("reg_01_newey_west", "symbol n lag", "alpha se_alpha t_mkt p_mkt t_smb p_smb t_umd p_umd")
def _(t: Tables) -> DataFrame:
    fit = regress.ols_newey_west(_regressed(t), "ret", FACTORS, keys=["symbol"])
    tests = {f"{s}_{f}": F.col(c)[k] for k, f in enumerate(FACTORS, 1) for s, c in (("t", "tstat"), ("p", "pvalue"))}
    return fit.withColumns({"alpha": F.col("coef")[0], "se_alpha": F.col("se")[0]} | tests)


@query("reg_02_huber", "symbol n", "alpha b1 b2 b3 r2 t_mkt")
def _(t: Tables) -> DataFrame:
    fit = regress.huber_newey_west(_regressed(t), "ret", FACTORS, keys=["symbol"])
    return fit.withColumns({"alpha": F.col("coef")[0], "t_mkt": F.col("tstat")[1]} | {b: F.col("coef")[k] for b, k in _B.items()})


@query("reg_02_huber_equation", "symbol n", "e0 e1 e2 e3", with_("panel", "SELECT symbol, n, 0 AS e0, 0 AS e1, 0 AS e2, 0 AS e3 FROM mm WHERE n >= 6", **_FACT), digits=5)
def _(t: Tables) -> DataFrame:
    """Σ ψ(r / s)·x of the Huber fit, over Σ |ψ(r / s)·x|: zero where it solves its equation."""
    rows = written(_regressed(t))
    # the residuals and their scale read the fit: it runs once
    fit = written(regress.huber_newey_west(rows, "ret", FACTORS, keys=["symbol"]).select("symbol", "coef"))
    resid = regress.residuals(rows, fit, "ret", FACTORS, keys=["symbol"]).where("resid is not null")
    scale = percentiles(resid.withColumn("_a", F.abs("resid")), ["symbol"], "_a", {"m": 0.5})
    psi = F.greatest(F.lit(-regress.HUBER_C), F.least(F.lit(regress.HUBER_C), F.col("resid") / (F.col("m") / regress.MAD)))
    terms = [F.lit(1.0), *[F.col(f) for f in FACTORS]]
    sums = resid.join(scale.select("symbol", "m"), "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(psi * x) / F.sum(F.abs(psi * x))).alias(f"e{k}") for k, x in enumerate(terms)])
    return sums


@query(
    "reg_03_decomposition",
    "symbol n",
    "alpha alpha_annual beta_mkt beta_smb beta_umd r2 resid_autocorr",
    with_(
        "panel",
        "SELECT symbol, n, alpha, alpha * 13 AS alpha_annual, b1 AS beta_mkt, b2 AS beta_smb, b3 AS beta_umd, r2, ac AS resid_autocorr FROM cf JOIN a USING (symbol)",
        **_FACT,
        e="SELECT j.symbol, j.ts, ret - alpha - b1 * mkt - b2 * smb - b3 * umd AS e FROM jn j JOIN cf USING (symbol)",
        a="SELECT symbol, sum(c * l) / sum(c * c) AS ac FROM (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM (SELECT *, e - avg(e) OVER (PARTITION BY symbol) AS c FROM e)) GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    return regress.decompose(t.panel, _factors(t), FACTORS, 13.0)


_SCORE_ROWS = " UNION ALL ".join(f"SELECT ts, '{s}' AS signal, avg({c}) AS score FROM panel GROUP BY 1" for s, c in {"mean": "ret", "size": "ret * volume", "breadth": "CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END"}.items())


def _scores(t: Tables) -> DataFrame:
    """Three market-wide signals per time."""
    wide = t.panel.groupBy("ts").agg(F.avg("ret").alias("mean"), F.avg(F.col("ret") * F.col("volume")).alias("size"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("breadth"))
    return wide.unpivot(["ts"], ["mean", "size", "breadth"], "signal", "score")


@query(
    "reg_04_orthogonalise",
    "signal ts",
    "score residual",
    with_(
        "panel",
        "SELECT s.signal, s.ts, score, score - alpha - b1 * mkt - b2 * smb - b3 * umd AS residual FROM sj s JOIN sf USING (signal)",
        **_FACT,
        s=_SCORE_ROWS,
        sj="SELECT s.*, mkt, smb, umd FROM s JOIN fx USING (ts)",
        **_fit_sql("sj", "signal", "score", "sm", "sf"),
    ),
)
def _(t: Tables) -> DataFrame:
    return regress.orthogonalise(_scores(t), _factors(t), FACTORS)


@query(
    "agg_21_factor_attribution",
    "symbol n",
    "alpha_usd mkt_usd smb_usd umd_usd residual_usd gross_usd r2",
    with_(
        "panel",
        """SELECT symbol, count(*) AS n, sum(alpha * volume) AS alpha_usd, sum(b1 * mkt * volume) AS mkt_usd, sum(b2 * smb * volume) AS smb_usd, sum(b3 * umd * volume) AS umd_usd, sum((ret - alpha - b1 * mkt - b2 * smb - b3 * umd) * volume) AS residual_usd, sum(ret * volume) AS gross_usd, any_value(r2) AS r2
        FROM (SELECT j.*, alpha, b1, b2, b3, r2 FROM jn j JOIN cf USING (symbol)) GROUP BY 1""",
        **_FACT,
    ),
)
def _(t: Tables) -> DataFrame:
    return regress.attribute_returns(t.panel, _factors(t), FACTORS, notional=F.col("volume"))


@query("cmb_01_max_ir_weights", "signal", "weight")
def _(t: Tables) -> DataFrame:
    scores, mk = _scores(t), regress.market_factor(t.panel)
    from marketspark.operators.regress import calendar

    cal = calendar(mk)
    ahead = cal.join(mk, "ts").select((F.col("t") - 1).alias("t"), F.col("mkt").alias("fwd"))
    joined = scores.join(cal, "ts").join(ahead, "t")
    ics = joined.groupBy("signal").agg(correlation(F.col("score"), F.col("fwd")).alias("ic"))
    return regress.max_ir_weights(ics, scores)


@query(
    "cmb_01_combined_score",
    "ts",
    "combined",
    with_("panel", "SELECT ts, sum(score * CASE signal WHEN 'mean' THEN 0.5::DOUBLE WHEN 'size' THEN -0.01::DOUBLE ELSE 0.2::DOUBLE END) AS combined FROM s GROUP BY 1", s=_SCORE_ROWS),
)
def _(t: Tables) -> DataFrame:
    weights = F.create_map(F.lit("mean"), F.lit(0.5), F.lit("size"), F.lit(-0.01), F.lit("breadth"), F.lit(0.2))
    scores = _scores(t)
    return regress.combine(scores, scores.select("signal").distinct().withColumn("weight", weights[F.col("signal")]))


def _entries(t: Tables) -> DataFrame:
    # wide rows: smaller partitions than usual
    return learn.entries(t.bars, trades_of(t), parts=parts_for(t.spark, 4 * t.deal_count))


@query("ml_01_feature_importance", "feature", "importance")
def _(t: Tables) -> DataFrame:
    return learn.feature_importance(_entries(t), [*learn.ENTRY_INDICATORS, *learn.DERIVED])


@query(
    "ml_01_derived_features",
    "symbol entry_ts",
    "return_1bar return_5bar relative_vol",
    with_(
        "bn",
        f"""SELECT symbol, entry_ts, CASE WHEN c1 > 0 THEN close / c1 - 1 ELSE 0 END AS return_1bar, CASE WHEN c5 > 0 THEN close / c5 - 1 ELSE 0 END AS return_5bar, CASE WHEN usual > 0 THEN volume / usual ELSE 1 END AS relative_vol
        FROM trades t JOIN (SELECT symbol, ts, close, volume, {lag('close')} AS c1, {lag('close', 5)} AS c5, avg(volume) {prior(20)} AS usual FROM bn) f USING (symbol) WHERE t.entry_ts = f.ts""",
        **LEDGER,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return _entries(t)


@query("ml_02_regimes", "symbol ts regime", "realised_vol")
def _(t: Tables) -> DataFrame:
    feats = metrics.hmm_features(bucket_lookup(t.type_bars, t.event_funding, {"funding_rate": None}, "1h")).where("ready")
    return learn.regimes(feats, ["log_ret", "realised_vol", "funding"], "realised_vol").select("symbol", "ts", "regime", "realised_vol")


_CUSUM = {
    "z": "SELECT *, (ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_pop(ret) OVER (PARTITION BY symbol) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM panel",
    "c": """SELECT symbol, ts, ret, rn, greatest(0, z - 0.5) AS up, greatest(0, -z - 0.5) AS dn FROM z WHERE rn = 1 UNION ALL
    SELECT z.symbol, z.ts, z.ret, z.rn, greatest(0, c.up + z.z - 0.5), greatest(0, c.dn - z.z - 0.5) FROM c JOIN z ON z.symbol = c.symbol AND z.rn = c.rn + 1""",
}


@query("agg_34_cusum", "symbol ts alarm", "cusum", with_("panel", "SELECT symbol, ts, greatest(up, dn) AS cusum, greatest(up, dn) > 2.5003 AS alarm FROM c", **_CUSUM))
def _(t: Tables) -> DataFrame:
    return learn.cusum(t.panel, "ret", threshold=2.5003)


@query(
    "ml_03_segments",
    "symbol segment start_ts end_ts n alarm",
    "mean",
    with_(
        "panel",
        "SELECT symbol, segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, any_value(alarm) AS alarm, avg(ret) AS mean FROM s GROUP BY 1, 2",
        **_CUSUM,
        f="SELECT *, greatest(up, dn) > 2.5003 AS alarm FROM c",
        s="SELECT *, CAST(sum(CASE WHEN alarm = pa THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS segment FROM (SELECT *, lag(alarm) OVER (PARTITION BY symbol ORDER BY ts) AS pa FROM f)",
    ),
)
def _(t: Tables) -> DataFrame:
    return learn.segments(t.panel, "ret", threshold=2.5003)


_HEALTH = {
    **LEDGER,
    "b": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts DESC) AS b, abs(exit_price - entry_price) / entry_price * 100 AS slip FROM trades",
    "o": "SELECT symbol, count(*) AS n0, avg(pnl_pct) AS m0, var_samp(pnl_pct) AS v0, avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) AS base_win_rate FROM b WHERE b > 30 GROUP BY 1 HAVING count(*) >= 10",
    "g": """SELECT symbol, count(*) AS n1, avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) AS win_rate, avg(slip) AS slippage_bps, avg(slip) FILTER (b <= 5) > 1.5 * avg(slip) FILTER (b > 25) AS slippage_widening,
    avg(pnl_pct) FILTER (b <= 10) AS m10, var_samp(pnl_pct) FILTER (b <= 10) AS v10, avg(pnl_pct) FILTER (b <= 20) AS m20, var_samp(pnl_pct) FILTER (b <= 20) AS v20, avg(pnl_pct) AS m30, var_samp(pnl_pct) AS v30 FROM b WHERE b <= 30 GROUP BY 1 HAVING count(*) = 30""",
}


def _t_sql(k: int) -> str:
    return f"(m{k} - m0) / sqrt((({k} - 1) * v{k} + (n0 - 1) * v0) / ({k} + n0 - 2) * (1.0::DOUBLE / {k} + 1.0::DOUBLE / n0)) AS t{k}"


@query(
    "agg_34_health_components",
    "symbol n0 n1 slippage_widening",
    "win_rate base_win_rate ratio slippage_bps t10 t20 t30",
    with_("bn", f"SELECT *, CASE WHEN base_win_rate > 0 THEN win_rate / base_win_rate ELSE 1 END AS ratio, {_t_sql(10)}, {_t_sql(20)}, {_t_sql(30)} FROM g JOIN o USING (symbol)", **_HEALTH),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return learn.health_components(trades_of(t)).where("n1 = 30")


@query(
    "agg_34_alpha_trend",
    "symbol n alpha_decaying",
    "alpha beta r2",
    with_(
        "panel",
        """SELECT symbol, count(*) AS n, regr_intercept(ret, mkt) AS alpha, regr_slope(ret, mkt) AS beta, regr_r2(ret, mkt) AS r2, coalesce(count(*) >= 40 AND avg(a) FILTER (i < n AND i >= n - 5) < 0.5 * avg(a) FILTER (i >= 20 AND i < 25), false) AS alpha_decaying
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, regr_intercept(ret, mkt) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS a FROM (SELECT p.*, mkt FROM panel p JOIN mk USING (ts))) GROUP BY 1""",
        **_FACT,
    ),
)
def _(t: Tables) -> DataFrame:
    return learn.alpha_trend(t.panel.join(regress.market_factor(t.panel), "ts"))


_T_TAILS = ", ".join(
    f"""CASE WHEN t{k} IS NOT NULL THEN 0.5 + 0.5 * CASE WHEN ({k} + n0) % 2 = 0
    THEN t{k} / sqrt({k} + n0 - 2 + t{k} * t{k}) * list_sum(list_transform(range(0, ({k} + n0 - 2) // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1)) / sqrt(pi()) * pow(({k} + n0 - 2) / ({k} + n0 - 2 + t{k} * t{k}), i)))
    ELSE 2 / pi() * (atan(t{k} / sqrt({k} + n0 - 2)) + sqrt({k} + n0 - 2) * t{k} / ({k} + n0 - 2 + t{k} * t{k})
    * list_sum(list_transform(range(0, ({k} + n0 - 3) // 2), lambda i: sqrt(pi()) / 2 * exp(lgamma(i + 1) - lgamma(i + 1.5)) * pow(({k} + n0 - 2) / ({k} + n0 - 2 + t{k} * t{k}), i)))) END END AS p{k}"""
    for k in (10, 20, 30)
)
_SCORE = {
    **_FACT,
    **_HEALTH,
    "hs_rows": """SELECT symbol, (pnl_pct - m0) / sd AS z, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) AS rn
    FROM (SELECT b.*, m0, stddev_pop(pnl_pct) OVER (PARTITION BY symbol) AS sd FROM b JOIN o USING (symbol) WHERE b <= 30) WHERE sd > 0""",
    "hs_cusum": """SELECT symbol, rn, greatest(0, z - 0.5) AS up, greatest(0, -z - 0.5) AS dn FROM hs_rows WHERE rn = 1 UNION ALL
    SELECT l.symbol, l.rn, greatest(0, cs.up + l.z - 0.5), greatest(0, cs.dn - l.z - 0.5) FROM hs_cusum cs JOIN hs_rows l ON l.symbol = cs.symbol AND l.rn = cs.rn + 1""",
    "hs_alpha": """SELECT symbol, regr_intercept(ret, mkt) AS alpha, coalesce(count(*) >= 40 AND avg(a) FILTER (i < n AND i >= n - 5) < 0.5 * avg(a) FILTER (i >= 20 AND i < 25), false) AS decaying
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, regr_intercept(ret, mkt) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS a
    FROM (SELECT p.*, mkt FROM panel p JOIN mk USING (ts))) GROUP BY 1 HAVING count(*) >= 20""",
    "hs_late": """SELECT b.symbol, count(*) AS n1, count(*) FILTER (b <= 10) AS k10, count(*) FILTER (b <= 20) AS k20, count(*) FILTER (b <= 30) AS k30, avg(CASE WHEN pnl > 0 THEN 100 ELSE 0 END) AS win_rate, avg(slip) AS slippage_bps,
    avg(pnl_pct) FILTER (b <= 10) AS m10, var_samp(pnl_pct) FILTER (b <= 10) AS v10, avg(pnl_pct) FILTER (b <= 20) AS m20, var_samp(pnl_pct) FILTER (b <= 20) AS v20, avg(pnl_pct) AS m30, var_samp(pnl_pct) AS v30
    FROM b JOIN o USING (symbol) JOIN (SELECT DISTINCT symbol FROM hs_rows) USING (symbol) WHERE b <= 30 GROUP BY 1 HAVING count(*) >= 10""",
    "hs_t": f"SELECT l.*, n0, m0, v0, base_win_rate, {', '.join(_t_sql(k).replace(f'(m{k}', f'CASE WHEN k{k} = {k} THEN (m{k}').replace(' AS t', ' END AS t') for k in (10, 20, 30))} FROM hs_late l JOIN o USING (symbol)",
    "hs_p": f"SELECT *, {_T_TAILS} FROM hs_t",
    "hs_points": """SELECT ps.*, c.cusum, coalesce(least(p10, p20, p30), 1) AS p_value, least(p10, p20, p30) AS least_p,
    (coalesce(p10, 1) < 0.05)::INT + (coalesce(p20, 1) < 0.05)::INT + (coalesce(p30, 1) < 0.05)::INT AS significant, alpha, decaying FROM hs_p ps JOIN (SELECT symbol, max(greatest(up, dn)) AS cusum FROM hs_cusum GROUP BY 1) c USING (symbol) LEFT JOIN hs_alpha USING (symbol)""",
    "hs_score": """SELECT *, CAST(round_even(greatest(0, least(100, CASE WHEN cusum < 2 THEN 20 WHEN cusum < 4 THEN 20 * (1 - (cusum - 2) / 2) ELSE 0 END + least(25, 25 * CASE WHEN base_win_rate > 0 THEN win_rate / base_win_rate ELSE 1 END)
    + CASE WHEN significant = 0 THEN 25 WHEN significant < 2 THEN 15 ELSE greatest(0, least_p * 25) END
    + CASE WHEN alpha IS NULL THEN 20 WHEN alpha > 0 AND NOT decaying THEN 20 WHEN alpha > 0 THEN 10 WHEN NOT decaying THEN 5 ELSE 0 END
    + CASE WHEN slippage_bps - 5 < 2 THEN 10 WHEN slippage_bps - 5 < 20 THEN 10 * (1 - (slippage_bps - 7) / 18) ELSE 0 END)), 0) AS INT) AS score FROM hs_points""",
}


@query(
    "agg_34_health_score",
    "symbol score grade action",
    "p_value",
    with_(
        "bn panel",
        """SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END AS grade,
        CASE WHEN score >= 70 THEN 'continue' WHEN score >= 50 THEN 'reduce_size' WHEN score >= 25 THEN 'pause' ELSE 'stop' END AS action FROM hs_score""",
        **_SCORE,
    ),
)
def _(t: Tables) -> DataFrame:
    alphas = learn.alpha_trend(t.panel.join(regress.market_factor(t.panel), "ts"))
    return learn.health_score(learn.health_components(trades_of(t)), alphas)
