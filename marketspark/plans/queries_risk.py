"""Costs, capacity, cross-moments, exposure, limits, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import asof, cost, metrics, panel, portfolio, risk
from marketspark.plans.queries_pnl import GRID, GRID_CTES, LEDGER, METRICS_SQL, RUN_KEYS, CURVE, curve_of, grid_curve, grid_metrics, trades_of
from marketspark.operators.bars import moment
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import lag, over, with_
from marketspark.session import cut_lineage
from marketspark.sources.tables import Tables

# ── costs ──────────────────────────────────────────────────────────────────────────────────

_TIER = {
    inst: "CASE "
    + " ".join(f"WHEN vol >= {least} THEN CASE WHEN taker THEN {t} ELSE {m} END" for least, m, t in reversed(tiers))
    + " END"
    for inst, tiers in cost.FEE_TIERS.items()
}
_ORDERS_SQL = """SELECT l_orderkey AS order_id, l_suppkey, sum(l_extendedprice) AS notional, count(*) AS n, min(l_linestatus) = 'F' AS taker, sum(sum(l_extendedprice)) OVER (PARTITION BY l_suppkey) AS vol,
    CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, avg(l_discount) AS disc FROM lineitem GROUP BY l_orderkey, l_suppkey"""


def _orders(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("order_id"), "l_suppkey").agg(
        F.sum("l_extendedprice").alias("notional"), (F.min("l_linestatus") == "F").alias("is_taker"), F.avg("l_discount").alias("disc")
    )
    volume = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("volume_14d"))
    return per.join(volume, "l_suppkey").withColumn("side", F.when(F.col("order_id") % 2 == 0, 1).otherwise(-1))


@query(
    "prj_07_fee_tiers",
    "order_id l_suppkey",
    "perp_bps spot_bps perp_usd",
    with_("", f"SELECT order_id, l_suppkey, {_TIER['perp']} + 3 AS perp_bps, {_TIER['spot']} AS spot_bps, notional * ({_TIER['perp']} + 3) / 10000 AS perp_usd FROM o", o=_ORDERS_SQL),
)
def _(t: Tables) -> DataFrame:
    o = _orders(t)
    perp = cost.fee_bps(F.col("volume_14d"), F.col("is_taker"))
    spot = cost.fee_bps(F.col("volume_14d"), F.col("is_taker"), "spot", builder=False)
    return o.withColumns({"perp_bps": perp, "spot_bps": spot, "perp_usd": F.col("notional") * perp / 10_000})


@query(
    "prj_08_drawdown_scaler",
    "symbol ts killed",
    "scaler step",
    with_(
        "bn",
        """SELECT symbol, ts, CASE WHEN dd <= 0 THEN 1 WHEN dd >= 0.2 THEN 0 ELSE 1 - dd * 5 END AS scaler, CASE WHEN dd <= 0.05 THEN 1 WHEN dd <= 0.1 THEN 0.75 WHEN dd <= 0.15 THEN 0.5 WHEN dd < 0.2 THEN 0.25 ELSE 0 END AS step,
        CASE WHEN dd <= 0 THEN 1 WHEN dd >= 0.2 THEN 0 ELSE 1 - dd * 5 END <= 1e-9 AS killed FROM (SELECT symbol, ts, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts) AS dd FROM bn)""",
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.series import series_window, through_now

    dd = 1 - F.col("close") / F.max("close").over(through_now(series_window()))
    df = t.bars.withColumn("dd", dd)
    df = df.withColumns({"scaler": risk.drawdown_scaler(F.col("dd")), "step": risk.drawdown_scaler(F.col("dd"), interpolate=False)})
    return df.withColumn("killed", F.col("scaler") <= 1e-9)


_LIQ = """SELECT symbol, avg(nv) / 7 AS adv_usd, stddev_samp(lr) * sqrt(1.0::DOUBLE / 7) AS daily_vol FROM (SELECT *, close * volume AS nv, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars) GROUP BY 1"""


@query(
    "prj_09_sqrt_impact",
    "order_id symbol",
    "impact_bps",
    with_("bars", "SELECT order_id, symbol, 0.7::DOUBLE * daily_vol * sqrt(notional / adv_usd) * 10000 AS impact_bps FROM o JOIN liq ON symbol = 'S' || l_suppkey", o=_ORDERS_SQL, liq=_LIQ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    o = _orders(t).withColumn("symbol", F.concat(F.lit("S"), "l_suppkey")).join(metrics.liquidity(t.bars, 1 / 7), "symbol")
    return o.withColumn("impact_bps", cost.sqrt_impact_bps(F.col("notional"), F.col("adv_usd"), F.col("daily_vol")))


@query(
    "prj_10_expected_funding",
    "order_id l_suppkey",
    "flat drifting",
    with_(
        "",
        """SELECT order_id, l_suppkey, side * notional * k * rate AS flat, side * notional * (k * rate + 1e-7 * k * (k - 1) / 2) AS drifting FROM (SELECT *, disc / 1000 - 5e-5 AS rate, round(disc * 100 + 0.26) AS k FROM o)""",
        o=_ORDERS_SQL,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    args = (F.col("side"), F.col("notional"), F.col("disc") / 1000 - 5e-5, F.col("disc") * 100 + 0.26)
    return _orders(t).withColumns({"flat": cost.expected_funding(*args), "drifting": cost.expected_funding(*args, drift=1e-7)})


_COST_PARTS = "fee_bps funding_bps impact_bps slippage_bps total_bps total_usd"


@query(
    "prj_11_trade_cost",
    "order_id symbol",
    _COST_PARTS,
    with_(
        "bars",
        """SELECT *, fee_bps + funding_bps + impact_bps + slippage_bps AS total_bps, notional * (fee_bps + funding_bps + impact_bps + slippage_bps) / 10000 AS total_usd FROM (
        SELECT order_id, symbol, notional, """
        + _TIER["perp"]
        + """ + 3 AS fee_bps, side * 8 * (disc / 1000 - 5e-5) * 10000 AS funding_bps, 0.7::DOUBLE * daily_vol * sqrt(notional / adv_usd) * 10000 AS impact_bps, disc * 10 AS slippage_bps
        FROM o JOIN liq ON symbol = 'S' || l_suppkey)""",
        o=_ORDERS_SQL,
        liq=_LIQ,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    o = _orders(t).withColumn("symbol", F.concat(F.lit("S"), "l_suppkey")).join(metrics.liquidity(t.bars, 1 / 7), "symbol")
    o = o.withColumns({"hours": F.lit(8.0), "funding_rate": F.col("disc") / 1000 - 5e-5, "slippage_bps": F.col("disc") * 10})
    return cost.trade_cost(o)


_SHORT = "filled unfilled avg_fill timing_usd opportunity_usd commission_usd total_usd timing_bps opportunity_bps commission_bps total_bps"


@query(
    "agg_15_implementation_shortfall",
    "order_id side",
    _SHORT,
    with_(
        "deals",
        """SELECT *, timing_usd + opportunity_usd + commission_usd AS total_usd, timing_usd / n * 10000 AS timing_bps, opportunity_usd / n * 10000 AS opportunity_bps, commission_usd / n * 10000 AS commission_bps,
        (timing_usd + opportunity_usd + commission_usd) / n * 10000 AS total_bps FROM (SELECT o.*, coalesce(filled, 0) AS filled, coalesce(commission_usd, 0) AS commission_usd, cst / filled AS avg_fill, intended_size - coalesce(filled, 0) AS unfilled,
        intended_size * decision_price AS n, coalesce(sg * filled * (cst / filled - decision_price), 0) AS timing_usd, sg * (intended_size - coalesce(filled, 0)) * (final_mid - decision_price) AS opportunity_usd
        FROM o LEFT JOIN f USING (order_id))""",
        o="""SELECT order_id, CASE WHEN order_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN order_id % 2 = 0 THEN 1 ELSE -1 END AS sg, arg_min(price, row(ts, seq)) AS decision_price, arg_max(price, row(ts, seq)) AS final_mid, sum(size) * 1.1::DOUBLE AS intended_size FROM deals GROUP BY 1""",
        f="SELECT order_id, sum(size) AS filled, sum(price * size) AS cst, sum(fee) AS commission_usd FROM deals WHERE crossed GROUP BY 1",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    d = t.deals
    orders = d.groupBy("order_id").agg(
        F.min_by("price", moment()).alias("decision_price"), F.max_by("price", moment()).alias("final_mid"), (F.sum("size") * 1.1).alias("intended_size")
    )
    orders = orders.withColumn("side", F.when(F.col("order_id") % 2 == 0, "buy").otherwise("sell"))
    return cost.implementation_shortfall(orders, d.where("crossed"))


@query(
    "sta_17_impact_fit",
    "symbol n",
    "a b r2",
    with_(
        "deals",
        """SELECT symbol, count(*) AS n, exp(regr_intercept(ln(slip), ln(p))) AS a, regr_slope(ln(slip), ln(p)) AS b, regr_r2(ln(slip), ln(p)) AS r2
        FROM (SELECT symbol, slip, size * price / sum(size * price) OVER (PARTITION BY symbol) AS p FROM deals) WHERE slip > 0 AND p > 0 GROUP BY 1""",
    ),
)
def _(t: Tables) -> DataFrame:
    value = F.col("size") * F.col("price")
    total = t.deals.groupBy("symbol").agg(F.sum(value).alias("_all"))
    observed = t.deals.join(total, "symbol").withColumns({"participation": value / F.col("_all"), "slippage_bps": F.col("slip")})
    return cost.fit_impact(observed)


def _mid_levels(t: Tables) -> DataFrame:
    """Levels with the mid price of their snapshot."""
    mid = t.books.where((F.size("bids") > 0) & (F.size("asks") > 0)).select("symbol", "ts", ((F.col("bids")[0]["px"] + F.col("asks")[0]["px"]) / 2).alias("mid"))
    return t.book_levels.join(mid, ["symbol", "ts"])


_WALK_CTES = {
    "q": """SELECT symbol || '/' || ts || '/' || s AS order_id, symbol, ts, s AS side, mid, 60.0::DOUBLE AS req FROM book_feats, (SELECT unnest(['buy', 'sell']) AS s)""",
    "m": """SELECT q.*, l.px, l.sz, greatest(0, least(l.sz, req - coalesce(sum(l.sz) OVER (PARTITION BY q.order_id ORDER BY l.lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
    FROM q JOIN levels_ranked l ON l.symbol = q.symbol AND l.ts = q.ts AND l.side = CASE q.side WHEN 'buy' THEN 'ask' ELSE 'bid' END""",
}


@query(
    "join_08_walk_book",
    "order_id side levels_used",
    "filled unfilled vwap slippage_bps",
    with_(
        "book_feats levels_ranked",
        """SELECT order_id, side, count(*) FILTER (take > 1e-12) AS levels_used, sum(take) AS filled, greatest(0, any_value(req) - sum(take)) AS unfilled, sum(px * take) / sum(take) AS vwap,
        CASE side WHEN 'buy' THEN 1 ELSE -1 END * (sum(px * take) / sum(take) - any_value(mid)) / any_value(mid) * 10000 AS slippage_bps FROM m GROUP BY 1, 2""",
        **_WALK_CTES,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    mids = _mid_levels(t).select("symbol", "ts", "mid").distinct()
    side = F.explode(F.array(F.lit("buy"), F.lit("sell")))
    orders = mids.withColumn("side", side).withColumns({"order_id": F.concat_ws("/", "symbol", F.col("ts").cast("string"), "side"), "req": F.lit(60.0)})
    return asof.walk_book(orders, t.book_levels, ["symbol", "ts"])


_DEPTH_SQL = """SELECT symbol, ts, side, sum(px * CASE WHEN sg * (px - lim) <= 0 THEN sz ELSE greatest(0, least(sz, sg * (lim * s - c) / (sg * (px - lim)))) END) AS depth_usd FROM (
    SELECT l.*, CASE l.side WHEN 'ask' THEN 1 ELSE -1 END AS sg, mid * (1 + CASE l.side WHEN 'ask' THEN 1 ELSE -1 END * 0.004::DOUBLE) AS lim,
    coalesce(sum(sz) OVER w, 0) AS s, coalesce(sum(px * sz) OVER w, 0) AS c FROM levels_ranked l JOIN book_feats f ON f.symbol = l.symbol AND f.ts = l.ts
    WINDOW w AS (PARTITION BY l.symbol, l.ts, l.side ORDER BY l.lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2, 3"""


@query("agg_33_depth_capacity", "symbol ts side", "depth_usd", with_("book_feats levels_ranked", _DEPTH_SQL), digits=4)
def _(t: Tables) -> DataFrame:
    return cost.depth_capacity(_mid_levels(t), ["symbol", "ts"], 40.0)


_CAP_SQL = """SELECT *, least(impact_usd, adv_cap_usd) AS capacity_usd, CASE WHEN impact_usd <= adv_cap_usd THEN 'impact' ELSE 'adv' END AS binding FROM (SELECT symbol, adv_usd, daily_vol, alpha_bps,
    least(1e10, adv_usd * pow(0.5::DOUBLE * alpha_bps / (0.7::DOUBLE * daily_vol * 10000), 2)) AS impact_usd, adv_usd * 0.05::DOUBLE AS adv_cap_usd, least(1e10, adv_usd * pow(alpha_bps / (0.7::DOUBLE * daily_vol * 10000), 2)) AS breakeven_usd
    FROM (SELECT *, 200.0::DOUBLE AS alpha_bps FROM liq))"""


def _capacity(t: Tables) -> DataFrame:
    return cost.capacity(metrics.liquidity(t.bars, 1 / 7).withColumn("alpha_bps", F.lit(200.0)))


@query("agg_33_capacity", "symbol binding", "impact_usd adv_cap_usd breakeven_usd capacity_usd", with_("bars", _CAP_SQL, liq=_LIQ), digits=4)
def _(t: Tables) -> DataFrame:
    return _capacity(t)


@query(
    "agg_33_capacity_curve",
    "symbol point",
    "size_usd impact_bps net_alpha_bps",
    with_(
        "bars",
        """SELECT symbol, point, size_usd, 0.7::DOUBLE * daily_vol * sqrt(size_usd / adv_usd) * 10000 AS impact_bps, alpha_bps - 0.7::DOUBLE * daily_vol * sqrt(size_usd / adv_usd) * 10000 AS net_alpha_bps FROM (
        SELECT c.*, CAST(k AS INT) AS point, greatest(2 * capacity_usd, 1.5 * breakeven_usd, 1) * k / 30 AS size_usd FROM c, range(1, 31) AS r(k))""",
        liq=_LIQ,
        c=_CAP_SQL,
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return cost.capacity_curve(_capacity(t))


@query(
    "agg_31_funding_accrual",
    "pos_id intervals",
    "cumulative_rate average_rate paid_usd",
    with_(
        "bn event_funding type_ticks",
        """SELECT pos_id, count(funding_rate) AS intervals, coalesce(sum(funding_rate), 0) AS cumulative_rate, coalesce(avg(funding_rate), 0) AS average_rate, coalesce(any_value(side) * any_value(notional) * sum(funding_rate), 0) AS paid_usd
        FROM p LEFT JOIN event_funding f ON f.symbol = p.symbol AND f.ts > p.entry_ts AND f.ts <= p.exit_ts GROUP BY 1""",
        p="SELECT seq AS pos_id, symbol, CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS side, price * size AS notional, ts AS entry_ts, ts + CAST(size AS BIGINT) * 1800000 AS exit_ts FROM type_ticks",
    ),
    digits=7,
)
def _(t: Tables) -> DataFrame:
    positions = t.type_ticks.select(
        F.col("seq").alias("pos_id"),
        "symbol",
        F.when(F.col("seq") % 3 == 0, -1).otherwise(1).alias("side"),
        (F.col("price") * F.col("size")).alias("notional"),
        F.col("ts").alias("entry_ts"),
        (F.col("ts") + F.col("size").cast("long") * 1_800_000).alias("exit_ts"),
    )
    return cost.accrued_funding(positions, t.event_funding)


# ── cross-moments ──────────────────────────────────────────────────────────────────────────

_PAIR_SQL = "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.ret, y.ret) AS corr, covar_samp(x.ret, y.ret) AS cov FROM {src} x JOIN {src} y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2 HAVING count(*) >= {least}"


@query("agg_16_correlations", "a b n", "corr cov", with_("panel", _PAIR_SQL.format(src="panel", least=2)))
def _(t: Tables) -> DataFrame:
    return panel.correlations(t.panel)


@query("agg_16_moments", "symbol n", "mean vol var", with_("panel", "SELECT symbol, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS vol, var_samp(ret) AS var FROM panel GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return panel.moments(t.panel)


@query(
    "join_10_correlation_alerts",
    "a b n exceeds advice",
    "corr",
    with_(
        "strategies",
        "SELECT *, abs(corr) > 0.1 AS exceeds, CASE WHEN abs(corr) > 0.2 THEN 'reduce_weaker' WHEN abs(corr) > 0.1 THEN 'alert' ELSE 'none' END AS advice FROM (" + _PAIR_SQL.format(src="tail", least=5) + ")",
        tail="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM strategies) WHERE k <= 48",
    ),
)
def _(t: Tables) -> DataFrame:
    return risk.pair_alerts(t.strategies, alert=0.1, reduce=0.2)


_LW = {
    "dense": "SELECT * FROM panel WHERE ts IN (SELECT ts FROM panel GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM panel))",
    "x": "SELECT ts, symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS x, count(*) OVER (PARTITION BY symbol) AS tt FROM dense",
    "v": "SELECT symbol, avg(x * x) AS s, sqrt(avg(x * x)) AS sd, any_value(tt) AS tt FROM x GROUP BY 1",
    "pr": """SELECT a.symbol AS a, b.symbol AS b, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, avg(pow(a.x, 3) * b.x) AS aab FROM x a JOIN x b ON a.ts = b.ts GROUP BY 1, 2""",
    "pp": """SELECT p.*, va.s AS sa, vb.s AS sb, va.sd AS sda, vb.sd AS sdb, va.tt AS tt, CASE WHEN a = b THEN 1 ELSE p.s / (va.sd * vb.sd) END AS r FROM pr p JOIN v va ON va.symbol = a JOIN v vb ON vb.symbol = b""",
    "k0": "SELECT avg(r) FILTER (a <> b) AS rho, max(tt) AS tt, sum(q - s * s) AS pi, sum(q - s * s) FILTER (a = b) AS pid, avg(s) FILTER (a = b) AS av FROM pp",
    "k1": """SELECT any_value(k0.rho) AS rho, any_value(k0.av) AS av, any_value(k0.tt) AS tt, any_value(pi) AS pi, any_value(pid) + any_value(k0.rho) * sum(sdb / sda * (aab - sa * s)) FILTER (a <> b) AS noise,
    sum(pow(CASE WHEN a = b THEN {fd} ELSE {fo} END - s, 2)) AS gamma FROM pp, k0""",
    "k": "SELECT *, greatest(0, least(1, (pi - noise) / gamma / tt)) AS delta FROM k1",
}


def _lw_sql(diag: str, off: str) -> str:
    ctes = {**_LW, "k1": _LW["k1"].format(fd=diag, fo=off)}
    body = f"SELECT a, b, delta, delta * CASE WHEN a = b THEN {diag} ELSE {off} END + (1 - delta) * s * tt_ / (tt_ - 1) AS cov FROM (SELECT pp.* EXCLUDE (tt), k.delta, k.rho, k.av, k.tt::DOUBLE AS tt_ FROM pp, k) WHERE a <= b"
    return with_("panel", body, **ctes)


@query("agg_17_ledoit_wolf", "a b", "cov delta", _lw_sql("sa", "rho * sda * sdb"))
def _(t: Tables) -> DataFrame:
    return panel.ledoit_wolf(panel.complete_rows(t.panel))


@query("agg_17_ledoit_wolf_identity", "a b", "cov delta", _lw_sql("av", "0"))
def _(t: Tables) -> DataFrame:
    return panel.ledoit_wolf(panel.complete_rows(t.panel), target="identity")


@query(
    "agg_18_beta_lead_lag",
    "symbol n best_lag",
    "beta best_corr",
    with_(
        "panel",
        """SELECT symbol, n, beta, arg_max(lag, row(abs(c), -(lag + 3))) AS best_lag, arg_max(c, row(abs(c), -(lag + 3))) AS best_corr FROM ll JOIN bt USING (symbol) GROUP BY 1, 2, 3""",
        j="SELECT p.*, m.ret AS mkt, row_number() OVER (PARTITION BY p.symbol ORDER BY p.ts) AS i FROM panel p JOIN panel m ON m.ts = p.ts AND m.symbol = 'S1' WHERE p.symbol <> 'S1'",
        bt="SELECT symbol, count(*) AS n, covar_samp(ret, mkt) / var_pop(mkt) AS beta FROM j GROUP BY 1",
        ll="SELECT a.symbol, CAST(k AS INT) AS lag, corr(a.ret, b.mkt) AS c FROM j a, range(-3, 4) AS r(k), j b WHERE b.symbol = a.symbol AND b.i = a.i - k GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return panel.beta_to(t.panel, "S1").join(panel.lead_lag(t.panel, "S1", 3), "symbol")


@query(
    "agg_32_basket_impact",
    "symbol",
    "own_bps impact_bps cost_usd own_cost_usd",
    with_(
        "panel bars",
        """SELECT symbol, own_bps, sgn * own_bps + coalesce(cross_bps, 0) AS impact_bps, q * (sgn * own_bps + coalesce(cross_bps, 0)) / 10000 AS cost_usd, abs(q) * own_bps / 10000 AS own_cost_usd FROM t
        LEFT JOIN (SELECT p.i AS symbol, 0.5::DOUBLE * sum(corr * sgn * own_bps) AS cross_bps FROM p JOIN t ON t.symbol = p.j GROUP BY 1) USING (symbol)""",
        liq=_LIQ,
        t="""SELECT symbol, q, sign(q) AS sgn, 0.7::DOUBLE * daily_vol * sqrt(abs(q) / adv_usd) * 10000 AS own_bps FROM (SELECT *, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * adv_usd / 10 AS q FROM liq)""",
        c=_PAIR_SQL.format(src="panel", least=2),
        p="SELECT a AS i, b AS j, corr FROM c UNION ALL SELECT b, a, corr FROM c",
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    sign = F.when(F.substring("symbol", 2, 20).cast("long") % 2 == 0, 1).otherwise(-1)
    legs = metrics.liquidity(t.bars, 1 / 7).withColumn("q", sign * F.col("adv_usd") / 10)
    return cost.basket_impact(legs, lambda pushes: panel.weighted_correlations(t.panel, pushes), damping=0.5)


@query("cmb_02_kelly_weights", "symbol", "w")
def _(t: Tables) -> DataFrame:
    return panel.kelly_weights(t.panel)


@query("cmb_02_kelly_residual", "symbol", "residual", with_("panel", "SELECT DISTINCT symbol, 0 AS residual FROM panel"))
def _(t: Tables) -> DataFrame:
    """Σw − v of the unclamped weights, over the largest v: zero where the system is solved."""
    known = cut_lineage(t.panel)
    w = cut_lineage(panel.kelly_solution(known, fraction=1.0))
    v = panel.moments(known).select("symbol", F.col("mean").alias("v"))
    size = v.agg(F.max(F.abs("v")).alias("_v"))  # one row
    made = panel.covariance_product(known, w, ridge=1e-8).join(v, "symbol")
    return made.crossJoin(F.broadcast(size)).select("symbol", ((F.col("y") - F.col("v")) / F.col("_v")).alias("residual"))


# ── exposure, limits, sizing ───────────────────────────────────────────────────────────────

_POS_SQL = """SELECT l_returnflag AS strategy, 'S' || l_suppkey AS symbol, sum(l_extendedprice) / 1000 AS notional, CASE WHEN avg(l_discount) > 0.05 THEN 'long' ELSE 'short' END AS side FROM lineitem GROUP BY 1, 2"""
_EQUITY = 3_000_000.0


def _positions(t: Tables) -> DataFrame:
    # exact sums: a mean discount of just 0.05 is common, and binary sums of it depend on the order of the rows
    over = F.sum(F.col("l_discount").cast("decimal(20,12)") - F.lit("0.05").cast("decimal(3,2)")) > 0
    return (
        t.raw("lineitem")
        .groupBy(F.col("l_returnflag").alias("strategy"), F.concat(F.lit("S"), "l_suppkey").alias("symbol"))
        .agg((F.sum("l_extendedprice") / 1000).alias("notional"), F.when(over, "long").otherwise("short").alias("side"))
    )


@query(
    "prj_15_exposure",
    "",
    "net_pct gross_pct long_pct short_pct",
    f"""SELECT (l - s) / {_EQUITY} * 100 AS net_pct, (l + s) / {_EQUITY} * 100 AS gross_pct, l / {_EQUITY} * 100 AS long_pct, s / {_EQUITY} * 100 AS short_pct
    FROM (SELECT sum(notional) FILTER (side = 'long') AS l, sum(notional) FILTER (side = 'short') AS s FROM ({_POS_SQL}))""",
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return risk.exposure(_positions(t), _EQUITY)


@query("prj_15_exposure_by_asset", "symbol", "signed_usd", f"SELECT symbol, sum(CASE side WHEN 'long' THEN notional ELSE -notional END) AS signed_usd FROM ({_POS_SQL}) GROUP BY 1", digits=4)
def _(t: Tables) -> DataFrame:
    return risk.exposure_by(_positions(t), "symbol")


@query(
    "prj_15_position_gate",
    "c_custkey symbol side allowed",
    "headroom permitted scale",
    with_(
        "",
        f"""SELECT c_custkey, symbol, side, requested > 0 AND headroom > 0 AS allowed, headroom, CASE WHEN requested > 0 AND headroom > 0 THEN least(requested, headroom) ELSE 0 END AS permitted,
        CASE WHEN requested > 0 AND headroom > 0 THEN least(requested, headroom) / requested ELSE 0 END AS scale FROM (SELECT r.*, greatest(0, least({_EQUITY} * 1.5 - CASE side WHEN 'long' THEN l - s ELSE s - l END, {_EQUITY} * 3 - (l + s),
        {_EQUITY} * 2 - CASE side WHEN 'long' THEN l ELSE s END, {_EQUITY} * 0.5 - abs(coalesce(x, 0)))) AS headroom FROM r CROSS JOIN e LEFT JOIN a USING (symbol))""",
        p=_POS_SQL,
        r="SELECT c_custkey, 'S' || (c_nationkey * 4) AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, c_acctbal * 200 AS requested FROM customer",
        e="SELECT sum(notional) FILTER (side = 'long') AS l, sum(notional) FILTER (side = 'short') AS s FROM p",
        a="SELECT symbol, sum(CASE side WHEN 'long' THEN notional ELSE -notional END) AS x FROM p GROUP BY 1",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    requests = t.raw("customer").select(
        "c_custkey",
        F.concat(F.lit("S"), F.col("c_nationkey") * 4).alias("symbol"),
        F.when(F.col("c_custkey") % 2 == 0, "long").otherwise("short").alias("side"),
        (F.col("c_acctbal") * 200).alias("requested"),
    )
    return risk.gate(requests, _positions(t), _EQUITY)


@query(
    "prj_16_sector_guard",
    "symbol entry_ts direction matches blocked",
    "size_factor",
    with_(
        "bn",
        """SELECT t.symbol, t.entry_ts, t.direction, count(o.symbol) AS matches, count(o.symbol) >= 2 AS blocked, CASE WHEN count(o.symbol) >= 2 THEN 0 WHEN count(o.symbol) = 1 THEN 0.5 ELSE 1 END AS size_factor
        FROM g t LEFT JOIN g o ON o.sector = t.sector AND o.direction = t.direction AND o.symbol <> t.symbol AND o.entry_ts < t.entry_ts AND o.entry_ts >= t.entry_ts - 1209600000 GROUP BY t.symbol, t.entry_ts, t.direction""",
        **LEDGER,
        g="SELECT t.symbol, t.entry_ts, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, n_name AS sector FROM trades t JOIN supplier ON t.symbol = 'S' || s_suppkey JOIN nation ON n_nationkey = s_nationkey",
    ),
)
def _(t: Tables) -> DataFrame:
    sectors = t.universe.select("symbol", F.col("tags")[0].alias("sector"))
    trades = trades_of(t).join(sectors, "symbol").select("symbol", "entry_ts", F.col("entry_ts").alias("ts"), F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"), "sector")
    return risk.sector_guard(trades, "14d")


_W_SQL = "SELECT r_name AS portfolio, symbol, tags[1] AS sector, s_acctbal / 20000 AS w0 FROM universe"
_LIMIT_CTES = {
    "w": _W_SQL,
    "w1": "SELECT *, CASE WHEN abs(w0) > 0.3 THEN sign(w0) * 0.3::DOUBLE ELSE w0 END AS w1, abs(w0) > 0.3 AS t1 FROM w",
    "w2": "SELECT *, CASE WHEN g > 0.5 THEN w1 * 0.5::DOUBLE / g ELSE w1 END AS w2, g > 0.5 AS t2 FROM (SELECT *, sum(abs(w1)) OVER (PARTITION BY portfolio, sector) AS g FROM w1)",
    "w3": "SELECT * EXCLUDE (g), CASE WHEN g > 2 THEN w2 * 2 / g ELSE w2 END AS w3, g > 2 AS t3 FROM (SELECT * EXCLUDE (g), sum(abs(w2)) OVER (PARTITION BY portfolio) AS g FROM w2)",
    "w4": "SELECT *, CASE WHEN abs(net) > 1 THEN w3 - (net - sign(net)) / n ELSE w3 END AS w4, abs(net) > 1 AS t4 FROM (SELECT *, sum(w3) OVER (PARTITION BY portfolio) AS net, count(*) OVER (PARTITION BY portfolio) AS n FROM w3)",
}


@query(
    "prj_19_position_limits",
    "portfolio symbol fired",
    "w",
    with_("universe", "SELECT portfolio, symbol, w4 AS w, concat_ws(',', CASE WHEN t1 THEN 'single' END, CASE WHEN t2 THEN 'sector' END, CASE WHEN t3 THEN 'gross' END, CASE WHEN t4 THEN 'net' END) AS fired FROM w4", **_LIMIT_CTES),
)
def _(t: Tables) -> DataFrame:
    w = t.universe.select(F.col("r_name").alias("portfolio"), "symbol", F.col("tags")[0].alias("sector"), (F.col("s_acctbal") / 20000).alias("w"))
    out = risk.apply_limits(w, max_single=0.3, max_sector=0.5, max_gross=2.0, max_net=1.0)
    return out.withColumn("fired", F.array_join("triggered", ","))


_SIZE_CTES = {
    "r": "SELECT *, coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), 0) * sqrt(13) AS vol, avg(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) AS m, coalesce(var_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), 0) AS v, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS side, least(0.25, abs(ret)) AS dd FROM panel",
    "s": "SELECT *, CASE WHEN vol < 1e-6 THEN 5 ELSE least(5, 0.15::DOUBLE / vol) END AS scaler, CASE WHEN dd >= 0.2 THEN 0 ELSE 1 - dd * 5 END AS dds FROM r",
}


@query(
    "prj_13_position_size",
    "symbol ts",
    "scaler target_usd kelly_usd fixed_usd",
    with_(
        "panel",
        """SELECT symbol, ts, scaler, side * least(1, scaler) * dds * 10000 AS target_usd, CASE WHEN v > 0 AND sign(m) = side THEN side * least(1, abs(0.5 * m / v)) ELSE 0 END * dds * 10000 AS kelly_usd, side * 0.01 * dds * 10000 AS fixed_usd FROM s""",
        **_SIZE_CTES,
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.series import lookback, series_window

    w = lookback(series_window(), 60)
    df = risk.vol_target_scaler(t.panel, 0.15, 13.0)
    df = df.withColumns({"mean": F.avg("ret").over(w), "variance": F.coalesce(F.var_samp("ret").over(w), F.lit(0.0)), "side": F.when(F.col("ret") > 0, 1).otherwise(-1), "drawdown": F.least(F.lit(0.25), F.abs("ret"))})
    for method, out in {"vol_target": "target_usd", "kelly": "kelly_usd", "fixed_fraction": "fixed_usd"}.items():
        df = risk.size_position(df, 10_000.0, method).withColumnRenamed("position_usd", out)
    return df


@query(
    "prj_14_recent_kelly",
    "symbol entry_ts",
    "kelly_risk",
    with_(
        "bn",
        """SELECT symbol, entry_ts, CASE WHEN k < 20 THEN 0.02 WHEN aw > 0 AND al > 0 THEN greatest(0.005, least(0.05, (p * aw / al - (1 - p)) / (aw / al) * 0.5)) ELSE 0.02 END AS kelly_risk FROM (
        SELECT symbol, entry_ts, count(*) OVER w AS k, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER w AS p, avg(abs(pnl_pct)) FILTER (pnl > 0) OVER w AS aw, avg(abs(pnl_pct)) FILTER (pnl <= 0) OVER w AS al FROM trades
        WINDOW w AS (PARTITION BY symbol ORDER BY entry_ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))""",
        **LEDGER,
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.memory import recent_kelly

    return recent_kelly(trades_of(t), ["symbol"])


_EXIT_SQL = """SELECT *, CASE policy WHEN 'momentum' THEN CASE WHEN NOT breakeven0 AND gain > 0 AND gain >= atr THEN entry_price WHEN breakeven0 AND sg * (peak - sg * atr * 1.5 - stop) > 0 THEN peak - sg * atr * 1.5 END
    WHEN 'funding' THEN CASE WHEN elapsed_s > 7200 AND abs(funding) > 0 AND sg * (entry_price - sg * atr * 1.5 - stop) < 0 THEN entry_price - sg * atr * 1.5 END
    WHEN 'mean_reversion' THEN CASE WHEN elapsed_s > 900 AND NOT breakeven0 AND sg * (entry_price - sg * atr * 0.5 - stop) > 0 THEN entry_price - sg * atr * 0.5 END END AS new_stop,
    breakeven0 OR (policy = 'momentum' AND gain > 0 AND gain >= atr) OR (policy = 'mean_reversion' AND elapsed_s > 900) AS breakeven, elapsed_s >= CASE policy WHEN 'funding' THEN 28800 WHEN 'mean_reversion' THEN 1800 ELSE 14400 END AS expired
    FROM (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (price - entry_price) AS gain, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM ps)"""


@query(
    "prj_20_exit_policies",
    "symbol ts policy side breakeven expired",
    "new_stop",
    with_(
        "bars",
        _EXIT_SQL,
        ps="""SELECT symbol, ts, CASE num_trades % 4 WHEN 0 THEN 'momentum' WHEN 1 THEN 'funding' WHEN 2 THEN 'mean_reversion' ELSE 'basic' END AS policy, CASE WHEN buy_volume > sell_volume THEN 'long' ELSE 'short' END AS side, open AS entry_price,
        close AS price, CASE WHEN buy_volume > sell_volume THEN high ELSE low END AS peak, CASE WHEN buy_volume > sell_volume THEN open * 0.97::DOUBLE ELSE open * 1.03::DOUBLE END AS stop, (high - low) / 2 + 1 AS atr, volume * 200 AS elapsed_s, total_pnl AS funding, net_flow > 0 AS breakeven0 FROM bars""",
    ),
)
def _(t: Tables) -> DataFrame:
    long = F.col("buy_volume") > F.col("sell_volume")
    k = F.col("num_trades") % 4
    positions = t.bars.select(
        "symbol",
        "ts",
        F.when(k == 0, "momentum").when(k == 1, "funding").when(k == 2, "mean_reversion").otherwise("basic").alias("policy"),
        F.when(long, "long").otherwise("short").alias("side"),
        F.col("open").alias("entry_price"),
        F.col("close").alias("price"),
        F.when(long, F.col("high")).otherwise(F.col("low")).alias("peak"),
        F.when(long, F.col("open") * 0.97).otherwise(F.col("open") * 1.03).alias("stop"),
        ((F.col("high") - F.col("low")) / 2 + 1).alias("atr"),
        (F.col("volume") * 200).alias("elapsed_s"),
        F.col("total_pnl").alias("funding"),
        (F.col("net_flow") > 0).alias("breakeven"),
    )
    return risk.exit_update(positions)


# ── portfolios ─────────────────────────────────────────────────────────────────────────────

_BY_STRATEGY = "SELECT strategy AS s, ts, sum(equity) AS equity FROM curve GROUP BY 1, 2"
_PORT_CTES = {
    **GRID_CTES,
    "sc": _BY_STRATEGY,
    "ix": "SELECT s, ts, equity, row_number() OVER (PARTITION BY s ORDER BY ts) - 1 AS idx FROM sc",
    "pc": "SELECT idx, sum(equity) + 1000 AS equity, sum(equity) + 1000 - 4000000 AS pnl FROM ix GROUP BY 1 HAVING count(*) = 4",
}


def _strategy_curves(t: Tables) -> DataFrame:
    return grid_curve(t).groupBy("strategy", "ts").agg(F.sum("equity").alias("equity"))


@query("agg_28_portfolio_curve", "idx", "equity pnl", with_("bn", "SELECT * FROM pc", **_PORT_CTES), digits=3)
def _(t: Tables) -> DataFrame:
    return portfolio.portfolio_curve(_strategy_curves(t), 4_000_000.0, 1000.0)


@query(
    "agg_28_portfolio_metrics",
    "n",
    "final_equity total_return_pct sharpe max_drawdown_pct",
    with_(
        "bn",
        """SELECT count(*) AS n, arg_max(equity, idx) AS final_equity, (arg_max(equity, idx) / arg_min(equity, idx) - 1) * 100 AS total_return_pct, avg(r) / stddev_pop(r) * sqrt(52) AS sharpe, min((equity - pk) / pk * 100) AS max_drawdown_pct
        FROM (SELECT *, equity / lag(equity) OVER (ORDER BY idx) - 1 AS r, max(equity) OVER (ORDER BY idx) AS pk FROM pc)""",
        **_PORT_CTES,
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return portfolio.portfolio_metrics(portfolio.portfolio_curve(_strategy_curves(t), 4_000_000.0, 1000.0), 52.0)


@query(
    "agg_29_monthly_matrix",
    "month",
    "m1 m2 m3 m4",
    with_(
        "bn",
        "SELECT month, " + ", ".join(f"avg(r) FILTER (strategy = '{a}/{b}') AS m{i + 1}" for i, (a, b) in enumerate(GRID)) + " FROM mr GROUP BY 1",
        **GRID_CTES,
        mr="""SELECT strategy, symbol, month, (coalesce(lead(f) OVER (PARTITION BY strategy, symbol ORDER BY month), l) - f) / f * 100 AS r FROM (SELECT strategy, symbol, strftime(make_timestamp_ms(ts), '%Y-%m') AS month, arg_min(equity, ts) AS f, arg_max(equity, ts) AS l FROM curve GROUP BY 1, 2, 3)""",
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.pnl import monthly_returns

    names = [f"{a}/{b}" for a, b in GRID]
    wide = portfolio.monthly_matrix(monthly_returns(grid_curve(t), RUN_KEYS), names)
    return wide.withColumnsRenamed({n: f"m{i + 1}" for i, n in enumerate(names)})


@query(
    "agg_29_validated_edge",
    "strategy symbol rank",
    "sharpe total_return_pct",
    with_("bn", "SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY sharpe DESC, symbol) AS rank FROM met WHERE total_return_pct > -90 AND sharpe > -1.5", **GRID_CTES),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    # the test prices are noise that no rule earns on, so the limits of the query are loose ones
    shifted = grid_metrics(t).withColumns({"total_return_pct": F.col("total_return_pct") + 90, "sharpe": F.col("sharpe") + 1.7})
    kept = portfolio.validated_edge(shifted, 0.2)
    return kept.withColumns({"total_return_pct": F.col("total_return_pct") - 90, "sharpe": F.col("sharpe") - 1.7})


@query(
    "agg_29_blacklist",
    "symbol strategies",
    "best_return",
    with_("bn", "SELECT symbol, count(*) AS strategies, max(total_return_pct) AS best_return FROM met GROUP BY 1 HAVING max(total_return_pct) < 0", **GRID_CTES),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return portfolio.blacklist(grid_metrics(t))


@query("prj_17_research_grade", "strategy symbol grade", "", with_("bn", """SELECT strategy, symbol, CASE WHEN deg >= 0.7 AND pp >= 90 AND dd > -15 AND rt > 10 AND pr = 0 AND sharpe > 1 THEN 'A' WHEN deg >= 0.4 AND pp >= 75 AND dd > -25 AND rt > 0 AND pr <= 5 THEN 'B'
    WHEN rt > 0 AND pp >= 50 AND pr <= 20 THEN 'C' WHEN rt > -10 AND n > 0 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, total_return_pct + 97 AS rt, max_drawdown_pct / 5 AS dd, abs(sharpe) / 3 AS deg, 100 + sharpe * 5 AS pp, greatest(0, -sharpe - 1) * 4 AS pr FROM met)""", **GRID_CTES))
def _(t: Tables) -> DataFrame:
    m = grid_metrics(t).withColumns(
        {
            "return_pct": F.col("total_return_pct") + 97,
            "max_drawdown_pct": F.col("max_drawdown_pct") / 5,
            "degradation": F.abs("sharpe") / 3,
            "prob_profit": 100 + F.col("sharpe") * 5,
            "prob_ruin": F.greatest(F.lit(0.0), -F.col("sharpe") - 1) * 4,
            "trades": F.col("n"),
        }
    )
    return risk.research_grade(m)


_TR_CTES = {
    "bt": "SELECT symbol, ts, any_value(entry_price) AS ep FROM (SELECT symbol, entry_ts AS ts, entry_price FROM trades) GROUP BY 1, 2",
}


@query(
    "agg_19_execution_report",
    "symbol trades twap_count ioc_count grade score",
    "entry_slippage exit_slippage slippage slippage_cost fee_cost total_cost twap_slippage ioc_slippage signal_to_fill_ms submit_to_fill_ms p99_ms",
    with_(
        "bn",
        """SELECT symbol, count(*) AS trades, count(*) FILTER (tw) AS twap_count, count(*) FILTER (NOT tw) AS ioc_count, avg(es) AS entry_slippage, avg(xs) AS exit_slippage, (avg(es) + avg(xs)) / 2 AS slippage,
        sum(es / 10000 * size * entry_price + xs / 10000 * size * exit_price) AS slippage_cost, sum(size * (entry_price + exit_price)) * 0.0003::DOUBLE AS fee_cost,
        sum(es / 10000 * size * entry_price + xs / 10000 * size * exit_price) + sum(size * (entry_price + exit_price)) * 0.0003::DOUBLE AS total_cost, coalesce(avg(es) FILTER (tw), 0) AS twap_slippage, coalesce(avg(es) FILTER (NOT tw), 0) AS ioc_slippage,
        avg(lat) AS signal_to_fill_ms, avg(lat) / 2 AS submit_to_fill_ms, list_sort(list(lat))[least(count(*) - 1, CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT)) + 1] AS p99_ms,
        CASE WHEN (avg(es) + avg(xs)) / 2 < 2 THEN 'A' WHEN (avg(es) + avg(xs)) / 2 < 5 THEN 'B' WHEN (avg(es) + avg(xs)) / 2 < 10 THEN 'C' WHEN (avg(es) + avg(xs)) / 2 < 20 THEN 'D' ELSE 'F' END AS grade,
        CASE WHEN (avg(es) + avg(xs)) / 2 < 2 THEN 95 WHEN (avg(es) + avg(xs)) / 2 < 5 THEN 80 WHEN (avg(es) + avg(xs)) / 2 < 10 THEN 65 WHEN (avg(es) + avg(xs)) / 2 < 20 THEN 45 ELSE 25 END AS score FROM x GROUP BY 1""",
        **LEDGER,
        x="""SELECT *, bars_held % 2 = 0 AS tw, bars_held * 1000.0::DOUBLE AS lat, CASE WHEN bars_held % 3 = 0 THEN 7 ELSE abs((entry_price - em) / em) * 10000 END AS es, abs((exit_price - xm) / xm) * 10000 AS xs
        FROM (SELECT *, entry_price / (1 + side * 0.0005::DOUBLE) AS em, exit_price * 1.0002::DOUBLE AS xm FROM trades)""",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return cost.execution_report(_executed(t), ["symbol"])


def _executed(t: Tables) -> DataFrame:
    base = 1_000_000_000.0
    return trades_of(t).withColumns(
        {
            "entry_mid": F.col("entry_price") / (1 + F.col("side") * 0.0005),
            "exit_mid": F.col("exit_price") * 1.0002,
            "entry_slippage_bps": F.when(F.col("bars_held") % 3 == 0, 7.0).otherwise(0.0),
            "exit_slippage_bps": F.lit(0.0),
            "method": F.when(F.col("bars_held") % 2 == 0, "twap").otherwise("ioc"),
            "signal_ts": F.lit(base),
            "submit_ts": base + F.col("bars_held") * 0.5,
            "fill_ts": base + F.col("bars_held") * 1.0,
            "side": F.when(F.col("side") > 0, "long").otherwise("short"),
        }
    )


@query(
    "agg_20_trade_attribution",
    "symbol trades",
    "alpha_pnl beta_pnl funding_pnl execution_cost slippage_cost fee_cost beta r2 total_pnl alpha_pct beta_pct",
    with_(
        "bn",
        """SELECT *, alpha_pnl + beta_pnl + funding_pnl + execution_cost AS total_pnl, alpha_pnl / (abs(alpha_pnl) + abs(beta_pnl) + abs(funding_pnl) + abs(execution_cost)) * 100 AS alpha_pct,
        beta_pnl / (abs(alpha_pnl) + abs(beta_pnl) + abs(funding_pnl) + abs(execution_cost)) * 100 AS beta_pct FROM (SELECT *, gross - beta_pnl AS alpha_pnl, slippage_cost + fee_cost AS execution_cost FROM (
        SELECT symbol, count(*) AS trades, sum(pnl) AS gross, 0 AS funding_pnl, -sum(abs(entry_price - entry_price / (1 + side * 0.0005::DOUBLE)) * size + exit_price * 0.0002::DOUBLE * size) AS slippage_cost, -sum(size * (entry_price + exit_price)) * 0.0003::DOUBLE AS fee_cost,
        regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, regr_slope(y, x) * sum(x) * 10000 AS beta_pnl FROM z GROUP BY 1))""",
        **LEDGER,
        z="""SELECT *, pnl / eq AS y, (exit_price - entry_price) / entry_price AS x FROM (SELECT *, 10000 + coalesce(sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eq FROM trades)""",
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return cost.attribute_trades(_executed(t), ["symbol"])


@query("pnl_06_pairs_trading", "pair entry_ts exit_ts side reason bars_held", "a0 b0 a1 b1 pnl")
def _(t: Tables) -> DataFrame:
    bars = t.type_bars
    pairs = portfolio.pair_bars(bars, "click", "view").unionByName(portfolio.pair_bars(bars, "purchase", "signup"))
    return portfolio.pairs_trades(portfolio.pairs_position(portfolio.ratio_zscore(pairs, 48)))


@query(
    "join_01_pair_bars",
    "pair ts",
    "close_a close_b z",
    with_(
        "type_bars",
        f"""SELECT pair, ts, close_a, close_b, CASE WHEN rn > 48 AND stddev_pop(ratio) {{w}} > 0 THEN (ratio - avg(ratio) {{w}}) / stddev_pop(ratio) {{w}} END AS z FROM p""".format(w="OVER (ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)"),
        p="SELECT 'click/view' AS pair, a.ts, a.close AS close_a, b.close AS close_b, CASE WHEN b.close > 0 THEN a.close / b.close END AS ratio, row_number() OVER (ORDER BY a.ts) AS rn FROM type_bars a JOIN type_bars b ON a.ts = b.ts AND a.symbol = 'click' AND b.symbol = 'view'",
    ),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return portfolio.ratio_zscore(portfolio.pair_bars(t.type_bars, "click", "view"), 48)
