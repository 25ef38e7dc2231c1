"""Trading costs: fees, impact, funding, slippage, shortfall, capacity, basket impact."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (least 14-day volume in USD, maker bps, taker bps) per instrument, and the add-on bps.
FEE_TIERS = {
    "perp": [(0, 1.5, 4.5), (5e6, 1.2, 4.0), (25e6, 0.8, 3.5), (100e6, 0.4, 3.0), (500e6, 0.0, 2.8), (2e9, -0.1, 2.4)],
    "spot": [(0, 4.0, 7.0), (5e6, 3.5, 6.0), (25e6, 3.0, 5.0), (100e6, 2.0, 4.5), (500e6, 1.5, 4.0), (2e9, 0.0, 3.5)],
}
BUILDER_BPS = {"perp": 3.0, "spot": 100.0}
GAMMA = 0.7


def base_fee_bps(volume_14d: Column, is_taker: Column, instrument: str = "perp") -> Column:
    """Fee of the highest tier whose volume is reached."""
    if instrument not in FEE_TIERS:
        raise ValueError(f"instrument must be perp or spot; got {instrument!r}")
    (_, maker, taker), *higher = FEE_TIERS[instrument]

    def side(m: float, t: float) -> Column:
        return F.when(is_taker, t).otherwise(m)

    chain = None
    for least, m, t in reversed(higher):
        reached = volume_14d >= least
        chain = F.when(reached, side(m, t)) if chain is None else chain.when(reached, side(m, t))
    return chain.otherwise(side(maker, taker))


def fee_bps(volume_14d: Column, is_taker: Column, instrument: str = "perp", builder: bool = True) -> Column:
    return base_fee_bps(volume_14d, is_taker, instrument) + (BUILDER_BPS[instrument] if builder else 0.0)


def sqrt_impact_bps(size_usd: Column, adv_usd: Column, daily_vol: Column, gamma: float = GAMMA) -> Column:
    """γ·σ·√(size/ADV) in bps; 0 for no trade, NULL without volume."""
    return F.when(size_usd <= 0, 0.0).when(adv_usd > 0, gamma * daily_vol * F.sqrt(size_usd / adv_usd) * 10_000)


def expected_funding(side: Column, notional: Column, rate: Column, hours: Column, drift: Column | float = 0.0, interval_h: float = 1.0) -> Column:
    """Funding cost of holding: the rate, with linear drift, over the rounded number of intervals."""
    n = F.rint(hours / interval_h)
    drift = F.lit(drift) if isinstance(drift, float) else drift
    total = n * rate + drift * interval_h * n * (n - 1) / 2
    return F.when(n > 0, side * notional * total).otherwise(0.0)


def trade_cost(trades: DataFrame, *, instrument: str = "perp", gamma: float = GAMMA) -> DataFrame:
    """Fee, funding, impact and book slippage in bps of notional and USD, and their sum.

    Columns read: ``notional, side (±1), is_taker, volume_14d, hours, funding_rate, adv_usd, daily_vol``
    and ``slippage_bps`` (from a book walk, may be NULL).
    """
    n = F.col("notional")
    fee = fee_bps(F.col("volume_14d"), F.col("is_taker"), instrument)
    funding = F.when(n > 0, expected_funding(F.col("side"), n, F.col("funding_rate"), F.col("hours")) / n * 10_000).otherwise(0.0)
    impact = F.coalesce(sqrt_impact_bps(n, F.col("adv_usd"), F.col("daily_vol"), gamma), F.lit(0.0))
    parts = {"fee": fee, "funding": funding, "impact": impact, "slippage": F.coalesce(F.col("slippage_bps"), F.lit(0.0))}
    df = trades.withColumns({f"{p}_bps": c for p, c in parts.items()})
    df = df.withColumn("total_bps", sum((F.col(f"{p}_bps") for p in parts), F.lit(0.0)))
    return df.withColumns({f"{p}_usd": n * F.col(f"{p}_bps") / 10_000 for p in [*parts, "total"]})


def implementation_shortfall(orders: DataFrame, fills: DataFrame, strict: bool = True) -> DataFrame:
    """Timing, opportunity and commission cost of each parent order against its decision price.

    ``orders``: order_id, side buy/sell, decision_price, intended_size, final_mid. ``fills``: order_id,
    price, size, fee. An over-filled order is an error, or is flagged and left out of the sums when not ``strict``.
    """
    done = fills.groupBy("order_id").agg(F.sum("size").alias("filled"), F.sum(F.col("price") * F.col("size")).alias("_cost"), F.sum("fee").alias("commission_usd"))
    df = orders.join(done, "order_id", "left").fillna(0.0, ["filled", "_cost", "commission_usd"])
    over = F.col("filled") > F.col("intended_size") + 1e-9
    if strict:
        problem = F.concat(F.lit("over-filled order "), F.col("order_id").cast("string"))
        df = df.withColumn("filled", F.when(over, F.raise_error(problem).cast("double")).otherwise(F.col("filled")))
    else:
        df = df.withColumn("overfilled", over)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    average = F.when(F.col("filled") > 0, F.col("_cost") / F.col("filled"))
    unfilled = F.greatest(F.lit(0.0), F.col("intended_size") - F.col("filled"))
    df = df.withColumns(
        {
            "avg_fill": average,
            "unfilled": unfilled,
            "timing_usd": F.coalesce(sign * F.col("filled") * (average - F.col("decision_price")), F.lit(0.0)),
            "opportunity_usd": sign * unfilled * (F.col("final_mid") - F.col("decision_price")),
        }
    )
    df = df.withColumn("total_usd", F.col("timing_usd") + F.col("opportunity_usd") + F.col("commission_usd"))
    notional = F.col("intended_size") * F.col("decision_price")
    return df.withColumns({f"{p}_bps": F.when(notional > 0, F.col(f"{p}_usd") / notional * 10_000) for p in ("timing", "opportunity", "commission", "total")}).drop("_cost")


def fit_impact(observed: DataFrame, keys: Sequence[str] = ("symbol",), least: int = 5) -> DataFrame:
    """Power law |slippage| = a·participation^b by least squares on logs, per key; NULL with too few points."""
    valid = observed.where((F.col("participation") > 0) & (F.abs("slippage_bps") > 0))
    logs = valid.select(*keys, F.log("participation").alias("_x"), F.log(F.abs("slippage_bps")).alias("_y"))
    fit = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("_b"),
        F.regr_intercept("_y", "_x").alias("_a"),
        F.regr_r2("_y", "_x").alias("_r2"),
    )
    enough = F.col("n") >= least
    return fit.select(*keys, "n", F.when(enough, F.exp("_a")).alias("a"), F.when(enough, F.col("_b")).alias("b"), F.when(enough, F.col("_r2")).alias("r2"))


def impact_capacity(alpha_bps: Column, adv_usd: Column, daily_vol: Column, share: float = 0.5, gamma: float = GAMMA, upper: float = 1e10) -> Column:
    """Size at which square-root impact reaches ``share`` of alpha: the law solved for the size."""
    target = share * alpha_bps
    size = adv_usd * F.pow(target / (gamma * daily_vol * 10_000), F.lit(2.0))
    return F.when((alpha_bps <= 0) | (adv_usd <= 0), 0.0).when(daily_vol <= 0, upper).otherwise(F.least(size, F.lit(upper)))


def depth_capacity(levels: DataFrame, on: Sequence[str], max_slippage_bps: float = 10.0) -> DataFrame:
    """Largest notional per book side that fills within the slippage limit of ``mid``.

    With S size and C cost taken from better levels, x more at price p keeps the average within the
    limit price L while C + p·x ≤ L·(S + x); once a level is cut, the levels behind it solve to 0.
    """
    buy = F.col("side") == "ask"
    sign = F.when(buy, 1.0).otherwise(-1.0)
    limit = F.col("mid") * (1 + sign * max_slippage_bps / 10_000)
    w = Window.partitionBy(*on, "side").orderBy(sign * F.col("px"), "sz").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    df = levels.where("px > 0 and sz > 0").withColumns(
        {"_s": F.coalesce(F.sum("sz").over(w), zero), "_c": F.coalesce(F.sum(F.col("px") * F.col("sz")).over(w), zero), "_l": limit, "_sg": sign}
    )
    beyond = F.col("_sg") * (F.col("px") - F.col("_l"))
    room = F.col("_sg") * (F.col("_l") * F.col("_s") - F.col("_c"))
    take = F.when(beyond <= 0, F.col("sz")).otherwise(F.greatest(zero, F.least(F.col("sz"), room / F.when(beyond > 0, beyond))))
    return df.groupBy(*on, "side").agg(F.sum(F.col("px") * take).alias("depth_usd"))


def capacity(df: DataFrame, *, share: float = 0.5, max_adv: float = 0.05, gamma: float = GAMMA) -> DataFrame:
    """Binding capacity of rows with ``alpha_bps, adv_usd, daily_vol`` and an optional ``depth_usd``."""
    impact = impact_capacity(F.col("alpha_bps"), F.col("adv_usd"), F.col("daily_vol"), share, gamma)
    df = df.withColumns(
        {
            "impact_usd": impact,
            "adv_cap_usd": F.when(F.col("adv_usd") > 0, F.col("adv_usd") * max_adv).otherwise(0.0),
            "breakeven_usd": impact_capacity(F.col("alpha_bps"), F.col("adv_usd"), F.col("daily_vol"), 1.0, gamma),
        }
    )
    least = F.least("impact_usd", "adv_cap_usd", "depth_usd") if "depth_usd" in df.columns else F.least("impact_usd", "adv_cap_usd")
    df = df.withColumn("capacity_usd", least)
    binding = F.when(F.col("capacity_usd") == F.col("impact_usd"), "impact").when(F.col("capacity_usd") == F.col("adv_cap_usd"), "adv").otherwise("l2_depth")
    return df.withColumn("binding", binding)


def capacity_curve(df: DataFrame, points: int = 30, gamma: float = GAMMA) -> DataFrame:
    """Impact and net alpha at ``points`` sizes up to twice the capacity or 1.5 times breakeven."""
    top = F.greatest(F.col("capacity_usd") * 2, F.col("breakeven_usd") * 1.5, F.lit(1.0))
    out = df.withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(points)))).withColumn("size_usd", top * F.col("point") / points)
    impact = sqrt_impact_bps(F.col("size_usd"), F.col("adv_usd"), F.col("daily_vol"), gamma)
    return out.withColumn("impact_bps", impact).withColumn("net_alpha_bps", F.col("alpha_bps") - F.col("impact_bps"))


def basket_impact(trades: DataFrame, correlations: DataFrame | Callable[[DataFrame], DataFrame], damping: float = 1.0, gamma: float = GAMMA) -> DataFrame:
    """Impact on each leg of a basket from all legs: Σ sign_j·ρ_ij·own_j, off-diagonal terms damped.

    ``trades``: symbol, q (signed USD), adv_usd, daily_vol. ``correlations``: a < b, corr; or, for many symbols, what
    makes (symbol, total) from weights (symbol, w), as ``panel.weighted_correlations``, with no row per pair.
    """
    own = F.coalesce(sqrt_impact_bps(F.abs("q"), F.col("adv_usd"), F.col("daily_vol"), gamma), F.lit(0.0))
    legs = trades.withColumns({"own_bps": own, "_push": F.signum("q") * own})
    if callable(correlations):
        pushed = correlations(legs.select("symbol", F.col("_push").alias("w"))).select("symbol", (F.col("total") * damping).alias("cross_bps"))
    else:
        both = correlations.select("a", "b", "corr").unionByName(correlations.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
        pushed = both.join(legs.select(F.col("symbol").alias("b"), "_push"), "b").groupBy(F.col("a").alias("symbol")).agg((F.sum(F.col("corr") * F.col("_push")) * damping).alias("cross_bps"))
    out = legs.join(pushed, "symbol", "left").withColumn("cross_bps", F.coalesce("cross_bps", F.lit(0.0)))
    out = out.withColumn("impact_bps", F.col("_push") + F.col("cross_bps"))
    return out.withColumns({"cost_usd": F.col("q") * F.col("impact_bps") / 10_000, "own_cost_usd": F.abs("q") * F.col("own_bps") / 10_000}).drop("_push")


# Fee per side assumed by the execution report, and the grade limits.
REPORT_FEE = 0.0003
GRADES = [("A", 95), ("B", 80), ("C", 65), ("D", 45), ("F", 25)]
GRADE_BPS = [2, 5, 10, 20]
GRADE_ATR_SHARE = [0.05, 0.10, 0.15, 0.20]


def _graded(value: Column, limits: Sequence[float], part: int) -> Column:
    chain = None
    for limit, grade in zip(limits, GRADES):
        chain = F.when(value < limit, grade[part]) if chain is None else chain.when(value < limit, grade[part])
    return chain.otherwise(GRADES[-1][part])


def execution_report(trades: DataFrame, keys: Sequence[str], atr_bps: Column | None = None) -> DataFrame:
    """Slippage, cost, method split, latency and grade per key.

    Slippage that is 0 is derived from the mid price when that is known. The 99th latency percentile is
    an order statistic of each key.
    """
    from marketspark.operators.ranks import value_at_rank

    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)

    def slip(which: str, direction: float) -> Column:
        px, mid, given = F.col(f"{which}_price"), F.col(f"{which}_mid"), F.coalesce(F.col(f"{which}_slippage_bps"), F.lit(0.0))
        derived = direction * sign * (px - mid) / mid * 10_000
        return F.abs(F.when((given == 0) & (mid > 0) & (px > 0), derived).otherwise(given))

    df = trades.withColumns({"_es": slip("entry", 1.0), "_xs": slip("exit", -1.0)})
    entry, exit_ = F.col("size") * F.col("entry_price"), F.col("size") * F.col("exit_price")
    latency = F.when((F.col("signal_ts") > 0) & (F.col("fill_ts") > 0), (F.col("fill_ts") - F.col("signal_ts")) * 1000.0)
    submit = F.when((F.col("submit_ts") > 0) & (F.col("fill_ts") > 0), (F.col("fill_ts") - F.col("submit_ts")) * 1000.0)
    df = df.withColumns({"_lat": latency, "_sub": submit})
    twap = F.col("method") == "twap"
    zero = F.lit(0.0)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("_es").alias("entry_slippage"),
        F.avg("_xs").alias("exit_slippage"),
        ((F.avg("_es") + F.avg("_xs")) / 2).alias("slippage"),
        F.sum(F.col("_es") / 10_000 * entry + F.col("_xs") / 10_000 * exit_).alias("slippage_cost"),
        F.sum((entry + exit_) * REPORT_FEE).alias("fee_cost"),
        F.count(F.when(twap, 1)).alias("twap_count"),
        F.count(F.when(~twap, 1)).alias("ioc_count"),
        F.coalesce(F.avg(F.when(twap, F.col("_es"))), zero).alias("twap_slippage"),
        F.coalesce(F.avg(F.when(~twap, F.col("_es"))), zero).alias("ioc_slippage"),
        F.coalesce(F.avg("_lat"), zero).alias("signal_to_fill_ms"),
        F.coalesce(F.avg("_sub"), zero).alias("submit_to_fill_ms"),
        *([F.avg(atr_bps).alias("_atr")] if atr_bps is not None else []),
    )
    n = F.col("n")
    p99 = value_at_rank(df.where("_lat is not null"), keys, "_lat", {"p99_ms": F.least(n - 1, F.floor(n * 0.99)) + 1}).drop("n")
    out = out.join(p99, list(keys), "left").fillna(0.0, ["p99_ms"]).withColumn("total_cost", F.col("slippage_cost") + F.col("fee_cost"))
    s = F.col("slippage")
    if atr_bps is not None:
        ratio = F.when(F.col("_atr") > 0, s / F.col("_atr"))
        grade = [F.when(ratio.isNotNull(), _graded(ratio, GRADE_ATR_SHARE, p)).otherwise(_graded(s, GRADE_BPS, p)) for p in (0, 1)]
    else:
        grade = [_graded(s, GRADE_BPS, p) for p in (0, 1)]
    return out.withColumns({"grade": grade[0], "score": grade[1]}).drop("_atr")


def attribute_trades(trades: DataFrame, keys: Sequence[str], initial: float = 10_000.0) -> DataFrame:
    """Profit of a trade list split in alpha, beta, funding and execution, by regressing each trade's
    return on equity against the market's move over it."""
    w = Window.partitionBy(*keys).orderBy("entry_ts")
    price_pnl = F.col("pnl") - F.coalesce(F.col("funding"), F.lit(0.0))
    df = trades.withColumn("_pp", price_pnl)
    equity = initial + F.coalesce(F.sum("_pp").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_eq", equity)
    df = df.withColumns(
        {
            "_y": F.when(F.col("_eq") > 0, F.col("_pp") / F.col("_eq")).otherwise(0.0),
            "_x": F.when(F.col("entry_price") > 0, (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")).otherwise(0.0),
        }
    )

    def slip(which: str) -> Column:
        return F.when(F.col(f"{which}_mid") > 0, F.abs(F.col(f"{which}_price") - F.col(f"{which}_mid")) * F.col("size")).otherwise(0.0)

    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("_pp").alias("_gross"),
        F.sum(F.coalesce(F.col("funding"), F.lit(0.0))).alias("funding_pnl"),
        (-F.sum(slip("entry") + slip("exit"))).alias("slippage_cost"),
        (-F.sum(F.col("size") * (F.col("entry_price") + F.col("exit_price"))) * REPORT_FEE).alias("fee_cost"),
        F.regr_slope("_y", "_x").alias("_b"),
        F.regr_r2("_y", "_x").alias("_r2"),
        F.sum("_x").alias("_mkt"),
    )
    fitted = F.col("trades") >= 3
    zero = F.lit(0.0)
    agg = agg.withColumns(
        {
            "beta": F.when(fitted, F.col("_b")).otherwise(zero),
            "r2": F.when(fitted, F.col("_r2")).otherwise(zero),
            "beta_pnl": F.when(fitted, F.col("_b") * F.col("_mkt") * initial).otherwise(zero),
            "execution_cost": F.col("slippage_cost") + F.col("fee_cost"),
        }
    )
    agg = agg.withColumn("alpha_pnl", F.col("_gross") - F.col("beta_pnl"))
    parts = ["alpha_pnl", "beta_pnl", "funding_pnl", "execution_cost"]
    agg = agg.withColumn("total_pnl", sum((F.col(p) for p in parts), zero)).withColumn("_den", sum((F.abs(p) for p in parts), zero))
    shares = {p.split("_")[0] + "_pct": F.when(F.col("_den") > 0, F.col(p) / F.col("_den") * 100).otherwise(zero) for p in parts}
    return agg.withColumns(shares).drop("_gross", "_b", "_r2", "_mkt", "_den")


def accrued_funding(positions: DataFrame, funding: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Funding paid by each position (``pos_id, side ±1, notional, entry_ts, exit_ts``) at the rates in
    (entry, exit], with count and mean, from prefix sums at both ends: no row per position and rate."""
    from marketspark.operators.asof import asof_join
    from marketspark.operators.series import day_of, running_sums

    valid = funding.where(F.col("funding_rate").isNotNull()).select(*keys, "ts", "funding_rate")
    totals = running_sums(valid, {"_sum": F.col("funding_rate"), "_cnt": F.lit(1.0)}, keys=keys, slice_by=day_of()).drop("funding_rate")
    zero = F.lit(0.0)

    def upto(df: DataFrame, when: str, tag: str) -> DataFrame:
        at = asof_join(df.withColumn("ts", F.col(when)), totals, ["_sum", "_cnt"], keys=keys)
        return at.withColumns({f"_s{tag}": F.coalesce("_sum", zero), f"_n{tag}": F.coalesce("_cnt", zero)}).drop("_sum", "_cnt", "ts")

    both = upto(upto(positions, "entry_ts", "0"), "exit_ts", "1")
    n, total = F.col("_n1") - F.col("_n0"), F.col("_s1") - F.col("_s0")
    return both.withColumns(
        {
            "intervals": n.cast("long"),
            "cumulative_rate": F.when(n > 0, total).otherwise(zero),
            "average_rate": F.when(n > 0, total / n).otherwise(zero),
            "paid_usd": F.when(n > 0, F.col("side") * F.col("notional") * total).otherwise(zero),
        }
    ).drop("_s0", "_n0", "_s1", "_n1")
