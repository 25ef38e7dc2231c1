"""Least squares of many series at once, factors, signal combination.

OLS needs only sums of products, which Spark aggregates with map-side partials; the k×k systems
(one row per series) are solved in batches of result rows. Huber weights need the exact median of residuals
in every pass: a short series is fitted in one group, a long one (over ``GROUP_ROWS``) by passes of
aggregations over its rows, wherever they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.probability import normal_cdf
from marketspark.operators.panel import correlations, ledoit_wolf, moments
from marketspark.operators.ranks import percentiles
from marketspark.operators.series import lookback, series_window
from marketspark.operators.tiles import solve
from marketspark.session import cut_lineage, written

HUBER_C = 1.345  # fixed value
#: Median absolute deviation of a standard normal.
MAD = 0.6744897501960817
#: Rows of a series up to which it is fitted in one group.
GROUP_ROWS = 20_000


def _terms(xs: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]


def ols(df: DataFrame, y: str, xs: Sequence[str], *, keys: Sequence[str]) -> DataFrame:
    """Coefficients (intercept first) per key: ``n, coef array, r2`` and the inverse of X′X (``inv``, row-major).
    Series with fewer than k + 2 rows are left out."""
    k = len(xs) + 1
    names = list(keys)
    valid = df.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    terms = _terms(xs)
    products = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(k)]
    agg = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*products).alias("xx"),
        F.array(*[F.sum(c * F.col(y)) for c in terms]).alias("xy"),
        F.sum(F.col(y) * F.col(y)).alias("yy"),
    )
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefs, invs, r2s = [], [], []
            for xx, xy, yy, n in zip(pdf["xx"], pdf["xy"], pdf["yy"], pdf["n"]):
                m, v = np.array(xx, dtype=float).reshape(k, k), np.array(xy, dtype=float)
                try:
                    inv = np.linalg.inv(m)
                except np.linalg.LinAlgError:
                    inv = np.full((k, k), np.nan)
                b = inv @ v
                total = yy - v[0] * v[0] / n
                coefs.append(b.tolist())
                invs.append(inv.ravel().tolist())
                r2s.append(1 - (yy - b @ v) / total if total > 0 else None)
            yield pdf[names].assign(n=pdf["n"], coef=coefs, inv=invs, r2=r2s)

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", n long, coef array<double>, inv array<double>, r2 double"
    return agg.where(F.col("n") >= k + 2).mapInPandas(run, schema)


def residuals(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], *, keys: Sequence[str], out: str = "resid") -> DataFrame:
    """Rows with their residual; NULL where a series has no fit."""
    terms = _terms(xs)
    joined = df.join(fit.select(*keys, "coef"), list(keys), "left")
    fitted = sum((F.col("coef")[i] * t for i, t in enumerate(terms[1:], 1)), F.col("coef")[0])
    return joined.withColumn(out, F.col(y) - fitted).drop("coef")


def newey_west_lag(n: Column) -> Column:
    return F.floor(4.0 * F.pow(n / 100.0, F.lit(2 / 9)))


def _bartlett(rows: DataFrame, scores: Sequence[Column], names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, meat): (L + 1) times the Bartlett-weighted sum of products of scores along each series, row-major.

    The lag L grows with n and has no bound: with B the sum of the last L + 1 scores (scores outside the
    series count as zero), the weighted moment is ΣBB′/(L + 1). B is the difference of two running sums, so a
    row meets one other row, whatever L is.
    """
    k = len(scores)
    ordered = Window.partitionBy(*names).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(s).over(running) for s in scores]
    at = rows.select(*names, F.row_number().over(ordered).alias("_t"), F.count(F.lit(1)).over(Window.partitionBy(*names)).alias("_n"), F.array(*sums).alias("_p"))
    lag = newey_west_lag(F.col("_n")).cast("int")
    at = at.withColumn("_lag", lag)
    # the sum before row t is subtracted from that at row t + L, or from the last one near the end
    ends = at.where(F.col("_t") > F.col("_lag")).select(*names, (F.col("_t") - F.col("_lag") - 1).alias("_t"), F.col("_p").alias("_ahead"))
    whole = at.where(F.col("_t") == F.col("_n")).select(*names, F.col("_p").alias("_last"))
    zero = F.array(*[F.lit(0.0)] * k)
    # rows 1 .. n - L - 1 have an end ahead, the L rows before the last one meet the last sum
    inner = at.select(*names, "_t", F.col("_p").alias("_before")).join(ends, [*names, "_t"]).select(*names, "_before", "_ahead")
    tail = at.where((F.col("_t") >= F.col("_n") - F.col("_lag")) & (F.col("_t") < F.col("_n"))).join(whole, names).select(*names, F.col("_p").alias("_before"), F.col("_last").alias("_ahead"))
    # the first L + 1 rows have nothing before them
    head = at.where(F.col("_t") <= F.col("_lag") + 1).select(*names, zero.alias("_before"), F.col("_p").alias("_ahead"))
    blocks = inner.unionByName(tail).unionByName(head)
    b = [F.col("_ahead")[i] - F.col("_before")[i] for i in range(k)]
    return blocks.groupBy(*names).agg(F.array(*[F.sum(b[i] * b[j]) for i in range(k) for j in range(k)]).alias("meat"))


def ols_newey_west(df: DataFrame, y: str, xs: Sequence[str], *, keys: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """OLS with Newey–West (Bartlett) standard errors: per key ``coef, se, tstat, pvalue`` arrays, ``r2, lag``."""
    k = len(xs) + 1
    names = list(keys)
    fit = ols(df, y, xs, keys=keys)
    valid = df.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    resid = residuals(valid, fit, y, xs, keys=keys).where("resid is not null")
    meat = _bartlett(resid, [t * F.col("resid") for t in _terms(xs)], names, order)
    joined = fit.withColumn("lag", newey_west_lag(F.col("n")).cast("int")).join(meat, names).select(*names, "n", "coef", "inv", "r2", "lag", "meat")
    return _significance(_sandwich(joined, names, k), k)


def _sandwich(joined: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Standard errors from ``inv`` and ``meat`` of each row (keys, n, coef, inv, r2, lag, meat)."""
    types = dict(joined.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ses = []
            for inv, s, lags in zip(pdf["inv"], pdf["meat"], pdf["lag"]):
                inv, s = np.array(inv, dtype=float).reshape(k, k), np.array(s, dtype=float).reshape(k, k) / (lags + 1)
                ses.append(np.sqrt(np.maximum(np.diag(inv @ s @ inv), 0)).tolist())
            yield pdf[[*names, "n", "coef", "r2", "lag"]].assign(se=ses)

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", n long, coef array<double>, r2 double, lag int, se array<double>"
    return joined.mapInPandas(run, schema)


def _significance(out: DataFrame, k: int) -> DataFrame:
    t = [F.when(F.col("se")[i] > 0, F.col("coef")[i] / F.col("se")[i]) for i in range(k)]
    out = out.withColumn("tstat", F.array(*t))
    for i in range(k):
        out = out.withColumn(f"_p{i}", 2 * (1 - normal_cdf(F.abs(F.col("tstat")[i]))))
    return out.withColumn("pvalue", F.array(*[f"_p{i}" for i in range(k)])).drop(*[f"_p{i}" for i in range(k)])


def _huber_groups(valid: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: Sequence[str], steps: int) -> DataFrame:
    """The fit of short series, each in one group."""
    k, names, ordering, regressors = len(xs) + 1, list(keys), list(order), list(xs)
    types = dict(valid.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ordering, kind="stable")
        x = np.column_stack([np.ones(len(group)), group[regressors].to_numpy(dtype=float)])
        v, n = group[y].to_numpy(dtype=float), len(group)
        if n < k + 2:
            return pd.DataFrame(columns=[*names, "n", "coef", "r2", "se"])
        weights = np.ones(n)
        b = np.linalg.lstsq(x, v, rcond=None)[0]
        for _ in range(steps):
            r = v - x @ b
            scale = np.median(np.abs(r)) / MAD
            if scale <= 0:
                break
            weights = np.minimum(1.0, HUBER_C * scale / np.maximum(np.abs(r), 1e-300))
            before, root = b, np.sqrt(weights)
            b = np.linalg.lstsq(x * root[:, None], v * root, rcond=None)[0]
            if np.max(np.abs(b - before)) < 1e-8:
                break
        r = v - x @ b
        inv = np.linalg.pinv((x * weights[:, None]).T @ x)
        s = x * (weights * r)[:, None]
        lag = int(math.floor(4.0 * (n / 100.0) ** (2 / 9)))
        meat = s.T @ s
        for j in range(1, lag + 1):
            g = s[j:].T @ s[:-j]
            meat = meat + (1 - j / (lag + 1)) * (g + g.T)
        se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
        total = ((v - v.mean()) ** 2).sum()
        row = {c: group[c].iat[0] for c in names} | {"n": n, "coef": b.tolist(), "r2": 1 - (r @ r) / total if total > 0 else None, "se": se.tolist()}
        return pd.DataFrame([row])

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", n long, coef array<double>, r2 double, se array<double>"
    return valid.groupBy(*keys).applyInPandas(run, schema)


def _huber_passes(valid: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: Sequence[str], steps: int) -> DataFrame:
    """The fit of long series: each pass is an exact median of residuals and one aggregation of weighted products.

    Of a series only coefficients go from pass to pass: ``coef`` now, ``wcoef`` and ``scale`` that its weights are from.
    """
    k, names, terms = len(xs) + 1, list(keys), _terms(xs)
    types = dict(valid.dtypes)
    rows = cut_lineage(valid)
    named = ", ".join(f"{c} {types[c]}" for c in names)
    nothing = F.lit(None)
    fit = ols(rows, y, xs, keys=keys).select(*names, "n", "coef", nothing.cast("array<double>").alias("wcoef"), nothing.cast("double").alias("scale"), F.lit(False).alias("done"))
    state = cut_lineage(fit)

    def fitted(coef: str) -> Column:
        return sum((F.col(coef)[i] * t for i, t in enumerate(terms[1:], 1)), F.col(coef)[0])

    def weight(coef: str, scale: str) -> Column:
        return F.least(F.lit(1.0), HUBER_C * F.col(scale) / F.greatest(F.abs(F.col(y) - fitted(coef)), F.lit(1e-300)))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, ends = [], []
            for xx, xy, coef in zip(pdf["xx"], pdf["xy"], pdf["coef"], strict=True):
                b = np.linalg.lstsq(np.array(xx, float).reshape(k, k), np.array(xy, float), rcond=None)[0]
                made.append(b.tolist())
                ends.append(bool(np.max(np.abs(b - np.array(coef, float))) < 1e-8))
            yield pdf[[*names, "n"]].assign(coef=made, wcoef=pdf["coef"], scale=pdf["scale"], done=ends)

    columns = f"{named}, n long, coef array<double>, wcoef array<double>, scale double, done boolean"
    for _ in range(steps):
        going = state.where("not done")
        if going.isEmpty():
            break
        met = rows.join(going.select(*names, "n", "coef"), names)
        medians = percentiles(met.select(*names, F.abs(F.col(y) - fitted("coef")).alias("_a")), names, "_a", {"_m": 0.5}).select(*names, (F.col("_m") / MAD).alias("scale"))
        weighted = met.join(medians.where("scale > 0"), names).withColumn("_w", weight("coef", "scale"))
        sums = weighted.groupBy(*names, "n", "coef", "scale").agg(
            F.array(*[F.sum(F.col("_w") * a * b) for a in terms for b in terms]).alias("xx"), F.array(*[F.sum(F.col("_w") * a * F.col(y)) for a in terms]).alias("xy")
        )
        flat = going.join(medians.where("scale > 0"), names, "left_anti").withColumn("done", F.lit(True)).select(*state.columns)
        state = cut_lineage(state.where("done").unionByName(flat).unionByName(sums.mapInPandas(solved, columns)))

    used = F.when(F.col("wcoef").isNull(), 1.0).otherwise(weight("wcoef", "scale"))
    full = rows.join(state.drop("done"), names).withColumns({"_w": used, "_r": F.col(y) - fitted("coef")})
    whole = full.groupBy(*names, "n", "coef").agg(
        F.array(*[F.sum(F.col("_w") * a * b) for a in terms for b in terms]).alias("xx"), (1 - F.sum(F.col("_r") * F.col("_r")) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2")
    )

    def inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*names, "n", "coef", "r2"]].assign(inv=[np.linalg.pinv(np.array(m, float).reshape(k, k)).ravel().tolist() for m in pdf["xx"]])

    meat = _bartlett(full, [t * F.col("_w") * F.col("_r") for t in terms], names, order)
    bread = whole.mapInPandas(inverted, f"{named}, n long, coef array<double>, r2 double, inv array<double>").withColumn("lag", newey_west_lag(F.col("n")).cast("int"))
    return _sandwich(bread.join(meat, names).select(*names, "n", "coef", "inv", "r2", "lag", "meat"), names, k).drop("lag")


def huber_newey_west(df: DataFrame, y: str, xs: Sequence[str], *, keys: Sequence[str], order: Sequence[str] = ("ts",), steps: int = 50, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Huber regression by reweighting (scale from the median absolute residual), Newey–West errors on
    the weighted residuals, pseudo-R². Series of over ``group_rows`` rows are fitted by passes over all tasks."""
    # the count of each series, the fits and their passes read these rows: what makes them runs once
    valid = written(df.where(" and ".join(f"{c} is not null" for c in [y, *xs])).select(*keys, *order, y, *xs))
    long = cut_lineage(valid.groupBy(*keys).count().where(F.col("count") > group_rows).select(*keys))
    fit = _huber_groups(valid.join(long, list(keys), "left_anti"), y, xs, keys, order, steps)
    if not long.isEmpty():
        fit = fit.unionByName(_huber_passes(valid.join(long, list(keys), "left_semi"), y, xs, keys, order, steps))
    return _significance(fit, len(xs) + 1)


# ── factors ────────────────────────────────────────────────────────────────────────────────


def market_factor(panel: DataFrame, least: int = 5) -> DataFrame:
    """(ts, mkt): volume-weighted mean return, from at least ``least`` symbols."""
    valid = panel.where("ret is not null and volume > 0")
    agg = valid.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"), (F.sum(F.col("ret") * F.col("volume")) / F.sum("volume")).alias("mkt"))
    return agg.where(F.col("_n") >= least).select("ts", "mkt")


def _long_short(scored: DataFrame, score: str, quantile: float, least: int, out: str, high_minus_low: bool) -> DataFrame:
    """Mean return of the top quantile against the bottom one per time. A group is one time: as large as the universe."""
    valid = scored.where(F.col(score).isNotNull() & F.col("ret").isNotNull())
    cuts = valid.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"), F.percentile(score, quantile).alias("_lo"), F.percentile(score, 1 - quantile).alias("_hi")).where(F.col("_n") >= least)
    joined = valid.join(cuts, "ts")
    low, high = F.avg(F.when(F.col(score) <= F.col("_lo"), F.col("ret"))), F.avg(F.when(F.col(score) >= F.col("_hi"), F.col("ret")))
    return joined.groupBy("ts").agg((high - low if high_minus_low else low - high).alias(out))


def calendar(panel: DataFrame) -> DataFrame:
    """(ts, t): position of each time in the panel. One row per calendar step."""
    return panel.select("ts").distinct().withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1)


def size_factor(panel: DataFrame, lookback_periods: int = 30, quantile: float = 0.3, least: int = 10) -> DataFrame:
    """(ts, smb): small minus big by the mean volume of the periods before."""
    df = panel.join(calendar(panel), "ts")
    before = Window.partitionBy("symbol").orderBy("t").rangeBetween(-lookback_periods, -1)
    scored = df.withColumn("_v", F.avg("volume").over(before)).where((F.col("t") >= lookback_periods) & (F.col("_v") > 0))
    return _long_short(scored, "_v", quantile, least, "smb", False)


def momentum_factor(panel: DataFrame, lookback_periods: int = 30, skip: int = 7, quantile: float = 0.2, least: int = 10) -> DataFrame:
    """(ts, umd): winners minus losers by the compounded return before the skipped periods; a symbol with a gap
    in the window is left out."""
    df = panel.join(calendar(panel), "ts")
    frame = Window.partitionBy("symbol").orderBy("t").rangeBetween(-(lookback_periods + skip), -(skip + 1))
    wipe = F.min("ret").over(frame) <= -1
    growth = F.exp(F.sum(F.log1p(F.when(F.col("ret") > -1, F.col("ret")))).over(frame)) - 1
    past = F.when(F.count("ret").over(frame) == lookback_periods, F.when(wipe, -1.0).otherwise(growth))
    return _long_short(df.withColumn("_p", past), "_p", quantile, least, "umd", True)


def factor_table(panel: DataFrame, **params: int) -> DataFrame:
    """All factors side by side at the times they share."""
    short = {k: v for k, v in params.items()}
    size = size_factor(panel, **({"lookback_periods": short["lookback"]} if "lookback" in short else {}))
    mom = momentum_factor(panel, **({"lookback_periods": short["lookback"], "skip": short.get("skip", 7)} if "lookback" in short else {}))
    return market_factor(panel).join(size, "ts").join(mom, "ts")


def decompose(returns: DataFrame, factors: DataFrame, names: Sequence[str], periods: float, *, keys: Sequence[str] = ("symbol",), robust: bool = False) -> DataFrame:
    """Alpha, loadings, t and p values, R² and residual autocorrelation per series. Series with fewer rows than
    factors + 5 are left out."""
    joined = returns.join(factors, "ts").select(*keys, "ts", "ret", *names)
    fit = (huber_newey_west if robust else ols_newey_west)(joined, "ret", names, keys=keys)
    fit = fit.where(F.col("n") >= len(names) + 5)
    res = residuals(joined, fit, "ret", names, keys=keys).where("resid is not null")
    w = series_window(keys)
    mean = F.avg("resid").over(Window.partitionBy(*keys))
    res = res.withColumn("_c", F.col("resid") - mean)
    res = res.withColumn("_l", F.lag("_c").over(w))
    ac = res.groupBy(*keys).agg((F.sum(F.col("_c") * F.col("_l")) / F.when(F.sum(F.col("_c") * F.col("_c")) > 0, F.sum(F.col("_c") * F.col("_c")))).alias("resid_autocorr"))
    out = fit.join(ac, list(keys))
    cols = {"alpha": F.col("coef")[0], "alpha_annual": F.col("coef")[0] * periods, "alpha_t": F.col("tstat")[0], "alpha_p": F.col("pvalue")[0]}
    for i, name in enumerate(names, 1):
        cols |= {f"beta_{name}": F.col("coef")[i], f"t_{name}": F.col("tstat")[i]}
    return out.withColumns(cols).select(*keys, "n", *cols, "r2", "resid_autocorr")


def attribute_returns(returns: DataFrame, factors: DataFrame, names: Sequence[str], *, keys: Sequence[str] = ("symbol",), notional: Column | None = None) -> DataFrame:
    """Money made by alpha, by each factor and by the residual: sums over periods × notional."""
    joined = returns.join(factors, "ts")
    fit = ols(joined.select(*keys, "ts", "ret", *names), "ret", names, keys=keys)
    full = joined.join(fit.select(*keys, "coef", "r2"), list(keys))
    size = F.lit(1.0) if notional is None else notional
    parts = {"alpha_usd": F.col("coef")[0] * size} | {f"{n}_usd": F.col("coef")[i] * F.col(n) * size for i, n in enumerate(names, 1)}
    explained = sum(parts.values(), F.lit(0.0))
    parts |= {"residual_usd": F.col("ret") * size - explained, "gross_usd": F.col("ret") * size}
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in parts.items()], F.first("r2").alias("r2"))


def orthogonalise(scores: DataFrame, factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each signal (ts, signal, score) with the part its factors explain removed (``residual``)."""
    joined = scores.join(factors, "ts")
    fit = ols(joined.select("signal", "ts", "score", *names), "score", names, keys=["signal"])
    fit = fit.where(F.col("n") >= len(names) + 5)
    return residuals(joined, fit, "score", names, keys=["signal"], out="residual").drop(*names)


# ── combination ────────────────────────────────────────────────────────────────────────────


def max_ir_weights(ics: DataFrame, scores: DataFrame, *, gross: float = 1.0, floor: float = 0.0, shrink: bool = True, blocks: int | None = None) -> DataFrame:
    """Signal weights Σ⁻¹·IC, scaled to a gross exposure. ``scores``: dense (ts, signal, score)."""
    panel = scores.select("ts", F.col("signal").alias("symbol"), F.col("score").alias("ret"))
    if shrink:
        cov = ledoit_wolf(panel, blocks=blocks).select("a", "b", "cov")
    else:
        m = moments(panel)
        cov = correlations(panel, blocks=blocks).select("a", "b", "cov").unionByName(m.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.col("var").alias("cov")))
    v = F.when(F.abs("ic") >= floor, F.coalesce("ic", F.lit(0.0))).otherwise(0.0)
    raw = solve(cov, ics.select(F.col("signal").alias("symbol"), v.alias("v")), ridge=1e-10)
    size = raw.agg(F.sum(F.abs("w")).alias("_g"))
    scaled = F.when(F.col("_g") > 0, F.col("w") * gross / F.when(F.col("_g") > 0, F.col("_g"))).otherwise(F.col("w"))
    return raw.join(F.broadcast(size)).select(F.col("symbol").alias("signal"), scaled.alias("weight"))  # one row


def combine(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of the scores at each time; missing scores count as 0."""
    joined = scores.join(weights, "signal")
    clean = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("score")).otherwise(0.0)
    return joined.groupBy("ts").agg(F.sum(clean * F.col("weight")).alias("combined"))
