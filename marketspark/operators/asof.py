"""Time joins: as-of (backward, forward, nearest), bucket lookups, markouts, intervals, book walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import bucket, interval_ms
from marketspark.operators.series import KEYS, day_of, fill_forward, running_sums


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    *,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    tie: str | None = None,
    direction: str = "backward",
    strict: bool = False,
    slice_by: Column | None = None,
    matched_ts: str | None = None,
) -> DataFrame:
    """Add to each left row the ``values`` of the latest right row at or before it (``backward``) or
    of the earliest at or after it (``forward``); NULL where there is none.

    Both sides are stacked and the last right row is carried forward inside (key, slice); only the
    last value of each slice crosses slice borders, so one hot key spreads over many tasks. With
    no ``keys`` (a single reference series) the slices alone partition the work.
    """
    slice_by = day_of(ts) if slice_by is None else slice_by
    sign = 1 if direction == "backward" else -1
    key_names = list(keys) or ["_one"]
    hit = F.struct(F.col(ts).alias("_t"), *[F.col(v).alias(v) for v in values])
    right_rank, left_rank = (1, 0) if strict else (0, 1)
    tie_of = F.col(tie) if tie else F.lit(0)
    r = right.select(*keys, F.col(ts).alias("_at"), (slice_by * sign).alias("_sl"), hit.alias("_val"), tie_of.alias("_tie"), F.lit(right_rank).alias("_rank"))
    dropped = [v for v in values if v in left.columns]
    base = left.drop(*dropped)
    l = base.withColumns({"_at": F.col(ts), "_sl": slice_by * sign, "_tie": F.lit(None), "_rank": F.lit(left_rank)})
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_at", F.col("_at") * sign)
    if not keys:
        both = both.withColumn("_one", F.lit(0))
    filled = fill_forward(
        both, {"_hit": F.when(F.col("_rank") == right_rank, F.col("_val"))}, keys=key_names, order=["_at", "_rank", "_tie"], slice_by=F.col("_sl")
    )
    out = filled.where(F.col("_rank") == left_rank).select(*base.columns, "_hit")
    picked = {v: F.col("_hit")[v] for v in values}
    if matched_ts:
        picked[matched_ts] = F.col("_hit")["_t"]
    return out.withColumns(picked).drop("_hit")


def nearest_join(left: DataFrame, right: DataFrame, values: Sequence[str], *, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Values of the right row nearest in time; of two equally near ones the earlier."""
    back = asof_join(left, right, values, keys=keys, ts=ts, matched_ts="_bt")
    back = back.withColumnsRenamed({v: f"_b_{v}" for v in values})
    both = asof_join(back, right, values, keys=keys, ts=ts, direction="forward", matched_ts="_ft")
    ahead = F.col("_bt").isNull() | (F.col("_ft") - F.col(ts) < F.col(ts) - F.col("_bt"))
    picked = {v: F.when(ahead, F.col(v)).otherwise(F.col(f"_b_{v}")) for v in values}
    return both.withColumns(picked).drop("_bt", "_ft", *[f"_b_{v}" for v in values])


def bucket_lookup(
    left: DataFrame, right: DataFrame, values: dict[str, float | None], tf: str, *, keys: Sequence[str] = KEYS, ts: str = "ts"
) -> DataFrame:
    """Join on the bucket of ``ts``; of several right rows in a bucket the last wins; defaults where none."""
    packed = F.max_by(F.struct(*values), F.col(ts)).alias("_v")
    latest = right.groupBy(*keys, bucket(ts, tf).alias("_bk")).agg(packed)
    out = left.withColumn("_bk", bucket(ts, tf)).join(latest, [*keys, "_bk"], "left")
    filled = {v: (F.col("_v")[v] if d is None else F.coalesce(F.col("_v")[v], F.lit(d))) for v, d in values.items()}
    return out.withColumns(filled).drop("_bk", "_v")


def oi_features(oi: DataFrame, window: int = 30) -> DataFrame:
    """Daily open interest with change, percent change and z-score against the days before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    prior = w.rowsBetween(-window, -1)
    before = F.lag("oi_close").over(w)
    mean, sd, n = F.avg("oi_close").over(prior), F.stddev_pop("oi_close").over(prior), F.count("oi_close").over(prior)
    return oi.withColumns(
        {
            "oi_delta": F.col("oi_close") - before,
            "oi_roc": F.when(before > 0, (F.col("oi_close") - before) / before * 100),
            "oi_zscore": F.when((n == window) & (sd > 0), (F.col("oi_close") - mean) / sd),
        }
    )


def markouts(fills: DataFrame, prices: DataFrame, horizons_s: Sequence[int] = (1, 10, 60, 300), *, keys: Sequence[str] = KEYS, tf: str | None = None) -> DataFrame:
    """Move in favour of the fill, in bps, at each horizon: the price as of fill time + horizon,
    undefined beyond the end of the price series. One row per fill and horizon."""
    targets = fills.withColumn("horizon_s", F.explode(F.array(*[F.lit(h) for h in horizons_s]))).withColumnsRenamed({"ts": "fill_ts", "price": "fill_price"})
    targets = targets.withColumn("ts", F.col("fill_ts") + F.col("horizon_s") * 1000)
    ends = prices.groupBy(*keys).agg(F.max("ts").alias("_end"))
    reached = asof_join(targets, prices.select(*keys, "ts", F.col("price").alias("price_at"), "seq"), ["price_at"], keys=keys, tie=None)
    known = reached.join(ends, list(keys), "left")
    price = F.when(F.col("ts") <= F.col("_end"), F.col("price_at"))
    sign = F.when(F.col("side") == "B", 1.0).otherwise(-1.0)
    bps = F.when(F.col("fill_price") > 0, sign * (price - F.col("fill_price")) / F.col("fill_price") * 10_000)
    return known.withColumns({"price_at": price, "markout_bps": bps}).drop("_end", "ts")


def position_on_bars(bars: DataFrame, trades: DataFrame, *, keys: Sequence[str] = KEYS, slice_by: Column | None = None) -> DataFrame:
    """``position`` (sum of trade sides) held on each bar in [entry, exit), from a running sum of
    entries and exits: no range join, whatever the number of trades."""
    steps = trades.select(
        *keys, F.explode(F.array(F.struct(F.col("entry_ts").alias("ts"), F.col("side").alias("_step")), F.struct(F.col("exit_ts").alias("ts"), (-F.col("side")).alias("_step")))).alias("_e")
    ).select(*keys, "_e.ts", F.col("_e._step").cast("double").alias("_step"), F.lit(0).alias("_rank"))
    both = bars.withColumn("_rank", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    summed = running_sums(both, {"position": F.col("_step")}, keys=keys, order=["ts", "_rank"], slice_by=slice_by)
    return summed.where("_rank = 1").drop("_rank", "_step")


def walk_book(orders: DataFrame, levels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Fill each order (``order_id``, ``side`` buy/sell, ``req``, ``mid``) through the levels of its
    snapshot (``on`` columns, ``side`` ask/bid, px, sz), best first. A book has a bounded depth,
    so the window per order is small."""
    against = F.when(F.col("side") == "buy", "ask").otherwise("bid")
    usable = levels.where("px > 0 and sz > 0").select(*on, F.col("side").alias("_side"), "px", "sz")
    matched = orders.withColumn("_side", against).join(usable, [*on, "_side"], "left").withColumns({f"_{c}": F.when(F.col("side") == "buy", F.col(c)).otherwise(-F.col(c)) for c in ("px", "sz")})
    # the order of the snapshot's arrays: equal bids with the larger size first, equal asks with the smaller
    w = Window.partitionBy("order_id").orderBy("_px", "_sz").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("sz").over(w), F.lit(0.0))
    take = F.greatest(F.lit(0.0), F.least(F.col("sz"), F.col("req") - before))
    taken = matched.withColumn("_take", F.coalesce(take, F.lit(0.0)))
    carried = [c for c in orders.columns if c != "order_id"]
    out = taken.groupBy("order_id", *carried).agg(
        F.sum("_take").alias("filled"),
        F.sum(F.col("px") * F.col("_take")).alias("_cost"),
        F.count(F.when(F.col("_take") > 1e-12, 1)).alias("levels_used"),
        F.count("px").alias("levels_total"),
    )
    vwap = F.when(F.col("filled") > 0, F.col("_cost") / F.col("filled"))
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return out.withColumns(
        {"vwap": vwap, "unfilled": F.greatest(F.lit(0.0), F.col("req") - F.col("filled")), "slippage_bps": sign * (vwap - F.col("mid")) / F.col("mid") * 10_000}
    ).drop("_cost")


def lookback_matches(events: DataFrame, *, group: Sequence[str], entity: str, ts: str, max_age: str) -> DataFrame:
    """For each event, how many events of the same ``group`` but another ``entity`` fell in the ``max_age`` before it.

    Counts, not pairs: count over the group's time range minus count over the entity's own.
    """
    reach = interval_ms(max_age)
    everyone = Window.partitionBy(*group).orderBy(ts).rangeBetween(-reach, -1)
    own = Window.partitionBy(*group, entity).orderBy(ts).rangeBetween(-reach, -1)
    return events.withColumn("matches", F.count(F.lit(1)).over(everyone) - F.count(F.lit(1)).over(own))
