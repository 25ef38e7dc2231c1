"""Bars, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators import bars as B
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import flow_bars_sql, ohlcv_sql, with_
from marketspark.sources import sinks
from marketspark.sources.tables import Tables
from marketspark.streaming.feeds import scratch_folder

_FLOW = "open high low close volume buy_volume sell_volume opens_long closes_long opens_short closes_short total_pnl total_fees taker_ratio volume_delta net_flow"
_OHLC = "open high low close volume"


@query(
    "agg_01_bars_from_fills",
    "symbol ts num_trades",
    _FLOW,
    with_("fills", flow_bars_sql("fills", 3_600_000)),
)
def _(t: Tables) -> DataFrame:
    return B.bars_from_fills(t.fills, "1h")


@query("agg_01_bars_from_deals", "symbol ts num_trades", _FLOW, with_("bars", "SELECT * FROM bars"), digits=4)
def _(t: Tables) -> DataFrame:
    return t.bars


@query(
    "agg_02_resample",
    "symbol ts tf num_trades",
    _OHLC,
    with_(
        "type_bars",
        "SELECT *, '4h' AS tf FROM a UNION ALL SELECT *, '1w' FROM b",
        a="SELECT symbol, ts // 14400000 * 14400000 AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, CAST(sum(num_trades) AS BIGINT) AS num_trades FROM type_bars GROUP BY symbol, type_bars.ts // 14400000",
        b="SELECT symbol, epoch_ms(date_trunc('week', make_timestamp_ms(ts))) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, CAST(sum(num_trades) AS BIGINT) AS num_trades FROM type_bars GROUP BY symbol, epoch_ms(date_trunc('week', make_timestamp_ms(type_bars.ts)))",
    ),
)
def _(t: Tables) -> DataFrame:
    return B.resample(t.type_bars, "4h").withColumn("tf", F.lit("4h")).union(B.resample(t.type_bars, "1w").withColumn("tf", F.lit("1w")))


def _threshold_sql(amount: str, thr: float) -> str:
    """Carry mode: the bar number is a function of the running amount."""
    return with_(
        "user_bars",
        """SELECT symbol, bar, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
        sum(volume) AS volume FROM c GROUP BY 1, 2""",
        c=f"SELECT *, CAST(floor((sum({amount}) OVER (PARTITION BY symbol ORDER BY ts) - {amount}) / {thr}) AS BIGINT) AS bar FROM user_bars",
    )


def _reset_sql(amount: str, thr: float) -> str:
    """Reset mode: walk each series, restarting the amount when the bar closes."""
    return with_(
        "user_bars",
        """SELECT symbol, bar, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
        sum(volume) AS volume FROM w GROUP BY 1, 2""",
        b=f"SELECT *, {amount} AS amt, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM user_bars",
        w=f"""SELECT *, CAST(0 AS BIGINT) AS bar, amt AS filled FROM b WHERE rn = 1 UNION ALL
        SELECT b.*, CASE WHEN w.filled >= {thr} THEN w.bar + 1 ELSE w.bar END, CASE WHEN w.filled >= {thr} THEN b.amt ELSE w.filled + b.amt END
        FROM w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1""",
    )


@query("agg_03_volume_bars_carry", "symbol bar ts", _OHLC, _threshold_sql("volume", 200))
def _(t: Tables) -> DataFrame:
    return B.threshold_bars(t.user_bars, 200, mode="carry")


@query("agg_03_volume_bars_reset", "symbol bar ts", _OHLC, _reset_sql("volume", 200))
def _(t: Tables) -> DataFrame:
    return B.threshold_bars(t.user_bars, 200)


@query("agg_04_dollar_bars_carry", "symbol bar ts", _OHLC, _threshold_sql("close * volume", 1500.5))
def _(t: Tables) -> DataFrame:
    return B.threshold_bars(t.user_bars, 1500.5, dollar=True, mode="carry")


@query("agg_04_dollar_bars_reset", "symbol bar ts", _OHLC, _reset_sql("close * volume", 1500.5))
def _(t: Tables) -> DataFrame:
    return B.threshold_bars(t.user_bars, 1500.5, dollar=True)


_BOOK = "open high low close bid_depth ask_depth imbalance spread_bps max_bid_wall max_ask_wall"
_BOOK_BARS = """SELECT symbol, ts // {ms} * {ms} AS ts, arg_min(mid, ts) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, ts) AS close,
avg(bid_depth) AS bid_depth, avg(ask_depth) AS ask_depth, avg(imbalance) AS imbalance, avg(spread_bps) AS spread_bps,
max(bid_wall) AS max_bid_wall, max(ask_wall) AS max_ask_wall, count(*) AS n_snapshots FROM book_feats GROUP BY symbol, book_feats.ts // {ms}"""


@query("agg_05_bars_from_books", "symbol ts n_snapshots", _BOOK, with_("book_feats", _BOOK_BARS.format(ms=3_600_000)))
def _(t: Tables) -> DataFrame:
    return B.bars_from_books(t.books, "1h")


@query("agg_06_merge_book_bars", "symbol ts n_snapshots", _BOOK, with_("book_feats", _BOOK_BARS.format(ms=86_400_000)))
def _(t: Tables) -> DataFrame:
    return B.merge_book_bars(B.bars_from_books(t.books, "1h"), "1d")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two overlapping ingests of the same bars: fine ticks of one kind and of another."""
    purchases = B.bars_from_ticks(t.ticks.where("event_type in ('purchase', 'click', 'view')"), "1h")
    rest = B.bars_from_ticks(t.ticks.where("event_type in ('signup', 'error', 'view')"), "1h")
    return purchases, rest


def _merged_on_disk(t: Tables, old: DataFrame, new: DataFrame) -> DataFrame:
    """Written, merged day by day, and read back."""
    path = f"{scratch_folder(t.spark)}/merged"
    sinks.merge_daily(None, old, path)
    sinks.merge_daily(sinks.read_daily(t.spark, path), new, path)
    return sinks.read_daily(t.spark, path).drop("date")


_HALF_CTES = {
    "old": ohlcv_sql("(SELECT * FROM ticks WHERE event_type IN ('purchase', 'click', 'view'))", 3_600_000),
    "new": ohlcv_sql("(SELECT * FROM ticks WHERE event_type IN ('signup', 'error', 'view'))", 3_600_000),
}


@query(
    "snk_01_upsert_bars",
    "symbol ts num_trades",
    _OHLC,
    with_("ticks", "SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = o.symbol AND n.ts = o.ts)", **_HALF_CTES),
)
def _(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return B.upsert(old, new)


@query(
    "snk_02_upsert_keep_first",
    "symbol ts num_trades",
    _OHLC + " spread",
    with_(
        "ticks",
        """SELECT *, NULL::DOUBLE AS spread FROM old UNION ALL SELECT *, high - low AS spread FROM new n
        WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.symbol = o.symbol AND n.ts = o.ts)""",
        **_HALF_CTES,
    ),
)
def _(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return B.upsert(old, new.withColumn("spread", F.col("high") - F.col("low")), keep="first")


@query(
    "snk_03_upsert_funding",
    "symbol ts",
    "funding_rate premium",
    with_(
        "event_funding",
        """SELECT * FROM event_funding WHERE symbol <> 'error' UNION ALL SELECT symbol, ts, funding_rate * 2, premium FROM event_funding WHERE symbol = 'error'""",
    ),
    digits=9,
)
def _(t: Tables) -> DataFrame:
    corrected = t.event_funding.where("symbol = 'error'").withColumn("funding_rate", F.col("funding_rate") * 2)
    return _merged_on_disk(t, t.event_funding, corrected)
