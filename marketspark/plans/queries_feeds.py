"""Tape, order flow, streams, browsing tables, universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions import symbols
from marketspark.functions.timefn import bucket
from marketspark.operators import asof, bars, flow, memory, scan, universe
from marketspark.operators import indicators as I
from marketspark.operators.series import lookback, series_window
from marketspark.plans.queries_signals import _AGG_CTES, _CONTEXT, _NEEDS, _STATE, DEPTH_CTES, TAPE_CTES, TAPE_SQL, flow_sql, market_state, trades
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import over, with_
from marketspark.sources import readers
from marketspark.sources.tables import Tables
from marketspark.session import cut_lineage
from marketspark.streaming import feeds
from marketspark.streaming.upserts import upserted as upsert_stream

_TAPE_VALS = "buy_volume sell_volume total_volume vwap imbalance large_buy_volume large_sell_volume volume_delta"
_TAPE_SELECT = """SELECT symbol, ts, buy_count, sell_count, trade_count, buy_volume, sell_volume, total_volume, notional / total_volume AS vwap, delta / total_volume AS imbalance, large * buy_volume / total_volume AS large_buy_volume,
    large * sell_volume / total_volume AS large_sell_volume, delta AS volume_delta FROM tp"""


@query("str_01_trade_tape", "symbol ts buy_count sell_count trade_count", _TAPE_VALS, with_("type_ticks", _TAPE_SELECT, **TAPE_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return flow.trade_tape(trades(t), "1h")


def _trade_stream(t: Tables) -> DataFrame:
    schema = t.raw("events").schema
    raw = feeds.events_stream(t.spark, t.sf_dir, "events.parquet", schema)
    size = F.get_json_object("props", "$.k").cast("double")
    time = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_type").alias("symbol"),
        time.alias("time"),
        F.unix_millis(time).alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (size * size + 1).alias("size"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "B").otherwise("A").alias("side"),
    )


def _upserted(t: Tables, stream: DataFrame, *keys: str) -> DataFrame:
    return upsert_stream(stream, keys, feeds.scratch_folder(t.spark))


@query("str_01_trade_tape_stream", "symbol ts buy_count sell_count trade_count", _TAPE_VALS, with_("type_ticks", _TAPE_SELECT, **TAPE_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return flow.tape_of_sizes(_upserted(t, feeds.tape_stream(_trade_stream(t), "1 hour", "2 hours"), "symbol", "bar_ts", "size"))


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    folder = feeds.scratch_folder(t.spark)
    feeds.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


_FIVE_DAYS, _HALF_DAY = 432_000_000, 43_200_000


def _fed(t: Tables, rows: DataFrame, file: Column) -> DataFrame:
    """``rows`` (with ``ts``) as a stream of files that arrive in the order of ``file``, a few of them, one a batch."""
    folder = f"{feeds.scratch_folder(t.spark)}/feed"
    dealt = cut_lineage(rows.withColumns({"time": F.timestamp_millis("ts"), "_file": file}))
    for f in [r[0] for r in dealt.select("_file").distinct().orderBy("_file").collect()]:
        dealt.where(F.col("_file") == f).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(dealt.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _shuffled(*by: str) -> Column:
    """Files of five days whose rows come up to six hours too late, in no order."""
    return F.floor((F.col("ts") + F.pmod(F.xxhash64(*by), F.lit(21_600_000))) / _FIVE_DAYS)


def _running(t: Tables) -> DataFrame:
    return _upserted(t, feeds.running_tape(_fed(t, trades(t), _shuffled("seq")), "1h", "12 hours"), "symbol", "ts")


_OF_VALS = "avg_bid_depth avg_ask_depth bid_ratio bid_vanished ask_vanished phantom_bid phantom_ask avg_spread_bps"


@query("str_02_orderflow", "symbol ts snapshots", _OF_VALS, with_("levels_ranked", flow_sql(21_600_000), **DEPTH_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    return flow.orderflow_windows(t.books, "6h")


@query("str_02_orderflow_stream", "symbol ts snapshots", _OF_VALS, with_("levels_ranked", flow_sql(21_600_000), **DEPTH_CTES), digits=5)
def _(t: Tables) -> DataFrame:
    diffs = _upserted(t, feeds.orderflow_diffs(_fed(t, t.books, _shuffled("symbol", "ts")), delay="12 hours"), "symbol", "ts")
    return flow.summarise_orderflow(diffs.groupBy("symbol", bucket("ts", "6h").alias("bar_ts")), "bar_ts")


@query("str_03_cumulative_delta", "symbol ts", "volume_delta cvd", with_("type_ticks", f"SELECT symbol, ts, delta AS volume_delta, sum(delta) {over()} AS cvd FROM tp", **TAPE_CTES), digits=4)
def _(t: Tables) -> DataFrame:
    return flow.cumulative_delta(flow.trade_tape(trades(t), "1h"))


@query("str_03_cumulative_delta_stream", "symbol ts", "volume_delta cvd", with_("type_ticks", f"SELECT symbol, ts, delta AS volume_delta, sum(delta) {over()} AS cvd FROM tp", **TAPE_CTES), digits=4)
def _(t: Tables) -> DataFrame:
    return _running(t)


_RELATIVE = with_("type_ticks", f"SELECT symbol, ts, CASE WHEN count(*) {over(60)} >= 5 THEN total_volume / avg(total_volume) {over(60)} ELSE 1 END AS relative_volume FROM tp", **TAPE_CTES)


@query(
    "str_04_relative_volume",
    "symbol ts",
    "relative_volume",
    _RELATIVE,
)
def _(t: Tables) -> DataFrame:
    return flow.relative_tape_volume(flow.trade_tape(trades(t), "1h"))


@query("str_04_relative_volume_stream", "symbol ts", "relative_volume", _RELATIVE)
def _(t: Tables) -> DataFrame:
    return _running(t)


_QUOTES = with_(
    "levels_ranked",
    """SELECT symbol, ts, bp AS bid_px, bs AS bid_sz, ap AS ask_px, az AS ask_sz, CASE WHEN bs + az > 0 THEN bs / (bs + az) ELSE 0.5 END AS bid_ratio, CASE WHEN bp > 0 AND ap > 0 THEN (ap - bp) / bp * 10000 ELSE 0 END AS spread_bps FROM (
    SELECT symbol, ts, coalesce(max(px) FILTER (side = 'bid' AND lvl = 1), 0) AS bp, coalesce(max(sz) FILTER (side = 'bid' AND lvl = 1), 0) AS bs, coalesce(max(px) FILTER (side = 'ask' AND lvl = 1), 0) AS ap,
    coalesce(max(sz) FILTER (side = 'ask' AND lvl = 1), 0) AS az FROM levels_ranked GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
)


@query(
    "str_05_latest_quotes",
    "symbol ts",
    "bid_px bid_sz ask_px ask_sz bid_ratio spread_bps",
    _QUOTES,
)
def _(t: Tables) -> DataFrame:
    return flow.latest_quotes(t.books)


@query("str_05_latest_quotes_stream", "symbol ts", "bid_px bid_sz ask_px ask_sz bid_ratio spread_bps", _QUOTES)
def _(t: Tables) -> DataFrame:
    return _upserted(t, feeds.latest_quote_stream(_fed(t, t.books, _shuffled("symbol", "ts"))), "symbol")


@query(
    "str_06_late_data",
    "symbol rows late kept dropped",
    "",
    with_(
        "type_ticks",
        f"""SELECT symbol, count(*) AS rows, count(*) FILTER (ts <= mark) AS late, count(*) FILTER (mark IS NULL OR ts > mark) AS kept, any_value(dropped) AS dropped
        FROM fed LEFT JOIN marks USING (file), (SELECT count(*) AS dropped FROM fed JOIN marks USING (file) WHERE ts <= mark) GROUP BY symbol""",
        fed=f"SELECT symbol, ts, seq, ts // {_FIVE_DAYS} + CASE WHEN seq % 50 = 7 THEN 3 ELSE 0 END AS file FROM type_ticks",
        marks=f"SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_HALF_DAY} AS mark FROM fed GROUP BY file",
    ),
)
def _(t: Tables) -> DataFrame:
    """Every 50th tick comes fifteen days late: what the stream drops, what the listener counts, what the side table keeps."""
    file = F.floor(F.col("ts") / _FIVE_DAYS) + F.when(F.pmod("seq", F.lit(50)) == 7, 3).otherwise(0)
    stream = _fed(t, t.type_ticks.select("symbol", "ts", "seq"), file)
    folder = feeds.scratch_folder(t.spark)
    counter = feeds.LateCounter()
    t.spark.streams.addListener(counter)
    try:
        once = stream.withWatermark("time", f"{_HALF_DAY} milliseconds").dropDuplicatesWithinWatermark(["symbol", "seq"])
        run = feeds.run_available(once, f"{folder}/out", f"{folder}/checkpoint")
        t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        t.spark.streams.removeListener(counter)
    late = feeds.late_rows_of(stream, _HALF_DAY, f"{folder}/side").groupBy("symbol").agg(F.count("*").alias("late"))
    kept = t.spark.read.schema(once.schema).parquet(f"{folder}/out").groupBy("symbol").agg(F.count("*").alias("kept"))
    rows = t.type_ticks.groupBy("symbol").agg(F.count("*").alias("rows"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("late", "kept")]
    return rows.join(late, "symbol", "left").join(kept, "symbol", "left").select("symbol", "rows", *filled, F.lit(counter.dropped[str(run.id)]).cast("long").alias("dropped"))


@query(
    "str_07_vault_positions",
    "symbol num_long num_short total_vaults",
    "net_notional",
    """SELECT 'S' || l_suppkey AS symbol, count(*) FILTER (sz > 0) AS num_long, count(*) FILTER (sz < 0) AS num_short, count(*) AS total_vaults, sum(sz * px) AS net_notional FROM (
    SELECT o_custkey, l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS sz, avg(100 + l_extendedprice / 2000) AS px FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    WHERE sz <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20) GROUP BY 1""",
    digits=3,
)
def _(t: Tables) -> DataFrame:
    vaults = t.raw("customer").select(F.col("c_custkey").alias("vault"), F.col("c_acctbal").alias("equity"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    positions = held.groupBy(F.col("o_custkey").alias("vault"), F.concat(F.lit("S"), "l_suppkey").alias("symbol")).agg(
        F.sum(signed).alias("size"), F.avg(100 + F.col("l_extendedprice") / 2000).alias("entry_px")
    )
    return flow.vault_positions(vaults, positions)


@query(
    "str_08_collected_once",
    "symbol ts",
    "",
    with_("type_ticks", "SELECT DISTINCT symbol, ts // 600000 * 600000 AS ts FROM type_ticks"),
)
def _(t: Tables) -> DataFrame:
    ten = F.col("ts") - F.pmod("ts", F.lit(600_000))
    snapshots = _trade_stream(t).select("symbol", "time", ten.alias("ts"))
    return _drained(t, feeds.deduplicated(snapshots, "1 hour"))


@query(
    "str_09_bars_with_funding_stream",
    "symbol ts num_trades",
    "open high low close volume funding_rate",
    with_(
        "type_bars event_funding",
        """SELECT b.symbol, b.ts, num_trades, open, high, low, close, v AS volume, coalesce(funding_rate, 0) AS funding_rate FROM type_bars b JOIN (SELECT symbol, ts // 3600000 * 3600000 AS ts, sum(size * size + 1) AS v FROM type_ticks GROUP BY symbol, type_ticks.ts // 3600000) s USING (symbol, ts)
        LEFT JOIN event_funding USING (symbol, ts)""",
    ),
    digits=7,
)
def _(t: Tables) -> DataFrame:
    return feeds.with_funding(_upserted(t, feeds.bars_stream(_trade_stream(t)), "symbol", "ts"), t.event_funding)


# ── browsing tables and universes ──────────────────────────────────────────────────────────

_SINCE = 1_704_672_000_000  # 2024-01-08


@query(
    "agg_07_order_flow",
    "symbol fills",
    "buy_volume sell_volume taker_ratio net_flow imbalance",
    with_(
        "fills",
        f"""SELECT *, (buy_volume - sell_volume) / (buy_volume + sell_volume) AS imbalance FROM (SELECT symbol, count(*) AS fills, sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS sell_volume,
        avg(CASE WHEN crossed THEN 1 ELSE 0 END) AS taker_ratio, sum(CASE WHEN is_open THEN size ELSE -size END) AS net_flow FROM fills WHERE ts >= {_SINCE} GROUP BY 1) WHERE buy_volume + sell_volume >= 1e-9
        ORDER BY abs((buy_volume - sell_volume) / (buy_volume + sell_volume)) DESC, symbol LIMIT 20""",
    ),
)
def _(t: Tables) -> DataFrame:
    return universe.order_flow(t.fills, _SINCE)


@query(
    "agg_08_funding_browser",
    "symbol samples",
    "current mean max min std zscore",
    with_(
        "funding",
        """SELECT *, CASE WHEN std > 1e-12 THEN (current - mean) / std ELSE 0 END AS zscore FROM (SELECT symbol, avg(funding_rate) AS mean, max(funding_rate) AS max, min(funding_rate) AS min, stddev_pop(funding_rate) AS std, count(*) AS samples
        FROM funding WHERE ts >= 946684800000 GROUP BY 1) JOIN (SELECT symbol, arg_max(funding_rate, ts) AS current FROM funding GROUP BY 1) USING (symbol) ORDER BY abs(current) DESC, symbol LIMIT 20""",
    ),
    digits=9,
)
def _(t: Tables) -> DataFrame:
    return universe.funding_browser(t.funding, 946_684_800_000)


_CTX = """SELECT symbol, arg_max(close, ts) AS mark, arg_min(open, ts) AS previous, sum(volume * close) AS day_volume FROM bars GROUP BY 1"""


@query(
    "agg_09_market_breadth",
    "",
    "overbought_pct oversold_pct avg_rsi",
    with_(
        "bars",
        """SELECT avg(CASE WHEN r > 70 THEN 100 ELSE 0 END) AS overbought_pct, avg(CASE WHEN r < 30 THEN 100 ELSE 0 END) AS oversold_pct, avg(r) AS avg_rsi
        FROM (SELECT greatest(0, least(100, 50 + 3 * (mark - previous) / previous * 100)) AS r FROM c ORDER BY day_volume DESC, symbol LIMIT 20)""",
        c=_CTX,
    ),
)
def _(t: Tables) -> DataFrame:
    ctx = t.bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("mark"), F.min_by("open", "ts").alias("previous"), F.sum(F.col("volume") * F.col("close")).alias("day_volume"))
    return universe.market_breadth(ctx)


def _stats_sql(src: str, v: str, extra: str = "") -> str:
    qs = ", ".join(f"quantile_cont({v}, {q}) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    return f"SELECT symbol, count({v}) AS n, min({v}) AS min, max({v}) AS max, avg({v}) AS mean, stddev_pop({v}) AS std, {qs}{extra} FROM {src} WHERE {v} IS NOT NULL GROUP BY 1"


@query("agg_26_volume_statistics", "symbol n", "min max mean std p10 p25 p50 p75 p90", with_("bars", _stats_sql("bars", "volume")), digits=4)
def _(t: Tables) -> DataFrame:
    return universe.value_statistics(t.bars, "volume")


@query(
    "agg_26_tick_statistics",
    "symbol n",
    "min max mean std p10 p25 p50 p75 p90 pct_above pct_below",
    with_("type_ticks", _stats_sql("type_ticks", "price", ", avg(CASE WHEN price > 40 THEN 100 ELSE 0 END) AS pct_above, avg(CASE WHEN price < 5 THEN 100 ELSE 0 END) AS pct_below")),
    digits=5,
)
def _(t: Tables) -> DataFrame:
    return universe.value_statistics(t.type_ticks, "price", above=40, below=5)


@query("agg_30_collector_stats", "rows first_ts last_ts symbols", "", with_("ticks", "SELECT count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT symbol) AS symbols FROM ticks"))
def _(t: Tables) -> DataFrame:
    return universe.collector_stats(t.ticks)


@query("srt_01_top_by_volume", "symbol", "volume", with_("universe", "SELECT symbol, volume FROM (SELECT * FROM universe ORDER BY coalesce(volume, -1) DESC, symbol LIMIT 15)"), digits=3)
def _(t: Tables) -> DataFrame:
    return universe.top_by_volume(t.universe, 15)


@query("prj_05_universe", "symbol tag", "volume", with_("universe", "SELECT symbol, tags[1] AS tag, volume FROM universe WHERE coalesce(volume, 0) >= 25000000 AND symbol <> 'S7'"), digits=3)
def _(t: Tables) -> DataFrame:
    return universe.select_universe(t.universe, min_volume=25_000_000, exclude=["s7"]).withColumn("tag", F.col("tags")[0])


@query("prj_06_by_sector", "symbol", "", with_("universe", "SELECT symbol FROM universe WHERE len(list_filter(tags, lambda x: lower(x) IN ('asia', 'nation_3'))) > 0"))
def _(t: Tables) -> DataFrame:
    return universe.by_sector(t.universe, ["Asia", "nation_3"])


def _two_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    rich = t.universe.where("s_acctbal > 3000").select("symbol", F.lit("rich").alias("origin"))
    busy = t.universe.where("volume > 28000000").select("symbol", F.lit("busy").alias("origin"))
    return rich, busy


@query(
    "set_01_universe_algebra",
    "op symbol origin",
    "",
    with_(
        "universe",
        """SELECT 'union' AS op, symbol, CASE WHEN symbol IN (SELECT symbol FROM a) THEN 'rich' ELSE 'busy' END AS origin FROM (SELECT symbol FROM a UNION SELECT symbol FROM b)
        UNION ALL SELECT 'intersection', symbol, 'rich' FROM (SELECT symbol FROM a INTERSECT SELECT symbol FROM b) UNION ALL SELECT 'difference', symbol, 'rich' FROM (SELECT symbol FROM a EXCEPT SELECT symbol FROM b)""",
        a="SELECT symbol FROM universe WHERE s_acctbal > 3000",
        b="SELECT symbol FROM universe WHERE volume > 28000000",
    ),
)
def _(t: Tables) -> DataFrame:
    a, b = _two_sets(t)
    return readers.stack([universe.combine(a, b, op).withColumn("op", F.lit(op)) for op in ("union", "intersection", "difference")])


@query(
    "set_02_diagonal_stack",
    "kind symbol ts",
    "close spread",
    with_("user_bars type_bars", "SELECT 'user' AS kind, symbol, ts, close, NULL::DOUBLE AS spread FROM user_bars UNION ALL SELECT 'type', symbol, ts, NULL, high - low FROM type_bars"),
)
def _(t: Tables) -> DataFrame:
    a = t.user_bars.select(F.lit("user").alias("kind"), "symbol", "ts", "close")
    b = t.type_bars.select(F.lit("type").alias("kind"), "symbol", "ts", (F.col("high") - F.col("low")).alias("spread"))
    return readers.stack([a, b])


@query("set_03_one_per_key", "symbol ts", "price", with_("type_ticks", "SELECT symbol, ts // 3600000 * 3600000 AS ts, arg_min(price, seq) AS price FROM type_ticks GROUP BY symbol, type_ticks.ts // 3600000"))
def _(t: Tables) -> DataFrame:
    hourly = t.type_ticks.withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(3_600_000)))
    return readers.one_per_key(hourly, ["symbol", "ts"], ["seq"])


# ── joins in time ──────────────────────────────────────────────────────────────────────────


@query(
    "join_02_hour_lookup",
    "symbol ts",
    "close funding_rate premium",
    with_("type_bars event_funding", "SELECT b.symbol, b.ts, close, coalesce(funding_rate, 0) AS funding_rate, coalesce(premium, 0) AS premium FROM type_bars b LEFT JOIN event_funding f ON f.symbol = b.symbol AND f.ts = b.ts AND f.ts % 7200000 = 0"),
    digits=8,
)
def _(t: Tables) -> DataFrame:
    even = t.event_funding.where(F.pmod("ts", F.lit(7_200_000)) == 0)
    return asof.bucket_lookup(t.type_bars, even, {"funding_rate": 0.0, "premium": 0.0}, "1h")


@query(
    "join_03_day_lookup",
    "symbol ts",
    "oi oi_delta oi_roc oi_zscore",
    with_(
        "type_bars open_interest",
        f"""SELECT b.symbol, b.ts, coalesce(o.oi_close, 0) AS oi, coalesce(d, 0) AS oi_delta, coalesce(r, 0) AS oi_roc, coalesce(z, 0) AS oi_zscore FROM type_bars b LEFT JOIN o ON o.symbol = b.symbol AND o.ts = b.ts // 86400000 * 86400000""",
        o="""SELECT *, oi_close - lag(oi_close) OVER w AS d, (oi_close - lag(oi_close) OVER w) / lag(oi_close) OVER w * 100 AS r, CASE WHEN row_number() OVER w > 10 AND stddev_pop(oi_close) OVER p > 0 THEN (oi_close - avg(oi_close) OVER p) / stddev_pop(oi_close) OVER p END AS z
        FROM open_interest WINDOW w AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    ),
)
def _(t: Tables) -> DataFrame:
    oi = asof.oi_features(t.open_interest, window=10)
    return asof.bucket_lookup(t.type_bars, oi.withColumnRenamed("oi_close", "oi"), {"oi": 0.0, "oi_delta": 0.0, "oi_roc": 0.0, "oi_zscore": 0.0}, "1d")


@query(
    "join_04_book_lookup",
    "symbol ts",
    "price imbalance spread_bps",
    with_("type_ticks book_feats", "SELECT t.symbol, t.ts, t.price, coalesce(imbalance, 0) AS imbalance, coalesce(spread_bps, 0) AS spread_bps FROM type_ticks t LEFT JOIN book_feats f ON f.symbol = t.symbol AND f.ts // 300000 = t.ts // 300000"),
)
def _(t: Tables) -> DataFrame:
    return asof.bucket_lookup(t.type_ticks, bars.book_features(t.books), {"imbalance": 0.0, "spread_bps": 0.0}, "5m")


@query(
    "join_05_asof",
    "symbol ts",
    "price mid",
    with_("type_ticks book_feats", "SELECT t.symbol, t.ts, t.price, f.mid FROM type_ticks t ASOF LEFT JOIN book_feats f ON f.symbol = t.symbol AND t.ts >= f.ts"),
)
def _(t: Tables) -> DataFrame:
    return asof.asof_join(t.type_ticks, bars.book_features(t.books).select("symbol", "ts", "mid"), ["mid"])


_MK = """SELECT f.seq, f.symbol, f.side, h AS horizon_s, CASE WHEN f.ts + h * 1000 <= e.mx THEN p.price END AS price_at, CASE WHEN f.ts + h * 1000 <= e.mx AND f.price > 0 THEN CASE side WHEN 'B' THEN 1 ELSE -1 END * (p.price - f.price) / f.price * 10000 END AS markout_bps
    FROM (SELECT *, CAST(unnest([1, 10, 60, 300, 36000]) AS INT) AS h FROM ff) f JOIN e USING (symbol) ASOF LEFT JOIN pp p ON p.symbol = f.symbol AND f.ts + f.h * 1000 >= p.ts"""
_MK_CTES = {
    "ff": "SELECT *, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'A' END AS side FROM type_ticks",
    "pp": "SELECT symbol, ts, arg_max(price, seq) AS price FROM type_ticks GROUP BY 1, 2",
    "e": "SELECT symbol, max(ts) AS mx FROM type_ticks GROUP BY 1",
}
_HORIZONS = (1, 10, 60, 300, 36000)


def _markouts(t: Tables) -> DataFrame:
    fills = t.type_ticks.withColumn("side", F.when(F.pmod("seq", F.lit(2)) == 0, "B").otherwise("A")).drop("size")
    prices = t.type_ticks.groupBy("symbol", "ts").agg(F.max_by("price", "seq").alias("price")).withColumn("seq", F.lit(0))
    return asof.markouts(fills, prices, _HORIZONS)


@query("join_06_markouts", "seq symbol side horizon_s", "price_at markout_bps", with_("type_ticks", _MK, **_MK_CTES), digits=4)
def _(t: Tables) -> DataFrame:
    return _markouts(t)


@query(
    "join_06_markout_means",
    "symbol horizon_s fills",
    "markout_bps",
    with_("type_ticks", f"SELECT symbol, horizon_s, count(markout_bps) AS fills, avg(markout_bps) AS markout_bps FROM ({_MK}) GROUP BY 1, 2", **_MK_CTES),
    digits=3,
)
def _(t: Tables) -> DataFrame:
    return _markouts(t).groupBy("symbol", "horizon_s").agg(F.count("markout_bps").alias("fills"), F.avg("markout_bps").alias("markout_bps"))


@query(
    "join_07_nearest",
    "symbol ts",
    "price mid",
    with_(
        "type_ticks book_feats",
        """SELECT symbol, ts, price, CASE WHEN bt IS NULL OR ft - ts < ts - bt THEN fm ELSE bm END AS mid FROM (SELECT t.*, b.ts AS bt, b.mid AS bm FROM type_ticks t ASOF LEFT JOIN book_feats b ON b.symbol = t.symbol AND t.ts >= b.ts) t
        JOIN (SELECT t.seq AS s2, f.ts AS ft, f.mid AS fm FROM type_ticks t ASOF LEFT JOIN book_feats f ON f.symbol = t.symbol AND t.ts <= f.ts) f ON s2 = t.seq""",
    ),
)
def _(t: Tables) -> DataFrame:
    return asof.nearest_join(t.type_ticks, bars.book_features(t.books).select("symbol", "ts", "mid"), ["mid"])


@query(
    "prj_12_book_pressure",
    "symbol ts",
    "imbalance bid_wall_share ask_wall_share pressure z",
    with_(
        "book_feats",
        f"""SELECT symbol, ts, imbalance, bid_wall / bid_depth AS bid_wall_share, ask_wall / ask_depth AS ask_wall_share, spread_bps / 5 AS pressure, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 24 AND stddev_samp(imbalance) {over(24)} > 0
        THEN (imbalance - avg(imbalance) {over(24)}) / stddev_samp(imbalance) {over(24)} END AS z FROM book_feats""",
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.pressure import book_pressure

    return book_pressure(bars.book_features(t.books))


@query(
    "sig_41_market_scan",
    "symbol direction tier leverage hold_type",
    "combined_score stop_price target_price size_pct",
)
def _(t: Tables) -> DataFrame:
    # the panel feeds both timeframes: it is computed once and its long plan cut
    panel = cut_lineage(market_state(t))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))

    def last(df: DataFrame) -> DataFrame:
        return df.withColumn("_b", back).where("_b = 1").drop("_b")

    bias = last(panel).withColumn("day_volume", F.lit(5e6))
    return scan.scan(bias, last(panel.where(F.col("hour") % 2 == 0)), min_score=0.05, min_categories=1)


_BF_CTES = {
    "bf": "SELECT s.*, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) AS later, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM state s",
    "fired": _AGG_CTES["fired"].replace("CASE name WHEN 'cvd_momentum' THEN 1.1::DOUBLE WHEN 'ema_trend' THEN 0.8::DOUBLE ELSE 1 END", "1"),
    "raw": _AGG_CTES["raw"],
    "opp": _AGG_CTES["opp"].replace("0.1003", "0.1"),
}


@query(
    "pnl_08_signal_backfill",
    "symbol ts direction combo result",
    "pnl_pct",
    with_(
        _NEEDS,
        """SELECT o.symbol, o.ts, lower(direction) AS direction, names AS combo, CASE WHEN pnl > 0 THEN 'win' ELSE 'loss' END AS result, pnl AS pnl_pct FROM (SELECT o.*, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * (later - close) / close * 100 AS pnl
        FROM opp o JOIN bf USING (symbol, ts) WHERE i >= 50 AND (i - 50) % 4 = 0 AND later IS NOT NULL AND close > 0 AND num_signals >= 2) o""",
        **_STATE,
        **_CONTEXT,
        **_BF_CTES,
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    return scan.backfill(cut_lineage(market_state(t)), hold=6, step=4).withColumn("combo", F.array_join("signals", ","))
