"""Scans, parsers, audit and change tracking, rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import rules, symbols
from marketspark.operators import asof, risk
from marketspark.operators import indicators as I
from marketspark.plans.queries_pnl import LEDGER, METRICS_SQL, trades_of
from marketspark.plans.registry import query
from marketspark.plans.sqlkit import full, lag, over, with_
from marketspark.sources import readers, sinks
from marketspark.sources.tables import Tables

_FROM, _TO = 915_148_800_000, 946_684_800_000  # 1999-01-01, 2000-01-01


@query(
    "src_01_select_bars",
    "symbol ts trades",
    "close volume",
    with_("bars", f"SELECT symbol, ts, num_trades AS trades, close, volume FROM bars WHERE symbol IN ('S1', 'S2', 'S3') AND ts >= {_FROM} AND ts <= {_TO}"),
)
def _(t: Tables) -> DataFrame:
    return readers.select_bars(t.bars, ["S1", "S2", "S3"], ["close", "volume", "trades", "funding_rate"], "1999-01-01", "2000-01-01T00:00:00Z")


@query("src_04_fills", "symbol ts side is_open is_long crossed", "price size", with_("fills", "SELECT * FROM fills"))
def _(t: Tables) -> DataFrame:
    from marketspark.sources.schemas import FILLS, conform

    return conform(t.fills, FILLS)


def _fill_lines(t: Tables) -> DataFrame:
    """The fills written as nested JSON lines, both item forms and some broken lines among them."""
    fill = F.struct(
        F.col("symbol").alias("coin"), F.col("ts").alias("time"), F.col("price").cast("string").alias("px"), F.col("size").cast("string").alias("sz"), "side",
        F.concat(F.when(F.col("is_open"), "Open ").otherwise("Close "), F.when(F.col("is_long"), "Long").otherwise("Short")).alias("dir"), "crossed",
        F.col("closed_pnl").cast("string").alias("closedPnl"), F.col("fee").cast("string").alias("fee"),
    )
    text = F.to_json(fill)
    pair = F.concat(F.lit('{"events": [["0xabc", '), text, F.lit("]]}"))
    plain = F.concat(F.lit('{"events": ['), text, F.lit("]}"))
    odd = F.pmod("seq", F.lit(10))
    return t.fills.select(F.when(odd == 9, F.concat(F.lit("not json "), text)).when(odd % 2 == 0, pair).otherwise(plain).alias("value"))


@query(
    "src_05_parse_fill_lines",
    "symbol ts side dir is_open is_long crossed",
    "price size closed_pnl fee",
    with_("fills", "SELECT *, CASE WHEN is_open THEN 'Open ' ELSE 'Close ' END || CASE WHEN is_long THEN 'Long' ELSE 'Short' END AS dir FROM fills WHERE seq % 10 <> 9"),
)
def _(t: Tables) -> DataFrame:
    return readers.parse_fill_lines(_fill_lines(t))


@query("src_06_parse_book_lines", "symbol ts n_bids n_asks", "best_bid best_ask", with_("levels_ranked", """SELECT symbol, ts, CAST(count(*) FILTER (side = 'bid') AS INT) AS n_bids, CAST(count(*) FILTER (side = 'ask') AS INT) AS n_asks,
    max(px) FILTER (side = 'bid') AS best_bid, min(px) FILTER (side = 'ask') AS best_ask FROM levels_ranked GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    def side(name: str):
        return F.transform(name, lambda x: F.struct(x["px"].cast("string").alias("px"), x["sz"].cast("string").alias("sz")))

    data = F.struct(F.struct(F.col("symbol").alias("coin"), F.col("ts").alias("time"), F.array(side("bids"), side("asks")).alias("levels")).alias("data"))
    lines = t.books.select(F.to_json(F.struct(data.alias("raw"))).alias("value"))
    lines = lines.unionByName(lines.limit(3).select(F.lit("{broken").alias("value")))
    parsed = readers.parse_book_lines(lines)
    return parsed.select("symbol", "ts", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.get("bids", F.lit(0))["px"].alias("best_bid"), F.get("asks", F.lit(0))["px"].alias("best_ask"))


@query("src_07_context_funding", "symbol ts", "funding_rate", with_("event_funding", "SELECT symbol, ts, funding_rate FROM event_funding"), digits=9)
def _(t: Tables) -> DataFrame:
    text = t.event_funding.select(F.col("symbol").alias("name"), F.col("ts").cast("string").alias("time"), F.col("funding_rate").cast("string").alias("fundingRate"))
    return readers.context_funding(text.unionByName(text))


@query("src_08_funding_series", "symbol ts", "funding_rate premium", with_("funding", "SELECT * FROM funding"), digits=9)
def _(t: Tables) -> DataFrame:
    from marketspark.sources.schemas import FUNDING, conform

    return conform(t.funding, FUNDING)


@query(
    "src_11_session_trades",
    "session price_count",
    "total",
    "SELECT l_orderkey AS session, count(*) AS price_count, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1",
    digits=3,
)
def _(t: Tables) -> DataFrame:
    sessions = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"))).alias("trades"))
    return readers.session_trades(sessions).groupBy("session").agg(F.count("price").alias("price_count"), F.sum("price").alias("total"))


@query(
    "src_12_inventory",
    "symbol tf rows first_ts last_ts",
    "",
    with_("bars day_bars", "SELECT symbol, '1w' AS tf, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1 UNION ALL SELECT symbol, '1d', count(*), min(ts), max(ts) FROM day_bars GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    both = readers.stack([t.bars.withColumn("tf", F.lit("1w")), t.day_bars.withColumn("tf", F.lit("1d"))])
    return readers.inventory(both)


@query("src_12_file_sizes", "files bytes")
def _(t: Tables) -> DataFrame:
    return readers.file_sizes(t.raw("lineitem"))


@query(
    "src_13_available_fields",
    "symbol fields",
    "",
    with_("type_bars event_funding", "SELECT DISTINCT symbol, 'close,funding_rate,high,low,open,trades,volume' AS fields FROM type_bars"),
)
def _(t: Tables) -> DataFrame:
    present = t.type_bars.select("symbol", F.lit("bars").alias("source")).unionByName(t.event_funding.select("symbol", F.lit("funding").alias("source"))).distinct()
    return readers.available_fields(present).withColumn("fields", F.array_join("fields", ","))


@query("src_14_recent_log", "seq symbol ts", "price", with_("type_ticks", "SELECT * FROM type_ticks WHERE symbol = 'error' ORDER BY ts DESC, seq DESC LIMIT 25"))
def _(t: Tables) -> DataFrame:
    return readers.latest(t.type_ticks, 25, ties=["seq"], symbol="error")


@query(
    "snk_05_audit_trail",
    "strategy symbol side action ts exit_reason",
    "size price notional fee pnl latency_ms",
    with_(
        "bn",
        """SELECT 'cross' AS strategy, symbol, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS side, 'OPEN' AS action, entry_ts AS ts, NULL AS exit_reason, size, entry_price AS price, size * entry_price AS notional, size * entry_price * 0.001::DOUBLE AS fee, NULL::DOUBLE AS pnl, bars_held * 500 AS latency_ms FROM trades
        UNION ALL SELECT 'cross', symbol, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END, 'CLOSE', exit_ts, exit_reason, size, exit_price, size * exit_price, size * exit_price * 0.001::DOUBLE, pnl, NULL FROM trades""",
        **LEDGER,
    ),
    digits=4,
)
def _(t: Tables) -> DataFrame:
    trades = trades_of(t).withColumns(
        {"strategy": F.lit("cross"), "side": F.when(F.col("side") > 0, "long").otherwise("short"), "signal_ts": F.lit(1000.0), "fill_ts": 1000.0 + F.col("bars_held") * 0.5}
    )
    return sinks.audit_trail(trades)


@query(
    "snk_08_config_diff",
    "symbol key before after change",
    "",
    with_(
        "universe",
        """SELECT symbol, key, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (
        SELECT symbol, 'region' AS key, r_name AS before, CASE WHEN s_acctbal > 5000 THEN r_name END AS after FROM universe UNION ALL SELECT symbol, 'nation', tags[1], lower(tags[1]) FROM universe) WHERE before IS DISTINCT FROM after""",
    ),
)
def _(t: Tables) -> DataFrame:
    u = t.universe
    old = u.select("symbol", F.create_map(F.lit("region"), F.col("r_name"), F.lit("nation"), F.col("tags")[0]).alias("config"))
    new = u.select("symbol", F.map_filter(F.create_map(F.lit("region"), F.when(F.col("s_acctbal") > 5000, F.col("r_name")), F.lit("nation"), F.lower(F.col("tags")[0])), lambda k, v: v.isNotNull()).alias("config"))
    return sinks.diff_maps(old, new, ["symbol"], "config")


@query("snk_09_fingerprint", "symbol rows fingerprint")
def _(t: Tables) -> DataFrame:
    return sinks.fingerprint(t.bars, ["symbol"])


@query(
    "prj_01_symbol_names",
    "raw coin spot market path back",
    "",
    """SELECT raw, coin, upper(trim(raw)) || '/USDC' AS spot, 'perp' AS market, replace(coin, ':', '-') AS path, coin AS back FROM (SELECT raw, CASE WHEN upper(bare) IN ('GOLD', 'CORN') THEN 'xyz:' || upper(bare) ELSE upper(bare) END AS coin FROM (
    SELECT DISTINCT raw, trim(replace(replace(raw, '-PERP', ''), '-perp', '')) AS bare FROM (SELECT CASE l_linenumber WHEN 1 THEN ' gold' WHEN 2 THEN 'CORN-PERP' ELSE 's' || l_suppkey || '-perp' END AS raw FROM lineitem)))""",
)
def _(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    raw = F.when(F.col("l_linenumber") == 1, " gold").when(F.col("l_linenumber") == 2, "CORN-PERP").otherwise(F.concat(F.lit("s"), "l_suppkey", F.lit("-perp")))
    df = li.select(raw.alias("raw")).distinct().withColumn("coin", symbols.normalise(F.col("raw")))
    return df.withColumns({"spot": symbols.normalise_spot(F.col("raw")), "market": symbols.market_of(F.col("coin")), "path": symbols.to_path(F.col("coin")), "back": symbols.from_path(symbols.to_path(F.col("coin")))})


@query(
    "prj_02_buckets",
    "seq b5m b4h b1w",
    "",
    with_("type_ticks", "SELECT seq, ts // 300000 * 300000 AS b5m, ts // 14400000 * 14400000 AS b4h, epoch_ms(date_trunc('week', make_timestamp_ms(ts))) AS b1w FROM type_ticks"),
)
def _(t: Tables) -> DataFrame:
    from marketspark.functions.timefn import bucket

    return t.type_ticks.withColumns({f"b{tf}": bucket("ts", tf) for tf in ("5m", "4h", "1w")})


@query(
    "prj_03_rule_targets",
    "symbol ts target fired",
    "",
    with_(
        "bn",
        f"""SELECT symbol, ts, coalesce(last_value(ev IGNORE NULLS) {over()}, 0) AS target, coalesce(l, false) AS fired FROM (SELECT *, CASE WHEN l THEN 1 WHEN s THEN -1 WHEN x THEN 0 END AS ev FROM (
        SELECT *, fast > slow AND {lag('fast')} <= {lag('slow')} AND volume > 20 AS l, fast < slow AND {lag('fast')} >= {lag('slow')} AS s, abs(close - slow) < 1 AS x FROM f))""",
        f=f"SELECT *, {full('avg(close)', 5)} AS fast, {full('avg(close)', 20)} AS slow FROM bn",
    ),
)
def _(t: Tables) -> DataFrame:
    df = I.add(t.bars, {"fast": ("sma", {"period": 5}), "slow": ("sma", {"period": 20})}).withColumn("gap", F.col("close") - F.col("slow"))
    long = rules.parse_rule('[{"indicator": "fast", "op": "crosses_above", "ref": "slow"}, {"indicator": "volume", "op": ">", "value": 20}]')
    short = [rules.Condition("fast", "crosses_below", ref="slow")]
    out = rules.with_target(df, long, short, [rules.Condition("gap", "abs_below", 1.0)])
    return out.withColumn("fired", rules.all_of(long))


@query(
    "prj_04_standing_filters",
    "symbol ts busy",
    "",
    with_("bn", f"SELECT symbol, ts, coalesce(volume / {full('avg(volume)', 20)} > 1.5, false) AS busy FROM bn"),
)
def _(t: Tables) -> DataFrame:
    return I.add(t.bars, {"vol_ratio": "vol_ratio"}).withColumn("busy", rules.all_of([rules.FILTERS["volume"]]))


@query(
    "prj_18_promotion_gates",
    "symbol gate passed",
    "metric threshold",
    with_(
        "panel",
        """SELECT symbol, g AS gate, m AS metric, th AS threshold, m >= th AS passed FROM (SELECT symbol, unnest(['deflated_sharpe', 'cv_pass_rate', 'capacity', 'track_record', 'max_drawdown']) AS g,
        unnest([0.96::DOUBLE, annual_vol, 20000, n, max_drawdown]) AS m, unnest([0.95::DOUBLE, 0.7, 10000, 252, -0.2]) AS th FROM q)""",
        q=METRICS_SQL.format(p=13.0, src="panel"),
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.metrics import return_metrics

    m = return_metrics(t.panel, 13.0).select(
        "symbol", F.lit(0.96).alias("dsr"), F.col("annual_vol").alias("cv_pass_rate"), F.lit(20000.0).alias("capacity_usd"), F.col("n").alias("n_obs"), F.lit(500).alias("n_trades"), "max_drawdown"
    )
    return risk.promotion_gates(m, ["symbol"])


@query(
    "prj_22_venue_funding",
    "symbol",
    "click view error divergence",
    with_(
        "event_funding",
        """SELECT day AS symbol, click, view, error, click - CASE WHEN (view <> 0)::INT + (error <> 0)::INT > 0 THEN (view + error) / ((view <> 0)::INT + (error <> 0)::INT) ELSE 0 END AS divergence FROM (SELECT CAST(ts // 86400000 AS VARCHAR) AS day,
        coalesce(max(r) FILTER (symbol = 'click'), 0) AS click, coalesce(max(r) FILTER (symbol = 'view'), 0) AS view, coalesce(max(r) FILTER (symbol = 'error'), 0) AS error FROM (SELECT symbol, ts, funding_rate AS r FROM event_funding) GROUP BY 1)""",
    ),
    digits=9,
)
def _(t: Tables) -> DataFrame:
    day = F.floor(F.col("ts") / 86_400_000).cast("string")
    nested = t.event_funding.groupBy(day.alias("d")).agg(F.collect_list(F.struct(F.col("symbol").alias("venue"), F.col("funding_rate").alias("rate"))).alias("venues"))
    return readers.venue_funding(nested.withColumnRenamed("d", "symbol"), "click", ["view", "error"])


@query(
    "join_12_position_on_bars",
    "symbol ts",
    "position",
    with_("bn", "SELECT b.symbol, b.ts, coalesce(sum(t.side), 0) AS position FROM bn b LEFT JOIN trades t ON t.symbol = b.symbol AND b.ts >= t.entry_ts AND b.ts < t.exit_ts GROUP BY 1, 2", **LEDGER),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.series import day_of

    return asof.position_on_bars(t.bars.select("symbol", "ts"), trades_of(t).select("symbol", "entry_ts", "exit_ts", "side"), slice_by=day_of())


@query(
    "prj_21_asset_contexts",
    "symbol",
    "day_volume open_interest mark previous",
    with_("bars", "SELECT symbol, sum(volume * close) AS day_volume, 0 AS open_interest, arg_max(close, ts) AS mark, arg_min(open, ts) AS previous FROM bars GROUP BY 1"),
    digits=3,
)
def _(t: Tables) -> DataFrame:
    # names and contexts of each region's symbols as two arrays that belong together by position
    per = t.bars.groupBy("symbol").agg(F.sum(F.col("volume") * F.col("close")).alias("v"), F.max_by("close", "ts").alias("m"), F.min_by("open", "ts").alias("p"))
    ctx = F.struct(F.col("v").cast("string").alias("dayNtlVlm"), F.col("m").cast("string").alias("markPx"), F.col("p").cast("string").alias("prevDayPx"))
    rows = per.select("symbol", F.array(F.struct(F.col("symbol").alias("name"))).alias("universe"), F.array(ctx).alias("contexts"))
    return readers.asset_contexts(rows, keys=["symbol"])


@query(
    "prj_23_lending_reserves",
    "token",
    "borrow_rate supply_rate borrowed supplied utilisation",
    with_(
        "type_ticks",
        """SELECT token, b AS borrow_rate, b / 2 AS supply_rate, x AS borrowed, s AS supplied, CASE WHEN s > 0 THEN x / s ELSE 0 END AS utilisation FROM (
        SELECT symbol AS token, arg_max(price / 1000, seq) AS b, arg_max(size, seq) AS x, arg_max(size * 2 + price, seq) AS s FROM type_ticks WHERE symbol <> 'error' GROUP BY 1)""",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = t.type_ticks.select(
        "seq",
        F.lit(None).cast("string").alias("coin"),
        F.when(F.col("symbol") == "error", " ").otherwise(F.col("symbol")).alias("token"),
        (F.col("price") / 1000).alias("borrow_rate"),
        (F.col("price") / 2000).alias("supply_rate"),
        F.col("size").alias("borrowed"),
        (F.col("size") * 2 + F.col("price")).alias("supplied"),
    )
    return readers.lending_reserves(rows)


@query(
    "join_13_parameter_grid",
    "fast slow bars",
    "mean_gap",
    with_(
        "bn",
        "SELECT fast, slow, count(gap) AS bars, avg(gap) AS mean_gap FROM g GROUP BY 1, 2",
        g=" UNION ALL ".join(f"SELECT {a} AS fast, {b} AS slow, {full('avg(close)', a)} - {full('avg(close)', b)} AS gap FROM bn" for a in (3, 5) for b in (5, 20) if a < b),
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.portfolio import parameter_grid

    wanted = {f"m{p}": ("sma", {"period": p}) for p in (3, 5, 20)}
    df = parameter_grid(I.add(t.bars, wanted), {"fast": [3, 5, 5], "slow": [5, 20]}, keep=lambda g: g["fast"] < g["slow"])
    means = F.create_map(*[x for p in (3, 5, 20) for x in (F.lit(p), F.col(f"m{p}"))])
    df = df.withColumn("gap", means[F.col("fast")] - means[F.col("slow")])
    return df.groupBy("fast", "slow").agg(F.count("gap").alias("bars"), F.avg("gap").alias("mean_gap"))


@query(
    "win_34_imbalance_zscore",
    "symbol ts",
    "z",
    with_(
        "book_feats",
        f"""SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 12 AND stddev_samp(imbalance) {over(12)} > 0 THEN (imbalance - avg(imbalance) {over(12)}) / stddev_samp(imbalance) {over(12)} END AS z FROM book_feats""",
    ),
)
def _(t: Tables) -> DataFrame:
    from marketspark.operators.bars import book_features
    from marketspark.operators.pressure import imbalance_zscore

    return imbalance_zscore(book_features(t.books), 12)
