"""DuckDB twins of the table adapters, as named common table expressions."""

from __future__ import annotations

from marketspark.functions import probability as P

_EV = "epoch_us(ts) // 1000 AS ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size"

# name -> (needed names, body)
CTES: dict[str, tuple[str, str]] = {
    "ticks": ("", f"SELECT 'U' || user_id AS symbol, event_type, {_EV} FROM events"),
    "type_ticks": ("", f"SELECT event_type AS symbol, {_EV} FROM events"),
    "fills": (
        "ticks",
        """SELECT *, (side = 'B') = is_open AS is_long, CASE WHEN is_open THEN 0 ELSE price - 20 END AS closed_pnl,
        price * size * 0.0001::DOUBLE AS fee FROM (SELECT *, CASE WHEN event_type IN ('purchase','signup') THEN 'B' ELSE 'A' END AS side,
        event_type IN ('signup','purchase','view') AS is_open, event_type <> 'error' AS crossed FROM ticks)""",
    ),
    "deals": (
        "",
        """SELECT 'S' || l_suppkey AS symbol, epoch_ms(l_shipdate) AS ts,
        l_orderkey::HUGEINT * 100000000000 + l_linenumber::HUGEINT * 10000000000 + CAST(round(l_extendedprice * 100) AS HUGEINT) AS seq,
        100 + l_extendedprice / 2000 AS price, l_quantity AS size,
        CASE WHEN (l_linestatus = 'O') = (l_returnflag <> 'R') THEN 'B' ELSE 'A' END AS side,
        l_linestatus = 'O' AS is_open, l_returnflag <> 'R' AS is_long, l_linenumber <= 6 AS crossed,
        CASE WHEN l_linestatus = 'O' THEN 0 ELSE (l_discount - 0.05::DOUBLE) * l_extendedprice * 0.1::DOUBLE END AS closed_pnl,
        l_tax * l_extendedprice * 0.01::DOUBLE AS fee, l_discount AS slip, l_orderkey AS order_id FROM lineitem""",
    ),
    "user_bars": ("ticks", ""),
    "type_bars": ("type_ticks", ""),
    "bars": ("deals", ""),
    "day_bars": ("deals", ""),
    "month_bars": ("deals", ""),
    "bn": ("bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars"),
    "panel": (
        "month_bars",
        """SELECT * FROM (SELECT ts, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, volume
        FROM month_bars) WHERE ret IS NOT NULL""",
    ),
    "strategies": (
        "",
        """SELECT * FROM (SELECT symbol, ts, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM
        (SELECT o_orderpriority AS symbol, (epoch_ms(o_orderdate) - 345600000) // 604800000 * 604800000 + 345600000 AS ts,
        avg(100 + o_totalprice / 10000) AS price FROM orders GROUP BY 1, 2)) WHERE ret IS NOT NULL""",
    ),
    "funding": (
        "",
        """SELECT o_orderpriority AS symbol, epoch_ms(o_orderdate) AS ts, (avg(o_totalprice) - 250000) / 1e9 AS funding_rate,
        (max(o_totalprice) - 400000) / 1e8 AS premium FROM orders GROUP BY 1, 2""",
    ),
    "event_funding": (
        "type_ticks",
        """SELECT symbol, ts // 3600000 * 3600000 AS ts, (avg(size) - 50) / 1e5 AS funding_rate, (max(price) - 60) / 1e4 AS premium
        FROM type_ticks GROUP BY 1, 2""",
    ),
    "open_interest": ("type_ticks", "SELECT symbol, ts // 86400000 * 86400000 AS ts, sum(size) AS oi_close FROM type_ticks GROUP BY 1, 2"),
    "book_levels": (
        "type_ticks",
        """SELECT symbol, ts // 600000 * 600000 AS ts, CASE WHEN seq % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
        CASE WHEN seq % 2 = 0 THEN 100 - price / 100 ELSE 100.01::DOUBLE + price / 100 END AS px, size + 1 AS sz FROM type_ticks""",
    ),
    "levels_ranked": (
        "book_levels",
        """SELECT *, row_number() OVER (PARTITION BY symbol, ts, side ORDER BY CASE WHEN side = 'bid' THEN -px ELSE px END,
        CASE WHEN side = 'bid' THEN -sz ELSE sz END) AS lvl FROM book_levels""",
    ),
    "book_feats": (
        "levels_ranked",
        """SELECT *, (best_bid + best_ask) / 2 AS mid, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 AS spread_bps,
        (bid_depth - ask_depth) / (bid_depth + ask_depth) AS imbalance FROM (SELECT symbol, ts,
        max(px) FILTER (side = 'bid') AS best_bid, min(px) FILTER (side = 'ask') AS best_ask,
        sum(px * sz) FILTER (side = 'bid' AND lvl <= 10) AS bid_depth, sum(px * sz) FILTER (side = 'ask' AND lvl <= 10) AS ask_depth,
        max(px * sz) FILTER (side = 'bid' AND lvl <= 10) AS bid_wall, max(px * sz) FILTER (side = 'ask' AND lvl <= 10) AS ask_wall
        FROM levels_ranked GROUP BY 1, 2) WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL""",
    ),
    "universe": (
        "",
        """SELECT 'S' || s_suppkey AS symbol, volume, [n_name, r_name] AS tags, r_name, s_acctbal FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice) AS volume FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""",
    ),
}


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf_sql(z: str, name: str = "nz") -> str:
    """The normal distribution by the same approximation as ``functions.probability``."""
    tail = f"""list_transform([abs({name})], lambda {name}x: CASE WHEN {name}x < {P.HART_BORDER!r} THEN exp({name}x * {name}x / -2) * {_polynomial(name + "x", P.HART_TOP)} / {_polynomial(name + "x", P.HART_BOTTOM)}
    ELSE exp({name}x * {name}x / -2) / ({name}x + 1 / ({name}x + 2 / ({name}x + 3 / ({name}x + 4 / ({name}x + 0.65::DOUBLE))))) / {P.ROOT_TWO_PI!r}::DOUBLE END)[1]"""
    return f"list_transform([CAST({z} AS DOUBLE)], lambda {name}: CASE WHEN {name} > 0 THEN 1 - {tail} ELSE {tail} END)[1]"


def normal_ppf_sql(p: str) -> str:
    def tail(t: str) -> str:
        r = f"sqrt(-2 * ln({t}))"
        return f"({_polynomial(r, P.TAIL_TOP)} / {_polynomial(r, P.TAIL_BOTTOM)})"

    c = "(np - 0.5::DOUBLE)"
    middle = f"({_polynomial(f'({c} * {c})', P.QUANTILE_TOP)} * {c} / {_polynomial(f'({c} * {c})', P.QUANTILE_BOTTOM)})"
    rough = f"CASE WHEN np < {P.QUANTILE_TAIL} THEN {tail('np')} WHEN np > {1 - P.QUANTILE_TAIL} THEN -{tail('(1 - np)')} ELSE {middle} END"
    step = f"({normal_cdf_sql('nx')} - np) * sqrt(2 * pi()) * exp(nx * nx / 2)"
    return f"list_transform([CAST({p} AS DOUBLE)], lambda np: list_transform([{rough}], lambda nx: list_transform([{step}], lambda nu: nx - nu / (1 + nx * nu / 2))[1])[1])[1]"


def bucket_sql(ms: int, ts: str = "ts", offset: int = 0) -> str:
    return f"(({ts} - {offset}) // {ms} * {ms} + {offset})" if offset else f"({ts} // {ms} * {ms})"


def ohlcv_sql(src: str, ms: int, offset: int = 0) -> str:
    return f"""SELECT symbol, {bucket_sql(ms, 'ts', offset)} AS ts, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, row(ts, seq)) AS close, sum(size) AS volume, count(*) AS num_trades FROM {src} GROUP BY 1, 2"""


def flow_bars_sql(src: str, ms: int, offset: int = 0) -> str:
    def part(cond: str) -> str:
        return f"sum(CASE WHEN {cond} THEN size ELSE 0 END)"

    return f"""SELECT *, 1.0::DOUBLE AS taker_ratio, buy_volume - sell_volume AS volume_delta,
    opens_long - closes_long - opens_short + closes_short AS net_flow FROM (
    SELECT symbol, {bucket_sql(ms, 'ts', offset)} AS ts, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, row(ts, seq)) AS close, sum(size) AS volume, count(*) AS num_trades,
    {part('is_open = is_long')} AS buy_volume, {part('is_open <> is_long')} AS sell_volume,
    {part('is_open AND is_long')} AS opens_long, {part('NOT is_open AND is_long')} AS closes_long,
    {part('is_open AND NOT is_long')} AS opens_short, {part('NOT is_open AND NOT is_long')} AS closes_short,
    sum(closed_pnl) AS total_pnl, sum(fee) AS total_fees FROM {src} WHERE crossed GROUP BY 1, 2)"""


_BODIES = {
    "user_bars": ohlcv_sql("ticks", 3_600_000),
    "type_bars": ohlcv_sql("type_ticks", 3_600_000),
    "bars": flow_bars_sql("deals", 604_800_000, 345_600_000),
    "day_bars": flow_bars_sql("deals", 86_400_000),
    "month_bars": flow_bars_sql("deals", 4 * 604_800_000, 345_600_000),
}


def with_(needs: str, body: str, **extra: str) -> str:
    """``WITH RECURSIVE`` prefix for the named tables (and what they need), the extra ones in order, then ``body``."""
    names: list[str] = []

    def visit(name: str) -> None:
        if name in names:
            return
        for need in CTES[name][0].split():
            visit(need)
        names.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][1] or _BODIES[n]})" for n in names] + [f"{n} AS ({b})" for n, b in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def over(rows: int | None = None, by: str = "symbol", order: str = "ts") -> str:
    """Window clause; ``rows`` counts the current row, None is everything up to now."""
    start = "UNBOUNDED PRECEDING" if rows is None else f"{rows - 1} PRECEDING"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {start} AND CURRENT ROW)"


def prior(rows: int, by: str = "symbol", order: str = "ts") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def full(agg: str, rows: int) -> str:
    """Aggregate over the last rows, NULL before there are enough (needs ``rn``)."""
    return f"CASE WHEN rn >= {rows} THEN {agg} {over(rows)} END"


def lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def recursion(src: str, **outs: tuple[str, str]) -> str:
    """y = a·y₋₁ + b along ``rn`` of each symbol of ``src``; a = 0 starts, a NULL gives NULL."""
    first = ", ".join(f"CASE WHEN {a} = 0 THEN {b} END AS {o}" for o, (a, b) in outs.items())
    again = ", ".join(f"CASE WHEN s.{o}_a = 0 THEN s.{o}_b ELSE s.{o}_a * r.{o} + s.{o}_b END" for o in outs)
    coded = ", ".join(f"CAST({a} AS DOUBLE) AS {o}_a, CAST({b} AS DOUBLE) AS {o}_b" for o, (a, b) in outs.items())
    first = ", ".join(f"CASE WHEN {o}_a = 0 THEN {o}_b END AS {o}" for o in outs)
    return f"""WITH RECURSIVE coded AS MATERIALIZED (SELECT symbol, rn, {coded} FROM {src}),
    r AS (SELECT symbol, rn, {first} FROM coded WHERE rn = 1 UNION ALL
    SELECT s.symbol, s.rn, {again} FROM r JOIN coded s ON s.symbol = r.symbol AND s.rn = r.rn + 1)
    SELECT b.*, {', '.join('r.' + o for o in outs)} FROM r JOIN {src} b USING (symbol, rn)"""


def seed(x: str, p: int, keep: str, gain: str, agg: str = "avg") -> tuple[str, str]:
    """Coefficients of a recursion started at the p-th value of the *column* x."""
    met = f"count({x}) {over()}"
    a = f"CASE WHEN {met} = {p} THEN 0 WHEN {met} > {p} THEN {keep} END"
    b = f"CASE WHEN {met} = {p} THEN {agg}({x}) {over(p)} WHEN {met} > {p} THEN ({gain}) * {x} END"
    return a, b


def ema_coef(x: str, p: int) -> tuple[str, str]:
    return seed(x, p, f"({p - 1}.0::DOUBLE / {p + 1})", f"2.0::DOUBLE / {p + 1}")


def wilder_coef(x: str, p: int, total: bool = False) -> tuple[str, str]:
    return seed(x, p, f"({p - 1}.0::DOUBLE / {p})", "1" if total else f"1.0::DOUBLE / {p}", "sum" if total else "avg")


TR = f"CASE WHEN rn > 1 THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
