"""Readers: partitioned Parquet tables, JSON lines, CSV, session logs. Scans stay lazy; filters and
column lists reach the file scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import epoch_ms, parse_bar_freq
from marketspark.operators.bars import threshold_bars
from marketspark.sources.schemas import BARS, FILLS, FUNDING, OPEN_INTEREST, check_fields, conform


def in_time(df: DataFrame, start: str | int | None = None, end: str | int | None = None, ts: str = "ts") -> DataFrame:
    """Rows in [start, end], both ends included; ISO text without a zone is UTC."""
    if start is not None:
        df = df.where(F.col(ts) >= epoch_ms(start))
    if end is not None:
        df = df.where(F.col(ts) <= epoch_ms(end))
    return df


def select_bars(bars: DataFrame, symbols: Sequence[str], fields: Sequence[str], start: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """Requested fields of the symbols in a time range; fields a table lacks are left out."""
    check_fields(fields)
    names = {"trades": "num_trades", "candle_pnl": "total_pnl", "candle_fees": "total_fees"}
    present = [F.col(names.get(f, f)).alias(f) for f in fields if names.get(f, f) in bars.columns]
    df = bars.where(F.col("symbol").isin(list(symbols))) if symbols else bars
    return in_time(df, start, end).select("symbol", "ts", *present)


def read_bars(spark: SparkSession, root: str, tf: str) -> DataFrame:
    """Bars from ``root/symbol=…/tf=…`` (the timeframe prunes partitions)."""
    return conform(spark.read.parquet(root).where(F.col("tf") == tf), BARS)


def load(spark: SparkSession, root: str, symbols: Sequence[str], fields: Sequence[str], freq: str, start: str | int | None = None, end: str | int | None = None, finest: str = "1m") -> DataFrame:
    """Time bars of ``freq``, or ``volume:N`` / ``dollar:N`` bars built from the finest timeframe."""
    kind, size = parse_bar_freq(freq)
    if kind == "time":
        return select_bars(read_bars(spark, root, freq), symbols, fields, start, end)
    base = read_bars(spark, root, finest).where(F.col("symbol").isin(list(symbols)))
    made = threshold_bars(in_time(base, start, end), float(size), dollar=kind == "dollar")
    return select_bars(made, symbols, fields)


def read_fills(spark: SparkSession, root: str) -> DataFrame:
    """Fills from ``root/symbol=…/date=…``."""
    return conform(spark.read.parquet(root), FILLS)


def read_series(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Funding or open-interest series, partitioned by symbol."""
    return conform(spark.read.parquet(root), {"funding": FUNDING, "open_interest": OPEN_INTEREST}[kind])


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns become NULL."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def read_lines(spark: SparkSession, path: str, schema: str, start: str | int | None = None, end: str | int | None = None, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Snapshots from JSON lines in daily folders, both ends of the range included, one row per key.

    The range cuts the folders that are read; of rows with one key that differ the smallest in column order stays.
    """
    df = spark.read.schema(f"{schema}, date date").json(path)
    for bound, inside in ((start, F.col("date") >= _date_of(start)), (end, F.col("date") <= _date_of(end))):
        df = df if bound is None else df.where(inside)
    return one_per_key(in_time(df, start, end).drop("date"), list(keys), [c for c in df.columns if c not in (*keys, "date")])


def _date_of(bound: str | int | None) -> Column:
    return F.to_date(F.timestamp_millis(F.lit(epoch_ms(bound or 0))))


def parse_fill_lines(lines: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Fills from JSON lines (column ``value``): each has ``events`` whose items are ``[address, fill]`` or ``fill``.
    Broken lines and times are skipped."""
    events = lines.select(F.explode(F.from_json("value", "events array<string>")["events"]).alias("e"))
    text = F.when(F.ltrim("e").startswith("["), F.get_json_object("e", "$[1]")).otherwise(F.col("e"))
    fields = "coin string, time string, px string, sz string, side string, dir string, crossed boolean, closedPnl string, fee string, startPosition string"
    f = events.select(F.from_json(text, fields).alias("f")).select("f.*")
    direction = F.coalesce("dir", F.lit(""))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    out = f.select(
        F.col("coin").alias("symbol"),
        F.col("time").try_cast("long").alias("ts"),
        number("px").alias("price"),
        number("sz").alias("size"),
        F.coalesce("side", F.lit("")).alias("side"),
        direction.alias("dir"),
        direction.contains("Open").alias("is_open"),
        direction.contains("Long").alias("is_long"),
        F.coalesce("crossed", F.lit(False)).alias("crossed"),
        number("closedPnl").alias("closed_pnl"),
        number("fee").alias("fee"),
        number("startPosition").alias("start_position"),
    ).where(F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    return out if symbols is None else out.where(F.col("symbol").isin(list(symbols)))


def parse_book_lines(lines: DataFrame) -> DataFrame:
    """Book snapshots from JSON lines ``{"raw": {"data": {coin, time, levels: [bids, asks]}}}``; broken lines are skipped."""
    schema = "raw struct<data: struct<coin: string, time: bigint, levels: array<array<struct<px: string, sz: string>>>>>"
    d = lines.select(F.from_json("value", schema)["raw"]["data"].alias("d")).where("d.time is not null and size(d.levels) >= 2")

    def side(i: int) -> Column:
        return F.transform(F.col("d.levels")[i], lambda x: F.struct(x["px"].try_cast("double").alias("px"), x["sz"].try_cast("double").alias("sz")))

    out = d.select(F.col("d.coin").alias("symbol"), F.col("d.time").alias("ts"), side(0).alias("bids"), side(1).alias("asks"))
    broken = F.exists("bids", lambda x: x["px"].isNull() | x["sz"].isNull()) | F.exists("asks", lambda x: x["px"].isNull() | x["sz"].isNull())
    return out.where(~broken)


def context_funding(csv: DataFrame) -> DataFrame:
    """Funding from asset-context tables whose column names vary; one row per symbol and time."""

    def pick(*names: str) -> Column:
        there = [F.col(n) for n in names if n in csv.columns]
        return F.coalesce(*there) if there else F.lit(None)

    rows = csv.select(
        pick("coin", "name").cast("string").alias("symbol"),
        pick("timestamp", "time").try_cast("double").cast("long").alias("ts"),
        pick("funding", "fundingRate", "funding_rate").try_cast("double").alias("funding_rate"),
    )
    return one_per_key(rows.where("ts is not null and funding_rate is not null"), ["symbol", "ts"], ["funding_rate"])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in a stated order (a plain ``dropDuplicates`` would keep an arbitrary one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def session_trades(sessions: DataFrame) -> DataFrame:
    """Trades of session logs (nested ``trades`` arrays), flattened with the session's columns."""
    kept = [c for c in sessions.columns if c != "trades"]
    return sessions.select(*kept, F.explode("trades").alias("_t")).select(*kept, "_t.*")


def inventory(bars: DataFrame, by: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """Rows and first and last time per symbol and timeframe."""
    return bars.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def file_sizes(df: DataFrame) -> DataFrame:
    """Bytes and number of the files behind a scan."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def available_fields(present: DataFrame) -> DataFrame:
    """(symbol, fields) from (symbol, source) rows: the fields each symbol's sources offer."""
    from marketspark.sources.schemas import FIELDS

    listed = F.create_map(
        *[x for s in sorted({f.source for f in FIELDS.values()}) for x in (F.lit(s), F.array(*[F.lit(f.name) for f in FIELDS.values() if f.source == s]))]
    )
    exploded = present.select("symbol", F.explode(listed[F.col("source")]).alias("field"))
    return exploded.groupBy("symbol").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def latest(df: DataFrame, n: int, ts: str = "ts", ties: Sequence[str] = (), **equal: str) -> DataFrame:
    """Last ``n`` rows, newest first, with equality filters (logs, histories); rows of the same time by ``ties``, largest first."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in ties]).limit(n)


def asset_contexts(zipped: DataFrame, universe: str = "universe", contexts: str = "contexts", keys: Sequence[str] = ()) -> DataFrame:
    """One row per asset from two arrays that belong together by position (within ``keys``, if there are several
    rows); text numbers cast, missing is 0."""
    tag = [F.col(k).alias(f"_k_{k}") for k in keys]
    names = zipped.select(*tag, F.posexplode(universe).alias("_i", "_a"))
    ctx = zipped.select(*tag, F.posexplode(contexts).alias("_i", "_c"))
    joined = names.join(ctx, [*[f"_k_{k}" for k in keys], "_i"], "left").select("_a.*", "_c.*")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in joined.columns else F.lit(0.0)

    impact = F.col("impactPxs") if "impactPxs" in joined.columns else F.lit(None).cast("array<string>")
    return joined.select(
        F.upper("name").alias("symbol"),
        number("dayNtlVlm").alias("day_volume"),
        number("openInterest").alias("open_interest"),
        number("premium").alias("premium"),
        number("markPx").alias("mark"),
        number("oraclePx").alias("oracle"),
        number("prevDayPx").alias("previous"),
        number("funding").alias("funding"),
        F.coalesce(F.get(impact, F.lit(0)).try_cast("double"), F.lit(0.0)).alias("impact_bid"),
        F.coalesce(F.get(impact, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("impact_ask"),
    )


def venue_funding(nested: DataFrame, own: str, others: Sequence[str]) -> DataFrame:
    """(symbol, own, one column per other venue, divergence) from rows ``symbol, venues: array<struct<venue, rate>>``.
    The comparison is with the mean of the non-zero other venues."""
    flat = nested.select("symbol", F.explode("venues").alias("v"))
    wide = flat.groupBy("symbol").agg(*[F.coalesce(F.max(F.when(F.col("v.venue") == v, F.col("v.rate"))), F.lit(0.0)).alias(v) for v in [own, *others]])
    total = sum((F.col(v) for v in others), F.lit(0.0))
    n = sum((F.when(F.col(v) != 0, 1).otherwise(0) for v in others), F.lit(0))
    return wide.withColumn("divergence", F.col(own) - F.when(n > 0, total / F.when(n > 0, n)).otherwise(0.0))


def lending_reserves(rows: DataFrame) -> DataFrame:
    """Borrow and supply per token from rows with ``seq``; blank tokens are dropped and the later row wins."""
    token = F.coalesce("coin", "token")
    named = rows.withColumn("token", token).where(F.trim("token") != "")
    return named.groupBy("token").agg(F.max_by(F.struct("borrow_rate", "supply_rate", "borrowed", "supplied"), "seq").alias("r")).select(
        "token", "r.*", F.when(F.col("r.supplied") > 0, F.col("r.borrowed") / F.when(F.col("r.supplied") > 0, F.col("r.supplied"))).otherwise(0.0).alias("utilisation")
    )
