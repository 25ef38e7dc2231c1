"""Writers and change tracking: partitioned upserts, audit export, experiment and version diffs, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.functions.timefn import bucket, interval_ms
from marketspark.operators.bars import bars_from_fills, upsert
from marketspark.session import cut_lineage


def _day(ts: str = "ts") -> Column:
    return F.to_date(F.timestamp_millis(ts))


def write_daily(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write by symbol and day; ``overwrite`` replaces only the days that occur in ``df``."""
    out = df.withColumn("date", _day()).repartition("symbol", "date")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").format(fmt).save(path)


#: Days up to which a scan is cut by a list of them.
MOST_DAYS = 10_000


def touched_part(stored: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a table partitioned by symbol and date that lie in ``days`` (symbol, date).

    The list of days cuts the scan to their folders (by first and last day where there are over ``MOST_DAYS``,
    27 years), the join to the very (symbol, date) pairs.
    """
    dates = [r["date"] for r in days.select("date").distinct().orderBy("date").limit(MOST_DAYS + 1).collect()]
    if len(dates) <= MOST_DAYS:
        cut = F.col("date").isin(dates)
    else:
        span = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        cut = F.col("date").between(F.lit(span["a"]), F.lit(span["b"]))
    return stored.where(cut).join(days, ["symbol", "date"], "left_semi")


def read_daily(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with its partition columns; None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).withColumn("symbol", F.col("symbol").cast("string"))


def merge_daily(existing: DataFrame | None, incoming: DataFrame, path: str, keep: str = "last", keys: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Upsert into a table partitioned by symbol and day. Only touched days are read and rewritten.

    ``existing`` is the table as read from ``path`` (with its partition column ``date``), or None. The
    merged days are checkpointed before they replace the files they were read from.
    """
    if existing is not None:
        days = incoming.select("symbol", _day().alias("date")).distinct()
        incoming = cut_lineage(upsert(touched_part(existing, days).drop("date"), incoming, keys=keys, keep=keep))
    write_daily(incoming, path)


def merged_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a row that is in both counts once, rows alike inside one of them stay as many."""
    columns = old.columns

    def numbered(df: DataFrame) -> DataFrame:
        hashed = df.select(*columns).withColumn("_h", F.xxhash64(*columns))
        return hashed.withColumn("_copy", F.row_number().over(Window.partitionBy("_h", *columns).orderBy("_h")))

    return numbered(old).unionByName(numbered(new)).dropDuplicates([*columns, "_copy"]).drop("_h", "_copy")


def ingest_fills(lines: DataFrame, fills_path: str, bars_path: str, tf: str, symbols: Sequence[str] | None = None) -> None:
    """JSON lines → daily fills and bars, also when a later file brings more fills of stored days.

    Fills are merged with the stored ones of the touched days (the same fill counts once, so a file
    may come again). Every bar that a touched day has a part in is built anew from all stored fills of
    its whole bucket, which may reach over several days.
    """
    from marketspark.sources.readers import parse_fill_lines

    spark = lines.sparkSession
    fills = cut_lineage(parse_fill_lines(lines, symbols))
    days = fills.select("symbol", _day().alias("date")).distinct()
    if days.isEmpty():
        return
    stored = read_daily(spark, fills_path)
    if stored is not None:
        fills = cut_lineage(merged_rows(touched_part(stored, days).select(*fills.columns), fills))
    write_daily(fills, fills_path)
    # days of the buckets touched: from each bucket's start to the last millisecond before the next
    start = bucket("ts", tf)
    buckets = fills.join(days, [fills["symbol"] == days["symbol"], _day() == days["date"]], "left_semi").select("symbol", start.alias("bar_ts")).distinct()
    end = F.col("bar_ts") + interval_ms(tf) - 1
    reach = buckets.select("symbol", F.explode(F.sequence(F.to_date(F.timestamp_millis("bar_ts")), F.to_date(F.timestamp_millis(end)))).alias("date")).distinct()
    whole = touched_part(read_daily(spark, fills_path), reach).drop("date").withColumn("bar_ts", start).join(buckets, ["symbol", "bar_ts"], "left_semi").drop("bar_ts")
    # fills of one millisecond have no order of their own: by price, in units of 1e-8
    seq = F.round(F.col("price") * 1e8).cast("decimal(25,0)")
    bars = bars_from_fills(whole.withColumn("seq", seq), tf).withColumn("tf", F.lit(tf))
    merge_daily(read_daily(spark, bars_path), bars, bars_path, keys=("symbol", "tf", "ts"))


AUDIT_FEE = 0.001  # fixed value


def audit_trail(trades: DataFrame, *, strategy: str | None = None, since_ts: int | None = None) -> DataFrame:
    """An OPEN and a CLOSE row per trade, with notional, fee and latency."""
    if strategy is not None:
        trades = trades.where(F.col("strategy") == strategy)
    if since_ts is not None:
        trades = trades.where(F.col("entry_ts") >= since_ts)
    latency = F.when((F.col("signal_ts") > 0) & (F.col("fill_ts") > 0), F.round((F.col("fill_ts") - F.col("signal_ts")) * 1000, 1))

    def row(action: str, ts: str, price: str, closing: bool) -> Column:
        none = F.lit(None)
        value = F.col("size") * F.col(price)
        return F.struct(
            F.lit(action).alias("action"),
            F.col(ts).alias("ts"),
            F.col(price).alias("price"),
            value.alias("notional"),
            (value * AUDIT_FEE).alias("fee"),
            (F.col("pnl") if closing else none).cast("double").alias("pnl"),
            (F.col("funding") if closing else none).cast("double").alias("funding"),
            (F.col("exit_reason") if closing else none).cast("string").alias("exit_reason"),
            (none if closing else latency).cast("double").alias("latency_ms"),
        )

    both = F.array(row("OPEN", "entry_ts", "entry_price", False), row("CLOSE", "exit_ts", "exit_price", True))
    return trades.select("strategy", "symbol", F.upper("side").alias("side"), "size", F.explode(both).alias("_r")).select("strategy", "symbol", "side", "size", "_r.*")


def diff_maps(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Key-wise difference of two map columns: (key, before, after, change) for keys that differ."""
    a = left.select(*keys, F.explode(column).alias("key", "before"))
    b = right.select(*keys, F.explode(column).alias("key", "after"))
    both = a.join(b, [*keys, "key"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.withColumn("change", change)


def config_hash(config: Column) -> Column:
    """sha256 of a map with its keys in order."""
    entries = F.array_sort(F.map_entries(config))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Content address of a row set, whatever its order or partitioning: rows are hashed, the hashes' parts
    summed, and the sums hashed again."""
    columns = sorted(c for c in df.columns if c not in by)
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    hashed = df.select(*by, row.alias("_h"))
    parts = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    agg = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)])
    return agg.select(*by, "rows", F.sha2(F.concat_ws("|", "rows", *[F.col(f"_s{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def seal(df: DataFrame, path: str, **meta: str) -> None:
    """Store the fingerprint of a result with its metadata."""
    fingerprint(df).withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode("append").parquet(path)


def verify(df: DataFrame, sealed: DataFrame) -> DataFrame:
    """Sealed rows with ``intact``: does the data still have the stored fingerprint."""
    now = fingerprint(df).select(F.col("fingerprint").alias("_now"))
    return sealed.join(F.broadcast(now)).withColumn("intact", F.col("_now") == F.col("fingerprint")).drop("_now")  # one row


def append_lines(df: DataFrame, path: str) -> None:
    """Append snapshots as JSON lines, one folder a day."""
    df.withColumn("date", _day()).repartition("date").write.mode("append").partitionBy("date").json(path)


def log_runs(runs: DataFrame, path: str) -> None:
    """Append experiment runs (``strategy, run_id, ts`` and metrics) to a log partitioned by strategy."""
    runs.repartition("strategy").write.mode("append").partitionBy("strategy").parquet(path)


def last_runs(log: DataFrame, n: int, *, strategy: str | None = None) -> DataFrame:
    """The ``n`` newest runs of each strategy, or of one (only its folder is read), with ``age`` 1 for the newest."""
    if strategy is not None:
        log = log.where(F.col("strategy") == strategy)
    newest = Window.partitionBy("strategy").orderBy(F.desc("ts"), F.desc("run_id"))
    return log.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def run_deltas(log: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Change of each metric from the second newest to the newest run of a strategy."""
    two = last_runs(log, 2)
    picked = [F.max(F.when(F.col("age") == age, F.col(c))).alias(f"_{c}_{age}") for c in ["run_id", *metrics] for age in (1, 2)]
    both = two.groupBy("strategy").agg(*picked)
    return both.select("strategy", F.col("_run_id_1").alias("run_id"), F.col("_run_id_2").alias("before_id"), *[(F.col(f"_{m}_1") - F.col(f"_{m}_2")).alias(f"d_{m}") for m in metrics])
