"""Adapters from the star-schema test tables to the market tables (fills, ticks, books, funding …).

On a cluster the same operators read real market tables (``readers.py``); these adapters let
every registered query run on the given Parquet tables as a whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions.timefn import DAY_MS, HOUR_MS, bucket
from marketspark.operators.bars import bars_from_fills, bars_from_ticks
from marketspark.operators.series import parts_for


def _ms(name: str) -> Column:
    """Epoch milliseconds of a time stored without a zone; the session runs in UTC."""
    return F.unix_millis(F.col(name).cast("timestamp"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """Sparse tick series, one per user."""
        return self._events().select(
            F.concat(F.lit("U"), "user_id").alias("symbol"), "ts", "seq", "price", "size", "event_type"
        )

    @cached_property
    def type_ticks(self) -> DataFrame:
        """Few dense tick series, one per event type: the skewed case."""
        return self._events().select(F.col("event_type").alias("symbol"), "ts", "seq", "price", "size")

    def _events(self) -> DataFrame:
        return self.raw("events").select(
            "user_id",
            "event_type",
            _ms("ts").alias("ts"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("size"),
        )

    @cached_property
    def fills(self) -> DataFrame:
        buy = F.col("event_type").isin("purchase", "signup")
        is_open = F.col("event_type").isin("signup", "purchase", "view")
        return self._events().select(
            F.concat(F.lit("U"), "user_id").alias("symbol"),
            "ts",
            "seq",
            "price",
            "size",
            F.when(buy, "B").otherwise("A").alias("side"),
            is_open.alias("is_open"),
            (buy == is_open).alias("is_long"),
            (F.col("event_type") != "error").alias("crossed"),
            F.when(is_open, F.lit(0.0)).otherwise(F.col("price") - 20).alias("closed_pnl"),
            (F.col("price") * F.col("size") * 0.0001).alias("fee"),
        )

    @cached_property
    def deals(self) -> DataFrame:
        """Fills with tame prices, one series per supplier."""
        li = self.raw("lineitem")
        opens, longs = F.col("l_linestatus") == "O", F.col("l_returnflag") != "R"
        price = 100 + F.col("l_extendedprice") / 2000
        fee = F.col("l_tax") * F.col("l_extendedprice") * 0.01
        pnl = F.when(opens, F.lit(0.0)).otherwise((F.col("l_discount") - 0.05) * F.col("l_extendedprice") * 0.1)
        return li.select(
            F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
            _ms("l_shipdate").alias("ts"),
            # order key, line number, price in cents: rows that still tie have the same price
            (
                F.col("l_orderkey").cast("decimal(14,0)") * F.lit(10**11).cast("decimal(12,0)")
                + F.col("l_linenumber").cast("decimal(1,0)") * F.lit(10**10).cast("decimal(11,0)")
                + F.round(F.col("l_extendedprice") * 100).cast("decimal(10,0)")
            )
            .cast("decimal(25,0)")
            .alias("seq"),
            price.alias("price"),
            F.col("l_quantity").alias("size"),
            F.when(opens == longs, "B").otherwise("A").alias("side"),
            opens.alias("is_open"),
            longs.alias("is_long"),
            (F.col("l_linenumber") <= 6).alias("crossed"),
            pnl.alias("closed_pnl"),
            fee.alias("fee"),
            F.col("l_discount").alias("slip"),
            F.col("l_orderkey").alias("order_id"),
        )

    @cached_property
    def deal_count(self) -> int:
        """No bar table of the deals is longer; the file footers tell it."""
        return self.raw("lineitem").count()

    @cached_property
    def bars(self) -> DataFrame:
        """Weekly bars with order flow, one series per supplier."""
        return bars_from_fills(self.deals, "1w")

    @cached_property
    def placed_bars(self) -> DataFrame:
        """The weekly bars, whole series a partition and as many partitions as their number asks for."""
        return self.bars.repartition(parts_for(self.spark, self.deal_count), "symbol")

    @cached_property
    def day_bars(self) -> DataFrame:
        return bars_from_fills(self.deals, "1d")

    @cached_property
    def user_bars(self) -> DataFrame:
        return bars_from_ticks(self.ticks, "1h")

    @cached_property
    def type_bars(self) -> DataFrame:
        return bars_from_ticks(self.type_ticks, "1h")

    @cached_property
    def panel(self) -> DataFrame:
        """Returns panel (ts, symbol, ret, volume): four-week bars per supplier."""
        from marketspark.operators.series import series_window

        monthly = bars_from_fills(self.deals, "4w")
        w = series_window()
        ret = F.col("close") / F.lag("close").over(w) - 1
        return monthly.select("ts", "symbol", ret.alias("ret"), "volume").where("ret is not null")

    @cached_property
    def strategies(self) -> DataFrame:
        """A few return series at the same times: one per order priority (mean scaled price move by week)."""
        from marketspark.operators.series import series_window

        weekly = (
            self.raw("orders")
            .groupBy(F.col("o_orderpriority").alias("symbol"), bucket(_ms("o_orderdate"), "1w").alias("ts"))
            .agg(F.avg(100 + F.col("o_totalprice") / 10000).alias("price"))
        )
        ret = F.col("price") / F.lag("price").over(series_window()) - 1
        return weekly.select("symbol", "ts", ret.alias("ret")).where("ret is not null")

    @cached_property
    def funding(self) -> DataFrame:
        """Daily funding per order priority: small rates around zero and a premium."""
        o = self.raw("orders")
        return o.groupBy(F.col("o_orderpriority").alias("symbol"), _ms("o_orderdate").alias("ts")).agg(
            ((F.avg("o_totalprice") - 250000) / 1e9).alias("funding_rate"), ((F.max("o_totalprice") - 400000) / 1e8).alias("premium")
        )

    @cached_property
    def event_funding(self) -> DataFrame:
        """Hourly funding per event type."""
        e = self._events()
        return e.groupBy(F.col("event_type").alias("symbol"), (F.col("ts") - F.pmod("ts", F.lit(HOUR_MS))).alias("ts")).agg(
            ((F.avg("size") - 50) / 1e5).alias("funding_rate"), ((F.max("price") - 60) / 1e4).alias("premium")
        )

    @cached_property
    def open_interest(self) -> DataFrame:
        """Daily open interest per event type."""
        e = self._events()
        return e.groupBy(F.col("event_type").alias("symbol"), (F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).alias("ts")).agg(
            F.sum("size").alias("oi_close")
        )

    @cached_property
    def book_levels(self) -> DataFrame:
        """Book levels (symbol, ts, side, px, sz): a snapshot per event hour and type, prices around the mean."""
        e = self._events()
        hour = F.col("ts") - F.pmod("ts", F.lit(600_000))
        is_bid = F.pmod("seq", F.lit(2)) == 0
        px = F.when(is_bid, 100 - F.col("price") / 100).otherwise(100.01 + F.col("price") / 100)
        return e.select(
            F.col("event_type").alias("symbol"), hour.alias("ts"), F.when(is_bid, "bid").otherwise("ask").alias("side"), px.alias("px"), (F.col("size") + 1).alias("sz")
        )

    @cached_property
    def books(self) -> DataFrame:
        """Snapshots with ``bids`` and ``asks`` arrays, best first."""
        lv = F.struct("px", "sz")
        is_bid = F.col("side") == "bid"
        return (
            self.book_levels.groupBy("symbol", "ts")
            .agg(F.sort_array(F.collect_list(F.when(is_bid, lv)), asc=False).alias("bids"), F.sort_array(F.collect_list(F.when(~is_bid, lv))).alias("asks"))
        )

    @cached_property
    def universe(self) -> DataFrame:
        """symbol, volume, tags of every supplier."""
        revenue = self.raw("lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("volume"))
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(revenue, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), "volume", F.array("n_name", "r_name").alias("tags"), "r_name", "s_acctbal")
        )
