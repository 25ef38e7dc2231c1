"""Schemas of the market tables and the catalogue of fields that can be asked for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S, _B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


FILLS = _table(
    symbol=_S, ts=_L, price=_D, size=_D, side=_S, dir=_S, is_open=_B, is_long=_B, crossed=_B, closed_pnl=_D, fee=_D, start_position=_D
)
BARS = _table(
    symbol=_S, ts=_L, open=_D, high=_D, low=_D, close=_D, volume=_D, num_trades=_L, buy_volume=_D, sell_volume=_D, taker_ratio=_D, opens_long=_D,
    closes_long=_D, opens_short=_D, closes_short=_D, net_flow=_D, volume_delta=_D, total_pnl=_D, total_fees=_D,
)
LEVEL = _table(px=_D, sz=_D)
BOOKS = _table(symbol=_S, ts=_L, bids=T.ArrayType(LEVEL), asks=T.ArrayType(LEVEL))
FUNDING = _table(symbol=_S, ts=_L, funding_rate=_D, premium=_D)
OPEN_INTEREST = _table(symbol=_S, ts=_L, oi_close=_D)


@dataclass(frozen=True)
class Field:
    name: str
    source: str  # bars, funding, context, fills, books
    ingestion: str  # fetch or sync
    derived: bool = False


# The fields by source and the way they get in.
_CATALOGUE = {
    ("bars", "fetch", False): "open high low close volume trades",
    ("funding", "fetch", False): "funding_rate",
    ("context", "fetch", False): "open_interest oi_delta premium oracle_price day_volume",
    ("context", "fetch", True): "oi_zscore",
    ("fills", "sync", False): "buy_volume sell_volume taker_ratio opens_long closes_long opens_short closes_short candle_pnl candle_fees",
    ("fills", "sync", True): "imbalance net_flow",
    ("books", "sync", False): "bid_depth_5 ask_depth_5 spread_bps",
    ("books", "sync", True): "depth_ratio bid_ask_imbalance",
}
FIELDS = {n: Field(n, *key) for key, names in _CATALOGUE.items() for n in names.split()}


def check_fields(wanted: Sequence[str], available: Sequence[str] | None = None) -> list[Field]:
    """The catalogue entries of ``wanted``; an unknown or (given ``available``) missing field is an error that
    says what to do, raised before any job runs."""
    unknown = [f for f in wanted if f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}; known: {', '.join(FIELDS)}")
    if available is not None:
        missing = [f for f in wanted if f not in available and not FIELDS[f].derived]
        if missing:
            hints = sorted({f"{FIELDS[f].ingestion} {FIELDS[f].source}" for f in missing})
            raise ValueError(f"not available: {', '.join(missing)}; needs {' and '.join(hints)}")
    return [FIELDS[f] for f in wanted]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in order: cast, absent ones NULL, NaN turned into NULL."""
    cols = []
    for field in schema.fields:
        if field.name not in df.columns:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = F.col(field.name).cast(field.dataType)
        cols.append((F.when(~F.isnan(c), c) if isinstance(field.dataType, T.DoubleType) else c).alias(field.name))
    return df.select(*cols)
