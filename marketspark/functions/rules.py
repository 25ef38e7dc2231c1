"""Trading rules as data: lists of conditions that become one boolean column."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketspark.operators.indicators import Axis
from marketspark.operators.series import through_now

OPS = (">", "<", ">=", "<=", "==", "abs_below", "crosses_above", "crosses_below")


@dataclass(frozen=True)
class Condition:
    """``indicator op value`` or ``indicator op ref``; ``price`` means the close."""

    indicator: str
    op: str
    value: float | None = None
    ref: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPS)}")

    def column(self, w: WindowSpec, loose_crosses: bool = False) -> Column:
        """``loose_crosses`` reads a cross as a plain comparison."""
        left = F.col("close" if self.indicator == "price" else self.indicator)
        right = F.col(self.ref) if self.ref else F.lit(0.0 if self.value is None else float(self.value))
        plain = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "==": left == right, "abs_below": F.abs(left) < right}
        if self.op in plain:
            return plain[self.op]
        above = self.op == "crosses_above"
        now = left > right if above else left < right
        if loose_crosses:
            return now
        was_left, was_right = F.lag(left).over(w), F.lag(right).over(w)
        return now & (was_left <= was_right if above else was_left >= was_right)


# The standing filters.
FILTERS = {
    "rsi_long": Condition("rsi", "<", 40),
    "rsi_short": Condition("rsi", ">", 60),
    "volume": Condition("vol_ratio", ">", 1.5),
    "trend": Condition("adx", ">", 25),
}


def parse_rule(text: str) -> list[Condition]:
    """A rule from JSON: ``[{"indicator": "rsi", "op": "<", "value": 30}, …]``."""
    return [Condition(**item) for item in json.loads(text)]


def all_of(conditions: Sequence[Condition], axis: Axis = Axis(), loose_crosses: bool = False) -> Column:
    """AND of the conditions; false where a value is missing."""
    columns = [F.coalesce(c.column(axis.w, loose_crosses), F.lit(False)) for c in conditions]
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def with_target(df: DataFrame, long: Sequence[Condition], short: Sequence[Condition] = (), exit_: Sequence[Condition] = (), axis: Axis = Axis()) -> DataFrame:
    """Add ``target``: the last entry or exit that fired holds until the next one; entries win over exits."""
    event = F.when(all_of(long, axis), 1) if long else F.when(F.lit(False), 1)
    if short:
        event = event.when(all_of(short, axis), -1)
    if exit_:
        event = event.when(all_of(exit_, axis), 0)
    out = df.withColumn("_event", event)
    return out.withColumn("target", F.coalesce(F.last("_event", ignorenulls=True).over(through_now(axis.w)), F.lit(0))).drop("_event")
