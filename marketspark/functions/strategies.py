"""User strategies: a target position for each bar, from indicators and a state of their own.

A strategy that rules can say (``functions.rules``) needs none of this. One whose next position hangs on its
own past gets its series row by row: the bars are the table argument of a Python table function, partitioned by
series and ordered by time, so Spark deals and sorts them and only the strategy's state is kept. The
result is the bars with ``target``, which ``operators.pnl`` makes trades of.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.operators.indicators import Axis, add


@dataclass(frozen=True)
class Param:
    """A typed parameter with its default and, for numbers, its bounds."""

    default: object
    low: float | None = None
    high: float | None = None
    about: str = ""

    def checked(self, name: str, value: object) -> object:
        kind = type(self.default)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not kind:
            raise TypeError(f"parameter {name!r} is {kind.__name__}, not {type(value).__name__}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"parameter {name!r} must lie in [{self.low}, {self.high}]")
        return value


class Strategy:
    """Base of user strategies: ``params``, the indicators they need, and the position after each bar."""

    params: Mapping[str, Param] = {}

    def __init__(self, **values: object):
        unknown = set(values) - set(self.params)
        if unknown:
            raise ValueError(f"no parameter {', '.join(sorted(unknown))}; known: {', '.join(sorted(self.params))}")
        self.values = {n: p.checked(n, values.get(n, p.default)) for n, p in self.params.items()}

    def indicators(self) -> dict[str, tuple[str, dict] | str]:
        """Indicator columns by name, as for ``indicators.add``."""
        return {}

    def on_bar(self, bar: Row, state: dict) -> float:
        """The position wanted after ``bar``; ``state`` starts empty for each series and is kept."""
        raise NotImplementedError


STRATEGIES: dict[str, type[Strategy]] = {}


def strategy(name: str):
    """Registers a class under ``name``."""

    def register(cls: type[Strategy]) -> type[Strategy]:
        if name in STRATEGIES and STRATEGIES[name].__qualname__ != cls.__qualname__:
            raise ValueError(f"strategy {name!r} registered twice")
        STRATEGIES[name] = cls
        return cls

    return register


def find(name: str) -> type[Strategy]:
    """The strategy of that name; an error names what is close to it."""
    if name in STRATEGIES:
        return STRATEGIES[name]
    near = difflib.get_close_matches(name, STRATEGIES, n=3)
    raise ValueError(f"unknown strategy {name!r}; " + (f"did you mean {', '.join(near)}?" if near else f"known: {', '.join(sorted(STRATEGIES))}"))


def strategy_catalogue(spark: SparkSession) -> DataFrame:
    """A row for each parameter of each strategy."""
    rows = [
        (n, (c.__doc__ or "").strip().split("\n")[0], p, type(v.default).__name__, str(v.default), v.low, v.high, v.about)
        for n, c in STRATEGIES.items()
        for p, v in (c.params or {"": Param("")}).items()
    ]
    return spark.createDataFrame(rows, "strategy string, about string, param string, type string, default string, low double, high double, param_about string")


def targets(bars: DataFrame, name: str, axis: Axis = Axis(), **values: object) -> DataFrame:
    """``bars`` with the indicators of the strategy and its ``target``."""
    made = find(name)(**values)
    ready = add(bars, made.indicators(), axis)

    class Positions:
        def __init__(self) -> None:
            self.state: dict = {}

        def eval(self, bar: Row) -> Iterator[tuple]:
            target = made.on_bar(bar, self.state)
            yield (*bar, None if target is None else float(target))

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in ready.schema.fields], T.StructField("target", T.DoubleType())])
    return F.udtf(Positions, returnType=schema)(ready.asTable().partitionBy(*axis.keys).orderBy(*axis.order))
