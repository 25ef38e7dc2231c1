"""Folds of a stream along event time, whatever order rows arrive in.

``OrderedFold`` keeps, for each key, the rows above the watermark and the state of the fold below it. A batch's
rows are put among the kept ones by event time and everything from the watermark on is folded anew, so the
output (in update mode, by key and time) is that of the sorted series as far as it is known. Rows that
the watermark has passed can't get predecessors any more: they move into the state, with the
batch that comes next or, where a key gets no more rows, when a timer fires. Memory of a key is what
arrives within the delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Fold = Callable[[pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]]


class OrderedFold(StatefulProcessor):
    """``fold(rows in order of ts, state) → (output rows, state)`` along each key.

    ``combine`` merges rows of one time into one (windows that get several partial sums). A row is
    settled once the watermark is ``span`` behind its time.
    """

    def __init__(self, fold: Fold, columns: T.StructType, state: T.StructType, start: tuple, combine: bool = False, span: int = 0):
        self.fold, self.columns, self.state, self.start, self.combine, self.span = fold, columns, state, start, combine, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.settled = handle.getValueState("settled", self.state)

    def _known(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns.names)

    def _advanced(self, rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """Folds all rows, settles those the watermark has passed, keeps the others."""
        if self.combine:
            rows = rows.groupby("ts", as_index=False)[[c for c in self.columns.names if c != "ts"]].sum()
        rows = rows.sort_values(self.columns.names, kind="stable").reset_index(drop=True)
        state = self.settled.get() if self.settled.exists() else self.start
        passed = rows["ts"] + self.span <= watermark
        before, state = self.fold(rows[passed], state)
        after, _ = self.fold(rows[~passed], state)
        if passed.any():
            self.settled.update(state)
        kept = rows[~passed]
        if len(kept):
            self.waiting.put([tuple(r) for r in kept[self.columns.names].astype(object).itertuples(index=False)])
            self.handle.registerTimer(int(kept["ts"].max()) + self.span)
        else:
            self.waiting.clear()
        return pd.concat([before, after])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[self.columns.names] for r in rows])
        known = self._known()
        out = self._advanced(pd.concat([known, new]) if len(known) else new, timerValues.getCurrentWatermarkInMs())
        out.insert(0, "symbol", key[0])
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self._known()
        if len(rows):
            self._advanced(rows, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def folded(stream: DataFrame, processor: OrderedFold, out: str, columns: Sequence[str]) -> DataFrame:
    """``stream`` (symbol, time with watermark, ts, columns) through ``processor``; write it in update mode by (symbol, ts)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    slim = stream.select("symbol", "time", "ts", *columns)
    return slim.groupBy("symbol").transformWithStateInPandas(processor, f"symbol string, {out}", "update", "eventTime")
