"""Ordered series: windows, running values, row numbers and recursions that do not rely on
one task holding a whole series.

Two kinds of series occur:

* *bar series*: at most one row per (symbol, bucket). Their length is bounded by the calendar
  (ten years of minutes is 5.3 million rows), whatever the number of ticks behind them, so a
  plain ``Window.partitionBy(symbol).orderBy(ts)`` is safe.
* *tick series*: unbounded. One symbol may hold a third of the table. For them the functions
  here take ``slice_by``, an expression that grows with the order (a day, an hour). Work is
  then spread over (symbol, slice) and only per-slice totals are carried between slices.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol",)
ORDER = ("ts",)


#: Rows of a partition, roughly, where tasks hold several sorted copies of their rows.
PART_ROWS = 400_000


def parts_for(spark: SparkSession, rows: int, part_rows: int = PART_ROWS) -> int:
    """Partitions for a table of up to ``rows`` rows: what a task sorts does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // part_rows))


def series_window(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def lookback(w: WindowSpec, rows: int) -> WindowSpec:
    """The last ``rows`` rows, the current one included."""
    return w.rowsBetween(-(rows - 1), 0)


def through_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full_frame(agg: Column, value: Column, w: WindowSpec, rows: int) -> Column:
    """``agg`` over the last ``rows`` rows, NULL until all of them hold a value."""
    frame = lookback(w, rows)
    return F.when(F.count(value).over(frame) == rows, agg.over(frame))


def correlation(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation over the rows that hold both, NULL where a side is constant (``corr`` fails there in ANSI
    mode, whatever condition is put around it)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    both, sa, sb = parts if frame is None else [p.over(frame) for p in parts]
    return F.try_divide(both, sa * sb)


def day_of(ts: str = "ts") -> Column:
    """Default slice of an epoch-ms series."""
    return F.floor(F.col(ts) / 86_400_000)


def _slice_offsets(df: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Totals of all earlier slices, per (key, slice). One row per slice: calendar-bounded."""
    per_slice = df.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, "_slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])


def number_rows(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, slice_by: Column | None = None, out: str = "rn"
) -> DataFrame:
    """1-based row number of each series, exact also when one series is far too long for a task."""
    if slice_by is None:
        return df.withColumn(out, F.row_number().over(series_window(keys, order)))
    sliced = df.withColumn("_slice", slice_by)
    offsets = _slice_offsets(sliced, keys, {"_before": F.count(F.lit(1))})
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn(out, F.row_number().over(w))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_slice", "_before")
    )


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    slice_by: Column | None = None,
) -> DataFrame:
    """Cumulative sums from the start of each series (NULL counts as 0)."""
    if slice_by is None:
        w = through_now(series_window(keys, order))
        return df.withColumns({n: F.sum(F.coalesce(c, F.lit(0.0))).over(w) for n, c in sums.items()})
    work = df.withColumns({f"_x_{n}": F.coalesce(c, F.lit(0.0)) for n, c in sums.items()}).withColumn("_slice", slice_by)
    offsets = _slice_offsets(work, keys, {f"_o_{n}": F.sum(f"_x_{n}") for n in sums})
    w = through_now(Window.partitionBy(*keys, "_slice").orderBy(*order))
    local = work.withColumns({n: F.sum(f"_x_{n}").over(w) for n in sums})
    joined = local.join(offsets, [*keys, "_slice"])
    joined = joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return joined.drop("_slice", *[f"_x_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def windowed(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    reach: int,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    slice_by: Column | None = None,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Apply ``build(df, w)`` whose frames reach back at most ``reach`` rows.

    With ``slice_by`` the series is cut in blocks of ``block_rows`` rows; the last ``reach`` rows
    of a block are also sent to the next one, so that every frame is complete, and are dropped
    after the computation. No task then holds more than ``block_rows + reach`` rows of a series.
    """
    if slice_by is None:
        return build(df, series_window(keys, order))
    size = max(block_rows, reach)
    numbered = number_rows(df, keys=keys, order=order, slice_by=slice_by, out="_rn")
    own = F.floor((F.col("_rn") - 1) / size)
    tail = (F.col("_rn") - 1) % size >= size - reach
    placed = numbered.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_rn")
    return build(placed, w).where(F.col("_block") == F.col("_own")).drop("_rn", "_own", "_block")


def fill_forward(
    df: DataFrame,
    fills: dict[str, Column],
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    slice_by: Column | None = None,
) -> DataFrame:
    """Last non-NULL value so far of each expression, the current row included."""
    if slice_by is None:
        w = through_now(series_window(keys, order))
        return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in fills.items()})
    work = df.withColumns({f"_v_{n}": c for n, c in fills.items()}).withColumn("_slice", slice_by)
    rank = F.struct(*order)
    last_in_slice = work.groupBy(*keys, "_slice").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_c_{n}") for n in fills]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in_slice.select(*keys, "_slice", *[F.last(f"_c_{n}", True).over(before).alias(f"_c_{n}") for n in fills])
    w = through_now(Window.partitionBy(*keys, "_slice").orderBy(*order))
    local = work.withColumns({n: F.last(f"_v_{n}", True).over(w) for n in fills})
    joined = local.join(carried, [*keys, "_slice"])
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in fills})
    return joined.drop("_slice", *[f"_v_{n}" for n in fills], *[f"_c_{n}" for n in fills])


# ── linear recursions ──────────────────────────────────────────────────────────────────────
#
# EMA, Wilder averages, directional sums, KAMA and the like are all y = a·y₋₁ + b with a and b
# known from the input. A row with a = 0 starts the recursion (y = b); a NULL a gives NULL.
# Such maps compose, so a long series is cut in blocks, each block reduced to one (A, B), the
# block starts chained, and the blocks replayed in parallel.


def _nan_floats(batch: pa.RecordBatch, name: str) -> list[float]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()


@dataclass(frozen=True)
class Then:
    """What goes on from the results of a scan in the same pass, so that no exchange comes between.

    ``make()`` gives a function from the flags of first rows and the ``inputs`` of a batch (arrays, NaN for NULL) to
    the values of ``outs``; it keeps its state from batch to batch.
    """

    outs: tuple[str, ...]
    inputs: tuple[str, ...]
    make: Callable[[], Callable[..., Sequence[list[float]]]]


def then_seeded(out: str, inputs: Sequence[str], value: Callable[..., np.ndarray], period: int, keep: float, gain: float, total: bool = False) -> Then:
    """y = keep·y₋₁ + gain·x over x = ``value`` of the inputs, started at the ``period``-th x with the mean (or sum, if
    ``total``) of the last rows."""

    def make() -> Callable:
        y, met, last = float("nan"), 0, deque(maxlen=period)

        def run(first: list[bool], *columns: np.ndarray) -> list[list[float]]:
            nonlocal y, met
            ys = []
            for starts, x in zip(first, value(*columns).tolist()):
                if starts:
                    met = 0
                    last.clear()
                last.append(x)
                met += x == x
                if met > period:
                    y = keep * y + gain * x
                elif met < period:
                    y = float("nan")
                else:
                    added, n = 0.0, 0  # in order, as a window adds
                    for v in last:
                        if v == v:
                            added, n = added + v, n + 1
                    y = (added if total else added / n) if n else float("nan")
                ys.append(y)
            return [ys]

        return run

    return Then((out,), tuple(inputs), make)


def then_affine(out: str, inputs: Sequence[str], coefficients: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Then:
    """y = a·y₋₁ + b with ``coefficients`` of the inputs; the first row of a series must not continue it."""

    def make() -> Callable:
        y = float("nan")

        def run(first: list[bool], *columns: np.ndarray) -> list[list[float]]:
            nonlocal y
            ys = []
            for a, b in zip(*[c.tolist() for c in coefficients(*columns)]):
                y = b if a == 0.0 else a * y + b
                ys.append(y)
            return [ys]

        return run

    return Then((out,), tuple(inputs), make)


def then_fold(outs: Sequence[str], inputs: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]]) -> Then:
    """A fold as in ``ordered_fold``; its rows hold None for NULL."""

    def make() -> Callable:
        state = start()

        def run(first: list[bool], *columns: np.ndarray) -> list[list[float]]:
            nonlocal state
            made = []
            for starts, row in zip(first, zip(*[[None if v != v else v for v in c.tolist()] for c in columns])):
                state, result = step(start() if starts else state, row)
                made.append(result)
            return list(zip(*made)) if made else [[] for _ in outs]

        return run

    return Then(tuple(outs), tuple(inputs), make)


def _replay(names: Sequence[str], then: Sequence[Then] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {n: float("nan") for n in names}
        going = [(t, t.make()) for t in then]
        for batch in batches:
            keep = [f for f in batch.schema.names if not f.startswith("_a_") and not f.startswith("_b_")]
            arrays = [batch.column(batch.schema.get_field_index(f)) for f in keep]
            for n in names:
                y, ys = state[n], []
                for a, b in zip(_nan_floats(batch, f"_a_{n}"), _nan_floats(batch, f"_b_{n}")):
                    y = b if a == 0.0 else a * y + b
                    ys.append(y)
                state[n] = y
                arrays.append(pa.array(ys, type=pa.float64(), from_pandas=True))
            made = dict(zip([*keep, *names], arrays))
            first = [n == 1 for n in made["_rn"].to_pylist()] if going else []
            for t, go in going:
                columns = [made[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in t.inputs]
                made |= {o: pa.array(v, type=pa.float64(), from_pandas=True) for o, v in zip(t.outs, go(first, *columns))}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _compose(names: Sequence[str], keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reduce each (key, block), met in order, to one affine map per recursion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        maps: dict[str, tuple[float, float]] = {}
        schema = None

        def emit() -> pa.RecordBatch:
            row = dict(zip([*keys, "_block"], group))
            for n in names:
                row[f"_a_{n}"], row[f"_b_{n}"] = maps[n]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in [*keys, "_block"]]))
            if schema is None:
                fields = [batch.schema.field(batch.schema.get_field_index(k)) for k in [*keys, "_block"]]
                schema = pa.schema([*fields, *[pa.field(f"_{p}_{n}", pa.float64()) for n in names for p in "ab"]])
            coeffs = {n: list(zip(_nan_floats(batch, f"_a_{n}"), _nan_floats(batch, f"_b_{n}"))) for n in names}
            for i, key in enumerate(ids):
                if key != group:
                    if group is not None:
                        yield emit()
                    group, maps = key, {n: (1.0, 0.0) for n in names}
                for n in names:
                    a, b = coeffs[n][i]
                    big_a, big_b = maps[n]
                    maps[n] = (0.0, b) if a == 0.0 else (a * big_a, a * big_b + b)
        if group is not None:
            yield emit()

    return run


def affine_scan(
    df: DataFrame,
    scans: dict[str, tuple[Column, Column]],
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    slice_by: Column | None = None,
    block_rows: int = 1_000_000,
    then: Sequence[Then] = (),
) -> DataFrame:
    """Add ``y = a·y₋₁ + b`` for each ``{out: (a, b)}``. The first row of a series must not continue
    the recursion; that is enforced here, so ``a`` and ``b`` may be written without edge cases.

    Spark knows no order behind a scan and would exchange and sort all columns again: what builds on the results
    goes in ``then`` (plain series only), as one pass over the rows."""
    names = list(scans)
    if then and slice_by is not None:
        raise ValueError("only plain series go on in the same pass")
    if slice_by is None:
        numbered = df.withColumn("_rn", F.row_number().over(series_window(keys, order)))
    else:
        numbered = number_rows(df, keys=keys, order=order, slice_by=slice_by, out="_rn")
    coded = numbered
    for n, (a, b) in scans.items():
        a, b = a.cast("double"), b.cast("double")
        coded = coded.withColumns({f"_a_{n}": F.when((F.col("_rn") == 1) & (a != 0), F.lit(None)).otherwise(a), f"_b_{n}": b})
    out_fields = [f for f in coded.schema.fields if not f.name.startswith(("_a_", "_b_"))]
    schema = T.StructType([*out_fields, *[T.StructField(n, T.DoubleType()) for n in [*names, *[o for t in then for o in t.outs]]]])
    if slice_by is None:
        # the row_number window above has clustered and sorted the series already
        return coded.sortWithinPartitions(*keys, *order).mapInArrow(_replay(names, then), schema).drop("_rn")

    blocked = coded.withColumn("_block", F.floor((F.col("_rn") - 1) / block_rows).cast("long"))
    coeffs = [f"_{p}_{n}" for n in names for p in "ab"]
    slim = blocked.select(*keys, "_block", "_rn", *coeffs).repartition(*keys, "_block")
    map_schema = T.StructType(
        [*[blocked.schema[k] for k in [*keys, "_block"]], *[T.StructField(c, T.DoubleType()) for c in coeffs]]
    )
    maps = slim.sortWithinPartitions(*keys, "_block", "_rn").mapInArrow(_compose(names, keys), map_schema)
    # chain the block maps (one row per block), then shift: the start of a block is the end of the one before
    first = Window.partitionBy(*keys).orderBy("_block")
    maps = maps.withColumn("_n", F.row_number().over(first))
    for n in names:
        maps = maps.withColumn(f"_a_{n}", F.when((F.col("_n") == 1) & (F.col(f"_a_{n}") != 0), F.lit(None)).otherwise(F.col(f"_a_{n}")))
    chain_schema = T.StructType([f for f in maps.schema.fields if f.name not in coeffs] + [T.StructField(n, T.DoubleType()) for n in names])
    ends = maps.sortWithinPartitions(*keys, "_block").mapInArrow(_replay(names), chain_schema)
    starts = ends.select(*keys, (F.col("_block") + 1).alias("_block"), *[F.col(n).alias(f"_s_{n}") for n in names])
    begin = (F.col("_rn") - 1) % block_rows == 0
    joined = blocked.join(starts, [*keys, "_block"], "left")
    for n in names:
        a, b, s = F.col(f"_a_{n}"), F.col(f"_b_{n}"), F.col(f"_s_{n}")
        inherit = begin & (F.col("_block") > 0) & (a != 0)
        joined = joined.withColumns(
            {f"_b_{n}": F.when(inherit, a * s + b).otherwise(b), f"_a_{n}": F.when(inherit, F.when(s.isNotNull(), F.lit(0.0))).otherwise(a)}
        )
    joined = joined.drop(*[f"_s_{n}" for n in names])
    ordered = joined.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_rn")
    out = T.StructType([f for f in joined.schema.fields if f.name not in coeffs] + [T.StructField(n, T.DoubleType()) for n in names])
    return ordered.mapInArrow(_replay(names), out).drop("_rn", "_block")


def ordered_fold(
    df: DataFrame,
    start: Callable[[], object],
    step: Callable[[object, tuple], tuple[object, tuple]],
    inputs: Sequence[str],
    out: T.StructType,
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Fold each *bar* series in order with a small Python state machine; adds the ``out`` columns.

    For state that no affine map expresses (ratchets, reversals, accumulate-and-reset). Rows
    stream through in Arrow batches and only the state is kept, so memory does not grow with
    the series; the work of one series is sequential by definition, hence bar series only.
    """
    names, key_names = list(inputs), list(keys)
    out_names = [f.name for f in out.fields]
    out_types = [pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, start()
        for batch in batches:
            at = batch.schema.get_field_index
            ids = list(zip(*[batch.column(at(k)).to_pylist() for k in key_names]))
            rows = zip(*[batch.column(at(c)).to_pylist() for c in names])
            produced = []
            for key, row in zip(ids, rows):
                if key != group:
                    group, state = key, start()
                state, result = step(state, row)
                produced.append(result)
            columns = list(zip(*produced)) if produced else [[] for _ in out_names]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays += [pa.array(c, type=t) for c, t in zip(columns, out_types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *out_names])

    clustered = df.withColumn("_rn", F.row_number().over(series_window(keys, order)))
    schema = T.StructType([*clustered.schema.fields, *out.fields])
    return clustered.sortWithinPartitions(*keys, *order).mapInArrow(run, schema).drop("_rn")
