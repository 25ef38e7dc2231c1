"""Exact order statistics and ranks of groups of any size.

Spark's exact ``percentile`` keeps a whole group's values in one buffer. Here groups are counted first. A group
of up to ``RANGE_ROWS`` rows is ordered in one place, with one exchange for all its values; a larger one is
split in value ranges (edges from a small quantile sketch, about one for each ``RANGE_ROWS`` rows), the
ranges are counted, and rows are ordered inside their range, each range in its own task. A value that
fills whole ranges is a range of its own and needs no order; its rows are spread. Sketch errors
move the edges, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import cut_lineage, written

#: Rows of a range, roughly, and the most ranges that a group is cut in.
RANGE_ROWS, RANGES = 500_000, 1024


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _cut(df: DataFrame, keys: Sequence[str], values: Sequence[str], range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the range of each value (``_r0`` …), and per group the ``n`` and, for each value, its ranges.

    ``_m0`` … map a range to the rows in it and below it. Ranges are even; the odd number after a range is
    that of a value which is an edge twice, and so fills a range.
    """
    cuts = [i / RANGES for i in range(1, RANGES)]
    wanted = F.greatest(F.lit(1), F.least(F.lit(RANGES), F.ceil(F.col("n") / range_rows)))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES) / wanted))
    edges = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(v, cuts, 10 * RANGES).alias(f"_e{i}") for i, v in enumerate(values)])
    edges = edges.withColumns({f"_e{i}": F.filter(f"_e{i}", lambda _, at: (at + 1) % step == 0) for i in range(len(values))})
    # only groups of over range_rows rows are cut: there is a row, and an edge, for each range_rows rows at most
    joined = df.join(F.broadcast(edges), list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    tagged = joined.withColumns(
        {f"_r{i}": F.size(F.filter(f"_e{i}", lambda e: e < F.col(v))) * 2 + (F.size(F.filter(f"_e{i}", lambda e: e == F.col(v))) > 1).cast("int") for i, v in enumerate(values)}
    ).drop(*[f"_e{i}" for i in range(len(values))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_r{i}").alias("_r")) for i in range(len(values))]))
    sizes = tagged.select(*keys, "n", each.alias("_x")).groupBy(*keys, "n", "_x._c", "_x._r").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*keys, "_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("below", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("_c") == i, F.struct("_r", F.struct("rows", "below"))))).alias(f"_m{i}") for i in range(len(values))]
    return tagged, sizes.groupBy(*keys, "n").agg(*maps)


def _by_size(rows: DataFrame, keys: Sequence[str], range_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups of up to ``range_rows`` rows, and those of larger ones (None if there are none)."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > range_rows)
    large = cut_lineage(counted.drop("_size") if keys else counted)
    if large.isEmpty():
        return rows, None
    if not keys:
        return rows.limit(0), rows
    same = [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)]
    named = F.broadcast(large.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)]))  # one for each range_rows rows at most
    return rows.join(named, same, "left_anti"), rows.join(named, same, "left_semi")


def _spread(row: Sequence[str], r: str) -> Column:
    """Rows of a value that fills its range go to several tasks; there is no order among them."""
    return F.when(F.col(r) % 2 == 1, F.pmod(F.xxhash64(*row), F.lit(256))).otherwise(F.lit(0))


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each group the value at each 1-based rank; the ranks may use ``n``, the group size."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value))
    short, long = _by_size(rows, keys, range_rows)
    if keys or long is None:
        sorted_ = short.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("_v")).where("n > 0")
        out = sorted_.select(*keys, *[F.try_element_at("_v", r.cast("int")).alias(o) for o, r in ranks.items()], "n")
        return out if long is None else out.unionByName(_value_at_rank(long, keys, value, ranks, range_rows))
    return _value_at_rank(long, keys, value, ranks, range_rows)


def _value_at_rank(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], range_rows: int) -> DataFrame:
    tagged, groups = _cut(rows, keys, [value], range_rows)
    # the ranges that hold a wanted rank: a few rows a group
    ranges = groups.select(*keys, "n", F.explode("_m0").alias("_r0", "_m"))
    held = ranges.where(_any([(r > F.col("_m.below")) & (r <= F.col("_m.below") + F.col("_m.rows")) for r in ranks.values()]))
    held = held.select(*keys, "_r0", F.col("_m.below").alias("_below"), F.col("_m.rows").alias("_rows"))
    wanted = tagged.join(held, [*keys, "_r0"])
    # rows of a value that fills its range are alike here: one of them says all
    wanted = wanted.where("_r0 % 2 = 0").unionByName(wanted.where("_r0 % 2 = 1").dropDuplicates([*keys, "_r0"])).repartition(*keys, "_r0")
    placed = wanted.withColumn("_at", F.col("_below") + F.row_number().over(Window.partitionBy(*keys, "_r0").orderBy(value)))
    full = F.col("_r0") % 2 == 1
    hit = {o: F.when(full, (r > F.col("_below")) & (r <= F.col("_below") + F.col("_rows"))).otherwise(r == F.col("_at")) for o, r in ranks.items()}
    return placed.groupBy(*keys).agg(*[F.max(F.when(h, F.col(value))).alias(o) for o, h in hit.items()], F.max("n").alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add average-tie ranks within each group: ``{value column: rank column}``; rows without a value are left out.

    Rows are carried through: one exchange for all columns of short groups, one for each ranked column of long ones.
    """
    rows = df.where(" and ".join(f"{v} is not null" for v in values))
    short, long = _by_size(rows, keys, range_rows)
    out = short
    for v, rank in values.items():
        ordered = Window.partitionBy(*keys).orderBy(v)
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        out = out.withColumn(rank, F.rank().over(ordered) + (ties - 1) / 2)
    return out if long is None else out.unionByName(_average_ranks(long, keys, values, range_rows))


def _average_ranks(rows: DataFrame, keys: Sequence[str], values: dict[str, str], range_rows: int) -> DataFrame:
    names, columns = list(values), rows.columns
    tagged, groups = _cut(rows, keys, names, range_rows)
    small = F.broadcast(groups.drop("n"))
    out = tagged.drop("n").join(small, list(keys)) if keys else tagged.drop("n").crossJoin(small)
    # looked up before any exchange: the maps grow with the group and must not travel with its rows
    places = {i: F.element_at(f"_m{i}", F.col(f"_r{i}")) for i in range(len(names))}
    out = out.withColumns({f"_below{i}": p["below"] for i, p in places.items()} | {f"_rows{i}": p["rows"] for i, p in places.items()}).drop(*[f"_m{i}" for i in places])
    for i, v in enumerate(names):
        r = f"_r{i}"
        out = out.withColumn("_s", _spread(columns, r))
        # said outright, as the join before has the rows of a group together
        out = out.repartition(*keys, r, "_s")
        inside = Window.partitionBy(*keys, r, "_s")
        ordered = F.rank().over(inside.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, r, "_s", v)) - 1) / 2
        out = out.withColumn(values[v], F.col(f"_below{i}") + F.when(F.col(r) % 2 == 1, (F.col(f"_rows{i}") + 1) / 2).otherwise(ordered)).drop(r, f"_below{i}", f"_rows{i}")
    return out.select(*columns, *values.values())


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbouring order statistics."""
    ranks = {}
    for out, q in wanted.items():
        position = (F.col("n") - 1) * F.lit(q)
        ranks[f"_lo_{out}"] = F.floor(position) + 1
        ranks[f"_hi_{out}"] = F.ceil(position) + 1
    picked = value_at_rank(df, keys, value, ranks)
    cols = {}
    for out, q in wanted.items():
        position = (F.col("n") - 1) * F.lit(q)
        cols[out] = F.col(f"_lo_{out}") + (position - F.floor(position)) * (F.col(f"_hi_{out}") - F.col(f"_lo_{out}"))
    return picked.withColumns(cols).drop(*ranks)


# ── correlations of ranks ──────────────────────────────────────────────────────────────────


def _ranges(df: DataFrame, value: str, rows: int, range_rows: int) -> DataFrame:
    """One range of ``value`` to a task; a value that fills ranges is spread over them."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))
    return df.withColumn("_s", spread).repartitionByRange(max(1, -(-rows // range_rows)), value, "_s").drop("_s")


def _inner_ranks(v: np.ndarray, members: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the values of a range: which are its first (1) and last (2), as these may go on in the next ranges, and
    among the others (0) twice the average rank in each set of members."""
    order = np.argsort(v, kind="stable")
    x = v[order]
    new = np.ones(len(v), bool)
    new[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    start, at = np.flatnonzero(new), np.cumsum(new) - 1
    end, kinds = np.append(start[1:], len(v)), np.zeros(len(start), np.int32)
    kinds[-1:], kinds[:1] = 2, 1
    kind, out = np.empty(len(v), np.int32), []
    kind[order] = kinds[at]
    for member in members:
        inner = np.concatenate([[0], np.cumsum(member[order] & (kinds[at] == 0))])
        twice = np.empty(len(v), np.int64)
        twice[order] = np.where(kinds == 0, inner[start] + inner[end] + 1, 0)[at]
        out.append(twice)
    return kind, out


def _bases(runs: dict[tuple[int, int], tuple[float, list[int]]]) -> tuple[dict[tuple[int, int], list[int]], list[int]]:
    """What to add to the inner ranks of each (range, kind) for twice the rank less its mean, and the size of each set.

    ``runs``: the value (of kinds 1 and 2) and how many members of each set there are. Neighbours of one value are one run.
    """
    joined: list[tuple[list[tuple[int, int]], float | None]] = []
    for at in sorted(runs, key=lambda k: (k[0], (1, 0, 2).index(k[1]))):
        value = runs[at][0] if at[1] else None
        before = joined[-1][1] if joined else None
        if value is not None and before is not None and (value == before or (value != value and before != before)):
            joined[-1][0].append(at)
        else:
            joined.append(([at], value))
    sets = range(len(next(iter(runs.values()))[1])) if runs else range(0)
    sizes = [sum(counts[i] for _, counts in runs.values()) for i in sets]
    bases, below = {}, [0 for _ in sets]
    for keys, value in joined:
        have = [sum(runs[k][1][i] for k in keys) for i in sets]
        for k in keys:
            bases[k] = [2 * below[i] - sizes[i] - 1 + (0 if value is None else have[i] + 1) for i in sets]
        below = [b + h for b, h in zip(below, have, strict=True)]
    return bases, sizes


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact sum of products below 2⁶³."""
    p = a * b
    return (int((p >> 32).sum()) << 32) + int((p & 0xFFFFFFFF).sum())


def _ratio(xy: int, xx: int, yy: int) -> float | None:
    with localcontext(prec=60):
        return float(Decimal(xy) / (Decimal(xx) * Decimal(yy)).sqrt()) if xx and yy else None


def _in_one_range(rows: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> list[tuple[int, int, int, float | None]]:
    """``rank_correlations`` of few rows, in one task."""

    def centred(v: np.ndarray) -> np.ndarray:
        _, at, count = np.unique(v, return_inverse=True, return_counts=True)
        return (2 * np.cumsum(count) - count)[at] - len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, batches = [], list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        for i, x in enumerate(xs if table is not None else []):
            for j, y in enumerate(ys):
                both = np.asarray(table.column(x).is_valid()) & np.asarray(table.column(y).is_valid())
                if both.any():
                    a, b = (centred(np.asarray(table.column(c).fill_null(0.0))[both]) for c in (x, y))
                    found.append({"i": i, "j": j, "n": int(both.sum()), "ic": _ratio(_dot(a, b), _dot(a, a), _dot(b, b))})
        yield pa.RecordBatch.from_pylist(found, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("ic", pa.float64())]))

    return [tuple(r) for r in rows.coalesce(1).mapInArrow(run, "i int, j int, n long, ic double").collect()]


def rank_correlations(df: DataFrame, signals: Sequence[str], targets: Sequence[str], range_rows: int = RANGE_ROWS) -> list[tuple[str, str, int, float | None]]:
    """(signal, target, n, correlation of average ranks) over the rows that have both; None where a side is constant.

    Rows are written once; those of one range are ranked in one task. Of more, a pass for each signal sorts them by value range and ranks them among the rows of every
    target at once; a pass for each target ranks it among the rows of every signal and leaves sums only. A task holds one
    range; the first and last value of a range, which may go on in others, are placed from a few numbers a range. Sums
    of (twice the rank less its mean) are integers and exact, for up to 3 billion rows.
    """
    some = lambda names: _any([F.col(n).isNotNull() for n in names])
    plain = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(signals)], *[F.col(c).cast("double").alias(f"_y{j}") for j, c in enumerate(targets)])
    xs, ys = [f"_x{i}" for i in range(len(signals))], [f"_y{j}" for j in range(len(targets))]
    rows = written(plain.where(some(xs) & some(ys)))
    total = rows.count()
    if total <= range_rows:
        return [(signals[i], targets[j], n, ic) for i, j, n, ic in _in_one_range(rows, xs, ys)]
    for i, x in enumerate(xs):
        kept = [c for c in rows.columns if c != x]
        places = [f"_d{i}_{j}" for j in range(len(ys))]

        def place(batches: Iterator[pa.RecordBatch], x: str = x, kept: Sequence[str] = kept, places: Sequence[str] = places) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not sum(b.num_rows for b in batches):
                return
            table = pa.Table.from_batches(batches)
            column = table.column(x)
            known = np.asarray(column.is_valid())
            v = np.asarray(column.drop_null())
            has = [np.asarray(table.column(y).is_valid())[known] for y in ys]
            kind, ranks = _inner_ranks(v, has)
            all_kinds, value = np.zeros(table.num_rows, np.int32), np.zeros(table.num_rows)
            all_kinds[known], value[known] = kind, v
            out = {c: table.column(c) for c in kept} | {"_range": pa.array(np.full(table.num_rows, TaskContext.get().partitionId(), np.int32)), "_kind": pa.array(all_kinds), "_v": pa.array(value, mask=all_kinds == 0)}
            for name, member, rank in zip(places, has, ranks, strict=True):
                all_ranks, none = np.zeros(table.num_rows, np.int64), np.ones(table.num_rows, bool)
                all_ranks[known], none[known] = rank, ~member
                out[name] = pa.array(all_ranks, mask=none)
            yield from pa.table(out).to_batches(1 << 16)

        schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes if c in kept] + ["_range int", "_kind int", "_v double"] + [f"{p} long" for p in places])
        placed = written(_ranges(rows, x, total, range_rows).mapInArrow(place, schema))
        runs = placed.where(_any([F.col(p).isNotNull() for p in places])).groupBy("_range", "_kind").agg(F.max("_v").alias("v"), *[F.count(p).alias(p) for p in places])
        bases, _ = _bases({(r["_range"], r["_kind"]): (r["v"], [r[p] for p in places]) for r in runs.collect()})
        table = df.sparkSession.createDataFrame([(*k, b) for k, b in bases.items()] or [(-1, 0, [0] * len(places))], "_range int, _kind int, _b array<long>")
        joined = placed.join(F.broadcast(table), ["_range", "_kind"], "left")  # three rows a range
        rows = joined.select(*kept, *[(F.col(p) + F.col("_b")[j]).alias(p) for j, p in enumerate(places)])
    rows = written(rows)
    fields = ["n", "d", "dr", "r", "rr", "dd"]
    out = []
    for j, y in enumerate(ys):
        names = [f"_d{i}_{j}" for i in range(len(xs))]

        def sums(batches: Iterator[pa.RecordBatch], y: str = y, names: Sequence[str] = names) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not sum(b.num_rows for b in batches):
                return
            table = pa.Table.from_batches(batches)
            v = np.asarray(table.column(y))
            has = [np.asarray(table.column(n).is_valid()) for n in names]
            kind, ranks = _inner_ranks(v, has)
            found = []
            for k in (1, 0, 2):
                if not (kind == k).any():
                    continue
                for i, (name, member, rank) in enumerate(zip(names, has, ranks, strict=True)):
                    at = member & (kind == k)
                    d, r = np.asarray(table.column(name).fill_null(0))[at], rank[at]
                    made = (int(at.sum()), int(d.sum()), _dot(d, r), int(r.sum()), _dot(r, r), _dot(d, d))
                    found.append({"_range": TaskContext.get().partitionId(), "_kind": k, "v": float(v[kind == k][0]) if k else None, "i": i} | {f: str(m) for f, m in zip(fields, made, strict=True)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("_range", pa.int32()), ("_kind", pa.int32()), ("v", pa.float64()), ("i", pa.int32())] + [(f, pa.string()) for f in fields]))

        some_rows = rows.where(F.col(y).isNotNull() & some(names)).select(y, *names)
        found = _ranges(some_rows, y, total, range_rows).mapInArrow(sums, "_range int, _kind int, v double, i int, " + ", ".join(f"{f} string" for f in fields)).collect()
        runs = {}
        for r in found:
            runs.setdefault((r["_range"], r["_kind"]), (r["v"], [0] * len(xs)))[1][r["i"]] = int(r["n"])
        bases, sizes = _bases(runs)
        for i in range(len(xs)):
            xy = xx = yy = 0
            for r in found:
                if r["i"] == i:
                    b = bases[r["_range"], r["_kind"]][i]
                    n, d, dr, once, rr, dd = (int(r[f]) for f in fields)
                    xy, xx, yy = xy + dr + b * d, xx + dd, yy + rr + 2 * b * once + b * b * n
            if sizes and sizes[i]:
                out.append((signals[i], targets[j], sizes[i], _ratio(xy, xx, yy)))
    return out
