"""Symmetric linear systems over many symbols, in square tiles.

Symbols are dealt to blocks by hash; a tile holds the entries of two blocks. Tiles are eliminated block by block
(LDLᵀ without pivots): with D the diagonal tile of block k and A the tiles below it, every tile of the rest loses
A D⁻¹ Aᵀ, one small matrix product a tile. The right side is a row of tiles below the matrix and is carried along.
What a step makes is written and read again, so plans and their estimates stay short. No task ever holds more than three tiles; the driver
holds the sizes of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import cut_lineage, written

#: Symbols of a block, roughly.
TILE = 256
#: A block's column of tiles is broadcast up to this size, computed beforehand; else it is shuffled.
BROADCAST_BYTES = 64 << 20
_TILES = "i int, j int, x binary"


def _matrix(raw: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, columns)


def _each(df: DataFrame, schema: str, make: Callable[..., tuple]) -> DataFrame:
    """Rows made from rows, one at a time: tiles are large."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame([make(**dict(zip(names, row, strict=True)))], columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


def _tiled(cov: DataFrame, names: DataFrame, sizes: dict[int, int], ridge: float) -> DataFrame:
    """Lower tiles (i ≥ j) of the matrix, with ``ridge`` on its diagonal; what ``cov`` doesn't name is zero."""
    side = lambda end: names.select(F.col("symbol").alias(end), F.col("block").alias(f"b{end}"), F.col("place").alias(f"p{end}"))
    placed = cov.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("ba") < F.col("bb")
    entries = placed.select(
        F.when(swap, F.col("bb")).otherwise(F.col("ba")).alias("i"), F.when(swap, F.col("ba")).otherwise(F.col("bb")).alias("j"),
        F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("p"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("q"), F.col("cov").cast("double").alias("x"),
    )
    every = cov.sparkSession.range(len(sizes)).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("j"))
    none = F.lit(None)
    entries = entries.unionByName(every.select("i", "j", none.cast("int").alias("p"), none.cast("int").alias("q"), none.cast("double").alias("x")))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iat[0]), int(group["j"].iat[0])
        tile, known = np.zeros((sizes[i], sizes[j])), group[group["p"].notna() & group["x"].notna()]
        p, q, x = known["p"].to_numpy(np.int64), known["q"].to_numpy(np.int64), known["x"].to_numpy(np.float64)
        tile[p, q] = x
        if i == j:
            tile[q, p] = x
            tile[np.diag_indices(sizes[i])] += ridge
        return pd.DataFrame({"i": [i], "j": [j], "x": [tile.tobytes()]})

    return entries.groupBy("i", "j").applyInPandas(fill, _TILES)


def dealt(vector: DataFrame, blocks: int) -> tuple[DataFrame, dict[int, int]]:
    """The symbols of ``symbol, v`` with their block and place in it (by name), and the blocks' sizes."""
    named = vector.select("symbol", F.col("v").cast("double").alias("v"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"))
    names = cut_lineage(named.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("symbol")) - 1))
    return names, {b: 0 for b in range(blocks)} | {r["block"]: r["count"] for r in names.groupBy("block").count().collect()}


def solve(cov: DataFrame, vector: DataFrame, ridge: float = 1e-8, tile: int = TILE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """w = (Σ + ridge·I)⁻¹ v over the symbols of ``vector`` (``symbol, v``), with Σ from ``a, b, cov`` (a ≤ b)."""
    names, sizes = dealt(vector, max(1, ceil(vector.count() / tile)))
    return eliminate(_tiled(cov, names, sizes, ridge), names, sizes, broadcast_bytes)


def product(matrix: DataFrame, names: DataFrame, sizes: dict[int, int], w: DataFrame) -> DataFrame:
    """``symbol, y`` with y = M·w for the lower tiles of a symmetric M and ``symbol, w``: a part a tile is shuffled."""
    placed = names.select("symbol", "block", "place").join(w, "symbol")

    def side(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(group["block"].iat[0])], "w": [group.sort_values("place")["w"].to_numpy(np.float64).tobytes()]})

    vectors = cut_lineage(placed.groupBy("block").applyInPandas(side, "block int, w binary"))
    ends = matrix.join(F.broadcast(vectors.select(F.col("block").alias("i"), F.col("w").alias("wi"))), "i")  # a row per block
    ends = ends.join(F.broadcast(vectors.select(F.col("block").alias("j"), F.col("w").alias("wj"))), "j")

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, j, x, wi, wj in zip(pdf["i"], pdf["j"], pdf["x"], pdf["wi"], pdf["wj"], strict=True):
                m = _matrix(x, sizes[i], sizes[j])
                yield pd.DataFrame({"block": np.int32(i), "place": np.arange(sizes[i], dtype=np.int32), "y": m @ np.frombuffer(wj, np.float64)})
                if i != j:
                    yield pd.DataFrame({"block": np.int32(j), "place": np.arange(sizes[j], dtype=np.int32), "y": m.T @ np.frombuffer(wi, np.float64)})

    parts = ends.select("i", "j", "x", "wi", "wj").mapInPandas(times, "block int, place int, y double")
    return parts.groupBy("block", "place").agg(F.sum("y").alias("y")).join(names, ["block", "place"]).select("symbol", "y")


def eliminate(matrix: DataFrame, names: DataFrame, sizes: dict[int, int], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """w = M⁻¹ v for the lower tiles (i ≥ j) of M and the dealt symbols with their ``v``."""
    blocks = len(sizes)
    last = blocks  # the row of tiles that holds the right side
    sizes = sizes | {last: 1}

    def side(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [last], "j": [int(group["block"].iat[0])], "x": [group.sort_values("place")["v"].to_numpy(np.float64).tobytes()]})

    rest = written(matrix.unionByName(names.groupBy("block").applyInPandas(side, _TILES)))
    used = [b for b in range(blocks) if sizes[b]]
    small = sum(sizes.values()) * max(sizes.values()) * 16 <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    columns: dict[int, DataFrame] = {}

    for k in used:
        diagonal = F.broadcast(rest.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("x").alias("d")))  # one tile

        def divided(i: int, x: bytes, d: bytes, k: int = k) -> tuple:
            a = _matrix(x, sizes[i], sizes[k])
            return i, x, np.linalg.solve(_matrix(d, sizes[k], sizes[k]).T, a.T).T.tobytes()

        below = rest.where((F.col("j") == k) & (F.col("i") > k)).select("i", "x").crossJoin(diagonal)
        columns[k] = written(_each(below, "i int, x binary, w binary", divided))

        def lowered(i: int, j: int, x: bytes, w: bytes, a: bytes, k: int = k) -> tuple:
            return i, j, (_matrix(x, sizes[i], sizes[j]) - _matrix(w, sizes[i], sizes[k]) @ _matrix(a, sizes[j], sizes[k]).T).tobytes()

        left = hint(columns[k].select("i", "w"))
        right = hint(columns[k].where(F.col("i") != last).select(F.col("i").alias("j"), F.col("x").alias("a")))
        if k != used[-1]:
            rest = written(_each(rest.where((F.col("j") > k)).join(left, "i").join(right, "j").select("i", "j", "x", "w", "a"), _TILES, lowered))

    # backwards: w_k = D⁻¹v_k − Σ W_ikᵀ w_i over the blocks below
    found: DataFrame | None = None
    for k in reversed(used):

        def back(i: int, w: bytes, y: bytes | None, k: int = k) -> tuple:
            tile_ = _matrix(w, sizes[i], sizes[k])
            return k, (tile_[0] if i == last else -tile_.T @ np.frombuffer(y, np.float64)).tobytes()

        def added(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": [int(group["i"].iat[0])], "y": [sum(np.frombuffer(y, np.float64) for y in group["y"]).tobytes()]})

        known = columns[k].select("i", "w")
        known = known.join(found, "i", "left") if found is not None else known.withColumn("y", F.lit(None).cast("binary"))
        made = written(_each(known.where((F.col("i") == last) | F.col("y").isNotNull()), "i int, y binary", back).groupBy("i").applyInPandas(added, "i int, y binary"))
        found = made if found is None else found.unionByName(made)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, y in zip(pdf["i"], pdf["y"], strict=True):
                values = np.frombuffer(y, np.float64)
                yield pd.DataFrame({"block": np.full(len(values), i, np.int32), "place": np.arange(len(values), dtype=np.int32), "w": values})

    if found is None:
        return names.select("symbol", F.col("v").alias("w"))
    return found.mapInPandas(spread, "block int, place int, w double").join(names, ["block", "place"]).select("symbol", "w")
