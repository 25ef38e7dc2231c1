"""Approximate nearest neighbours: a graph made by NN-descent, searched greedily.

Build: each vector's list of neighbours starts from random blocks (exact inside a block) and gets
better by joins: the neighbours of a vector, both ways, are brought together with their vectors,
compared with each other, and each learns of those nearer than its farthest so far. Pairs that met
before aren't compared again. Rounds end when few lists change.

Search: each query starts at its own list, looks up the lists of the nearest vectors it hasn't
looked at, and keeps the ``BEAM`` nearest of all it has seen, until it has looked at all of them.
Both compare by distance of unit vectors less their common mean, kept in single precision (so that vectors that
differ little from all others, or inside a cluster, are still told apart) and multiplied in double; what is
found is scored again on the originals in double precision. Neither rounds nor steps have a bound.

Equal vectors are one node that lists its smallest ids, so copies cost nothing; lists of those that
name a node are cut to a sample before the shuffle. A query's state is one row of bounded size:
nodes seen and the beam. The graph is the index: every vector is in it.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length
from most, and rows without id, take no part; ties go to the smaller id; rows that repeat an id are
candidates of their own, but never of a query with that id; an empty table gives no rows; only
vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored

#: Neighbours of a list, and of those that name a node, in the build; the latter in the search.
LIST, NAMED_BY, SEARCH_NAMED_BY = 32, 20, 40
#: Vectors of a starting block, and how many such blocks each vector is in.
BLOCK, STARTS = 1024, 3
#: Rounds end below this share of changed entries.
CHANGED = 0.05
#: Nodes that a query keeps, of which so many are scored exactly; results of a query.
BEAM, EXACT, NEAREST = 128, 32, 5
#: Below any nearness (minus the squared distance of unit vectors).
FARTHEST = -9.0
QUERY_EVERY = 50


def nodes(vectors: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """(node, vec, code, ids): distinct vectors with their smallest ids; the code is the unit vector less the mean of all."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.size("vec") == (common["length"] if common else 0))
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("at") <= keep)
    classes = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    whole = stored(classes)
    sums = whole.mapInArrow(_summed, "n long, total array<double>").toPandas()  # one row a task
    mean = np.sum(np.stack(sums["total"].to_list()), axis=0) / sums["n"].sum() if len(sums) else np.zeros(0)
    return stored(whole.mapInArrow(_coded(mean), "vec array<double>, ids array<long>, code binary").withColumn("node", F.monotonically_increasing_id()))


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length. Rows are scaled by their largest component first: squares of any double stay in range."""
    flat = vectors.flatten().to_numpy().reshape(len(vectors), -1)
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            part = _units(batch.column(0)).sum(axis=0)
            n, total = n + batch.num_rows, part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])


def _coded(mean: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = (_units(batch.column(0)) - mean).astype(np.float32) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary())], ["vec", "ids", "code"])

    return run


def _decoded(codes: pa.Array) -> np.ndarray:
    n = len(codes)
    width = len(codes[0].as_py()) // 4 if n else 0
    return np.frombuffer(b"".join(codes.to_pylist()), np.float32).reshape(n, width).astype(np.float64)


def _nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus the squared distance of each row of ``x`` to each of ``y``; they are moved to their middle first, where little cancels."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    return 2 * (x @ y.T) - np.einsum("ij,ij->i", x, x)[:, None] - np.einsum("ij,ij->i", y, y)


def _pairs(v: list, u: list, s: list) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((v, np.int64), (u, np.int64), (s, np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], ["v", "u", "s"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of each member of a block (list of node, code) in the block."""
    for batch in batches:
        for row in range(len(batch.column(0))):
            members = batch.column(0)[row].values
            ids, own = members.field(0).to_numpy(), _decoded(members.field(1))
            near = _nearness(own, own).astype(np.float32)
            np.fill_diagonal(near, FARTHEST)
            most = min(LIST, len(ids) - 1)
            if most < 1:
                continue
            at = np.argpartition(-near, most - 1, axis=1)[:, :most]
            yield _pairs([np.repeat(ids, most)], [ids[at].ravel()], [np.take_along_axis(near, at, axis=1).ravel()])


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members around a node (list of node, fresh, farthest so far, code) with each other."""
    for batch in batches:
        lists = batch.column(0)
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        ids, fresh = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
        far, own = flat.field(2).to_numpy(), _decoded(flat.field(3))
        base = offsets[0]
        v, u, s = [], [], []
        for a, b in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True):
            near = _nearness(own[a:b], own[a:b]).astype(np.float32)
            new = fresh[a:b]
            at, to = np.nonzero((near > far[a:b, None]) & (new[:, None] | new) & (ids[a:b, None] != ids[a:b]))
            v.append(ids[a:b][at])
            u.append(ids[a:b][to])
            s.append(near[at, to])
        yield _pairs(v, u, s)


def _best(rows: DataFrame, most: int = LIST) -> DataFrame:
    """The nearest ``most`` of each v; a pair that is there twice counts as met before."""
    once = rows.repartition("v").groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return once.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).filter(F.col("at") <= most).drop("at")


def graph(points: DataFrame) -> DataFrame:
    """(v, u, s): the lists of neighbours of all nodes."""
    n = points.count()
    blocks = max(1, -(-n // BLOCK))
    members = [
        points.groupBy(F.lit(k).alias("start"), F.pmod(F.xxhash64("node", F.lit(k)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("node", "code")).alias("members"))
        for k in range(STARTS if blocks > 1 else 1)
    ]
    begun = members[0]
    for more in members[1:]:
        begun = begun.union(more)
    pairs = begun.select("members").repartition(max(blocks, 1)).mapInArrow(_in_blocks, "v long, u long, s float")
    now = stored(_best(pairs.withColumn("fresh", F.lit(True))))
    for turn in count() if blocks > 1 else ():
        far = now.groupBy("v").agg(F.min("s").alias("far"), F.count("*").alias("n")).select("v", F.when(F.col("n") < LIST, F.lit(FARTHEST)).otherwise(F.col("far")).cast("float").alias("far"))
        lookup = points.select(F.col("node").alias("u"), "code").join(far.withColumnRenamed("v", "u"), "u")
        sample = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(turn)))
        named = now.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh").withColumn("at", F.row_number().over(sample)).filter(F.col("at") <= NAMED_BY).drop("at")
        around = now.select("v", "u", "fresh").union(named).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        met = around.join(lookup, "u").groupBy("v").agg(F.collect_list(F.struct("u", "fresh", "far", "code")).alias("members"))
        found = met.select("members").mapInArrow(_local_join, "v long, u long, s float").withColumn("fresh", F.lit(True))
        now = stored(_best(now.withColumn("fresh", F.lit(False)).union(found)))
        if now.filter("fresh").count() < CHANGED * n * LIST:
            break
    return now.select("v", "u", "s")


_STATE = "q long, code binary, beam array<long>, near array<float>, open array<boolean>, seen array<long>"


def _looked(beam: int) -> Callable:
    """Takes new nodes (list of node, code) into the state of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("q", "code", "beam", "near", "open", "seen")}
            for row in batch.to_pylist():
                new = row["new"] or []
                ids, near = np.array(row["beam"], np.int64), np.array(row["near"], np.float32)
                if new:
                    own = _decoded(pa.array([row["code"], *(x["code"] for x in new)], pa.binary()))
                    ids = np.concatenate((ids, np.array([x["node"] for x in new], np.int64)))
                    near = np.concatenate((near, -((own[1:] - own[0]) ** 2).sum(axis=1).astype(np.float32)))
                    order = np.lexsort((ids, -near))[:beam]
                    is_new = order >= len(row["beam"])
                    ids, near = ids[order], near[order]
                else:
                    is_new = np.zeros(len(ids), bool)
                for k, x in (("q", row["q"]), ("code", row["code"]), ("beam", ids.tolist()), ("near", near.tolist()), ("open", is_new.tolist()), ("seen", row["seen"] + [x["node"] for x in new])):
                    out[k].append(x)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds, strict=True)], list(out))

    return run


def searched(points: DataFrame, edges: DataFrame, starts: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, u): for each node q of ``starts`` the nodes of its beam, the nearest ``EXACT`` of them; q itself is one."""
    both = edges.select("v", "u", "s").union(
        edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "s")
        .withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u")))
        .filter(F.col("at") <= SEARCH_NAMED_BY)
        .drop("at")
    )
    lists = stored(both.groupBy("v").agg(F.collect_set("u").alias("us")))
    codes = points.select("node", "code")
    own = codes.join(starts.select(F.col("node")).distinct(), "node")
    state = stored(
        own.select(
            F.col("node").alias("q"), "code", F.array("node").alias("beam"), F.array(F.lit(0.0).cast("float")).alias("near"), F.array(F.lit(True)).alias("open"), F.array("node").alias("seen")
        )
    )
    while True:
        frontier = state.select("q", F.explode(F.arrays_zip("beam", "open")).alias("x")).filter("x.open").select("q", F.col("x.beam").alias("v"))
        reached = frontier.join(lists, "v").select("q", F.explode("us").alias("node")).distinct().groupBy("q").agg(F.collect_list("node").alias("nodes"))
        fresh = reached.join(state.select("q", "seen"), "q").select("q", F.explode(F.array_except("nodes", "seen")).alias("node"))
        new = fresh.join(codes, "node").groupBy("q").agg(F.collect_list(F.struct("node", "code")).alias("new"))
        state = stored(state.join(new, "q", "left").mapInArrow(_looked(beam), _STATE))
        if state.filter(F.exists("open", lambda x: x)).isEmpty():
            break
    return state.select("q", F.explode(F.slice("beam", 1, EXACT)).alias("u"))


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, most: int = NEAREST, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``most`` nearest rows found for each row whose id ``every`` divides."""
    points = nodes(vectors, most + 1)
    edges = stored(graph(points))
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
    queries = stored(asked.join(points.select("vec", "node"), "vec").select("query_id", "node"))
    found = searched(points, edges, queries, beam)
    left, right = points.select(F.col("node").alias("q"), F.col("vec").alias("a")), points.select(F.col("node").alias("u"), F.col("vec").alias("b"), "ids")

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda acc, t: acc + t)

    def cosine(x: str, y: str):
        return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))

    def scaled(x: str):
        return F.transform(x, lambda c: c / F.array_max(F.transform(x, F.abs)))

    met = found.join(left, "q").join(right, "u").select("q", "ids", "a", "b")
    # squares of very small or large components leave the range of doubles: those vectors are scaled first
    plain = (dot("a", "a") > 1e-200) & (dot("a", "a") < 1e200) & (dot("b", "b") > 1e-200) & (dot("b", "b") < 1e200)
    wide = met.withColumns({"_plain": plain, "_a": F.when(~plain, scaled("a")), "_b": F.when(~plain, scaled("b"))})
    scored = wide.select("q", "ids", F.when(F.col("_plain"), cosine("a", "b")).otherwise(cosine("_a", "_b")).alias("score"))
    # a query's row drops its own id later, so each node keeps one more than asked for
    listed = scored.select("q", F.explode("ids").alias("vec_id"), "score")
    listed = listed.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= most + 1).drop("at")
    answers = queries.join(listed, queries["node"] == listed["q"]).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
