"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are put in a random order (a hash) that is cut into blocks. Whole passes over
the source and a first part of one more pass make up its target. The blocks of all sources are then
split among output shards by a binary tree: a node deals half of its blocks to the left at random,
so the numbers by source follow the multivariate hypergeometric law, and every shard gets its exact
number of blocks; the numbers at the leaves are the shards' quotas, which the source's blocks fill
in their permuted order. Inside a shard rows are ordered by a hash. DataFrame operations only.

A hot source costs nothing extra: sums by (source, block) are taken map-side, and only documents of
the one block where the pass ends are looked at one by one.

Defined results: null text has no words; null source is the last source; a source without words has
target 0 and its documents are taken 0 times; an empty table gives no rows; doc_id may repeat or be
null, rows are told apart by a row number of their own; columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import positions, stored, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix per 100 words of the input, and the most passes over a source.
PERCENT, MOST = 150, 2
#: Bits of the order key that number the blocks of a source's permuted order.
CUT_BITS = 14
#: How often a partial pass goes on among the documents that still fit, and how often the nearest in size is taken.
FITTING, NEAREST = 2, 2
#: Blocks to deal among shards: about so many in all, one a source and pass at least.
DEALT_BLOCKS = 4096
OUT_SHARDS = 16
SEED = 20_011


def source_targets(sizes: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target: shares by weight, capped, the excess reshared.

    The level (words per unit of weight) is found by repeated sums over the sources; only such sums
    reach the driver.
    """
    ranked = stored(
        positions(sizes, F.col("source").asc_nulls_last(), to="_rank")
        .withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS)).cast("int")).cast("double"))
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .drop("_rank")
    )
    level, capped = float("-inf"), -1
    while True:
        full = F.col("_cap") < F.col("weight") * F.lit(level)
        got = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(full.cast("long")).alias("capped"),
        ).first()
        if not got["total"] or got["capped"] == capped or not got["weight"]:
            break
        capped = got["capped"]
        level = (got["total"] * percent / 100 - got["given"]) / got["weight"]
    level = max(level, 0.0)
    return ranked.withColumn("target", F.least(F.col("_cap"), F.col("weight") * F.lit(level))).drop("_cap")


def _block() -> Column:
    """Block of a row in its source's permuted order: the high bits of its order key."""
    return F.call_function("shiftrightunsigned", F.col("_key"), F.lit(64 - CUT_BITS))


def _first_part(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(_row) of the rows that, in their source's permuted order, come before the running sum of sizes passes its ``budget`` (_s, _left).

    The place is found in sums by block; only rows of one block, 2**-14 of the source, are added up one by one.
    """
    inside = rows.join(budget, rows["source"].eqNullSafe(budget["_s"]))
    blocks = inside.groupBy("_s", _block().alias("_block")).agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
    running = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ran = blocks.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    # the last block that begins at or before the budget's end; blocks before it are taken whole
    begun = ran.filter(F.col("_before") <= F.col("_left")).groupBy("_s").agg(F.max("_block").alias("_cut"), F.max("_before").alias("_b"), F.first("_left").alias("_left"))
    cut = begun.select("_s", "_cut", (F.col("_left") - F.col("_b")).alias("_left"))
    marked = rows.join(cut, rows["source"].eqNullSafe(cut["_s"]))
    running = Window.partitionBy("_s").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.filter(_block() == F.col("_cut")).withColumn("_sum", F.sum("size").over(running)).filter(F.col("_sum") <= F.col("_left"))
    return marked.filter(_block() < F.col("_cut")).select("_row").union(edge.select("_row"))


def _taken(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with ``copies``: whole passes over the source, plus 1 for those of one more, partial pass.

    That pass takes documents in their order while they fit. One that doesn't fit is passed over, and
    the search goes on among those that fit in what is left (``FITTING`` times); at last the
    documents whose sizes come nearest to what is missing are taken (``NEAREST`` times).
    """
    quota = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
    ).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    marked = rows.join(quota, rows["source"].eqNullSafe(quota["source"])).drop(quota["source"]).withColumn("_in", F.lit(False))
    for turn in range(FITTING + NEAREST):
        if turn:
            marked = stored(marked)
        missing = marked.groupBy(F.col("source").alias("_s")).agg((F.first("_rest") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_left"))
        missing = stored(missing.filter(F.col("_left") > 0))
        free = marked.filter(~F.col("_in") & (F.col("size") > 0)).join(missing, marked["source"].eqNullSafe(missing["_s"]))
        if turn < FITTING:
            more = _first_part(free.filter(F.col("size") <= F.col("_left")).select("source", "size", "_key", "_row"), missing)
        else:
            off = F.abs(F.col("size") - F.col("_left"))
            more = free.filter(off < F.col("_left")).groupBy("_s").agg(F.min(F.struct(off, F.col("_key"), F.col("_row")))["_row"].alias("_row"))
        more = more.select(F.col("_row").alias("_more"))
        marked = marked.join(more, marked["_row"] == more["_more"], "left").withColumn("_in", F.col("_in") | F.col("_more").isNotNull()).drop("_more")
    return marked.withColumn("copies", F.col("_whole") + F.col("_in").cast("long"))


def splitting_tree(quotas: DataFrame, n_shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """(source, blocks) to (source, block, shard): a random split of all blocks into shards of equal counts."""
    units = quotas.select("source", F.explode(F.expr("sequence(1L, blocks)")).alias("_unit")).withColumn("_node", F.lit(0)).withColumn("_width", F.lit(n_shards))
    width, level = n_shards, 0
    while width > 1:
        node = Window.partitionBy("_node")
        drawn = (
            units.withColumn("_at", F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "_unit"), "source", "_unit")))
            .withColumn("_all", F.count("*").over(node))
            .withColumn("_lefts", F.ceil(F.col("_width") / 2).cast("int"))
            .withColumn("_go_left", (F.col("_width") == 1) | (F.col("_at") * F.col("_width") <= F.col("_all") * F.col("_lefts")))
        )
        # nodes are numbered by the first of the shards below them
        units = drawn.select(
            "source", "_unit",
            F.when(F.col("_go_left"), F.col("_node")).otherwise(F.col("_node") + F.col("_lefts")).alias("_node"),
            F.when(F.col("_go_left"), F.col("_lefts")).otherwise(F.col("_width") - F.col("_lefts")).alias("_width"),
        )
        width, level = -(-width // 2), level + 1
    # quotas at the leaves, filled by the source's blocks in their (already permuted) order
    leaves = units.groupBy("source", F.col("_node").alias("shard")).agg(F.count("*").alias("_n"))
    ends = leaves.withColumn("_end", F.sum("_n").over(Window.partitionBy("source").orderBy("shard")))
    return ends.select("source", "shard", F.explode(F.expr("sequence(_end - _n, _end - 1)")).alias("block"))


def mix(docs: DataFrame, n_shards: int = OUT_SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken and ``shards``, the shard of each copy taken.

    ``carry`` names the columns to keep (source among them), if not all.
    """
    own = ("size", "source_size", "target", "taken", "shards", "_row", "_key")
    kept = [c for c in carry or docs.columns if c not in own]
    body = F.coalesce(F.col("text"), F.lit(""))
    named = stored(docs.select(*kept, word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), body).alias("_key")).withColumn("_row", F.monotonically_increasing_id()))
    light = named.select("source", "size", "_key", "_row")
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes).drop("weight"))
    taken = stored(_taken(light, targets))
    # blocks of a source to deal: in proportion to its words, a power of two
    share = F.greatest(F.col("target") * DEALT_BLOCKS / F.greatest(F.col("_all"), F.lit(1.0)), F.lit(1.0))
    bits = targets.crossJoin(F.broadcast(targets.agg(F.sum("target").alias("_all")))).withColumn("_bits", F.floor(F.log2(share)).cast("int"))
    # as many blocks as its passes reach; documents taken beyond them, to top up, join a block of those
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    reached = F.greatest(F.ceil(passes * F.expr("shiftleft(1L, _bits)")), F.lit(1)).cast("long")
    quotas = stored(bits.select("source", "_bits", reached.alias("blocks")))
    leaf = stored(splitting_tree(quotas, n_shards, seed)).withColumnRenamed("source", "_src")
    numbered = taken.join(quotas.withColumnRenamed("source", "_b"), taken["source"].eqNullSafe(F.col("_b"))).drop("_b")
    slot = F.expr("if(_bits = 0, 0L, shiftrightunsigned(_key, 64 - _bits))")
    copies = numbered.select("_row", "source", "_key", "blocks", F.explode_outer(F.expr(f"if(copies > 0, transform(sequence(0L, copies - 1), p -> p * shiftleft(1L, _bits)), cast(array() as array<bigint>))")).alias("_pass"), slot.alias("_slot"))
    at = F.col("_pass") + F.col("_slot")
    copies = copies.select("_row", "source", F.when(F.col("_pass").isNull(), F.lit(None)).when(at < F.col("blocks"), at).otherwise(F.pmod("_key", "blocks")).alias("_at"))
    dealt = copies.join(leaf, copies["source"].eqNullSafe(leaf["_src"]) & (F.col("_at") == F.col("block")), "left")
    shards = dealt.groupBy("_row").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    figures = taken.select("_row", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).join(shards, "_row")
    return named.join(figures, "_row").select(*kept, "size", "source_size", "target", "taken", "shards", "_key")


def mixed(docs: DataFrame, n_shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns of ``docs``, dealt to shards and ordered at random inside each."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", "source")
    copies = mix(packed, n_shards, seed, carry=("_doc", "source")).select("_doc", F.posexplode("shards").alias("_copy", "_shard"), "_key")
    dealt = copies.repartition("_shard", F.pmod("_key", F.lit(64)))
    return dealt.sortWithinPartitions("_shard", F.xxhash64(F.lit(seed + 1), "_key", "_copy")).select("_doc.*")
