"""Benchmark decontamination by greedy string tiling.

A document is held against a benchmark item with which it shares seeds (runs of five words). The
longest runs that both have are marked again and again, longest first, each word at most once; the
share of the item's words that ends up in tiles is its coverage. Tiles may come in any order, so a
passage whose sentences were moved around is caught. Words are lower-case runs of letters and digits.

The benchmark's seeds and texts are sent to all tasks only while they are small: at most
``BROADCAST_WORDS`` words, counted first. Beyond that, seeds of documents and items are joined by
hash, and texts are joined to the pairs that share enough seeds.

Defined results: null text has no words; items of under five words can't be tiled and match nothing;
a document that repeats is reported as often as it is there; item_id may repeat or be null, each row
of the benchmark is an item; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import stored
from marketspark.llm.tokens import Rolling, hashes, plain_words, slices

#: Words of a seed, which is also the shortest tile, and the least coverage that counts as a leak.
SEED_WORDS, COVERAGE = 5, 0.6
#: Most words of a benchmark that is sent to all tasks (40 bytes a word there: 80 MB).
BROADCAST_WORDS = 2_000_000


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word hashes: (place in item, place in document, length), longest first."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    roll_item, roll_doc = Rolling(item), Rolling(doc)
    found: list[tuple[int, int, int]] = []

    def unmarked(free: np.ndarray, width: int) -> np.ndarray:
        taken = np.concatenate(([0], np.cumsum(~free)))
        return taken[width:] == taken[: len(taken) - width]

    def meeting(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of free windows of the item that the document has too, and the document's places."""
        if width > min(len(item), len(doc)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine, other = roll_item.windows(width), roll_doc.windows(width)
        at_item, at_doc = np.nonzero(unmarked(free_item, width))[0], np.nonzero(unmarked(free_doc, width))[0]
        at_doc = at_doc[np.isin(other[at_doc], mine[at_item])]
        return at_item[np.isin(mine[at_item], other[at_doc])], at_doc

    longest = min(len(item), len(doc))
    while longest >= shortest:
        low, high = shortest - 1, longest  # the longest width at which anything still meets
        while low < high:
            width = (low + high + 1) // 2
            low, high = (width, high) if len(meeting(width)[0]) else (low, width - 1)
        if low < shortest:
            break
        at_item, at_doc = meeting(low)
        by_hash: dict[int, list[int]] = {}
        for at, key in zip(at_doc.tolist(), roll_doc.windows(low)[at_doc].tolist(), strict=True):
            by_hash.setdefault(key, []).append(at)
        for i, key in zip(at_item.tolist(), roll_item.windows(low)[at_item].tolist(), strict=True):
            for d in by_hash.get(key, ()):
                if free_item[i : i + low].all() and free_doc[d : d + low].all() and np.array_equal(item[i : i + low], doc[d : d + low]):
                    free_item[i : i + low], free_doc[d : d + low] = False, False
                    found.append((i, d, low))
                    break
        longest = low
    return found


def _words(texts: pa.Array) -> list[np.ndarray]:
    words, ends = plain_words(texts)
    values = hashes(words)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Items:
    """Benchmark items with an index of their seeds."""

    def __init__(self, ids: list, sequences: list[np.ndarray]):
        whole = [(i, w) for i, w in zip(ids, sequences, strict=True) if len(w) >= SEED_WORDS]
        self.ids, self.words = [i for i, _ in whole], [w for _, w in whole]
        seeds = [Rolling(w).windows(SEED_WORDS) for w in self.words]
        number = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        joined = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.seeds, self.number, self.place = joined[order], number[order], place[order]

    def shared(self, doc_seeds: np.ndarray, least: float) -> Iterator[int]:
        """Items of which the words in shared seeds, an upper bound of any tiling, reach the coverage."""
        found = np.unique(doc_seeds)
        low, high = np.searchsorted(self.seeds, found), np.searchsorted(self.seeds, found, side="right")
        hits = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a] or [np.zeros(0, np.int64)])
        for item in np.unique(self.number[hits]).tolist():
            covered = np.unique(self.place[hits[self.number[hits] == item]][:, None] + np.arange(SEED_WORDS))
            if len(covered) >= least * len(self.words[item]):
                yield item


_SCHEMA = "text_hash long, n_tiles int, matched_words int, item_words int, coverage double"
_NAMES = ["doc_id", "item_id", "text_hash", "n_tiles", "matched_words", "item_words", "coverage"]


def _verdict(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, float]:
    found = tiles(item, doc)
    matched = sum(n for _, _, n in found)
    return len(found), matched, len(item), matched / len(item)


def _by_broadcast(docs: DataFrame, ids: list, sequences: list[np.ndarray], types: tuple[str, str], least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Items(ids, sequences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, 2):
                words, ends = plain_words(part.column(2))
                values = hashes(words)
                seeds = Rolling(values).windows(SEED_WORDS)
                known = np.concatenate(([0], np.cumsum(np.isin(seeds, items.seeds))))
                for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    last = b - SEED_WORDS + 1  # seeds that don't reach into the next text
                    if last > a and known[last] > known[a]:
                        for item in items.shared(seeds[a:last], least):
                            said = _verdict(items.words[item], values[a:b])
                            if said[-1] >= least:
                                out.append((part.column(0)[row].as_py(), items.ids[item], part.column(1)[row].as_py(), *said))
            columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
            kinds = [batch.schema.field(0).type, item_type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types[1]]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {types[0]}, item_id {types[1]}, {_SCHEMA}")


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, seed, place) of every seed; the place of a seed's first occurrence in its text."""
    for batch in batches:
        for part in slices(batch, 1):
            for row, words in enumerate(_words(part.column(1))):
                seeds, place = np.unique(Rolling(words).windows(SEED_WORDS), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seeds), part.column(0)[row].as_py())), pa.array(seeds.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(np.full(len(seeds), len(words), np.int32))],
                    ["row", "seed", "place", "n_words"],
                )


def _by_join(docs: DataFrame, benchmark: DataFrame, types: tuple[str, str], least: float) -> DataFrame:
    rows = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("row", F.monotonically_increasing_id()))
    items = stored(benchmark.select("item_id", F.col("text").alias("item_text")).withColumn("item", F.monotonically_increasing_id()))
    schema = "row long, seed long, place int, n_words int"
    doc_seeds = rows.select("row", "text").mapInArrow(_seed_rows, schema)
    item_seeds = items.select("item", "item_text").mapInArrow(_all_seed_rows, schema)
    met = doc_seeds.select("row", "seed").join(item_seeds.withColumnRenamed("row", "item"), "seed")
    # an item has few seeds: the places of one item are a bounded list
    pairs = met.groupBy("row", "item").agg(F.collect_set("place").alias("places"), F.first("n_words").alias("n"))
    reach = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (SEED_WORDS - 1))))))
    likely = pairs.filter(reach >= F.col("n") * least).select("row", "item")
    texts = likely.join(rows, "row").join(items, "item").select("doc_id", "item_id", "text_hash", "text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                said = [_verdict(i, d) for i, d in zip(_words(part.column(4)), _words(part.column(3)), strict=True)]
                figures = [pa.array(c, k) for c, k in zip(zip(*said, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *figures], _NAMES)

    return texts.mapInArrow(run, f"doc_id {types[0]}, item_id {types[1]}, {_SCHEMA}").filter(F.col("coverage") >= least)


def _all_seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_seed_rows``, with every occurrence."""
    for batch in batches:
        for part in slices(batch, 1):
            for row, words in enumerate(_words(part.column(1))):
                seeds = Rolling(words).windows(SEED_WORDS)
                n = len(seeds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.column(0)[row].as_py())), pa.array(seeds.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(words), np.int32))],
                    ["row", "seed", "place", "n_words"],
                )


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, text_hash, n_tiles, matched_words, item_words, coverage) of each pair with at least that coverage."""
    types = (dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"])
    # an upper bound of the words: letters and digits can't make more words than half the bytes, plus one
    bound = benchmark.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    if bound > most_words * 4:
        return _by_join(docs, benchmark, types, least)
    items = benchmark.select("item_id", "text").toArrow()
    sequences = _words(items.column("text").combine_chunks())
    if sum(map(len, sequences)) > most_words:
        return _by_join(docs, benchmark, types, least)
    return _by_broadcast(docs, items.column("item_id").to_pylist(), sequences, types, least)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that cover no benchmark item."""
    bad = contaminated(docs, benchmark, least).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    return own.join(bad, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti").select("_doc.*")
