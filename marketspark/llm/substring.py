"""Substring dedup by recompression.

A text is a sequence of word hashes. Recompression names runs of one symbol, then, round after
round, pairs of neighbours (a pair is named where the left symbol falls in one half of all names and the
right one in the other). Names are hashes of what they stand for, so every task gives the same string
the same name, and equal passages have equal symbols inside, but for a few at both ends. For each
window it is known which symbols the window alone determines; of its runs of three such symbols at
the highest level that has three, the one with the smallest hash is its anchor. Equal windows have
equal anchors at equal places, so only anchors that occur twice can belong to repeats.

Rounds through the cluster:

1. An anchor occurrence serves a stretch of neighbouring windows. One row each goes to its anchor's
   partition: name, hash of the stretch's words, document, place. Names that occur once end here.
   Stretches that occur twice are repeats as they are (most of a repeat).
2. Where an anchor also occurs with stretches of its own (at the ends of repeats), the single
   windows of those are compared, by anchor and window hash (128 bits).
3. Words in repeated windows are removed.

A task first settles what repeats among the texts it has at hand and sends one witness for
it, so an anchor in a third of all documents sends a row a slice, not one a document.

Defined results: null and empty texts have no words and keep an empty text; documents shorter than
a window lose nothing; copies, repeated rows included, lose everything a window covers, as no copy is
spared; occurrences that overlap in one document count; an empty table gives no rows; doc_id may
repeat or be null; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import stored
from marketspark.llm.tokens import BASE, Rolling, hashes, mixed, raw_words, slices

#: Words of a window.
WINDOW = 35
#: Rounds of pair naming, and symbols of an anchor.
ROUNDS, ANCHOR = 5, 3
_ODD = np.uint64(BASE)
#: A place is packed with the number of windows from it on (6 bits) and the low bits of the text's word count.
_SPAN_BITS, _COUNT_BITS = 6, 20


class Level:
    """Symbols after a round, where they start, and for each window the symbols it determines: first .. last - 1."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, owners: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.names, self.starts, self.owners, self.first, self.last = names, starts, owners, first, last

    def _next(self, heads: np.ndarray, names: np.ndarray, first: np.ndarray, last: np.ndarray) -> Level:
        return Level(names, self.starts[heads], self.owners[heads], first.astype(np.int32), last.astype(np.int32))

    def runs(self) -> Level:
        """Names maximal runs of a symbol; a window can't tell where its first and last run end outside."""
        begins = np.ones(len(self.names), bool)
        begins[1:] = (self.names[1:] != self.names[:-1]) | (self.owners[1:] != self.owners[:-1])
        heads = np.nonzero(begins)[0]
        length = np.diff(np.append(heads, len(begins))).astype(np.uint64)
        names = np.where(length > 1, mixed(self.names[heads] * _ODD + length), self.names[heads])
        run = np.cumsum(begins, dtype=np.int32) - 1
        return self._next(heads, names, run[self.first] + 1, run[self.last - 1])

    def pairs(self, salt: int) -> Level:
        """Names pairs; a window's first symbol may be the end of a pair, its last one the beginning of one."""
        right = (mixed(self.names ^ np.uint64(salt * 0x9E3779B1)) >> np.uint64(40)).astype(np.uint8) & 1
        joins = np.zeros(len(right) + 1, bool)  # joins[i]: symbol i ends a pair
        joins[1:-1] = (right[:-1] == 0) & (right[1:] == 1) & (self.owners[1:] == self.owners[:-1])
        heads = np.nonzero(~joins[:-1])[0]
        both = joins[heads + 1]
        names = self.names[heads]
        after = self.names[np.minimum(heads + 1, len(right) - 1)]
        names = np.where(both, mixed(names * _ODD + mixed(after + np.uint64(salt))), names)
        # number of the symbol that begins at or before an old one, and one past the last
        place = np.append(np.cumsum(~joins[:-1], dtype=np.int32) - 1, np.int32(len(heads)))
        first = self.first + right[np.minimum(self.first, len(right) - 1)]
        last = self.last - (right[np.maximum(self.last - 1, 0)] == 0)
        return self._next(heads, names, place[np.minimum(first, len(right))], np.where(last > 0, place[np.maximum(last - 1, 0)] + 1, 0))


def anchors(values: np.ndarray, owners: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor occurrences of texts laid end to end: first window, number of windows, name, hash of the stretch's words."""
    begin = np.arange(max(len(values) - window + 1, 0), dtype=np.int32)
    begin = begin[owners[begin] == owners[begin + window - 1]]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    levels = [Level(values, np.arange(len(values), dtype=np.int32), owners, begin, begin + np.int32(window))]
    now = levels[0].runs()
    for k in range(ROUNDS):
        now = now.pairs(k + 1)
        levels.append(now)
    chosen, first, last = np.zeros(len(begin), np.int8), levels[0].first.copy(), levels[0].last.copy()
    for k, level in enumerate(levels[1:], 1):
        at = np.nonzero(level.last - level.first >= ANCHOR)[0]
        chosen[at], first[at], last[at] = k, level.first[at], level.last[at]
    # windows in a row that determine the same symbols have the same anchor
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (begin[1:] != begin[:-1] + 1)
    groups = np.nonzero(fresh)[0]
    place, names = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.uint64)
    for k, level in enumerate(levels):
        mine = np.nonzero(chosen[groups] == k)[0]
        if not len(mine):
            continue
        n = len(level.names) - ANCHOR + 1
        joined = level.names[:n]
        for step in range(1, ANCHOR):
            joined = mixed(joined * _ODD + level.names[step : n + step])
        rank = mixed(joined ^ np.uint64(0xA5A5A5A5A5A5))
        low = first[groups[mine]].astype(np.int64)
        many = last[groups[mine]] - ANCHOR + 1 - low
        best, least = low.copy(), rank[low]
        open_ = np.arange(len(mine))
        for step in range(1, int(many.max())):
            open_ = open_[many[open_] > step]
            seen = rank[low[open_] + step]
            better = seen < least[open_]
            best[open_[better]], least[open_[better]] = low[open_[better]] + step, seen[better]
        place[mine], names[mine] = level.starts[best], mixed(joined[best] + np.uint64(k))
    level_of, at = chosen[groups], begin[groups].astype(np.int64)
    width = np.diff(np.append(groups, len(begin)))
    fresh = np.ones(len(groups), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (level_of[1:] != level_of[:-1]) | (at[1:] != at[:-1] + width[:-1])
    heads = np.nonzero(fresh)[0]
    count = np.add.reduceat(width, heads)
    start, names = at[heads], names[heads]
    return start, count, names, Rolling(values).ranges(start, start + count - 1 + window)


def _settled(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows with two keys: how often both and how often the first occur, and which row is the first of each."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[1:] != b[:-1]

    def spread(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.nonzero(new)[0]
        sizes = np.diff(np.append(heads, len(new)))
        count, head = np.empty(len(new), np.int64), np.zeros(len(new), bool)
        count[order] = np.repeat(sizes, sizes)
        head[order[heads]] = True
        return count, head

    n_both, head_both = spread(new_b)
    n_first, _ = spread(new_a)
    return n_both, n_first, head_both, new_a


_ROW = "part long, name long, own long, ref long, place long, kind int, n int"
_NAMES = ["part", "name", "own", "ref", "place", "kind", "n"]
#: Kinds of rows: known repeat; stretch to compare window by window; to be counted; to be counted, compared anyway.
_SURE, _COMPARE, _COUNT, _WITNESS = 0, 1, 2, 3


def _rows(name: np.ndarray, own: np.ndarray, ref: np.ndarray, place: np.ndarray, compares: bool) -> Iterator[pa.RecordBatch]:
    """Rows for the occurrences of a slice: what repeats inside it is settled, the rest is to be counted."""
    if not len(name):
        return
    n_own, n_name, head, _ = _settled(name, own)
    sure, mixed_ = n_own > 1, (n_own == 1) & (n_name > 1) & compares
    # one row of those to compare tells other slices that there are some
    order = np.argsort(name, kind="stable")
    order = order[mixed_[order]]
    tells = np.zeros(len(name), bool)
    if len(order):
        tells[order[np.append(True, name[order][1:] != name[order][:-1])]] = True
    parts = [(sure, _SURE, 2), (mixed_, _COMPARE, 1), (sure & head, _COUNT, 2), (tells, _WITNESS, 1), (~sure & ~mixed_, _COUNT, 1)]
    for chosen, kind, n in parts:
        at = np.nonzero(chosen)[0]
        if len(at):
            # stretches meet at their anchor, single windows at themselves; rows that aren't counted are spread by document
            meet = name[at] if compares else mixed(name[at] * _ODD ^ own[at])
            part = meet if kind >= _COUNT else mixed(ref[at] + place[at].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (part, name[at], own[at], ref[at])] + [pa.array(place[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), n, np.int32))],
                _NAMES,
            )


def _packed(start: np.ndarray, many: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (start << (_SPAN_BITS + _COUNT_BITS)) | (many << _COUNT_BITS) | (words & ((1 << _COUNT_BITS) - 1))


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (_SPAN_BITS + _COUNT_BITS), (place >> _COUNT_BITS) & ((1 << _SPAN_BITS) - 1), place & ((1 << _COUNT_BITS) - 1)


def _occurrences(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, ends = raw_words(part.column(1))
                values = hashes(words)
                size = np.diff(ends)
                owners = np.repeat(np.arange(len(size), dtype=np.int32), size)
                start, many, name, own = anchors(values, owners, window)
                ref = part.column(0).to_numpy().view(np.uint64)
                of = owners[start] if len(start) else np.zeros(0, np.int32)
                yield from _rows(name, own, ref[of], _packed(start - ends[of], many, size[of]), True)

    return run


def _windows(window: int) -> Callable:
    """Single windows of the stretches listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, ends = raw_words(part.column(1))
                hashed = Rolling(hashes(words)).windows(window)
                size = np.diff(ends)
                listed = part.column(2)
                offsets = listed.offsets.to_numpy()
                flat = listed.flatten()
                of = np.repeat(np.arange(len(size)), np.diff(offsets))
                name = flat.field(0).to_numpy().view(np.uint64)
                start, many, count = _unpacked(flat.field(1).to_numpy())
                real = (count == size[of] & ((1 << _COUNT_BITS) - 1)) & (start + many - 1 + window <= size[of])
                of, name, start, many = of[real], name[real], start[real], many[real]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at, of, name = np.repeat(start, many) + step, np.repeat(of, many), np.repeat(name, many)
                ref = part.column(0).to_numpy().view(np.uint64)
                yield from _rows(name, hashed[ends[of] + at] if len(at) else np.zeros(0, np.uint64), ref[of], _packed(at, np.ones(len(at), np.int64), size[of]), False)

    return run


def _removed(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = []
                places = part.column(2)
                for row, text in enumerate(part.column(1).to_pylist()):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    spans: list[list[int]] = []
                    if places[row].is_valid and len(words) >= window:
                        start, many, count = _unpacked(np.sort(np.asarray(places[row].values)))
                        real = count == len(words) & ((1 << _COUNT_BITS) - 1)
                        for a, b in zip(start[real].tolist(), (start + many - 1 + window)[real].tolist(), strict=True):
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], min(b, len(words)))
                            else:
                                spans.append([a, min(b, len(words))])
                    kept, at = [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    made.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), spans))
                n_words, n_removed, kept_text, removed = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64())))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
                )

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of every row: ``removed`` lists [first, past last] word ranges."""
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))
    dealt = texts.select("ref", "text").mapInArrow(_occurrences(window), _ROW).repartition("part")
    # everything below is inside the anchor's partition: one exchange
    by_name, by_own = Window.partitionBy("part"), Window.partitionBy("part", "own")
    counted = F.col("kind") >= _COUNT
    n_name = F.sum(F.when(counted, F.col("n")).otherwise(0)).over(by_name)
    n_own = F.sum(F.when(counted, F.col("n")).otherwise(0)).over(by_own)
    seen = dealt.withColumn("n_own", n_own).withColumn("at", F.row_number().over(by_own.orderBy("kind", "ref", "place"))).withColumn("n_name", n_name)
    alone = counted & ((F.col("n_own") == 1) | (F.col("kind") == _WITNESS))
    seen = seen.withColumn("compared", F.max(alone.cast("int")).over(by_name) == 1)
    repeats = counted & (F.col("n_name") > 1)
    said = (
        F.when(F.col("kind") < _COUNT, F.array(F.col("kind")))
        .when(repeats & (F.col("n_own") > 1), F.when(F.col("compared") & (F.col("at") == 1) & (F.col("kind") == _COUNT), F.array(F.lit(_SURE), F.lit(_COMPARE))).otherwise(F.array(F.lit(_SURE))))
        .when(repeats & (F.col("kind") == _COUNT), F.array(F.lit(_COMPARE)))
        .otherwise(F.array().cast("array<int>"))
    )
    found = stored(seen.select("ref", "place", "name", F.explode(said).alias("kind")))
    # the texts are dealt by document once: both joins read that exchange, so both take the same columns of it
    compare = found.filter(F.col("kind") == _COMPARE).groupBy("ref").agg(F.collect_set(F.struct("name", "place")).alias("listed"))
    singles = texts.join(compare, "ref").select("ref", "text", "listed", "doc_id").mapInArrow(_windows(window), _ROW)
    same = Window.partitionBy("part", "own")
    windows = singles.repartition("part").withColumn("n_own", F.sum(F.when(counted, F.col("n")).otherwise(0)).over(same)).filter((F.col("kind") == _SURE) | (F.col("n_own") > 1))
    flagged = found.filter(F.col("kind") == _SURE).select("ref", "place").union(windows.select("ref", "place"))
    by_text = flagged.groupBy("ref").agg(F.collect_set("place").alias("places"))
    joined = texts.join(by_text, "ref", "left").select("doc_id", "text", "places")
    out = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_words long, n_removed long, kept_text string, removed array<array<long>>").fields])
    return joined.mapInArrow(_removed(window), out)
