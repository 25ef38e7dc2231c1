"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A document's 64-bit fingerprint takes the majority of its shingles' hashes bit by bit. Documents
whose fingerprints differ in at most two bits are linked; classes are the components of the links.

Candidates: the fingerprint is cut in three segments. Two differing bits leave one segment alike, so
each segment in turn is an exact key, joined with fuzzy keys of the next one: the perfect Golay code
[23, 12] decodes the segment to its nearest codeword, and to all codewords at distance 4 where that
is 3 away, which gives 1 or 6 codeword indices such that segments at distance up to 2 share one.
Equal keys are candidates, the whole distance decides.

Equal fingerprints are one node from the start, so a group of copies costs one row. A bucket of more
than ``PAIRED`` fingerprints isn't paired off: each of its fingerprints is sent to itself and its 64
neighbours at distance 1; two that meet at such a midpoint are at distance 2 at most, and those at
distance 2 or less always meet, so a link to the midpoint's first member loses no component.

Defined results: null or wordless text has fingerprint 0, which is linked like any other; doc_id may
repeat, rows with the same fingerprint share a class; a class whose doc_ids are all null has id null,
and unrelated classes may have the same id, so the root tells classes apart; an empty table gives no
rows; of other columns only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored
from marketspark.llm.graph import components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this size are paired off; larger ones go by midpoints.
PAIRED = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority of the hashes of all shingles of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(first), _CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; text_hash tells rows with the same doc_id apart."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << (bit - 11), rest)
    return rest


def _error_table() -> np.ndarray:
    """Error pattern of weight 3 at most by remainder; the code is perfect, so each of 2,048 has one."""
    ones = [1 << i for i in range(23)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i])]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    table = np.zeros(2048, np.int64)
    table[_remainder(np.array(errors))] = errors
    return table


def golay_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the codeword indices of each 23-bit segment."""
    errors = _error_table()

    def nearest(words: np.ndarray) -> np.ndarray:
        return (words ^ errors[_remainder(words)]) >> 11

    # the nearest codewords of a segment and of all its neighbours are those up to distance 4
    found = np.stack([nearest(segments), *(nearest(segments ^ (1 << i)) for i in range(23))], axis=1)
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, at = np.nonzero(fresh)
    return rows, found[rows, at]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        parts = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
        for k in range(3):
            rows, keys = golay_keys(parts[(k + 1) % 3])
            joined = (np.int64(k) << 34) | (parts[k][rows] << 12) | keys
            yield pa.RecordBatch.from_arrays([pa.array(joined), pa.array(prints[rows].view(np.int64))], ["key", "fp"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(prints), 4096):
            own = prints[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(own, 65).view(np.int64))], ["mid", "fp"])


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``prints`` (fp) that join all those within two bits."""
    keys = stored(prints.select("fp").mapInArrow(_keyed, "key long, fp long"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = keys.join(sizes, "key")
    small = crowded.filter(F.col("n") <= paired).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= MOST_BITS))).alias("b"))
    large = crowded.filter(F.col("n") > paired).select("fp").distinct().mapInArrow(_midpoints, "mid long, fp long")
    # at most 65 fingerprints meet at a midpoint
    met = large.groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row: root is the class's smallest fingerprint, component_id its smallest doc_id."""
    rows = stored(fingerprints(docs))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # only classes of several fingerprints need the smallest doc_id of another one
    ids = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (null first), then text hash; columns as in ``docs``."""
    # doc_ids are null or repeat in unrelated classes, roots don't
    found = stored(near_duplicates(docs).select("doc_id", "text_hash", "root"))
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("_k")).select(F.col("_k.doc_id").alias("_id"), F.col("_k.text_hash").alias("_hash"))
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    kept = own.join(keep, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    # rows alike in doc_id and text
    one = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    return kept.withColumn("_at", F.row_number().over(one)).filter("_at = 1").select("_doc.*")
