"""Quality classifier: nearest neighbours vote in a latent-semantic space.

Terms are the shapes of three neighbouring bytes (letter case, digit, blank, line end, or the very
punctuation sign) and how often a word comes back one to four words later, all from whole texts.
Term weights (logarithm of the count, times inverse document frequency) of a bounded sample of labelled documents
are reduced by a singular-value decomposition; the labelled vectors are sent to all tasks. Every
document is folded into the same space, cosines with all labelled vectors are computed block by
block, and the most similar ones vote with their similarity as weight.

``SAMPLE`` bounds the labelled rows used (those with the smallest hash of doc_id), and with it the
driver's matrix and what is broadcast (one megabyte); all documents are scored.

Defined results: null and empty texts, and all texts where nothing is labelled, get the labelled
share of label 1 (0.5 without labels); a doc_id with several labels counts once for each;
labels other than 0 and 1, null included, are left out; a null doc_id is not held out and never
labelled; repeated rows get equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.tokens import hashes, raw_words, slices

#: Labelled rows that are learned from, dimensions of the latent space, neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4096, 24, 25
#: A document is kept from this score on.
KEEP = 0.3
FOLDS = 5
#: Power of a neighbour's similarity that is its weight.
SHARPNESS = 16
_KINDS = 64
_RETURNS = (1, 2, 3, 4)
_BLOCK = 2048


def _kinds() -> np.ndarray:
    """Kind of each byte: letters by case (bytes of other scripts count as small letters), digits, blanks, signs each for itself."""
    kinds = np.ones(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c in "\t\n\v\f\r" else 6
    for n, b in enumerate(signs):
        kinds[b] = 7 + n
    return kinds


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def terms(texts: pa.Array, of_shape: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x size) counts of the shapes that ``of_shape`` numbers, and (texts x 4) shares of returning words."""
    n = len(texts)
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    owner = np.repeat(np.arange(n), np.diff(ends))
    kind = _kinds()[data]
    if len(kind) > 2:
        shape = of_shape[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
        mine = (owner[:-2] == owner[2:]) & (shape >= 0)
        counts = np.bincount(owner[:-2][mine] * size + shape[mine], minlength=n * size).reshape(n, size)
    else:
        counts = np.zeros((n, size), np.int64)
    words, marks = raw_words(pc.ascii_lower(pc.fill_null(texts, "")))
    values, writer = hashes(words), np.repeat(np.arange(n), np.diff(marks))
    back = np.zeros((n, len(_RETURNS)))
    for column, step in enumerate(_RETURNS):
        if len(values) > step:
            same = (values[step:] == values[:-step]) & (writer[step:] == writer[:-step])
            back[:, column] = np.bincount(writer[step:][same], minlength=n)
    return counts, back / np.maximum(np.diff(marks), 1)[:, None]


class Space:
    """The latent space, its labelled vectors and their labels."""

    def __init__(self, texts: pa.Array, labels: np.ndarray):
        everything = np.arange(_KINDS**3)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen, n = np.zeros(_KINDS**3, np.int64), len(texts)
        for k in range(0, n, 16):  # few at a time: a row of all shapes is two megabytes
            seen += (terms(texts.slice(k, 16), everything, _KINDS**3)[0] > 0).sum(axis=0)
        kept = np.nonzero(seen >= 3)[0]
        self.of_shape = np.full(_KINDS**3, -1, np.int64)
        self.of_shape[kept] = np.arange(len(kept))
        self.size = max(len(kept), 1)
        self.idf = np.log(1 + n / np.maximum(seen[kept], 1)) if len(kept) else np.zeros(1)
        weighted = np.vstack([self.weights(texts.slice(k, _BLOCK)) for k in range(0, n, _BLOCK)]) if n else np.zeros((0, self.size + len(_RETURNS)))
        self.axes = np.linalg.svd(weighted, full_matrices=False)[2][:DIMENSIONS].T if n else np.zeros((weighted.shape[1], DIMENSIONS))
        there = np.linalg.norm(weighted, axis=1) > 0
        self.labelled, self.labels = self.folded(weighted[there]), labels[there].astype(np.float32)

    def weights(self, texts: pa.Array) -> np.ndarray:
        counts, back = terms(texts, self.of_shape, self.size)
        shapes = np.log1p(counts) * self.idf
        return np.hstack([shapes / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-9), np.sqrt(back)])

    def folded(self, weighted: np.ndarray) -> np.ndarray:
        latent = weighted @ self.axes
        return (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for k in range(0, len(texts), _BLOCK):
            weighted = self.weights(texts.slice(k, _BLOCK))
            there = np.nonzero(np.linalg.norm(weighted, axis=1) > 0)[0]
            if not len(there) or not len(self.labels):
                continue
            cosine = self.folded(weighted[there]) @ self.labelled.T
            most = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 1e-3) ** SHARPNESS
            out[k + there] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """The space of the labelled documents outside the held-out fold."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # a doc_id that repeats counts once for each text; the bound holds for the rows as well
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "quality").limit(sample).select("text", "quality").toArrow()
    return Space(got.column("text").combine_chunks(), got.column("quality").to_numpy().astype(np.float64))


def scored(docs: DataFrame, space: Space, to: str = "quality_score") -> DataFrame:
    """Columns of ``docs`` and the score in column ``to`` (replaced if there)."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    rest = [c for c in docs.columns if c != to]
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                score = pa.array(sent.value.scores(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*rest, to])

    rows = docs.select(*rest)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """Rows of ``docs`` whose score is ``least`` or more."""
    to = "_score" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    return scored(docs, learned(docs, labels), to).filter(F.col(to) >= least).drop(to)
