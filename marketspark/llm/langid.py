"""Language identification by rank-order profiles of n-grams.

Texts are lower-cased, everything but letters becomes one blank, and n-grams of one to three
characters are counted over whole texts, blanks at word ends included. A language's profile is the
list of its most frequent n-grams in all its documents, a document's profile its own; the distance of
the two is the sum of differences of rank, with the profile's length for an n-gram that the language
doesn't list. The nearest language wins.

Counts are summed inside a task before they are shuffled; only profiles (``PROFILE`` rows a language)
reach the driver and the tasks.

Defined results: null text, text without a letter, and any text when nothing could be learned get
``und`` with score 0; ties of frequency go to the smaller n-gram, ties of distance to the smaller
language; a null doc_id isn't held out; repeated rows count as often as they are there; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.quality import held_out
from marketspark.llm.tokens import slices

#: N-grams of a profile, and the longest n-gram.
PROFILE, LONGEST = 400, 3
FOLDS, FOLD = 3, 1
UNKNOWN = "und"
#: Texts whose code points are worked on at a time.
_SLICE = 1 << 21


def letters(texts: pa.Array) -> list[np.ndarray]:
    """Code points of each text, lower-cased, with one blank before, between and after words; empty without letters (marks are none)."""
    texts = pc.if_else(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"), texts, "")
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " "), " ")
    return [np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(np.int64) if t else np.zeros(0, np.int64) for t in spaced.to_pylist()]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (code points packed 21 bits each) in order, and their counts; the lone blank doesn't count."""
    made = [points] if LONGEST == 1 else [points, points[:-1] << 21 | points[1:], points[:-2] << 42 | points[1:-1] << 21 | points[2:]]
    joined = np.sort(np.concatenate(made))
    starts = np.nonzero(np.concatenate(([True], joined[1:] != joined[:-1])))[0]
    values, counts = joined[starts], np.diff(np.concatenate((starts, [len(joined)])))
    there = values != 32
    return values[there], counts[there]


def top(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    return values[np.argsort(-counts, kind="stable")[:most]]


def profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _SLICE):
                by: dict[str, list[np.ndarray]] = {}
                for points, lang in zip(letters(part.column(0)), part.column(1).to_pylist(), strict=True):
                    if len(points):
                        by.setdefault(lang, []).append(points)
                for lang, texts in by.items():
                    values, counts = grams(np.concatenate(texts))
                    # texts follow each other with two blanks between: no n-gram with both is one of a text
                    own = (values & ((1 << 42) - 1) != (32 << 21 | 32)) & (values >> 21 != (32 << 21 | 32))
                    values, counts = values[own], counts[own]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

    known = docs.filter(F.col("lang").isNotNull()).select("text", "lang")
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "gram"]
    # first inside slices of the n-grams, so that no task sees all of a language
    sliced = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(32))).orderBy(*order))).filter(F.col("at") <= most)
    ranked = sliced.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= most)
    rows = ranked.orderBy("lang", "at").select("lang", "gram").toArrow().to_pydict()
    out: dict[str, list[int]] = {}
    for lang, gram in zip(rows["lang"], rows["gram"], strict=True):
        out.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    """Ranks of all listed n-grams by language, and distances of texts to them."""

    def __init__(self, by_language: dict[str, np.ndarray], most: int = PROFILE):
        self.languages, self.most = sorted(by_language), most
        self.listed = np.unique(np.concatenate(list(by_language.values()))) if by_language else np.zeros(0, np.int64)
        # the last row is for n-grams that no language lists
        self.ranks = np.full((len(self.listed) + 1, len(self.languages)), -1, np.int64)
        for column, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.listed, by_language[lang]), column] = np.arange(len(by_language[lang]))

    def nearest(self, points: np.ndarray) -> tuple[str, float]:
        """Language and 1 - distance / greatest possible distance."""
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        own = top(*grams(points), self.most)
        at = np.searchsorted(self.listed, own)
        at[at == len(self.listed)] = 0
        ranks = self.ranks[np.where(self.listed[at] == own, at, len(self.listed))]
        away = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / (self.most * len(own))


def predicted(docs: DataFrame, known: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                said = [sent.value.nearest(p) for p in letters(part.column(1))]
                langs, scores = zip(*said, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles are learned outside the held-out fold."""
    known = Profiles(profiles(docs.filter(~held_out(F.col("doc_id"), FOLDS, FOLD))))
    return predicted(docs, known).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
