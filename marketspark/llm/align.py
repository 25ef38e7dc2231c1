"""Alignment of two tokenizers on the same texts, by whitespace-token anchors.

Each text is tokenised whole by a byte-level BPE (A) and a piece model (B). Where both have a token that
ends at the same byte and both next tokens begin with a space mark, the text is cut: what lies between two
cuts is a window of token ids (A ids, B ids). Byte lengths follow from ids, so a window's alignment depends on
its ids alone and is kept in a memo by id tuple. Inside a window, ends that A and B share cut it into
groups, and all A-B tokens of a group whose byte ranges overlap are linked.

Links of an id pair are counted corpus-wide: pairs are summed per document, then by pair with map-side
partials. The table of pairs grows with the two vocabularies, not with the corpus; it is broadcast up to
``BROADCAST_PAIRS`` (counted first), beyond that documents' pairs meet it by a join salted by row, since
some pairs are in nearly every document.

Memory: texts are tokenised in slices of ``SLICE_BYTES``; longer ones are cut before a space and a letter that
follow a letter, where neither tokenizer joins anything, and the memo holds at most twice ``MEMO`` windows. A piece
without such a place (one huge word) is tokenised as it is.

Defined results: a null or empty text, and a text whose joined A or B bytes differ from a space and the
text, has no tokens, zeros and an empty groups string; special tokens' strings are plain text; repeated rows
and repeated or null doc_id are rows of their own; empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored
from marketspark.llm.tokens import slices

#: Folder of the tokenizers' files, and the two files.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level BPE cuts a text before it merges (fixed value of its format).
_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES = 1 << 20
MEMO = 200_000
#: Bytes of ids up to which a window is kept in the memo.
_MEMO_BYTES = 512
BROADCAST_PAIRS = 4_000_000
SALTS = 64
_LONG_RUN = re.compile(r"\S{5000}|\s{5000}")
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Bytes of each id, and which ids begin with a space."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(entries), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in entries), np.bool_, len(entries))
        self.length_of, self.written = self.lengths.tolist(), list(map(str, range(len(entries))))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def spell(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the bytes of ``ids``, joined, are ``raw``."""
        many, ends = self.lengths[ids], self.ends(ids)
        if not len(ids) or ends[-1] != len(raw):
            return False
        return np.array_equal(self.raw[np.repeat(self.starts[ids] - ends + many, many) + np.arange(len(raw))], raw)


class Tokenizers:
    """Both tokenizers and their vocabularies."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        import tokenizers

        path = str(Path(folder) / BYTE_BPE)
        signs = _byte_signs()
        described = json.loads(Path(path).read_text(encoding="utf-8"))
        special = {t["id"] for t in described["added_tokens"]}
        entries = {i: bytes(signs[c] for c in entry) for entry, i in described["model"]["vocab"].items() if i not in special}
        self.exact = tokenizers.Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        # a merge's rank is its id, so the faster encoder gives the same ids
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=_CUTS, mergeable_ranks={v: k for k, v in entries.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / PIECES))
        self.a, self.b = Vocabulary([entries.get(i, b"") for i in range(max(entries) + 1)]), Vocabulary([self._piece(i) for i in range(self.pieces.get_piece_size())])

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and ``text`` by A, and of ``text`` by B; None if either doesn't give the bytes back."""
        spaced = " " + text
        a = self.exact.encode(spaced, add_special_tokens=False).ids if _LONG_RUN.search(text) else self.fast.encode_ordinary(spaced)
        ids = np.array(a, np.int32), np.array(self.pieces.encode(text, num_threads=1), np.int32)
        raw = np.frombuffer(spaced.encode(), np.uint8)
        return ids if self.a.spell(ids[0], raw) and self.b.spell(ids[1], raw) else None


def parts(text: str, size: int = SLICE_BYTES) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters; the space between two of them is left out."""
    first = 0
    while len(text) - first > size:
        cut = _SAFE.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.end()
    if first < len(text):
        yield text[first:]


@lru_cache(maxsize=1)
def tokenizers_of(folder: str) -> Tokenizers:
    return Tokenizers(folder)


#: Set in the B ids of a window's key, which tells them from A ids.
_B = 1 << 20


def groups(a: list[int], b: list[int], known: Tokenizers) -> tuple[str, int, bytes]:
    """Written groups, their number, and the packed id pair of each link of one window."""
    a_len, b_len, a_said, b_said = known.a.length_of, known.b.length_of, known.a.written, known.b.written
    said, links = [], []
    i = j = first_a = first_b = 0
    a_end, b_end = a_len[a[0]], b_len[b[0]]
    while True:
        links.append(a[i] << 20 | b[j])
        if a_end < b_end:
            i += 1
            a_end += a_len[a[i]]
        elif b_end < a_end:
            j += 1
            b_end += b_len[b[j]]
        else:
            i, j = i + 1, j + 1
            said.append(f"{','.join([a_said[k] for k in a[first_a:i]])}|{','.join([b_said[k] for k in b[first_b:j]])}")
            if i == len(a):
                return ";".join(said), len(said), array("q", links).tobytes()
            first_a, first_b = i, j
            a_end, b_end = a_end + a_len[a[i]], b_end + b_len[b[j]]


class Memo:
    """Alignments of windows by id tuple: the bytes of A ids, then of B ids with a mark.

    Two generations of at most ``MEMO`` windows: what was asked for since the last change stays.
    """

    def __init__(self, known: Tokenizers):
        self.known, self.of, self.old = known, {}, {}

    def window(self, key: bytes) -> tuple[str, int, bytes]:
        found = self.of.get(key) or self.old.get(key)
        if found is None:
            ids = array("i", key).tolist()
            n = next(k for k, x in enumerate(ids) if x >= _B)
            found = groups(ids[:n], [x - _B for x in ids[n:]], self.known)
        if len(key) <= _MEMO_BYTES:
            if len(self.of) >= MEMO:
                self.of, self.old = {}, self.of
            self.of[key] = found
        return found

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, bytes]]:
        """The alignment of each window of a text."""
        known = self.known
        _, i, j = np.intersect1d(known.a.ends(a)[:-1], known.b.ends(b)[:-1], assume_unique=True, return_indices=True)
        anchor = known.a.spaced[a[i + 1]] & known.b.spaced[b[j + 1]]
        i, j = i[anchor] + 1, j[anchor] + 1
        # ids of both sides in one array, window after window
        ids = np.empty(len(a) + len(b), np.int32)
        of_a, of_b = np.zeros(len(a) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
        of_a[i], of_b[j] = np.diff(j, prepend=0), np.diff(i, prepend=0)
        ids[np.arange(len(a)) + np.cumsum(of_a)[:-1]] = a
        first = i[0] if len(i) else len(a)
        of_b[0], of_b[j] = first, np.diff(i, append=len(a))
        ids[np.arange(len(b)) + np.cumsum(of_b)[:-1]] = b | _B
        raw, cuts = ids.tobytes(), [0, *((i + j) * 4).tolist(), len(ids) * 4]
        keys = [raw[p:q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
        found = list(map(self.of.get, keys))
        if None in found:
            found = [x or self.window(k) for x, k in zip(found, keys, strict=True)]
        return found

    def text(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, hash of the written groups, distinct linked pairs and their number of links."""
        n_a = n_b = n_groups = 0
        digest, found = hashlib.sha256(), [np.zeros((2, 0), np.int64)]
        for part in parts(text or ""):
            ids = self.known.encode(part)
            if ids is None:
                n_a = 0
                break
            said, counts, links = zip(*self.windows(*ids), strict=True)
            digest.update((";" if n_a else "").encode() + ";".join(said).encode())
            n_a, n_b, n_groups = n_a + len(ids[0]), n_b + len(ids[1]), n_groups + sum(counts)
            found.append(np.stack(np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)))
        if n_a == 0:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = found[1] if len(found) == 2 else np.concatenate(found, axis=1)
        if len(found) > 2:
            pairs, place = np.unique(pairs, return_inverse=True)
            times = np.bincount(place, times).astype(np.int64)
        return n_a, n_b, n_groups, int(times.sum()), digest.hexdigest(), pairs, times


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each text's distinct linked id pairs with their number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(tokenizers_of(folder))
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows = [memo.text(text) for text in part.column(1).to_pylist()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_ALIGNED}")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair over all texts, and whether no other A id has more with that B id."""
    each = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    counted = each.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 20) - 1))))
    return counted.withColumn("best", F.col("n") == most)


def alignment(docs: DataFrame, folder: str = FOLDER, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    texts = stored(aligned(docs, folder)).withColumn("_row", F.monotonically_increasing_id())
    counts = stored(pair_counts(texts))
    whole = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = texts.select(*whole, F.explode_outer(F.arrays_zip("pairs", "times")).alias("e")).select(*whole, F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        met = each.join(F.broadcast(counts), "pair", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = each.withColumn("_salt", F.pmod("_row", F.lit(SALTS))).join(counts.withColumn("_salt", salts), ["pair", "_salt"], "left")
    summed = met.groupBy(*whole).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).cast("long").alias("count_sum"),
    )
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
