"""Arrow batches of texts to arrays of word hashes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 23
#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose texts in ``column`` have about ``budget`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = 0
    while first < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[first:]), budget, side="right"))
        last = min(first + max(fits, 1), len(sizes))
        yield batch.slice(first, last - first)
        first = last


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all lists, empty ones left out, and where each list's words begin and end."""
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    there = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if there.all():
        return words, ends
    return words.filter(pa.array(there)), np.concatenate(([0], np.cumsum(there)))[ends]


def raw_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, unchanged."""
    return _flat(pc.ascii_split_whitespace(pc.fill_null(texts, "")))


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and digits, in lower case."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    return _flat(pc.split_pattern(spaced, " "))


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Running Karp-Rabin hashes of ranges of a sequence, by prefix sums modulo 2**64."""

    def __init__(self, sequence: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sequence * powers(len(sequence)), dtype=np.uint64)))
        self.back = powers(len(sequence) + 1, INVERSE)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n])
