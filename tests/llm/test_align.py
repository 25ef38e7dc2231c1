"""Alignment of two tokenizers against brute force over bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketspark.llm import align

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def known():
    return align.tokenizers_of(align.FOLDER)


def spelled(known, text):
    """(ids and byte ranges of A, of B), straight from both tokenizers; None where the bytes differ."""
    if not text:
        return None
    raw = b" " + text.encode()
    signs = align._byte_signs()
    names = {i: t for t, i in known.exact.get_vocab().items()}
    a = known.exact.encode(" " + text, add_special_tokens=False).ids
    b = known.pieces.encode(text)
    a_bytes = [bytes(signs[c] for c in names[i]) for i in a]
    b_bytes = [known._piece(i) for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    out = []
    for ids, parts in ((a, a_bytes), (b, b_bytes)):
        at, ranges = 0, []
        for i, part in zip(ids, parts, strict=True):
            ranges.append((i, at, at + len(part)))
            at += len(part)
        out.append(ranges)
    return out


def by_force(known, texts):
    said = [spelled(known, t) for t in texts]
    links = [[(x, y) for x, s, e in pair[0] for y, p, q in pair[1] if s < q and p < e] if pair else [] for pair in said]
    total = Counter(link for each in links for link in each)
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    rows = []
    for pair, own in zip(said, links, strict=True):
        if pair is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in pair[0]} & {e for _, _, e in pair[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in pair))
            low = high
        rows.append((len(pair[0]), len(pair[1]), len(groups), len(own), sum(total[x] == most[x[1]] for x in own), sum(total[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "   ", "\n", "a", " leading", "trailing ", "two  blanks   three", "tabs\tand\nlines\r\n\n end", "<|endoftext|> and </s> <s> <unk>", "Straße naïve Ünïcödé",
    "中文 没有 空格 的文字", "한국어 텍스트", "▁ block ▁x", "<0x41> b<0x0A>", "é combining", "👩‍👩‍👧 family 🏳️‍🌈", "don't we'll THEY'RE", "1234567890 3.14 ² ½", "a" * 300, "x\x00y", " nbsp　wide", "﻿bom", "ﬁ ligature ①",
]


def test_against_all_byte_ranges(spark, known):
    rng = random.Random(3)
    letters = "abcdefghij éß中 '.,-\n\t0123"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(60)] + ["the same text again and again", "the same text again and again"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    clashing = docs.select("*", *[F.lit(7).alias(n) for n in ("n_a", "pair", "pairs", "times", "n", "best", "_row", "_salt", "e", "groups_sha256")])
    want = by_force(known, texts)
    for bound in (align.BROADCAST_PAIRS, 0):
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.alignment(clashing, broadcast_pairs=bound).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_rows_with_null_and_repeated_ids(spark, known):
    texts = ["one text", "one text", "other text", None]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, None)], DOCS)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in align.alignment(docs).collect())
    assert got == sorted(by_force(known, texts))
    assert align.alignment(docs.limit(0)).count() == 0


def test_cut_texts_are_tokenised_alike(known, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "béta", "don't", "12", "x-y", "\n", "  ", "中", "Ünï"]
    text = " ".join(rng.choice(words) for _ in range(3000))
    whole = [x.tolist() for x in known.encode(text)]
    monkeypatch.setattr(align, "SLICE_BYTES", 500)
    cut = [known.encode(p) for p in align.parts(text, 500)]
    assert len(cut) > 20
    assert [sum((x.tolist() for x, _ in cut), []), sum((y.tolist() for _, y in cut), [])] == whole
    memo = align.Memo(known)
    many = memo.text(text)
    monkeypatch.undo()
    once = align.Memo(known).text(text)
    assert many[:5] == once[:5] and many[5].tolist() == once[5].tolist() and many[6].tolist() == once[6].tolist()


def test_memo_forgets_nothing_it_needs(known, monkeypatch):
    monkeypatch.setattr(align, "MEMO", 3)
    text = "one two three four five six one two seven one"
    memo = align.Memo(known)
    assert memo.text(text)[4] == align.Memo(known).text(text)[4] and len(memo.of) <= 3 and len(memo.old) <= 3


def test_fast_and_exact_encoders_agree(known):
    for text in ODD:
        if text:
            assert known.fast.encode_ordinary(" " + text) == known.exact.encode(" " + text, add_special_tokens=False).ids


def test_long_texts_without_blanks(known):
    said = align.Memo(known).text("ab" * 40_000)
    assert said[0] > 0 and said[3] >= max(said[:2])
    assert align.Memo(known).text(" " * 40_000)[3] > 0
