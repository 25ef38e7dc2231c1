"""Operators of the training-data subpackage against brute force, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketspark.llm import decontaminate, graph, html, langid, mixing, neighbours, pii, quality, sharding, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts], strict=True))
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """``docs`` with columns named like those the operators make."""
    names = ("size", "score", "shard", "taken", "shards", "copies", "_row", "_key", "_hash", "_id", "_at", "_doc_id", "ref", "quality_score", "pos", "node")
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


def words(text):
    return (text or "").encode().split()


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# --- 1: substring dedup


def removed_by_force(texts, width=substring.WINDOW):
    seen = Counter(tuple(w[i : i + width]) for w in map(words, texts) for i in range(len(w) - width + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_against_all_windows(spark, seed):
    rng = random.Random(seed)
    rare, few = [f"w{i}" for i in range(400)], ["a", "b"]
    shared = [sentence(rng, n, rare) for n in (34, 35, 36, 60, 90)]
    texts = [" ".join([sentence(rng, rng.randrange(80), rare), rng.choice(shared), sentence(rng, rng.randrange(60), rare)]) for _ in range(40)]
    # runs, periods and near-periods of all kinds, alone and beside text
    texts += ["it " * n for n in (34, 35, 36, 80)] + ["x y " * n for n in (17, 18, 40)] + ["p q r p q " * 20, sentence(rng, 50, rare) + " z" * 50]
    texts += [sentence(rng, 120, few) for _ in range(6)] + [texts[0], texts[0], None, "", " \n\t ", "one word\x0b two", "Ünï " * 36]
    got = substring.without_repeats(clashing(documents(spark, texts))).collect()
    by_id = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got}
    assert [by_id[i] for i in range(len(texts))] == removed_by_force(texts)


def test_substring_deals_texts_once(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}-"), F.col("id") % 7) for k in range(60)]).alias("text"))
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        out = substring.without_repeats(docs)
        assert re.search(r"ReusedExchange \[doc_id\S+, text\S+, ref\S+\]", out._jdf.queryExecution().executedPlan().toString())
        assert out.filter("n_removed = 60").count() == 300
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_substring_odd_tables(spark):
    assert substring.without_repeats(documents(spark, ["x"]).limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(60))
    rows = substring.without_repeats(documents(spark, [long, long, "short"], ids=[None, None, 3])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(1, 0), (60, 60), (60, 60)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 50, 80).astype(np.uint64)
    text = np.concatenate([rng.integers(0, 50, 100).astype(np.uint64), passage, rng.integers(0, 50, 30).astype(np.uint64), passage, rng.integers(0, 50, 40).astype(np.uint64)])
    start, many, name, _ = substring.anchors(text, np.zeros(len(text), np.int32))
    named = {s + k: n for s, m, n in zip(start, many, name, strict=True) for k in range(m)}
    assert all(named[100 + k] == named[210 + k] for k in range(80 - substring.WINDOW + 1))
    assert len(named) == len(text) - substring.WINDOW + 1


# --- 2: HTML extraction


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a&nbsp;&amp;\n b<br>c</p>", "a & b c"),
        ("<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T</h1><p>Long enough words of the text. <p>Is.<p><b>And more &lt;words&gt; of it.</article><footer>F</footer>", "T\nLong enough words of the text.\nIs.\nAnd more <words> of it."),
        ("<div class=ad>Buy<article><p>The text of the page is here.</p></article>", "The text of the page is here."),
        ("<main><p>Text of the page, quite long.</p><div class='comments'><p>A reader's long comment on it.</p></div><form>Send</form><aside>More</aside></main>", "Text of the page, quite long."),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- c -->", "x"),
        ("<article><p>Half a tag <", "Half a tag <"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "A sentence of the article that goes on for quite a while and says a good deal about its subject."


def test_pages_without_article_keep_short_parts():
    body = [f"{LONG} {k}" for k in range(12)]
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    links = "<div>" + "".join(f"<div><a href={k}>L{k}</a></div>" for k in range(20)) + "</div>"
    parts = {
        "<ul><li>a</li><li>b</li></ul>": ["a", "b"],
        "<ol><li>a</li></ol>": ["a"],
        "<blockquote><p>Said.</p></blockquote>": ["Said."],
        "<table><tr><td>x</td><td>y</td></tr></table>": ["x", "y"],
        "<section><h2>S</h2><p>Few.</p></section>": ["S", "Few."],
        "<div><div><p>Deep.</p></div></div>": ["Deep."],
    }
    for part, kept in parts.items():
        page = f"<html><body>{links}<div class=content>{paragraphs}{part * 5}</div>{links}</body></html>"
        assert html.main_text(page) == "\n".join(body + kept * 5)
    # the long lines all in one section, short sections beside it
    short = "<section><p>Few.</p></section>"
    assert html.main_text(f"<body>{links}<div class=content><section>{paragraphs}</section>{short * 6}</div>{links}") == "\n".join(body + ["Few."] * 6)
    deep = "<div>" * 5000 + f"<p>{LONG}</p>" + "</div>" * 5000
    assert html.main_text(deep) == LONG


def test_short_articles_stay():
    page = f"<article>{f'<p>{LONG}</p>' * 10}</article>" + "<article><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p></article>"
    assert html.main_text(page) == "\n".join([LONG] * 10 + list("abcde"))


def test_any_markup_is_read():
    assert html.main_text("<![foo bar]><p>a</p>") == "a"
    assert html.main_text("<p>a</p><![foo").startswith("a")
    rng = random.Random(4)
    tags = "p div b li ul tr td table article main section a h1 span nav form option dt dd body script style".split()
    odd = ["<br>", "&amp;", "<![", "<!x", "<!-", "]]>", "<![if x]>", "<![CDATA[", "<!DOCTYPE", "<?p", "<", "&#x", "\0", "<a b='", "<!["]
    for _ in range(1500):
        html.main_text("".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"w{rng.random()} words ", rng.choice(odd)]) for _ in range(rng.randrange(40))))


@pytest.mark.parametrize("page", ["<div>{n}</li>", "<b>{n}<p>x", "<p><b>{n}<li>x", "<td>{n}<tr>", "<table>{n}</p>"])
def test_unclosed_tags_take_linear_time(page):
    first, then = page.split("{n}")
    took = []
    for n in (3000, 24_000):
        begin = time.perf_counter()
        html.main_text(first * n + then * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 40 * took[0] + 1


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>ab</p></article>"), (1, "u", "<article><p>ab</p></article>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    rows = html.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "ab", 2), (1, "ab", 2)]
    assert html.extracted(pages.limit(0)).count() == 0


def test_html_articles_of_the_table(spark):
    """The table's pages keep their text in one article element."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    from html import unescape

    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extracted(pages).collect():
        inner = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", inner)]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_long_page():
    assert len(html.main_text("<article>" + "<p>some words of a paragraph</p>" * 20_000 + "</article>").split("\n")) == 20_000


# --- 3: quality


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.scored(docs.select("doc_id", "text"), quality.learned(docs, labels))
    rows = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert np.mean([(r["quality_score"] >= quality.KEEP) == (r["quality"] == 1) for r in rows]) >= 0.95


def test_quality_odd_input(spark):
    docs = documents(spark, [None, "", "a b c", "A!! B!!", "a b c", "x" * 200_000], ids=[1, 2, 3, 4, 3, None])
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, None), (None, 1), (4, 5)], "doc_id long, quality int")
    space = quality.learned(docs, labels)
    rows = quality.scored(clashing(docs), space).select("doc_id", "text", "quality_score").collect()
    assert len(rows) == 6 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert {r["quality_score"] for r in rows if not r["text"]} == {space.prior}
    assert len({r["quality_score"] for r in rows if r["doc_id"] == 3}) == 1
    unlabelled = quality.learned(docs, labels.limit(0))
    assert {r["quality_score"] for r in quality.scored(docs, unlabelled).collect()} == {0.5}
    kept = quality.accepted(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns
    assert quality.scored(docs.limit(0), space).count() == 0


def test_quality_vote_by_force(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    space = quality.learned(docs, labels)
    texts = docs.select("text").limit(40).toArrow().column(0).combine_chunks()
    vectors = space.folded(space.weights(texts)).astype(float)
    for vector, score in zip(vectors, space.scores(texts), strict=True):
        if not vector.any():  # nothing known in the text
            assert score == space.prior
            continue
        cosine = space.labelled.astype(float) @ vector
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-3) ** quality.SHARPNESS
        assert score == pytest.approx((weight * space.labels[near]).sum() / weight.sum(), abs=0.02)


# --- 4: decontamination


def tiled_by_force(item, doc, shortest=5):
    """Greedy tiling with nested loops: the covered number of the item's words."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < shortest:
            return covered
        covered += n
        for k in range(n):
            free_i[i + k] = free_d[d + k] = False


def test_tiling_against_nested_loops():
    rng = random.Random(3)
    for _ in range(30):
        item = [rng.randrange(30) for _ in range(40)]
        a, b = rng.randrange(5, 20), rng.randrange(20, 35)
        doc = [rng.randrange(30) for _ in range(20)] + item[b:] + item[a:b] + [rng.randrange(30) for _ in range(9)] + item[:a]
        found = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64))
        assert sum(n for _, _, n in found) == tiled_by_force(item, doc)
        assert all(item[i : i + n] == doc[d : d + n] for i, d, n in found)


def leak_tables(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [sentence(rng, 30, vocabulary) for _ in range(4)] + ["too few words", None, ""]
    w = items[1].split()
    texts = [
        sentence(rng, 50, vocabulary) + " " + items[0].upper() + "!! " + sentence(rng, 20, vocabulary),
        " ".join(w[20:] + [sentence(rng, 9, vocabulary)] + w[:10] + ["and"] + w[10:20]),
        sentence(rng, 100, vocabulary),
        " ".join(items[2].split()[:12]),
        "too few words",
        None,
        "",
        items[3] + " " + items[0],
    ]
    return texts, items, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_leaks_both_ways(spark):
    texts, _, items = leak_tables(spark)
    docs = documents(spark, texts + texts[:1], ids=[*range(len(texts)), 0])
    expected = sorted([(0, 0), (0, 0), (1, 1), (7, 0), (7, 3)])
    for most in (decontaminate.BROADCAST_WORDS, 0):
        found = decontaminate.contaminated(clashing(docs), items, most_words=most).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == expected
        assert all(r["coverage"] == 1.0 for r in found)
    kept = decontaminate.decontaminated(clashing(docs), items)
    assert kept.columns == clashing(docs).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), items).count()
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()


# --- 5: language


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97


def test_language_odd_input(spark):
    docs = documents(spark, ["the cat", "le chat", None, "12 !!", "", "the " * 50_000, "\u0301 \u0308"], ["en", "fr", "en", None, None, None, None], ids=[0, 2, None, 7, 8, 9, 11])
    rows = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identified(clashing(docs)).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == 7
    assert {k for k, s in rows.items() if k[1] == "und"} == {(None, "und"), (7, "und"), (8, "und"), (11, "und")}
    nothing = langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identified(docs.limit(0)).count() == 0


def test_out_of_place_by_force():
    known = {"a": np.array([10, 20, 30], np.int64), "b": np.array([30, 99], np.int64)}
    profiles = langid.Profiles(known, 3)
    points = langid.letters(__import__("pyarrow").array(["ab b"]))[0]
    own = langid.top(*langid.grams(points), 3).tolist()
    away = {k: sum(abs(i - v.tolist().index(g)) if g in v else 3 for i, g in enumerate(own)) for k, v in known.items()}
    assert profiles.nearest(points) == (min(away, key=away.get), 1 - min(away.values()) / (3 * len(own)))


# --- 6: mixing


def targets_by_force(sizes):
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    capped, total = set(), sum(sizes.values()) * 1.5
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        share = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and share[s] > 2 * sizes[s]}
        if not over:
            return share
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    sources = [rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]) for _ in range(400)]
    texts = [sentence(rng, rng.randrange(1, 60), ["u", "v"]) for _ in sources]
    texts[3], texts[4] = None, ""
    docs = documents(spark, texts, sources=sources, ids=[i // 2 for i in range(400)])
    rows = mixing.mix(clashing(docs)).collect()
    assert len(rows) == 400
    sizes, taken = Counter(), Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words(t))
    expected = targets_by_force(sizes)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["size"] == len(words(r["text"])) and all(0 <= s < mixing.OUT_SHARDS for s in r["shards"])
        assert len(r["shards"]) <= 2 and (not r["size"] or len(r["shards"]) * r["size"] == r["taken"])
    assert all(abs(taken[s] - expected[s]) <= 8 for s in sizes)  # smaller than most documents
    # again, with other partitions: the same documents, as often
    made = mixing.mixed(clashing(docs).repartition(3))
    assert made.columns == clashing(docs).columns
    assert Counter((r["doc_id"], r["text"]) for r in made.collect()) == Counter({k: n for k, n in Counter((r["doc_id"], r["text"]) for r in rows for _ in r["shards"]).items()})


def test_mix_odd_tables(spark):
    assert mixing.mix(documents(spark, ["x"]).limit(0)).count() == 0
    rows = mixing.mix(documents(spark, [None, "", "a b", "a b"], sources=["x", "x", "y", "y"], ids=[1, 2, 3, 3])).collect()
    assert sorted((r["size"], r["source_size"]) for r in rows) == [(0, 0), (0, 0), (2, 4), (2, 4)]
    assert sum(r["taken"] for r in rows if r["source"] == "y") == 6 and sum(r["taken"] for r in rows) == 6


def test_splitting_tree_is_exact_and_random(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 24), (None, 1)], "source string, blocks long")
    rows = mixing.splitting_tree(quotas, 5, 1).collect()
    assert sorted((r["source"] or "", r["block"]) for r in rows) == sorted([("a", i) for i in range(40)] + [("b", i) for i in range(24)] + [("", 0)])
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 2
    # left child of a root of 2: the mean share of a source is that of the law
    means = [sum(r["shard"] == 0 and r["source"] == "a" for r in mixing.splitting_tree(quotas, 2, s).collect()) for s in range(4)]
    assert abs(np.mean(means) - 20) < 3 and len(set(means)) > 1


# --- 7: personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base_by_force(text):
    found = [(m.start(), k, m.end()) for k, (kind, form) in enumerate(BASE.items()) for m in form.finditer(text or "") if passes(kind, m.group())]
    return sorted(found)


TRICKY = [
    "a.b+c@x-y.example.com_d@e.fg and @no and x@y z@w.v.",
    "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 01.002.0003.255 9.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41111111111111111111 12 -34 4111  1111 1111 1111 1",
    "+1 (017) 555-7713 +12 +123456789012345 +1234567890123456 ++1 234 567 8901) + 1",
    "Café 😀 é@x.y 4111111111111111é +1 234 567 8901",
    None,
    "",
    "x" * 50_000 + "@a.b " + "1 " * 3_000,
]


def test_base_spans_against_regular_expressions(spark):
    rng = random.Random(7)
    texts = TRICKY + ["".join(rng.choice("0123456789.@+- ()ab") for _ in range(rng.randrange(150))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in pii.personal_data(clashing(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        spans = [(s["start"], s["kind"], s["end"]) for s in rows[i]["base"]]
        assert spans == base_by_force(text), text
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    texts = [f"{name()} {name()} my email is {name()}{i}@mail.example.com now {name()}" for i in range(30)]
    texts += ["word my email is joe77(at)mail now", "word my email is sam@intranet9 now", "the 7 cats and 8 dogs"]
    rows = {r["doc_id"]: r for r in pii.personal_data(documents(spark, texts + texts[-2:-1], ids=[*range(33), 31])).collect()}
    for i, hidden in ((30, "joe77"), (31, "sam@intranet9")):
        (span,) = rows[i]["spans"]
        assert texts[i][span["start"] : span["end"]] == hidden and span["kind"] == 0 and not rows[i]["base"]
    assert not rows[32]["spans"] and all(len(rows[i]["spans"]) == 1 for i in range(30))
    assert pii.personal_data(documents(spark, texts).limit(0)).count() == 0


# --- 8: sharding


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        axes = [F.floor(F.col("id") / side**k) % side for k in range(dims)]
        rows = sorted(spark.range(side**dims).select(sharding.hilbert_index(axes, bits).alias("h"), *[a.alias(f"a{k}") for k, a in enumerate(axes)]).collect())
        assert [r[0] for r in rows] == list(range(side**dims))
        assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    texts = ["same text"] * 60 + [f"tëxt {i}" * (i + 1) for i in range(40)] + [None, ""]
    docs = documents(spark, texts, langs=[None, "en", "fr"] * 34, sources=["s1"] * 90 + [None] * 12, ids=[0, 0, None, *range(99)])
    rows = sharding.shard_table(clashing(docs), payload=("doc_id", "text", "pos")).collect()
    slots = defaultdict(list)
    for r in rows:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"], r["pos"]) == (len(body) + 8, zlib.crc32(body), "rows", None, 7)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 102 and set(slots) == set(range(24)) and {len(s) for s in slots.values()} <= {4, 5}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(docs.limit(0)).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard_table(docs.limit(3)).collect()) == [(0, 0), (8, 0), (16, 0)]


# --- 9: SimHash


def fingerprint_by_force(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    digests = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def test_fingerprints():
    for text in (None, "", "One", "a B", "a b c", "É é x y Z", "a b c a b c a", "w " * 70_000):
        assert simhash.fingerprint(text) == fingerprint_by_force(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(9)
    own = rng.integers(0, 1 << 23, 3000)
    keys = set(zip(*(x.tolist() for x in simhash.golay_keys(own)), strict=True))
    assert {n for n in Counter(r for r, _ in keys).values()} == {1, 6}
    for first in range(23):
        second = rng.integers(0, 23, 3000)
        rows, other = simhash.golay_keys(own ^ (1 << first) ^ np.where(second == first, 0, 1 << second))
        assert len({r for r, _ in keys & set(zip(rows.tolist(), other.tolist(), strict=True))}) == 3000


@pytest.mark.parametrize("paired", [simhash.PAIRED, 2])
def test_links_join_all_within_two_bits(spark, paired):
    rng = random.Random(10)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:8]:
        for _ in range(12):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(p)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), paired)
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    reach = components_by_force(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {p: roots.get(p, p) for p in signed} == reach


def components_by_force(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(4000))
    texts = [base, base + " x", base.replace("w7 ", "q "), "other words here", None, "", "OTHER words  here", base]
    rows = simhash.near_duplicates(clashing(documents(spark, texts, ids=[5, 4, 6, 9, 8, 7, 9, None]))).collect()
    prints = [fingerprint_by_force(t) for t in texts]
    by = {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in rows}
    assert len(rows) == 8 and by[9, prints[3]] == 9 and by[8, 0] == by[7, 0] == 7
    expected = 4 if (prints[0] ^ prints[1]).bit_count() <= 2 else 5
    assert by[5, prints[0]] == by[None, prints[0]] == expected
    kept = simhash.deduplicated(clashing(documents(spark, texts + ["other words here"], ids=[5, 4, 6, 9, 8, 7, 9, None, 9])))
    assert kept.count() == len({r["component_id"] for r in rows}) and "_doc_id" in kept.columns
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_deduplicated_keeps_unrelated_texts_of_one_id(spark):
    rng = random.Random(11)
    texts = [sentence(rng, 40, [f"w{i}" for i in range(900)]) for _ in range(12)]
    prints = [fingerprint_by_force(t) for t in texts]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    # six unrelated texts without id, four with the same one, two with their own; copies of some of them
    ids = [None] * 6 + [3] * 4 + [1, 2]
    copied = [(None, texts[0]), (9, texts[1]), (3, texts[6]), (5, texts[10]), (3, None), (3, "")]
    rows = [*zip(ids, texts, strict=True), *copied]
    kept = simhash.deduplicated(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"]) == sorted((i or 0, t) for i, t in zip(ids, texts, strict=True))
    assert len(kept) == 13


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(3, 3)]
    linked = {frozenset(e) for e in edges}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_by_force(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10: nearest neighbours


def near_by_force(rows, query, most=5):
    q = np.array(query[1], float)
    scored = [(-float(q @ np.array(v, float)) / (np.linalg.norm(q) * np.linalg.norm(v)), i) for i, v in rows if i != query[0]]
    return [(i, -s) for s, i in sorted(scored)[:most]]


def test_neighbours_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # copies
    odd = [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] * 16), (7150, [1.0, None] * 8), (7200, [1.0]), (None, rows[0][1]), (7250, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    asked = [r for r in rows if r[0] % 50 == 0]
    assert set(got) == {r[0] for r in asked}
    hits = 0
    for query in asked:
        exact = near_by_force(rows, query)
        hits += len({i for i, _ in exact} & {i for i, _ in got[query[0]]})
        if query[0] >= 1000:  # copies: ties by id
            assert [i for i, _ in got[query[0]]] == [i for i, _ in exact]
    assert hits >= 0.95 * 5 * len(asked)


def test_neighbours_recall_over_several_blocks(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(3000)]
    got = defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = {q[0]: {i for i, _ in near_by_force(rows, q)} for q in rows if q[0] % 50 == 0}
    assert np.mean([len(exact[q] & got[q]) / 5 for q in exact]) >= 0.9


def test_few_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    two = neighbours.nearest(spark.createDataFrame([(50, [1.0, 0.0]), (7, [1.0, 1.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in two] == [(1, 3), (2, 7)] and two[0]["score"] == 1.0


def recall(spark, x):
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.nearest(rows).collect():
        found[r["query_id"]].append(r["score"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, len(x), neighbours.QUERY_EVERY):
        cosines = np.delete(unit @ unit[q], q)
        fifth = np.sort(cosines)[-5]
        hit += sum(s >= fifth - 1e-13 for s in found[q])
        total += 5
    return hit / total


@pytest.mark.parametrize("kind", ["clusters", "common mean", "random"])
def test_recall_on_low_contrast(spark, kind):
    rng = np.random.default_rng(6)
    noise = rng.normal(size=(2000, 32))
    x = {"clusters": rng.normal(size=(20, 32))[np.arange(2000) % 20] + 1e-3 * noise, "common mean": rng.normal(size=32) + 1e-3 * noise, "random": noise}[kind]
    assert recall(spark, x) >= 0.9


def test_tiny_and_huge_vectors(spark):
    rows = [(50, [1e-200, 1e-200]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 1e200]), (4, [1.0, 1.0]), (5, [1e-320, 1e-320])]
    got = {r["vec_id"]: r["score"] for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == pytest.approx({1: 1.0, 4: 1.0, 5: 1.0, 2: 0.5**0.5, 3: 0.5**0.5})
