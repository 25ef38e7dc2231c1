"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they miss.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by form, with their places.
Bootstrap: base finds are seeds. The words around every identifier-like token (two to the left, or one
on each side) are lexical patterns. Patterns and tokens form a graph that is scored in rounds: a
pattern is as trustworthy as its tokens' mean score for a kind, a token as its patterns suggest
together. Tokens that base patterns miss, in places of high-confidence patterns, are reported with the
pattern's kind; base finds always stay.

DataFrame operations only. Counts by (pattern, token) are summed map-side before they are shuffled, and
the graph's joins are on patterns and tokens, whose rows are distinct pairs; joins with hot
patterns are plain equi-joins that Spark may split.

Defined results: null text is empty and has nothing; a base match that fails its check (parts over
255, digits, check digit) is dropped and the search goes on behind it; spans are in code points, end
exclusive, by start, then kind in the order of ``KINDS``; found tokens that touch a base span are
left out; repeated rows get equal results; an empty table gives no rows; only doc_id and text are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Forms. Possessive and bounded where that changes no match: a run is tried once, at its beginning.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
FORMS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold to be searched for a kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: A token: identifier characters with a digit or an at sign among them.
_CHARS, _PLAIN = r"A-Za-z0-9@._%+#/-", r"A-Za-z._%+#/-"
TOKEN = rf"(?<![{_CHARS}])[{_PLAIN}]*+[0-9@][{_CHARS}]*+"
BLANK = r"\x20\x09-\x0D"
#: A pattern is trusted with so many seeds of a kind, and from this confidence on; rounds of scoring.
SEEDS, CONFIDENCE, ROUNDS = 5, 0.9, 3
#: Characters of a gap in which context words are looked for.
_REACH = 64


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(hit)).between(14, 19) & _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: array of (start, kind's number, end)."""
    form = F.lit(FORMS[kind])
    found = F.arrays_zip(F.slice(F.transform(F.split(text, FORMS[kind], -1), F.length), 1, 1 << 30).alias("gaps"), F.regexp_extract_all(text, form, F.lit(0)).alias("hits"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    number = F.lit(KINDS.index(kind))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gaps"]
        end = start + F.length(x["hits"])
        span = F.struct(start.alias("start"), number.alias("kind"), end.alias("end"))
        # after the last match there is one more gap and no hit
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.coalesce(x["hits"].isNotNull() & _passes(kind, x["hits"]), F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(NEEDS[kind]), walked).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, n_email, n_ip, n_card, n_phone, base): ``base`` is the ordered array of (start, kind, end)."""
    body = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    each = body.select("doc_id", "ref", *[_spans(F.col("text"), k).alias(k) for k in KINDS])
    return each.select("doc_id", "ref", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(F.concat(*KINDS)).alias("base"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def tokens(docs: DataFrame) -> DataFrame:
    """(ref, doc_id, at, gap, hit, left, left2, right): identifier-like tokens in order, the length of the gap before each, and its context."""
    any_ = f"{PHONE}|{CARD}|{TOKEN}"
    some = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref")).filter(F.col("text").rlike("[0-9@]"))
    cut = some.select("doc_id", "ref", F.split("text", any_, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(any_), F.lit(0)).alias("hits"))
    rows = cut.select("doc_id", "ref", "gaps", F.posexplode("hits").alias("at", "hit"))
    before, after = F.get("gaps", F.col("at")), F.get("gaps", F.col("at") + 1)
    tail = F.lower(F.right(before, F.lit(_REACH)))
    head = F.lower(F.left(after, F.lit(_REACH)))
    word = f"[^{BLANK}]+"
    return rows.select(
        "doc_id", "ref", "at", F.length(before).alias("gap"), "hit",
        F.regexp_extract(tail, f"({word})[{BLANK}]*$", 1).alias("left"),
        F.regexp_extract(tail, f"({word})[{BLANK}]+{word}[{BLANK}]*$", 1).alias("left2"),
        F.regexp_extract(head, f"^[{BLANK}]*({word})", 1).alias("right"),
    )


def _seed_kind(hit: Column) -> Column:
    """Number of the kind whose form a token has; null for none."""
    out = F.lit(None).cast("int")
    for k in reversed(KINDS):
        out = F.when(hit.rlike(f"^(?:{FORMS[k]})$") & _passes(k, hit), F.lit(KINDS.index(k))).otherwise(out)
    return out


def trusted_patterns(found: DataFrame, seeds: int = SEEDS, least: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are trusted, from tokens with their contexts."""
    edges = stored(_patterned(found).groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    kinds = found.sparkSession.range(len(KINDS)).select(F.col("id").cast("int").alias("kind"))
    # patterns with too few seeds of a kind are never trusted, so they and their scores aren't followed
    strong = edges.filter(F.col("seed").isNotNull()).groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("n_seeds")).filter(F.col("n_seeds") >= seeds)
    graph = stored(edges.join(strong, "pattern").select("pattern", "kind", "token", "seed"))
    score = F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed").isNotNull(), 0.0)
    patterns = graph.groupBy("pattern", "kind").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("confidence"))
    for _ in range(rounds):
        open_ = graph.filter(F.col("seed").isNull()).join(patterns, ["pattern", "kind"])
        # a token is believed unless all its patterns err
        believed = open_.groupBy("token", "kind").agg((F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-6)))))).alias("belief"))
        scored = graph.join(believed, ["token", "kind"], "left")
        patterns = stored(scored.groupBy("pattern", "kind").agg(F.avg(F.coalesce(score, F.col("belief"), F.lit(0.0))).alias("confidence")))
    return patterns.join(F.broadcast(kinds), "kind").filter(F.col("confidence") >= least)


def _patterned(found: DataFrame) -> DataFrame:
    """A row for each token and pattern of its context."""
    two = F.when((F.col("left2") != "") & (F.col("left") != ""), F.concat(F.lit("2 "), F.col("left2"), F.lit(" "), F.col("left")))
    sides = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("1 "), F.col("left"), F.lit(" _ "), F.col("right")))
    return found.select("doc_id", "ref", "at", F.lower("hit").alias("token"), _seed_kind(F.col("hit")).alias("seed"), F.explode(F.filter(F.array(two, sides), lambda p: p.isNotNull())).alias("pattern"))


def discovered(found: DataFrame, **settings) -> DataFrame:
    """(ref, doc_id, extra): the tokens without base form in the places of trusted patterns, as an array of (start, kind, end)."""
    trusted = trusted_patterns(found, **settings)
    named = _patterned(found).filter(F.col("seed").isNull()).join(trusted, "pattern")
    best = named.groupBy("doc_id", "ref", "at").agg(F.min("kind").alias("kind"))
    documents = best.select("ref").distinct()
    running = Window.partitionBy("doc_id", "ref").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # rows alike in doc_id and text bring the same tokens twice
    once = found.join(documents, "ref").select("doc_id", "ref", "at", "gap", "hit").distinct()
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(running).cast("int")).withColumn("start", F.col("end") - F.length("hit"))
    spans = placed.alias("p").join(best.alias("b"), (F.col("p.ref") == F.col("b.ref")) & (F.col("p.at") == F.col("b.at")) & F.col("p.doc_id").eqNullSafe(F.col("b.doc_id")))
    core = F.regexp_replace("hit", r"[._%+#/-]+$", "")
    span = F.struct("start", "kind", (F.col("start") + F.length(core)).alias("end"))
    return spans.select(F.col("p.doc_id").alias("doc_id"), F.col("p.ref").alias("ref"), span.alias("span")).groupBy("doc_id", "ref").agg(F.collect_set("span").alias("extra"))


def personal_data(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row; both lists are arrays of (start, kind, end)."""
    base = base_spans(docs)
    more = discovered(stored(tokens(docs)), **settings).withColumnRenamed("doc_id", "_id").withColumnRenamed("ref", "_ref")
    joined = base.join(more, (F.col("ref") == F.col("_ref")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    apart = F.filter(F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.array_sort(F.concat("base", apart)).alias("spans"))
