"""Quality rules of documents and of their hosts.

Every document is measured and held against ``RULES``. Failures are summed by host (a domain, or the
source of a document), and a host's rate of failures is shrunk towards a beta prior that is fitted to
all hosts by moments: with mean ``p`` and correlation ``rho`` inside hosts the prior weighs as much as
``s = 1 / rho - 1`` documents, and a host with ``f`` failures in ``n`` documents has the rate
``(f + s p) / (n + s)``. Where hosts differ no more than chance explains, every host has rate ``p``. A host
fails if a rule's rate reaches ``HOST_FAILS``; its documents aren't kept, nor is a document that fails a base
rule itself.

Route: measures are column expressions over whole texts, computed once and stored without the texts. A host's
sums are hash aggregates with map-side partials, the prior one row of sums over hosts. Only failed
hosts come back to the documents: broadcast up to ``BROADCAST_HOSTS`` (counted first), beyond that by a
join salted by row, so that a host with a third of all rows is spread either way.

Defined results: a null or empty text has no words and fails the base rule; a document without host (null) is
judged by itself alone and counts for no host; repeated rows count as often as they are there; an
empty table gives no rows; columns of the input with clashing names are replaced. Windows are told apart by
64-bit hashes inside one text (two different windows of a text with n words collide with probability
n² / 2⁶⁵).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import stored

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
#: Words of a window that is looked for again in the same text.
WINDOW = 8
#: Rules by name: which documents fail. The first two are the base rules that a document must pass itself.
RULES = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeated")
#: A host whose shrunk rate of failures of one rule is at least this fails as a whole.
HOST_FAILS = 0.5
BROADCAST_HOSTS = 1_000_000
SALTS = 64


def host_of(url: Column) -> Column:
    """Host name of a URL in lower case without ``www.``; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _swapped(text: Column, signs: str, by: str) -> Column:
    """``text`` with each of ``signs`` replaced; runs over bytes, faster than ``translate``."""
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def words(text: Column) -> Column:
    """Array of the words of a text."""
    spaced = F.trim(_swapped(text, SPACES[:-1], " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def repeated_words(ws: Column) -> Column:
    """How many of the words ``ws`` lie in a window that is there twice or more."""

    def covered(ps: Column) -> Column:
        again = F.filter(ps, lambda p, k: (p["h"] == F.get(ps, k - 1)["h"]) | (p["h"] == F.get(ps, k + 1)["h"]))
        starts = F.array_sort(F.transform(again, lambda p: p["i"]))
        return _let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def counted(hs: Column) -> Column:
        # most texts repeat nothing: no sort for them
        alike = F.size(F.array_distinct(hs)) == F.size(hs)
        return F.when(alike, F.lit(0).cast("long")).otherwise(_let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, counted))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words(whole), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("again")))
    in_lines = _let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("again")))
    made = docs.withColumns({"_words": counts, "_lines": in_lines})
    made = made.withColumns(
        {
            "n_words": F.col("_words.n"),
            "word_chars": F.length(_swapped(whole, SPACES, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(_swapped(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.col("_lines.again"),
            "n_lines": F.col("_lines.n"),
            "n_repeat_words": F.col("_words.again"),
        }
    ).drop("_words", "_lines")
    return made.withColumn("base_failed", F.expr(" OR ".join(RULES[name] for name in BASE)))


def host_rates(measures: DataFrame, host: str = "host") -> DataFrame:
    """(host, n_docs, rate_<rule> …, host_failed): shrunk rates of failures of every host."""
    hosts = measures.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.count_if(F.expr(fails)).alias(f"f_{name}") for name, fails in RULES.items()]
    )
    sums = [F.count("*").alias("_k"), F.sum("n_docs").alias("_n"), F.sum(F.col("n_docs") * F.col("n_docs").cast("double")).alias("_nn")]
    for name in RULES:
        f = F.col(f"f_{name}").cast("double")
        sums += [F.sum(f).alias(f"_f_{name}"), F.sum(f * f / F.col("n_docs")).alias(f"_ff_{name}")]
    made = hosts.crossJoin(F.broadcast(hosts.agg(*sums)))  # one row of sums
    k, n = F.col("_k"), F.col("_n").cast("double")
    for name in RULES:
        p = F.col(f"_f_{name}") / n
        spread = (F.col(f"_ff_{name}") - n * p * p) / F.nullif(p * (1 - p), F.lit(0.0))
        rho = (spread - (k - 1)) / F.nullif(n - F.col("_nn") / n - (k - 1), F.lit(0.0))
        strength = F.when(rho > 0, 1 / F.least(rho, F.lit(1.0)) - 1)
        made = made.withColumn(f"rate_{name}", F.coalesce((F.col(f"f_{name}") + strength * p) / (F.col("n_docs") + strength), p))
    rates = [F.col(f"rate_{name}") for name in RULES]
    return made.select("host", "n_docs", *rates, (F.greatest(*rates) >= HOST_FAILS).alias("host_failed"))


def judged(measures: DataFrame, host: str = "host", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``measures`` with host_failed and kept."""
    plain = measures.drop("host_failed", "kept")
    bad = stored(host_rates(plain, host).filter("host_failed").select(F.col("host").alias("_bad")))
    if bad.count() <= broadcast_hosts:
        joined = plain.join(F.broadcast(bad), F.col(host) == F.col("_bad"), "left")
    else:
        salted = plain.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        spread = bad.withColumn("_salt_bad", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, (F.col(host) == F.col("_bad")) & (F.col("_salt") == F.col("_salt_bad")), "left").drop("_salt", "_salt_bad")
    failed = F.col("_bad").isNotNull()
    return joined.withColumns({"host_failed": failed, "kept": ~F.col("base_failed") & ~failed}).drop("_bad")


def ruled(docs: DataFrame, host: Column, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdicts of every row of ``docs``, beside the columns ``carry``."""
    clean = docs.select(*carry, F.col("text").alias("_text"), host.alias("_host"))
    made = measured(clean, "_text").drop("_text")
    return judged(stored(made), "_host").withColumnRenamed("_host", "host")
