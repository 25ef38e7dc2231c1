"""Conversation repair against a shortest-path search over whole audits."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketspark.llm import grammar, repair

ROWS = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, roles) of the cheapest, then least, edits of rows (initial, fault)."""
    done, heap = {}, [(0, "", "", 0, 0)]
    while heap:
        cost, audit, roles, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done[i, q] = (cost, audit, roles)
        steps = [(5, "I", x, i) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append((2, "D", "", i + 1))
            if fault not in (grammar.BLANK, grammar.REPEATED):
                stays = 5 if fault == grammar.CUT else 0
                steps += [(stays, "K", initial, i + 1)] + [(1 + stays, "R", x, i + 1) for x in "ua"]
        for more, letter, symbol, at in steps:
            to = q if letter == "D" else NEXT.get((q, symbol))
            if to is not None:
                heapq.heappush(heap, (cost + more, audit + letter, roles + symbol, at, to))
    return min(done[len(rows), q] for q in (0, 3) if (len(rows), q) in done)


def blank(text):
    return not (text or " ").encode().split()


def by_force(table):
    """Contract columns by conversation, straight from its sentences."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if lot == 0:
                continue
            if lot == 1:
                text = ""
            if lot == 2:
                text = text.translate({ord(c): None for c in ".!?"})
            if lot == 4:
                role = "user"
            rows += [(turn, role, text)] * (2 if lot == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for _, role, text in rows:
            words = text.encode().strip(b" \t\n\x0b\x0c\r").decode()
            fault = grammar.BLANK if blank(text) else grammar.REPEATED if (role, text) in seen else grammar.FINE if words[-1] in ".!?" else grammar.CUT
            seen.add((role, text))
            marked.append((role[:1], fault))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, roles = cheapest(marked)
        said, at, k = [], 0, 0
        for letter in audit:
            if letter == "D":
                k += 1
                continue
            name = {"u": "user", "a": "assistant"}.get(roles[at])
            if letter == "I":
                said.append(f"{name}:")
            else:
                said.append(f"{rows[k][1] if letter == 'K' else name}:{rows[k][2]}")
                k += 1
            at += len(roles[at : at + 1]) or 1
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(marked[:-1], marked[1:], strict=True)) if marked else 0
        count = [sum(f == g for _, f in marked) for g in (grammar.BLANK, grammar.REPEATED, grammar.CUT)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(rows):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows.collect()}


def table_of(seed, convs, longest):
    rng, out = random.Random(seed), []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Cut of", "Long one? Sure", "end.\n ", "é.", "", " \t", None, f"Own {rng.random()}.", f"{turn} said."])
            if rng.random() < 0.9:
                out.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.0 else turn, role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_against_search(seed):
    rng, repairer = random.Random(seed), grammar.Repairer()
    for _ in range(1500):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        frontier, cost, steps = repairer.run(rows[::-1], repairer.start())
        cost, state = repairer.best_end(frontier, cost)
        audit = "".join(letter for row in repairer.edits(steps, 0, state) for letter, _ in row)
        assert (cost, audit) == cheapest(rows)[:2]


def test_ambiguous_tops_are_refused():
    with pytest.raises(ValueError):
        # after x, what may follow depends on what came before
        grammar.Automaton((("T", ("a", "X", "b")), ("T", ("b", "X", "a")), ("X", ("x", "y"))))


def test_query_against_search(spark):
    table = table_of(1, [*range(120), None], 12)
    rows = spark.createDataFrame(table, ROWS)
    clashing = rows.select("*", *[F.lit(7).alias(c) for c in ("gone", "fault", "conv", "h1", "at", "piece", "audit", "_copy", "lo")])
    assert found(repair.summarised(repair.damaged(clashing))) == by_force(table)


def test_conversations_over_many_partitions(spark, monkeypatch):
    table = table_of(5, [0, 1], 400) + table_of(6, range(2, 12), 8)
    want = by_force(table)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        monkeypatch.setattr(repair, "PIECE", 16)
        mended = repair.Repair(repair.damaged(spark.createDataFrame(table, ROWS)), broadcast_groups=0)
        assert len(mended.plan) > 15
        assert found(mended.summaries()) == want
        pieces = sorted(mended.pieces().filter("conv_id = 0").collect(), key=lambda r: (r["at"], r["piece"]))
        assert "".join(p["audit"] for p in pieces) == want[0][6]
        said = "\n".join(f"{t['role']}:{t['text']}" for p in pieces for t in p["turns"])
        assert hashlib.sha256(said.encode()).hexdigest() == want[0][7]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_repeated_rows_and_turns(spark):
    # a turn of two roles: by role; equal rows of a turn are duplicates, whichever partition they are in
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be kind."), (1, 3, "user", "Hi.")] * 40
    marked = spark.createDataFrame(rows, ROWS).withColumn("gone", F.lit(False))
    got = found(repair.summarised(marked))[1]
    assert got[:4] == (1, 0, 197, 0) and got[6].count("D") >= 197
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    assert found(repair.summarised(marked))[1] == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_gone(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")], ROWS)
    assert repair.summarised(repair.damaged(rows.limit(0))).count() == 0
    gone = found(repair.summarised(rows.withColumn("gone", F.lit(True))))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_text_and_conversation(spark):
    text = "word " * 400_000 + "end."
    rows = spark.createDataFrame([("c", 0, "user", text), ("c", 1, "assistant", text)], ROWS.replace("conv_id long", "conv_id string")).withColumn("gone", F.lit(False))
    got = found(repair.summarised(rows))["c"]
    assert got[5:7] == (0, "KK") and got[7] == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()
    many = spark.range(30_000).select(F.lit("m").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"), F.lit(False).alias("gone"))
    assert found(repair.summarised(many))["m"][5:7] == (0, "K" * 30_000)
