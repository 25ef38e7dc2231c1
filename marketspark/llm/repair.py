"""Conversation structure repair: cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first), rows of one turn by role and then by a hash of role and
text. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated.
``grammar`` parses each conversation against the role grammar: keep, rerole, delete, insert.

Route: rows are sorted by range over (conversation, turn, role, hash), so that a long conversation is spread
over partitions, and checkpointed there. A conversation inside one partition is repaired in one go. One that
crosses a border is parsed by parts: each part is first summed up as costs and order of its cheapest
edits from each top at its end to each top at its begin (a few numbers); these sums, at most two a partition,
are chained on the driver, which tells each part where to begin and end; then parts are repaired like whole
conversations. Only the SHA-256 of a conversation is sequential by nature: that of one in parts runs over its
repaired lines in order, in one task with one hash state.

Whether a text was seen earlier is told by a sum over (conversation, hash of role and text), with map-side
partials; only texts seen in several turns come back to the rows, broadcast up to ``BROADCAST_GROUPS`` (counted
first), beyond that by a salted join. Copies within a turn are neighbours.

Defined results: null role and null text count as one space (a blank row); null conv_id is one conversation;
roles are told by their first character, an empty role has none; a conversation without rows has zeros, an empty audit
and no turns; repeated rows of the table are duplicates; empty tables give no rows; other columns are
not read. Texts of a turn that differ only in hash order have no other order. Role and text are told apart by
96 bits of hash inside a conversation.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import stored
from marketspark.llm.grammar import BLANK, CUT, FINE, REPEATED, Repairer
from marketspark.session import cut_lineage

ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BROADCAST_GROUPS = 1_000_000
SALTS = 64
#: Repaired turns of a row that describes a part of a conversation.
PIECE = 2048
SPACES = " \t\n\x0b\x0c\r"
_KEY = ("conv", "turn", "role", "h1", "h2")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): some rows lose text, role or end marks, come twice or go; by crc32."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    said = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    copies = F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(lot == 4, F.lit("user")).otherwise(text("role")).alias("role"), said.alias("text"), (lot == 0).alias("gone"), copies.alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("_copies").alias("_copy")).drop("_copy")


def prepared(rows: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Rows with hashes and faults. A row that is ``gone`` stays as a mark of its conversation, without text."""
    text, gone = F.coalesce("text", F.lit(" ")), F.coalesce("gone", F.lit(False))
    role = F.coalesce("role", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    keep = lambda c: F.when(~gone, c)
    made = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), keep(role).alias("role"), keep(text).alias("text"), gone.alias("gone"),
        keep(fault).cast("int").alias("fault"), keep(F.xxhash64(role, text)).alias("h1"), keep(F.hash(text, role)).alias("h2"),
    )
    seen = made.filter(~F.col("gone") & (F.col("fault") != BLANK)).groupBy("conv", "h1", "h2").agg(
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_if(F.col("turn").isNull()).alias("without")
    )
    several = stored(
        seen.filter("lo <> hi OR (without > 0 AND lo IS NOT NULL)").select(F.col("conv").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.when(F.col("without") == 0, F.col("lo")).alias("_first"), F.lit(True).alias("_met"))
    )
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    if several.count() <= broadcast_groups:
        joined = made.join(F.broadcast(several), same, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        salted = made.withColumn("_salt", F.pmod(F.coalesce("turn", F.lit(0)), F.lit(SALTS)))
        joined = salted.join(several.withColumn("_s", salts), same & (F.col("_salt") == F.col("_s")), "left")
    later = F.col("_met").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first")) & (F.col("fault") != BLANK)
    return joined.select("conv", "turn", "role", "text", "gone", F.when(later, REPEATED).otherwise(F.col("fault")).alias("fault"), "h1", "h2")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows spread by range over conversations and turns, in order inside partitions, checkpointed."""
    order = [F.asc_nulls_first(c) for c in _KEY]
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    return cut_lineage(spread.repartitionByRange(*order, F.asc("_tie")).sortWithinPartitions(*order).drop("_tie"))


class Run(NamedTuple):
    """The rows of one conversation in one partition."""

    conv: object
    initials: list[str]
    faults: list[int]
    roles: list[str]
    texts: list[str]
    turns: list


def runs(batches: Iterator[pa.RecordBatch], before: tuple | None, wanted: Callable[[object], bool] = lambda conv: True) -> Iterator[Run]:
    """The runs of a partition; ``before`` is the key of the row before it. Copies of the row before are duplicates."""
    now, last = None, before
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_KEY, "gone", "fault", "text")]
        for *key, gone, fault, text in zip(*columns, strict=True):
            conv, turn, role = key[:3]
            if not wanted(conv):
                continue
            if now is None or now.conv != conv:
                if now is not None:
                    yield now
                now = Run(conv, [], [], [], [], [])
            if gone:
                continue
            key = tuple(key)
            now.initials.append(role[:1])
            now.faults.append(REPEATED if key == last and fault != BLANK else fault)
            now.roles.append(role)
            now.texts.append(text)
            now.turns.append(turn)
            last = key
    if now is not None:
        yield now


class Sums(NamedTuple):
    """Counts of a run, which can be added."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str | None
    last: str | None
    low: int | None
    high: int | None
    turns: int

    @classmethod
    def of(cls, run: Run) -> Sums:
        count = [run.faults.count(f) for f in (BLANK, REPEATED, CUT)]
        illegal = sum(x + y not in LEGAL for x, y in zip(run.initials[:-1], run.initials[1:], strict=True)) if run.initials else 0
        known = [t for t in run.turns if t is not None]
        ends = (run.initials[0], run.initials[-1]) if run.initials else (None, None)
        return cls(len(run.faults), *count, illegal, *ends, known[0] if known else None, known[-1] if known else None, len(set(known)))

    def plus(self, other: Sums) -> Sums:
        """The sums of this run and the one after it."""
        if not other.rows or not self.rows:
            return other if other.rows else self
        illegal = self.illegal + other.illegal + (self.last + other.first not in LEGAL)
        shared = self.high is not None and self.high == other.low
        low, high = (self.low if self.low is not None else other.low), (other.high if other.high is not None else self.high)
        counts = [x + y for x, y in zip(self[:4], other[:4], strict=True)]
        return Sums(*counts, illegal, self.first, other.last, low, high, self.turns + other.turns - shared)

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.low is not None else 0


def _borders(lines: DataFrame) -> tuple[dict[int, dict[str, tuple]], dict[int, tuple]]:
    """Conversations that go on beyond a partition, by partition, and the key before each partition. One row a partition is collected."""
    placed = lines.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.struct(*_KEY).alias("key"))
    ends = placed.groupBy("part").agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last")).orderBy("part").collect()
    crossing: dict[int, list] = {}
    before: dict[int, tuple] = {}
    for left, right in zip(ends[:-1], ends[1:], strict=True):
        before[right["part"]] = tuple(left["last"])
        if left["last"]["conv"] == right["first"]["conv"]:
            crossing.setdefault(left["part"], []).append(left["last"]["conv"])
            crossing.setdefault(right["part"], []).append(right["first"]["conv"])
    return crossing, before


class Part(NamedTuple):
    """Where the parse of a part begins and ends, and its place in its conversation (0 is its first part)."""

    lane: int | None
    state: int
    at: int


def _chained(lines: DataFrame, crossing: dict[int, list], before: dict[int, tuple]) -> tuple[dict[tuple, Part], dict]:
    """The plan of each part of the conversations that cross borders, and their (cost, sums)."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_here = crossing.get(part, [])
        repairer, out = Repairer(), []
        for run in runs(batches, before.get(part), lambda conv: conv in open_here) if open_here else ():
            rows = list(zip(run.initials, run.faults, strict=True))[::-1]
            ends = []
            for begin in (repairer.start(), repairer.open_start()):
                frontier, cost, _ = repairer.run(rows, begin)
                ends.append([(lane, node.state, cost + c, rank) for lane, node, c, rank in frontier])
            out.append((part, open_here.index(run.conv), json.dumps((ends, Sums.of(run)))))
        cells = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["part", "which", "said"])

    rows = lines.drop("text").withColumn("text", F.lit("")).mapInArrow(summed, "part int, which int, said string").orderBy("part").collect()
    by_conv: dict[object, list] = {}
    for row in rows:
        (end, middle), sums = json.loads(row["said"])
        by_conv.setdefault(crossing[row["part"]][row["which"]], []).append((row["part"], end, middle, Sums(*sums)))
    plan: dict[tuple, Part] = {}
    totals = {}
    ending = Repairer().ending
    for conv, parts in by_conv.items():
        costs, ranks, chosen = None, None, []
        for _, end, middle, _ in reversed(parts):
            found: dict[int, tuple] = {}
            for lane, state, cost, rank in end if costs is None else middle:
                if costs is not None:
                    if lane not in costs:
                        continue
                    cost, rank = cost + costs[lane], (rank, ranks[lane])
                else:
                    rank = (rank, 0)
                if state not in found or (cost, rank) < found[state][:2]:
                    found[state] = (cost, rank, lane)
            order = {r: k for k, r in enumerate(sorted({f[1] for f in found.values()}))}
            costs, ranks = {s: f[0] for s, f in found.items()}, {s: order[f[1]] for s, f in found.items()}
            chosen.append({s: f[2] for s, f in found.items()})
        cost, _, state = min((costs[s], ranks[s], s) for s in costs if s in ending)
        sums = parts[0][3]
        for _, _, _, more in parts[1:]:
            sums = sums.plus(more)
        totals[conv] = (cost, sums)
        for at, ((part, *_), lanes) in enumerate(zip(parts, reversed(chosen), strict=True)):
            lane = lanes[state]
            plan[part, conv] = Part(None if at == len(parts) - 1 else lane, state, at)
            state = lane
    return plan, totals


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = [("at", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("turns", _TURNS)]
_PIECES = "at int, piece int, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, turns array<struct<role: string, text: string>>"


def _written(run: Run, edits: list[tuple], most: int | None) -> Iterator[tuple[str, list[dict]]]:
    """(audit, repaired turns) of the rows of a run, in pieces of ``most`` edits if given."""
    audit, turns = [], []
    for k, row in enumerate(edits):
        for letter, symbol in row:
            audit.append(letter)
            if letter != "D":
                role = run.roles[k] if letter == "K" else ROLES[symbol]
                turns.append({"role": role, "text": "" if letter == "I" else run.texts[k]})
        if most and len(audit) >= most:
            yield "".join(audit), turns
            audit, turns = [], []
    yield "".join(audit), turns


def line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


class Repair:
    """Rows in order, and what is known of conversations that cross partitions."""

    def __init__(self, rows: DataFrame, broadcast_groups: int = BROADCAST_GROUPS):
        self.kind = dict(rows.dtypes)["conv_id"]
        self.lines = in_order(prepared(rows, broadcast_groups))
        self.crossing, self.before = _borders(self.lines)
        self.plan, self.totals = _chained(self.lines, self.crossing, self.before) if self.crossing else ({}, {})

    def pieces(self, whole: bool = True, parts: bool = True) -> DataFrame:
        """Repaired conversations: those in one row, those in several, or both."""
        plan, totals, before = self.plan, self.totals, self.before

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, repairer, out, size, conv_type = TaskContext.get().partitionId(), Repairer(), [], 0, None

            def typed() -> Iterator[pa.RecordBatch]:
                nonlocal conv_type
                for batch in batches:
                    conv_type = batch.schema.field("conv").type
                    yield batch

            def made() -> pa.RecordBatch:
                cells = list(zip(*out, strict=True))
                arrays = [pa.array(cells[0], conv_type), *[pa.array(c, t) for c, (_, t) in zip(cells[1:], _FIELDS, strict=True)]]
                out.clear()
                return pa.RecordBatch.from_arrays(arrays, ["conv_id", *[n for n, _ in _FIELDS]])

            for run in runs(typed(), before.get(part)):
                own = plan.get((part, run.conv))
                single = own is None and len(run.faults) <= PIECE
                if not (whole if single else parts):
                    continue
                begin = repairer.start() if own is None or own.lane is None else repairer.lane_start(own.lane)
                frontier, cost, steps = repairer.run(zip(reversed(run.initials), reversed(run.faults), strict=True), begin)
                if own is None:
                    cost, state = repairer.best_end(frontier, cost)
                    at, sums, lane = 0, Sums.of(run), 0
                else:
                    (cost, sums), state, at, lane = totals[run.conv], own.state, own.at, own.lane or 0
                counts = (sums.gaps, sums.blank, sums.duplicate, sums.truncated, sums.illegal, cost)
                for k, (audit, turns) in enumerate(_written(run, repairer.edits(steps, lane, state), None if single else PIECE)):
                    out.append((run.conv, at, k, single, *counts, audit, turns))
                    size += 1 + len(turns)
                    if size >= PIECE:
                        yield made()
                        size = 0
            if out:
                yield made()

        return self.lines.mapInArrow(mend, f"conv_id {self.kind}, {_PIECES}")

    def summaries(self) -> DataFrame:
        """One row for each conversation: counts, cost, whole audit and SHA-256 of its repaired lines."""
        lines = F.array_join(F.transform("turns", line), "\n")
        names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
        single = self.pieces(parts=False).select(*names[:-1], F.sha2(F.encode(lines, "UTF-8"), 256).alias("repaired_sha256"))

        def closed(row: dict, audit: list[str], digest: hashlib._Hash, conv_type: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array([row["conv_id"]], conv_type), *[pa.array([row[c]], pa.int64()) for c in _COUNTS], pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = None
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                for k in range(batch.num_rows):
                    piece = batch.slice(k, 1).to_pylist()[0]
                    if row is None or piece["conv_id"] != row["conv_id"]:
                        if row is not None:
                            yield closed(row, audit, digest, conv_type)
                        row, audit, digest, begun = piece, [], hashlib.sha256(), False
                    audit.append(piece["audit"])
                    if piece["n"]:
                        digest.update((("\n" if begun else "") + piece["lines"]).encode())
                        begun = True
            if row is not None:
                yield closed(row, audit, digest, conv_type)

        counts = ", ".join(f"{c} long" for c in _COUNTS)
        several = self.pieces(whole=False).select("conv_id", "at", "piece", *_COUNTS, "audit", lines.alias("lines"), F.size("turns").alias("n"))
        ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "at", "piece")
        return single.union(ordered.mapInArrow(hashed, f"conv_id {self.kind}, {counts}, audit string, repaired_sha256 string"))


def repaired(rows: DataFrame) -> DataFrame:
    """Repaired conversations, in pieces of about ``PIECE`` turns.

    (conv_id, at, piece, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): pieces go by
    (at, piece); counts and cost are those of the conversation and the same in each of its pieces; ``whole`` says
    that the conversation is this one row.
    """
    return Repair(rows).pieces()


def summarised(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    return Repair(rows).summaries()
