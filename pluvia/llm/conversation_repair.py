"""Repair of conversations: the cheapest edits that give them a legal order of roles.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. That language has four
states (before all turns, after a system turn, after a user's, after an assistant's).
What the rest of a conversation costs from each of them is a vector of four numbers; less
its smallest number, only a few such vectors exist. So the weighted automaton is made
deterministic lazily: vectors are its states, numbered as they turn up, and a table holds
for each of them and each kind of turn the vector before that turn and what was taken off.
Conversations are read through that table from the last turn to the first. The trace runs
against the scan, from the first turn on, along arcs that are tight (whose cost and rest
make up the state's cost), the least letter first, and is tabulated in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A turn is a byte: its role's initial (system, user, assistant, other) and four times its fault.
INITIALS, OTHER = "sua", 3
FINE, CUT, BLANK, DUPLICATE = range(4)
TURNS = 16
#: From each state: where a kept system, user, assistant or other turn leads, and where the one wanted role does.
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
NEXT = (2, 2, 3, 2)
WANTED = ("user", "user", "assistant", "user")
NEVER = float("inf")

Vector = tuple[float, ...]


class Automaton:
    """The deterministic automaton as far as turns have asked for it. State 0 is the end of a conversation."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.number(self._inserted([0, NEVER, NEVER, 0]))

    def number(self, vector: Vector) -> int:
        at = self.numbers.get(vector)
        if at is None:
            at = self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * TURNS)
        return at

    @staticmethod
    def _inserted(costs: list[float]) -> Vector:
        """Costs if turns may be inserted first; three of them lead through all states."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return tuple(costs)

    def arcs(self, q: int, turn: int, after: Vector) -> list[tuple[str, float, int]]:
        """(letter, cost with what follows, state) of what may be done with a turn."""
        fault, initial = divmod(turn, 4)
        out = [("D", DELETE + after[q], q)]
        if fault in (FINE, CUT):
            more, to = TRUNCATED * (fault == CUT), KEPT[q][initial]
            if to is not None:
                out.append(("K", more + after[to], to))
            out.append(("R", REROLE + more + after[NEXT[q]], NEXT[q]))
        return out

    def step(self, state: int, turn: int) -> tuple[int, int]:
        """The state before ``turn`` and the cost taken off its vector."""
        found = self.table[state][turn]
        if found is None:
            after = self.vectors[state]
            costs = self._inserted([min(c for _, c, _ in self.arcs(q, turn, after)) for q in range(4)])
            least = int(min(costs))
            found = self.table[state][turn] = (self.number(tuple(c - least for c in costs)), least)
        return found

    @cache  # noqa: B019 - one automaton a worker
    def trace(self, state: int, turn: int, q: int) -> tuple[str, int]:
        """The least letters from ``q`` up to and with ``turn``, which ``state`` follows, and where they lead."""
        before, off = self.step(state, turn)
        costs, letters = self.vectors[before], ""
        while True:
            tight = {letter: to for letter, c, to in self.arcs(q, turn, self.vectors[state]) if c == costs[q] + off}
            if "D" in tight:
                return letters + "D", q
            if costs[q] == INSERT + costs[NEXT[q]]:
                letters, q = letters + "I", NEXT[q]
                continue
            letter = min(tight)
            return letters + letter, tight[letter]

    @cache  # noqa: B019
    def tail(self, q: int) -> str:
        """Turns to insert at the end."""
        out = ""
        while self.vectors[0][q]:
            out, q = out + "I", NEXT[q]
        return out

    def solve(self, turns: bytes) -> tuple[int, str]:
        """The least cost and the least letters of that cost."""
        state, off, states = 0, 0, [0]
        for t in reversed(turns):
            state, c = self.table[state][t] or self.step(state, t)
            off += c
            states.append(state)
        q, out = 0, []
        for t, state in zip(turns, states[-2::-1], strict=True):
            letters, q = self.trace(state, t, q)
            out.append(letters)
        return off + int(self.vectors[states[-1]][0]), "".join(out) + self.tail(q)


@cache
def automaton() -> Automaton:
    """One a worker, so that conversations share what others made."""
    return Automaton()


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): turns with faults put in, by crc32 of ``conv_id:turn`` modulo 20.

    0: the turn goes (times 0), 1: its text is empty, 2: its text loses ``.!?``, 3: it is there
    twice, 4: its role is user. A null role, text or part of that key is one space.
    """
    blank = F.lit(" ")
    conv, turn = F.col(id_col).cast("long"), F.col(turn_col).cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("what"))
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.cast("long").alias("times"))


def _faced(turns: DataFrame) -> DataFrame:
    """``turns`` with two hashes of role and text, and the turn as a byte, in which repeats aren't told yet."""
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == INITIALS[0], 0).when(initial == INITIALS[1], 1).when(initial == INITIALS[2], 2).otherwise(OTHER)
    return turns.withColumn("h", F.xxhash64("role", "text")).withColumn("g", F.xxhash64(F.lit(1), "text", "role")).withColumn("face", place + 4 * fault)


#: Nulls come first.
ORDER = ["conv_id", "turn", "h", "g"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation in a range: its turns as bytes, its first and last turn number and how many it has."""
    part = TaskContext.get().partitionId()
    now, turns, lo, hi, n, some = None, bytearray(), None, None, 0, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": now, "part": part, "turns": bytes(turns), "lo": lo, "hi": hi, "n": n}], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("turns", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())]))

    for b in batches:
        made = []
        for conv, turn, face, times, first in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "face", "times", "first")), strict=True):
            if not some or conv != now:
                if some:
                    made.append(row())
                now, turns, lo, hi, n, some = conv, bytearray(), None, None, 0, True
            if not times:
                continue
            if turn is not None and turn != hi:
                lo, hi, n = turn if lo is None else lo, turn, n + 1
            again = face if face // 4 == BLANK else face % 4 + 4 * DUPLICATE
            turns.append(face if first else again)
            turns += bytes([again]) * (times - 1)
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if some:
        yield row()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = automaton()
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    for b in batches:
        out = []
        for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            turns = b"".join(p["turns"] for p in parts)
            numbered = [p for p in parts if p["n"]]
            distinct = sum(p["n"] for p in numbered) - sum(x["hi"] == y["lo"] for x, y in zip(numbered, numbered[1:], strict=False))
            gaps = numbered[-1]["hi"] - numbered[0]["lo"] + 1 - distinct if numbered else 0
            faces = np.frombuffer(turns, np.uint8)
            faults = np.bincount(faces // 4, minlength=4).tolist()
            roles = faces % 4
            illegal = len(roles[1:]) - int(legal[roles[:-1], roles[1:]].sum())
            out.append((conv, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, *made.solve(turns)))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(cols)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def plans(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``turns`` has conv_id, turn (longs), role, text (not null) and times, how often a row is
    there; of rows with 0 only the conversation's id counts. A conversation's turns are in
    the order of turn, nulls first, and of equal ones by a hash of role and text; equal rows
    are adjacent. The first fault of a turn counts: blank, duplicate (role and text stood
    earlier), truncated (doesn't end in ``.!?``). gaps counts the missing turn numbers,
    illegal the adjacent roles that aren't system-user, user-assistant or assistant-user.
    The edits are Keep (0), Rerole to user or assistant (3), Delete (4, the only one for blank
    and duplicate turns) and Insert of an empty turn of either (3); a truncated turn that stays
    costs 3. audit has the initials of the cheapest edits in order, the least in ASCII of
    equally cheap ones; so it has a letter a turn and that is also what a task holds of
    its longest conversation: texts don't come along.

    Equal rows are counted before they are sorted, and the sort deals a conversation of any
    share of the table over as many ranges as it needs. A null conv_id is a conversation.
    Without turns all counts are 0 and audit is empty. An empty table gives no rows.
    """
    keys = ["conv_id", "turn", "h", "g", "face"]
    rows = _faced(turns).groupBy(*keys).agg(F.sum("times").alias("times"))
    same = rows.where("times > 0").groupBy("conv_id", "h", "g", "face").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    firsts = same.select("conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "h", "g", "face", F.lit(0).cast("long").alias("times"), F.lit(True).alias("first"))
    rows = rows.withColumn("first", F.lit(False)).union(firsts).groupBy(*keys).agg(F.sum("times").alias("times"), F.max("first").alias("first"))
    parts = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_segments, "conv_id long, part int, turns binary, lo long, hi long, n long")
    # a conversation has a part in each range that it reaches into, most of them one
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns", "lo", "hi", "n"))).alias("parts"))
    return whole.mapInArrow(_solved, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit first: the turns that the audit leaves, in order."""
    letters, at, q, conv, place = "", 0, 0, None, 0
    for b in batches:
        out: list[tuple] = []

        def put(edit: str, role: str, text: str, turn: int | None, out=out) -> None:
            nonlocal place
            out.append((conv, place, edit, turn, role, text))
            place += 1

        def inserted() -> None:
            nonlocal at, q
            while at < len(letters) and letters[at] == "I":
                put("I", WANTED[q], "", None)
                at, q = at + 1, NEXT[q]

        for kind, new, audit, turn, role, text, face, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not kind:
                letters, at, q, conv, place = audit, 0, 0, new, 0
                if letters.count("I") == len(letters):
                    inserted()
                continue
            for _ in range(times):
                inserted()
                edit, at = letters[at], at + 1
                if edit == "K":
                    put("K", role, text, turn)
                    q = KEPT[q][face % 4]
                elif edit == "R":
                    put("R", WANTED[q], text, turn)
                    q = NEXT[q]
            if at < len(letters) and letters.find("I", at) == at and letters.count("I", at) == len(letters) - at:
                inserted()
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns that ``found`` (of ``plans``) leaves, place from 0; inserted ones have no turn number.

    Rows come by conversation and place within partitions. They stream through: a task
    holds a batch and one audit, whatever a conversation's length. Conversations of which
    nothing is left have no rows.
    """
    null = F.lit(None)
    heads = found.select(F.lit(0).alias("kind"), "conv_id", "audit", null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("int").alias("face"), null.cast("long").alias("times"), null.cast("long").alias("h"), null.cast("long").alias("g"))
    body = _faced(turns.where("times > 0")).select(F.lit(1).alias("kind"), "conv_id", null.cast("string").alias("audit"), "turn", "role", "text", "face", "times", "h", "g")
    rows = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "h", "g")
    return rows.drop("h", "g").mapInArrow(_edited, "conv_id long, place long, edit string, turn long, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order: the digest of each conversation's ``role:text`` lines."""
    now, digest = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], ["of", "repaired_sha256"])

    for b in batches:
        out = []
        for conv, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text")), strict=True):
            if not place:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            digest.update(f"{'\n' if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield batch(out)
    if digest is not None:
        yield batch([(now, digest.hexdigest())])


def repair(turns: DataFrame) -> DataFrame:
    """``plans`` with repaired_sha256, the digest of the repaired ``role:text`` joined by newlines; of nothing, that of the empty string.

    Nulls, repeats, ties and empty tables are as ``plans`` says.
    """
    found = materialize(plans(turns), "plans")
    digests = repaired(turns, found).mapInArrow(_hashed, "of long, repaired_sha256 string")
    rows = found.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
