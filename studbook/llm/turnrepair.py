"""Cheapest repair of the turn structure of conversations, streamed in turn order.

Turns are dealt out by conversation and sorted by turn. A task reads them batch by batch and carries, for each state of the
automaton of `(s?(ua)+)?`, the cost of the cheapest edits that lead there, the order of their texts, and the hash of the turns
they leave. What a turn does to these depends on its role and faults only, and the costs differ by few points, so the steps
are looked up in a table that fills as they occur. Each turn leaves one number of two bytes, the step taken; when the
conversation ends, the edits are read from these backwards. The numbers of a giant conversation go to an unnamed file of the
task (deleted with it, nobody else reads it) instead of memory.

Edits: keep 0, set the role to user or assistant 3, delete 4, insert an empty user or assistant turn 3. Blank and duplicate
turns must be deleted; a truncated one that stays adds 3. Among the cheapest, the least text of initials (D, I, K, R) wins.
Two edit texts that lead to different states after the same turns differ before either ends, so their order never changes.

Rows without a conv_id form one conversation with a null id. Turns with equal (conv_id, turn) go by role, then by the digest
of the text; equal ones are duplicates of the first. A kept turn whose role has no characters adds no initial. An empty table
gives no rows. Texts are never held beyond their batch. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
# A role without characters adds no initial, so it changes no state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3} | {(s, ""): s for s in range(4)}
FILL = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}
HELD_STEPS = 1 << 22   # step numbers kept in memory; the rest of a conversation's goes to a file
OUT_ROWS = 4_000
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Fault = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}


def damaged(conversations: DataFrame, chance: Column) -> DataFrame:
    """(conv_id, turn, role, text, here): rows after damage number `chance`; a dropped row stays with here = false.

    0 drops the row, 1 empties its text, 2 removes `.!?` from it, 3 repeats the row, 4 makes its role user.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), chance.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("damage") == 0, "").otherwise(text).alias("text"), (F.col("damage") != 0).alias("here"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text, here), dealt by conversation and in order, with the number of their first fault."""
    dealt = turns.withColumn("digest", F.md5("text")).repartition("conv_id")
    # A conversation is in one partition already, so this window sorts but moves nothing.
    seen = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), Fault["blank"]).when(F.col("seen") > 1, Fault["duplicate"]).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), Fault["truncated"]).otherwise(0)
    faulty = dealt.withColumn("seen", seen).withColumn("fault", fault.cast("int"))
    ordered = faulty.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "seen")
    # As texts, since pandas makes floats of a long column with nulls.
    return ordered.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "here", "fault")


class Steps:
    """What one turn does to the best edits of each state.

    A configuration is, per state, (cost above the least, place among the texts) or None. A step leads from a configuration
    and a kind of turn to the next one; `moves[step]` has for each state that can be reached (state before, inserts, edit).
    """

    def __init__(self):
        self.configurations: list[tuple] = [((0, 0), None, None, None)]
        self.number = {self.configurations[0]: 0}
        self.table: dict[tuple[int, str, int], tuple[int, int, int]] = {}
        self.moves: list[tuple] = []

    def step(self, configuration: int, initial: str, fault: int) -> tuple[int, int, int]:
        """(next configuration, cost of its least state, number of the step)."""
        key = (configuration, initial, fault)
        if key not in self.table:
            self.table[key] = self._make(*key)
        return self.table[key]

    def _reached(self, configuration: int) -> Iterator[tuple[int, int, int, str, int]]:
        """(cost, place, state before, inserts, state) with up to two inserted turns."""
        for before, held in enumerate(self.configurations[configuration]):
            if held is not None:
                state = before
                for inserts in range(3):
                    yield held[0] + inserts * INSERT, held[1], before, "I" * inserts, state
                    state = FILL[state][1]

    def _make(self, configuration: int, initial: str, fault: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}
        stays = TRUNCATED if fault == Fault["truncated"] else 0
        for cost, place, before, inserts, state in self._reached(configuration):
            options = [(DELETE, "D", state)]
            if fault not in (Fault["blank"], Fault["duplicate"]):
                options.append((REROLE + stays, "R", FILL[state][1]))
                if (state, initial) in NEXT:
                    options.append((KEEP + stays, "K", NEXT[state, initial]))
            for price, edit, after in options:
                found = (cost + price, place, inserts + edit, before)
                best[after] = min(best.get(after, found), found)
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
        if after not in self.number:
            self.number[after] = len(self.configurations)
            self.configurations.append(after)
        self.moves.append(tuple((best[s][3], best[s][2]) if s in best else None for s in range(4)))
        return self.number[after], least, len(self.moves) - 1

    def finish(self, configuration: int) -> tuple[int, int, str]:
        """(cost, state before, inserts) of the cheapest end."""
        ends = [(cost, place, inserts, before) for cost, place, before, inserts, state in self._reached(configuration) if state in ACCEPTED]
        cost, _, inserts, before = min(ends)
        return cost, before, inserts


class Conversation:
    """The state of one conversation between its turns."""

    def __init__(self, conv_id: int | None, steps: Steps):
        self.conv_id, self.steps = conv_id, steps
        self.configuration = self.cost = self.illegal = self.distinct = 0
        self.faults = [0, 0, 0, 0]
        self.lowest = self.highest = self.initial = None
        self.left = [(hashlib.sha256(), ""), None, None, None]   # hash of the lines, and what parts the next one from them
        self.numbers, self.file = array("H"), None

    def turn(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.distinct += turn != self.highest
            self.lowest, self.highest = turn if self.lowest is None else self.lowest, turn
        self.configuration, least, step = self.steps.step(self.configuration, initial if initial in "sua" else "other", fault)
        self.cost += least
        self.numbers.append(step)
        if len(self.numbers) >= HELD_STEPS:
            self.file = self.file or tempfile.TemporaryFile()
            self.numbers.tofile(self.file)
            self.numbers = array("H")
        self._leave(self.steps.moves[step], role, text)

    def _leave(self, moves: tuple, role: str, text: str) -> None:
        left, body = [None] * 4, None
        for after, move in enumerate(moves):
            if move is None:
                continue
            before, edits = move
            (made, gap), state = self.left[before], before
            made = made.copy()
            for edit in edits:
                if edit == "D":
                    continue
                name = role
                if edit != "K":
                    name, state = NAMES[FILL[state][0]], FILL[state][1]
                made.update(f"{gap}{name}:".encode())
                gap = "\n"
                if edit != "I":
                    body = text.encode() if body is None else body
                    made.update(body)
            left[after] = made, gap
        self.left = left

    def _numbers_backwards(self) -> Iterator[int]:
        yield from reversed(self.numbers)
        if self.file is not None:
            size = array("H").itemsize * HELD_STEPS
            at = self.file.tell()
            while at:
                at -= size
                self.file.seek(at)
                held = array("H")
                held.fromfile(self.file, HELD_STEPS)
                yield from reversed(held)
            self.file.close()

    def row(self) -> tuple:
        cost, state, inserts = self.steps.finish(self.configuration)
        (made, gap), at = self.left[state], state
        for _ in inserts:
            made.update(f"{gap}{NAMES[FILL[at][0]]}:".encode())
            gap, at = "\n", FILL[at][1]
        edits = [inserts]
        for step in self._numbers_backwards():
            state, made_of = self.steps.moves[step][state]
            edits.append(made_of)
        edits.reverse()
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.distinct
        return self.conv_id, gaps, self.faults[1], self.faults[2], self.faults[3], self.illegal, self.cost + cost, "".join(edits), made.hexdigest()


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps, held, out = Steps(), None, []
    names = [c.split()[0] for c in _OUT.split(", ")]

    def ready() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[:-2]})
        out.clear()
        return frame

    for frame in frames:
        columns = [frame[c].astype("object").where(frame[c].notna(), None).tolist() for c in ("conv_id", "turn", "role", "text", "here", "fault")]
        for conv_id, turn, role, text, here, fault in zip(*columns):
            conv_id = None if conv_id is None else int(conv_id)
            if held is None or conv_id != held.conv_id:
                if held is not None:
                    out.append(held.row())
                    if len(out) >= OUT_ROWS:
                        yield ready()
                held = Conversation(conv_id, steps)
            if here:
                held.turn(None if turn is None else int(turn), role, text, int(fault))
    if held is not None:
        out.append(held.row())
    yield ready()


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text, here): faults counted, the cheapest edits, and the
    SHA-256 of the repaired `role:text` lines. A conversation without any turn here has zeros and empty texts."""
    return with_faults(turns).mapInPandas(_repair, _OUT)
