"""Repair of conversations by a Viterbi search whose edits leave as soon as all survivors agree on them.

The roles of a conversation shall read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn. Edits of a
row: Keep (0), Rerole to user or assistant (3), Delete (4; the only choice for blank and duplicate rows); in front of any
row and at the end Insert an empty user or assistant turn (3). A truncated row that stays costs 3 more. The cheapest
sequence wins; of equally cheap ones the one whose initials come first in ASCII.

The search has four states, by what has been written last: nothing, system, user, assistant. Each has one survivor, the
leaf of a tree of edits that point back to their predecessors. Two paths into one state at equal cost are compared edit by
edit from their last common one, so ties are decided on all that is unresolved. Edits count what refers to them; a path
that loses is freed up to the last edit that others share, and the edits that all survivors share are given out and
forgotten. A state whose survivor can't win any more is dropped: all that may follow a system turn or nothing may also
follow an assistant turn, at a cost of at most one Delete more. Runs of Deletes are one node with a count. So what
is held is the unresolved part, not the conversation.

Rows of a conversation are dealt by its id, sorted and streamed through the search: a SHA-256 over all of a conversation can
only be taken in order, by one task, but that task holds one batch of rows. Faults are found before, by Spark's
functions: duplicates by the earliest turn of each (conversation, role, text), combined before the shuffle.

Nulls in role and text are one space (also in the damage's key, where a null id or turn is one space too). A null id is a
conversation of its own. Null turns come first; rows of one turn come by role and text. A role that does not begin with
s, u or a can't be kept. Rows that repeat are rows; a conversation without rows left has zeros, an empty audit and the hash
of an empty text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FINAL = (NOTHING, ASSISTANT)


class Edit:
    """An edit (``times`` Deletes in a row are one), its predecessor, and what refers to it: later edits and survivors."""

    __slots__ = ("initial", "times", "turn", "before", "depth", "after", "held")

    def __init__(self, initial: str, turn: tuple[str, str] | None, before: "Edit | None"):
        self.initial, self.times, self.turn, self.before = initial, 1, turn, before
        self.depth = before.depth + 1 if before else 0
        self.after, self.held = [], 0
        if before:
            before.after.append(self)


def spelled(a: Edit, b: Edit) -> tuple[list, list]:
    """Initials with their counts of two paths from their last common edit on."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append((a.initial, a.times))
            a = a.before
        else:
            right.append((b.initial, b.times))
            b = b.before
    return left[::-1], right[::-1]


def earlier(a: Edit, b: Edit) -> bool:
    """Whether the path to ``a`` comes before the path to ``b`` in ASCII order."""
    left, right = spelled(a, b)
    i = j = 0
    while i < len(left) and j < len(right):
        (x, m), (y, n) = left[i], right[j]
        if x != y:
            return x < y
        step = min(m, n)
        left[i], right[j] = (x, m - step), (y, n - step)
        i, j = i + (m == step), j + (n == step)
    return i == len(left) and j < len(right)


class Repair:
    """The search over one conversation; ``give(initial, times, turn)`` gets the edits in order."""

    def __init__(self, give: Callable[[str, int, tuple[str, str] | None], None]):
        self.give = give
        self.root = Edit("", None, None)
        self.root.times, self.root.held = 0, 1
        self.live: dict[int, tuple[int, Edit]] = {NOTHING: (0, self.root)}

    def _free(self, edit: Edit) -> None:
        edit.held -= 1
        while not edit.held and not edit.after and edit.before:
            edit.before.after.remove(edit)
            edit = edit.before

    def _offer(self, found: dict, state: int, cost: int, edit: Edit) -> None:
        """Enter a path into ``found`` unless a better one leads to its state; ``edit`` may be dropped."""
        edit.held += 1
        old = found.get(state)
        if old and (old[0] < cost or (old[0] == cost and not earlier(edit, old[1]))):
            self._free(edit)
            return
        found[state] = (cost, edit)
        if old:
            self._free(old[1])

    def _inserted(self) -> None:
        """Survivors after any Inserts. Two lead from nothing to assistant; more never pay."""
        for state in (NOTHING, SYSTEM, ASSISTANT, USER, ASSISTANT):
            if state in self.live:
                cost, edit = self.live[state]
                for to in AFTER[state]:
                    if to != SYSTEM and (to not in self.live or cost + INSERT <= self.live[to][0]):
                        self._offer(self.live, to, cost + INSERT, Edit("I", (NAMES[to], ""), edit))

    def row(self, role: str, text: str, fault: int) -> None:
        self._inserted()
        found: dict[int, tuple[int, Edit]] = {}
        extra = TRUNCATED if fault == CUT else 0
        if fault not in (BLANK, DUPLICATE):
            for state, (cost, edit) in self.live.items():
                for to in AFTER[state]:
                    if INITIAL.get(role[:1]) == to:
                        self._offer(found, to, cost + KEEP + extra, Edit("K", (role, text), edit))
                    elif to != SYSTEM:
                        self._offer(found, to, cost + REROLE + extra, Edit("R", (NAMES[to], text), edit))
        for state, (cost, edit) in self.live.items():
            if state in found and found[state][0] < cost + DELETE:
                continue
            if edit.initial == "D" and edit.held == 1 and not edit.after and state not in found:
                edit.times += 1
                self._offer(found, state, cost + DELETE, edit)
            else:
                self._offer(found, state, cost + DELETE, Edit("D", None, edit))
        for _, edit in self.live.values():
            self._free(edit)
        self.live = found
        self._drop_hopeless()
        self._give_shared()

    def _drop_hopeless(self) -> None:
        if ASSISTANT in self.live:
            best = self.live[ASSISTANT][0]
            for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
                if state in self.live and best + more < self.live[state][0]:
                    self._free(self.live.pop(state)[1])

    def _give_shared(self) -> None:
        """Give out what all survivors share. The root is given; Deletes counted on it since are shared too."""
        while True:
            if self.root.times:
                self.give(self.root.initial, self.root.times, self.root.turn)
                self.root.times = 0
            if self.root.held or len(self.root.after) != 1:
                return
            self.root = self.root.after[0]
            self.root.before = None

    def end(self) -> int:
        """Give out the rest; the cost of all edits."""
        self._inserted()
        best = None
        for state in FINAL:
            if state in self.live:
                cost, edit = self.live[state]
                if best is None or cost < best[0] or (cost == best[0] and earlier(edit, best[1])):
                    best = (cost, edit)
        rest, edit = [], best[1]
        while edit is not None and edit is not self.root:
            rest.append(edit)
            edit = edit.before
        for edit in reversed(rest):
            self.give(edit.initial, edit.times, edit.turn)
        return best[0]


class Conversation:
    """Counts and repair of one conversation, fed row by row."""

    def __init__(self):
        self.audit, self.sha, self.turns = [], hashlib.sha256(), 0
        self.low = self.high = self.last_turn = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.previous = self.seen = None
        self.repair = Repair(self.take)

    def take(self, initial: str, times: int, turn: tuple[str, str] | None) -> None:
        self.audit.append(initial * times)
        if turn:
            self.sha.update(("\n" if self.turns else "").encode() + f"{turn[0]}:{turn[1]}".encode("utf-8", "surrogatepass"))
            self.turns += 1

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last_turn
            self.high = self.last_turn = turn
        if fault not in (BLANK, DUPLICATE) and self.seen == (turn, role, text):
            fault = DUPLICATE  # the copy of a row within its turn
        self.seen = (turn, role, text)
        self.faults[fault] += 1
        if self.previous is not None:
            self.illegal += self.previous + role[:1] not in ("su", "ua", "au")
        self.previous = role[:1]
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, gone): rows as the damage leaves them; a dropped row stays, marked and without text."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    damage = (F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20).alias("damage")
    held = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), blank(role).alias("role"), blank(text).alias("text"), damage)
    is_ = lambda n: F.col("damage") == n
    body = F.when(is_(0) | is_(1), "").when(is_(2), F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    times = F.when(is_(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return held.select("conv", "turn", F.when(is_(4), "user").otherwise(F.col("role")).alias("role"), body.alias("text"), is_(0).alias("gone"),
                       F.explode(times).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, gone) with ``fault``; copies of a row within its turn are found by their neighbour later."""
    content = F.rtrim("text", F.lit(SPACE))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("h", F.when(~F.col("gone"), F.sha2("text", 256)))
    firsts = keyed.filter("NOT gone").groupBy("conv", "role", "h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    a, b = keyed.alias("a"), firsts.alias("b")
    both = a.join(b, F.expr("a.conv <=> b.conv AND a.role = b.role AND a.h = b.h"), "left").select("a.*", "b.first")
    again = F.coalesce(place > F.col("first"), F.lit(False))
    fault: Column = F.when(content == "", BLANK).when(again, DUPLICATE).when(~F.right(content, F.lit(1)).isin(*ENDINGS), CUT).otherwise(0)
    return both.select("conv", "turn", "role", "text", "gone", fault.alias("fault"))


RESULT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def repaired(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, gone, fault)."""
    kind = rows.schema["conv"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *(f.split()[0] for f in RESULT.split(", "))]
        types = [pa.null(), *[pa.int64()] * 6, pa.string(), pa.string()]
        key, talk, done = None, None, []
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for c, turn, role, text, gone, fault in zip(*(column.to_pylist() for column in batch.columns)):
                if talk is None or c != key:
                    if talk is not None:
                        done.append((key, *talk.result()))
                    key, talk = c, Conversation()
                if not gone:
                    talk.row(turn, role, text, fault)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if talk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, *talk.result()), types)], names)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(each, f"conv {kind}, {RESULT}").withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The damage, and its repair: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repaired(with_faults(damaged(rows, conv, turn, role, text)), conv)
