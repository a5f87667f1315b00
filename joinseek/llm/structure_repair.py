"""Conversations whose roles are out of order, and their cheapest repair by iterative-deepening A*.

A repair keeps, renames, deletes or inserts turns until the initials of the roles
read ``(s?(ua)+)?``. The search goes depth-first in the ASCII order of the edits'
initials under a bound on the cost; if it fails the bound rises to the least cost
that exceeded it. What was proven of a state, that no repair from it costs less
than so much, is kept in a table over all bounds. The first path that is accepted
is the answer: of the cheapest repairs the one whose edits come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.session import quoted

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits, and what a truncated turn that is not deleted adds.
DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: What a turn suffers from.
SOUND, CUT, MUST_GO = 0, 1, 2
#: States of the reader of role initials, and the number of one that ends well.
START, SYSTEM, USER, ASSISTANT, ACCEPT = range(5)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a turn of the initial leads, from each state.
READS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Where the role that has to come next leads; it is the one to insert or rename to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 60

Edit = tuple[str, int]


def _floor(turns: Sequence[tuple[str, int]], goal: int) -> list[tuple[int, int, int, int]]:
    """Lower bounds on the cost from each turn on, by state.

    They are the exact costs in a simpler problem, in which system turns are kept
    anywhere before a user turn; so they never exceed the true cost. A block that
    is to end before any user turn has all but one system turn deleted.
    """
    if goal in (START, SYSTEM):
        rest, system = 4 * [FAR], False
        rest[goal] = 0
        bounds = [tuple(rest)]
        for number, (initial, fault) in enumerate(reversed(turns), 1):
            system = system or (initial == "s" and fault != MUST_GO)
            rest[goal] = DELETE * number
            if goal == SYSTEM and system:
                rest[START] = DELETE * (number - 1)
            bounds.append(tuple(rest))
        bounds.reverse()
        return bounds
    # From where u comes next, and from where a does; behind the last turn of a block nothing is inserted.
    if goal == ACCEPT:
        u, a = 0, INSERT
    else:
        u, a = (FAR, 0) if goal == USER else (0, FAR)
    bounds = [(u, u, a, u)]
    for initial, fault in reversed(turns):
        to_u, to_a = DELETE + u, DELETE + a
        if fault != MUST_GO:
            stay = TRUNCATED if fault == CUT else 0
            to_u = min(to_u, stay + a + (0 if initial == "u" else RENAME))
            to_a = min(to_a, stay + u + (0 if initial == "a" else RENAME))
            if initial == "s":
                to_u = min(to_u, stay + u)
        u, a = min(to_u, INSERT + to_a), min(to_a, INSERT + to_u)
        bounds.append((u, u, a, u))
    bounds.reverse()
    return bounds


def search(turns: Sequence[tuple[str, int]], start: int = START, goal: int = ACCEPT) -> tuple[int, list[Edit]] | None:
    """(cost, edits) of the cheapest repair, the ASCII-least of several; None if there is none.

    ``turns`` are pairs of role initial and fault. An edit is its initial and the
    state it leads to. With a goal other than ``ACCEPT`` the edits must end in
    that state, with none after the last turn; blocks of turns are joined that way.
    """
    total = len(turns)
    floor = _floor(turns, goal)
    proven: dict[int, int] = {}

    def least(at: int, state: int) -> int:
        return proven.get(at * 4 + state, floor[at][state])

    def moves(at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, turn, state) in ASCII order."""
        found = []
        if at < total:
            found.append(("D", DELETE, at + 1, state))
        if at < total or goal == ACCEPT:
            found.append(("I", INSERT, at, NEXT[state]))
        if at < total and turns[at][1] != MUST_GO:
            stay = TRUNCATED if turns[at][1] == CUT else 0
            read = READS[state].get(turns[at][0])
            if read is not None:
                found.append(("K", stay, at + 1, read))
            found.append(("R", stay + RENAME, at + 1, NEXT[state]))
        return found

    def done(at: int, state: int) -> bool:
        return at == total and (state in (START, ASSISTANT) if goal == ACCEPT else state == goal)

    while (bound := least(0, start)) < FAR:
        # Frames of the depth-first search: turn, state, cost left, moves, the next of them, least excess.
        path: list[Edit] = []
        if done(0, start):
            return 0, path
        stack = [[0, start, bound, moves(0, start), 0, FAR]]
        while stack:
            frame = stack[-1]
            at, state, left, options, number, excess = frame
            if number == len(options):
                proven[at * 4 + state] = max(excess, least(at, state))
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[5] = min(above[5], above[3][above[4] - 1][1] + proven[at * 4 + state])
                continue
            frame[4] += 1
            edit, cost, to, into = options[number]
            need = cost + least(to, into)
            if need > left:
                frame[5] = min(excess, need)
                continue
            path.append((edit, into))
            if done(to, into):
                return bound, path
            stack.append([to, into, left - cost, moves(to, into), 0, FAR])
    return None


@dataclass
class _Branch:
    """The cheapest repair so far that ends in one state."""

    cost: int
    audit: tuple | None  # edits so far, as (earlier, text) pairs
    digest: object
    empty: bool

    def text(self) -> str:
        parts, at = [], self.audit
        while at is not None:
            parts.append(at[1])
            at = at[0]
        return "".join(reversed(parts))


@dataclass
class Conversation:
    """Reads the turns of one conversation in order and finds its repair.

    Up to ``block`` turns are held and searched as a whole. Of a longer
    conversation, each block is searched from every state in which the one before
    may end to every other, and only the best repair per state goes on, with a
    running digest of its text; so the texts held do not grow with the length.
    """

    block: int
    turns: list[tuple[str, str, int]] = field(default_factory=list)
    branches: dict[int, _Branch] = field(default_factory=lambda: {START: _Branch(0, None, hashlib.sha256(), True)})
    faults: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    distinct: int = 0
    first: int | None = None
    last: int | None = None
    initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int, kind: int) -> None:
        """``kind`` is 0 for a sound turn, else the place of its fault among blank, duplicate, truncated, from 1."""
        if kind:
            self.faults[kind - 1] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if len(self.turns) == self.block:
            self._close((START, SYSTEM, USER, ASSISTANT))
        self.turns.append((role, text, fault))

    def _close(self, goals: Sequence[int]) -> None:
        turns = [(role[:1], fault) for role, _, fault in self.turns]
        after = {}
        for goal in goals:
            best = None
            for start, branch in self.branches.items():
                found = search(turns, start, goal)
                if found is None:
                    continue
                edits = "".join(edit for edit, _ in found[1])
                if best is not None and branch.cost + found[0] > best[0]:
                    continue
                if best is not None and branch.cost + found[0] == best[0] and branch.text() + edits >= best[1].text() + best[2]:
                    continue
                best = (branch.cost + found[0], branch, edits, found[1])
            if best is not None:
                after[goal] = self._extended(*best)
        self.branches, self.turns = after, []

    def _extended(self, cost: int, branch: _Branch, edits: str, path: Sequence[Edit]) -> _Branch:
        digest, empty, at = branch.digest.copy(), branch.empty, 0
        for edit, into in path:
            if edit == "D":
                at += 1
                continue
            role, text = (NAMES[into], "") if edit == "I" else self.turns[at][:2]
            if edit == "R":
                role = NAMES[into]
            at += edit != "I"
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            empty = False
        return _Branch(cost, (branch.audit, edits), digest, empty)

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        self._close((ACCEPT,))
        best = self.branches[ACCEPT]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.faults, self.illegal, best.cost, best.text(), best.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone): the conversations after damage drawn from crc32 of ``conv_id:turn``.

    A null id, turn, role or text is one blank, in what is drawn from too; a null turn
    has no place in the order. Rows that are dropped are there with ``gone``, so
    that no conversation is lost.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    drawn = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced["role"].alias("role"), spaced["text"].alias("text"), drawn.alias("drawn")
    )
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("drawn") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _kind(seen_before: Column) -> Column:
    """The first fault of a turn: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANK)), F.lit(1))
    kind = F.when(F.btrim("text", F.lit(BLANK)) == "", 1).when(seen_before, 2)
    return kind.when(~end.isin(*ENDS), 3).otherwise(0)


def repairs(turns: DataFrame, block: int = 1024) -> DataFrame:
    """Faults and the cheapest repair of every conversation.

    ``turns`` has (conv, turn, role, text, gone). Result: (conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows are taken by turn, missing ones first, those of equal turn by role and
    text. Duplicates are found by a sort on role and text, which deals a long
    conversation over many tasks; then each conversation passes through one task as
    a sorted stream, since a digest of its whole text has to, and is held in
    blocks of ``block`` turns only.
    """
    whole = turns.withColumn("digest", F.sha2(F.concat_ws("\0", F.octet_length("role").cast("string"), "role", "text"), 256))
    earlier = F.expr("row_number() OVER (PARTITION BY conv, gone, digest ORDER BY turn) > 1")
    marked = whole.select("conv", "turn", "role", "text", "gone", earlier.alias("again"))
    marked = marked.select("conv", "turn", "role", "text", "gone", _kind(F.col("again")).alias("kind"), "again")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]
    streams = marked.repartition("conv").sortWithinPartitions(*order)
    conv_type = turns.schema["conv"].dataType
    schema = (
        f"conv {conv_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    to_go = {1: MUST_GO, 2: MUST_GO, 3: CUT, 0: SOUND}

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, arrow_type = None, None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [arrow_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            arrow_type = batch.schema.field(0).type
            done = []
            for conv, turn, role, text, gone, kind, _ in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        done.append((key, *now.result()))
                    key, now = conv, Conversation(block)
                if not gone:
                    now.add(turn, role, text, to_go[kind], kind)
            if done:
                yield made(done)
        if now is not None:
            yield made([(key, *now.result())])

    return streams.mapInArrow(repaired, schema)


def repaired_conversations(conversations: DataFrame, block: int = 1024) -> DataFrame:
    """The repair of every conversation after damage, by conv_id; see ``damaged`` and ``repairs``.

    Every conv_id has a row, the null one too; one without rows after damage has
    zeros, an empty audit and the digest of the empty text. Equal rows are turns
    of their own, of which all but the first are duplicates. An empty table gives
    an empty one. Columns other than conv_id, turn, role and text are not read.
    """
    found = repairs(damaged(conversations), block)
    return found.select(F.col("conv").alias("conv_id"), *(quoted(c) for c in found.columns if c != "conv"))
