"""Operator 12: repair of conversation structure by a Viterbi search with survivor coalescence.

A repaired conversation's role initials read ``(s?(ua)+)?``. Rows are kept (free), given the other role
(1) or deleted (2, a must for blank and duplicate ones), turns may be inserted anywhere (5), and a truncated
row that stays costs 5. The cheapest edits count, of equally cheap ones those whose initials D, I, K, R come
first in ASCII order.

The search keeps one survivor for each state of the pattern. Survivors are leaves of a tree of
back-pointers whose nodes count their references, so edits that no survivor uses go at once; where all
survivors share an ancestor, the edits up to it are final and leave the tree. Memory thus holds what is
unresolved only, with runs of forced deletions as one node, however long a conversation is. A survivor goes
when it costs more than another one with all that may lie between their states. (Rows that leave two ways
open, say with a fault at every third row, stay in the tree until a later row decides.) Equally cheap
candidates of one state are compared over their whole unresolved edits. Of two such, neither begins with
all of the other (they would differ by insertions, thus in cost), so what wins now wins for ever.

Which rows repeat an earlier one is found by aggregation over (conversation, digest). The rows of a
conversation then stream through one task in order, as the digest of its repaired text needs: a hash in
sequence can't be split. Nothing of a conversation is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
_BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_WANTED = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
# The most by which finishing from a state can cost more than from another: _BRIDGE[state][other].
_BRIDGE = {START: {SYSTEM: 0, USER: 5, ASSISTANT: 0}, SYSTEM: {START: 10, USER: 5, ASSISTANT: 10},
           USER: {START: 7, SYSTEM: 5, ASSISTANT: 5}, ASSISTANT: {START: 2, SYSTEM: 0, USER: 5}}
_ADJACENT = {"su", "ua", "au"}
_ROWS = 2000  # result rows of a batch


class Node:
    """An edit, ``run`` times; ``refs`` counts the edits that follow it and the survivors that end with it."""

    __slots__ = ("before", "letter", "run", "row", "refs")

    def __init__(self, before: "Node | None", letter: str, row: tuple | None):
        self.before, self.letter, self.row, self.run, self.refs = before, letter, row, 1, 0
        if before is not None:
            before.refs += 1


def _release(node: Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.before


class Repair:
    """The search over one conversation's rows; ``emit(letter, run, row)`` gets final edits in order."""

    def __init__(self, emit: Callable[[str, int, tuple | None], None]):
        self.emit = emit
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.order: dict[tuple[int, int], tuple[int, str, str]] = {}
        self._since, self._depth = 0, 0

    def _edits(self, node: Node) -> list[Node]:
        """The unresolved edits up to ``node``."""
        found = []
        while node is not self.root:
            found.append(node)
            node = node.before
        return found[::-1]

    def _compare(self, a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str, str]:
        """Order of two candidates' whole edits: -1 or 1, else 0 and what either has beyond the other.

        A candidate is a survivor's state and the initials that follow it. How the survivors' own edits compare is
        known from when they were made, so that no comparison walks over them again.
        """
        (s, x), (t, y) = a, b
        if s != t:
            sign, rest_s, rest_t = self.order[s, t]
            if sign:
                return sign, "", ""
            x, y = rest_s + x, rest_t + y
        for k, (p, q) in enumerate(zip(x, y)):
            if p != q:
                return (-1 if p < q else 1), "", ""
        same = min(len(x), len(y))
        return 0, x[same:], y[same:]

    def _better(self, best: dict, state: int, cost: int, origin: int, edits: tuple) -> None:
        """``edits``: (initial, row) after the survivor of ``origin``. Takes the candidate if it is cheaper or comes first."""
        old = best.get(state)
        if old is None or cost < old[0] or cost == old[0] and self._compare(
                (origin, "".join(e[0] for e in edits)), (old[1], "".join(e[0] for e in old[2])))[0] < 0:
            best[state] = (cost, origin, edits)

    def _with_insertions(self) -> dict:
        """The survivors and what insertions make of them: state -> (cost, origin, edits)."""
        best = {s: (cost, s, ()) for s, (cost, _) in self.alive.items()}
        for _ in range(3):  # more in a row would come back to a state
            for state, (cost, origin, edits) in list(best.items()):
                to, role = _WANTED[state]
                self._better(best, to, cost + INSERT, origin, (*edits, ("I", (None, role, ""))))
        return best

    def _move(self, best: dict) -> None:
        """The candidates become the survivors, but for those that cost more than another one's way to any end."""
        best = {state: x for state, x in best.items() if not any(x[0] > y[0] + _BRIDGE[s][state] for s, y in best.items() if s != state)}
        said = {state: (origin, "".join(e[0] for e in edits)) for state, (_, origin, edits) in best.items()}
        order = {(s, t): self._compare(said[s], said[t]) for s in said for t in said if s != t}
        alive = {}
        for state, (cost, origin, edits) in best.items():
            node = self.alive[origin][1]
            for letter, row in edits:
                node = Node(node, letter, row)
            node.refs += 1
            alive[state] = (cost, node)
        for _, node in self.alive.values():
            _release(node)
        self.alive, self.order = alive, order
        self._since += 1
        if self._since > self._depth:  # a walk over the unresolved edits for as many rows
            self._resolve()

    def delete(self) -> None:
        """A row that must go. Insertions before it come later in ASCII order than those after it."""
        alive = {}
        for state, (cost, node) in self.alive.items():
            if node.letter == "D" and node.refs == 1 and node is not self.root:
                node.run += 1
            else:
                node.refs -= 1
                node = Node(node, "D", None)
                node.refs = 1
            alive[state] = (cost + DELETE, node)
        self.alive = alive
        self.order = {(s, t): self._compare((s, "D"), (t, "D")) for s, t in self.order}

    def row(self, role: str, row: tuple, extra: int) -> None:
        """A row that may stay: ``row`` is (turn, role, text), ``extra`` the cost of its staying."""
        best: dict = {}
        turn, _, text = row
        for state, (cost, origin, edits) in self._with_insertions().items():
            self._better(best, state, cost + DELETE, origin, (*edits, ("D", None)))
            kept = _LEGAL.get((state, role[:1]))
            if kept is not None:
                self._better(best, kept, cost + extra + KEEP, origin, (*edits, ("K", row)))
            to, wanted = _WANTED[state]
            self._better(best, to, cost + extra + REROLE, origin, (*edits, ("R", (turn, wanted, text))))
        self._move(best)

    def _resolve(self) -> None:
        leaves = {id(node) for _, node in self.alive.values()}
        path = self._edits(next(iter(self.alive.values()))[1])
        done = 0
        for node in path:
            if self.root.refs != 1 or id(self.root) in leaves:
                break
            self.emit(node.letter, node.run, node.row)
            node.before, self.root = None, node
            done += 1
        self._since, self._depth = 0, len(path) - done

    def finish(self) -> int:
        """Emits the rest; the cost."""
        ends = self._with_insertions()
        best: dict = {}
        for state in (START, ASSISTANT):
            if state in ends:
                self._better(best, 0, *ends[state])
        cost, origin, edits = best[0]
        for n in self._edits(self.alive[origin][1]):
            self.emit(n.letter, n.run, n.row)
        for letter, row in edits:
            self.emit(letter, 1, row)
        return cost


class Conversation:
    """Counts and repairs the rows of one conversation, in order."""

    def __init__(self, conv_id: int | None, emit: Callable[[str, int, tuple | None], None]):
        self.conv_id = conv_id
        self.repair = Repair(emit)
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.previous: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, repeats: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        row = (turn, role, text)
        if self.previous and self.previous[1][:1] + role[:1] not in _ADJACENT:
            self.illegal += 1
        repeats = repeats or self.previous == row
        self.previous = row
        end = text.rstrip(_BLANKS)
        if not end:
            self.blank += 1
            self.repair.delete()
        elif repeats:
            self.duplicate += 1
            self.repair.delete()
        else:
            cut = end[-1] not in ".!?"
            self.truncated += cut
            self.repair.row(role, row, TRUNCATED * cut)

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, repeats), a conversation's rows in one partition and in order.

    Null roles and texts are one space. ``repeats``: an earlier turn has the role and text; among rows of
    one turn, equal ones stand next to each other.
    """
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), space))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("conv", "said").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["conv", "said"], "left")
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce(F.col("first") < at, F.lit(False)).alias("repeats"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _fed(batches: Iterator[pa.RecordBatch], begin: Callable, done: Callable) -> Iterator[None]:
    """Feed a sorted stream of rows to conversations; gives way after every ``_ROWS`` rows and at the end."""
    now = None
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            for conv_id, turn, role, text, repeats in zip(*(c.to_pylist() for c in batch.slice(at, _ROWS).columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done(now)
                    now = begin(conv_id)
                now.add(turn, role, text, repeats)
            yield
    if now is not None:
        done(now)
    yield


def _written(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)
    rows.clear()
    return batch


def conversation_audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Rows stand in the order of turn (nulls first), then role and text. Null roles and texts are one space, rows without
    conv_id one conversation. A role without a letter can't be kept as it is. The audit gives the edits' initials;
    the digest is of the repaired ``role:text`` lines. Repeated rows are duplicates; other columns are ignored;
    an empty table gives no rows.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def begin(conv_id):
            audit, digest, lines = [], hashlib.sha256(), [0]

            def emit(letter, many, row):
                audit.append(letter * many)
                if letter != "D":
                    digest.update(f"{chr(10) * (lines[0] > 0)}{row[1]}:{row[2]}".encode())
                    lines[0] += 1
            conversation = Conversation(conv_id, emit)
            conversation.audit, conversation.digest = audit, digest
            return conversation

        def done(c):
            cost = c.repair.finish()
            rows.append((c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(c.audit), c.digest.hexdigest()))

        for _ in _fed(batches, begin, done):
            yield _written(rows, names, types)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types))
    return ordered_turns(turns).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations; ``turn`` is null for inserted rows.

    Cases as in ``conversation_audits``; a conversation all of whose rows go has no rows here.
    """
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # final edits that wait to be written

        def begin(conv_id):
            places = [0]

            def emit(letter, _, row):
                if letter != "D":
                    rows.append((conv_id, places[0], letter, *row))
                    places[0] += 1
            return Conversation(conv_id, emit)

        for _ in _fed(batches, begin, lambda c: c.repair.finish()):
            yield _written(rows, names, types)

    return ordered_turns(turns).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")
