"""Repair of the structure of conversations: Viterbi with survivors that coalesce.

Each row is kept, gets another role or is deleted, and empty turns are inserted, at the least total cost, so that the
roles read `(system? (user assistant)+)?` by their initials. A state of this language holds one survivor, the cheapest
way to it. Survivors are leaves of a tree of back pointers whose nodes count their references: nodes that no survivor
reaches any more go, and as soon as all survivors share their first edits, these are emitted. So memory holds what is
unresolved, not the conversation. Survivors of equal cost are compared by all their unresolved edits; what was
emitted they have in common, and as they have used up the same rows at the same cost, neither begins with the other,
so the comparison holds for whatever follows.

Rows of a conversation come sorted and stream through one task: the machine needs them in turn.

Defined results: a null role or text is one space, as in the contract; null turns come first; ties in turn are ordered
by role, then text; repeated rows count as duplicates; rows with a null conv_id form one conversation; an empty
table gives no edits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as c

SPACE = " \t\n\x0b\x0c\r"
EDIT = "conv_id long, step long, op string, turn long, found_role string, role string, text string, fault string, cost long"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDIT_ARROW = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("op", pa.string()), ("turn", pa.int64()), ("found_role", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int64())])
DIGEST_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")])
#: Output rows, and bytes of their texts, that a task holds before it hands them on.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: What a truncated row costs more unless it is deleted.
    truncated: int = 5


#: States by the last role that was put out: none, system, user, assistant; the role that may be put in next, and its state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
BY_INITIAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPT = (START, ASSISTANT)


class Node:
    """An edit that survivors share. heads: survivors that end here; kids: edits that follow. Their number is the reference count."""

    __slots__ = ("parent", "op", "row", "role", "cost", "kids", "heads")

    def __init__(self, parent, op, row, role, cost):
        self.parent, self.op, self.row, self.role, self.cost, self.kids, self.heads = parent, op, row, role, cost, set(), 0


class Survivors:
    """The machine of one conversation. emit(node) takes edits in their order, as soon as they are sure."""

    def __init__(self, costs: Costs, emit: Callable[[Node], None]):
        self.costs, self.emit = costs, emit
        self.root = Node(None, "", None, None, 0)
        self.root.heads = 1
        self.best = {START: (0, self.root)}

    def _ops(self, node: Node, op: str) -> str:
        """The unresolved edits of a candidate."""
        out = [op]
        while node is not self.root:
            out.append(node.op)
            node = node.parent
        return "".join(reversed(out))

    def _better(self, new: tuple, old: tuple | None) -> bool:
        """Candidates are (total cost, node before, op, row, role, own cost); an op may be empty."""
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        return self._ops(new[1], new[2]) < self._ops(old[1], old[2])

    def _move(self, wanted: dict[int, tuple]) -> None:
        """Make the chosen candidates the survivors, free what no survivor reaches, emit what all share."""
        before, after = self.best, {}
        self._leave_beaten(wanted)
        for state, (total, node, op, row, role, cost) in wanted.items():
            if op:
                kid = Node(node, op, row, role, cost)
                node.kids.add(kid)
                node = kid
            node.heads += 1
            after[state] = (total, node)
        for _, node in before.values():
            node.heads -= 1
            while node is not self.root and not node.heads and not node.kids:
                node.parent.kids.discard(node)
                node = node.parent
        self.best = after
        while not self.root.heads and len(self.root.kids) == 1:
            self.root = self.root.kids.pop()
            self.root.parent = None
            self.emit(self.root)

    def _leave_beaten(self, wanted: dict[int, tuple]) -> None:
        """Leave out candidates that no rest of the conversation can make the best: after an assistant all can follow that follows
        a system turn, and all that follows the start, but that a system row which the start would keep has to be deleted."""
        done = wanted.get(ASSISTANT)
        if done is None:
            return
        if START in wanted and done[0] + self.costs.delete < wanted[START][0]:
            del wanted[START]
        if SYSTEM in wanted and self._better(done, wanted[SYSTEM]):
            del wanted[SYSTEM]

    def _insert(self) -> None:
        """Put in turns between rows, as long as a state becomes cheaper by it."""
        while True:
            wanted = {s: (cost, node, "", None, None, 0) for s, (cost, node) in self.best.items()}
            changed = False
            for s, (cost, node) in self.best.items():
                role, to = NEXT[s]
                new = (cost + self.costs.insert, node, "I", None, role, self.costs.insert)
                if self._better(new, wanted.get(to)):
                    wanted[to], changed = new, True
            if not changed:
                return
            self._move(wanted)

    def add(self, row: tuple) -> None:
        """row: turn, role, text, fault."""
        self._insert()
        role, fault, costs = row[1], row[3], self.costs
        more = costs.truncated if fault == "truncated" else 0
        wanted: dict[int, tuple] = {}

        def offer(to: int, new: tuple) -> None:
            if self._better(new, wanted.get(to)):
                wanted[to] = new

        for s, (total, node) in self.best.items():
            offer(s, (total + costs.delete, node, "D", row, role, costs.delete))
            if fault in ("blank", "duplicate"):
                continue
            if (to := BY_INITIAL.get((s, role[:1]))) is not None:
                offer(to, (total + more, node, "K", row, role, more))
            name, to = NEXT[s]
            offer(to, (total + costs.rerole + more, node, "R", row, name, costs.rerole + more))
        self._move(wanted)

    def end(self) -> None:
        self._insert()
        last = None
        for s in ACCEPT:
            if s in self.best:
                total, node = self.best[s]
                new = (total, node, "", None, None, 0)
                last = new if self._better(new, last) else last
        self._move({START: last})


def fault_of(text: str, seen: bool) -> str | None:
    bare = text.rstrip(SPACE)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None


def repair(rows: DataFrame, costs: Costs | None = None) -> DataFrame:
    """rows: conv_id, turn, role, text. Returns the edits of each conversation in their order: step (from 1), op (K keep, R new role,
    D delete, I insert), turn and found_role of the row (null for inserts), role and text after the edit (of a deleted
    row, as found), fault (blank, duplicate, truncated or null), cost. The rows of a conversation stand together, in order."""
    costs = costs or Costs()
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) == 1
    rows = rows.repartition("conv_id").withColumn("seen", ~first).sortWithinPartitions("conv_id", "turn", "role", "text", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, conv, machine, step = [], 0, None, None, 0

        def emit(node: Node) -> None:
            nonlocal step, size
            step += 1
            turn, found, text, fault = (None, None, "", None) if node.row is None else node.row
            out.append((conv, step, node.op, turn, found, node.role, text, fault, node.cost))
            size += len(text)

        def made() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True), EDIT_ARROW, strict=True)], schema=EDIT_ARROW)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for cid, turn, role, text, seen in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "seen")], strict=True):
                if machine is None or cid != conv:
                    if machine is not None:
                        machine.end()
                    conv, step, machine = cid, 0, Survivors(costs, emit)
                # As (turn, role, text, fault); emit() and add() name the parts.
                machine.add((turn, role, text, fault_of(text, seen)))
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield made()
        if machine is not None:
            machine.end()
        if out:
            yield made()

    return rows.mapInArrow(c.tidy(run), EDIT)


def digest(edits: DataFrame) -> DataFrame:
    """edits as repair() gives them, before anything moves their rows. A row a conversation: its faults, the pairs of initials
    that may not stand together, turns missing between the first and the last, cost, audit and a hash of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for batch in batches:
            for x in batch.to_pylist():
                if now is None or now.conv != x["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = _Tally(x["conv_id"])
                now.add(x)
            if len(out) >= BATCH_ROWS:
                yield _tallied(out)
        if now is not None:
            out.append(now.row())
        if out:
            yield _tallied(out)

    return edits.mapInArrow(c.tidy(run), DIGEST)


def _tallied(out: list[tuple]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True), DIGEST_ARROW, strict=True)], schema=DIGEST_ARROW)
    out.clear()
    return batch


class _Tally:
    """What digest() counts of one conversation."""

    def __init__(self, conv):
        self.conv, self.ops, self.sha, self.any, self.cost, self.illegal = conv, [], hashlib.sha256(), False, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.role = None
        self.turns = 0

    def add(self, x: dict) -> None:
        self.ops.append(x["op"])
        self.cost += x["cost"]
        if x["fault"]:
            self.faults[x["fault"]] += 1
        if x["op"] != "D":
            self.sha.update(f"{chr(10) if self.any else ''}{x['role']}:{x['text']}".encode())
            self.any = True
        if x["op"] == "I":
            return
        initial, turn = x["found_role"][:1], x["turn"]
        self.illegal += self.role is not None and self.role + initial not in ("su", "ua", "au")
        self.role = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.ops), self.sha.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage: of 20 classes of rows, one goes, one loses its text, one its sentence ends, one is repeated, one speaks as user."""
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    named = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")]
    name = F.concat(named[0], F.lit(":"), named[1])
    kept = kept.withColumn("kind", F.crc32(name) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return kept.drop("copy")
