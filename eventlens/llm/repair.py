"""Conversation repair: generalised LR parsing of the roles with weighted edits.

The roles of a conversation must form a sentence of a small grammar. A row may be kept, given another role or deleted,
and empty rows may be inserted; the cheapest edits win, ties by their letters.

1. ``StackAutomaton`` holds the stacks of an LR(0) parser. Stacks share their lower parts, so together they are
   a graph; shifts and all reductions after them are followed side by side, whatever conflicts a grammar has.
2. ``Repairer`` moves a frontier of stacks over the rows, each with its least (cost, edits). Stacks whose tops are equal
   (the same state over the same rest) are merged into the cheaper one. What a frontier does at a kind of row is
   remembered, so most rows cost a lookup.
3. Spark brings each conversation's rows together in order and they are streamed, so memory does not grow with a
   conversation but for the letters of its edits. One conversation passes one task: edits and digest depend on the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import cut

#: Rules of the roles' first letters; capitals are not roles. Their sentences are (s?(ua)+)?
ROLE_GRAMMAR = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "BP"), ("B", "P"), ("P", "ua"))
#: Roles that edits may give, by letter.
ROLE_NAMES = (("a", "assistant"), ("u", "user"))
_TAIL = 2048
_REMEMBERED = 50_000


@dataclass(frozen=True)
class EditCosts:
    delete: int = 3
    rerole: int = 2
    insert: int = 2
    truncated: int = 1


class StackAutomaton:
    """Numbered stacks of the LR(0) parser of a grammar; a stack is a parser state over another stack.

    A grammar may be ambiguous, but no rule may follow a symbol that can be empty by that symbol's own rule again (S -> SS, S -> nothing).
    """

    def __init__(self, grammar=ROLE_GRAMMAR):
        self.rules = (("", grammar[0][0]), *grammar)
        self.left = {a for a, _ in grammar}
        self.stacks: dict[tuple[frozenset, int], int] = {}
        self.state: list[frozenset] = []
        self.below: list[int] = []
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}
        self.start = self._settled(self._stack(self._closed({(0, 0)}), -1))
        self.accepting = dict.fromkeys(self.start, self.accepts_empty)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            wanted = self.rules[rule][1][dot : dot + 1]
            for i, (a, _) in enumerate(self.rules):
                if a == wanted and wanted and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _stack(self, state: frozenset, below: int) -> int:
        key = (state, below)
        if key not in self.stacks:
            self.stacks[key] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return self.stacks[key]

    def _push(self, stack: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.state[stack] if self.rules[r][1][d : d + 1] == symbol}
        return self._stack(self._closed(moved), stack) if moved else None

    def _settled(self, stack: int) -> tuple[int, ...]:
        """The stacks after all reductions that can still shift; sets ``accepts_empty`` if one of them ends a sentence."""
        todo, seen, out = [stack], set(), []
        self.accepts_empty = False
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            shifts = {self.rules[r][1][d : d + 1] for r, d in self.state[s]} - self.left - {""}
            if shifts:
                out.append(s)
            for r, d in self.state[s]:
                if d == len(self.rules[r][1]):
                    if r == 0:
                        self.accepts_empty = True
                        continue
                    base = s
                    for _ in range(d):
                        base = self.below[base]
                    todo.append(self._push(base, self.rules[r][0]))
        return tuple(sorted(out))

    def after(self, stack: int, symbol: str) -> tuple[int, ...]:
        """The stacks that follow ``stack`` on a role, with all reductions done."""
        key = (stack, symbol)
        if key not in self.moves:
            pushed = self._push(stack, symbol)
            found = () if pushed is None else self._settled(pushed)
            for s in found:
                self.accepting[s] = self.accepting.get(s, False) or self.accepts_empty
            self.moves[key] = found
        return self.moves[key]


class Repairer:
    """Cheapest edits over a frontier of stacks.

    A frontier is a tuple of (stack, cost above the least, rank): ranks order the edits so far. Edits of stacks of one
    frontier take the same rows and end with a row's edit, so of two different ones none begins with the other, and
    what follows cannot change their order.
    """

    def __init__(self, grammar=ROLE_GRAMMAR, names=ROLE_NAMES, costs: EditCosts = EditCosts()):
        self.parser, self.given, self.costs = StackAutomaton(grammar), [a for a, _ in names], costs
        self.start = tuple((s, 0, 0) for s in self.parser.start)
        self.steps: dict = {}
        self.ends: dict = {}

    def _inserted(self, frontier):
        """Per stack, the least (cost, rank, edits, roles, parent) after any insertions."""
        best = {s: (cost, rank, "", "", i) for i, (s, cost, rank) in enumerate(frontier)}
        fresh = dict(best)
        while fresh:
            found = {}
            for s, (cost, rank, edits, roles, i) in fresh.items():
                for role in self.given:
                    for t in self.parser.after(s, role):
                        new = (cost + self.costs.insert, rank, edits + "I", roles + role, i)
                        if new < best.get(t, (float("inf"),)):
                            best[t] = found[t] = new
            fresh = found
        return best

    def step(self, frontier, initial: str, fault: str):
        """The frontier after a row, its least cost, and per stack (parent, edits, roles). ``fault`` is '', 'delete' or 'truncated'."""
        key = (frontier, initial, fault)
        if key not in self.steps:
            if len(self.steps) > _REMEMBERED:
                self.steps.clear()
            more = self.costs.truncated if fault == "truncated" else 0
            best: dict = {}

            def offer(t, new):
                if new < best.get(t, (float("inf"),)):
                    best[t] = new

            for s, (cost, rank, edits, roles, i) in self._inserted(frontier).items():
                offer(s, (cost + self.costs.delete, rank, edits + "D", roles + "-", i))
                if fault != "delete":
                    for t in self.parser.after(s, initial) if initial else ():
                        offer(t, (cost + more, rank, edits + "K", roles + initial, i))
                    for role in self.given:
                        for t in self.parser.after(s, role):
                            offer(t, (cost + self.costs.rerole + more, rank, edits + "R", roles + role, i))
            least = min(x[0] for x in best.values())
            ranks = {k: n for n, k in enumerate(sorted({x[1:3] for x in best.values()}))}
            ordered = sorted(best.items())
            self.steps[key] = tuple((s, x[0] - least, ranks[x[1:3]]) for s, x in ordered), least, tuple((x[4], x[2], x[3]) for _, x in ordered)
        return self.steps[key]

    def end(self, frontier):
        """(cost, parent, edits, roles) of the best complete repair."""
        if frontier not in self.ends:
            if len(self.ends) > _REMEMBERED:
                self.ends.clear()
            cost, _, edits, roles, i = min(x for s, x in self._inserted(frontier).items() if self.parser.accepting.get(s))
            self.ends[frontier] = cost, i, edits, roles
        return self.ends[frontier]


class Repair:
    """The running repair of one conversation: ``add`` its rows, then ``finish``."""

    def __init__(self, repairer: Repairer):
        self.repairer, self.frontier, self.cost = repairer, repairer.start, 0
        # per stack: its edits and roles, as older stretches linked backwards and the latest one
        self.paths: list[tuple] = [(None, "", "")] * len(self.frontier)

    def add(self, initial: str, fault: str) -> None:
        self.frontier, least, moves = self.repairer.step(self.frontier, initial, fault)
        self.cost += least
        paths, rolled = [], {}
        for i, edits, roles in moves:
            link, old_edits, old_roles = self.paths[i]
            if len(old_edits) >= _TAIL:
                link, old_edits, old_roles = rolled.setdefault(i, (self.paths[i], "", ""))
            paths.append((link, old_edits + edits, old_roles + roles))
        self.paths = paths

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and roles ('-' at a deletion) of the whole conversation."""
        cost, i, edits, roles = self.repairer.end(self.frontier)
        parts, path = [(edits, roles)], self.paths[i]
        while path is not None:
            parts.append(path[1:])
            path = path[0]
        return self.cost + cost, "".join(p[0] for p in reversed(parts)), "".join(p[1] for p in reversed(parts))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``dropped`` of the rows, damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays with ``dropped`` set), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets its role
    to user. Nulls become one space, in the hashed text too; conv_id and turn stay null in the columns.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("_")).drop("_")


_SPACES = " \t\n\x0b\x0c\r"


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of each conversation in one partition, by turn (nulls first), then role and text."""
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` in order with their first fault: blank, duplicate, truncated or none ('')."""
    last = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    # the partitioning by conversation serves the window too
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("dropped", "turn"))
    fault = F.when(last == "", "blank").when(F.col("seen") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return _in_order(rows.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault).drop("seen"))


_PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles string"


def repair_plan(rows: DataFrame, grammar=ROLE_GRAMMAR, names=ROLE_NAMES, costs: EditCosts = EditCosts()) -> DataFrame:
    """One row per conversation: conv_id, counts of its faults, the cost and letters of its cheapest edits, their roles.

    ``rows`` has conv_id, turn, role, text without nulls in role and text, and ``dropped`` for rows that only name their conversation.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(grammar, names, costs)
        key: tuple = ()
        out: list[list] = []
        kind = None

        def fresh():
            return Repair(repairer), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, [None, None, 0, None, 0]

        repair, faults, turns = fresh()

        def close() -> None:
            low, high, distinct, _, illegal = turns
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append([key[0], gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *repair.finish()])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *[x.split()[0] for x in _PLAN.split(", ")]])

        before = ""
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, turn, initial, fault, dropped in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "dropped")], strict=True):
                if key != (conv,):
                    if key:
                        close()
                    key, before = (conv,), ""
                    repair, faults, turns = fresh()
                if dropped:
                    continue
                faults[fault] += 1
                if turn is not None:  # rows come by turn
                    turns[0] = turn if turns[0] is None else turns[0]
                    turns[2] += turn != turns[1]
                    turns[1] = turn
                if turns[3] is not None:
                    turns[4] += before + initial not in ("su", "ua", "au")
                turns[3], before = True, initial
                repair.add(initial, "delete" if fault in ("blank", "duplicate") else fault)
            if len(out) > 5000:
                yield flush()
                out = []
        if key:
            close()
        if out:
            yield flush()

    kinds = ", ".join(f"{n} {t}" for n, t in rows.select("conv_id").dtypes)
    read = with_faults(rows).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "dropped")
    return read.mapInArrow(plan, f"{kinds}, {_PLAN}")


def apply_repairs(rows: DataFrame, plan: DataFrame, names=ROLE_NAMES) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (K, R or I), role, text; each conversation in order in one partition.

    ``plan`` has conv_id, audit and roles, as ``repair_plan`` gives them for the same ``rows``.
    """
    name = dict(names)
    columns = ["conv_id", "position", "edit", "role", "text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, roles, at, position, conv = "", "", 0, 0, None

        def inserts(out: list) -> None:
            nonlocal at, position
            while at < len(edits) and edits[at] == "I":
                out.append((conv, position, "I", name[roles[at]], ""))
                at, position = at + 1, position + 1

        kinds = None
        for batch in batches:
            kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            out: list[tuple] = []
            for c, audit, shape, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "audit", "roles", "role", "text")], strict=True):
                if audit is not None:  # the head of a conversation
                    inserts(out)
                    conv, edits, roles, at, position = c, audit, shape, 0, 0
                    continue
                inserts(out)
                if edits[at] != "D":
                    out.append((conv, position, edits[at], name[roles[at]] if edits[at] == "R" else role, text))
                    position += 1
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)
        if kinds:
            out = []
            inserts(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    heads = plan.select("conv_id", "audit", "roles")
    body = rows.where("not dropped").select("conv_id", "turn", "role", "text")
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv_id").withColumn("_body", F.col("audit").isNull())
    both = both.sortWithinPartitions("conv_id", "_body", "turn", "role", "text").drop("_body", "turn")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.select("conv_id").dtypes)
    return both.mapInArrow(apply, f"{kinds}, position bigint, edit string, role string, text string")


def ordered_digests(rows: DataFrame, name: str) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` joined by line ends, for rows that stand in order, a conversation in one partition."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind = None, None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", name])

        for batch in batches:
            kind = batch.column("conv_id").type
            for c, position, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text")], strict=True):
                if position == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if len(done) > 5000:
                yield flush()
                done = []
        if sha is not None:
            done.append((conv, sha.hexdigest()))
            yield flush()

    kinds = ", ".join(f"{n} {t}" for n, t in rows.select("conv_id").dtypes)
    return rows.select("conv_id", "position", "role", "text").mapInArrow(digest, f"{kinds}, {name} string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` and repairs them: one row per original conv_id with counts, cost, audit and repaired_sha256.

    Rows are taken by turn (nulls first), rows of one turn by role and text. A null conv_id is a conversation of its
    own; null roles and texts are one space. Repeated rows are duplicates, empty texts are blank, texts of any length are
    whole. Columns other than conv_id, turn, role and text are not read. An empty table gives no rows.
    """
    rows = damaged(conversations)
    plan = cut(repair_plan(rows))
    digests = ordered_digests(apply_repairs(rows, plan), "repaired_sha256")
    joined = plan.join(digests, plan["conv_id"].eqNullSafe(digests["conv_id"]), "left")
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select(plan["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)
