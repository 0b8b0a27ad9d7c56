"""Conversation repair by survivor-coalescence Viterbi.

A conversation's rows, in order, are edited at least cost so that its role initials read ``(s?(ua)+)?``: every row is
kept, given another role or deleted, and empty rows may be inserted before any row and at the end.  The states are
"nothing yet", "after system", "after user" and "after assistant"; each holds one survivor, the cheapest (then
ASCII-least) edits that lead there.

* **Backpointer tree.**  A survivor is a node of a tree; a node counts its children and whether it is a survivor and goes
  when nothing refers to it.  Once all survivors share an ancestor, the edits up to it are final: they are emitted and
  forgotten, so memory holds the unresolved rows only.  A survivor that another one undercuts by more than it costs to
  do as it does is dropped, which keeps that stretch short.
* **Ties** of equal cost compare the complete unresolved suffixes back to the shared ancestor.  Inserts are taken just
  before the row they precede (an insert before a delete is never least), so no edit string is a prefix of a rival.

Scale: texts move in one grouping exchange (equal rows of a conversation become one row with a count, map side first) and
one by conversation.  A conversation of more than ``PIECE_ROWS`` rows is cut into ordered ranges: each range gives its
costs and string order from every state to every state (narrow rows, in parallel), these small tables are folded into
the states at the borders, and then all ranges are repaired in parallel.  Only the digest of a cut conversation's
repaired text is taken in one task, as SHA-256 has to be: it streams the ranges' lines and holds none.

Defined cases: null conversation, turn, role and text count as one space in texts and damage, a null turn comes first and
a null ``conv_id`` is a conversation; rows of one turn are ordered by role, then text; an empty role has no
initial; repeated rows are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import CRC_TABLE, crc_sql
from .store import table, written

#: Conversations of more distinct rows are cut into ranges.
PIECE_ROWS = 20_000
PART_CHARS = 1 << 20
SLICE_ROWS = 256
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Cost to bring a state to a whole sequence by inserts at the end.
CLOSE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: What it costs at most to do from one state whatever can follow another.
COPES = {(START, SYSTEM): 0, (START, USER): 3, (START, ASSISTANT): 0, (SYSTEM, START): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
         (USER, START): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, START): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3}


def _turn_to(state: int) -> int:
    """The state after a user or assistant row that the sequence asks for next."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, truncated: bool) -> list[tuple[int, int, int, str, tuple]]:
    """For one kind of row: (from, to, cost, edits, roles of inserted and rerolled rows), the best for each pair of states."""
    best: dict[tuple[int, int], tuple] = {}
    left = TRUNCATED if truncated else 0
    for start in range(4):
        ways = [(start, DELETE, "D", ())]
        state, cost, edits, roles = start, 0, "", ()
        for _ in range(3):
            to = _turn_to(state)
            if (state, initial) in NEXT:
                ways.append((NEXT[state, initial], cost + left, edits + "K", roles))
            ways.append((to, cost + REROLE + left, edits + "R", (*roles, NAME[to])))
            state, cost, edits, roles = to, cost + INSERT, edits + "I", (*roles, NAME[to])
        for to, *way in ways:
            best[start, to] = min(best.get((start, to), tuple(way)), tuple(way))
    return [(a, b, *way) for (a, b), way in best.items()]


MOVES = {(i, t): _moves(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


class Node:
    """Edits of one row in the backpointer tree."""

    __slots__ = ("children", "deletes", "edits", "held", "parent", "roles", "row")

    def __init__(self, parent: Node | None, edits: str, roles: tuple, row: tuple | None, deletes: int):
        self.parent, self.edits, self.roles, self.row, self.deletes = parent, edits, roles, row, deletes
        self.children: dict[int, Node] = {}
        self.held = False
        if parent is not None:
            parent.children[id(self)] = self

    def text(self) -> str:
        return self.edits + "D" * self.deletes


class Repair:
    """Streaming repair of consecutive rows from one state; ``emit(edits, roles, row)`` gets every final row's edits."""

    def __init__(self, entry: int = START, emit: Callable | None = None):
        self.root = Node(None, "", (), None, 0)
        self.emit = emit or (lambda *_: None)
        self.best: dict[int, tuple[int, Node]] = {entry: (0, self.root)}
        self.root.held = True
        self.most = 0  # unresolved rows at once, for tests

    def unresolved(self, node: Node) -> str:
        parts = []
        while node is not self.root:
            parts.append(node.text())
            node = node.parent
        return "".join(reversed(parts))

    def _before(self, a: Node, b: Node, end_a: str, end_b: str) -> bool:
        """Whether edits ``a + end_a`` come before ``b + end_b``; both nodes stand at the same row."""
        left, right = [end_a], [end_b]
        while a is not b:
            left.append(a.text())
            right.append(b.text())
            a, b = a.parent, b.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, row: tuple, initial: str, truncated: bool, copies: int, must_go: bool) -> None:
        """One row and ``copies`` equal ones after it; with ``must_go`` the row itself is deleted, too."""
        if must_go:
            found = {s: (cost + DELETE * (copies + 1), n, "", (), copies + 1) for s, (cost, n) in self.best.items()}
        else:
            found = {}
            for a, b, extra, edits, roles in MOVES[initial if initial in ("s", "u", "a") else "", truncated]:
                if a not in self.best:
                    continue
                cost, node = self.best[a]
                cost += extra + DELETE * copies
                had = found.get(b)
                if had is None or cost < had[0] or cost == had[0] and self._before(node, had[1], edits, had[2]):
                    found[b] = (cost, node, edits, roles, copies)
            found = {b: x for b, x in found.items() if not any(q != b and y[0] + COPES[q, b] < x[0] for q, y in found.items())}
        old = self.best
        self.best = {}
        for state, (cost, node, edits, roles, deletes) in found.items():
            made = Node(node, edits, roles, row, deletes)
            made.held = True
            self.best[state] = (cost, made)
        for _, node in old.values():
            node.held = False
        for _, node in old.values():
            self._release(node)
        self._settle()

    def _release(self, node: Node | None) -> None:
        while node is not None and not node.held and not node.children and node.parent is not None:
            node.parent.children.pop(id(node), None)
            node = node.parent

    def _settle(self) -> None:
        """Emit the edits that all survivors share."""
        while len(self.root.children) == 1 and not self.root.held:
            (node,) = self.root.children.values()
            self.emit(node.text(), node.roles, node.row)
            node.parent = None
            self.root = node

    def finish(self, end: int | None = None) -> int:
        """Emit the rest on the way to state ``end`` (None: the cheapest whole sequence, with its closing inserts); the cost."""
        if end is None:
            best = None
            for state, (cost, node) in self.best.items():
                new = cost + INSERT * len(CLOSE[state]), node, CLOSE[state], state
                if best is None or new[0] < best[0] or new[0] == best[0] and self._before(node, best[1], new[2], best[2]):
                    best = new
            cost, node, close, state = best
        else:
            (cost, node), close, state = self.best[end], "", end
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.text(), node.roles, node.row)
        if close:
            self.emit(close, ("user", "assistant")[-len(close):], None)
        return cost

    def border(self) -> dict[int, tuple[int, int]]:
        """Per reachable state the cost and the place of its edits among the survivors' in ASCII order."""
        names = sorted((self.unresolved(n), s) for s, (_, n) in self.best.items())
        return {s: (self.best[s][0], k) for k, (_, s) in enumerate(names)}


def fold(tables: list[dict[int, dict[int, tuple[int, int]]]]) -> list[tuple[int, int | None]]:
    """Entry and exit state of every range on the least way through all of them, from the ranges' border tables."""
    now: dict[int, tuple[int, int]] = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for t in tables:
        best: dict[int, tuple] = {}
        for a, (cost, place) in now.items():
            for b, (extra, inner) in t.get(a, {}).items():
                new = cost + extra, place, inner, a
                best[b] = min(best.get(b, new), new)
        order = sorted(best, key=lambda s: best[s][1:3])
        now = {s: (best[s][0], order.index(s)) for s in best}
        back.append({s: best[s][3] for s in best})
    state = min(now, key=lambda s: (now[s][0] + INSERT * len(CLOSE[s]), now[s][1]))
    out: list[tuple[int, int | None]] = []
    for k in range(len(tables) - 1, -1, -1):
        before = back[k][state]
        out.append((before, state if k < len(tables) - 1 else None))
        state = before
    return out[::-1]


def _crc(conv: Column, turn: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` after the test damage; null roles and texts are one space."""
    source = rows.select("conv_id", "turn", _crc(F.col("conv_id"), F.col("turn")).alias("hit"),
                         F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    text = (F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return source.filter("hit <> 0").select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                                            text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of ``copies`` and first ``fault``: blank, duplicate (of an earlier turn), truncated or null."""
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = (rows.select("conv_id", name.alias("name"), turn.alias("at")).groupBy("conv_id", "name").agg(F.min("at").alias("first"), F.max("at").alias("last"))
             .filter(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("conv_id").alias("__conv"), F.col("name").alias("__name"), "first"))
    whole = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("name", name)
    met = whole.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("name") == F.col("__name")), "left")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(bare == "", "blank").when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


COUNTS = ("first_turn", "last_turn", "turns", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns], strict=True)


def _add(repair: Repair, row: tuple, role: str, copies: int, fault: str | None) -> None:
    repair.add(row, role[:1], fault == "truncated", copies - 1, fault in ("blank", "duplicate"))


def _borders(batches: Iterator) -> Iterator:
    """Per (conversation, range): costs and places from every state to every state, as rows."""
    import pyarrow as pa

    key, runs, out = None, [], []

    def closed() -> None:
        out.extend({"conv_id": key[0], "piece": key[1], "a": a, "b": b, "cost": c, "place": k} for a, r in enumerate(runs) for b, (c, k) in r.border().items())

    for conv, piece, initial, copies, fault in _rows(batches):
        if (conv, piece) != key:
            if key is not None:
                closed()
            key, runs = (conv, piece), [Repair(a) for a in range(4)]
        for r in runs:
            _add(r, (), initial, copies, fault)
    if key is not None:
        closed()
    yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("place", pa.int32())]))


def _ends(pdf):
    """Entry and exit states of one conversation's ranges (a few numbers each)."""
    import pandas as pd

    tables, names = [], sorted(set(pdf["piece"]))
    for p in names:
        t: dict = {}
        for r in pdf[pdf["piece"] == p].itertuples():
            t.setdefault(r.a, {})[r.b] = (r.cost, r.place)
        tables.append(t)
    ways = fold(tables)
    out = pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]] * len(names), "piece": names, "entry": [w[0] for w in ways], "leave": [w[1] for w in ways]})
    out["conv_id"], out["leave"] = out["conv_id"].astype("Int64"), out["leave"].astype("Int64")
    return out


class _Piece:
    """Repair of one (conversation, range): its parts as result rows."""

    def __init__(self, conv, piece, entry, leave, whole):
        self.conv, self.piece, self.leave, self.whole = conv, piece, leave, whole
        self.audit, self.lines, self.size, self.part, self.items, self.sha = [], [], 0, 0, 0, hashlib.sha256()
        self.done: list[dict] = []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial_first = self.initial_last = None
        self.repair = Repair(entry, self.take)

    def add(self, turn, role, text, copies, fault) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = (turn if self.first is None else self.first), turn
        initial = role[:1]
        if self.initial_first is None:
            self.initial_first = initial
        else:
            self.illegal += self.initial_last + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # equal initials never follow one another
        self.initial_last = initial
        self.blank += copies if fault == "blank" else 0
        self.duplicate += 0 if fault == "blank" else copies if fault == "duplicate" else copies - 1
        self.truncated += fault == "truncated"
        _add(self.repair, (role, text), role, copies, fault)

    def line(self, role: str, text: str) -> None:
        new = ("\n" if self.items else "") + role + ":" + text
        self.items += 1
        if self.whole:
            self.sha.update(new.encode())
        else:
            self.lines.append(new)
            self.size += len(new)
            if self.size >= PART_CHARS:
                self.flush()

    def take(self, edits: str, roles: tuple, row: tuple | None) -> None:
        self.audit.append(edits)
        names = iter(roles)
        for e in edits:
            if e == "I":
                self.line(next(names), "")
            elif e == "K":
                self.line(*row)
            elif e == "R":
                self.line(next(names), row[1])

    def flush(self, **more) -> None:
        self.done.append({"conv_id": self.conv, "piece": self.piece, "part": self.part, "audit": "".join(self.audit), "body": "".join(self.lines), **more})
        self.audit, self.lines, self.size, self.part = [], [], 0, self.part + 1

    def close(self) -> list[dict]:
        cost = self.repair.finish(self.leave)
        self.flush(first_turn=self.first, last_turn=self.last, turns=self.turns, first_initial=self.initial_first, last_initial=self.initial_last, blank=self.blank,
                   duplicate=self.duplicate, truncated=self.truncated, illegal=self.illegal, cost=cost, sha=self.sha.hexdigest() if self.whole else None)
        return self.done


PARTS = ("conv_id bigint, piece bigint, part int, audit string, body string, first_turn bigint, last_turn bigint, turns bigint, first_initial string,"
         " last_initial string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, sha string")
RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _arrow(rows: list[dict], ddl: str):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(","))]))


def _repaired(batches: Iterator) -> Iterator:
    """Rows in order of (conversation, range): every range's parts."""
    key, now, out = None, None, []
    for conv, piece, entry, leave, whole, turn, role, text, copies, fault in _rows(batches):
        if (conv, piece) != key:
            if now is not None:
                out += now.close()
            key, now = (conv, piece), _Piece(conv, piece, entry, leave, whole)
        now.add(turn, role, text, copies, fault)
        if len(now.done) > 4:
            out, now.done = out + now.done, []
        if len(out) >= 16:
            yield _arrow(out, PARTS)
            out = []
    if now is not None:
        out += now.close()
    yield _arrow(out, PARTS)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _joined(batches: Iterator) -> Iterator:
    """Parts of cut conversations in order: one result row each; the digest streams over the parts' lines."""
    key, total, audit, sha, lines, out = None, {}, [], None, False, []

    def closed() -> dict:
        return {"conv_id": key, "gaps": _gaps(total["first"], total["last"], total["turns"]), **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")},
                "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    for conv, _, part, text, body, first, last, turns, left, right, *counts, _ in _rows(batches):
        if sha is None or conv != key:
            if sha is not None:
                out.append(closed())
            key, audit, sha, lines = conv, [], hashlib.sha256(), False
            total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | dict.fromkeys(("first", "last", "initial"))
        audit.append(text)
        if body:
            sha.update(("\n" * (lines and not part) + body).encode())
            lines = True
        if turns is not None:  # a range's last part
            total["turns"] += turns - (first is not None and first == total["last"])
            total["first"] = first if total["first"] is None else total["first"]
            total["last"] = total["last"] if last is None else last
            total["illegal"] += total["initial"] is not None and total["initial"] + left not in ("su", "ua", "au")
            total["initial"] = right
            for k, v in zip(("blank", "duplicate", "truncated", "illegal", "cost"), counts, strict=True):
                total[k] += v
    if sha is not None:
        out.append(closed())
    yield _arrow(out, RESULT)


def repair_turns(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, copies``): the columns of ``RESULT``."""
    faults = written(judged(rows), "turn-faults")
    long = faults.groupBy(F.col("conv_id").alias("__conv")).agg(F.count("*").alias("n")).filter(F.col("n") > piece_rows).select("__conv")
    mine = F.col("conv_id").eqNullSafe(F.col("__conv"))
    keys = ["conv_id", "turn", "role", "text"]
    ranges = faults.join(long, mine, "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = written(ranges.withColumn("at", F.monotonically_increasing_id()), "turn-ranges").withColumn("piece", F.shiftrightunsigned("at", 33))
    borders = (cut.select("conv_id", "piece", "at", F.left("role", F.lit(1)).alias("initial"), "copies", "fault")
               .repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
               .select("conv_id", "piece", "initial", "copies", "fault")
               .mapInArrow(_borders, "conv_id bigint, piece bigint, a int, b int, cost bigint, place int"))
    ends = (borders.groupBy("conv_id").applyInPandas(_ends, "conv_id bigint, piece bigint, entry int, leave int")
            .select(F.col("conv_id").alias("__conv"), F.col("piece").alias("__piece"), "entry", "leave"))
    columns = ["conv_id", "piece", "entry", "leave", "whole", "turn", "role", "text", "copies", "fault"]
    short = (faults.join(long, mine, "left_anti").withColumn("piece", F.lit(0).cast("long")).withColumn("entry", F.lit(START))
             .withColumn("leave", F.lit(None).cast("int")).withColumn("whole", F.lit(True)))
    cut = cut.join(ends, mine & (F.col("piece") == F.col("__piece"))).withColumn("whole", F.lit(False))
    parts = written(short.select(*columns).unionByName(cut.select(*columns)).repartition("conv_id", "piece")
                    .sortWithinPartitions("conv_id", "piece", "turn", "role", "text").mapInArrow(_repaired, PARTS), "turn-parts")
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long")
    one = parts.filter("sha IS NOT NULL").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                                 F.col("sha").alias("repaired_sha256"))
    many = parts.filter("sha IS NULL AND body IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part").mapInArrow(_joined, RESULT)
    return one.unionByName(many)


def op12_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Damage and least-cost repair of every conversation."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_turns(damaged(rows)).withColumnRenamed("conv_id", "__conv")
    names = rows.select("conv_id").distinct()
    zero = [c for c in found.columns if c not in ("__conv", "audit", "repaired_sha256")]
    return (names.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def _op12_sql() -> str:
    """The same least edits as a recursion over rows with one (cost, edits, lines) per state; structs compare field by field."""

    def then(state: str, cost: str, edit: str, role: str = "", text: str = "''") -> str:
        line = f"{role} || ':' || {text}"
        lines = f"CASE WHEN {state}.l = '' THEN {line} ELSE {state}.l || chr(10) || {line} END" if role else f"{state}.l"
        return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', l := {lines}) END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def inserted(source: str, columns: str) -> str:
        user = least("p2", *[then(p, str(INSERT), "I", "'user'") for p in ("p0", "p1", "p3")])
        assistant = least("p3", then("u", str(INSERT), "I", "'assistant'"))
        return f"SELECT {columns}, p0, p1, u, {assistant} AS a FROM (SELECT {columns}, p0, p1, p2, p3, {user} AS u FROM {source})"

    def put(edit: str, state: str, cost: str, role: str, when: str) -> str:
        return f"CASE WHEN NOT gone AND {when} THEN {then(state, f'({cost} + late)', edit, role, 'text')} END"

    keeps = lambda p, initial: put("K", p, "0", "role", f"left(role, 1) = '{initial}'")
    roles = lambda p, role: put("R", p, str(REROLE), f"'{role}'", "true")
    drop = lambda p: then(p, str(DELETE), "D")
    before_user = ("p0", "p1", "a")
    states = {"p0": drop("p0"), "p1": least(drop("p1"), keeps("p0", "s")),
              "p2": least(drop("u"), *[keeps(p, "u") for p in before_user], *[roles(p, "user") for p in before_user]),
              "p3": least(drop("a"), keeps("u", "a"), roles("u", "assistant"))}
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    kind = "struct(c BIGINT, a VARCHAR, l VARCHAR)"
    return f"""WITH RECURSIVE t AS ({CRC_TABLE}),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations, t),
dmg AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
               CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {white}) AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS earlier FROM dmg),
f AS (SELECT conv_id, turn, role, text, i, bare = '' AS blank, bare <> '' AND again AS dup, NOT again AND bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
             earlier IS NOT NULL AND (left(earlier, 1) || left(role, 1)) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
             count_if(cut) AS truncated, count_if(illegal) AS illegal FROM f GROUP BY conv_id),
s AS (SELECT conv_id, n, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', l := '')::{kind} AS p0, NULL::{kind} AS p1, NULL::{kind} AS p2, NULL::{kind} AS p3 FROM n
      UNION ALL
      SELECT conv_id, n, i, {", ".join(f"{e} AS {p}" for p, e in states.items())}
      FROM ({inserted("(SELECT s.conv_id, s.n, f.i, f.role, f.text, f.blank OR f.dup AS gone, CASE WHEN f.cut THEN " + str(TRUNCATED) + " ELSE 0 END AS late, p0, p1, p2, p3"
                      " FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)", "conv_id, n, i, role, text, gone, late")})),
e AS (SELECT conv_id, {least("p0", "a")} AS best FROM ({inserted("(SELECT * FROM s WHERE i = n)", "conv_id")})),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.l, '')) AS repaired_sha256
FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


QUERIES = {"op12_turn_repair": op12_turn_repair}
ORACLE = {"op12_turn_repair": _op12_sql()}
