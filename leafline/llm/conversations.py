"""Repair of conversation structure: the cheapest edits, and of these the least audit.

A conversation's turns, in order, are to have the roles ``system?`` and then
``user assistant`` pairs.  A turn may be kept, given another role, or deleted,
and turns may be inserted; a state says what may come next, so the edits of a
conversation are a path through (turn, state) nodes.  Backward sums give every
node its least cost; arcs that reach it are optimal.

Of all cheapest paths the one whose audit (the initials of its edits) is the
least is found by prefix doubling: optimal arcs are ranked by their initial,
then by the ranks of themselves and of the arc that follows 2**k places on,
which ranks them by audits of length 2, 4, 8 and so on; the least arc at the
start is followed through the doubled pointers, which double the path as well.
All conversations of a task are ranked at once.

Turns are sorted by range, not by conversation, so a conversation of any share
of the rows is many stretches.  Only the first and last conversation of a task
can go on in another one.  Such a stretch is solved for each state that it may
leave to; its costs and the order of its audits are all that is passed on, two
narrow rows a task, from which the state at each border follows.

Defined results: null roles and texts are one space; a null turn comes first;
turns of one number are ordered by role and text; a null conv_id is one
conversation; repeated turns are one turn with a number of copies, of which all
but one are duplicates; a role that begins with none of s, u and a cannot be
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.spread import keep, slots, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
EDITS = "DIKR"  # in the order of their initials
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults
BLANKS = " \t\n\x0b\x0c\r"
PART_BYTES = 32 << 20  # text of a part, about
PREFIX = 64  # characters of roles and texts that ranges are sampled by

# states: nothing yet, after system, after user, after assistant; the first and the last may end
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # by inserting, or by a new role
KEPT = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])  # by initial (none, s, u, a) and state
FAR = 1 << 40
ENDS = np.array([0, FAR, FAR, 0])

TURNS = "conv_id long, part int, seq long, turn long, role string, text string, fault int, copies long"
EDITED = "conv_id long, part int, seq long, turn long, edit string, times long, role string, text string, fault int, illegal long, cost long"


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Least costs of nodes from those of their other arcs: one or two insertions may come first."""
    for _ in range(2):
        cost = np.minimum(cost, cost[:, NEXT] + INSERT)
    return cost


class Solution:
    """Costs, optimal arcs and their ranks for stretches of turns.

    ``first``: turns before each stretch, one entry more than stretches;
    ``forced``: the turn must be deleted; ``initial``: 1, 2, 3 for s, u, a;
    ``after``: costs after each stretch, by state; ``ends``: nothing comes
    after it, so turns may be inserted at its end.
    """

    def __init__(self, first: np.ndarray, forced: np.ndarray, initial: np.ndarray, cut: np.ndarray, after: np.ndarray, ends: np.ndarray):
        n = np.diff(first)
        base = first[:-1] + np.arange(len(n))  # of the layers, one more than turns
        layers = int(first[-1]) + len(n)
        self.base, self.n = base, n
        cost = np.full((layers, 4), FAR, np.int64)
        cost[base + n] = np.where(ends[:, None], _inserted(after.copy()), after)
        extra = TRUNCATED * cut.astype(np.int64)
        target = KEPT[initial]  # turn, state
        allowed = (target >= 0) & ~forced[:, None]
        order = np.argsort(n, kind="stable")
        for back in range(1, int(n.max(initial=0)) + 1):
            some = order[np.searchsorted(n[order], back) :]
            layer, row = base[some] + n[some] - back, first[:-1][some] + n[some] - back
            later = cost[layer + 1]
            kept = np.where(allowed[row], np.take_along_axis(later, np.maximum(target[row], 0), 1) + KEEP + extra[row, None], FAR)
            reroled = np.where(forced[row, None], FAR, later[:, NEXT] + REROLE + extra[row, None])
            cost[layer] = _inserted(np.minimum(np.minimum(later + DELETE, kept), reroled))
        self.cost = np.minimum(cost, FAR)

        # arcs by layer, state and edit; only the optimal ones are kept
        last = np.zeros(layers, bool)
        last[base + n] = True
        turn_layers = np.flatnonzero(~last)  # in the order of the turns
        head = np.full((layers, 4, 4), -1, np.int64)
        paid = np.zeros((layers, 4, 4), np.int64)
        node = np.arange(layers)[:, None] * 4
        head[turn_layers, :, 0] = node[turn_layers] + 4 + np.arange(4)
        paid[:, :, 0] = DELETE
        may_insert = ~last
        may_insert[base[ends] + n[ends]] = True
        head[may_insert, :, 1] = node[may_insert] + NEXT
        paid[:, :, 1] = INSERT
        head[turn_layers, :, 2] = np.where(allowed, node[turn_layers] + 4 + target, -1)
        paid[turn_layers, :, 2] = KEEP + extra[:, None]
        head[turn_layers, :, 3] = np.where(forced[:, None], -1, node[turn_layers] + 4 + NEXT)
        paid[turn_layers, :, 3] = REROLE + extra[:, None]
        flat = self.cost.ravel()
        optimal = (head >= 0) & (self.cost[:, :, None] < FAR) & (np.where(head >= 0, flat[head], FAR) + paid == self.cost[:, :, None])
        arcs = np.flatnonzero(optimal)
        self.edit, self.head, self.tail = arcs % 4, head.ravel()[arcs], arcs // 4
        self._rank(layers, int((2 * n + 4).max(initial=1)))

    def _rank(self, layers: int, longest: int) -> None:
        """Ranks of the arcs by their audits, prefix by prefix, and the pointers 1, 2, 4, ... places on."""
        end = len(self.edit)
        bounds = np.searchsorted(self.tail, np.arange(layers * 4 + 1))
        rank = np.append(self.edit + 1, 0)  # what ends is the least
        self.leave = self._least(rank, bounds, end)
        pointer = np.append(self.leave[self.head], end)
        self.pointers, reach = [pointer], 1
        while reach < longest:
            rank = np.unique(rank * (end + 2) + rank[pointer], return_inverse=True)[1]
            self.leave = self._least(rank, bounds, end)
            pointer = pointer[pointer]
            self.pointers.append(pointer)
            reach *= 2
        self.rank = rank

    @staticmethod
    def _least(rank: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
        """Per node the arc of the least rank, or ``end`` if it has none; edits of a node's arcs differ, so there is one."""
        out = np.full(len(bounds) - 1, end)
        some = np.flatnonzero(np.diff(bounds) > 0)
        if len(some):
            best = np.minimum.reduceat(rank[:end], bounds[:-1][some])
            owner = np.repeat(np.arange(len(some)), np.diff(bounds)[some])
            at = np.flatnonzero(rank[:end] == best[owner])
            out[some[owner[at[::-1]]]] = at[::-1]
        return out

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of every stretch's least path from a state, in order, and the stretch of each."""
        end = len(self.edit)
        arc = self.leave[self.base * 4 + entry]
        which, place = np.arange(len(arc)), np.zeros(len(arc), np.int64)
        which, place, arc = (v[arc < end] for v in (which, place, arc))
        for k, pointer in enumerate(self.pointers):
            more = pointer[arc]
            on = more < end
            which, place, arc = np.concatenate([which, which[on]]), np.concatenate([place, place[on] + (1 << k)]), np.concatenate([arc, more[on]])
        order = np.lexsort((place, which))
        return arc[order], which[order]


def faults(conversations: DataFrame) -> DataFrame:
    """Different turns (conv_id, turn, role, text) with their copies and the first fault of the first copy."""
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("said", said).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    # only what is said in several turns is joined back
    again = rows.groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("what")).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(again, rows["conv_id"].eqNullSafe(again["conv"]) & (rows["said"] == again["what"]), "left")
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"), "copies")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), *batch.columns[1:]], ["conv_id", "part", "seq", "turn", "role", "text", "fault", "copies"])
        seq += n


def ordered_turns(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """Turns in order over all parts: part and seq are the place of a turn; kept in the shared folder."""
    if parts is None:
        total, n = conversations.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        parts = max(slots(conversations.sparkSession), math.ceil(((total or 0) + 256 * n) / PART_BYTES))
    rows = faults(conversations)
    # the first characters of a text only order turns whose roles are told apart by as many
    head = F.when(F.length("role") <= PREFIX, F.substring("text", 1, PREFIX))
    front = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    dealt = rows.repartitionByRange(parts, *front, F.substring("role", 1, PREFIX), head)
    return keep(dealt.sortWithinPartitions(*front, "role", "text").mapInArrow(_numbered, TURNS))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forced deletions, initials and truncations of turns."""
    fault = table.column("fault").to_numpy()
    initials = {"s": 1, "u": 2, "a": 3}
    initial = np.array([initials.get(r[:1], 0) for r in table.column("role").to_pylist()], np.int64)
    return (fault == BLANK) | (fault == DUPLICATE), initial, fault == CUT


def _stretches(table: pa.Table) -> np.ndarray:
    """Where conversations begin among sorted turns, and the number of turns."""
    ids = table.column("conv_id").combine_chunks()
    known, values = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
    new = (known[1:] != known[:-1]) | (values[1:] != values[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


BORDER = "conv_id long, part int, only boolean, last boolean, costs array<long>, ranks array<long>, role int"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last conversation of a part, solved for each state that they may leave to."""
    whole = list(batches)
    if not sum(b.num_rows for b in whole):
        return
    table = pa.Table.from_batches(whole)
    first = _stretches(table)
    ends = [(first[0], first[1])] if len(first) == 2 else [(first[0], first[1]), (first[-2], first[-1])]
    out = []
    for k, (a, b) in enumerate(ends):
        forced, initial, cut = _arrays(table.slice(a, b - a))
        after = np.where(np.eye(4, dtype=bool), 0, FAR)
        many = Solution(np.arange(5) * (b - a), np.tile(forced, 4), np.tile(initial, 4), np.tile(cut, 4), after, np.zeros(4, bool))
        cost, rank = np.empty((4, 4), np.int64), np.empty((4, 4), np.int64)  # by entry and leaving state
        for leave in range(4):
            nodes = many.base[leave] * 4 + np.arange(4)
            cost[:, leave], rank[:, leave] = many.cost.ravel()[nodes], many.rank[many.leave[nodes]]
        out.append({"conv_id": table.column("conv_id")[int(a)].as_py(), "part": table.column("part")[0].as_py(), "only": len(ends) == 1, "last": k == len(ends) - 1, "costs": cost.ravel().tolist(), "ranks": rank.ravel().tolist(), "role": int(initial[-1])})
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("only", pa.bool_()), ("last", pa.bool_()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("role", pa.int32())])
    yield pa.RecordBatch.from_pylist(out, schema)


STATE = "part int, entry int, before int, after array<long>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's stretches, in order: the state at the start of each, the initial before it, and the costs after it."""

    def solve(chain: list[dict]) -> pa.RecordBatch:
        cost = [np.array(c["costs"]).reshape(4, 4) for c in chain]
        rank = [np.array(c["ranks"]).reshape(4, 4) for c in chain]
        after = [_inserted(ENDS[None].copy())[0]]
        for m in cost[:0:-1]:
            after.insert(0, np.minimum((m + after[0]).min(axis=1), FAR))
        state, entries = START, []
        for m, r, later in zip(cost, rank, after):
            entries.append(state)
            total = m[state] + later
            least = np.flatnonzero(total == total.min())
            state = int(least[r[state][least].argmin()])
        rows = []
        for k, c in enumerate(chain):
            # a part's first stretch learns how it is entered, its last one what comes after
            rows.append({"part": c["part"], "entry": entries[k] if c["only"] or not c["last"] else None, "before": chain[k - 1]["role"] if k and (c["only"] or not c["last"]) else None, "after": after[k].tolist() if c["last"] and k < len(chain) - 1 else None})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("before", pa.int32()), ("after", pa.list_(pa.int64()))]))

    chain: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if chain and chain[0]["conv_id"] != row["conv_id"]:
                yield solve(chain)
                chain = []
            chain.append(row)
    if chain:
        yield solve(chain)


LEGAL = {(1, 2), (2, 3), (3, 2)}  # initials that may follow one another


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = list(batches)
    if not sum(b.num_rows for b in whole):
        return
    table = pa.Table.from_batches(whole)
    first = _stretches(table)
    n = len(first) - 1
    forced, initial, cut = _arrays(table)
    entry, ends, after = np.zeros(n, np.int64), np.ones(n, bool), np.tile(ENDS, (n, 1))
    side = {c: table.column(c)[0].as_py() for c in ("entry", "before", "after")}
    if side["entry"] is not None:
        entry[0] = side["entry"]
    if side["after"] is not None:
        after[-1], ends[-1] = side["after"], False
    solved = Solution(first, forced, initial, cut, after, ends)
    arcs, which = solved.paths(entry)
    edit, head, tail = solved.edit[arcs], solved.head[arcs], solved.tail[arcs]
    row = tail // 4 - which  # the layer of a stretch is as many places on as there are stretches before it
    state = head % 4
    on = edit != EDITS.index("I")
    row = np.where(on, row, -1)
    copies = table.column("copies").to_numpy()
    illegal = np.zeros(table.num_rows, np.int64)
    legal = np.zeros((4, 4), bool)
    for pair in LEGAL:
        legal[pair] = True
    inner = np.ones(table.num_rows, bool)
    inner[first[:-1]] = False
    illegal[1:] += inner[1:] & ~legal[initial[:-1], initial[1:]]
    if side["before"] is not None:
        illegal[0] += not legal[side["before"], initial[0]]
    illegal += copies - 1  # a turn after its copy

    roles, names = table.column("role").to_pylist(), {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
    kept, inserted, deleted = EDITS.index("K"), EDITS.index("I"), EDITS.index("D")
    price = np.array([DELETE, INSERT, KEEP, REROLE])
    # the copies of a turn follow it as deletions
    more = on & (np.where(on, copies[row], 1) > 1)
    at = np.repeat(np.arange(len(arcs)), 1 + more)
    copy = np.zeros(len(at), bool)
    copy[1:] = at[1:] == at[:-1]
    text = table.column("text").combine_chunks()
    convs, turns, fault = table.column("conv_id").combine_chunks(), table.column("turn").combine_chunks(), table.column("fault").to_numpy()
    start = first[:-1]
    part = table.column("part")[0].as_py()
    step = 1 << 14
    for lo in range(0, len(at), step):
        a, again = at[lo : lo + step], copy[lo : lo + step]
        e, r = np.where(again, deleted, edit[a]), row[a]
        owner = np.where(r >= 0, r, start[which[a]])
        shown = e != deleted
        own = shown & (e != inserted)
        role = [(roles[i] if kind == kept else names[s]) if show else None for i, kind, s, show in zip(r.tolist(), e.tolist(), state[a].tolist(), shown.tolist())]
        texts = pa.array(np.where(own, r, 0), mask=~own)
        taken = text.take(texts)
        taken = pc.if_else(pa.array(shown & ~own), pa.scalar("", pa.string()), taken)
        times = np.where(again, copies[r] - 1, 1)
        what = np.where(r < 0, 0, fault[r])
        what = np.where(again & (what != BLANK), DUPLICATE, what)
        cost = np.where(again, DELETE * times, price[e] + np.where(own & (what == CUT), TRUNCATED, 0))
        yield pa.RecordBatch.from_arrays(
            [
                convs.take(pa.array(owner)), pa.array(np.full(len(a), part, np.int32)), pa.array(np.arange(lo, lo + len(a))), turns.take(pa.array(np.where(r >= 0, r, 0), mask=r < 0)),
                pa.array([EDITS[x] for x in e.tolist()]), pa.array(times), pa.array(role, pa.string()), taken, pa.array(what.astype(np.int32)),
                pa.array(np.where(again | (r < 0), 0, illegal[r])), pa.array(cost),
            ],
            ["conv_id", "part", "seq", "turn", "edit", "times", "role", "text", "fault", "illegal", "cost"],
        )


def repair(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """All edits: conv_id, place (part, seq), turn, edit (K, R, D or I), times, the repaired role and text (null if deleted), fault, illegal steps before it, cost."""
    small_batches(conversations.sparkSession)
    turns = ordered_turns(conversations, parts)
    borders = turns.mapInArrow(_borders, BORDER)
    chains = borders.repartition(slots(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_chained, STATE)
    sides = chains.groupBy("part").agg(F.max("entry").alias("entry"), F.max("before").alias("before"), F.max("after").alias("after"))
    # one narrow row a part, so its size is bounded by their number; broadcast, as it must not disturb the order of the turns
    sides = keep(sides).withColumnRenamed("part", "at")
    return turns.join(F.broadcast(sides), F.col("part") == F.col("at"), "left").drop("at").mapInArrow(_edited, EDITED)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Report:
    """What is counted of one conversation while its edits pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turn, self.low, self.different = conv_id, None, None, 0
        self.counts, self.illegal, self.cost, self.audit, self.digest, self.any = [0, 0, 0, 0], 0, 0, [], hashlib.sha256(), False

    def add(self, e: dict) -> None:
        self.audit.append(e["edit"] * e["times"])
        self.illegal += e["illegal"]
        self.cost += e["cost"]
        if e["edit"] != "I":
            self.counts[e["fault"]] += e["times"]
        if e["turn"] is not None and e["turn"] != self.turn:
            self.low = e["turn"] if self.low is None else self.low
            self.turn, self.different = e["turn"], self.different + 1
        if e["role"] is not None:
            self.digest.update((("\n" if self.any else "") + f"{e['role']}:{e['text']}").encode())
            self.any = True

    def row(self) -> dict:
        gaps = self.turn - self.low + 1 - self.different if self.different else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in REPORT.replace(" long", "").replace(" string", "").split(", ")])
    now, rows = None, []
    for batch in batches:
        for e in batch.to_pylist():
            if now is None or now.conv_id != e["conv_id"]:
                if now is not None:
                    rows.append(now.row())
                now = _Report(e["conv_id"])
            now.add(e)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal steps, cost, audit, and the digest of the repaired turns.

    A digest takes its text in one sequence, so a conversation's edits pass
    through one task, as a stream; the task holds its audit and no text.
    """
    return edits.repartition(slots(edits.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_reported, REPORT)
