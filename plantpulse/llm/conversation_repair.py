"""Conversation structure repair by the auction shortest-path algorithm.

A conversation's rows, in order, are columns of a lattice whose rows are the states
of the grammar ``(s?(ua)+)?``: nothing yet, after ``s``, after ``u``, after ``a``.
Arcs are edits with integer costs: Keep 0, Rerole to user or assistant 1, Delete 2
(the only one for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated
row that stays adds 5.

The cheapest repair is found by the auction algorithm (Bertsekas, 1991).  Every node has a price;
a path grows from the origin.  If the end node's price is below the least
of arc cost plus next price, the price rises to it and the path is
contracted by that node; else the path is extended to the next node that gives the least.
When the destination is reached, prices are the dual solution: an arc is tight if its cost is the
difference of its ends' prices, and every cheapest path consists of tight arcs.  From the tight arcs
that reach the destination, the ASCII-least edit is taken at every node; in a given state at most one
role is legal for Insert and Rerole, so edits fix the path.

Prices grow step by step, so a long lattice would take steps in the square of its length.  It is cut into
blocks of ``BLOCK`` columns, from the last to the first: the entry prices of a block, found by one auction
for each of the four states, are the costs of the exit arcs of the block before.
Blocks of equal codes and exit prices are solved once per task.

Rows are dealt out by conversation.  Order inside a conversation: turn (nulls
first), then role and text, so copies are next to each other.

Defined results: a null role or text counts as one space.  A role other than
system, user or assistant can be reroled or deleted, but not kept.  A conversation without rows after damage has
zero counts, an empty audit and the digest of the empty string.  Rows with a null ``conv_id``
form a conversation of their own.  Very long texts are read whole.  Repeated rows are duplicates.
An empty table gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plantpulse.llm.common import ship, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row adds unless it is deleted.
TRUNCATED_COST = 5
#: States of the grammar and where each role's initial leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTED = (NOTHING, ASSISTANT)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
#: Columns solved at once, and solved blocks remembered by a task.
BLOCK, REMEMBERED = 32, 100_000
#: Separators, as everywhere in this package.
BLANK = " \t\n\x0b\x0c\r"


def row_arcs(code: str) -> list[list[tuple[int, int, str]]]:
    """Per state, the (cost, next state, edit) of a row: code ``-`` must go, else the role's initial,
    upper case when the row is truncated (``x``: no legal role)."""
    out = []
    for state in range(4):
        arcs = [(COSTS[DELETE], state, DELETE)]
        if code != "-":
            extra = TRUNCATED_COST if code.isupper() else 0
            if code.lower() in STEPS[state]:
                arcs.append((COSTS[KEEP] + extra, STEPS[state][code.lower()], KEEP))
            arcs += [(COSTS[REROLE] + extra, STEPS[state][r], REROLE) for r in "ua" if r in STEPS[state]]
        out.append(arcs)
    return out


_INSERTS = [[(COSTS[INSERT], STEPS[s][r], INSERT) for r in "ua" if r in STEPS[s]] for s in range(4)]
_ROWS = {c: row_arcs(c) for c in "-suaxSUAX"}


def lattice(codes: str, exits: tuple[int, ...] | None) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, node, edit) per node ``4 * column + state``; the last node is the destination.

    ``exits``: cost of leaving at each state after the last row; None at the end of a conversation, where inserts
    may follow the last row and only accepted states are left.
    """
    end = 4 * (len(codes) + 1)
    arcs = []
    for column, code in enumerate(codes):
        for state in range(4):
            arcs.append([(c, 4 * column + s, e) for c, s, e in _INSERTS[state]]
                        + [(c, 4 * column + 4 + s, e) for c, s, e in _ROWS[code][state]])
    for state in range(4):
        if exits is not None:
            arcs.append([(exits[state], end, "")])
        else:
            arcs.append([(c, end - 4 + s, e) for c, s, e in _INSERTS[state]] + [(0, end, "")] * (state in ACCEPTED))
    return arcs


def auction(arcs: list[list[tuple[int, int, str]]], origin: int, prices: list[int]) -> None:
    """Raises ``prices`` (which satisfy price <= cost + next price on every arc) until a path of
    tight arcs leads from ``origin`` to the destination, the node after the last of ``arcs``."""
    end, path = len(arcs), [origin]
    while path[-1] != end:
        at = path[-1]
        least, to = min((c + prices[j], j) for c, j, _ in arcs[at])
        if prices[at] < least:
            prices[at] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def tight_nodes(arcs, prices: list[int]) -> list[list[tuple[str, int]]]:
    """Per node, the tight arcs (edit, next node) from which the destination is reached over tight arcs."""
    end = len(arcs)
    into: list[list[tuple[int, str]]] = [[] for _ in range(end + 1)]
    for i, out in enumerate(arcs):
        for c, j, e in out:
            if prices[i] == c + prices[j]:
                into[j].append((i, e))
    found: list[list[tuple[str, int]]] = [[] for _ in range(end + 1)]
    seen, todo = {end}, [end]
    while todo:
        j = todo.pop()
        for i, e in into[j]:
            found[i].append((e, j))
            if i not in seen:
                seen.add(i)
                todo.append(i)
    return found


def solve(codes: str, exits: tuple[int, ...] | None) -> list[tuple[int, str, int]]:
    """For each entry state: price of the way out, its ASCII-least edits, and the state at the last row's end."""
    arcs = lattice(codes, exits)
    end = len(arcs)
    prices = [0] * (end + 1)
    for state in range(4):
        auction(arcs, state, prices)
    tight = tight_nodes(arcs, prices)
    out = []
    for state in range(4):
        at, edits = state, []
        while True:
            edit, to = min(tight[at])
            if to == end:
                break
            edits.append(edit)
            at = to
        out.append((prices[state], "".join(edits), at - (end - 4)))
    return out


class Repairer:
    """Cheapest repairs of conversations given as one code per row (see :func:`row_arcs`)."""

    def __init__(self, block: int = BLOCK):
        self.block, self.known = block, {}

    def _solved(self, codes: str, exits: tuple[int, ...] | None) -> list[tuple[int, str, int]]:
        if (codes, exits) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[codes, exits] = solve(codes, exits)
        return self.known[codes, exits]

    def repair(self, codes: str) -> tuple[int, str]:
        """Cost and ASCII-least edits."""
        cuts = list(range(0, len(codes), self.block)) or [0]
        solved, exits, paid = [], None, 0
        for lo in reversed(cuts):
            block = self._solved(codes[lo:lo + self.block], exits)
            solved.append(block)
            base = min(p for p, _, _ in block)
            exits = tuple(p - base for p, _, _ in block)
            paid += base
        state, edits = NOTHING, []
        for block in reversed(solved):
            edits.append(block[state][1])
            state = block[state][2]
        return paid + exits[NOTHING], "".join(edits)


def initial(role: str) -> str:
    return role[:1]


def fault_codes(rows: list[tuple[str, str]]) -> tuple[str, dict[str, int]]:
    """One code per (role, text), and how many rows have each fault (the first of blank, duplicate, truncated)."""
    counts, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [], set()
    last = None
    for role, text in rows:
        body, start = text.rstrip(BLANK), initial(role)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        code = start if start in ROLES and start else "x"
        if not body:
            counts["blank"] += 1
            code = "-"
        elif key in seen:
            counts["duplicate"] += 1
            code = "-"
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            code = code.upper()
        seen.add(key)
        counts["illegal"] += last is not None and last + start not in LEGAL_PAIRS
        last = start
        codes.append(code)
    return "".join(codes), counts


def repaired_rows(rows: list[tuple[str, str]], audit: str):
    """The (role, text) rows that the edits leave."""
    state, at = NOTHING, 0
    for edit in audit:
        if edit == INSERT:
            start = next(r for r in "ua" if r in STEPS[state])
            yield ROLES[start], ""
        else:
            role, text = rows[at]
            at += 1
            if edit == DELETE:
                continue
            start = initial(role)
            if edit == REROLE:
                start = next(r for r in "ua" if r in STEPS[state])
                role = ROLES[start]
            yield role, text
        state = STEPS[state][start]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROW = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_OWN, _DIGEST = T.StructField("repaired", T.ArrayType(_ROW)), T.StructField("repaired_sha256", T.StringType())


def repair_conversations(rows: DataFrame, with_texts: bool = True) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (conv_id, turn, role, text, present): faults, cost, edits and repaired rows.

    Rows with ``present`` false only name their conversation.  ``with_texts=False`` gives the digest of the repaired
    rows (``repaired_sha256``) in place of the rows themselves.
    """
    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("audit", T.StringType()),
                           _OWN if with_texts else _DIGEST])
    arrow = to_arrow_schema(schema)

    def run(batches):
        repairer = Repairer()
        for conv_id, group in conversations(batches):
            own = [(t, r, x) for t, r, x, here in group if here]
            said = [(r, x) for _, r, x in own]
            codes, counts = fault_codes(said)
            cost, audit = repairer.repair(codes)
            turns = {t for t, _, _ in own if t is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            row = {"conv_id": conv_id, "gaps": gaps, **counts, "cost": cost, "audit": audit}
            if with_texts:
                row["repaired"] = [{"role": r, "text": x} for r, x in repaired_rows(said, audit)]
            else:
                digest = hashlib.sha256()
                for i, (r, x) in enumerate(repaired_rows(said, audit)):
                    digest.update(f"{chr(10) if i else ''}{r}:{x}".encode("utf-8", "surrogatepass"))
                row["repaired_sha256"] = digest.hexdigest()
            yield row

    def batched(batches):
        waiting = []
        for row in run(batches):
            waiting.append(row)
            if len(waiting) == 1000:
                yield pa.RecordBatch.from_pylist(waiting, schema=arrow)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=arrow)

    dealt = rows.select("conv_id", "turn", "role", "text", "present").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "turn", "role", "text")  # nulls first
    return dealt.mapInArrow(batched, schema)


def conversations(batches):
    """(conv_id, rows) of batches sorted by conversation."""
    have, group, at = False, [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, *row in zip(*columns, strict=True):
            if have and conv_id != at:
                yield at, group
                group = []
            have, at = True, conv_id
            group.append(row)
    if have:
        yield at, group


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` after the damage that the hash of a row's conversation and turn decides."""
    space = F.lit(" ")
    known = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
                      (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("__copy"))
    return out.drop("__copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), with_texts=False)
