"""Conversation structure repair: turns are aligned with alternating target strings, the cheapest edits are the audit.

Targets are the strings of `(s?(ua)+)?`: nothing, user and assistant in turn, or the same after a system turn. One
Wagner-Fischer matrix, filled from the end, serves all feasible lengths, as shorter targets are ends of longer ones: its
columns are the target symbols that are still to come. Ukkonen's band follows from the cost that a repair may have at most,
which is doubled until a repair keeps it; every cheapest alignment then lies inside. Alignments of all lengths that cost
the least are traced back, and the least audit in ASCII order is taken. Conversations whose band would have over CELLS cells
are aligned in the same matrix with its columns folded by what the next symbol is: exact, and linear in their turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import bound_batches, shuffle_parts, slices

#: What edits cost. An undeleted truncated turn costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Cells of a band that are filled at most; the excess over unavoidable costs that is tried first.
CELLS, FIRST_EXCESS = 1 << 20, 6
#: Characters of results that a task hands on together.
CHARS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}

Row = tuple[str, bool, int]  # initial of the role, whether it must go, cost of staying (0 or TRUNCATED)
Plan = tuple[int, str, list[tuple[int, str]]]  # cost, audit, repaired turns: place among the rows (-1: inserted), symbol

REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


def symbol(left: int) -> str:
    """The target symbol that comes next when so many are left."""
    return "a" if left % 2 else "u"


def banded(rows: list[Row], excess: int) -> Plan | None:
    """The cheapest edits, if they cost at most so much more than what can't be avoided."""
    n = len(rows)
    free = sum(1 for _, gone, stays in rows if not gone and stays)
    fewer = min(free, excess) + (excess - min(free, excess)) // DELETE  # a truncated turn may go for one more than it costs
    low, cost, keepable = [0] * (n + 1), [[]] * (n + 1), 0
    cost[n] = [INSERT * j for j in range(excess // INSERT + 1)]
    for i in range(n - 1, -1, -1):
        initial, gone, stays = rows[i]
        keepable += not gone
        low[i], high = max(0, keepable - fewer), keepable + excess // INSERT
        below, first, line = cost[i + 1], low[i + 1], []
        for j in range(low[i], high + 1):
            best = DELETE + below[j - first] if first <= j < first + len(below) else inf
            if not gone and first < j <= first + len(below):
                best = min(best, stays + below[j - 1 - first] + (0 if initial == symbol(j) else REROLE))
            if line:
                best = min(best, line[-1] + INSERT)
            line.append(best)
        cost[i] = line

    def at(i: int, j: int) -> float:
        return cost[i][j - low[i]] if 0 <= j - low[i] < len(cost[i]) else inf

    starts = [(at(0, j), -1, j) for j in range(low[0], low[0] + len(cost[0])) if j % 2 == 0]
    gone_before = 0
    for i, (initial, gone, stays) in enumerate(rows):  # the system turn is kept, what stands before it goes
        if initial == "s" and not gone:
            starts += [(gone_before + stays + at(i + 1, j), i, j) for j in range(max(2, low[i + 1]), low[i + 1] + len(cost[i + 1])) if j % 2 == 0]
        gone_before += DELETE
    least = min(starts)[0] if starts else inf
    if least - sum(DELETE if gone else stays for _, gone, stays in rows) > excess:
        return None
    best = None
    for c, system, j in starts:
        if c > least:
            continue
        audit, out = ["D" * system + "K"] if system >= 0 else [], [(system, "s")] if system >= 0 else []
        i = system + 1
        while i < n or j:
            here = at(i, j)
            if i < n and DELETE + at(i + 1, j) == here:
                audit.append("D")
                i += 1
                continue
            if j and INSERT + at(i, j - 1) == here:
                audit.append("I")
                out.append((-1, symbol(j)))
            else:
                audit.append("K" if rows[i][0] == symbol(j) else "R")
                out.append((i, symbol(j)))
                i += 1
            j -= 1
        found = "".join(audit)
        if best is None or found < best[1]:
            best = (int(least), found, out)
    return best


#: States of the grammar: nothing yet, after the system turn, an assistant comes next, a user or the end comes next.
START, OPENED, ANSWER, ASK = range(4)
NEXT = {START: ("u", ANSWER), OPENED: ("u", ANSWER), ANSWER: ("a", ASK), ASK: ("u", ANSWER)}


def folded(rows: list[Row]) -> Plan:
    """The cheapest edits, with the columns of the matrix folded by the state of the grammar."""
    n = len(rows)
    cost = [[0.0] * 4 for _ in range(n + 1)]
    cost[n] = [0, 2 * INSERT, INSERT, 0]

    def edits(i: int, state: int) -> list[tuple[float, str, int, int, str]]:
        """All edits but insertions: cost in all, letter, next row, next state, symbol."""
        initial, gone, stays = rows[i]
        wanted, after = NEXT[state]
        out = [(DELETE + cost[i + 1][state], "D", i + 1, state, "")]
        if not gone:
            out.append((stays + cost[i + 1][after] + (0 if initial == wanted else REROLE), "K" if initial == wanted else "R", i + 1, after, wanted))
            if state == START and initial == "s":
                out.append((stays + cost[i + 1][OPENED], "K", i + 1, OPENED, "s"))
        return out

    for i in range(n - 1, -1, -1):
        line = [min(edits(i, s))[0] for s in range(4)]
        for _ in range(2):  # insertions lead from state to state; two in a row change no more than the state they end in
            line = [min(line[s], INSERT + line[NEXT[s][1]]) for s in range(4)]
        cost[i] = line
    i, state, audit, out = 0, START, [], []
    while i < n or cost[n][state]:
        choices = edits(i, state) if i < n else []
        choices.append((INSERT + cost[i][NEXT[state][1]], "I", i, NEXT[state][1], NEXT[state][0]))
        _, letter, after, to, made = min((c for c in choices if c[0] == cost[i][state]), key=lambda c: c[1])
        audit.append(letter)
        if made:
            out.append((i if after > i else -1, made))
        i, state = after, to
    return int(cost[0][START]), "".join(audit), out


def cheapest(rows: list[Row]) -> Plan:
    """The cheapest edits, the least audit among them."""
    excess = FIRST_EXCESS
    while len(rows) * (excess // INSERT + excess) <= CELLS:
        found = banded(rows, excess)
        if found:
            return found
        excess *= 2
    return folded(rows)


def repair_one(conv_id: int | None, rows: list[tuple[int | None, str, str, bool, bool]]) -> tuple:
    """The row of REPAIRED of a conversation: rows of turn, role, text, blank, truncated, in order."""
    seen, faults, plan = set(), [0, 0, 0], []
    for _, role, text, blank, truncated in rows:
        twice = (role, text) in seen
        seen.add((role, text))
        fault = 0 if blank else 1 if twice else 2 if truncated else None
        if fault is not None:
            faults[fault] += 1
        plan.append((role[:1], fault in (0, 1), TRUNCATED if fault == 2 else 0))
    initials = [p[0] for p in plan]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
    cost, audit, out = cheapest(plan) if rows else (0, "", [])
    repaired = [(rows[i][1] if i >= 0 and rows[i][1][:1] == s else NAMES[s], rows[i][2] if i >= 0 else "") for i, s in out]
    return conv_id, gaps, *faults, illegal, cost, audit, [{"role": r, "text": t} for r, t in repaired]


TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
FIELDS = [(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired", pa.list_(TURN))]


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS)) == ""


def is_truncated(text: Column) -> Column:
    """Whether the last character that isn't blank ends no sentence."""
    return ~F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).isin(".", "!", "?")


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Faults of every conversation, the cheapest edits that mend its structure, and the turns they leave. Returns REPAIRED.

    turns: conv_id, turn, role, text; further columns are left out but the one that copies names, which says how often a
    row stands there (0: the conversation is known, the row isn't there). Rows come by turn, nulls first, ties by role and text; a
    null role or text is one space, conversations without id are one. A blank turn is of white space only, a duplicate
    says what its role said before, a truncated one ends no sentence; a turn counts for the first of these. Blank and
    duplicate turns go. A role that is empty or starts with another letter than s, u and a can't be kept. No rows give
    no rows. The texts of a conversation are in one task.
    """
    bound_batches(turns.sparkSession)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    rows = rows.withColumns({"blank": is_blank(F.col("text")), "ends": is_truncated(F.col("text"))})
    dealt = rows.repartition(shuffle_parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: object = run  # no conversation yet
        held, out, size = [], [], 0
        for batch in slices(batches):
            for conv_id, turn, role, text, n, blank, ends in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if conv_id != own:
                    if own is not run:
                        out.append(repair_one(own, held))
                    own, held = conv_id, []
                    if size > CHARS:
                        yield packed(out)
                        out, size = [], 0
                held += [(turn, role, text, blank, ends)] * n
                size += len(text) + 64
        if own is not run:
            out.append(repair_one(own, held))
        yield packed(out)

    return dealt.mapInArrow(run, REPAIRED)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], [c for c, _ in FIELDS])


def digests(repaired: DataFrame) -> DataFrame:
    """Repaired conversations with a digest in place of their turns."""
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(said.cast("binary"), 256)).drop("repaired")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults that a hash of conversation and turn deals out: conv_id, turn, role, text, copies.

    Of twenty hashes one drops the row (copies 0), one empties its text, one takes its sentence ends away, one repeats it,
    one makes its role user. Null values count as one space; a null turn stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
