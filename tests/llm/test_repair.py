"""Repair against all edit sequences of short conversations, and against plain rules for the query's damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from galleria.llm import repair
from galleria.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile("(s?(ua)+)?")


def every_edit(rows, most=5):
    """(cost, audit) of the best of all edit sequences with up to `most` insertions, by search over prefixes."""
    best = None
    for inserts in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            for made in itertools.product("ua", repeat=inserts):
                for ops in itertools.product(*[["D"] if gone else ["D", "K", "u", "a"] for _, gone, _ in rows]):
                    cost, audit, roles = 3 * inserts, "", ""
                    for i in range(len(rows) + 1):
                        for p, m in zip(places, made, strict=True):
                            if p == i:
                                audit, roles = audit + "I", roles + m
                        if i == len(rows):
                            break
                        op, (initial, _, stays) = ops[i], rows[i]
                        cost += 4 if op == "D" else stays + (0 if op == "K" else 3)
                        audit += op if op in "DK" else "R"
                        roles += "" if op == "D" else (initial or "?") if op == "K" else op
                    if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def some_rows(rng, n, letters="uasx"):
    out = []
    for _ in range(n):
        gone = rng.random() < 0.2
        out.append((rng.choice(letters), gone, 0 if gone or rng.random() < 0.7 else 3))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_edits_of_all(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3):
        rows = some_rows(rng, n)
        cost, audit, _ = repair.cheapest(rows)
        assert (cost, audit) == every_edit(rows, most=3)


def test_the_folded_matrix_gives_the_same_repair():
    rng = random.Random(5)
    for _ in range(1500):
        rows = some_rows(rng, rng.randrange(14), rng.choice(["ua", "uas", "s", "uasx"]))
        assert repair.cheapest(rows) == repair.folded(rows)


def test_long_conversations_are_linear():
    rng = random.Random(6)
    rows = some_rows(rng, 60_000)
    cost, audit, out = repair.cheapest(rows)
    assert len(audit) >= 60_000 and LEGAL.fullmatch("".join(s for _, s in out)) and cost > 0


def plain(rows):
    """The query's rows by plain rules over (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = found.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, plan, seen = {"b": 0, "d": 0, "t": 0}, [], []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.append((role, text))
            if fault:
                counts[fault] += 1
            plan.append((role[:1], fault in ("b", "d"), 3 if fault == "t" else 0))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, kept = repair.folded(plan)
        lines, i, k = [], 0, 0
        for op in audit:
            if op == "I":
                lines.append({"u": "user", "a": "assistant"}[kept[k][1]] + ":")
            elif op == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
            elif op == "R":
                lines.append({"u": "user", "a": "assistant"}[kept[k][1]] + ":" + own[i][2])
            k, i = k + (op != "D"), i + (op != "I")
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_the_query_equals_plain_rules(spark, sf):
    for d in (sf, sf.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(QUERIES["op12_repair"](spark, d)) == plain(rows)


def test_awkward_turns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, None, None, "x."), (1, None, "user", "x."), (1, 2, "user", "x."), (1, 2, "user", "x.")]
    rows += [(2, 0, "", "hm."), (3, 0, "user", "long " * 30_000 + "."), (3, 1, "assistant", " "), (3, 5, "assistant", "a\x00b! \n"), (4, 9, "system", "be kind."), (5, -3, "assistant", "漢字。")]
    rows += [(i, 0, "user", "hello?") for i in range(6, 80)]  # some conversations lose their only turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    result = repair.digests(repair.repair(repair.damaged(df.selectExpr("*", "1 AS `a.b`", "2 AS blank", "3 AS copies").repartition(3)), copies="copies"))
    found = got(result)
    assert found == plain(rows)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in found)


def test_no_turns_and_whole_repairs(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    row = repair.repair(spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "no"), (1, 2, "assistant", "a.")], schema)).first()
    assert (row["cost"], row["audit"]) == (6, "KRK") and [tuple(t) for t in row["repaired"]] == [("system", "s."), ("user", "no"), ("assistant", "a.")]
