import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from siltstone.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, fault int, conv string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    say = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role0, text0 = say(role), say(text)
        role1 = "user" if kind == 4 else role0
        text1 = "" if kind == 1 else re.sub("[.!?]", "", text0) if kind == 2 else text0
        for again in range(0 if kind == 0 else 2 if kind == 3 else 1):
            out.append((conv, turn, role1, text1, role0, text0, again))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[4].encode(), r[5].encode(), r[6]))


def faults(turns):
    seen, out = set(), []
    for _, _, role, text, *_ in turns:
        shown = text.strip(" \t\n\v\f\r")
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """(cost, edits, lines) by trying every string of edits: all runs of insertions up to two before each turn and the end."""
    best = None
    choices = [("D",) if f in (1, 2) else ("D", "K", "Ru", "Ra") for f in found]
    runs = [()] + [(x,) for x in "ua"] + [(x, y) for x in "ua" for y in "ua"]
    for edits in product(*choices):
        for inserted in product(runs, repeat=len(turns) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(turns) + 1):
                for x in inserted[i]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if i == len(turns):
                    break
                e, (_, _, role, text, *_), f = edits[i], turns[i], found[i]
                audit += e[0]
                if e == "D":
                    cost += 3
                else:
                    cost += (f == 3) + 2 * (e[0] == "R")
                    lines.append({"K": role, "Ru": "user", "Ra": "assistant"}[e] + ":" + text)
            if GRAMMAR.fullmatch("".join(x.split(":")[0][:1] or "-" for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def expected(rows, search=True):
    damaged = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [t for t in damaged if t[0] == conv]
        found = faults(turns)
        known = [t[1] for t in turns if t[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        head = [gaps, *(sum(f == k for f in found) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs)]
        cost, audit, lines = cheapest(turns, found) if search else (None, None, [])
        out[conv] = (*head, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)


def conversation(rng, conv, n):
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
        text = rng.choice(["Hi.", "Yes", "What? ", "no!\n", "", None, " \t", "é。", "same.", "same."])
        rows.append((conv, rng.choice([i, i, i, i + 3, None]), role, text))
    return rows


def test_against_every_edit_string(spark):
    rng = random.Random(5)
    rows = [r for c in [*range(40), None, -7] for r in conversation(rng, c, rng.randrange(1, 4))]
    rows += rng.sample(rows, 3)
    small = [c for c in {r[0] for r in rows} if sum(t[0] == c for t in damage(rows)) <= 3]
    rows = [r for r in rows if r[0] in small]
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.audit(frame(spark, rows)).collect()}
    assert got == expected(rows)
    assert len(got) == len(small) > 20


def plain_cost(symbols):
    """The least cost by a plain table over (turn, state), forwards."""
    far = 1 << 40
    grow = lambda row: [min(row[0], far), row[1], min(row[2], row[0] + 2, row[1] + 2, row[3] + 2), min(row[3], row[2] + 2, row[0] + 4, row[1] + 4)]
    row = grow([0, far, far, far])
    for role, fault in symbols:
        new = [c + 3 for c in row]
        if fault not in (1, 2):
            extra = fault == 3
            for state, c in enumerate(row):
                asked, to = ("a", 3) if state == 2 else ("u", 2)
                new[to] = min(new[to], c + extra + (0 if role[:1] == asked else 2))
                if role[:1] == "s" and state == 0:
                    new[1] = min(new[1], c + extra)
        row = grow(new)
    return min(row[0], row[3])


def test_long_conversations(spark):
    """Costs as a plain table gives them; the edits give roles of the grammar and the digest."""
    rng = random.Random(6)
    rows = [r for c in range(30) for r in conversation(rng, c, rng.randrange(20, 200))]
    rows += conversation(rng, 99, 5000)
    table = frame(spark, rows)
    damaged = damage(rows)
    lines = {}
    for r in cv.repaired(cv.damaged(table)).orderBy("conv", "place").collect():
        lines.setdefault(r["conv"], []).append(r)
    for r in cv.audit(table).collect():
        turns = [t for t in damaged if t[0] == r["conv_id"]]
        found = faults(turns)
        assert r["cost"] == plain_cost([(t[2], f) for t, f in zip(turns, found)])
        mine = lines.get(r["conv_id"], [])
        assert GRAMMAR.fullmatch("".join(x["role"][:1] for x in mine))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in mine).encode()).hexdigest()
        assert len(r["audit"].replace("I", "")) == len(turns) and "".join(x["edit"] for x in mine) == r["audit"].replace("D", "")
        assert r["cost"] == sum({"D": 3, "I": 2, "R": 2, "K": 0}[e] for e in r["audit"]) + sum(f == 3 and e != "D" for e, f in zip(r["audit"].replace("I", ""), found))


def test_nothing_left_and_nothing_given(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = cv.audit(frame(spark, [(1, gone, "user", "Hi.")])).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.audit(frame(spark, [(1, 1, "user", "x")]).where("false")).count() == 0


@pytest.mark.parametrize("symbol", range(9))
def test_costs_are_least_from_every_state(symbol):
    after = cv.END
    before = cv.cost_before(symbol, after)
    for state in range(4):
        edits, to = cv.step(symbol, state, before, after)
        assert edits.rstrip("DKR") == "I" * edits.count("I") and before[state] >= after[to]
