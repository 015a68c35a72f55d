import random
from itertools import permutations

import duckdb
import pytest

from siltstone.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, part string, n long, E string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The failures of each row (doc_id, text, source), by definition."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        f += "E" * any(d is not None and doc_id is not None and d < doc_id and (x or "") == t for d, x, _ in rows)
        out.append(f)
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failing = fails(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, failing) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                kept = [(d, x) for d, x in left if f not in x]
                redundant = sum(f in x for _, x in mine) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, sum(x == f for _, x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[f] += len(gone)
                left = kept
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def case(seed, n=70):
    rng = random.Random(seed)
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "A a", "A" * 10, "x # y", "  x y　z ", "é" * 300]
    for _ in range(18):
        pool = rng.choice([30, 400])
        texts.append(" ".join(rng.choice(["w", "W", "w&"] if rng.random() < 0.3 else ["w"]) + str(rng.randrange(pool)) for _ in range(rng.choice([5, 199, 200, 201, 300]))))
    rows = [(rng.choice([i, i, i, None]) if rng.random() < 0.2 else i, rng.choice(texts), rng.choice([None, "", "s0", "s1", "Ä"])) for i in range(n)]
    rows += rng.sample(rows, 5)  # repeated rows
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(d, t, s, "clash", 1, "x") for d, t, s in rows], DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_row_as_by_definition(spark, seed):
    rows, labels = case(seed)
    got = fa.audit(*frames(spark, rows, labels)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want


def test_sql_says_the_same(spark):
    rows, labels = case(3)
    seen, unique = set(), []
    for r in rows:  # the SQL takes doc_ids as they should be
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    got = {tuple(r) for r in fa.audit(*frames(spark, unique, labels)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", unique)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert set(con.execute(fa.SQL).fetchall()) == got


def test_a_hot_text_and_an_empty_table(spark):
    rows = [(i, "same text", "hot" if i % 3 else None) for i in range(300)]
    docs, labels = frames(spark, rows, [(0, 1, 1)])
    got = {r["part"]: r for r in fa.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert (got["hot"]["removed"], got[""]["removed"], got[""]["kept"], got[""]["good_lost"]) == (200, 99, 1, 0)
    assert fa.audit(docs.where("false"), labels).count() == 0


def test_joint_counts_invert(spark):
    rows, labels = case(4)
    joint = {r["part"]: r for r in fa.joint_failures(fa.failure_cells(*frames(spark, rows, labels))).collect()}
    failing = fails(rows)
    for part, r in joint.items():
        mine = [f for (_, _, s), f in zip(rows, failing) if (s or "") == part]
        for s in range(32):
            held = [f for i, f in enumerate("ABCDE") if s >> i & 1]
            assert r["every"][s] == sum(all(h in f for h in held) for f in mine)
