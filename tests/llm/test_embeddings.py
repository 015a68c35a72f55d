import duckdb
import numpy as np
import pytest

from siltstone.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, unit string, n int"


def near(rng, v, cos):
    w = rng.standard_normal(len(v))
    w -= w @ v * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], None if l is None else int(l), 1, "x", 2) for i, v, l in rows], SCHEMA).repartition(3)


def brute(rows, least=0.98):
    ok = {}
    for i, v, l in rows:
        if i is not None and l is not None and v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v):
            ok[i] = (l, np.array([np.float32(x) for x in v], float))
    ids = sorted(ok)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (la, va), (lb, vb) = ok[a], ok[b]
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= least:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in comp:
                    comp[x] = i
                    stack += links[x]
    return {i: (i, len(links.get(i, ())), comp.get(i, i), comp.get(i, i) == i) for i, _, _ in rows if i is not None}


def cluster_rows(rng, d=64):
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        n += 1
        rows.append((n * 3 + 1, None if v is None else list(v), label))

    for k in range(25):
        base = rng.standard_normal(d)
        base /= np.linalg.norm(base)
        add(base, k % 3)
        for _ in range(rng.integers(0, 4)):
            add(near(rng, base, rng.choice([0.97, 0.979, 0.981, 0.985, 0.99, 0.999])) * rng.choice([0.01, 1, 300]), rng.choice([k % 3, k % 3, 2]))
        if k % 5 == 0:
            add(base, k % 3)
            add(base, None)
    chain = rng.standard_normal(d)
    chain /= np.linalg.norm(chain)
    for _ in range(12):
        add(chain, 1)
        chain = near(rng, chain, 0.984)
    for v in (None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * d, [1.0] * d, [-0.0, 1.0], [0.0, 1.0], [2.0], [5.0], [-5.0]):
        add(v, 0)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("d", [64, 16, 5])
def test_links_and_components_as_all_pairs_give(spark, d):
    rows = cluster_rows(np.random.default_rng(d), d)
    got = {r["vec_id"]: tuple(r) for r in em.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows) and len(got) == len(rows)


def test_hot_group_in_blocks(spark, monkeypatch):
    """Near copies of one vector and exact copies of another, over many blocks."""
    rng = np.random.default_rng(9)
    a, b = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 32)))
    rows = [(i, near(rng, a, 0.992), 1) for i in range(700)] + [(1000 + i, b, 1) for i in range(400)] + [(2000, near(rng, b, 0.99), 1)]
    got = {r["vec_id"]: tuple(r) for r in em.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert got[1000][1] == 400 and got[2000][1:3] == (400, 1000)


def test_repeated_rows_nulls_and_empty_table(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v, 1), (5, v, 1), (7, v, 1), (None, v, 1), (9, [4.0, 3.0, 2.0, 1.0], 1)]
    got = sorted((tuple(r) for r in em.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert em.near_duplicates(table(spark, rows).where("false")).count() == 0


def test_sql_says_the_same(spark):
    rows = [r for r in cluster_rows(np.random.default_rng(3), 12)]
    got = {tuple(r) for r in em.near_duplicates(table(spark, rows)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(int(i), None if v is None else [None if x is None else float(x) for x in v], None if l is None else int(l)) for i, v, l in rows])
    assert set(con.execute(em.SQL).fetchall()) == got


@pytest.mark.parametrize("length, vectors", [(64, 10_000), (64, 3_000_000), (16, 50_000), (768, 10_000)])
def test_pairs_at_the_bound_share_a_filter(length, vectors):
    """Recall at the least cosine, where it is lowest: at least 0.995 of 1500 pairs."""
    rng = np.random.default_rng(1)
    code = em.Code(length, vectors)
    v = rng.standard_normal((1500, length))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = np.array([near(rng, x, em.LEAST) for x in v])
    one, two = (np.concatenate([code.decode(x[i : i + 250]) for i in range(0, len(x), 250)]) for x in (v, w))
    shared = np.array([len(np.intersect1d(a, b)) for a, b in zip(one, two)])
    assert (shared > 0).mean() >= 0.995 and one.shape == (1500, em.LISTED)


def test_decoding_lists_the_greatest_products():
    code = em.Code(8, 4)
    rng = np.random.default_rng(2)
    v = em.unit_of(rng.standard_normal((20, 8)))
    turned = v @ code.turn
    parts = [turned[:, a:b] @ c.T for a, b, c in zip(code.cuts[:-1], code.cuts[1:], code.parts)]
    every = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(20, -1)
    for row, found in zip(every, code.decode(v)):
        assert set(found.tolist()) == set(np.argsort(-row)[: em.LISTED].tolist())
