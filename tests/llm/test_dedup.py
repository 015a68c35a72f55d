import random
import re

import pyarrow as pa
import pytest

from siltstone.llm import line_windows, minhash, substrings
from siltstone.session import Scratch


def plain_windows(pairs, width=3):
    seen, out = {}, {}
    for doc_id, t in sorted(pairs):
        ls = (t or "").split("\n") if t is not None else []
        for i in range(len(ls) - width + 1):
            w = tuple(ls[i : i + width])
            if re.sub(r"\s+", "", "".join(w)):
                seen.setdefault(w, (doc_id, i))
    for doc_id, t in pairs:
        ls = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(ls) - width + 1):
            w = tuple(ls[i : i + width])
            if re.sub(r"\s+", "", "".join(w)) and seen[w] < (doc_id, i):
                gone |= set(range(i, i + width))
        out[doc_id] = (t if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone))
    return out


def test_line_windows_against_plain_python(docs, pairs):
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_removed"]) for r in line_windows.dedup_line_windows(docs).collect()}
    expected = plain_windows(pairs)
    assert got == expected and sum(n for _, _, n in expected.values()) > 0


def test_line_windows_edges(spark, empty):
    assert line_windows.dedup_line_windows(empty).count() == 0
    rows = [(1, "a\na\na\na\na", "x"), (2, "b\nc", "y"), (3, None, "z"), (4, "\n\n\n\n", "q"), (5, "\n\n\n\n", "q"), (6, "p\nq\nr", "h"), (6, "p\nq\nr", "h"), (None, "p\nq\nr", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").withColumnRenamed("h", "w")
    got = {(r["doc_id"], r["w"]): r["text"] for r in line_windows.dedup_line_windows(df).collect()}
    assert got[1, "x"] == "a" and got[2, "y"] == "b\nc" and got[3, "z"] is None and got[4, "q"] == got[5, "q"] == "\n\n\n\n"
    assert got[None, "t"] == "p\nq\nr" and got[6, "h"] == ""


def test_line_windows_leave_other_columns(spark):
    rows = [(1, "a\nb\nc", 7, 8, 9, 10, 11), (2, "a\nb\nc\nd", 7, 8, 9, 10, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d int, _H int, _gone int, _ls int, _key int")
    got = line_windows.dedup_line_windows(df, n_lines="lines", n_removed="gone").orderBy("doc_id")
    assert got.columns == [*df.columns, "lines", "gone"]
    assert [tuple(r) for r in got.collect()] == [(1, "a\nb\nc", 7, 8, 9, 10, 11, 3, 0), (2, "d", 7, 8, 9, 10, 11, 4, 3)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def plain_groups(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def grouped(df):
    rows = minhash.group_near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates_against_all_pairs(docs, pairs):
    assert grouped(docs) == plain_groups(pairs)


def family(seed, n, size, rate):
    """Near copies of one text, edited independently: most link to the original only, some to each other alone."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(rate)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = f"n{rng.randrange(10**6)}"
            elif kind == 1:
                del w[at]
            else:
                w.insert(at, f"n{rng.randrange(10**6)}")
        if i % 7 == 6:  # a copy of another copy, a little changed: linked to it, perhaps not to the original
            w = list(out[-1])
            w[rng.randrange(len(w))] = "again"
        out.append(w)
    rng.shuffle(out)
    return [(i + 1, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,n,size,rate", [(1, 90, 120, [1, 3, 6, 9, 14]), (2, 80, 60, [2, 4, 8, 12]), (3, 60, 30, [0, 1, 2, 5]), (4, 70, 200, [10, 14, 18, 25])])
def test_families_lose_no_link(spark, seed, n, size, rate):
    pairs = family(seed, n, size, rate)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    assert grouped(df) == plain_groups(pairs)


def test_near_duplicate_edges(spark, empty):
    assert grouped(empty) == {}
    rows = [(1, None, 9), (2, "", 9), (3, "One TWO", 9), (4, "one two", 9), (5, "one", 9), (6, "one", 9), (7, "x", 9), (8, " \t ", 9)]
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (0, 8)}
    odd = minhash.group_near_duplicates(spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (9, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in odd) == [(0, 0, True), (9, 9, True), (9, 9, True)]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in minhash.components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_signatures_estimate_similarity():
    base = [f"a{i}" for i in range(300)]
    texts = [" ".join(base), " ".join(base[:270] + [f"b{i}" for i in range(30)])]
    sets = minhash.shingle_sets(pa.array(texts), b"key")
    sig = minhash.signatures(sets)
    truth = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.1


def plain_substrings(pairs, width=100):
    seen, out = set(), {}
    for doc_id, t in sorted(pairs, key=lambda p: p[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc_id] = (kept, len(re.findall(b"\1+", bytes(gone))))
    return out


def test_substrings_against_plain_python(docs, pairs):
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in substrings.cut_repeats(docs).collect()}
    expected = plain_substrings(pairs)
    assert got == expected and sum(n for _, n in expected.values()) > 5


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_small_alphabets(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randrange(40, 180))) for _ in range(6)]
    pairs = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(40)] + [(50, "a" * 5000), (51, "é" * 300)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in substrings.cut_repeats(df).collect()}
    assert got == plain_substrings(pairs)


def test_substring_edges(spark, empty):
    assert substrings.cut_repeats(empty).count() == 0
    long = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(None, long, "k"), (1, long, "k"), (2, long, "k"), (2, long, "k"), (3, None, "k"), (4, "x" * 99, "k")]
    got = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans2 string")).collect()
    kept = sorted((r["doc_id"] or 0, len(r["kept"])) for r in got)
    assert kept == [(0, len(long)), (1, 0), (2, 0), (2, 0), (3, 0), (4, 99)]


def test_a_long_text_is_read_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(3000))

    def cover():
        out = []
        for _, data, bounds, base in substrings.blocks(pa.array(["x", text])):
            first, last, core = substrings.runs(data, bounds)
            out += [(base + s, base + k) for a, b, k in zip(first, last, core) for s in range(a, b + 1)]
        return sorted(out)

    whole = cover()
    monkeypatch.setattr(substrings, "_BLOCK", 256)
    parts = cover()
    # The first text goes before the second in one block, and is too short for a window.
    assert [(s - 1, k - 1) for s, k in whole] == parts and [s for s, _ in parts] == list(range(len(text) - 99))


@pytest.mark.parametrize("hot,size", [(3, 2000), (1 << 14, 2000), (5, 1 << 25)])
def test_hot_cores_and_many_ranges(spark, monkeypatch, hot, size):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "RANGE_BYTES", size)
    monkeypatch.setattr(substrings, "SAMPLED", 3)
    monkeypatch.setattr(substrings, "MOST_RANGES", 20)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    other = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    pairs = [(i, other(rng.randrange(80)) + line + rng.choice(["", line[:20], other(rng.randrange(60))]) + other(20)) for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in substrings.cut_repeats(df).collect()}
    assert got == plain_substrings(pairs)


def test_columns_of_the_same_names(spark):
    long = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, Kept int, _doc int, row int")
    got = substrings.cut_repeats(df)
    assert got.columns == ["doc_id", "text", "_doc", "row", "kept", "spans"]
    assert [(r["doc_id"], r["_doc"], r["row"], len(r["kept"])) for r in got.orderBy("doc_id").collect()] == [(1, 2, 3, len(long)), (2, 2, 3, 0)]


@pytest.mark.parametrize("small", [1, 8, 1000])
def test_multikey_order_and_shared_bytes(small):
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 20)).astype(np.uint8)) for _ in range(400)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    at = np.cumsum(size) - size
    for words, rows in ((substrings.suffix_words(data, at, size, 20), texts), (substrings.prefix_words(data, at + size, size, 20), [t[::-1] for t in texts])):
        order = substrings.multikey_order(words, small)
        ranked = [rows[i].ljust(24, b"\0") for i in order]
        assert ranked == sorted(ranked)
        shared = substrings.shared_bytes(words, order)
        expected = [next((k for k in range(24) if a[k] != b[k]), 24) for a, b in zip(ranked, ranked[1:])]
        assert shared[1:].tolist() == expected


def test_parted_equal_suffixes_are_noticed(spark):
    rows = [(0, 0, b"a", b"c"), (1, 0, b"d", b"f"), (1, 1, b"a", b"b")]
    df = spark.createDataFrame(rows, "bucket long, kind int, low binary, high binary")
    substrings._boundaries_differ(df, 1)
    with pytest.raises(ValueError):
        substrings._boundaries_differ(df.union(spark.createDataFrame([(2, 0, b"f", b"g")], df.schema)), 1)
