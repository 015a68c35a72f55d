import random
import re

import numpy as np
import pytest
from test_dedup import family, plain_groups

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from siltstone.llm import minhash  # noqa: E402


def plain_groups_of(pairs, width, percent):
    """The smallest doc_id of each document's group, by all pairs of shingle sets."""
    sets, comp = {}, {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
        comp[i] = i
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    return {i: (len(sets[i]), c) for i, c in comp.items()}


def test_stage_takes_five_words_at_four_fifths(spark):
    """A copy whose last tenth is new goes (0.82 of five-word shingles); one edited at every 40th word stays (0.78; 0.86 of three-word ones)."""
    rng = random.Random(5)
    base = [[f"b{k}x{rng.randrange(10**6)}" for _ in range(400)] for k in range(2)]
    block = base[0][:360] + [f"new{i}" for i in range(40)]
    edited = [f"edit{i}" if i % 40 == 20 else w for i, w in enumerate(base[1])]
    pairs = [(1, " ".join(base[0])), (2, " ".join(block)), (3, " ".join(base[1])), (4, " ".join(edited)), (5, "one two three four"), (6, "One two three FOUR"), (7, None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, (_, c) in plain_groups_of(pairs, 5, 80).items() if c == i} == {1, 3, 4, 5, 7}
    assert {i for i, (_, c) in plain_groups(pairs).items() if c == i} == {1, 2, 3, 5, 7}


@pytest.mark.parametrize("seed,n,size,rate", [(1, 90, 120, [1, 3, 6, 9, 14]), (2, 80, 60, [2, 4, 8, 12]), (3, 60, 30, [0, 1, 2, 5]), (4, 70, 200, [3, 5, 7, 9, 18])])
def test_families_lose_no_link_of_five_words(spark, seed, n, size, rate):
    pairs = family(seed, n, size, rate)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.group_near_duplicates(df, 5, 80).collect()}
    assert got == plain_groups_of(pairs, 5, 80)


def test_bands_follow_the_least_similarity():
    assert [(r, minhash.BINS // r) for r in map(minhash.rows_of, (80, 85))] == [(5, 50), (6, 42)]
    with pytest.raises(ValueError):
        minhash.rows_of(100)


def copies_beside(n, seed=3):
    """A text, and n copies of another that shares 0.6 of it: each copy has one word of its own and links to the other copies alone."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    other = base[:225] + [f"o{rng.randrange(10**6)}" for _ in range(75)]
    out = [(1, " ".join(base))]
    for i in range(n):
        w = list(other)
        w[rng.randrange(len(w))] = f"own{i}"
        out.append((i + 2, " ".join(w)))
    return out


def template(n, seed=4):
    """n texts of one form, a tenth of each filled in by itself: none is linked to another, though all share bands."""
    rng = random.Random(seed)
    form = [f"f{rng.randrange(10**6)}" for _ in range(300)]
    return [(i + 1, " ".join(w if k % 30 else f"own{i}x{k}" for k, w in enumerate(form))) for i in range(n)]


@pytest.mark.parametrize("make,most", [(copies_beside, 15), (template, 15)])
def test_compared_pairs_grow_with_the_group_not_its_square(spark, monkeypatch, make, most):
    edges, compared = minhash._edges, []
    for n in (60, 120):
        seen = []
        monkeypatch.setattr(minhash, "_edges", lambda *args: seen.append(edges(*args).cache()) or seen[-1])
        pairs = make(n)
        df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.group_near_duplicates(df).collect()}
        assert got == plain_groups_of(pairs, 3, 85)
        compared.append((sum(e.count() for e in seen), len(seen)))
    (few, rounds), (many, more) = compared
    assert few <= most * 60 and many <= 2.6 * few and more <= rounds + 1, compared


def scattered(n, seed=6):
    """n texts of one form, every 33rd word or so another at places of their own: none is linked to another, and each shares bands with some."""
    rng = random.Random(seed)
    form = [f"f{rng.randrange(10**6)}" for _ in range(400)]
    return [(i + 1, " ".join(f"own{i}x{k}" if rng.random() < 0.03 + 0.01 * (i % 3) else w for k, w in enumerate(form))) for i in range(n)]


def test_texts_of_one_form_meet_first_members_alone(spark, monkeypatch):
    """Buckets of bands once made a centre each, and a leaf's elements were dealt out for each of its centres."""
    edges, seen = minhash._edges, []
    monkeypatch.setattr(minhash, "_edges", lambda *args: seen.append(edges(*args).cache()) or seen[-1])
    pairs = scattered(90)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.group_near_duplicates(df, 5, 80).collect()}
    assert got == plain_groups_of(pairs, 5, 80)
    assert sum(e.count() for e in seen[1:]) <= 90, [e.count() for e in seen]


def test_words_that_one_unkeyed_hash_confuses(spark):
    """Two words of 16 bytes that the candidates' hash gives one value: texts without a common shingle stay apart."""
    one, other = "rs18bf38il5pj3jo", "9u2xh2dzf+9k=u~x"
    rows = [(1, one), (2, other), (3, f"a b {one}"), (4, f"a b {other}"), (5, one)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def cut_texts(n, seed=8):
    """Of n near copies what a cut of repeated lines leaves: four fifths of a text's lines, other ones in each; some are linked."""
    rng = random.Random(seed)
    lines = [" ".join(f"l{k}x{rng.randrange(10**6)}" for _ in range(12)) for k in range(30)]
    return [(i + 1, "\n".join(f"own{i} {line}" if rng.random() < 0.05 else line for line in lines if rng.random() < 0.9)) for i in range(n)]


@pytest.mark.parametrize("blocks,rounds", [({}, 1), ({"BLOCK_DOCS": 9}, 1), ({"BLOCK_ELEMENTS": 3000}, 1), ({"GROUP_BLOCKS": 0}, None)])
def test_what_a_cut_leaves_takes_one_round(spark, monkeypatch, blocks, rounds):
    """Groups whose texts are alike without being linked once took a round of stars for each few of them."""
    edges, seen = minhash._edges, []
    monkeypatch.setattr(minhash, "_edges", lambda *args: seen.append(1) or edges(*args))
    for name, value in blocks.items():
        monkeypatch.setattr(minhash, name, value)
    pairs = cut_texts(70)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.group_near_duplicates(df, 5, 80).collect()}
    assert got == plain_groups_of(pairs, 5, 80)
    assert 1 < len({c for _, c in got.values()}) < len(got)
    assert rounds is None or len(seen) == rounds


@pytest.mark.parametrize("common,columns,left", [(16, 2048, 0), (3, 5, 0), (3, 5, 17), (100, 7, 25)])
def test_linked_sets_are_those_of_all_pairs(monkeypatch, common, columns, left):
    rng = np.random.default_rng(common)
    monkeypatch.setattr(minhash, "COMMON", common)
    monkeypatch.setattr(minhash, "COLUMNS", columns)
    sets = [np.unique(rng.choice(30, rng.integers(1, 30), replace=False) if k % 3 else np.append(np.arange(20), 100 + k)) for k in range(60)]
    want = [(i, j) for i in range(60) for j in range(60) if i < j and (not left or i < left <= j) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    got = sorted(zip(*(x.tolist() for x in minhash.linked_sets(sets, left, 80))))
    assert want and got == want
