import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import arrays, kneser_ney, langid

KEY = b"a key of a run"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def plain_model(train):
    uni, bi, ctx, starts = Counter(), Counter(), Counter(), 0
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["<s>", *w], w))
        ctx.update(["<s>", *w[:-1]])
        starts += 1
    d = lambda c: kneser_ney.discounts(*(sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)))
    cont = Counter(b for _, b in bi)
    d2, d1, types, v = d(bi), d(cont), len(bi), len(uni)
    kinds = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in bi.items():
        kinds[a][min(n, 3)] += 1
    g1 = sum(d1[min(n, 3)] for n in cont.values()) / types
    one = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / types + g1 / (v + 1)

    def two(a, w):
        if not ctx[a]:
            return one(w)
        n = bi[a, w]
        return max(n - d2[min(n, 3)], 0) / ctx[a] + sum(d2[k] * kinds[a][k] for k in (1, 2, 3)) / ctx[a] * one(w)

    return uni, two


def test_scores_against_a_plain_model(docs, pairs):
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(docs).collect()}
    train = [t for i, t in pairs if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, two = plain_model(train)
    total, v = sum(uni.values()), len(uni)
    assert len(got) == len(pairs)
    for i, t in pairs:
        r, w = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), total)
        assert r["n_known"] == sum(uni[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + 1) / (total + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(two(a, b)) for a, b in zip(["<s>", *w], w)), abs=1e-3)


def test_probabilities_of_a_context_sum_to_one(docs, pairs):
    train = [t for i, t in pairs if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, two = plain_model(train)
    for a in list(uni)[:5] + ["<s>"]:
        if a is not None:
            assert sum(two(a, w) for w in uni) + two(a, "never seen") == pytest.approx(1)


def test_model_edges(spark, empty):
    assert kneser_ney.score_documents(empty).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = kneser_ney.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)
    odd = kneser_ney.score_documents(spark.createDataFrame([(None, "a"), (1, None), (3, "a " * 3000), (3, "a")], "doc_id long, text string")).collect()
    assert sorted(r["n_tokens"] for r in odd) == [1, 2, 2, 3001] and not any(r["held_out"] for r in odd if r["doc_id"] is None)


def test_words_of_one_hash_by_construction_and_texts_in_blocks(spark, pairs, monkeypatch):
    one = b"a"
    while len(one) < 1024:
        one += one.translate(bytes.maketrans(b"ab", b"ba"))
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    df = spark.createDataFrame([(1, one.decode()), (3, other.decode()), (4, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(df).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r["n_known"] == (2 if i not in held else 1) for i, r in got.items())
    arr = pa.array([t for _, t in pairs] + ["b a " * 400])
    whole = [kneser_ney._words(part, more, KEY) for _, part, more in kneser_ney.blocks(arr)]
    parts = [kneser_ney._words(part, more, KEY) for _, part, more in kneser_ney.blocks(arr, 200)]
    assert len(parts) > len(whole) == 1 and (np.concatenate([h for h, _ in parts]) == whole[0][0]).all()


def test_words_that_one_unkeyed_hash_confuses(spark):
    """Two words of 16 bytes that the candidates' hash gives one value: not one word to the model."""
    one, other = "rs18bf38il5pj3jo", "9u2xh2dzf+9k=u~x"
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    df = spark.createDataFrame([(learned, one), (held, other)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(df).collect()}
    assert got[learned]["n_known"] == 2 and got[held]["n_known"] == 1


def test_a_store_keeps_few_files_open(tmp_path, monkeypatch):
    """Five thousand buckets under 256 descriptors, mounted and copied."""
    import os
    import resource

    store = arrays.Store(str(tmp_path / "s"))
    n = 5000
    for i in range(n):
        store.put(f"b{i}", np.arange(i, i + 40))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (used + 256, hard))
    try:
        assert all(int(store.get(f"b{i % n}")[3]) == i % n + 3 for i in [*range(n), *range(0, n, 7)])
        store._maps.clear()
        far = arrays.Store("file://" + str(tmp_path / "s"))
        monkeypatch.setattr(far, "_local", lambda: None)
        assert all(int(far.get(f"b{i}")[0]) == i for i in range(0, n, 9)) and len(os.listdir(far._own.name)) <= arrays.OPEN
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_packed_rows_and_counter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 50, 5000).astype(np.uint64) << np.uint64(40)
    c = arrays.Counter(merge_at=100)
    for part in np.array_split(keys, 20):
        c.add(part)
    got, counts = c.take()
    assert dict(zip(got.tolist(), counts.tolist())) == Counter(keys.tolist()) and c.take()[0].size == 0
    assert (arrays.unsqueeze(arrays.squeeze(got, True), len(got), True) == got).all()


def test_store(tmp_path):
    for uri in (f"file://{tmp_path}/a", f"{tmp_path}/b"):
        s = arrays.Store(uri)
        s.put("x", np.arange(100))
        s.put("none", np.zeros(0, np.uint64))
        assert s.get("x").sum() == 4950 and len(s.get("none")) == 0


LANGS = {"en": ["th", "er", "ing", "on", "ow", "the"], "fr": ["é", "eau", "oi", "que", "ai", "ç"], "de": ["sch", "ü", "ei", "ung", "tz", "ß"]}


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        text = " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 60)))
        out.append((i, text, lang))
    return out


def test_held_out_accuracy_and_whole_texts(spark):
    rows = corpus(4, 240) + [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "", None), (1003, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("score2", df["lang"]), model).withColumn("h", langid.held_out()).collect()}
    held = [(i, lang) for i, _, lang in rows[:240] if got[i]["h"]]
    assert all(got[i]["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert len(held) > 30 and sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels_everything_is_unknown(spark, empty):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.fit(df)).first()["lang_pred"] == "und"
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_clashing_names_and_repeated_ids(spark):
    rows = [(0, f"{t} {i}", lang, 1, 2, 3) for i, (_, t, lang) in enumerate(corpus(6, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found int, _FOUND_ int, h int")
    model = langid.fit(df, sample_docs=3)
    got = langid.identify(df, model)
    assert model.languages == ["de", "en", "fr"] and got.columns == [*df.columns, "lang_pred", "score"]
    assert {(r["_found"], r["_FOUND_"], r["h"]) for r in got.collect()} == {(1, 2, 3)}


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "a b c", "xyzzy"[i % 5]) for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(df).languages == ["y", "z"]


def test_gradients_against_differences():
    model = langid.Model.fresh(["a", "b"], hidden=3)
    windows, goal = [b"ab a", b"c", b"bca"], np.array([0, 1, 0])
    _, grads = langid.gradients(model, windows, goal)
    rng = np.random.default_rng(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    for k, w in model.weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w.shape) if k[0] != "x" else (int(rng.integers(0, 9)), ord("a"))
            step, old = 1e-3, w[at]
            w[at] = old + step
            up, _ = langid.gradients(model, windows, goal)
            w[at] = old - step
            down, _ = langid.gradients(model, windows, goal)
            w[at] = old
            assert grads[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def plain_labels(w, window):
    """One window, a byte at a time."""
    logistic = lambda v: 1 / (1 + np.exp(-v))
    out = np.zeros((len(window), len(w["bias"])))
    for d, places in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
        n = w[f"c{d}"].shape[0]
        h = np.zeros(n)
        for t in places:
            a, u = w[f"x{d}"][:, window[t]], w[f"h{d}"] @ h
            z, r = logistic(a[:n] + u[:n]), logistic(a[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * (u[2 * n :] + w[f"c{d}"][:, 0]))
            h = new + z * (h - new)
            out[t] += w[f"o{d}"] @ h
    e = np.exp(out + w["bias"][:, 0])
    return e / e.sum(axis=1, keepdims=True)


def test_predictions_against_a_byte_at_a_time(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 40)
    monkeypatch.setattr(langid, "COLUMNS", 7)
    model = langid.Model.fresh(["p", "q", "r"], hidden=4)
    texts = [t for _, t, _ in corpus(9, 12)] + ["é", "a", "", None, "12 a 3", "12"]
    langs, scores = langid.Reader(model).predict(pa.array(texts))
    for t, lang, score in zip(texts, langs, scores):
        data = np.frombuffer((t or "").encode(), np.uint8)
        sums, n = np.zeros(3), 0
        for at in range(0, len(data), 40):
            p, on = plain_labels(model.weights, data[at : at + 40]), langid._MAYBE[data[at : at + 40]]
            sums, n = sums + p[on].sum(axis=0), n + on.sum()
        assert lang == ("und" if not n else "pqr"[sums.argmax()]) and score == pytest.approx(sums.max() / n if n else 0, abs=1e-5)


def test_state_goes_on_across_words():
    model = langid.Model.fresh(["p", "q"], hidden=4)
    x = np.frombuffer(b"abc def ghi" + b"xyz def ghi", np.uint8).reshape(2, 11).T
    p = langid._labels(model.weights, np.ascontiguousarray(x), np.array([11, 11]))
    assert np.abs(p[4:, :, 0] - p[4:, :, 1]).min() > 0  # the same bytes after another word
