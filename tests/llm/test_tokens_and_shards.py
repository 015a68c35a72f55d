import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pt = pytest.importorskip("public_tokenizers")

from siltstone.llm import packing, rans, tokens, words  # noqa: E402
from siltstone.session import Scratch  # noqa: E402


def direct(name, texts, end):
    t = tokens.encoder(pt.path(name)).plain
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_ids_equal_the_tokenizers(pairs, name, end):
    texts = [t for _, t in pairs] + ["it's  two", "x\n\n y", " ", " a", "é" * 50, "a\x1cb", "don't\tWON'T", "日本語 テキスト", "trail \n", "<|startoftext|>a"]
    enc, got = tokens.encoder(pt.path(name)), []
    for at, ids, bounds in enc.encode(pa.array(texts, pa.string()), end):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == direct(name, texts, end)


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 10)
    enc = tokens.PieceEncoder(pt.path("word_bpe_49k.json"))
    for k in range(3):
        texts = [f"alpha{k} beta{j}" for j in range(30)]
        (_, ids, bounds), = enc.encode(pa.array(texts), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == direct("word_bpe_49k.json", texts, 1)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, rans.BLOCK, rans.BLOCK * 2 + 777])
def test_a_shard_round_trips(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.4, n).clip(max=5000).astype(np.uint32)
    symbols, counts = np.unique(np.append(ids, [1, 7]), return_counts=True)
    table = rans.Table.load(rans.Table.fit(symbols, counts).dump())
    assert table.freqs.sum() == 1 << table.scale and table.freqs.min() >= 1
    sizes = np.array([n // 2, n - n // 2])
    blob = rans.encode_shard(np.array([5, -3]), sizes, ids, table, 9)
    got = rans.decode_shard(blob, table, 9)
    assert got[0].tolist() == [5, -3] and got[1].tolist() == sizes.tolist() and (got[2] == ids).all()


def test_damage_is_noticed():
    table = rans.Table.fit(np.array([1, 2]), np.array([5, 5]))
    blob = bytearray(rans.encode_shard(np.array([1]), np.array([4]), np.array([1, 2, 1, 1]), table, 0))
    with pytest.raises(ValueError):
        rans.decode_shard(bytes(blob), table, 1)
    blob[20] ^= 1
    with pytest.raises(ValueError):
        rans.decode_shard(bytes(blob), table, 0)
    with pytest.raises(ValueError):
        rans.encode_shard(np.array([1]), np.array([1]), np.array([9]), table, 0)


def test_shards_give_every_documents_place_and_checksum(spark, docs, pairs):
    out = Scratch(spark, "t").path("s")
    rans.write_shards(spark, docs, out, pt.path("byte_bpe_50k.json"), 2, shard_ids=500)
    got = rans.read_shards(spark, out).orderBy("doc_id").collect()
    order = sorted(pairs)
    ids = direct("byte_bpe_50k.json", [t for _, t in order], 2)
    at = 0
    for r, (doc_id, _), own in zip(got, order, ids, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert spark.read.parquet(f"{out}/shards").count() > 3


def test_shards_of_an_empty_table_and_of_null_ids(spark, docs, empty):
    out = Scratch(spark, "t").path("s")
    rans.write_shards(spark, empty, out, pt.path("byte_bpe_50k.json"), 2)
    assert rans.read_shards(spark, out).count() == 0
    odd = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string")
    rans.write_shards(spark, odd, out + "2", pt.path("byte_bpe_50k.json"), 2)
    got = rans.read_shards(spark, out + "2").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1] and sum(r["n_tokens"] for r in got) == 7


def check_pieces(rows, expected):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for doc_id, pieces in by_doc.items():
        ids, at = expected[doc_id], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all


def test_packing_covers_every_id_once(spark, docs, pairs):
    rows = packing.pack(docs, pt.path("word_bpe_49k.json"), 1).collect()
    check_pieces(rows, dict(zip([i for i, _ in pairs], direct("word_bpe_49k.json", [t for _, t in pairs], 1))))


def test_packing_fills_long_windows_from_shorter_tiers():
    rng = random.Random(3)
    p = packing.Packer(0)
    expected = {}
    for i in range(400):
        ids = np.arange(rng.choice([3, 100, 300, 700, 1500, 5000])) + i
        expected[i] = ids.tolist()
        p.add(i, ids)
        if i % 50 == 49:
            p.flush()
    p.flush(last=True)
    rows = [dict(zip([f.name for f in packing._ARROW], r)) for r in p.rows]
    check_pieces(rows, expected)
    assert len({r["tier"] for r in rows}) > 1


def test_step_groups_are_equal_across_tasks(spark, docs):
    many = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(7)
    rows = packing.pack(many, pt.path("word_bpe_49k.json"), 1, step_ids=2048).collect()
    sizes, groups = {}, {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
        groups.setdefault(r["tier"], {}).setdefault(r["step_group"], set()).add(r["sequence_id"])
    assert all(sizes[r["sequence_id"]] == r["tier"] for r in rows)
    assert len({r["sequence_id"] >> 40 for r in rows}) > 3
    for tier, own in groups.items():
        assert sorted(own) == list(range(len(own)))
        assert all(len(s) == max(1, 2048 // tier) for g, s in own.items() if g < len(own) - 1)


def test_packing_edge_cases(spark, empty):
    assert packing.pack(empty, pt.path("word_bpe_49k.json"), 1).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (4, "x " * 5000, 2)], "doc_id long, text string, length long")
    got = packing.pack(odd, pt.path("word_bpe_49k.json"), 1).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {None: 1, 4: 5001}


def thue_morse(n):
    s = b"a"
    while len(s) < n:
        s += s.translate(bytes.maketrans(b"ab", b"ba"))
    return s, s.translate(bytes.maketrans(b"ab", b"ba"))


def test_hashes_of_ranges_agree():
    data = np.frombuffer(b"abcabcabc" + b"x" * 200 + b"abc" + b"x" * 200, np.uint8)
    h = words.range_hashes(data, np.array([0, 3, 6, 1, 0, 9, 212, 209]), np.array([3, 6, 9, 4, 2, 209, 412, 212]))
    assert h[0] == h[1] == h[2] == h[7] and h[5] == h[6] and len(set(h.tolist())) == 4
    assert words.same_ranges(data, np.array([0, 0, 9, 9]), data, np.array([3, 1, 212, 10]), np.array([3, 3, 200, 199])).tolist() == [True, False, True, True]


def test_keyed_hashes_of_words():
    text = b"  one two one " + b"x" * 300 + b" rs18bf38il5pj3jo 9u2xh2dzf+9k=u~x two"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.word_ranges(data, np.array([0, len(text)]))
    a, b = (words.word_hashes(data, starts, ends, k) for k in (b"k", b"l"))
    assert a[0] == a[2] and a[1] == a[6] and len(set(a.tolist())) == 5 and not set(a.tolist()) & set(b.tolist())
    assert len(words.word_hashes(data, starts[:0], ends[:0], b"k")) == 0 and words.new_key() != words.new_key()
    at = [starts[4], starts[5]]
    assert len(set(words.range_hashes(data, np.array(at), np.array(at) + 16).tolist())) == 1  # candidates only


@pytest.mark.parametrize("n", [64, 128, 1024, 8192])
def test_complements_do_not_collide(n):
    data = np.frombuffer(b"".join(thue_morse(n)), np.uint8)
    assert len(set(words.range_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


@pytest.mark.parametrize("name,end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_ids_of_complements_and_of_colliding_pieces(name, end, monkeypatch):
    texts = [" ".join(x.decode() for x in thue_morse(n)[::step]) for n in (64, 1024, 2048, 4096, 8192) for step in (1, -1)]
    for hashed in (words.range_hashes, lambda data, a, b: (b - a).astype(np.uint64) % np.uint64(5)):  # the second one collides all the time
        monkeypatch.setattr(tokens, "range_hashes", hashed)
        enc = tokens.PieceEncoder(pt.path(name))
        for _ in range(2):
            got = [ids[a:b].tolist() for _, ids, bounds in enc.encode(pa.array(texts + ["one two <|x", "two one éa"]), end) for a, b in zip(bounds[:-1], bounds[1:])]
            assert got == direct(name, texts + ["one two <|x", "two one éa"], end)


@pytest.mark.parametrize("name,end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_long_texts_are_encoded_in_blocks(pairs, name, end, monkeypatch):
    monkeypatch.setattr(tokens, "blocks", lambda arr, most: words.blocks(arr, 300))
    texts = [t for _, t in pairs] + ["word " * 500, "x" * 2000, " y  z\t\u3000w 1 2" * 90, "a  b" * 300]
    enc, got, at = tokens.PieceEncoder(pt.path(name)), [], []
    for i, ids, bounds in enc.encode(pa.array(texts, pa.string()), end):
        at.append(i)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == direct(name, texts, end) and at == sorted(set(at))
