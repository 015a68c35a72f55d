import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import digest, isomedia, mixing
from siltstone.session import Scratch


def test_fingerprints_and_edits_against_plain_python(spark, docs, pairs):
    got = {r["doc_id"]: r for r in digest.compare_edited(docs).collect()}
    order = sorted(pairs)
    texts = [t or "" for _, t in order]
    codes = digest.digests(pa.array(texts))
    names = digest.to_text(codes)
    assert len(got) == len(order)
    for i, (doc_id, _) in enumerate(order):
        nxt = texts[(i + 1) % len(texts)]
        new = digest.edited(texts[i], nxt)
        h = len(texts[i]) // 2
        assert new == texts[i][: len(texts[i]) - h] + nxt[:h]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest(), names[i])
        own = digest.digests(pa.array([new]))
        assert r["edited_fingerprint"] == digest.to_text(own)[0]
        assert r["near_edited"] == pytest.approx(digest.likeness(codes[i : i + 1], own)[0])
        assert r["near_next"] == pytest.approx(digest.likeness(codes[i : i + 1], codes[[(i + 1) % len(texts)]])[0])


def test_digest_is_per_text_and_bounded():
    texts = ["", "ab", "abc", "some longer text " * 9, "ß" * 400]
    whole = digest.to_text(digest.digests(pa.array(texts)))
    assert whole == [digest.to_text(digest.digests(pa.array([t])))[0] for t in texts]
    rows = digest.from_text(whole)
    assert (rows == digest.digests(pa.array(texts))).all()
    assert (digest.likeness(rows, rows) == 1).all()
    for a in range(5):
        assert (0 <= digest.likeness(rows[[a] * 5], rows)).all()


def test_counts_by_hand():
    text = b"abcdx"
    expected = np.zeros(digest.BUCKETS, int)
    P, S = digest._PEARSON, digest._SALTS
    for i in range(len(text)):
        for (a, b, c), salt in zip(digest._TRIPLETS, S):
            if i + c < len(text):
                expected[P[P[P[text[i + a] ^ salt] ^ text[i + b]] ^ text[i + c]]] += 1
    assert (digest._counts(np.frombuffer(b"zz" + text, np.uint8), np.array([0, 2, 7]))[1] == expected).all()


def test_digest_edges(spark, empty):
    assert digest.compare_edited(empty).count() == 0
    one = digest.compare_edited(spark.createDataFrame([(7, "abcd", 1)], "doc_id long, text string, k long")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    ties = digest.compare_edited(spark.createDataFrame([(1, "b"), (1, "a"), (None, None)], "doc_id long, text string"))
    assert ties.count() == 3
    assert digest.fingerprint(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("fingerprint").distinct().count() == 1


def test_media_round_trip(spark, docs, pairs):
    where = Scratch(spark, "t").path("media")
    got = {r["doc_id"]: r for r in isomedia.read_back(isomedia.save(docs, where)).collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(where).collect()}
    assert {i: hashlib.sha256(m).hexdigest() for i, m in files.items()} == {i: r["media_sha256"] for i, r in got.items()}
    for i, r in got.items():
        payload = b"".join(files[i][k["offset"] : k["offset"] + 64] for k in r["keyframes"])
        raw = (dict(pairs)[i] or "").encode()
        assert payload == b"".join((raw + bytes(-len(raw) % 64 if raw else 64))[at : at + 64] for at in range(0, r["payload_bytes"], 1024))
        assert r["codec"] == "raw " and r["duration"] == r["payload_bytes"] // 64
    for doc_id, t in pairs:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload)
    assert isomedia.read_back(isomedia.store(docs.where("false"))).count() == 0


@pytest.mark.parametrize("frames", [1, 15, 16, 17, 33])
def test_sample_tables(frames):
    payload = bytes(range(256)) * (frames // 4 + 1)
    payload = payload[: frames * 64]
    data = isomedia.mux(payload)
    (track,) = isomedia.parse(data)
    assert track.codec == "raw " and track.duration == frames and track.timescale == isomedia.TIMESCALE
    assert track.keyframes.tolist() == list(range(0, frames, 16))
    assert isomedia.sample_bytes(data, track) == payload
    assert all(data[o : o + 64] == payload[64 * k : 64 * k + 64] for k, o in zip(track.keyframes, track.offsets[track.keyframes]))


def test_wide_boxes_varied_sizes_and_missing_sync_table():
    sizes = [3, 5, 2, 7]
    media = b"".join(bytes([65 + i]) * n for i, n in enumerate(sizes))
    full, box = isomedia._full, isomedia._box
    at = 8
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stts", struct.pack(">IIIII", 2, 1, 10, 3, 20)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 3, 1)),
        full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), full(b"co64", struct.pack(">IQQ", 2, at + 16 - 8, at + 16 - 8 + 3)),
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"hdlr", struct.pack(">I4s12x", 0, b"soun")), box(b"minf", stbl))))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(media)) + media
    (track,) = isomedia.parse(mdat + moov)
    assert track.sizes.tolist() == sizes and track.offsets.tolist() == [16, 19, 24, 26] and track.durations.tolist() == [10, 20, 20, 20]
    assert track.keyframes.tolist() == [0, 1, 2, 3] and isomedia.sample_bytes(mdat + moov, track) == media


def test_damaged_media_give_a_reason(spark):
    good = isomedia.mux(bytes(64))
    rows = [(1, good), (2, None), (3, good[:100]), (4, b"junk"), (5, b""), (6, good[:-1])]
    got = {r["id"]: r for r in isomedia.probe(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["tracks"][0]["samples"] == 1 and got[1]["tracks"][0]["keyframes"][0]["length"] == 64
    assert got[2]["error"] == "no media" and all(got[i]["error"] for i in (3, 4, 6)) and got[5]["tracks"] == []


def test_targets_share_all_and_stop_at_three_times():
    goal = mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 900)])
    assert list(goal) == ["a", "b", "c", None] and sum(goal.values()) == pytest.approx(2010)
    assert goal[None] == 30 and goal["b"] == 300 and goal["a"] / goal["c"] == pytest.approx(5)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def plain_sainte_lague(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(m for w, m in zip(weights, most) if w > 0))):
        i = max((i for i in range(len(weights)) if weights[i] > 0 and got[i] < most[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_apportionment_against_one_seat_at_a_time():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        weights = [rng.choice([0, 1, 2, 5, 17.5, 300]) for _ in range(n)]
        most = [rng.randrange(0, 40) for _ in range(n)]
        seats = rng.randrange(0, 120)
        assert mixing.sainte_lague(weights, seats, most) == plain_sainte_lague(weights, seats, most)


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix_meets_targets_and_reruns_agree(spark, docs, pairs):
    got = mixing.mix(docs).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {i: size_of(t) for i, t in pairs}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r["source"], []).append(r)
    for rows in per.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 2 * mixing.BLOCK_WORDS
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_drawn_texts_hold_the_words_taken(spark, docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    drawn = mixing.draw(docs.withColumn("rest", docs["lang"]))
    assert drawn.columns == [*docs.columns, "rest"]
    rows = drawn.collect()
    assert {r["doc_id"]: size_of(r["text"]) for r in rows} == {d: n for d, n in taken.items() if n}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_large_sources_are_summed_in_parts(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 50)
    monkeypatch.setattr(mixing, "MAX_SHARDS", 2)
    got = mixing.mix(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r["source"], []).append(r)
    for rows in per.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 3 * mixing.BLOCK_WORDS
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()} == {r["doc_id"]: r["taken"] for r in got}
    drawn = {r["doc_id"]: size_of(r["text"]) for r in mixing.draw(docs).collect()}
    assert drawn == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_multipliers_permute():
    import math

    rng = np.random.default_rng(3)
    assert all(math.gcd(mixing._multiplier(rng, n), n) == 1 for n in [1, 2, 3, 12, 30030, 10**9])
    with pytest.raises(ValueError):
        mixing._multiplier(rng, mixing.MAX_BLOCKS)


def test_probe_leaves_other_columns(spark):
    df = spark.createDataFrame([(isomedia.mux(bytes(64)), 5, 6)], "media binary, _found int, _FOUND_ int")
    got = isomedia.probe(df).first()
    assert (got["_found"], got["_FOUND_"], got["error"]) == (5, 6, None) and got["tracks"][0]["samples"] == 1


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", None)], "doc_id long, text string, source string")
    assert mixing.mix(odd).count() == 5
