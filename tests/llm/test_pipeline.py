import zlib

import numpy as np
import pytest
from test_dedup import plain_windows
from test_near_dedup import plain_groups_of

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from siltstone.llm import langid, mixing, queries, tokens  # noqa: E402


def test_stages_against_plain_versions(spark, docs, tmp_path):
    """Each stage on what the one before kept, against a brute-force version of the same."""
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in scores.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE}
    cut = steps["line_dedup"](spark, kept, "").cache()
    expected = plain_windows([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t for i, (t, n, gone) in expected.items() if not (gone and gone == n)}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    near = steps["near_dedup"](spark, cut, "").cache()
    groups = plain_groups_of([(r["doc_id"], r["text"]) for r in cut.collect()], corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_PERCENT)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in groups.items() if c == i}
    mixed = steps["mix_sources"](spark, near, "").cache()
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(near).collect() if r["taken"]}
    assert {r["doc_id"]: len(r["text"].split()) for r in mixed.collect()}.keys() == taken.keys()
    rows = steps["pack_sequences"](spark, mixed, "").collect()
    plain = tokens.encoder(queries.tokenizer_path("word_bpe_49k.json")).plain
    for r in mixed.collect():
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [1]
        pieces = sorted((p for p in rows if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in pieces)


def test_run_rereads_every_stage(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_nulls_repeated_rows_and_clashing_names(spark, docs, empty, tmp_path):
    """Null ids, texts, languages and sources, empty texts, repeated rows and columns that stages use inside; then no row at all."""
    from pyspark.sql import functions as F

    some = docs.limit(12)
    odd = spark.createDataFrame([(None, "one two three words of a text", None, None, 29), (None, None, None, None, None), (900, "", "en", "a", 0), (901, None, "en", None, None)], docs.schema)
    clashing = ["h", "size", "kept", "score", "shard", "_lang", "_kept", "_score", "_every", "band", "key"]
    table = some.unionByName(some).unionByName(odd).select("*", *[F.lit(7).alias(c) for c in clashing])
    names = table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
        rows = table.collect()
        table = spark.createDataFrame(rows, table.schema)
        if name != "pack_sequences":
            assert table.columns == names and all(r[c] == 7 for r in rows for c in clashing)
    assert {r["doc_id"] for r in rows} & {r["doc_id"] for r in some.collect()}
    none = empty
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
