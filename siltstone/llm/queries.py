"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import conversations, digest, embeddings, filter_audit, isomedia, kneser_ney, langid, line_windows, minhash, mixing, packing, rans, substrings
from siltstone.session import Scratch, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "op1").path("corpus")
    rans.write_shards(spark, read_table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return rans.read_shards(spark, out)


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edited(read_table(spark, sf_dir, "documents"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_windows.dedup_line_windows(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"))


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.read_back(isomedia.save(read_table(spark, sf_dir, "documents"), Scratch(spark, "op4").path("media")))


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(read_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group_near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(rows, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length("kept").cast("long")
    removed = F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)"), F.lit(0))
    return cut.select("doc_id", (size + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(read_table(spark, sf_dir, "conversations"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rans_tokens, op2_quartile_digest, op3_line_windows, op4_iso_media, op5_sainte_lague, op6_kneser_ney, op7_minhash, op8_hierarchical_packing, op9_byte_gru, op10_suffix_ranges,
        op11_spherical_caps, op12_turn_repair, op13_filter_interactions,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_windows": line_windows.SQL, "op7_minhash": minhash.SQL, "op10_suffix_ranges": substrings.SQL, "op11_spherical_caps": embeddings.SQL, "op13_filter_interactions": filter_audit.SQL,
}
