"""Five stages from raw documents to packed sequences; every stage reads all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which ``run`` writes as Parquet and rereads as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, line_windows, minhash, mixing, packing
from siltstone.llm.queries import tokenizer_path
from siltstone.session import Scratch, fresh_name, read_table

#: A document whose likeliest language has less than this pooled probability is rejected.
MIN_SCORE = 0.35
#: Near duplicates here share this percentage of their shingles of so many words; op7's own contract is another.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null or letterless texts and mere noise."""
    lang, score = fresh_name(docs, "lang"), fresh_name(docs, "score")
    found = langid.identify(docs, langid.fit(docs), lang=lang, score=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; a document of which nothing is left goes."""
    every, gone = fresh_name(docs, "every"), fresh_name(docs, "gone_lines")
    cut = line_windows.dedup_line_windows(docs, n_lines=every, n_removed=gone).where((F.col(gone) == 0) | (F.col(gone) < F.col(every)))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    own = fresh_name(docs, "kept")
    kept = minhash.group_near_duplicates(docs, NEAR_WIDTH, NEAR_PERCENT).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the blocks that bring each source to its target; a document's text is what is taken of it."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The language model and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
