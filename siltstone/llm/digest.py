"""Quartile bucket digests of documents and their bounded difference.

Each window of four bytes adds three byte triplets; a triplet is hashed to one of 256 buckets. A
bucket's code is the quartile (0-3) in which its count lies among the document's 256 counts. The
fingerprint is hexadecimal: checksum, logarithm of the length, two ratios of quartiles (a byte
each), then 64 bytes of codes. The difference of two fingerprints adds code distances (6 for
opposite quartiles), length and ratio distances, and stops at ``CAP``, what unrelated digests
reach; likeness is 1 - difference / CAP.

Cases: a null text is an empty one; texts under three bytes have no triplet and digest to codes 0
and their length; equal texts have equal fingerprints; equal doc_ids stand in the order of their
texts, a null doc_id comes first; the next of the only document is itself; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import raw, slices
from siltstone.llm.worker import tidy
from siltstone.session import ship, small_batches

BUCKETS = 256
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_RNG = np.random.default_rng(77)
_PEARSON = _RNG.permutation(256).astype(np.uint8)
_SALTS = _RNG.choice(256, len(_TRIPLETS), replace=False).astype(np.uint8)
#: Code distance; opposite quartiles count double.
_STEP = np.array([0, 1, 2, 6], np.int64)
#: Mean distance of independent uniform codes is 1.625 a bucket.
CAP = int(1.625 * BUCKETS)


def _counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    size = np.diff(bounds)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
    left = np.repeat(bounds[1:], size) - np.arange(len(data))
    total = np.zeros(n * BUCKETS, np.int64)
    for (a, b, c), salt in zip(_TRIPLETS, _SALTS):
        m = len(data) - c
        if m <= 0:
            continue
        h = _PEARSON[data[a : a + m] ^ salt]
        h = _PEARSON[h ^ data[b : b + m]]
        h = _PEARSON[h ^ data[c : c + m]]
        at = (row[:m] + h)[left[:m] > c]
        total += np.bincount(at, minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def digests(arr: pa.Array) -> np.ndarray:
    """A row of 4 + BUCKETS bytes each: checksum, length, two ratios, then one code a bucket."""
    out = np.zeros((len(arr), 4 + BUCKETS), np.uint8)
    for at, part in slices(arr):
        data, bounds = raw(part)
        counts = _counts(data, bounds)
        ranked = np.sort(counts, axis=1)
        q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        rows = out[at : at + len(part)]
        rows[:, 4:] = (counts > q[:, :1]).astype(np.uint8) + (counts > q[:, 1:2]) + (counts > q[:, 2:])
        size = np.diff(bounds)
        rows[:, 0] = _checks(data, bounds)
        rows[:, 1] = np.minimum(255, np.floor(8 * np.log2(size + 1))).astype(np.uint8)
        top = np.maximum(q[:, 2], 1)
        rows[:, 2] = (q[:, 0] * 100 // top).astype(np.uint8)
        rows[:, 3] = (q[:, 1] * 100 // top).astype(np.uint8)
    return out


def _checks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    within = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    sums = np.append(0, np.cumsum(_PEARSON[data].astype(np.int64) * (1 + within % 251)))
    return ((sums[bounds[1:]] - sums[bounds[:-1]]) % 256).astype(np.uint8)


def to_text(rows: np.ndarray) -> list[str]:
    codes = rows[:, 4:].reshape(len(rows), -1, 4)
    packed = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    return [r.tobytes().hex() for r in np.concatenate([rows[:, :4], packed], axis=1)]


def from_text(texts: list[str]) -> np.ndarray:
    rows = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1)
    packed = rows[:, 4:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return np.concatenate([rows[:, :4], packed.reshape(len(texts), -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - difference / CAP of two rows of digests, pairwise; 1 only for equal fingerprints."""
    far = np.abs(a.astype(np.int16) - b.astype(np.int16))
    total = _STEP[far[:, 4:]].sum(axis=1) + np.minimum(far[:, 1], 32) // 2 + np.minimum(far[:, 2], 60) // 10 + np.minimum(far[:, 3], 60) // 10
    total = total + (far[:, 0] > 0)
    return 1 - np.minimum(total, CAP) / CAP


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """The input with a column of fingerprints; one pass, nothing is shuffled."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(to_text(digests(pa.array(texts, pa.string()))), index=texts.index, dtype=object)

    return docs.withColumn(out_col, of(F.col(text_col).cast("string")))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, text, ahead) in order; an ahead row only ends its bucket."""
    held: tuple | None = None
    for batch in batches:
        buckets, ids, ahead = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        texts = [t or "" for t in batch.column(2).to_pylist()]
        rows = digests(pa.array(texts, pa.string()))
        if held:
            buckets, ids, ahead, texts = [held[0], *buckets], [held[1], *ids], [held[2], *ahead], [held[3], *texts]
            rows = np.concatenate([held[4], rows])
        held = (buckets[-1], ids[-1], ahead[-1], texts[-1], rows[-1:])
        own = [i for i in range(len(ids) - 1) if not ahead[i] and buckets[i] == buckets[i + 1]]
        for at in range(0, len(own), 256):
            some = own[at : at + 256]
            changed = [edited(texts[i], texts[i + 1]) for i in some]
            new = digests(pa.array(changed, pa.string()))
            this, following = rows[some], rows[[i + 1 for i in some]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in some], pa.int64()),
                    pa.array([len(texts[i]) for i in some], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(to_text(this)),
                    pa.array(to_text(new)),
                    pa.array(likeness(this, new)),
                    pa.array(likeness(this, following)),
                ],
                schema=_ARROW,
            )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by doc_id.

    Documents go to ranges of doc_id (bounds from an approximate quantile, a few for each shuffle
    partition); the first document of a range is also sent to the range before it, the very first
    to the last, so every document meets its successor in one shuffle of the texts.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    cuts = rows.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)
    bounds = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.float64), "right").astype(np.int32), index=k.index)

    keyed = rows.withColumn("k", key).withColumn("bucket", bucket("k"))
    firsts = sorted(keyed.groupBy("bucket").agg(F.min("k").alias("k")).collect(), key=lambda r: r["bucket"])  # a row a range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    before = [(r["k"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "k long, to int"))
    sent = keyed.join(heads, "k", "left").select(
        "doc_id", "text", "k", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("bucket", F.lit(False).alias("ahead")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("ahead")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("ahead"))))).alias("s")
    )
    flat = sent.select(F.col("s.bucket").alias("bucket"), "doc_id", "text", F.col("s.ahead").alias("ahead"), "k")
    ordered = flat.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "k", "text")
    return ordered.select("bucket", "doc_id", "text", "ahead").mapInArrow(tidy(_compare), _SCHEMA)
