"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped by workers.

Words are lower-cased (A-Z) runs of bytes that are no ASCII white space; a document is its words
and an end, which is a word of the vocabulary. The vocabulary is a sorted array of 64-bit word
hashes (BLAKE2b under a key drawn for each run: no text can be made to collide); a word's number is its place there. A bigram is one 64-bit key (number of the context,
number of the word). Three passes build the model, each a count within tasks, a shuffle of packed
counts by bucket and a merge that writes one file a bucket into the shared folder:

1. words: hash buckets are ranges of the hash, so the buckets in a row are the sorted vocabulary;
2. bigrams: bucketed by ranges of context numbers, but those of a context with more than
   1 / (4 * buckets) of all words (at most 4 * buckets contexts) by the whole key's hash;
3. back-off weights of contexts, and continuation counts of words (distinct contexts), from the files of 2.

Only sums a bucket reach the driver: sizes, counts of counts, back-off weights of hot contexts.
Scoring maps the files and looks up whole slices of text at once; memory is that of a slice, the
rest is page cache. Probability: max(c - D(c), 0) / c(context) + backoff(context) * p(word), where
p is the same from continuation counts over 1 / (V + 1); an unseen context gives p(word).

Cases: a null text is empty (only the end); a null doc_id is scored, never learned from and not
held out; without rows to learn from every score is 0; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrays import BUCKET_DDL, Counter, Store, bucket_rows, buckets_for, merged_rows, opened
from siltstone.llm.words import blocks, lowered, mix, new_key, raw, word_hashes, word_ranges
from siltstone.llm.worker import tidy, tidy_group
from siltstone.session import Scratch, ship, small_batches

END = np.uint64(0x5EED0E0D)
#: The number that stands for a text's start as a context.
START = (1 << 32) - 1
_32 = np.uint64(32)


def _ranges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash; ascending with the hash."""
    return ((h >> _32) * np.uint64(buckets) >> _32).astype(np.int64)


def _words(arr: pa.Array, more: bool, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with its end, in a row, and the n+1 bounds; if ``more``, the last text has no end yet."""
    data, bounds = raw(arr)
    data = lowered(data)
    starts, ends, of = word_ranges(data, bounds)
    last = len(of) - more
    hashes = np.insert(word_hashes(data, starts, ends, key), of[1:last], END)
    of = of + np.arange(len(of))
    of[last:] -= 1
    return hashes, of


@dataclass
class Vocabulary:
    store: Store
    buckets: int
    offsets: list[int]  # first number of each bucket, and the number of words
    tokens: int
    texts: int
    key: bytes  # of the words' hashes

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of ascending hashes."""
        store = opened(self.store)
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(_ranges(hashes, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if self.offsets[b + 1] == self.offsets[b]:
                continue
            keys, part = store.get(f"words-{b}"), hashes[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            number[cuts[b] : cuts[b + 1]] = np.where(hit, at + self.offsets[b], -1)
            count[cuts[b] : cuts[b + 1]] = np.where(hit, store.get(f"word-counts-{b}")[at], 0)
        return number, count

    def at(self, name: str, numbers: np.ndarray, dtype) -> np.ndarray:
        """Values of ascending word numbers from files that lie beside the vocabulary's."""
        store, out = opened(self.store), np.zeros(len(numbers), dtype)
        cuts = np.searchsorted(numbers, self.offsets)
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            out[cuts[b] : cuts[b + 1]] = store.get(f"{name}-{b}")[numbers[cuts[b] : cuts[b + 1]] - self.offsets[b]]
        return out

    def bucket_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, numbers, "right") - 1


def _count_words(buckets: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, part, more in blocks(batch.column(0)):
                counter.add(_words(part, more, key)[0])
                if counter.full():
                    keys, counts = counter.take()
                    yield bucket_rows(keys, counts, _ranges(keys, buckets))
        keys, counts = counter.take()
        yield bucket_rows(keys, counts, _ranges(keys, buckets))

    return run


def _write_words(store: Store):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = merged_rows(table)
        b = table.column("bucket")[0].as_py()
        store.put(f"words-{b}", keys)
        store.put(f"word-counts-{b}", counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)
        ends = int(counts[keys == END].sum())
        return pa.table({"bucket": pa.array([b], pa.int32()), "size": [len(keys)], "total": [int(counts.sum())], "ends": [ends]})

    return run


def fit_vocabulary(train: DataFrame, store: Store, buckets: int) -> Vocabulary:
    key = new_key()
    rows = train.select("text").mapInArrow(tidy(_count_words(buckets, key)), BUCKET_DDL)
    found = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(tidy_group(_write_words(store)), "bucket int, size long, total long, ends long").collect()  # a row a bucket
    sizes = {r["bucket"]: r["size"] for r in found}
    offsets = [0, *np.cumsum([sizes.get(b, 0) for b in range(buckets)]).tolist()]
    if offsets[-1] >= START:
        raise ValueError("the vocabulary passes 2**32 words")
    return Vocabulary(store, buckets, offsets, sum(r["total"] for r in found), sum(r["ends"] for r in found), key)


def _numbered(vocabulary: Vocabulary, arr: pa.Array, more: bool = False, before: tuple[int, int] | None = None):
    """For each token of a slice: its number, count, and its context's number (START at a text's first, -1: unknown) and count.

    ``before``: number and count of the word before the slice, where its first text goes on from the last slice.
    """
    hashes, bounds = _words(arr, more, vocabulary.key)
    unique, where = np.unique(hashes, return_inverse=True)
    number, count = vocabulary.look_up(unique)
    number, count = number[where], count[where]
    context, total = np.empty_like(number), np.empty_like(count)
    context[1:], total[1:] = number[:-1], count[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(number)]
    context[firsts], total[firsts] = START, vocabulary.texts
    if before and len(context):
        context[0], total[0] = before
    return number, count, context, total, bounds


@dataclass
class Bigrams:
    vocabulary: Vocabulary
    buckets: int

    @property
    def hot(self) -> int:
        """Occurrences above which a context's bigrams are spread over all buckets."""
        return self.vocabulary.tokens // (4 * self.buckets) + 1

    def bucket_of(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        context = (keys >> _32).astype(np.int64)
        ranged = context * self.buckets // max(1, self.vocabulary.size)
        spread = (mix(keys) >> _32).astype(np.int64) % self.buckets
        return np.where((context_counts > self.hot) | (context == START), spread, np.minimum(ranged, self.buckets - 1))


def _count_bigrams(bigrams: Bigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def rows() -> pa.RecordBatch:
            keys, counts = counter.take()
            context = (keys >> _32).astype(np.int64)
            inner = context != START
            totals = np.zeros(len(keys), np.int64)
            totals[inner] = bigrams.vocabulary.at("word-counts", context[inner], np.int64)
            return bucket_rows(keys, counts, bigrams.bucket_of(keys, totals))

        before = None
        for batch in batches:
            for _, part, more in blocks(batch.column(0)):
                number, count, context, _, _ = _numbered(bigrams.vocabulary, part, more, before)
                before = (int(number[-1]), int(count[-1])) if more else None
                counter.add(context.astype(np.uint64) << _32 | number.astype(np.uint64))
                if counter.full():
                    yield rows()
        yield rows()

    return run


_SMALL = 255


def _write_bigrams(store: Store):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = merged_rows(table)
        b = table.column("bucket")[0].as_py()
        large = np.flatnonzero(counts >= _SMALL)
        store.put(f"pairs-{b}", keys)
        store.put(f"pair-counts-{b}", np.minimum(counts, _SMALL).astype(np.uint8))
        store.put(f"pair-large-{b}", np.stack([large, counts[large]]).astype(np.int64))
        kinds = np.bincount(np.minimum(counts, 5), minlength=6)
        return pa.table({"bucket": pa.array([b], pa.int32()), **{f"n{i}": [int(kinds[i])] for i in range(1, 5)}})

    return run


def pair_counts(store: Store, b: int, at: np.ndarray) -> np.ndarray:
    """Counts of a bucket's bigrams by place."""
    counts = store.get(f"pair-counts-{b}")[at].astype(np.int64)
    large = store.get(f"pair-large-{b}")
    full = np.flatnonzero(counts == _SMALL)
    if len(full):
        counts[full] = large[1][np.searchsorted(large[0], at[full])]
    return counts


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0) to D(3+) of modified Kneser-Ney from counts of counts; plain ones where a count is missing."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.01 * k), 0.99 * k) for k, x in enumerate(d, 1))])


def _back_off(bigrams: Bigrams, d: np.ndarray):
    """Each bucket's contexts: the mass of their discounts, and how many contexts each word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bigrams.vocabulary
        store = opened(vocabulary.store)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                keys = np.asarray(store.get(f"pairs-{b}"))
                kinds = np.minimum(store.get(f"pair-counts-{b}"), 3)
                words, contexts = Counter(full_at=1 << 62), (keys >> _32).astype(np.int64)
                words.add(keys & np.uint64(0xFFFFFFFF))
                first = np.append(0, np.flatnonzero(contexts[1:] != contexts[:-1]) + 1)
                mass = np.add.reduceat(d[kinds], first)
                own = contexts[first]
                totals = np.full(len(own), vocabulary.texts, np.int64)
                inner = own != START
                totals[inner] = vocabulary.at("word-counts", own[inner], np.int64)
                hot = (totals > bigrams.hot) | (own == START)
                low, high = (-(-x * vocabulary.size // bigrams.buckets) for x in (b, b + 1))
                gamma = np.zeros(high - low, np.float32)
                gamma[own[~hot] - low] = mass[~hot] / totals[~hot]
                store.put(f"back-off-{b}", gamma)
                ids, counts = words.take()
                yield bucket_rows(ids, counts, vocabulary.bucket_of(ids.astype(np.int64)))
                # Hot contexts have a part of their mass in every bucket; parts are summed in millionths.
                micro = np.rint(mass[hot] * 1e6).astype(np.int64)
                target = np.where(own[hot] == START, 0, vocabulary.bucket_of(own[hot]))
                yield bucket_rows(own[hot].astype(np.uint64), micro, target, kind=1)

    return run


def _write_continuations(vocabulary: Vocabulary):
    def run(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        ids, counts = merged_rows(table)
        low = vocabulary.offsets[b]
        dense = np.zeros(vocabulary.offsets[b + 1] - low, np.uint32)
        dense[ids.astype(np.int64) - low] = counts
        vocabulary.store.put(f"continuations-{b}", dense)
        kinds = np.bincount(np.minimum(counts, 5), minlength=6)
        hot, micro = merged_rows(table, kind=1)
        rows = {f"n{i}": [int(kinds[i])] for i in range(1, 5)}
        return pa.table({"types": [int(counts.sum())], "words": [len(ids)], **rows, "hot": pa.array([hot.astype(np.int64).tolist()], pa.list_(pa.int64())), "micro": pa.array([micro.tolist()], pa.list_(pa.int64()))})

    return run


@dataclass
class Model:
    bigrams: Bigrams
    d2: np.ndarray
    d1: np.ndarray
    types: int  # distinct bigrams
    back_off1: float
    hot_numbers: np.ndarray
    hot_back_off: np.ndarray

    def unigram(self, number: np.ndarray) -> np.ndarray:
        """p(word) from continuation counts, of ascending numbers; -1 is an unknown word."""
        vocabulary = self.bigrams.vocabulary
        base = 1 / (vocabulary.size + 1)
        if not self.types:
            return np.full(len(number), base)
        known = number >= 0
        c = np.zeros(len(number))
        c[known] = vocabulary.at("continuations", number[known], np.int64)
        return np.maximum(c - self.d1[np.minimum(c, 3).astype(np.int64)], 0) / self.types + self.back_off1 * base

    def score(self, arr: pa.Array, more: bool = False, before: tuple[int, int] | None = None) -> tuple[dict[str, np.ndarray], tuple[int, int] | None]:
        """Per text of a slice: n_tokens, n_known, base_score and score; and the last word, if ``more``."""
        vocabulary, bigrams = self.bigrams.vocabulary, self.bigrams
        store = opened(vocabulary.store)
        number, count, context, total, bounds = _numbered(vocabulary, arr, more, before)
        unique, where = np.unique(number, return_inverse=True)
        p = self.unigram(unique)[where]
        seen = np.flatnonzero((context >= 0) & (total > 0)) if self.types else np.zeros(0, np.int64)
        if len(seen):
            # Contexts in ascending order, so that files are read forwards.
            order = seen[np.argsort(context[seen].astype(np.uint64) << _32 | (number[seen] & 0xFFFFFFFF).astype(np.uint64))]
            con, num, tot = context[order], number[order], total[order].astype(float)
            keys = con.astype(np.uint64) << _32 | (num & 0xFFFFFFFF).astype(np.uint64)
            bucket = bigrams.bucket_of(keys, total[order])
            hot = (total[order] > bigrams.hot) | (con == START)
            weight, c = np.zeros(len(order)), np.zeros(len(order), np.int64)
            if hot.any():
                weight[hot] = self.hot_back_off[np.searchsorted(self.hot_numbers, con[hot])]
            sort = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[sort], np.arange(bigrams.buckets + 1))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                mine = sort[cuts[b] : cuts[b + 1]]
                cold = mine[~hot[mine]]
                if len(cold):
                    weight[cold] = store.get(f"back-off-{b}")[con[cold] + (b * vocabulary.size // -bigrams.buckets)]
                mine = mine[num[mine] >= 0]
                pairs = store.get(f"pairs-{b}") if len(mine) else np.zeros(0, np.uint64)
                if len(pairs):
                    at = np.minimum(np.searchsorted(pairs, keys[mine]), len(pairs) - 1)
                    hit = pairs[at] == keys[mine]
                    c[mine[hit]] = pair_counts(store, b, at[hit])
            p[order] = np.maximum(c - self.d2[np.minimum(c, 3)], 0) / tot + weight * p[order]
        n = len(bounds) - 1
        text = np.repeat(np.arange(n), np.diff(bounds))
        base = np.log10((count + 1) / (vocabulary.tokens + vocabulary.size + 1))
        return {
            "n_tokens": np.diff(bounds),
            "n_known": np.bincount(text, count > 0, n).astype(np.int64),
            "base_score": np.bincount(text, base, n),
            "score": np.bincount(text, np.log10(p), n),
        }, ((int(number[-1]), int(count[-1])) if more else None)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2


def fit(train: DataFrame, uri: str, buckets: int | None = None) -> Model:
    """Count the model of the column ``text`` into files below ``uri``, in the shared folder."""
    spark = train.sparkSession
    ship(spark)
    small_batches(spark)
    buckets = buckets or buckets_for(train, "text")
    store = Store(uri)
    vocabulary = fit_vocabulary(train, store, buckets)
    bigrams = Bigrams(vocabulary, buckets)
    if not vocabulary.size:
        return Model(bigrams, discounts(0, 0, 0, 0), discounts(0, 0, 0, 0), 0, 1.0, np.zeros(0, np.int64), np.zeros(0))
    rows = train.select("text").mapInArrow(tidy(_count_bigrams(bigrams)), BUCKET_DDL)
    found = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(tidy_group(_write_bigrams(store)), "bucket int, n1 long, n2 long, n3 long, n4 long").collect()  # a row a bucket
    filled = {r["bucket"] for r in found}
    for b in set(range(buckets)) - filled:
        store.put(f"pairs-{b}", np.zeros(0, np.uint64))
    d2 = discounts(*(sum(r[f"n{i}"] for r in found) for i in range(1, 5)))
    each = spark.createDataFrame([(b,) for b in sorted(filled)], "bucket int").repartition(len(filled), "bucket")
    parts = each.mapInArrow(tidy(_back_off(bigrams, d2)), BUCKET_DDL)
    schema = "types long, words long, n1 long, n2 long, n3 long, n4 long, hot array<long>, micro array<long>"
    ends = parts.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(tidy_group(_write_continuations(vocabulary)), schema).collect()  # a row a bucket
    counts = [sum(r[f"n{i}"] for r in ends) for i in range(1, 5)]
    d1, types, words = discounts(*counts), sum(r["types"] for r in ends), sum(r["words"] for r in ends)
    back_off1 = (d1[1] * counts[0] + d1[2] * counts[1] + d1[3] * (words - counts[0] - counts[1])) / types
    mass = dict(pair for r in ends for pair in zip(r["hot"], r["micro"]))
    hot = np.array(sorted(mass), np.int64)
    inner = hot[hot != START]
    totals = np.concatenate([vocabulary.at("word-counts", inner, np.int64), np.full(len(hot) - len(inner), vocabulary.texts)])
    weights = np.array([mass[int(h)] for h in hot]) / 1e6 / np.maximum(totals, 1)
    return Model(bigrams, d2, d1, types, back_off1, hot, weights)


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun: dict[str, float] = {}
            before = None
            for at, part, more in blocks(batch.column(2)):
                got, before = model.score(part, more, before)
                for k, v in begun.items():
                    got[k][0] += v
                begun = {k: v[-1] for k, v in got.items()} if more else {}
                if more:
                    continue
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array([model.bigrams.vocabulary.tokens] * n, pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every text by the model of the texts whose crc32(doc_id) mod 7 is not 2."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = fit(rows.where("NOT held_out AND doc_id IS NOT NULL"), Scratch(spark, "kneser-ney").path("model"))
    return rows.mapInArrow(tidy(_score(model)), _SCHEMA)
