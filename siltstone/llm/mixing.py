"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources ordered by code point, null last, weigh 5, 2, 1, 5, ...; they share the corpus's
size in words, no target above ``MOST`` times its source (the excess is reshared by weight). The
words of a source are dealt by a seeded hash of doc_id and text to shards of about ``SHARD_WORDS``
words, ``MAX_SHARDS`` at most; a shard is cut into blocks of ``BLOCK_WORDS`` words (equal to within
one word, across documents). Blocks go to sources, then to a source's shards, by highest quotients
weight / (2 * seats + 1). A shard with quota q and n blocks takes each block q // n times and
q % n of them once more, those that a seeded affine permutation puts first, so that selection
needs no sort and no list of blocks. Within a shard documents are ordered by their hash; where a
source has more words than MAX_SHARDS shards of SHARD_WORDS hold, a shard is summed in parts, ranges
of the hash, so that no task orders more than about SHARD_WORDS words' documents at any size.

Per-source and per-shard totals reach the driver: at most MAX_SHARDS rows a source, and sources
are bounded by ``MAX_SOURCES`` (more raise ValueError: the targets are worked out there). The plan is
joined by Spark, which broadcasts it only under its own threshold.

Cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0
take nothing; equal doc_ids of a source are ordered by size; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.worker import tidy
from siltstone.session import Scratch, ship, small_batches

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS, SHARD_WORDS, MAX_SHARDS, MAX_SOURCES = 64, 1 << 20, 1024, 100_000
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"
#: A shard's blocks stay below this, so that products of two of them fit 64 bits.
MAX_BLOCKS = 1 << 31


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Water-filling in exact arithmetic: shares by weight, those above their limit held at it."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: most * n for s, n in order}
    left, open_, out = sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > limit[s] * total]
        if not over:
            out |= {s: Fraction(left * weight[s], total) for s in open_}
            break
        for s in over:
            out[s] = Fraction(limit[s])
        left -= sum(limit[s] for s in over)
        held = set(over)
        open_ = [s for s in open_ if s not in held]
    return {s: float(out[s]) for s, _ in order}


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients w / (2s + 1), none above ``most``; ties go to the first."""
    w, top = np.array(weights, float), np.array(most, np.int64)
    top = np.where(w > 0, top, 0)
    seats = min(seats, int(top.sum()))
    if seats <= 0:
        return [0] * len(weights)
    at = lambda t: np.minimum(top, np.floor((w / t + 1) / 2).astype(np.int64))  # noqa: E731  seats with quotients of t or more
    high, low = float(w.max()) * 2, float(w[w > 0].min()) / (4 * (float(top.max()) + 1))
    for _ in range(200):
        mid = (high + low) / 2
        if at(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = at(high)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < top[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < top[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return [int(g) for g in got]


def _multiplier(rng: np.random.Generator, blocks: int) -> int:
    """A random number without a common divisor with ``blocks``: multiplying by it permutes them."""
    if blocks >= MAX_BLOCKS:
        raise ValueError("a shard has too many blocks: raise MAX_SHARDS")
    while blocks > 2:
        found = int(rng.integers(1, blocks))
        if gcd(found, blocks) == 1:
            return found
    return 1


_PLAN = "source string, shard int, source_size long, target double, words long, blocks long, each long, extra long, mult long, plus long"


def _plan(sized: DataFrame, seed: int) -> DataFrame:
    """One row a shard: its words, blocks, quota and permutation. ``sized``: source, size, h."""
    spark = sized.sparkSession
    sizes = [(r["source"], r["n"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets(sizes)
    shards = spark.createDataFrame([(s, min(MAX_SHARDS, max(1, -(-n // SHARD_WORDS)))) for s, n in sizes], "s string, shards int")
    dealt = sized.join(shards, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "shards", F.expr("pmod(h, shards)").cast("int").alias("shard")).agg(F.sum("size").alias("words"))
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in dealt.collect():
        found.setdefault(r["source"], []).append((r["shard"], r["words"] or 0))
    order = sorted(found, key=lambda s: (s is None, s or ""))
    cut = lambda n: max(1, round(n / BLOCK_WORDS)) if n else 0
    total = sum(n for _, n in sizes)
    quotas = sainte_lague([goal[s] for s in order], round(total / BLOCK_WORDS), [MOST * sum(cut(n) for _, n in found[s]) for s in order])
    size_of, rows = dict(sizes), []
    for s, quota in zip(order, quotas):
        parts = sorted(found[s])
        for (shard, n), q in zip(parts, sainte_lague([float(n) for _, n in parts], quota, [MOST * cut(n) for _, n in parts])):
            blocks = cut(n)
            rng = np.random.default_rng([seed, shard, *(s or "\0").encode()])
            each, extra = divmod(q, blocks) if blocks else (0, 0)
            rows.append((s, shard, size_of[s], goal[s], n, blocks, each, extra, _multiplier(rng, blocks), int(rng.integers(0, max(1, blocks)))))
    return spark.createDataFrame(rows, _PLAN)


def _placed(rows: DataFrame, sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with source, size and h -> with their shard's plan and ``a``, the words before them in it.

    ``sized`` holds source, size and h of the same rows.
    """
    counts = plan.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), *[c for c in plan.columns if c not in ("source", "shard")])
    # A source's shards and the parts of each.
    cut = [(r["source"], max(1, -(-r["source_size"] // SHARD_WORDS))) for r in plan.select("source", "source_size").distinct().collect()]
    many = rows.sparkSession.createDataFrame([(s, min(MAX_SHARDS, n), -(-n // MAX_SHARDS)) for s, n in cut], "s string, shards int, parts long")

    def dealt(some: DataFrame) -> DataFrame:
        place = some.join(many, F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", F.expr("pmod(h, shards)").cast("int"))
        # The upper 31 bits of the order's key, so that parts follow the order.
        return place.withColumn("part", F.expr("shiftrightunsigned(h, 33) * parts div 2147483648")).withColumn("high", F.expr("shiftrightunsigned(h, 33)")).drop("s", "shards", "parts")

    sums = dealt(sized).groupBy("source", "shard", "part").agg(F.sum("size").alias("part_words"))
    earlier = Window.partitionBy("source", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), F.col("part").alias("q_part"), F.coalesce(F.sum("part_words").over(earlier), F.lit(0)).alias("ahead"))
    full = dealt(rows).join(counts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    full = full.join(ahead, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")) & (F.col("part") == F.col("q_part")))
    before = Window.partitionBy("source", "shard", "part").orderBy("high", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("a", F.col("ahead") + F.coalesce(F.sum("size").over(before), F.lit(0)))


_TAKEN = """CASE WHEN size = 0 OR blocks = 0 THEN 0 ELSE each * size + aggregate(
    sequence(((a + 1) * blocks - 1) div words, ((a + size) * blocks - 1) div words), 0L,
    (t, k) -> t + CASE WHEN (mult * k + plus) % blocks < extra
                  THEN least(a + size, (k + 1) * words div blocks) - greatest(a, k * words div blocks) ELSE 0L END) END"""


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix), source, shard."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = scratch.table("sized", _sized(rows, seed).select("doc_id", "source", "size", "h"))
    placed = _placed(sized, sized, _plan(sized, seed))
    return placed.select("doc_id", "size", "source_size", "target", F.expr(_TAKEN).alias("taken"), "source", "shard")


_SPANS = re.compile(WORD)


def _cut(text: str, a: int, words: int, blocks: int, each: int, extra: int, mult: int, plus: int) -> str:
    """The document's share of the mix: its blocks as they stand, once for each time they are taken."""
    spans = [m.span() for m in _SPANS.finditer(text)]
    n = len(spans)
    if not n or not blocks:
        return ""
    times = np.zeros(n + 1, np.int64)
    for k in range(((a + 1) * blocks - 1) // words, ((a + n) * blocks - 1) // words + 1):
        first, last = max(a, k * words // blocks) - a, min(a + n, (k + 1) * words // blocks) - a
        times[first:last] = each + ((mult * k + plus) % blocks < extra)
    out = []
    for level in range(1, int(times.max()) + 1):
        flag = np.concatenate([[False], times[:-1] >= level, [False]])
        edges = np.flatnonzero(flag[1:] != flag[:-1])
        for i, j in zip(edges[::2], edges[1::2]):
            out.append(text if j - i == n else text[spans[i][0] : spans[j - 1][1]])
    return "\n".join(out)


def draw(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each document's taken blocks, in order, a block taken twice twice.

    Same columns as the input (text and, where there is one, n_chars anew), one row for each
    document of which something is taken; a document taken whole keeps its text unchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "mixing")
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    packed = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).cast("struct<x:int>").alias("rest"))
    sized = _sized(packed, seed)
    slim = scratch.table("sized", sized.select("source", "size", "h"))
    placed = _placed(sized, slim, _plan(slim, seed)).where("size > 0 AND (each > 0 OR extra > 0)")
    names = ["a", "words", "blocks", "each", "extra", "mult", "plus"]
    kept = placed.select("doc_id", "source", "text", "rest", *names)
    schema = kept.select("doc_id", "source", "text", "rest").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ["text", *names]))
            texts = pa.array([_cut(*x) for x in args], pa.string())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, batch.column(3)], names=["doc_id", "source", "text", "rest"])
            yield out.filter(pa.array([t != "" for t in texts.to_pylist()], pa.bool_()))

    drawn = kept.mapInArrow(tidy(run), schema)
    columns = [F.col(c) if c in ("doc_id", "source", "text") else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns]
    return drawn.select(*columns)
