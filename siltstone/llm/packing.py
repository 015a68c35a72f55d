"""Hierarchical packing of documents' token ids into sequences of several context sizes.

Each task packs the documents it reads, so nothing is shuffled. A document is cut at multiples of
the largest tier; full windows stand alone, and the rest goes to the smallest tier (256, 512, 1024
or 2048 ids) that holds it. A window of 64 batches' worth of rests is packed from the largest tier
down: the longest rest opens a sequence, and its gap is filled by the longest rest that fits, from
that tier or any shorter one; what no rest fits is filled by a cut. Whatever is left at a task's
end is laid end to end and cut at powers of two. So every sequence is full, or its
length is a power of two: no id of padding is needed.

Sequences of one length form step groups of ``STEP_IDS`` ids. The packed pieces are written first;
then each task's sequences of a length are numbered after those of the tasks before it, so groups
run on across tasks, and only the last group of a length may be short.

Cases: a null text is an empty one (the end id alone); rows with equal or null doc_id are packed
separately; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.tokens import encoder
from siltstone.llm.worker import tidy
from siltstone.session import Scratch, ship, small_batches

TIERS = (256, 512, 1024, 2048)
#: Ids that one step group of a tier holds.
STEP_IDS = 1 << 14
#: Ids of rests that a task gathers before it packs them.
WINDOW_IDS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("nth", pa.int64())])
#: Bits of a sequence's number within its task.
_OWN = 40


class Packer:
    """One task's packing. A rest is (length, order, doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.base = tiers, part << _OWN
        self.sequences = 0
        self.of_size: Counter[int] = Counter()
        self.rests: list[tuple] = []
        self.held = self.order = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        size = sum(p[0] for p in pieces)
        at = 0
        for length, _, doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, self.base + self.sequences, at, size, self.of_size[size]))
            at += length
        self.of_size[size] += 1
        self.sequences += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        for start in range(0, n - n % top, top):
            self._close([(top, 0, doc_id, start, ids[start : start + top], n)])
        if n % top:
            start = n - n % top
            self.rests.append((n - start, self.order, doc_id, start, ids[start:], n))
            self.order += 1
            self.held += n - start

    def _take(self, rests: list[tuple], gap: int) -> tuple | None:
        i = bisect_right(rests, (gap, float("inf")))
        return rests.pop(i - 1) if i else None

    def flush(self, last: bool = False) -> None:
        rests = sorted(self.rests, key=lambda r: r[:2])
        left = sum(r[0] for r in rests)
        self.rests = []
        while rests and left >= self.tiers[-1]:
            first = rests.pop()
            tier = next(t for t in self.tiers if t >= first[0])
            pieces, gap = [first], tier - first[0]
            while gap:
                nxt = self._take(rests, gap)
                if nxt is None:  # a cut fills the gap; the shortest rest loses least context
                    length, order, doc_id, start, ids, total = rests.pop(0)
                    nxt = (gap, order, doc_id, start, ids[:gap], total)
                    insort(rests, (length - gap, order, doc_id, start + gap, ids[gap:], total), key=lambda r: r[:2])
                pieces.append(nxt)
                gap -= nxt[0]
            self._close(pieces)
            left -= tier
        if not last:
            self.rests, self.held = rests, left
            return
        while rests:  # under one window: cut at the powers of two of what is left
            size = 1 << (sum(r[0] for r in rests).bit_length() - 1)
            pieces, gap = [], size
            while gap:
                length, order, doc_id, start, ids, total = rests.pop(0)
                pieces.append((min(gap, length), order, doc_id, start, ids[:gap], total))
                if length > gap:
                    rests.insert(0, (length - gap, order, doc_id, start + gap, ids[gap:], total))
                gap -= min(gap, length)
            self._close(pieces)
        self.held = 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _pack(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, bounds in enc.encode(batch.column(1), end_id):
                for i in range(len(bounds) - 1):
                    packer.add(doc_ids[at + i], ids[bounds[i] : bounds[i + 1]])
                if packer.held >= WINDOW_IDS:
                    packer.flush()
                yield packer.batch()
        packer.flush(last=True)
        yield packer.batch()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, step_ids: int = STEP_IDS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, the sequence's length (``tier``) and step group."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = Scratch(spark, "packing").table("pieces", rows.mapInArrow(tidy(_pack(tokenizer, end_id)), SCHEMA))
    part = F.shiftright("sequence_id", _OWN)
    counts = pieces.groupBy(part.alias("part"), F.col("tier").alias("t")).agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "t", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = pieces.join(ahead, (part == F.col("part")) & (F.col("tier") == F.col("t")))
    group = F.expr(f"(ahead + nth) div greatest(1, {step_ids} div tier)").alias("step_group")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group)
