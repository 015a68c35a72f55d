"""Token ids as binary shards, coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, serves all shards. A shard holds whole
documents in ascending doc_id order. Its ids are cut into blocks of ``BLOCK`` ids that are coded
independently, each by ``LANES`` interleaved coders that share one stream of 32-bit words. Every
``STEPS`` rounds a block stores the coders' states and the stream's position, so that decoding
starts at any checkpoint; every block has the CRC-32 of its ids, every shard that of its bytes.

Layout of a shard (little-endian): header ``_HEADER``; doc_ids int64; ids per document uint32;
for each block ``_BLOCK`` and then its checkpoints (word position uint32, states uint64), then its
words uint32; CRC-32 of all that uint32. Layout of a table: header ``_TABLE``, symbols uint32,
frequencies uint32, CRC-32.

Cases: a null text is an empty one (only the end id); a null doc_id sorts first and is kept as
null; equal doc_ids stand in the order of their ids' bytes; an empty table gives no shard and no row.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.tokens import encoder
from siltstone.llm.worker import tidy
from siltstone.session import Scratch, ship, small_batches

LANES, BLOCK, STEPS, SCALE = 32, 1 << 16, 512, 20
#: Ids after which a shard is closed, at the next document's start.
SHARD_IDS = 1 << 21
_LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<4sHHIIIQ")  # magic, version, lanes, documents, blocks, table's CRC-32, ids
_BLOCK = struct.Struct("<IIII")  # ids, words, checkpoints, CRC-32 of the ids as uint32
_TABLE = struct.Struct("<4sHHI")  # magic, version, scale bits, symbols
#: Stands for a null doc_id in a shard.
_NULL = -(1 << 63)


class Table:
    """Symbol frequencies that sum to 2**scale, and the tables that coding needs."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, scale: int):
        self.symbols, self.freqs, self.scale = symbols.astype(np.uint32), freqs.astype(np.uint64), scale
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.index = np.full(int(self.symbols.max(initial=0)) + 1, -1, np.int64)
        self.index[self.symbols] = np.arange(len(self.symbols))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))
        return self._slots

    @classmethod
    def fit(cls, symbols: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> "Table":
        """Each symbol gets its share of 2**scale, at least 1; the commonest take up the rounding."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        while len(symbols) * 4 > 1 << scale:
            scale += 1
        freqs = np.maximum(1, np.floor(counts * ((1 << scale) / max(counts.sum(), 1)))).astype(np.int64)
        over = int(freqs.sum()) - (1 << scale) if len(freqs) else 0
        by_size = np.argsort(-freqs, kind="stable")
        if over < 0:
            freqs[by_size[0]] -= over
        for i in by_size:
            if over <= 0:
                break
            take = min(over, int(freqs[i]) - 1)
            freqs[i] -= take
            over -= take
        return cls(symbols, freqs, scale)

    def dump(self) -> bytes:
        body = _TABLE.pack(b"SRNT", 1, self.scale, len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def load(cls, blob: bytes) -> "Table":
        magic, version, scale, n = _TABLE.unpack_from(blob)
        if magic != b"SRNT" or version != 1 or zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("not a frequency table, or damaged")
        at = _TABLE.size
        return cls(np.frombuffer(blob, "<u4", n, at), np.frombuffer(blob, "<u4", n, at + 4 * n), scale)


def _encode_alike(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of one length, a row each, coded side by side."""
    blocks, n = ids.shape
    steps = -(-n // LANES)
    known = ids < len(table.index)
    at = np.where(known, table.index[np.where(known, ids, 0)], -1)
    if (at < 0).any():
        raise ValueError("an id is missing from the frequency table")
    padded = np.full((blocks, steps * LANES), int(np.argmax(table.freqs)), np.int64)
    padded[:, :n] = at
    lanes = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    freq, start = table.freqs[lanes], table.starts[lanes]
    state = np.full(blocks * LANES, _LOW, np.uint64)
    words = np.empty(lanes.shape, np.uint32)
    sent = np.empty(lanes.shape, bool)
    room, scale, half = np.uint64(63 - table.scale), np.uint64(table.scale), np.uint64(32)
    marks = {}
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        full = state >= (f << room)
        words[t], sent[t] = state.astype(np.uint32), full
        state = np.where(full, state >> half, state)
        q = state // f
        state = (q << scale) + (state - q * f) + start[t]
        if t % STEPS == 0:
            marks[t] = state
    out = []
    for b in range(blocks):
        own = slice(b * LANES, (b + 1) * LANES)
        flags = sent[:, own]
        stream = words[:, own][flags]
        before = np.append(0, np.cumsum(flags.sum(axis=1)))
        points = b"".join(struct.pack("<I", int(before[t])) + marks[t][own].astype("<u8").tobytes() for t in range(0, steps, STEPS))
        out.append(_BLOCK.pack(n, len(stream), -(-steps // STEPS), zlib.crc32(ids[b].astype("<u4").tobytes())) + points + stream.astype("<u4").tobytes())
    return out


def encode_shard(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, table: Table, table_crc: int) -> bytes:
    blocks, whole = [], len(ids) // BLOCK
    if whole:
        blocks += _encode_alike(ids[: whole * BLOCK].reshape(whole, BLOCK), table)
    if len(ids) % BLOCK:
        blocks += _encode_alike(ids[whole * BLOCK :].reshape(1, -1), table)
    body = _HEADER.pack(b"SRNS", 1, LANES, len(doc_ids), len(blocks), table_crc, len(ids))
    body += np.asarray(doc_ids, "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes() + b"".join(blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def _decode_alike(parts: list[tuple], steps: int, table: Table, lanes: int) -> np.ndarray:
    """Runs of ``steps`` rounds from checkpoints, side by side: (words, position, states) -> a row of symbols each."""
    base = np.cumsum([0] + [len(p[0]) for p in parts])[:-1]
    words = np.concatenate([p[0] for p in parts] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    at = base + np.array([p[1] for p in parts], np.int64)
    state = np.concatenate([p[2] for p in parts]).astype(np.uint64)
    slots, freqs, starts = table.slots, table.freqs, table.starts
    mask, scale, half = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), np.uint64(32)
    out = np.empty((steps, len(state)), np.uint32)
    for t in range(steps):
        slot = state & mask
        s = slots[slot]
        out[t] = s
        state = freqs[s] * (state >> scale) + slot - starts[s]
        need = (state < _LOW).reshape(-1, lanes)
        nth = np.cumsum(need, axis=1)
        where = (at[:, None] + nth - 1)[need]
        at = at + nth[:, -1]
        flat = need.reshape(-1)
        state[flat] = (state[flat] << half) | words[where]
    return out.reshape(steps, len(parts), lanes).transpose(1, 0, 2).reshape(len(parts), steps * lanes)


def decode_shard(blob: bytes, table: Table, table_crc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ids of a shard; raises ValueError on any damage."""
    magic, version, lanes, n_docs, n_blocks, crc, n_ids = _HEADER.unpack_from(blob)
    if magic != b"SRNS" or version != 1 or zlib.crc32(memoryview(blob)[:-4]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("not a shard, or damaged")
    if crc != table_crc:
        raise ValueError("the shard was coded by another frequency table")
    at = _HEADER.size
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
    sizes = np.frombuffer(blob, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    runs: dict[int, list] = {}
    heads, offset = [], 0
    for _ in range(n_blocks):
        n, n_words, points, block_crc = _BLOCK.unpack_from(blob, at)
        at += _BLOCK.size
        steps, width = -(-n // lanes), 4 + 8 * lanes
        stream = np.frombuffer(blob, "<u4", n_words, at + points * width)
        for p in range(points):
            position = struct.unpack_from("<I", blob, at + p * width)[0]
            states = np.frombuffer(blob, "<u8", lanes, at + p * width + 4)
            runs.setdefault(min(STEPS, steps - p * STEPS), []).append((stream, position, states, offset + p * STEPS * lanes))
        at += points * width + 4 * n_words
        heads.append((offset, n, block_crc))
        offset += steps * lanes
    flat = np.empty(offset, np.uint32)
    for steps, parts in runs.items():
        for row, part in zip(_decode_alike(parts, steps, table, lanes), parts):
            flat[part[3] : part[3] + len(row)] = row
    ids = [table.symbols[flat[o : o + n]] for o, n, _ in heads]
    for got, (_, _, block_crc) in zip(ids, heads):
        if zlib.crc32(got.astype("<u4").tobytes()) != block_crc:
            raise ValueError("a block's ids differ from its checksum")
    return doc_ids, sizes, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def _tokenize(path: str, end_id: int):
    """Rows: doc_id and ids of each document; at a task's end one row of its symbol counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for at, ids, bounds in enc.encode(batch.column(1), end_id):
                n = len(bounds) - 1
                got = np.bincount(ids, minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
                flat = ids.astype("<u4" if ids.dtype == np.uint32 else "<u2")
                wide = flat.itemsize
                rows = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), batch.column(0).slice(at, n), pa.array(np.diff(bounds)), rows], ["counts", "doc_id", "n", "ids"])
        seen = np.flatnonzero(counts)
        blob = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([len(seen)], pa.int64()), pa.array([blob], pa.binary())], ["counts", "doc_id", "n", "ids"])

    return run


def _spread_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            pairs = np.frombuffer(blob, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["id", "n"])


_SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, raw_bytes long, shard binary"


def _pack(table_blob: bytes, wide: int, shard_ids: int):
    """Documents in order -> shards; ``part`` and ``seq`` order the shards of the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc = Table.load(table_blob), zlib.crc32(table_blob)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        rows: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(rows)
            blob = encode_shard(np.array(doc_ids, np.int64), np.array([len(r) for r in rows]), ids, table, crc)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(rows), "n_ids": held, "raw_bytes": 4 * held, "shard": blob}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("raw_bytes", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(_NULL if doc_id is None else doc_id)
                rows.append(np.frombuffer(blob, f"<u{wide}").astype(np.uint32))
                held += len(rows[-1])
                if held >= shard_ids:
                    yield close()
                    doc_ids, rows, held, seq = [], [], 0, seq + 1
        if rows:
            yield close()

    return run


def write_shards(spark: SparkSession, docs: DataFrame, out: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Write ``out``/table (one row) and ``out``/shards (a row each) as Parquet with binary columns."""
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "rans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "counts boolean, doc_id long, n long, ids binary"
    # Counts and documents go to folders of their own, so that neither is read for the other.
    rows.mapInArrow(tidy(_tokenize(tokenizer, end_id)), kinds).write.partitionBy("counts").option("compression", "zstd").parquet(scratch.path("tokens"))
    tokens = spark.read.schema(kinds).parquet(scratch.path("tokens"))
    counts = (
        tokens.where("counts").select("ids").mapInArrow(tidy(_spread_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    )  # a row for each id of the vocabulary at most
    table = Table.fit(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)).dump() if len(counts) else Table(np.zeros(0), np.zeros(0), SCALE).dump()
    spark.createDataFrame([(bytearray(table),)], "blob binary").coalesce(1).write.parquet(f"{out}/table")
    wide = encoder(tokenizer).dtype().itemsize
    ordered = tokens.where("not counts").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(tidy(_pack(table, wide, shard_ids)), _SHARD_SCHEMA).write.parquet(f"{out}/shards")
    scratch.close()


_DOC_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(table_blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc = Table.load(table_blob), zlib.crc32(table_blob)
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i) for i in range(3))):
                doc_ids, sizes, ids = decode_shard(blob.as_py(), table, crc)
                flat = ids.astype("<u4")
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL), pa.array(starts, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], schema=_DOC_SCHEMA)

    return run


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    ship(spark)
    small_batches(spark)
    table = bytes(spark.read.parquet(f"{out}/table").first()["blob"])
    shards = spark.read.schema(_SHARD_SCHEMA).parquet(f"{out}/shards")
    # Ids before a shard: those of the parts before its part (a row a part), then of the shards before it there.
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = sizes.withColumn("inside", F.sum("n_ids").over(within) - F.col("n_ids")).join(parts.select("part", "base"), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("shard_start"))
    docs = shards.select("part", "seq", "shard").mapInArrow(tidy(_read(table)), "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
