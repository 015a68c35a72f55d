"""ISO base media files in a binary column: written from bytes, and indexed without decoding.

``parse`` walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables
(stsd, stts, stss, stsc, stsz and stz2, stco and co64) and gives for each track the codec,
timescale, duration, every sample's byte range and which samples are keyframes. ``probe`` stores
that as columns; it never reads the media data. ``mux`` writes bytes as a raw video track of 8x8
eight-bit frames (64 bytes a sample), a chunk and a keyframe every 16 samples.

Cases: a null text is an empty one; null media give nulls and ``error`` "no media"; damaged media
give nulls and a reason, never an exception; a track without stss has every sample a keyframe;
equal texts give equal values; other columns stay, but ``probe`` replaces ``tracks`` and ``error``;
an empty table gives no row. A value is held in memory whole, with tables
of 12 bytes a sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from siltstone.llm.worker import tidy
from siltstone.session import fresh_name, ship, small_batches

SIDE, FRAME, GROUP, TIMESCALE = 8, 64, 16, 25
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")


@lru_cache(maxsize=512)
def _moov(frames: int, media_at: int) -> bytes:
    chunks = -(-frames // GROUP)
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x04gray", 8, -1)
    last = frames - (chunks - 1) * GROUP
    runs = [(1, GROUP, 1)] if chunks > 1 else [(1, last, 1)]
    if chunks > 1 and last != GROUP:
        runs.append((chunks, last, 1))
    offsets = media_at + np.arange(chunks, dtype=np.int64) * GROUP * FRAME
    wide = int(offsets[-1]) >= 1 << 32
    keys = 1 + np.arange(chunks, dtype=np.int64) * GROUP
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", chunks), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def mux(payload: bytes) -> bytes:
    """A file whose one track holds the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    frames = len(payload) // FRAME
    at = 0
    for _ in range(3):  # the tables' size may depend on where the data start
        moov = _moov(frames, at)
        now = len(_FTYP) + len(moov) + (8 if len(payload) + 8 < 1 << 32 else 16)
        if now == at:
            break
        at = now
    return _FTYP + moov + _box(b"mdat", payload)


def padded(text: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % FRAME if text else FRAME)


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    durations: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of contents, end) of the boxes of a range."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box {kind!r} is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} passes the end of what holds it")
        yield kind, at + head, at + size
        at += size
    if at != end:
        raise ValueError("bytes are left after the last box")


def _ints(data: bytes, at: int, end: int, width: str, n: int) -> np.ndarray:
    if at + n * int(width[-1]) > end:
        raise ValueError("a table passes the end of its box")
    return np.frombuffer(data, width, n, at).astype(np.int64)


def _tables(data: bytes, at: int, end: int, track: Track) -> None:
    chunks = first = None
    stts: list[np.ndarray] = []
    sync = None
    for kind, a, b in boxes(data, at, end):
        if kind == b"stsd":
            if struct.unpack_from(">I", data, a + 4)[0]:
                track.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
                if track.handler == "vide" and a + 44 <= b:
                    track.width, track.height = struct.unpack_from(">HH", data, a + 40)
        elif kind == b"stts":
            pairs = _ints(data, a + 8, b, ">u4", 2 * struct.unpack_from(">I", data, a + 4)[0]).reshape(-1, 2)
            stts = [pairs[:, 0], pairs[:, 1]]
        elif kind == b"stss":
            sync = _ints(data, a + 8, b, ">u4", struct.unpack_from(">I", data, a + 4)[0]) - 1
        elif kind == b"stsc":
            first = _ints(data, a + 8, b, ">u4", 3 * struct.unpack_from(">I", data, a + 4)[0]).reshape(-1, 3)
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, a + 4)
            if fixed and n > len(data):
                raise ValueError("more samples than bytes")
            track.sizes = np.full(n, fixed, np.int64) if fixed else _ints(data, a + 12, b, ">u4", n)
        elif kind == b"stz2":
            bits, n = struct.unpack_from(">3xBI", data, a + 4)
            if bits == 4:
                both = _ints(data, a + 12, b, ">u1", (n + 1) // 2)
                track.sizes = np.stack([both >> 4, both & 15], 1).reshape(-1)[:n]
            else:
                track.sizes = _ints(data, a + 12, b, f">u{bits // 8}", n)
        elif kind in (b"stco", b"co64"):
            chunks = _ints(data, a + 8, b, ">u4" if kind == b"stco" else ">u8", struct.unpack_from(">I", data, a + 4)[0])
    n = len(track.sizes)
    if n and (chunks is None or first is None or not len(chunks) or not len(first)):
        raise ValueError("samples without chunks")
    if n:
        until = np.append(first[1:, 0], len(chunks) + 1)
        per = np.repeat(first[:, 1], np.maximum(until - first[:, 0], 0))[: len(chunks)]
        of = np.repeat(np.arange(len(per)), per)[:n]
        if len(of) < n:
            raise ValueError("chunks hold fewer samples than there are")
        before = np.cumsum(track.sizes) - track.sizes
        heads = np.searchsorted(of, np.arange(len(per)))
        track.offsets = chunks[of] + before - before[np.minimum(heads, n - 1)][of]
        if (track.offsets < 0).any() or (track.offsets + track.sizes > len(data)).any():
            raise ValueError("a sample passes the end of the file")
    if stts:
        if int(stts[0].sum()) > max(n, 1):
            raise ValueError("more times than samples")
        track.durations = np.repeat(stts[1], stts[0])
    track.keyframes = np.arange(n) if sync is None else sync
    if len(track.keyframes) and (track.keyframes.min() < 0 or track.keyframes.max() >= n):
        raise ValueError("a keyframe is not a sample")


def parse(data: bytes) -> list[Track]:
    """Every track of a file; raises ValueError where the boxes contradict each other."""
    tracks: list[Track] = []

    def walk(at: int, end: int) -> None:
        for kind, a, b in boxes(data, at, end):
            if kind == b"trak":
                tracks.append(Track())
            if kind == b"mdhd" and tracks:
                wide = data[a] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"hdlr" and tracks:
                tracks[-1].handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stbl" and tracks:
                _tables(data, a, b, tracks[-1])
            elif kind in _NESTED:
                walk(a, b)

    try:
        walk(0, len(data))
    except (struct.error, IndexError) as e:
        raise ValueError("a box is cut off") from e
    return tracks


def sample_bytes(data: bytes, track: Track) -> bytes:
    """All samples of a track in order; adjoining ones are read at once."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]))


def feature(track: Track) -> str:
    """One line a track: codec, size, duration and its keyframes' byte ranges as a checksum."""
    ranges = np.stack([track.offsets[track.keyframes], track.sizes[track.keyframes]]).astype("<i8").tobytes()
    return (
        f"{track.handler}/{track.codec.strip()} {track.width}x{track.height} {track.duration}/{track.timescale}s samples={len(track.sizes)} "
        f"keyframes={len(track.keyframes)} keyframe_bytes={int(track.sizes[track.keyframes].sum())} ranges={zlib.crc32(ranges):08x}"
    )


TRACK_TYPE = "array<struct<handler:string,codec:string,width:int,height:int,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,length:long>>>>"


def _track_row(t: Track) -> dict:
    keys = [{"offset": int(o), "length": int(s)} for o, s in zip(t.offsets[t.keyframes], t.sizes[t.keyframes])]
    return {"handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": keys}


def _looked(data: pa.Buffer) -> dict:
    try:
        return {"tracks": [_track_row(t) for t in parse(memoryview(data))], "error": None}
    except ValueError as e:
        return {"tracks": None, "error": str(e)}


def probe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds ``tracks`` (``TRACK_TYPE``) and ``error``; the media data are not touched."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    kind = T._parse_datatype_string(f"struct<tracks:{TRACK_TYPE},error:string>")

    @F.arrow_udf(kind)
    def look(media: pa.Array) -> pa.Array:
        return pa.array([_looked(m.as_buffer()) if m.is_valid else {"tracks": None, "error": "no media"} for m in media], to_arrow_type(kind))

    found = fresh_name(df, "found")
    return df.withColumn(found, look(F.col(media_col).cast("binary"))).withColumn("tracks", F.col(found)["tracks"]).withColumn("error", F.col(found)["error"]).drop(found)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's bytes, padded, as the one track of a file."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_store), "doc_id long, n_bytes long, media binary")


def save(docs: DataFrame, path: str) -> DataFrame:
    """``store``'s table as Parquet files below ``path``, read again."""
    stored = store(docs)
    stored.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(stored.schema).parquet(path)


_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes array<struct<offset:long,length:long>>"


def _read(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = memoryview(data.as_buffer())
                track = parse(data)[0]
                got, row = sample_bytes(data, track), _track_row(track)
                rows.append((doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), *(row[k] for k in ("codec", "timescale", "duration", "keyframes"))))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read_back(stored: DataFrame) -> DataFrame:
    """From the stored bytes alone: the payload's digests, each file's feature, its codec, duration and keyframe byte ranges."""
    ship(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_read(to_arrow_schema(T._parse_datatype_string(_DDL)))), _DDL)
