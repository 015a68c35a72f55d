"""Numpy arrays in the shared folder: written by tasks, memory-mapped by others; and compact rows of sorted keys.

A file is written under another name and renamed, so a task that runs twice leaves the same file.
A worker keeps the ``OPEN`` files that it used last mapped, whatever their number: descriptors, maps and
local copies do not grow with the data.
Where the shared folder is a mounted one, workers map the files in place; elsewhere (an object
store, HDFS) they copy a file to their own disk once, through pyarrow's file systems.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.worker import held


#: Files that a worker keeps mapped.
OPEN = 200


class Store:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self._maps: OrderedDict[str, np.ndarray] = OrderedDict()
        self._own: tempfile.TemporaryDirectory | None = None

    def __reduce__(self):
        return Store, (self.uri,)

    def _local(self) -> str | None:
        if self.uri.startswith("file:"):
            return "/" + self.uri.removeprefix("file:").lstrip("/")
        return self.uri if self.uri.startswith("/") else None

    def put(self, name: str, values: np.ndarray) -> None:
        local = self._local()
        if local:
            os.makedirs(local, exist_ok=True)
            half = f"{local}/.{name}-{uuid.uuid4().hex}"
            with open(half, "wb") as f:
                np.save(f, values)
            os.replace(half, f"{local}/{name}.npy")
            return
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        half = f"{path}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(half) as f:
            sink = pa.BufferOutputStream()
            np.save(sink, values)
            f.write(sink.getvalue())
        system.move(half, f"{path}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        if name in self._maps:
            self._maps.move_to_end(name)
        else:
            while len(self._maps) >= OPEN:
                old, _ = self._maps.popitem(last=False)  # closed as soon as nobody holds its array
                if self._own:
                    os.unlink(f"{self._own.name}/{old}.npy")
            local = self._local()
            if local is None:
                self._own = self._own or tempfile.TemporaryDirectory(prefix="arrays-")
                local = self._own.name
                system, path = fs.FileSystem.from_uri(self.uri)
                fs.copy_files(f"{path}/{name}.npy", f"{local}/{name}.npy", source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            path = f"{local}/{name}.npy"
            # An empty array cannot be mapped.
            self._maps[name] = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
        return self._maps[name]


def opened(store: Store) -> Store:
    """The worker's own handle, so that maps stay open between tasks."""
    return held(("store", store.uri), lambda: store)


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as zstd of their byte planes; ascending ones as differences."""
    v = np.asarray(values, np.uint64)
    if ascending and len(v):
        v = np.concatenate([v[:1], v[1:] - v[:-1]])
    planes = v.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return bytes(pa.compress(planes, codec="zstd", asbytes=True))


def unsqueeze(blob: bytes, n: int, ascending: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1).astype(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of each one's counts (default 1)."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return keys[first], sums.astype(np.int64)


class Counter:
    """Counts of 64-bit keys within a task: gathered, merged when large, given out when too large."""

    def __init__(self, merge_at: int = 2_000_000, full_at: int = 8_000_000):
        self.merge_at, self.full_at = merge_at, full_at
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.floor = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        part = counted(keys, counts)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held - self.floor > self.merge_at:
            merged = self._merged()
            self.parts, self.held = [merged], len(merged[0])
            self.floor = self.held

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return counted(np.zeros(0, np.uint64))
        return counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def full(self) -> bool:
        return self.held > self.full_at

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._merged()
        self.parts, self.held, self.floor = [], 0, 0
        return out


#: Bytes of text whose counted keys one bucket holds, about.
BUCKET_BYTES = 128 << 20


def buckets_for(docs: DataFrame, text: str) -> int:
    """Buckets for keys counted over a column of texts, in proportion to its bytes."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(16, -(-total // BUCKET_BYTES))


BUCKET_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BUCKET_DDL = "bucket int, kind int, n long, keys binary, counts binary"


def bucket_rows(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Sorted keys and their counts, a row a bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.append(np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    rows = [(int(bucket[a]), kind, int(b - a), squeeze(keys[a:b], True), squeeze(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BUCKET_ROWS)], schema=BUCKET_ROWS)


def merged_rows(table: pa.Table, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a bucket's rows of one kind."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, n, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "keys", "counts"))):
        if k == kind:
            keys.append(unsqueeze(a, n, True))
            counts.append(unsqueeze(b, n).astype(np.int64))
    return counted(np.concatenate(keys), np.concatenate(counts))
