"""Removal of repeated 100-byte strings by a sparse suffix array, sorted in ranges.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier: in a document
before, or at a smaller offset of the same one. Matches never cross documents and are judged on the
input as it is.

Suffixes are thinned before they are sorted. Each window of WIDTH bytes has one anchor: of its
grams (``GRAM`` bytes) the one with the smallest hash, leftmost on ties. Equal windows have equal
anchors at equal offsets. A window reaches at least 34 bytes beyond its anchor on one side, so it
holds the ``CORE`` of 66 bytes on that side. Suffixes at cores are kept, each with the run of
windows that share it (about one core for 25 bytes) and as many bytes as these windows need. A
line that a third of all documents hold, but that is shorter than a core, joins nothing.

1. Hashes of cores are counted (packed by bucket of the hash, buckets in proportion to the input);
   those that occur twice are written as sorted arrays into the shared folder. This only thins:
   a false hit costs a row.
2. Cores with over ``HOT`` occurrences are too many for one range where what surrounds them differs.
   Their windows become suffixes of their own: counted likewise, and those that occur twice are sent
   as they stand, to the ranges where their own bytes lie.
3. Suffixes are sent to ranges between sampled splitters, by the bytes of the core (or window); as
   many ranges as keep about ``RANGE_BYTES`` each. A splitter never parts equal ones. Runs with equal
   bytes are merged within a task first: all but the earliest are repeats already, so a passage that
   a third of all documents share costs one run a task.
4. A range sorts its suffixes by multikey quicksort and compares neighbours byte by byte, to the
   right of the core's start and to the left of it. Two windows that hold a core at the same offset
   are equal if both comparisons reach to their ends; the earliest of equal ones stays.
5. Ranges give their first and last suffix; neighbours across a boundary must differ.
6. Covered spans are merged per document and cut out.

Cases: a null text is an empty one; texts under 100 bytes lose nothing; documents are ordered by
doc_id (null first), then by the text's hash, and rows equal in both count as one document; a long
text is read in blocks; an empty table gives no row; other columns stay, but those with the names of
the two new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.arrays import BUCKET_DDL, BUCKET_ROWS, Counter, Store, bucket_rows, buckets_for, merged_rows, opened, squeeze, unsqueeze
from siltstone.llm.words import lanes, mix, range_hashes, raw, same_ranges, slices
from siltstone.llm.worker import tidy, tidy_group
from siltstone.session import Scratch, ship, small_batches

WIDTH, GRAM = 100, 32
SIDE = (WIDTH - GRAM) // 2
CORE = GRAM + SIDE
_GRAMS = WIDTH - GRAM + 1
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 20
_GATHER = 16 << 20  # bytes of text within which a task merges equal runs
#: Bytes of runs that a range holds, about.
RANGE_BYTES = 32 << 20
#: Splitters that workers hold; beyond them a range is parted by the suffixes' hashes.
MOST_RANGES = 1 << 18
#: Occurrences from which a core's windows are suffixes of their own.
HOT = 1 << 14
#: One of so many suffixes is a candidate for splitters.
SAMPLED = 512
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _ranks(data: np.ndarray) -> np.ndarray:
    """A value of each gram, by which anchors are chosen."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = lanes(data).copy()
    value = eight[:n] * _FACTORS[0]
    for k in range(1, GRAM // 8):
        value += eight[8 * k : 8 * k + n] * _FACTORS[k]
    value ^= value >> np.uint64(32)
    value *= _FACTORS[3]
    return value


def blocks(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, bounds, offset of the first byte in its text); windows of blocks in a row are those of the texts."""
    for row, part in slices(arr, _BLOCK):
        data, bounds = raw(part)
        if len(part) > 1 or len(data) <= _BLOCK + WIDTH:
            yield row, data, bounds, 0
            continue
        for at in range(0, len(data) - WIDTH + 1, _BLOCK):
            own = data[at : at + _BLOCK + WIDTH - 1]
            yield row, own, np.array([0, len(own)]), at


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a block: first and last window start of each run, and its core's place."""
    none = np.zeros(0, np.int64)
    ranks = _ranks(data)
    if len(ranks) < _GRAMS:
        return none, none, none
    ends = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(ranks), dtype=np.uint64)
    anchor = (_least(ranks & ~_PLACE | place, _GRAMS) & _PLACE).astype(np.int64)
    start = np.arange(len(anchor))
    ok = start + WIDTH <= ends[start]
    same = ok[1:] & ok[:-1] & (anchor[1:] == anchor[:-1])
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    anchor = anchor[first]
    # Windows that start at most SIDE bytes before the anchor hold the core after it, the others the one before it.
    cut = anchor - SIDE
    right, left = last >= cut, first < cut
    return np.concatenate([np.maximum(first, cut)[right], first[left]]), np.concatenate([last[right], np.minimum(last, cut - 1)[left]]), np.concatenate([anchor[right], cut[left]])


def _bytes_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Ranges of ``size`` bytes, as an array of WIDTH-byte strings that sort as bytes do."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    out[:, :size] = data[at[:, None] + np.arange(size)]
    return out.view(f"S{WIDTH}").reshape(-1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _known(store: Store, kind: str, h: np.ndarray, buckets: int) -> np.ndarray:
    """Whether each hash is in the arrays ``kind``."""
    order = np.argsort(h)
    ranked = h[order]
    hit = np.zeros(len(h), bool)
    cuts = np.searchsorted(_bucket(ranked, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        known = store.get(f"{kind}-{b}")
        if len(known):
            mine = ranked[cuts[b] : cuts[b + 1]]
            hit[order[cuts[b] : cuts[b + 1]]] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
    return hit


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _windows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _flat(first, last - first + 1)


def _count(buckets: int, hot: Store | None = None):
    """Counts of core hashes; with ``hot``, of the windows of hot cores. Rows of kind 1 are sampled suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, data, bounds, _ in blocks(batch.column(0)):
                first, last, at = runs(data, bounds)
                size = CORE
                h = range_hashes(data, at, at + CORE)
                if hot is not None:
                    on = _known(opened(hot), "hot", h, buckets)
                    at, size = _windows_of(first[on], last[on]), WIDTH
                    h = range_hashes(data, at, at + WIDTH)
                counter.add(h)
                some = np.flatnonzero(mix(h + at.astype(np.uint64)) % np.uint64(SAMPLED) == 0)
                if len(some):
                    some = some[np.argsort(h[some])]
                    yield _sample_rows(h[some], _bytes_at(data, at[some], size), _bucket(h[some], buckets))
                if counter.full():
                    keys, counts = counter.take()
                    yield bucket_rows(keys, counts, _bucket(keys, buckets))
        keys, counts = counter.take()
        yield bucket_rows(keys, counts, _bucket(keys, buckets))

    return run


def _sample_rows(keys: np.ndarray, suffixes: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Sorted hashes and their suffixes, a row a bucket."""
    cuts = np.append(np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket))
    rows = [(int(bucket[a]), 1, int(b - a), squeeze(keys[a:b], True), suffixes[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BUCKET_ROWS)], schema=BUCKET_ROWS)


def _write_repeated(store: Store, kind: str, hot: int | None, sample: int):
    """Writes a bucket's hashes that occur twice, and those that occur over ``hot`` times."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, counts = merged_rows(table)
        store.put(f"{kind}-{b}", keys[counts > 1])
        n_hot = 0
        if hot is not None:
            store.put(f"hot-{b}", keys[counts > hot])
            n_hot = int((counts > hot).sum())
        many = keys[counts > 1]
        found = [np.zeros(0, f"S{WIDTH}")]
        for is_sample, n, k, c in zip(*(table.column(x).to_pylist() for x in ("kind", "n", "keys", "counts"))):
            if is_sample == 1 and len(many):
                h = unsqueeze(k, n, True)
                hit = many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h
                found.append(np.frombuffer(c, f"S{WIDTH}")[hit])
        suffixes = np.sort(np.concatenate(found))
        suffixes = suffixes[(np.arange(sample) * len(suffixes)) // sample] if len(suffixes) > sample else suffixes
        return pa.table({"bucket": pa.array([b], pa.int32()), "runs": [int(counts[counts > 1].sum())], "hot": [n_hot], "suffixes": pa.array([suffixes.tobytes()], pa.binary())})

    return run


_WRITTEN = "bucket int, runs long, hot long, suffixes binary"
_FIELDS = ("doc", "t", "start", "offset", "size")
_RUNS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), *[(f, pa.binary()) for f in _FIELDS], ("length", pa.int64()), ("bytes", pa.binary())])
_RUNS_DDL = "bucket int, kind int, n long, doc binary, t binary, start binary, offset binary, size binary, length long, bytes binary"
#: Kinds of rows: runs of windows around a core, single windows of hot cores, and windows known to be repeats (no bytes).
_AROUND, _SINGLE, _LATE = 0, 1, 2


def _run_rows(kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray], body: np.ndarray | None = None, base: np.ndarray | None = None) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = order[a:b]
        text = body[_flat(base[some], columns["size"][some] + WIDTH - 1)].tobytes() if body is not None else b""
        packed = bytes(pa.compress(text, codec="zstd", asbytes=True)) if text else b""
        rows.append((int(bucket[a]), kind, b - a, *(squeeze(columns[f][some]) for f in _FIELDS), len(text), packed))
    values = list(zip(*rows)) if rows else [()] * len(_RUNS)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _RUNS)], schema=_RUNS)


class _Gathered:
    """Suffixes of one kind that a task has found, and their bytes."""

    def __init__(self, kind: int, core: int):
        self.kind, self.core = kind, core
        self.parts: list[dict[str, np.ndarray]] = []
        self.bodies: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: np.ndarray, t: np.ndarray, start: np.ndarray, offset: np.ndarray, size: np.ndarray, data: np.ndarray, at: np.ndarray, h: np.ndarray) -> None:
        length = size + WIDTH - 1
        body = data[_flat(at, length)]
        self.parts.append({"doc": doc, "t": t, "start": start, "offset": offset, "size": size, "h": h, "base": self.held + np.cumsum(length) - length})
        self.bodies.append(body)
        self.held += len(body)

    def rows(self, splitters: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        c = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        body = np.concatenate(self.bodies)
        self.parts, self.bodies, self.held = [], [], 0
        length = c["size"] + WIDTH - 1
        content = range_hashes(body, c["base"], c["base"] + length)
        order = np.lexsort((c["start"], c["t"], c["doc"], c["offset"], content))
        c, content, length = {k: v[order] for k, v in c.items()}, content[order], length[order]
        head = np.ones(len(order), bool)
        head[1:] = (content[1:] != content[:-1]) | (c["offset"][1:] != c["offset"][:-1]) | (length[1:] != length[:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        # A run is only known for a repeat if its bytes are those of the first.
        same = same_ranges(body, c["base"], body, c["base"][first], length)
        own = (c["doc"] == c["doc"][first]) & (c["t"] == c["t"][first]) & (c["start"] == c["start"][first])
        late, keep = np.flatnonzero(same & ~own), np.flatnonzero(head | ~same)
        columns = {f: c[f] for f in _FIELDS}
        if len(late):
            ranges = (len(splitters) + 1) * parts
            yield _run_rows(_LATE, (mix(c["doc"][late].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64), {f: v[late] for f, v in columns.items()})
        suffixes = _bytes_at(body, (c["base"] + c["offset"])[keep], self.core)
        bucket = np.searchsorted(splitters, suffixes, "right") * parts + (c["h"][keep] % np.uint64(parts)).astype(np.int64)
        yield _run_rows(self.kind, bucket, {f: v[keep] for f, v in columns.items()}, body, c["base"][keep])


def _send(store: Store, buckets: int, any_hot: bool, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = opened(store)
        splitters = arrays.get("splitters")
        around, single = _Gathered(_AROUND, CORE), _Gathered(_SINGLE, WIDTH)
        for batch in batches:
            docs, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, data, bounds, base in blocks(batch.column(2)):
                first, last, core = runs(data, bounds)
                h = range_hashes(data, core, core + CORE)
                hit = _known(arrays, "cores", h, buckets)
                first, last, core, h = first[hit], last[hit], core[hit], h[hit]
                hot = _known(arrays, "hot", h, buckets) if any_hot else np.zeros(len(h), bool)
                if hot.any():
                    at = _windows_of(first[hot], last[hot])
                    w = range_hashes(data, at, at + WIDTH)
                    twice = _known(arrays, "windows", w, buckets)
                    at, w = at[twice], w[twice]
                    text = np.searchsorted(bounds, at, "right") - 1
                    single.add(docs[row + text], hashes[row + text], at - bounds[text] + base, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), data, at, w)
                    first, last, core, h = first[~hot], last[~hot], core[~hot], h[~hot]
                text = np.searchsorted(bounds, first, "right") - 1
                around.add(docs[row + text], hashes[row + text], first - bounds[text] + base, core - first, last - first + 1, data, first, h)
                for some in (around, single):
                    if some.held >= _GATHER:
                        yield from some.rows(splitters, parts)
        for some in (around, single):
            yield from some.rows(splitters, parts)

    return run


def multikey_order(keys: np.ndarray, small: int = 1024) -> np.ndarray:
    """Order of the rows of 64-bit words, by multikey quicksort.

    Rows are parted by their word at some depth into those below, at and above a pivot, the median
    of three; those at it go on with the next word. Short stretches are sorted at once.
    """
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2 or k == keys.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= small:
            order[a:b] = rows[np.lexsort(keys[rows, k:].T[::-1])]
            continue
        word = keys[rows, k]
        pivot = np.sort(word[[0, (b - a) // 2, -1]])[1]
        below, above = word < pivot, word > pivot
        at = ~(below | above)
        n, m = int(below.sum()), int(at.sum())
        order[a:b] = np.concatenate([rows[below], rows[at], rows[above]])
        todo += [(a, a + n, k), (a + n, a + n + m, k + 1), (a + n + m, b, k)]
    return order


def shared_bytes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of the order shares with the one before it (the first: none)."""
    shared = np.zeros(len(order), np.int64)
    on = np.arange(1, len(order))
    for k in range(keys.shape[1]):
        if not len(on):
            break
        differ = keys[order[on], k] ^ keys[order[on - 1], k]
        # Leading zero bytes of the difference.
        zero = np.zeros(len(on), np.int64)
        for byte in range(7, -1, -1):
            zero += (zero == 7 - byte) & ((differ >> np.uint64(8 * byte)) & np.uint64(255) == 0)
        shared[on] += zero
        on = on[differ == 0]
    return shared


def _kept_high(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The most significant ``count`` bytes of each word (0 or less: none; 8 or more: all)."""
    count = np.clip(count, 0, 8)
    shift = np.minimum(8 * (8 - count), 63).astype(np.uint64)
    return np.where(count > 0, words >> shift << shift, np.uint64(0))


def suffix_words(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place as big-endian words; zeros beyond ``size`` bytes."""
    eight = lanes(data)
    steps = -(-width // 8)
    return np.stack([_kept_high(eight[np.minimum(at + 8 * k, len(data))].byteswap(), np.minimum(size, width) - 8 * k) for k in range(steps)], axis=1)


def prefix_words(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes before each place, nearest first, as big-endian words; zeros beyond ``size`` bytes."""
    room = 8 * -(-width // 8)
    eight = lanes(np.concatenate([np.zeros(room, np.uint8), data]))
    return np.stack([_kept_high(eight[at + room - 8 * (k + 1)].astype(np.uint64), np.minimum(size, width) - 8 * k) for k in range(room // 8)], axis=1)


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its class of rows that share ``depth`` leading bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeats(c: dict[str, np.ndarray], data: np.ndarray, core: int) -> tuple[tuple[np.ndarray, ...], bytes, bytes]:
    """Spans (doc, t, first byte, last byte + 1) of windows of these runs that also start earlier; the first and last suffix.

    ``data`` holds the runs' bytes in a row; a run's core of ``core`` bytes starts at its ``offset``.
    """
    side = WIDTH - core
    length = c["size"] + WIDTH - 1
    at = np.cumsum(length) - length + c["offset"]
    right = suffix_words(data, at, length - c["offset"], WIDTH)
    order = multikey_order(right)
    ends = [_bytes_at(data, at[order[[i]]], core).tobytes() for i in (0, -1)]
    shared = shared_bytes(right, order)
    del right
    # Only runs whose core another one has go on, in the order of documents and places.
    joint = np.append(shared[1:] >= core, False) | (shared >= core)
    kept = np.zeros(len(order), bool)
    kept[order[joint]] = True
    rank = np.lexsort((c["start"] + c["offset"], c["t"], c["doc"]))
    rank = rank[kept[rank]]
    number = np.full(len(order), -1)
    number[rank] = np.arange(len(rank))
    order, shared = number[order[joint]], shared[joint]
    c, at = {f: v[rank] for f, v in c.items()}, at[rank]
    left = prefix_words(data, at, c["offset"], max(side, 1))
    back = multikey_order(left)
    before = shared_bytes(left, back)
    place = c["start"] + c["offset"]
    gone = np.zeros((len(rank), side + 2), bool)  # by how many bytes a window starts before the core, between two empty columns
    for n in range(side + 1):
        rows = np.flatnonzero((n <= c["offset"]) & (n > c["offset"] - c["size"]))
        if not len(rows):
            continue
        key = _classes(order, shared, WIDTH - n)[rows]
        if n:
            key = key * (len(rank) + 1) + _classes(back, before, n)[rows]
        by = np.argsort(key, kind="stable")
        head = np.append(True, key[by][1:] != key[by][:-1])
        first, rows = rows[by[np.flatnonzero(head)[np.cumsum(head) - 1]]], rows[by]
        gone[rows, n] = (c["doc"][rows] != c["doc"][first]) | (c["t"][rows] != c["t"][first]) | (place[rows] != place[first])
    edges = np.diff(gone.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return (c["doc"][row], c["t"][row], place[row] - high + 1, place[row] - low + WIDTH), ends[0], ends[1]


_FOUND = "bucket int, kind int, _doc long, _t long, a long, b long, low binary, high binary"


def _find_repeats(table: pa.Table) -> pa.Table:
    """A range's runs -> covered spans; and for each kind a row (no span) with its first and last suffix."""
    bucket = table.column("bucket")[0].as_py()
    held: dict[int, dict[str, list[np.ndarray]]] = {}
    bodies: dict[int, list[np.ndarray]] = {}
    for i in range(table.num_rows):
        row = {c: table.column(c)[i].as_py() for c in table.column_names}
        into = held.setdefault(row["kind"], {f: [] for f in _FIELDS})
        for f in _FIELDS:
            into[f].append(unsqueeze(row[f], row["n"]).astype(np.int64))
        if row["kind"] != _LATE:
            bodies.setdefault(row["kind"], []).append(np.frombuffer(pa.decompress(row["bytes"], decompressed_size=row["length"], codec="zstd", asbytes=True), np.uint8))
    out = []
    for kind in sorted(held):
        c = {f: np.concatenate(v) for f, v in held.pop(kind).items()}
        if kind == _LATE:
            spans = (c["doc"], c["t"], c["start"], c["start"] + c["size"] - 1 + WIDTH)
        else:
            spans, low, high = repeats(c, np.concatenate(bodies.pop(kind)), CORE if kind == _AROUND else WIDTH)
            out.append([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([low], pa.binary()), pa.array([high], pa.binary())])
        n = len(spans[0])
        out.append([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), *(pa.array(x, pa.int64()) for x in spans), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())])
    names = ["bucket", "kind", "_doc", "_t", "a", "b", "low", "high"]
    return pa.concat_tables([pa.Table.from_arrays(columns, names) for columns in out])


def _boundaries_differ(found: DataFrame, parts: int) -> None:
    """Raises if equal suffixes lie on both sides of a boundary: a splitter parted them."""
    ends = found.where("kind IS NOT NULL").select("kind", F.pmod("bucket", F.lit(parts)).alias("part"), "bucket", "low", "high")
    before = F.lag("high").over(Window.partitionBy("kind", "part").orderBy("bucket"))
    if not ends.withColumn("before", before).where("before >= low").isEmpty():
        raise ValueError("equal suffixes lie in two ranges")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_doc, _t (the row's key) and _spans, array of (a, b): bytes that repeats cover, not merged."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    store = Store(scratch.path("arrays"))
    texts = docs.where(F.octet_length("text") >= WIDTH).select(_key().alias("_doc"), F.xxhash64("text").alias("_t"), F.col("text").cast("string").alias("text"))
    buckets = buckets_for(texts, "text")

    def count(kind: str, hot: Store | None, limit: int | None) -> list:
        counted = texts.select("text").mapInArrow(tidy(_count(buckets, hot)), BUCKET_DDL).repartitionById(buckets, F.col("bucket"))
        sample = max(16, MOST_RANGES // buckets)
        rows = counted.groupBy("bucket").applyInArrow(tidy_group(_write_repeated(store, kind, limit, sample)), _WRITTEN).collect()  # MOST_RANGES suffixes, or 16 a bucket
        for b in set(range(buckets)) - {r["bucket"] for r in rows}:
            for name in (kind, "hot") if limit is not None else (kind,):
                store.put(f"{name}-{b}", np.zeros(0, np.uint64))
        return rows

    rows = count("cores", None, HOT)
    any_hot = any(r["hot"] for r in rows)
    if any_hot:
        rows += count("windows", store, None)
    suffixes = np.sort(np.concatenate([np.zeros(0, f"S{WIDTH}"), *(np.frombuffer(r["suffixes"], f"S{WIDTH}") for r in rows)]))
    wanted = max(16, sum(r["runs"] for r in rows) * (WIDTH + 25) // RANGE_BYTES)
    ranges = min(wanted, MOST_RANGES)
    parts = -(-wanted // ranges)
    store.put("splitters", np.unique(suffixes[(np.arange(1, ranges) * len(suffixes)) // ranges]) if len(suffixes) else suffixes)
    sent = texts.mapInArrow(tidy(_send(store, buckets, any_hot, parts)), _RUNS_DDL).repartitionById(ranges * parts, F.col("bucket"))
    found = scratch.table("found", sent.groupBy("bucket").applyInArrow(tidy_group(_find_repeats), _FOUND))
    scratch.drop("arrays")
    _boundaries_differ(found, parts)
    return found.where("_doc IS NOT NULL").groupBy("_doc", "_t").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, merged = [], []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, whole, out, at = (text or "").encode(), [], [], 0
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if whole and s[0] <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], s[1])
                else:
                    whole.append(list(s))
            for a, b in whole:
                out.append(data[at:a])
                at = b
            kept.append(b"".join(out) + data[at:])
            merged.append([{"a": a, "b": b} for a, b in whole])
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(kept, pa.binary()), pa.array(merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["row", "kept", "spans"])


def cut_repeats(docs: DataFrame, kept: str = "kept", spans: str = "spans") -> DataFrame:
    """Each row with ``kept`` (its remaining bytes) and ``spans`` (merged runs of removed bytes, as offsets a to b)."""
    found = repeated_spans(docs)
    stay = [c for c in docs.columns if c.lower() not in (kept.lower(), spans.lower())]
    # Numbered names inside, so that other columns may be called anything.
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(stay)])
    keyed = docs.select(_key().alias("_doc"), F.xxhash64("text").alias("_t"), F.col("text").cast("string").alias("text"), row.alias("row"))
    joined = keyed.join(found, ["_doc", "_t"], "left").select("text", "_spans", "row")
    schema = joined.select("row", F.lit(b"").alias("kept"), F.col("_spans").alias("spans")).schema
    out = joined.mapInArrow(tidy(_cut), schema)
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(stay)], F.col("kept").alias(kept), F.col("spans").alias(spans))


SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
n AS (SELECT doc_id, t, octet_length(t) AS size FROM b),
w AS (SELECT doc_id, i, t[i:i + 99] AS s FROM (SELECT doc_id, t, unnest(range(1, size - 98)) AS i FROM n)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN f USING (s) WHERE (w.doc_id, w.i) > f.first),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
c AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
k AS (SELECT n.doc_id, n.t[coalesce(lag(c.z) OVER v, 1):c.a - 1] AS piece, c.a FROM n JOIN c USING (doc_id) WINDOW v AS (PARTITION BY n.doc_id ORDER BY c.a)
      UNION ALL SELECT n.doc_id, n.t[max(c.z):n.size], n.size + 1 FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, n.t, n.size),
h AS (SELECT doc_id, sha256(unhex(string_agg(hex(piece), '' ORDER BY a))) AS kept FROM k GROUP BY doc_id),
m AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id)
SELECT n.doc_id, n.size AS n_bytes, CAST(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(m.n_spans, 0) AS BIGINT) AS n_spans, coalesce(h.kept, sha256(n.t)) AS kept_sha256
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN h USING (doc_id)
"""
