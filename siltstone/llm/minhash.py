"""Near-duplicate groups by one-permutation MinHash with optimal densification, exact at the links.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); two documents are
linked at a Jaccard similarity of t = ``percent`` / 100. op7 takes three words and 0.85, the defaults.
One hash of each shingle gives its bin (top bits) and its rank; an empty bin copies the bin that a
fixed random sequence names first among the filled ones (optimal densification). The ``BINS`` values
make bands of as many rows as ``percent`` allows (``rows_of``); documents that share a band are
candidates. At a similarity of 0.85 a pair shares none of 42 bands of six with a chance of about
2e-9, and at 0.8 none of 50 bands of five with the same.

Documents of one set form a class, and its smallest doc_id stands for it. In a bucket of over
``DIRECT`` representatives that are not known to be connected, edges form a star: from the one with
the smallest set (the centre C; ties by doc_id) to each other one. In others those few are compared
with all. Both are linear in the bucket's size. Before that, a round of stars from each bucket's
smallest doc_id connects what it can: few centres serve all bands of a group. Edges are confirmed on the full sets
(64-bit hashes of shingles, from words' BLAKE2b under a key drawn for each run, which no text can be made to meet), and confirmed links give components. A star may miss a link between two of its leaves A and B, where not
both are connected to C. Say A is not linked to it. Linked sets share |A & B| >= t / (1 + t) (|A| + |B|),
A and C share less than t / (1 + t) (|A| + |C|), and |C| <= |B|: so A and B share elements that C does not
hold. Therefore leaves go on in new buckets, one for each element that they have beyond C, rarest
first and only as many as these bounds leave (prefix filter). Copies that were filled in or edited
independently share no such element, and the bucket ends; near copies of another text share one,
meet in one bucket and are linked to its centre.

Band buckets serve the first round alone. Those that then still hold several components join documents to
groups. A group of ``GROUP_BLOCKS`` blocks at most has all its sets compared, by two blocks a task's step: what is left of texts
that were cut or edited is alike without being linked, so that no filter parts it, and stars took a round for each few
of it. In larger groups each document is dealt out once: by the first of its elements in an order that holds for its group,
those of one component before those of several, then the rarest (prefix filter). Linked sets share one of these;
texts of one form, each filled in for itself, do not. Stars and element buckets go on from these buckets.

Components are worked out after each round, and every new bucket is compared in the same way, with a
later centre, until no bucket holds leaves that are not known to be connected. n near copies of one text cost pairs with
one of them in each bucket, not all their pairs. No link between two documents that share a band is
lost but by the chance above.

Cases: text null, or without words: n_shingles 0, linked with nothing. Fewer words than
``width``: one shingle, the whole sequence. A null doc_id is linked with nothing and has a null component_id;
rows of one doc_id are one document, linked where any of its texts is. Columns other than doc_id
and text are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.words import joined, lowered, mix, new_key, raw, slices, word_hashes, word_ranges
from siltstone.llm.worker import tidy
from siltstone.session import Scratch, ship, small_batches

BINS = 252
#: The greatest chance that a pair at the least similarity shares no band.
MISSED = 1e-8
SHINGLE = 3
PERCENT = 85
_TRIES = np.random.default_rng(8).integers(0, BINS, (4096, BINS))
_SALT = np.random.default_rng(9).integers(1, 1 << 63, BINS, dtype=np.uint64)
_EMPTY = np.uint64((1 << 64) - 1)


def rows_of(percent: int) -> int:
    """Rows of a band: the most with which a pair of this similarity shares no band with a chance of MISSED at most."""
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    return max(r for r in range(1, BINS) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED)


def shingle_sets(arr: pa.Array, key: bytes, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, under a key of ``words.new_key``."""
    data, bounds = raw(arr)
    data = lowered(data)
    starts, ends, of = word_ranges(data, bounds)
    words = word_hashes(data, starts, ends, key)
    runs = words
    for k in range(1, width):
        runs = joined(runs[: len(words) - k], words[k:]) if len(words) > k else runs[:0]
    out = []
    for a, b in zip(of[:-1], of[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = joined(h, w)
            out.append(h)
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values each, densified; sets must not be empty."""
    sig = np.full((len(sets), BINS), _EMPTY, np.uint64)
    for row, s in zip(sig, sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.append(0, np.flatnonzero(bins[1:] != bins[:-1]) + 1)
        row[bins[first]] = s[first]  # the smallest hash of each bin: the set is sorted
    filled = sig != _EMPTY
    row, at = np.nonzero(~filled)
    for tries in _TRIES:
        if not len(row):
            break
        source = tries[at]
        ok = filled[row, source]
        sig[row[ok], at[ok]] = sig[row[ok], source[ok]]
        row, at = row[~ok], at[~ok]
    for r, a in zip(row, at):
        sig[r, a] = sig[r][filled[r]][0]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = BINS // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(_SALT[:bands], (len(sig), bands)).copy()
    for r in range(rows):
        key = joined(key, parts[:, :, r])
    return key.astype(np.int64)


#: Documents and elements of a block of a group; groups of so many blocks are compared whole.
BLOCK_DOCS, BLOCK_ELEMENTS, GROUP_BLOCKS = 1024, 1 << 20, 64
#: An element that so many sets hold is counted by products of matrices, so many elements at a time.
COMMON, COLUMNS = 16, 2048

_SKETCH = "doc_id long, n long, s long, x long, bands array<long>"
#: Into so many parts the leaves of one centre are dealt where they meet what is known of it.
SALT = 16
#: So many members of a bucket that are not known to be connected to the rest are compared with all of it at once.
DIRECT = 8
#: Bits of the map that tells which documents may be candidates; its size is fixed, a full one only filters less.
MAP_BITS = 1 << 23


def _sketch(width: int, rows: int, key: bytes):
    """A sketch of each document."""
    n_bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                sets = shingle_sets(part, key, width)
                n = np.array([len(s) for s in sets], np.int64)
                total = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                folded = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
                sig = signatures([s for s in sets if len(s)])
                offsets = np.append(0, np.cumsum(np.where(n > 0, n_bands, 0))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(sig, rows).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n), pa.array(total), pa.array(folded), bands], ["doc_id", "n", "s", "x", "bands"])

    return run


def _place(doc_ids: np.ndarray) -> np.ndarray:
    """Bit of each document in the candidates' map."""
    return (mix(doc_ids.astype(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(1 + _place(batch.column(0).to_numpy()))], ["bit"])


def _candidate_map(candidates: DataFrame) -> np.ndarray:
    """MAP_BITS bits, built as bitmaps of 4 KB in Spark: a fixed number of rows reaches the driver."""
    bits = candidates.mapInArrow(tidy(_places), "bit long")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    whole = np.zeros(MAP_BITS, bool)
    for r in parts:
        own = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little")
        # Bits count from 1, so that bucket n holds places from 32768 * (n - 1) on.
        at = (r["bucket"] - 1) * 32768
        whole[at : at + len(own)] |= own.astype(bool)
    return np.packbits(whole)


def _sets(packed: np.ndarray, width: int, key: bytes):
    """Sets of the documents that the candidates' map may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(wanted[_place(ids)]))
            for at, part in slices(kept.column(1)):
                sets = shingle_sets(part, key, width)
                own = kept.column(0).slice(at, len(part))
                offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                total = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                name = joined(mix(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)), total).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own, pa.array(name), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "name", "n", "hashes"])

    return run


#: Edges that one task contracts in memory (some tens of MB).
CONTRACTED = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (a, b) do, shortest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > 2 * CONTRACTED:  # files are dealt whole, so a task may get more
            x, y = contracted(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
            if len(x) > CONTRACTED:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                a, b = [x[:0]], [y[:0]]
    x, y = contracted(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp (its smallest reachable node) of every node of the edges (a, b).

    Tasks of up to CONTRACTED edges contract theirs to stars. Where that takes one task all is done;
    else alternating stars go on across tasks: a round replaces edges by shorter ones towards smaller
    nodes; a node's neighbours are never gathered, only their minimum. Every round is written to the shared folder.
    """
    ship(edges.sparkSession)
    plain = scratch.table(f"{name}-edges", edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    tasks = -(-plain.count() // CONTRACTED)
    now = scratch.table(f"{name}-0", plain.coalesce(max(1, tasks)).mapInArrow(tidy(_contract), "a long, b long"))
    scratch.drop(f"{name}-edges")
    seen = None
    for step in count(1) if tasks > 1 else ():
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        new = scratch.table(f"{name}-{step}", small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{step - 1}")
        now, last, seen = new, seen, state
        if state == last or not state[0]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b"), F.col("b")).distinct())


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets, of what they share, and both sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    full = left.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    return full.withColumns({"na": F.size("ha"), "nb": F.size("hb"), "both": F.size(F.array_intersect("ha", "hb"))})


def _merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, comp) after those of their representatives, ``more``, are known."""
    later = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    known = comps.join(later, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return known.union(more.join(comps.select("node"), "node", "left_anti").select("node", "comp"))


def _like_sizes(n1: str, n2: str, percent: int) -> str:
    """Whether two sets of these sizes can be linked at all."""
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, star) of each bucket's smallest doc_id with its others: few centres serve all bands of a group."""
    first = members.groupBy("band").agg(F.min(F.struct("doc_id", F.col("n").alias("na"))).alias("first"))
    met = _salted(members, first, ["doc_id", "n"]).select("first.*", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    return met.where(f"doc_id <> b AND {_like_sizes('na', 'nb', percent)}").select(F.col("doc_id").alias("a"), "b").distinct().withColumn("star", F.lit(False))


def _salted(members: DataFrame, per_band: DataFrame, kept: list[str]) -> DataFrame:
    """Members with what is known of their band; a band's members are dealt to ``SALT`` parts."""
    dealt = members.select("band", *kept, F.expr(f"pmod(hash(doc_id), {SALT})").alias("salt"))
    return dealt.join(per_band.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["band", "salt"])


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, star) to compare of all buckets (band, doc_id, n, rest, root), linear in each bucket's size.

    ``root`` is a document that a member is known to be connected to. ``rest`` is the most elements that a member
    can share with another of the bucket. Members beside the bucket's most frequent root are compared with all of
    other roots with which they can be linked, where they are ``DIRECT`` at most; where
    they are more, all are compared with the member of the smallest set, which is ``a`` (``star``).
    """
    sized = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", "doc_id")).alias("least"))
    stats = sized.groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), F.min("least").alias("least"))
    stats = stats.select("band", F.col("most.root").alias("major"), (F.col("all") - F.col("most.c")).alias("others"), F.col("least.doc_id").alias("a")).where("others > 0")
    known = _salted(members, stats, ["doc_id", "n", "rest", "root"])
    few, many = known.where(F.col("others") <= DIRECT), known.where(F.col("others") > DIRECT)
    one = few.where("root <> major").select("band", F.col("doc_id").alias("d1"), F.col("n").alias("n1"), F.col("rest").alias("s1"), F.col("root").alias("r1"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    two = few.select("band", "salt", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("rest").alias("s2"), F.col("root").alias("r2"), "major")
    fit = f"{_like_sizes('n1', 'n2', percent)} AND {100 + percent} * least(s1, s2) >= {percent} * (n1 + n2)"
    direct = one.join(two, ["band", "salt"]).where(f"r1 <> r2 AND (r2 = major OR d1 < d2) AND {fit}").select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b"), F.lit(False).alias("star"))
    star = many.where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(True).alias("star"))
    return direct.union(star).groupBy("a", "b").agg(F.bool_or("star").alias("star"))


def _edges(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with na, nb, both, linked, and for stars ``own``: what the leaf has beyond the centre."""
    exact = _compared(pairs, sets).withColumn("linked", F.expr(f"100 * both >= {percent} * (na + nb - both)"))
    return exact.select("a", "b", "star", "na", "nb", "both", "linked", F.when(F.col("star"), F.array_except("hb", "ha")).alias("own"))


def _element_buckets(edges: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, band: leaves of one star, not all connected to its centre, that share a rare element beyond it.

    ``edges`` of stars with ra and rb, the roots of centre and leaf. A leaf's home is its smallest
    centre. Two leaves of one home meet there alone; a centre brings leaves of different homes together besides.
    """
    every = edges.withColumn("joined", F.col("linked") | (F.col("ra") == F.col("rb"))).withColumn("home", F.min("a").over(Window.partitionBy("b")))
    housed = every.where("size(own) > 0").withColumn("salt", F.expr(f"pmod(hash(b), {SALT})"))
    groups = housed.groupBy("a").agg(F.bool_or(~F.col("joined")).alias("open"), F.count(F.lit(1)).alias("leaves"), F.min("home").alias("h1"), F.max("home").alias("h2")).where("open AND leaves > 1")
    salted = groups.select("a", (F.col("h1") < F.col("h2")).alias("many"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = housed.join(salted, ["a", "salt"]).where("many OR a = home").select("a", "b", "rb", "joined", "na", "nb", "both", F.size("own").alias("x"), F.explode("own").alias("e"))
    rare = rows.groupBy("a", "e").agg(F.count(F.lit(1)).alias("often"), F.bool_or(~F.col("joined")).alias("open"), F.min("rb").alias("r1"), F.max("rb").alias("r2"))
    # An element that only one leaf has joins nothing, but takes a place in the order: the rarest come first.
    shared = rows.join(rare.where("often > 1"), ["a", "e"])
    by = Window.partitionBy("a", "b")
    placed = shared.withColumn("place", F.col("x") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("often", "e")))
    # The least number of elements beyond the centre that two linked leaves share: by this one's size and what it
    # shares with the centre; and, if it is connected to the centre, by its partner, which is not.
    least = f"greatest(1, ({percent} * (nb + greatest(na, ({percent} * nb + 99) div 100)) + {99 + percent}) div {100 + percent} - both)"
    least = f"CASE WHEN joined THEN greatest({least}, {percent} * (nb - na) div {100 + percent} + 1) ELSE {least} END"
    fit = placed.where(F.expr(f"open AND r1 < r2 AND place <= x - {least} + 1"))
    return fit.select(F.col("b").alias("doc_id"), F.col("nb").alias("n"), F.col("nb").alias("rest"), F.xxhash64("a", "e").alias("band"))


def linked_sets(sets: list[np.ndarray], left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all sets that are linked; with ``left``, of those before it with those from it on."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    elements, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(elements, kind="stable")
    elements, rows = elements[order], rows[order]
    often = np.diff(np.append(np.flatnonzero(np.append(True, elements[1:] != elements[:-1])), len(elements)))
    column, often = np.repeat(np.arange(len(often)), often), np.repeat(often, often)
    both = np.zeros((n, n), np.float32)
    common = often >= COMMON
    _, place = np.unique(column[common], return_inverse=True)
    for first in range(0, int(place.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(place, [first, first + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[rows[common][a:b], place[a:b] - first] = 1
        both[: left or n, left:] += held[: left or n] @ held[left:].T
    few = ~common & (often > 1)
    rows, column = rows[few], column[few]
    for apart in range(1, min(COMMON, len(column))):
        same = np.flatnonzero(column[apart:] == column[: len(column) - apart])
        np.add.at(both, (rows[same], rows[same + apart]), 1)
    found = []
    for first in range(0, left or n, 256):
        shared = both[first : min(first + 256, left or n)].astype(np.int64)
        i, j = np.nonzero((100 + percent) * shared >= percent * (sizes[first : first + len(shared), None] + sizes[None]))
        found.append(np.stack([i + first, j]))
    i, j = np.concatenate(found, axis=1)
    ok = (i < j) & (j >= left)
    return i[ok], j[ok]


def _linked_roots(percent: int):
    """Edges that connect the roots of linked sets: rows (comp, i, j, block, root, hashes) come sorted by comp, i and j."""

    def links(key, block: list[int], root: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        order = np.argsort(np.array(block), kind="stable")
        roots = np.array(root, np.int64)[order]
        if (roots == roots[0]).all():
            return None
        left = block.count(key[1]) if key[1] != key[2] else 0
        if key[1] != key[2] and left in (0, len(block)):
            return None
        i, j = linked_sets([sets[k] for k in order], left, percent)
        apart = roots[i] != roots[j]
        if not apart.any():
            return None
        x, y = contracted(roots[i[apart]], roots[j[apart]])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, root, sets = None, [], [], []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            hashes = batch.column(5)
            flat, offsets = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if tuple(keys[a]) != now:
                    if now and (out := links(now, block, root, sets)):
                        yield out
                    now, block, root, sets = tuple(keys[a]), [], [], []
                block += batch.column(3).slice(a, b - a).to_pylist()
                root += batch.column(4).slice(a, b - a).to_pylist()
                sets += [flat[offsets[k] : offsets[k + 1]].copy() for k in range(a, b)]
        if now and (out := links(now, block, root, sets)):
            yield out

    return run


def _group_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between roots of each group (``comp`` of the open members) by all its sets, a block of it with another at a time."""
    block = F.expr("pmod(xxhash64(doc_id), blocks)").cast("int")
    every = sets.select("doc_id", "hashes").join(opened, "doc_id").select("comp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "root", "hashes")
    dealt = every.select("comp", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "root", "hashes")
    keys = ["comp", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_linked_roots(percent)), "a long, b long")


def _blocks(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Open members with the number of blocks of their group."""
    per = sets.select("doc_id", "n").join(opened, "doc_id").groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("e"))
    blocks = per.select(F.col("comp").alias("band"), F.expr(f"CAST(greatest((c + {BLOCK_DOCS - 1}) div {BLOCK_DOCS}, (e + {BLOCK_ELEMENTS - 1}) div {BLOCK_ELEMENTS}, 1) AS INT)").alias("blocks"))
    return _salted(opened.withColumnRenamed("comp", "band"), blocks, ["doc_id", "root"]).select("doc_id", "root", F.col("band").alias("comp"), "blocks")


def _open_members(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, root, comp: documents of band buckets (band, doc_id, root) that hold several roots; comp: smallest document reachable by such buckets."""
    spans = buckets.groupBy("band").agg(F.min("doc_id").alias("first"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    met = scratch.table("met", _salted(buckets, spans.select("band", "first"), ["doc_id", "root"]).select("doc_id", "root", "first").distinct())
    groups = components(met.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), scratch, "groups")
    return scratch.table("open", met.select("doc_id", "root").distinct().join(groups.withColumnRenamed("node", "doc_id"), "doc_id"))


def _prefix_buckets(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, rest, band: documents of one group (``comp`` of the open members) that share one of their first elements.

    One order of elements holds for the whole group: those with which no two roots meet, then the rarest. Linked sets
    share t / (1 + t) of their sizes' sum, so among the first of the smaller set that leave fewer than that many (``short``)
    there is a shared one, and among the first of the larger one that leave fewer than t of it (``long``). Each set is
    dealt out once, whatever number of buckets it was in; texts of one form, filled in each for itself, share no such element.
    """
    named = sets.join(opened, "doc_id")
    rows = named.select("name", "root", "comp", F.explode("hashes").alias("e")).select("name", "root", F.xxhash64("comp", "e").alias("band"))
    of = Window.partitionBy("band")
    meeting = rows.select("name", "band", F.count(F.lit(1)).over(of).alias("often"), F.min("root").over(of).alias("r1"), F.max("root").over(of).alias("r2")).where("r1 < r2").select("name", "band", "often")
    by = Window.partitionBy("name")
    ranked = meeting.select("name", "band", F.count(F.lit(1)).over(by).alias("m"), F.row_number().over(by.orderBy("often", "band")).alias("r"))
    placed = ranked.join(named.select("name", "doc_id", "n", "root"), "name").withColumn("rest", F.expr("m - r + 1"))
    fit = placed.where(f"100 * rest >= {percent} * n").withColumn("short", F.expr(f"{100 + percent} * rest >= {2 * percent} * n"))
    spans = fit.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.when(F.col("short"), F.col("n"))).alias("least")).where("r1 < r2 AND least IS NOT NULL").select("band", "least")
    # A larger set needs a smaller one that it can still share enough with.
    return fit.join(spans, "band").where(f"short OR {100 + percent} * rest >= {percent} * (n + least)").select("doc_id", "n", "rest", "band")


def group_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest doc_id of each component) for every row.

    Texts are linked that share ``percent`` of their shingles of ``width`` words, at least.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    scratch, key = Scratch(spark, "minhash"), new_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.table("sketch", rows.mapInArrow(tidy(_sketch(width, rows_of(percent), key)), _SKETCH))
    known = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.table("classes", known.groupBy("s", "x", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("s", "x", "n", "rep"))
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    classed = sketch.join(classes, ["s", "x", "n"], "left").select("doc_id", "n", rep.alias("rep"))
    # A bucket is a band key that two representatives share; keys are aggregated, then joined back.
    slim = known.join(classes, ["s", "x", "n"], "left").where("rep IS NULL OR rep = doc_id")
    banded = slim.select("doc_id", F.explode("bands").alias("band"), "n")
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")).where("d1 < d2").select("band")
    once = banded.join(shared, "band").groupBy("doc_id", "band").agg(F.min("n").alias("n"))  # rows of one doc_id are one document
    buckets = scratch.table("buckets-0", once.select("doc_id", "n", "band", F.col("doc_id").alias("root")))
    candidates = scratch.table("candidates", buckets.select("doc_id").distinct())
    found_sets = rows.mapInArrow(tidy(_sets(_candidate_map(candidates), width, key)), "doc_id long, name long, n int, hashes array<long>")
    sets = scratch.table("sets", found_sets.join(candidates, "doc_id", "left_semi"))
    comps = spark.createDataFrame([], "node long, comp long")
    root = lambda df, node, name: df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    turn = 0
    while True:
        pairs = _pairs(buckets, percent) if turn else _first_pairs(buckets, percent)
        needed = sets
        if turn:  # few are left: only their sets move
            pairs = scratch.table(f"pairs-{turn}", pairs)
            needed = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
        edges = scratch.table(f"edges-{turn}", _edges(pairs, needed, percent))
        new = root(root(edges.where("linked").select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        if not new.isEmpty():
            found = components(new, scratch, f"components-{turn}")
            comps = scratch.table(f"connected-{turn}", _merged(comps, found) if turn else found)
        stars = edges.where("star")
        if turn and stars.isEmpty():
            break
        if turn:
            members = _element_buckets(root(root(stars, "a", "ra"), "b", "rb"), percent)
        else:
            opened = scratch.table("blocks", _blocks(_open_members(root(buckets.drop("root"), "doc_id", "root"), scratch), sets))
            near = scratch.table("near", _group_links(opened.where(F.col("blocks") <= GROUP_BLOCKS), sets, percent))
            if not near.isEmpty():
                comps = scratch.table("connected-near", _merged(comps, components(near, scratch, "components-near")))
            large = opened.where(F.col("blocks") > GROUP_BLOCKS)
            if large.isEmpty():
                break
            members = _prefix_buckets(large.drop("blocks"), sets, percent)
        following = scratch.table(f"buckets-{turn + 1}", root(members, "doc_id", "root"))
        scratch.drop(f"buckets-{turn}")
        scratch.drop(f"edges-{turn}")
        scratch.drop(f"pairs-{turn}")
        buckets, turn = following, turn + 1
    found = classed.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    for name in ("candidates", "sets", "met", "open", "blocks", "near", f"buckets-{turn}", f"pairs-{turn}", f"edges-{turn}"):
        scratch.drop(name)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("comp", "rep"), F.lit(True)).alias("kept")
    )


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM e),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, u.b FROM r JOIN u ON u.a = r.node),
c AS (SELECT start, min(node) AS component_id FROM r GROUP BY start)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, documents.doc_id = c.component_id AS kept
FROM documents JOIN c ON c.start = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
