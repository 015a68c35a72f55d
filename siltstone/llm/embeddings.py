"""Near-duplicate vectors by spherical-cap filters of structured random product codes.

Two vectors of one label and length are linked at a cosine of ``LEAST`` or more. A seeded rotation
turns unit vectors, which are cut into parts; a code has ``size`` random unit directions for each
part, and the filter directions are all their combinations: size ** parts of them, never listed. A
vector is in the caps of the directions whose products with it, sums of its parts' products, exceed its
height. List decoding finds them part by part, keeping the prefixes that can still be among them.
A vector's height is the one that ``LISTED`` directions exceed: a product code has dense and thin
spots, and under one height for all 28 to 50% of random vectors exceeded none (simulated, 64
dimensions). With its own height each vector has LISTED filters, and a pair at the least cosine shares 27 of
48 on average; in simulation 0 of 4000 pairs shared none (tests measure it again). The code grows with
the number of vectors, so that unlike ones share a filter about once each, at any size.

Vectors with equal components are one class. Classes that share a filter meet in blocks of a few
hundred vectors: a bucket of n members is dealt to parts by a hash and pairs of parts are compared by a matrix product,
so neither a task nor a row holds a whole bucket and no row stands for a pair. A pair that shares
several filters counts in the smallest alone. Blocks give numbers of links for each member and a forest of
links, from which components are worked out (``minhash.components``).

Work on a hot group of n vectors that differ but are all linked is n * n / 2 products: the number of links
of each is part of the result and each depends on all others. Exact copies cost nothing.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, a null label and a
null vec_id link with nothing (component: the own vec_id). Vectors of different lengths are not
linked. Rows of one vec_id are one vector where their components are equal, and linked where any is;
n_links counts vec_ids of each class. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.minhash import components
from siltstone.llm.worker import tidy
from siltstone.session import Scratch, ship, small_batches

LEAST = 0.98
#: Directions that exceed a vector's height.
LISTED = 48
#: Filter directions for each vector of the table, so that unlike vectors share a filter about once each.
FILTERS_A_VECTOR = 2048
#: Directions of one part; a larger code has more parts.
MOST_CODES = 1 << 14
#: Vectors of a bucket that are compared by one product.
BLOCK = 256
SEED = 20240611


class Code:
    """Directions of one vector length: a rotation, and ``size`` unit directions for each part."""

    def __init__(self, length: int, vectors: int, seed: int = SEED):
        rng = np.random.default_rng([seed, length])
        # Caps must stay wider than the angle of a link: in few dimensions fewer directions do.
        filters = min(FILTERS_A_VECTOR * max(vectors, 1), LISTED * 2.5 ** min(length - 1, 64))
        self.blocks = 1 if length < 8 else 2
        while self.blocks < length // 4 and filters ** (1 / self.blocks) > MOST_CODES:
            self.blocks += 1
        self.size = int(min(max(np.ceil(filters ** (1 / self.blocks)), LISTED), MOST_CODES))
        self.turn = np.linalg.qr(rng.standard_normal((length, length)))[0]
        self.cuts = np.linspace(0, length, self.blocks + 1).astype(int)
        self.parts = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            d = rng.standard_normal((self.size, b - a))
            self.parts.append(d / np.linalg.norm(d, axis=1, keepdims=True))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """For each row the LISTED directions with the greatest products, those that exceed its height.

        Among the best sums only codes among each part's best occur, so lists of LISTED prefixes suffice.
        """
        turned, sums, keys = unit @ self.turn, np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for a, b, codes in zip(self.cuts[:-1], self.cuts[1:], self.parts):
            products = turned[:, a:b] @ codes.T
            best = np.argpartition(-products, LISTED - 1, axis=1)[:, :LISTED] if self.size > LISTED else np.broadcast_to(np.arange(self.size), products.shape)
            every = (sums[:, :, None] + np.take_along_axis(products, best, 1)[:, None, :]).reshape(len(unit), -1)
            names = (keys[:, :, None] * self.size + best[:, None, :]).reshape(len(unit), -1)
            if every.shape[1] > LISTED:
                top = np.argpartition(-every, LISTED - 1, axis=1)[:, :LISTED]
                every, names = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)
            sums, keys = every, names
        return keys


@lru_cache(maxsize=4)
def code_of(length: int, vectors: int) -> Code:
    return Code(length, vectors)


def unit_of(values: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, scaled first so that squares neither overflow nor vanish."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


_UNIT = "vec_id long, label long, digest binary, unit array<double>"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of label and components and the unit vector of each row; both null where it links with nothing."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        offsets = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        fine = np.append(0, np.cumsum(np.isfinite(flat)))
        some = np.append(0, np.cumsum(flat != 0))
        a, b = offsets[:-1], offsets[1:]
        ok = (fine[b] - fine[a] == b - a) & (some[b] - some[a] > 0) & vectors.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        digests: list[bytes | None] = [None] * len(batch)
        units: list[np.ndarray | None] = [None] * len(batch)
        for n in np.unique(b[ok] - a[ok]):
            rows = np.flatnonzero(ok & (b - a == n))
            values = flat[a[rows][:, None] + np.arange(n)] + 0.0  # no negative zeros
            for i, label, v, u in zip(rows, labels.take(pa.array(rows)).to_pylist(), values, unit_of(values)):
                digests[i] = hashlib.blake2b(v.tobytes(), digest_size=16, person=label.to_bytes(8, "little", signed=True)).digest()
                units[i] = u
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "label", "digest", "unit"])


def _decoded(vectors: int):
    """The filters of each class: one row a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label, _, unit = batch.columns
            sizes = np.diff(unit.offsets.to_numpy())
            flat, offsets = unit.values.to_numpy(zero_copy_only=False), unit.offsets.to_numpy()
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for some in np.array_split(rows, -(-len(rows) // 256)):
                    keys = code_of(int(n), vectors).decode(flat[offsets[some][:, None] + np.arange(n)])
                    at = pa.array(np.repeat(some, keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([rep.take(at), label.take(at), pa.array(np.full(len(at), n, np.int32)), pa.array(keys.reshape(-1))], ["rep", "label", "length", "filter"])

    return run


def _forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its component) of a symmetric matrix of links."""
    n = len(ids)
    low = np.arange(n)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    either = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(either, low[None, :], n).min(axis=1)
        if (new == low).all():
            break
        low = new
    return [(int(ids[i]), int(ids[order[low[i]]])) for i in range(n) if low[i] != rank[i]]


def _links(ids: np.ndarray, parts: np.ndarray, pair: tuple[int, int], unit: np.ndarray, weight: np.ndarray, own: int, filters: list[np.ndarray], least: float):
    """Links within one pair of parts of a bucket that no smaller shared filter gives: (ids, numbers of links, edges)."""
    cos = unit @ unit.T
    linked = cos >= least
    np.fill_diagonal(linked, False)
    if pair[0] != pair[1]:
        linked &= parts[:, None] != parts[None, :]
    if not linked.any():
        return None
    used = np.flatnonzero(linked.any(axis=1))
    linked, ids, weight = linked[np.ix_(used, used)], ids[used], weight[used]
    # Filters below this bucket's that two members have: such pairs are counted there.
    earlier = [filters[i][filters[i] < own] for i in used]
    every, where, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True) if earlier else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    shared = np.flatnonzero(times > 1)
    if len(shared):
        place = np.full(len(every), -1)
        place[shared] = np.arange(len(shared))
        has = np.zeros((len(used), len(shared)), np.float32)
        row = np.repeat(np.arange(len(used)), [len(e) for e in earlier])
        at = place[where]
        has[row[at >= 0], at[at >= 0]] = 1
        linked &= (has @ has.T) == 0
    return ids, linked @ weight, _forest(linked, ids)


_FOUND = "rep long, links long, other long"


def _compared(least: float):
    """Counts (rep, links) and edges (rep, other) of members that are sorted by bucket and pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[int, int] = defaultdict(int)
        edges: set[tuple[int, int]] = set()
        left: pa.Table | None = None

        def group(rows: pa.Table) -> None:
            columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
            ids = columns["rep"].to_numpy()
            if len(ids) < 2:
                return
            unit = columns["unit"].flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            filters = [np.array(f, np.int64) for f in columns["filters"].to_pylist()]
            pair = int(columns["i"][0].as_py()), int(columns["j"][0].as_py())
            found = _links(ids, columns["part"].to_numpy(), pair, unit, columns["n"].to_numpy().astype(np.int64), int(columns["filter"][0].as_py()), filters, least)
            if found:
                for r, k in zip(found[0].tolist(), found[1].tolist()):
                    links[r] += k
                edges.update(found[2])

        def rows() -> pa.RecordBatch:
            counted, joined = [(r, k, None) for r, k in links.items() if k], [(a, 0, b) for a, b in edges]
            links.clear()
            edges.clear()
            columns = list(zip(*counted, *joined)) if counted or joined else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "other"])

        def ends(table: pa.Table) -> np.ndarray:
            keys = np.stack([table.column(c).to_numpy() for c in ("label", "length", "filter", "i", "j")])
            return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None and len(left):
                table = pa.concat_tables([left, table])
            if not len(table):
                continue
            cuts = [0, *ends(table).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:]):
                group(table.slice(a, b - a))
            left = table.slice(cuts[-1])
            if len(links) + len(edges) > 200_000:
                yield rows()
        if left is not None and len(left):
            group(left)
        yield rows()

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "caps")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = scratch.table("read", rows.mapInArrow(tidy(_digested), _UNIT))
    known = read.where("digest IS NOT NULL")
    # Combined by (class, vec_id) first: repeated rows count once, and a hot class is a few rows a task.
    classes = scratch.table("classes", known.groupBy("digest", "vec_id").agg(F.first("label").alias("label")).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    classed = read.select("vec_id", "label", "digest", "unit").join(classes, "digest", "left")
    reps = scratch.table("reps", classed.where("digest IS NOT NULL AND (rep IS NULL OR rep = vec_id)").groupBy(F.col("vec_id").alias("rep"), "digest").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.first(F.coalesce("n", F.lit(1))).cast("long").alias("n")))
    count = reps.count()
    decoded = scratch.table("decoded", reps.select("rep", "label", "n", "unit").mapInArrow(tidy(_decoded(count)), "rep long, label long, length int, filter long"))
    buckets = decoded.groupBy("label", "length", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.table("members", decoded.join(buckets, ["label", "length", "filter"]))
    # All shared filters of a member go with it, so that a pair is counted in the smallest one.
    filters = members.groupBy("rep", "length").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    parts = F.expr(f"greatest(1, (size + {BLOCK - 1}) div {BLOCK})")
    dealt = members.withColumn("parts", parts).withColumn("part", F.expr("pmod(xxhash64(rep), parts)")).drop("size")
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rep", "label", "length", "filter", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    full = pairs.join(filters, ["rep", "length"]).join(reps.select("rep", F.size("unit").alias("length"), "unit", "n"), ["rep", "length"])
    keys = ["label", "length", "filter", "i", "j"]
    sorted_pairs = full.select(*keys, "part", "rep", "n", "unit", "filters").repartition(*keys).sortWithinPartitions(*keys)
    found = scratch.table("found", sorted_pairs.mapInArrow(tidy(_compared(least)), _FOUND))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    comps = components(edges, scratch, "components").select(F.col("node").alias("rep"), "comp")
    nodes = reps.select("rep").distinct().join(links, "rep", "left").join(comps, "rep", "left").withColumnRenamed("rep", "node")
    own = F.when(F.col("digest").isNotNull(), F.coalesce("rep", "vec_id"))
    out = read.select("vec_id", "digest").join(classes, "digest", "left").withColumn("node", own).join(nodes, "node", "left")
    comp = F.coalesce("comp", "node", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS start, vec_id AS node FROM embeddings UNION SELECT r.start, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT start, min(node) AS component_id FROM r GROUP BY start), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept FROM embeddings JOIN c ON c.start = vec_id LEFT JOIN n ON n.a = vec_id
"""
