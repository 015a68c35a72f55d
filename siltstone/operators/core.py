"""Building blocks of the queries: ordered dedupe, rankings, budgets, range and band joins, set differences.

Where order matters a column gives it explicitly; ``ord`` by default. Every ranking has a total order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.schemas import CONFIDENCES, SEVERITIES, rank
from siltstone.session import Scratch, fresh_name, ship, small_batches


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str] = ("ord",)) -> DataFrame:
    """One row a key, the first by order. A group-wise minimum: combined before the shuffle, no sort of a key's rows."""
    by = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)])
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(*named, by.alias("_by"), row.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_by").alias("_row")).select("_row.*")


def latest_wins(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key, the one with the greatest ``at``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(at)).alias("_row")).select("_row.*")


def count_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def count_over(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Counts over a fixed list of keys; those without rows count 0."""
    fixed = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(wanted)], f"{key} string, place int")
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(found, key, "left").select(key, "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def examples(df: DataFrame, keys: list[str], example: Column, most: int = 3, order: str = "ord") -> DataFrame:
    """keys, n, first_order and the first ``most`` examples of each group.

    Only each group's first rows are gathered: ranks come from a window whose limit Spark pushes
    below the shuffle (WindowGroupLimit), the count from a separate aggregate.
    """
    ranked = df.select(*keys, F.col(order).alias("_o"), example.alias("_e")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).where(F.col("_r") <= most)
    few = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_e"))), lambda s: s["_e"]).alias("examples"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_order"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return counts.alias("c").join(few.alias("f"), condition).select("c.*", "f.examples")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def breadth_first(df: DataFrame, key: Column, order: list[tuple[str, bool]], most: int | None = None) -> DataFrame:
    """Rows by order ((column, descending) pairs), then breadth first: every group's first, every group's second, ...

    Groups go by their best row. With a limit no group can place more than ``most`` rows, so each
    is cut to that before the final sort.
    """
    keyed = df.withColumn("_key", key)
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_key").orderBy(*sort)))
    if most is not None:
        ranked = ranked.where(F.col("_in") <= most)
    whole = Window.partitionBy("_key").orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.select("*", *[F.first(c).over(whole).alias(f"_h{i}") for i, (c, _) in enumerate(order)])
    out = ranked.orderBy("_in", *[F.col(f"_h{i}").desc() if down else F.col(f"_h{i}").asc() for i, (_, down) in enumerate(order)])
    out = out.limit(most) if most is not None else out
    return out.drop("_key", "_in", *[f"_h{i}" for i in range(len(order))])


def in_order(df: DataFrame, order: list[Column | str], amount: Column) -> DataFrame:
    """The rows with ``_n`` (place from 0) and ``_before`` (sum of the amount before the row), over the whole table.

    Rows are sorted by ranges and written; sums of the ranges before are added to those within one,
    so that no task orders the whole table.
    """
    part, key, worth, rows_ahead, sum_ahead = (fresh_name(df, n) for n in ("part", "key", "worth", "rows_ahead", "sum_ahead"))
    ranked = df.withColumn(worth, F.coalesce(amount.cast("long"), F.lit(0))).orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(key, F.monotonically_increasing_id())
    rows = Scratch(df.sparkSession, "order").table("rows", ranked)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = rows.groupBy(part).agg(F.count(F.lit(1)).alias("c"), F.sum(worth).alias("s"))
    ahead = totals.select(part, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias(rows_ahead), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias(sum_ahead))
    own = Window.partitionBy(part).orderBy(key)
    before = F.coalesce(F.sum(worth).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(ahead, part).withColumn("_n", F.col(rows_ahead) + F.row_number().over(own) - 1).withColumn("_before", F.col(sum_ahead) + before)
    return placed.select(*[c for c in df.columns if c not in ("_n", "_before")], "_n", "_before")


def running_budget(df: DataFrame, size: str, budget: int, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Adds ``used`` (before the row) and ``taken``: what of its size fits the budget in order; rows without any go."""
    if keys:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        used = df.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0)))
    else:
        used = in_order(df, order, F.col(size)).select(*[c for c in df.columns if c != "used"], F.col("_before").alias("used"))
    return used.withColumn("taken", F.least(F.col(size), F.greatest(F.lit(budget) - F.col("used"), F.lit(0)))).where("taken > 0")


def until_enough(df: DataFrame, active: Column, target: int, batch: int, order: list[str]) -> DataFrame:
    """Whole batches in order, up to the one with which ``target`` active rows are reached."""
    place = in_order(df, order, active.cast("int")).withColumn("batch", F.floor(F.col("_n") / batch))
    done = place.groupBy("batch").agg(F.min("_before").alias("_b")).where(F.col("_b") < target)
    return place.join(done.select("batch"), "batch", "left_semi").drop("_n", "_before")


def range_semi(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str = "start_line", high: str = "end_line", anti: bool = False) -> DataFrame:
    """Points that lie in some range of their key (or in none, with ``anti``; there also points without key or place).

    A sweep: along a key's starts and points, a point lies in a range if the furthest end of those begun
    so far reaches it. One shuffle and one sort; no point meets a range.
    """
    place, kind, end, known, row = (fresh_name(points, n) for n in ("place", "kind", "end", "known", "row"))
    whole = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(F.col(key).alias(known), F.col(at).alias(place), F.lit(1).alias(kind), F.lit(None).alias(end), whole.alias(row))
    usable = p.where(F.col(known).isNotNull() & F.col(place).isNotNull())
    r = ranges.where(f"`{key}` IS NOT NULL AND `{low}` <= `{high}`").groupBy(F.col(key).alias(known), F.col(low).alias(place)).agg(F.max(high).alias(end))
    both = usable.drop(end).unionByName(r.withColumn(kind, F.lit(0)), allowMissingColumns=True)
    reach = F.max(end).over(Window.partitionBy(known).orderBy(place, kind).rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(F.col(end) >= F.col(place), F.lit(False))
    found = both.withColumn(end, reach).where(F.col(kind) == 1).where(~inside if anti else inside).select(row)
    if anti:
        found = found.unionByName(p.where(F.col(known).isNull() | F.col(place).isNull()).select(row))
    return found.select(f"{row}.*")


def _sweep():
    """First open range of each point, of rows sorted by key, place and kind (0: a range's start, 1: a point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = object()
        opened: list[tuple] = []
        count = 0
        for batch in batches:
            hits: list[Any] = []
            columns = {n: batch.column(n) for n in batch.schema.names}
            points = columns["kind"].to_pylist()
            for k, at, point, end, order, hit in zip(columns["key"].to_pylist(), columns["place"].to_pylist(), points, columns["end"].to_pylist(), columns["order"].to_pylist(), columns["hit"]):
                if k != key:
                    key, opened = k, []
                if not point:
                    # The first by order is on top; a range that has ended goes when it comes up.
                    count += 1
                    heapq.heappush(opened, (order is None, order if order is not None else 0, count, end, hit))
                    continue
                while opened and opened[0][3] < at:
                    heapq.heappop(opened)
                hits.append(opened[0][4].as_py() if opened else None)
            rows = columns["row"].filter(pa.array([p == 1 for p in points], pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(hits, columns["hit"].type)], ["row", "hit"])

    return run


def range_first(points: DataFrame, ranges: DataFrame, key: str, at: str, order: str, low: str = "start_line", high: str = "end_line") -> DataFrame:
    """Each point with the first range of its key that holds it (columns of the range as struct ``hit``, null for none).

    A sweep over starts and points sorted by key and place, with the open ranges of one key as a heap: time is
    that of sorting, whatever number of points and ranges a key has, and any type of column passes through.
    """
    spark = points.sparkSession
    ship(spark)
    small_batches(spark)
    whole, hit = F.struct(*[F.col(c) for c in points.columns]), F.struct(*[F.col(c) for c in ranges.columns])
    p = points.select(F.col(key).alias("key"), F.col(at).alias("place"), F.lit(1).alias("kind"), whole.alias("row"))
    r = ranges.where(f"`{key}` IS NOT NULL AND `{low}` <= `{high}`").select(F.col(key).alias("key"), F.col(low).alias("place"), F.lit(0).alias("kind"), F.col(high).alias("end"), F.col(order).alias("order"), hit.alias("hit"))
    usable = F.col("key").isNotNull() & F.col("place").isNotNull()
    both = p.where(usable).unionByName(r, allowMissingColumns=True).select("key", "place", "kind", "end", "order", "hit", "row")
    out = T.StructType([both.schema["row"], both.schema["hit"]])
    swept = both.repartition("key").sortWithinPartitions("key", "place", "kind", F.col("order").asc_nulls_last(), "end").mapInArrow(_sweep(), out)
    rest = p.where(~usable).select("row", F.lit(None).cast(both.schema["hit"].dataType).alias("hit"))
    return swept.unionByName(rest).select("row.*", "hit")


def band_self_join(df: DataFrame, key: str, at: str, width: int, order: str = "ord") -> DataFrame:
    """Pairs (a before b) of one key whose values differ by ``width`` at most.

    Values fall into bins of ``width``; a pair's bins are equal or neighbours, so one side is sent
    to its bin and the other to its bin and the two beside it: an equi-join, not a loop over a key.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    slot = F.floor(F.col(at) / max(width, 1))
    a = df.select(F.col(key).alias("_k"), slot.alias("_b"), row.alias("a"))
    b = df.select(F.col(key).alias("_k"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_b"), row.alias("b"))
    return a.join(b, ["_k", "_b"]).where((F.col("a")[order] < F.col("b")[order]) & (F.abs(F.col("a")[at] - F.col("b")[at]) <= width)).select("a", "b")


#: Rows of a block (two blocks meet as a whole), and those of its two sides that are written at a time: each of a few, or of all, beside each of a strip.
BLOCK, FEW, STRIP = 2048, 32, 256


def _two_blocks(rows: DataFrame, names: list[str], width: int, block: int) -> DataFrame:
    """_own (whether both are the same block), _xs, _ys: every two blocks of rows (``names``, _at, _o, _v) of one key whose values differ by ``width`` at most.

    A key's and value's rows are cut into blocks by a hash of ``_o``, sorted arrays of ``_v``. What is shuffled
    grows with the pairs of rows divided by the block's size, and a frequent value is dealt out by pairs of its blocks.
    """
    counts = rows.groupBy(*names, "_at").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m"))
    cut = rows.join(counts, [*names, "_at"]).groupBy(*names, "_at", F.pmod(F.xxhash64("_o"), F.col("_m")).cast("int").alias("_i"))
    blocks = cut.agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    low = counts.select(*names, F.col("_at").alias("_low"), F.col("_m").alias("_m1"), F.explode(F.sequence(F.lit(0), F.lit(width))).alias("_off"))
    high = counts.select(*names, F.col("_at").alias("_high"), F.col("_m").alias("_m2"))
    near = low.withColumn("_high", F.col("_low") + F.col("_off")).join(high, [*names, "_high"])
    # Of one value with itself a block meets those from itself on.
    one = F.col("_off") == 0
    left = blocks.select(*names, F.col("_at").alias("_low"), "_i", F.col("_vs").alias("_xs")).join(near, [*names, "_low"])
    left = left.select(*names, "_low", "_off", "_i", F.explode(F.sequence(F.when(one, F.col("_i")).otherwise(0), F.col("_m2") - 1)).alias("_j"), "_xs")
    right = blocks.select(*names, F.col("_at").alias("_high"), F.col("_i").alias("_j"), F.col("_vs").alias("_ys")).join(near, [*names, "_high"])
    right = right.select(*names, "_low", "_off", F.explode(F.sequence(F.lit(0), F.when(one, F.col("_j")).otherwise(F.col("_m1") - 1))).alias("_i"), "_j", "_ys")
    # A small exchange makes many pairs: its partitions are given by number, so that they are not put together.
    by = [*names, "_low", "_off", "_i", "_j"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(parts, *by).join(right.repartition(parts, *by), by)
    return met.select((one & (F.col("_i") == F.col("_j"))).alias("_own"), "_xs", "_ys")


def _each_two(met: DataFrame, few: int | None = None) -> DataFrame:
    """_own, _x, _y: each of ``_xs`` with each of ``_ys``, in runs of one row beside a strip of the other side, which a columnar file packs to a small part.

    Spark holds all rows that generated code makes of one row until that row is done. With ``few`` the left side is
    cut too, by an expression that runs outside of generated code, and few * STRIP wide rows are held, not a block's.
    """
    cut = lambda c, n: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / n).cast("int")), lambda s: F.slice(c, s * n + 1, F.lit(n)))).alias(c)
    strips = met.select("_own", "_xs", cut("_ys", STRIP))
    if few is not None:
        strips = strips.select("_own", cut("_xs", few), "_ys")
    return strips.select("_own", "_ys", F.explode("_xs").alias("_x")).select("_own", "_x", F.explode("_ys").alias("_y"))


def band_pairs(df: DataFrame, keys: list[str], at: str, width: int, order: str = "ord", block: int = BLOCK) -> DataFrame:
    """(a, b), a before b: ``order`` of the rows of ``band_self_join`` where ``at`` is a whole number.

    All rows of one key and value meet all those of a value near it, so no pair is compared.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(at).cast("long").alias("_at"), F.col(order).alias("_o")).dropna()
    pairs = _each_two(_two_blocks(rows.withColumn("_v", F.col("_o")), names, width, block))
    return pairs.where("_x < _y OR (NOT _own AND _x > _y)").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


#: Words that have a bit of their own, the most frequent ones; 64 to a number.
COMMON_WORDS = 128


def overlap_pairs(df: DataFrame, key: str, words: str, order: str = "ord", block: int = BLOCK) -> DataFrame:
    """(a, b, overlap), a before b: every two rows of one key with what ``text.words_overlap`` says of their distinct words.

    The most frequent words of the table are bits, so that what two rows share of them is counted at once. The
    others are compared only where two rows have a bit in common that other words' hashes set.
    """
    rows = df.select(F.col(key).alias("_k0"), F.lit(0).cast("long").alias("_at"), F.col(order).alias("_o"), F.col(words).alias("_w")).dropna(subset=["_k0", "_o"])
    often = rows.select(F.explode("_w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").limit(COMMON_WORDS)
    common = F.array(*[F.lit(r["w"]) for r in often.collect()]).cast("array<string>")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    bits = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda x, n: x.bitwiseOR(bit(n)))
    place = lambda w: F.array_position(common, w) - 1
    named = rows.withColumn("_p", F.transform("_w", place)).withColumn("_rare", F.filter("_w", lambda w: place(w) < 0))
    among = lambda first: bits(F.transform(F.filter("_p", lambda p: (p >= first) & (p < first + 64)), lambda p: p - first))
    own = [among(i).alias(f"c{i}") for i in range(0, COMMON_WORDS, 64)]
    hashed = bits(F.transform("_rare", lambda w: F.pmod(F.xxhash64(w), F.lit(64)))).alias("h")
    row = F.struct(F.col("_o"), F.size("_w").alias("n"), *own, hashed, F.col("_rare").alias("rare"))
    pairs = _each_two(_two_blocks(named.withColumn("_v", row), ["_k0"], 0, block), FEW)
    pairs = pairs.where("_x._o < _y._o OR (NOT _own AND _x._o > _y._o)")
    both = lambda c: F.col(f"_x.{c}").bitwiseAND(F.col(f"_y.{c}"))
    shared = F.when(both("h") == 0, F.lit(0)).otherwise(F.size(F.array_intersect("_x.rare", "_y.rare")))
    for i in range(0, COMMON_WORDS, 64):
        shared = shared + F.bit_count(both(f"c{i}"))
    least = F.least("_x.n", "_y.n")
    return pairs.select(F.least("_x._o", "_y._o").alias("a"), F.greatest("_x._o", "_y._o").alias("b"), F.when(least == 0, F.lit(0.0)).otherwise(shared / least).alias("overlap"))


def range_state(points: DataFrame, events: DataFrame, key: str, at: str, on: str = "on", when: str = "line") -> DataFrame:
    """Each point with ``state``: the ``on`` flag of the last event of its key at or before it (as-of join).

    Points and events share one shuffle and one sort; no point meets every event.
    """
    p = points.withColumn("_t", F.col(at)).withColumn("_e", F.lit(1)).withColumn("_on", F.lit(None).cast("boolean"))
    e = events.select(F.col(key), F.col(when).alias("_t"), F.lit(0).alias("_e"), F.col(on).alias("_on"))
    both = p.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("state", F.last("_on", ignorenulls=True).over(w)).where("_e = 1").drop("_t", "_e", "_on")


def multiset_diff(current: DataFrame, baseline: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, resolved, unchanged): rows keep their number, as anti and semi joins do, unlike EXCEPT."""
    b, c = baseline.select(key).distinct(), current.select(key).distinct()
    return current.join(b, key, "left_anti"), baseline.join(c, key, "left_anti"), current.join(b, key, "left_semi")


#: Rules that are made part of the expression; more are joined.
LITERAL_RULES = 1000


def theta_first(df: DataFrame, rules: DataFrame, condition: Callable[[Column], Column], order: str) -> DataFrame:
    """Each row with the first rule (struct ``rule``) for which a condition holds, or null: by ``order`` (nulls first), then by the rule itself.

    ``condition`` makes a column of a rule's struct and the row's columns. A configured table of
    rules becomes an array in the expression: no join, nothing is shuffled. A large one is joined.
    """
    rule = F.struct(*[F.col(c) for c in rules.columns])
    few = rules.select(rule.alias("rule")).orderBy(F.col("rule")[order].asc_nulls_first(), "rule").limit(LITERAL_RULES + 1)
    listed = few.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rule")[order].alias("o"), "rule")))).alias("j"), F.count(F.lit(1)).alias("n")).first()
    if listed["n"] <= LITERAL_RULES:
        kind = few.agg(F.collect_list(F.struct(F.col("rule")[order].alias("o"), "rule")).alias("x")).schema["x"].dataType
        array = F.transform(F.from_json(F.lit(listed["j"]), kind), lambda x: x["rule"])
        return df.withColumn("rule", F.get(F.filter(array, condition), F.lit(0)))
    # Rows are written once under an id, so that contents are not shuffled and any column passes through.
    own = fresh_name(df, "id")
    kept = Scratch(df.sparkSession, "rules").table("rows", df.withColumn(own, F.monotonically_increasing_id()))
    joined = kept.join(rules.select(rule.alias("rule")), condition(F.col("rule")))
    first = joined.groupBy(own).agg(F.min_by("rule", F.struct(F.col("rule")[order].isNotNull(), F.col("rule")[order], "rule")).alias("rule"))
    return kept.join(first, own, "left").drop(own)


def threshold(df: DataFrame, min_severity: str | None, min_confidence: str | None) -> DataFrame:
    """Rows at or above both thresholds; an unknown threshold keeps all, an unknown value goes."""
    for column, least, order in (("severity", min_severity, SEVERITIES), ("confidence", min_confidence, CONFIDENCES)):
        if least in order:
            df = df.where(F.coalesce(rank(F.col(column), order) <= order.index(least), F.lit(False)))
    return df
