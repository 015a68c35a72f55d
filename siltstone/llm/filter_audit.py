"""Interaction audit of quality filters by inclusion-exclusion over joint failures.

Five filters fail a document (words are maximal runs of other characters than ASCII white space):
A: under 200 words; B: under half of its words distinct; C: over 2 A-Z in 100 code points; D: holds
one of #$%&*|; E: equals the text of a smaller doc_id. One aggregate counts for each part (source)
and each of the 32 subsets of filters the documents that fail all of it, as sums of flag products
J(S): of all documents, of good ones and of toxic ones. All else follows from these 96 sums a part:

* survivors of a set P of filters: sum of (-1)^|S| J(S) over the subsets S of P (Moebius inversion);
* removed by a step: survivors before less survivors after; redundant: J({f}) less removed;
* failing f alone: survivors of the other four less survivors of all five;
* Shapley: the Harsanyi dividend of S in the game "removed by P" is (-1)^(|S|+1) J(S); f's value is
  the sum of dividends / |S| over the sets that hold it, times 120 the sum over all orders.

Filter E needs the smallest doc_id of each text: texts meet by their SHA-256, first combined by (text,
part, flags), so that a text that a third of all rows hold is a handful of rows after the first combine.

Cases: a null text is an empty one (fails A, and E where a smaller doc_id is empty too); a null
source is the part ''; rows of one doc_id are separate documents, none of which is smaller than the
other; a null doc_id fails no E and makes nobody fail it, and has no labels; a doc_id with several
labels is good (toxic) if any says so; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS = 200
_SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> list[Column]:
    """Failures (0 or 1) of the filters A to D, which see one text alone; null is an empty text."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return [(n < LEAST_WORDS).cast("long"), (100 * distinct < 50 * n).cast("long"), (100 * capitals > 2 * F.length(t)).cast("long"), F.rlike(t, F.lit(r"[#$%&*|]")).cast("long")]


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (0 or 1), good, toxic (booleans) and n: how many documents are so; several rows may say the same."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("_id IS NOT NULL AND (good OR toxic)")
    text = F.col("text").cast("string")
    flags = [c.alias(f) for f, c in zip(FILTERS, text_flags(text))]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_h"), *flags)
    same = [*FILTERS[:4], "part", "_h"]
    once = rows.groupBy("_id", *same).agg(F.count(F.lit(1)).alias("n"))
    marked = once.join(told, "_id", "left").fillna(False, ["good", "toxic"])
    grouped = marked.groupBy(*same, "good", "toxic").agg(F.sum("n").alias("n"), F.min("_id").alias("_least"), F.min_by("n", "_id").alias("_of_least"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("_no_id"))
    first = F.min("_least").over(Window.partitionBy("_h"))
    kept = F.col("_no_id") + F.when(F.col("_least") == first, F.col("_of_least")).otherwise(0)
    both = F.array(F.struct(F.lit(0).cast("long").alias("E"), kept.alias("n")), F.struct(F.lit(1).cast("long").alias("E"), (F.col("n") - kept).alias("n")))
    split = grouped.withColumn("_e", both).select("part", *FILTERS[:4], "good", "toxic", F.explode("_e").alias("_e"))
    return split.select("part", *FILTERS[:4], "_e.E", "good", "toxic", "_e.n").where("n > 0")


def joint_failures(cells: DataFrame) -> DataFrame:
    """part and, for all, good and toxic documents, the array of J(S); bit i of S stands for filter i."""

    def product(subset: int) -> Column:
        out = F.col("n")
        for i, f in enumerate(FILTERS):
            if subset >> i & 1:
                out = out * F.col(f)
        return out

    of = {"every": F.lit(1), "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")}
    sums = [F.sum(product(s) * weight).alias(f"_{name}{s}") for name, weight in of.items() for s in range(SUBSETS)]
    return cells.groupBy("part").agg(*sums).select("part", *[F.array(*[f"_{name}{s}" for s in range(SUBSETS)]).alias(name) for name in of])


def _survivors(joint: str) -> str:
    """For each set of filters the documents that none of it removes."""
    return f"transform(sequence(0, {SUBSETS - 1}), p -> aggregate(sequence(0, {SUBSETS - 1}), 0L, (t, s) -> t + CASE WHEN (s & ~p) <> 0 THEN 0L WHEN bit_count(s) % 2 = 0 THEN {joint}[s] ELSE -{joint}[s] END))"


def interactions(joint: DataFrame) -> DataFrame:
    """The audit's rows from the joint failures: every part, order of filters and step."""
    k, orders = len(FILTERS), ["".join(o) for o in permutations(FILTERS)]
    dividends = f"transform(sequence(0, {k - 1}), f -> aggregate(sequence(1, {SUBSETS - 1}), 0L, (t, s) -> t + CASE WHEN (shiftright(s, f) & 1) = 0 THEN 0L WHEN bit_count(s) % 2 = 1 THEN every[s] * ({len(orders)} div bit_count(s)) ELSE -every[s] * ({len(orders)} div bit_count(s)) END))"
    left = joint.select("part", F.col("every").alias("failing"), *[F.expr(_survivors(c)).alias(c) for c in ("every", "good", "toxic")], F.expr(dividends).alias("shapley"))
    steps = left.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("f", F.expr(f"ascii(substring(filter_order, step, 1)) - {ord(FILTERS[0])}"))
    steps = steps.withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (t, i) -> CASE WHEN i < step THEN t | shiftleft(1, ascii(substring(filter_order, i, 1)) - {ord(FILTERS[0])}) ELSE t END)"))
    steps = steps.withColumn("after", F.expr("before | shiftleft(1, f)"))
    removed = "every[before] - every[after]"
    every = SUBSETS - 1
    return steps.select(
        "part", "filter_order", "step", F.expr("every[after]").alias("kept"), F.expr(removed).alias("removed"), F.expr(f"failing[shiftleft(1, f)] - ({removed})").alias("redundant"),
        F.expr(f"every[{every} - shiftleft(1, f)] - every[{every}]").alias("unique_fails"), F.expr("good[before] - good[after]").alias("good_lost"), F.expr("toxic[before] - toxic[after]").alias("toxic_lost"), F.expr("shapley[f]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(joint_failures(failure_cells(docs, labels)))


# Every order is applied step by step to the documents' own failures; no joint counts.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
l AS (SELECT doc_id, max(quality) FILTER (quality = 1) AS good, max(toxic) FILTER (toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, n, good, toxic, contains(fails, f) AS failing, length(translate(fails, earlier, '')) < length(fails) AS gone, fails = f AS alone FROM s, c),
g AS (SELECT part, filter_order, step, any_value(f) AS f, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
