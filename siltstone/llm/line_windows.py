"""Removal of repeated overlapping windows of three lines, by DataFrame functions alone.

Every run of three lines is hashed (128 bits). A window that also starts earlier, in a document
before or higher up in the same one, is a repeat; the lines that repeats cover, merged, go. The
earliest occurrence is found by a minimum per hash, which is combined before the shuffle, and only
hashes that occur twice are joined back, so a window that a third of all rows hold costs one row
a task on one side and a join that adaptive execution splits on the other.

Cases: documents are ordered by doc_id (null first), then by the text's hash; rows equal in both
count as one document and are treated alike. Texts of under three lines, empty texts and null
texts stay as they are; windows of blank lines only are no repeats. A document whose lines all go
gets an empty text. Columns other than text stay, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import fresh_name

WIDTH = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """One row a window that is not blank: d, t (the document), at (first line), h and g (hashes)."""
    window = lambda i: [F.col("ls")[i + k] for k in range(width)]
    every = F.transform(
        F.sequence(F.lit(0), F.size("ls") - width),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*window(i)).alias("h"),
            F.xxhash64(F.lit(width), *reversed(window(i))).alias("g"),
            (F.length(F.regexp_replace(F.concat(*window(i)), r"\s+", "")) > 0).alias("full"),
        ),
    )
    long_enough = rows.where(F.size("ls") >= width).select("d", "t", F.explode(every).alias("w"))
    return long_enough.where("w.full").select("d", "t", F.col("w.at").alias("at"), F.col("w.h").alias("h"), F.col("w.g").alias("g"))


def dedup_line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """The input with ``text`` cut, and the columns ``n_lines`` and ``n_removed`` (null text: 0), which replace columns of these names."""
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), _lines(text).alias("ls"))
    windows = _windows(rows, width)
    place = F.struct("d", "t", "at")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    later = windows.join(repeated, ["h", "g"]).where(place > F.col("first"))
    key, owner, own, starts, lines, gone = (fresh_name(docs, n) for n in ("key", "owner", "own", "starts", "lines", "gone"))
    covered = later.groupBy("d", "t").agg(F.collect_set("at").alias(starts)).select(F.col("d").alias(owner), F.col("t").alias(own), starts)
    spread = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1))))
    joined = docs.withColumn(key, F.xxhash64(text)).join(covered, F.col(doc_id).eqNullSafe(F.col(owner)) & (F.col(key) == F.col(own)), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cut = joined.withColumn(lines, _lines(text)).withColumn(gone, spread)
    return (
        cut.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)))
        .withColumn(n_removed, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(keep, lambda i: F.col(lines)[i]), "\n")))
        .drop(key, owner, own, starts, lines, gone)
    )


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS body FROM s),
f AS (SELECT body, min((doc_id, i)) AS first FROM w WHERE regexp_matches(body, '[^ \t\n\f\r\v]') GROUP BY body HAVING count(*) > 1),
r AS (SELECT DISTINCT w.doc_id, w.i + k.k AS line FROM w JOIN f USING (body), (VALUES (0), (1), (2)) k(k) WHERE (w.doc_id, w.i) > f.first),
g AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text FROM e
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND r.line = e.i) GROUP BY e.doc_id)
SELECT l.doc_id, CASE WHEN g.n IS NULL THEN l.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
