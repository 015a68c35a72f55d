"""An audit that reads a code base in rounds: a queue of line windows, walked breadth first under budgets.

The queue is a table in the shared folder that only grows: each round writes what it adds. An entry
has a place: additions at the back count upwards, targets that a reviewer asks for go to the front,
below all others. Taking the next targets takes all entries up to a place; what has been taken is a
list of (when, place) pairs, so that nothing is rewritten. A round hands at most ``TARGETS`` windows to the
reviewer; these, the ranges read and the places taken, at most TARGETS rows a round, are all that the
driver knows. Everything else is joins over the queue, the chunks and the import graph.

Files that one round's files import are queued by importer, then by path. A round's text is bounded in
characters; how a reviewer wraps it is not part of the budget.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import matches, normal_path
from siltstone.operators.core import first_wins, in_order
from siltstone.operators.imports import import_graph, rated
from siltstone.session import Scratch
from siltstone.sources.files import audit_chunks, routes

#: Windows that a round hands out, and files that start a walk without any entry point.
TARGETS, STARTERS = 6, 6
# Fixed value: names of files that an audit starts with.
ENTRY_POINT = r"(?i)(server|entry|main|index|route|routes|controller|api|webhook|bin/|cli|command|worker|job)"
#: What a reviewer asks for: a file (start_line null: its first window, at the back) or a range (at the front), by ord.
ASKED = "path string, start_line int, end_line int, ord long"
_ENTRY = "path string, start_line int, end_line int, chunk_index int, place long, at int"


@dataclass
class Round:
    number: int
    pack: DataFrame  # path, start_line, end_line, chunk_index, content, ord: what the reviewer is given
    ranges: list[tuple[str, int, int]]
    chars: int


@dataclass
class Walk:
    """A queue of windows over ``files`` (path, language, content, line_count, ord) with its budgets."""

    files: DataFrame
    results: DataFrame
    priority: list[str] = field(default_factory=list)
    max_files: int = 100

    def __post_init__(self) -> None:
        self.spark = self.files.sparkSession
        self.scratch = Scratch(self.spark, "audit")
        ranked = in_order(rated(self.files, self.results), [F.col("score").desc(), F.col("ord"), F.col("path")], F.lit(0))
        self.ranked = self.scratch.table("ranked", ranked.select("path", F.col("_n").alias("rank")))
        known = self.files.join(self.ranked.select("path"), "path", "left_semi")
        self.known = self.scratch.table("known", known.select("path", "content"))
        self.chunks = self.scratch.table("chunks", audit_chunks(known).select("path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("chunk_index").cast("int").alias("chunk_index")))
        self.graph = self.scratch.table("graph", import_graph(known))
        self.read: list[tuple[str, int, int]] = []
        self.taken: list[tuple[int, int]] = []  # (step, place): of entries added before the step all up to the place
        self.step = self.back = self.front = 0
        self.parts: list[str] = []
        entries = known.where(matches(F.col("path"), ENTRY_POINT)).select("path").union(routes(known).select("path")).distinct()
        self._push_first(self._listed([p.strip().lstrip("./") for p in self.priority]))
        self._push_first(self.ranked.join(entries, "path", "left_semi").select("path", F.col("rank").alias("ord")))
        if self.back == 0:
            self._push_first(self.ranked.orderBy("rank").limit(STARTERS).select("path", F.col("rank").alias("ord")))

    # --- the queue ---

    def _listed(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long")

    def _queue(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(*self.parts)

    def _push(self, windows: DataFrame, front: bool = False) -> int:
        """Adds windows (path, start_line, end_line, chunk_index, ord) that no entry has had yet, in order."""
        key = ["path", "start_line", "end_line"]
        fresh = first_wins(windows.join(self.known.select("path"), "path", "left_semi"), key).join(self._queue().select(*key), key, "left_anti")
        self.step += 1
        name = f"queue-{self.step}"
        placed = in_order(fresh, [F.col("ord"), *map(F.col, key)], F.lit(0))
        added = self.scratch.table(f"{name}-raw", placed)
        n = added.count()
        first = self.front - n if front else self.back
        if n:
            self.scratch.table(name, added.select(*key, F.col("chunk_index").cast("int").alias("chunk_index"), (F.col("_n") + first).alias("place"), F.lit(self.step).alias("at")))
            self.parts.append(self.scratch.path(name))
        self.scratch.drop(f"{name}-raw")
        if front:
            self.front = first
        else:
            self.back = first + n
        return n

    def _push_first(self, paths: DataFrame) -> int:
        """Adds the first windows of files (path, ord)."""
        first = self.chunks.where("chunk_index = 0")
        return self._push(first.join(paths.groupBy("path").agg(F.min("ord").alias("ord")), "path"))

    def _open(self) -> DataFrame:
        """Entries that are neither taken nor read."""
        rows = self._queue()
        for step, place in self.taken:
            rows = rows.where((F.col("at") > step) | (F.col("place") > place))
        return rows.where(~self._was_read()) if self.read else rows

    def _was_read(self) -> Column:
        kind = "array<struct<path:string,a:int,b:int>>"
        listed = F.from_json(F.lit(json.dumps([{"path": p, "a": a, "b": b} for p, a, b in self.read])), kind)
        return F.exists(listed, lambda r: (r["path"] == F.col("path")) & (r["a"] <= F.col("start_line")) & (r["b"] >= F.col("end_line")))

    def next(self, limit: int = TARGETS) -> list[tuple[str, int, int, int]]:
        """Takes the next windows: (path, start_line, end_line, chunk_index), none of a new file beyond the budget of files."""
        if self._open().isEmpty():
            seen = self.spark.createDataFrame([(p,) for p in sorted({p for p, _, _ in self.read})], "path string")
            self._push_first(self.ranked.join(seen, "path", "left_anti").select("path", F.col("rank").alias("ord")))
        out: list[tuple[str, int, int, int]] = []
        files = {p for p, _, _ in self.read}
        while len(out) < limit:
            rows = self._open()
            room = self.max_files - len(files)
            if room < limit - len(out):
                # Of files not read yet only the first ones in order fit.
                new = rows.where(~F.col("path").isin(*files)) if files else rows
                fits = [r["path"] for r in new.groupBy("path").agg(F.min("place").alias("p")).orderBy("p").limit(max(0, room)).collect()]
                rows = rows.where(F.col("path").isin(*files, *fits))
            got = rows.orderBy("place").limit(limit - len(out)).collect()  # TARGETS at most
            self.step += 1
            short = len(got) < limit - len(out)
            self.taken.append((self.step, self.back if short else got[-1]["place"]))
            out += [(r["path"], r["start_line"], r["end_line"], r["chunk_index"]) for r in got]
            files |= {r["path"] for r in got}
            following = self.spark.createDataFrame([(r["path"], r["chunk_index"] + 1, i) for i, r in enumerate(got)], "path string, chunk_index int, ord long")
            if not got or not self._push(self.chunks.join(following, ["path", "chunk_index"])) or not short:
                break
        return out

    # --- rounds ---

    def run(self, review: Callable[[Round], DataFrame | None], max_rounds: int, max_chars: int, round_chars: int | None = None) -> list[Round]:
        """Rounds until nothing is left to read, no characters are left, or the last round.

        ``review`` sees a round's pack and gives what it asks for (ASKED), or None.
        """
        left, rounds = max_chars, []
        asked = self.next()
        for number in range(1, max_rounds + 1):
            if not asked:
                break
            targets = self.spark.createDataFrame([(*t, i) for i, t in enumerate(asked)], "path string, start_line int, end_line int, chunk_index int, ord long")
            lines = F.split("content", r"\r?\n", -1)
            cut = self.known.join(targets, "path").withColumn("content", F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
            before = F.coalesce(F.sum(F.length("content")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # TARGETS rows
            budget = min(left, round_chars or left)
            rows = cut.withColumn("before", before).where(F.col("before") < budget)
            pack = self.scratch.table(f"pack-{number}", rows.select("path", "start_line", "end_line", "chunk_index", F.substring("content", F.lit(1), F.lit(budget) - F.col("before")).alias("content"), "ord"))
            given = pack.select("path", "start_line", "end_line", F.length("content").alias("n")).orderBy("ord").collect()  # TARGETS at most
            if not given:
                break
            ranges = [(r["path"], r["start_line"], r["end_line"]) for r in given]
            chars = sum(r["n"] for r in given)
            self.read += ranges
            paths = self._listed([p for p, _, _ in ranges])
            self._push_first(self.graph.join(paths, F.col("from_path") == F.col("path")).select(F.col("to_path").alias("path"), F.col("ord")))
            left -= chars
            this = Round(number, pack, ranges, chars)
            rounds.append(this)
            wanted = review(this)
            if wanted is not None:
                wanted = self.scratch.table(f"asked-{number}", wanted.select(normal_path(F.col("path"), root=True).alias("path"), "start_line", "end_line", "ord"))
                self._push_first(wanted.where("start_line IS NULL").select("path", "ord"))
                part = wanted.where("start_line IS NOT NULL").join(self.chunks.groupBy("path").agg(F.max("end_line").alias("n")), "path")
                self._push(part.select("path", "start_line", F.least("end_line", "n").alias("end_line"), F.floor((F.col("start_line") - 1) / 180).cast("int").alias("chunk_index"), "ord"), front=True)
            asked = self.next()
            if left <= 0:
                break
        return rounds
