"""The import graph of a code base, walks over it, and searches that give windows of lines."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.classify import attack_surface_weight, auditable, file_role, result_score, role_score, seed_classes
from siltstone.functions.text import explode_lines, matches, may_match
from siltstone.operators.core import first_wins, in_order, range_semi, running_budget, top_per_key
from siltstone.session import Scratch
from siltstone.sources.files import audit_chunks, imports, path_aliases, routes

# Endings of files that an import may mean.
_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rb", ".php", ".go", ".java", ".cs")
_ENDINGS = ("", *(f"{name}{ext}" for ext in _EXTENSIONS for name in ("", "/index", "/__init__")))
#: The alias that holds where no configuration names it.
_USUAL_ALIAS = ("@/", "src/")


def resolve_folder(path):
    """A path without empty, . and .. parts, as a stack of its parts has it; .. stays only where it leads out of the root."""
    push = lambda stack, part: F.concat(stack, F.array(part))
    up = lambda stack: (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
    step = lambda stack, part: F.when(part.isin("", "."), stack).when((part == "..") & (F.size(stack) > 0), F.when(up(stack), F.slice(stack, 1, F.size(stack) - 1)).otherwise(push(stack, part))).otherwise(push(stack, part))
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def import_graph(files: DataFrame) -> DataFrame:
    """from_path, to_path: the known files that each import may mean: beside the importer, from the root, by alias, or as a dotted module."""
    # Four branches read the imports and three the aliases: both are taken from the texts once and written.
    scratch = Scratch(files.sparkSession, "imports")
    found = scratch.table("modules", imports(files).select("path", F.trim(F.replace("module", F.lit("\\"), F.lit("/"))).alias("module")))
    folder = F.regexp_replace("path", "[^/]*$", "")
    beside = found.where("startswith(module, '.')").select("path", F.concat(folder, F.col("module")).alias("base"))
    rooted = found.where("startswith(module, '/')").select("path", F.col("module").alias("base"))
    named = found.where("NOT startswith(module, '.') AND NOT startswith(module, '/')")
    dotted = named.select("path", F.explode(F.array(F.replace("module", F.lit("."), F.lit("/")), F.concat(folder, F.replace("module", F.lit("."), F.lit("/"))))).alias("base"))
    given = scratch.table("aliases", path_aliases(files).where("prefix <> ''"))
    usual = files.sparkSession.createDataFrame([_USUAL_ALIAS], "prefix string, target string")
    aliases = given.union(usual.join(given.select("prefix").distinct(), "prefix", "left_anti"))
    # A module meets the aliases by its own beginnings of the lengths that occur: an equi-join.
    sizes = sorted(r["n"] for r in aliases.select(F.length("prefix").alias("n")).distinct().collect())
    heads = F.explode(F.array_distinct(F.array(*[F.substring("module", 1, n) for n in sizes])))
    by_alias = named.withColumn("prefix", heads).join(aliases, "prefix").select("path", F.concat("target", F.expr("substring(module, length(prefix) + 1)")).alias("base"))
    every = beside.unionByName(rooted).unionByName(dotted).unionByName(by_alias).select("path", resolve_folder(F.col("base")).alias("base")).distinct()
    tried = every.select("path", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in _ENDINGS])).alias("to_path"))
    hit = tried.join(files.select(F.col("path").alias("to_path")).distinct(), "to_path").where("path <> to_path")
    return hit.select(F.col("path").alias("from_path"), "to_path").distinct()


def reach_depth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """path, depth: breadth-first distance from the seeds over (from_path, to_path).

    Each round joins only the frontier and anti-joins what was seen; edges and rounds are written to the
    shared folder, so the plan does not grow and edges are made once. It ends when a round reaches nothing new.
    """
    scratch = Scratch(edges.sparkSession, "bfs")
    edges = scratch.table("edges", edges.select("from_path", "to_path"))
    seen = scratch.table("seen-0", seeds.select("path", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in count(1):
        following = frontier.join(edges, F.col("path") == F.col("from_path")).select(F.col("to_path").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("depth", F.lit(depth))
        frontier = scratch.table(f"frontier-{depth}", following)
        if frontier.isEmpty():
            scratch.drop("edges")
            break
        seen = scratch.table(f"seen-{depth}", seen.unionByName(frontier))
        scratch.drop(f"seen-{depth - 1}")
    return seen


def seed_ranking(results: DataFrame, files: DataFrame, classes: list[str], most_results: int = 80, most_files: int = 30, per_class: int = 12) -> tuple[DataFrame, DataFrame]:
    """(paths for all, (class, path) pairs) from the best-scored results on known files."""
    known = results.join(files.select("path").distinct(), "path", "left_semi").withColumn("_s", result_score())
    top = known.orderBy(F.col("_s").desc(), "ord").limit(most_results)
    paths = top.groupBy("path").agg(F.max_by(F.struct("_s", F.negative("ord")), F.struct("_s", F.negative("ord"))).alias("_b")).orderBy(F.col("_b._s").desc(), F.col("_b").desc()).limit(most_files).select("path")
    pairs = top.select("path", "_s", "ord", F.explode(seed_classes()).alias("class")).where(F.col("class").isin(classes))
    best = pairs.groupBy("class", "path").agg(F.max("_s").alias("_s"), F.min("ord").alias("ord"))
    return paths, top_per_key(best, ["class"], [F.col("_s").desc(), F.col("ord"), F.col("path")], per_class).select("class", "path")


def rated(files: DataFrame, results: DataFrame) -> DataFrame:
    """path, language, line_count, hints, route_count, has_result, ord and score of every file worth reading.

    Texts are read here, before any join, and what they say is written: no text is shuffled, and nothing
    that sorts or walks the files reads them again.
    """
    kept = files.where(auditable(F.col("path"), F.col("language"), F.col("line_count"), F.col("content")))
    counts = routes(kept).groupBy("path").agg(F.count(F.lit(1)).alias("route_count"))
    flagged = results.select("path").where("path IS NOT NULL").distinct().withColumn("has_result", F.lit(True))
    critical = matches(F.col("path"), r"(?i)(route|routes|controller|command|cli|bin/|exe/|rake|task|worker|job|api|server|auth|session|login|webhook|admin|security|crypto|upload|email|billing|tenant|shopify)")
    words = r"(?i)(getSession|requireAuth|admin|jwt|csrf|cors|crypto|encrypt|decrypt|webhook|fetch|axios|redirect|sendFile|readFile|createTransport|params|ARGV|process\.argv|sys\.argv|\$_(GET|POST|REQUEST|COOKIE)|unserialize|Marshal\.load|YAML\.load|shell_exec|Open3|system\()"
    sensitive = may_match(F.col("content"), F.col("_low"), words) & matches(F.col("content"), words)
    said = kept.select("path", "language", "line_count", "ord", "content", F.lower("content").alias("_low")).select("path", "language", "line_count", "ord", F.coalesce(sensitive, F.lit(False)).alias("_sensitive"))
    rows = said.join(counts, "path", "left").join(flagged, "path", "left").fillna(0, ["route_count"]).fillna(False, ["has_result"])
    hints = F.array_compact(F.array(F.when(critical, "security-critical-path"), F.when(F.col("route_count") > 0, "route-entrypoint"), F.when(F.col("_sensitive"), "security-sensitive-symbols")))
    rows = rows.select("path", "language", "line_count", hints.alias("hints"), "route_count", "has_result", "ord")
    points = attack_surface_weight(F.col("path")) + role_score(file_role(F.col("path"), F.col("language"))) + F.size("hints") * 10 + F.col("route_count") * 6 + F.when(F.col("has_result"), 8).otherwise(0)
    return Scratch(files.sparkSession, "rated").table("files", rows.withColumn("score", points))


def manifest(files: DataFrame, results: DataFrame) -> DataFrame:
    """``rated``, best first."""
    return rated(files, results).orderBy(F.col("score").desc(), "ord")


def traversal(files: DataFrame, results: DataFrame, priority: list[str] = (), most_files: int | None = None) -> DataFrame:
    """path, start_line, end_line, chunk_index, file_place, place: the order in which an audit reads chunks, of all files or the first ``most_files``.

    Priority files come first, then files by depth from the entry points over imports, then by score.
    """
    ranked = rated(files, results)
    asked = F.array_position(F.array(*map(F.lit, priority)), F.col("path")) if priority else F.lit(0)
    depth = reach_depth(import_graph(files), ranked.where("route_count > 0 OR array_contains(hints, 'security-critical-path')").select("path"))
    rows = ranked.join(depth, "path", "left").select("path", F.when(asked > 0, asked).otherwise(1 << 30).alias("_p"), F.coalesce("depth", F.lit(1 << 30)).alias("_d"), "score", "ord")
    order = ["_p", "_d", F.col("score").desc(), "ord"]
    if most_files is not None:
        # Only the picked files are cut.
        rows = rows.orderBy(*order).limit(most_files)
        files = files.join(F.broadcast(rows.select("path").distinct()), "path", "left_semi")
    cut = Scratch(files.sparkSession, "traversal").table("chunks", audit_chunks(files).drop("chunk_count"))
    sizes = cut.groupBy("path").agg(F.count(F.lit(1)).alias("_c"))
    placed = in_order(rows.join(sizes, "path"), order, F.col("_c")).select("path", (F.col("_n") + 1).cast("int").alias("file_place"), "_before")
    nth = F.row_number().over(Window.partitionBy("file_place").orderBy("chunk_index"))
    return cut.join(placed, "path").withColumn("place", (F.col("_before") + nth).cast("int")).drop("_before").orderBy("place")


def search(files: DataFrame, query: str, symbol: bool = False, most: int = 20, before: int = 60, after: int = 90) -> DataFrame:
    """path, start_line, end_line around the first hit in each file; a symbol must stand as a word."""
    low = query.lower()
    hit = matches(F.col("line"), rf"\b{re.escape(query)}\b") if symbol else F.lower("line").contains(low)
    rows = explode_lines(files).where(hit).groupBy("path", "ord").agg(F.min("i").alias("i"), F.first(F.size("lines")).alias("n"))
    top = rows.orderBy("ord").limit(most)
    return top.select("path", F.greatest(F.col("i") + 1 - before, F.lit(1)).alias("start_line"), F.least(F.col("i") + 1 + after, F.col("n")).alias("end_line"))


def requested_targets(wanted: DataFrame, files: DataFrame, inspected: DataFrame, most_files: int) -> DataFrame:
    """Targets (path, start_line, end_line, ord) of known files that no inspected range holds, within a budget of files."""
    known = wanted.join(files.select("path").distinct(), "path", "left_semi")
    r = inspected.select(F.col("path").alias("_p"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    new = known.join(r, (F.col("path") == F.col("_p")) & (F.col("_a") <= F.col("start_line")) & (F.col("_b") >= F.col("end_line")), "left_anti")
    unique = first_wins(new, ["path", "start_line", "end_line"])
    order = unique.groupBy("path").agg(F.min("ord").alias("_o")).orderBy("_o").limit(most_files)
    return unique.join(order.select("path"), "path", "left_semi")


def uninspected(points: DataFrame, inspected: DataFrame) -> DataFrame:
    """Cited lines (path, line) that lie in no inspected range."""
    return range_semi(points, inspected, "path", "line", anti=True)


def backed_off(budget: int, sizes: list[int], fixed: int, limit: int, share: float = 0.7) -> int:
    """The budget for source text, cut to ``share`` of itself until it and the fixed text of a prompt fit the limit.

    ``sizes``: characters of the chunks in order, the last one that fits being clipped.
    """
    while budget > 0 and fixed + min(budget, sum(sizes)) > limit:
        budget = int(budget * share)
    return budget


def bounded_pack(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks in order while their text fits a budget of characters; the last one is clipped."""
    used = running_budget(chunks.withColumn("_n", F.length("content")), "_n", budget, ["place"])
    return used.withColumn("content", F.substring("content", F.lit(1), F.col("taken").cast("int"))).drop("_n", "used", "taken")
