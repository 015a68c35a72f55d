"""What a reviewer is given about a result: its lines, neighbours and what else was asked for, within a budget."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import explode_lines, line_slice, lines, matches, normal_path, numbered, redact, redactable, trim
from siltstone.operators.core import running_budget, top_per_key
from siltstone.sources.files import ProjectConfig, imports, routes, symbols

# Files whose content is not shown, and scanners that are said to have found nothing.
_ENV = r"(^|/)\.env($|\.|/)"
_LOCK = r"(?i)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Gemfile\.lock|poetry\.lock|go\.sum|Cargo\.lock)$"
_EXPECTED = ("semgrep", "bearer", "custom-rules", "taint-lite", "config-checks")


def snippets(results: DataFrame, files: DataFrame, around: int = 25, most: int = 12_000) -> DataFrame:
    """ord, path, start_line, end_line, content: redacted lines around each result; env and lock files are replaced."""
    # A generator makes each file's lines and flag once; a plain column would be worked out for every result that a join finds.
    told = F.struct(lines(F.col("content")).alias("_ls"), redactable(F.col("content")).alias("_secret"))
    text = files.select(F.col("path").alias("_p"), F.inline(F.array(told)))
    joined = results.join(text, F.col("path") == F.col("_p"))
    first = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)) - around)
    last = F.least(F.size("_ls"), F.coalesce("end_line", "start_line", F.lit(1)) + around)
    # Patterns are looked for once a file, not once a result; most files hold none of them.
    part = line_slice(F.col("_ls"), first, last)
    shown = F.substring(F.when(F.col("_secret"), redact(part)).otherwise(part), 1, most)
    content = F.when(matches(F.col("path"), _ENV), "[REDACTED ENV FILE CONTENT]").when(matches(F.col("path"), _LOCK), "[DEPENDENCY LOCKFILE CONTENT OMITTED; scanner result metadata retained]").otherwise(shown)
    return joined.select("ord", "path", first.alias("start_line"), last.alias("end_line"), content.alias("content"))


def _near(results: DataFrame, rows: DataFrame, within: int, most: int) -> DataFrame:
    """Rows of a result's file at most so many lines away, the first in order of lines."""
    r = results.select("ord", F.col("path").alias("_p"), F.coalesce("start_line", F.lit(1)).alias("_at"))
    hit = r.join(rows, F.col("_p") == F.col("path")).where(F.abs(F.col("start_line") - F.col("_at")) <= within)
    return top_per_key(hit.drop("_p", "_at"), ["ord"], [F.col("start_line"), F.col("name")], most)


def near_symbols(results: DataFrame, files: DataFrame) -> DataFrame:
    return _near(results, symbols(files), 80, 20)


def near_routes(results: DataFrame, files: DataFrame) -> DataFrame:
    return _near(results, routes(files).select("path", "method", F.col("route_path").alias("name"), "start_line", "framework"), 120, 20)


def file_imports(results: DataFrame, files: DataFrame, most: int = 40) -> DataFrame:
    """ord, modules: what each result's file imports."""
    few = top_per_key(imports(files), ["path"], [F.col("k")], most).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "module"))), lambda s: s["module"]).alias("modules"))
    return results.select("ord", "path").join(few, "path").select("ord", "modules")


def config_hints(results: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """Lines of a result's file that speak of settings or secrets, redacted."""
    rows = explode_lines(files.join(results.select("path").distinct(), "path", "left_semi")).where(matches(F.col("line"), r"(?i)(process\.env|import\.meta\.env|os\.environ|dotenv|config|secret|token|password)"))
    few = top_per_key(rows.select("path", "i", "line"), ["path"], [F.col("i")], most)
    return results.select("ord", "path").join(few, "path").select("ord", "path", (F.col("i") + 1).alias("line"), F.substring(redact(trim(F.col("line"))), 1, 240).alias("note"))


def related(results: DataFrame, all_results: DataFrame, most: int = 10) -> DataFrame:
    """ord, related: the first results of the same path, clipped."""
    clip = all_results.select("path", F.col("ord").alias("_o"), "scanner", "rule_id", F.substring("title", 1, 500).alias("title"), "category", "severity", "start_line", "end_line", F.substring("message", 1, 1000).alias("message")).where("path IS NOT NULL")
    few = top_per_key(clip, ["path"], [F.col("_o")], most)
    listed = few.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_o", "scanner", "rule_id", "title", "category", "severity", "start_line", "end_line", "message"))).alias("related"))
    return results.select("ord", "path").join(listed, "path").select("ord", "related")


def silent_scanners(results: DataFrame, all_results: DataFrame) -> DataFrame:
    """ord, scanners: of the expected ones, those without a result for the path."""
    seen = all_results.where("path IS NOT NULL").groupBy("path").agg(F.collect_set("scanner").alias("_seen"))
    joined = results.select("ord", "path").join(seen, "path", "left")
    return joined.select("ord", F.array_except(F.array(*map(F.lit, _EXPECTED)), F.coalesce("_seen", F.array().cast("array<string>"))).alias("scanners"))


def context_packs(results: DataFrame, files: DataFrame, all_results: DataFrame, max_chars: int = 60_000) -> DataFrame:
    """One JSON document a result, and its length in characters.

    A pack that is too long has its snippet clipped by as much, then goes without related results,
    then without symbols and routes, then without hints and imports: the first form that fits
    counts, and the last one where none does. ``chars`` is the true length.
    """
    parts = snippets(results, files).select("ord", F.struct("path", "start_line", "end_line", "content").alias("snippet"))
    gather = lambda df, name: df.groupBy("ord").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "ord"])).alias(name))
    packs = results.select("ord", F.struct("scanner", "rule_id", "title", "category", "severity", "path", "start_line", "end_line", "message").alias("result")).join(parts, "ord", "left")
    for df in (gather(near_symbols(results, files), "symbols"), gather(near_routes(results, files), "routes"), gather(config_hints(results, files), "config_hints"), file_imports(results, files), related(results, all_results), silent_scanners(results, all_results)):
        packs = packs.join(df, "ord", "left")
    names = [c for c in packs.columns if c != "ord"]

    def form(snippet, *without: str):
        return F.to_json(F.struct(*[snippet.alias(c) if c == "snippet" else F.col(c) for c in names if c not in without]))

    # A character takes one or more in JSON, so clipping by what is too much is enough while the snippet has it.
    over = lambda *without: F.greatest(F.length(form(F.col("snippet"), *without)) - max_chars, F.lit(0))
    clip = lambda *without: F.col("snippet").withField("content", F.substring(F.col("snippet.content"), F.lit(1), F.greatest(F.length("snippet.content") - over(*without), F.lit(0))))
    steps = [(), ("related",), ("related", "symbols", "routes"), ("related", "symbols", "routes", "config_hints", "modules")]
    forms = [form(F.col("snippet")), *[form(clip(*w), *w) for w in steps]]
    fitting = F.coalesce(*[F.when(F.length(f) <= max_chars, f) for f in forms], forms[-1])
    return packs.select("ord", fitting.alias("pack")).select("ord", "pack", F.length("pack").alias("chars"))


def given_ranges(packs: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """path, start_line, end_line of all that a reviewer was given: snippets, and files and symbols asked for."""
    shape = lambda df: df.select(F.regexp_replace(normal_path(F.col("path")), "^/+", "").alias("path"), "start_line", "end_line").where("path <> '' AND start_line IS NOT NULL AND end_line IS NOT NULL")
    own = shape(packs)
    return own.unionByName(shape(requested)).distinct() if requested is not None else own.distinct()


def requested_context(asked: DataFrame, files: DataFrame, max_chars: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(contexts, missing) for asked (kind: file or symbol, query, ord): five files, eight symbols, five matches a symbol, a budget of characters."""
    a = asked.withColumn("query", trim(F.col("query"))).where("query <> ''").dropDuplicates(["kind", "query"])
    wanted = top_per_key(a, ["kind"], [F.col("ord")], 8).withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("ord"))).where("kind = 'symbol' OR _n <= 5").drop("_n")
    text = files.select("path", lines(F.col("content")).alias("ls"), F.col("ord").alias("file_ord"))
    by_file = wanted.where("kind = 'file'").withColumn("_q", F.regexp_replace(F.replace("query", F.lit("\\"), F.lit("/")), "^/+", "")).join(text, F.col("_q") == F.col("path"))
    by_file = by_file.select("kind", "query", "ord", "path", F.lit(1).alias("start_line"), F.least(F.size("ls"), F.lit(220)).alias("end_line"), "ls", F.lit(0).cast("long").alias("file_ord"))
    # A symbol is looked up among the words of each line: an equi-join, not a pattern built from data.
    words = explode_lines(files.select("path", "content", F.col("ord").alias("file_ord"))).select("path", "file_ord", "lines", "i", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("word"))
    first = words.join(wanted.where("kind = 'symbol'"), F.col("word") == F.col("query")).groupBy("kind", "query", "ord", "path", "file_ord").agg(F.min("i").alias("i"), F.first("lines").alias("ls"))
    by_symbol = top_per_key(first, ["query"], [F.col("file_ord")], 5).select("kind", "query", "ord", "path", F.greatest(F.lit(1), F.col("i") + 1 - 35).alias("start_line"), F.least(F.size("ls"), F.col("i") + 1 + 80).alias("end_line"), "ls", "file_ord")
    every = by_file.unionByName(by_symbol)
    body = redact(numbered(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), F.col("start_line")))
    sized = every.withColumn("content", body).withColumn("_c", F.length("content")).drop("ls")
    fits = running_budget(sized, "_c", max_chars, ["kind", "ord", "file_ord", "path"]).withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("taken").cast("int")))
    missing = wanted.select("kind", "query").join(every.select("kind", "query").distinct(), ["kind", "query"], "left_anti")
    return fits.drop("_c", "used", "taken", "file_ord"), missing


# Lines that matter for security, by what they are.
_INVENTORY = (
    ("boundary", None, r"(?i)(req\.(query|params|body|headers|cookies)|request\.(args|form|json|files)|params\[|\$_(GET|POST|REQUEST|COOKIE|FILES)|ARGV|process\.argv|sys\.argv)"),
    ("sink", "ssrf", r"(?i)(fetch\(|axios\.|http\.get|https\.get|request\()"),
    ("sink", "command-injection", r"(?i)(exec|execSync|spawn|spawnSync|system|shell_exec|subprocess\.(run|Popen)|Open3\.)\s*\("),
    ("sink", "path-traversal", r"(?i)(sendFile|readFile|writeFile|createReadStream|open|file_get_contents|File\.read|Path\()"),
    ("sink", "xss", r"(?i)(innerHTML|dangerouslySetInnerHTML|v-html|render\s+inline)"),
    ("sink", "open-redirect", r"(?i)(redirect|location\.href|header\s*\(\s*['\"]Location)"),
    ("guard", None, r"(?i)(requireAuth|isAuthenticated|authorize|policy|before_action|middleware|csrf|sanitize|escape|validate|schema|zod|joi|allowlist|whitelist|normalize|realpath)"),
)


def inventory(files: DataFrame) -> DataFrame:
    """path, kind, category, line, detail: the first 30 boundaries, 40 sinks and 40 guards of each file."""
    rows = explode_lines(files)
    kinds = F.array_compact(F.array(*[F.when(matches(F.col("line"), p), F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.lit(c).cast("string").alias("category"))) for n, (k, c, p) in enumerate(_INVENTORY)]))
    found = rows.select("path", "i", F.substring(trim(F.col("line")), 1, 180).alias("detail"), F.explode(kinds).alias("k")).select("path", "k.n", "k.kind", "k.category", (F.col("i") + 1).alias("line"), "detail")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("path", "kind").orderBy("line", "n")))
    return ranked.where("(kind = 'boundary' AND _r <= 30) OR (kind <> 'boundary' AND _r <= 40)").drop("_r", "n")


def inventory_summary(files: DataFrame) -> DataFrame:
    """path, summary: counts of a file's inventory and the categories of its first eight sinks."""
    inv = inventory(files)
    sinks = top_per_key(inv.where("kind = 'sink'"), ["path"], [F.col("line"), F.col("category")], 8).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "category"))), lambda s: s["category"]).alias("c"))
    counts = inv.groupBy("path").agg(F.count_if(F.col("kind") == "boundary").alias("b"), F.count_if(F.col("kind") == "guard").alias("g"))
    entered = routes(files).groupBy("path").agg(F.least(F.count(F.lit(1)), F.lit(30)).alias("e"))
    joined = files.select("path").join(counts, "path", "left").join(sinks, "path", "left").join(entered, "path", "left").fillna(0, ["b", "g", "e"])
    named = F.when(F.size("c") > 0, F.array_join("c", ",")).otherwise("none")
    return joined.select("path", F.format_string("entrypoints=%d trustBoundaries=%d sinks=%s guards=%d", "e", "b", named, "g").alias("summary"))


def rendered_templates(templates: DataFrame, files: DataFrame) -> DataFrame:
    """Template paths that some source file renders: a line of render, template or view that names it, near a request or route."""
    p = F.replace("path", F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(p, r"\.[^.]+$", "")
    names = F.array_distinct(F.filter(F.array(F.regexp_extract(bare, r"[^/]+$", 0), F.regexp_extract(bare, r"(?i)(?:^|/)(?:views|templates)/(.+)$", 1), bare), lambda n: n != ""))
    t = templates.select(F.col("path").alias("template"), F.explode(names).alias("name"))
    source = files.where(matches(F.col("path"), r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|py|php|rb|java|cs)$"))
    rows = explode_lines(source).where(matches(F.col("line"), "(?i)(render|template|view)"))
    near = line_slice(F.col("lines"), F.col("i") - 4, F.col("i") + 6)
    live = matches(near, r"(?i)(req|request|res\.render|reply\.view|render_template|erb\s*:|haml\s*:)") | matches(near, r"(?i)\b(?:app|router)\.(get|post|put|patch|delete|all|use)\s*\(")
    # Names meet the words and quoted paths of a line, not every line.
    said = F.array_distinct(F.concat(F.regexp_extract_all("line", F.lit(r"[\w./-]+"), F.lit(0)), F.regexp_extract_all("line", F.lit(r"[\w-]+"), F.lit(0))))
    calls = rows.where(live).select(F.col("path").alias("caller"), F.explode(said).alias("name"))
    return t.join(calls, "name").where("template <> caller").select(F.col("template").alias("path")).distinct()


def class_budgets(classes: list[str], files: int, rounds: int, chars: int) -> dict[str, tuple[int, int, int]]:
    """An audit's budgets shared among classes, at least one of each."""
    n = max(1, len(classes))
    return {c: (max(1, files // n), max(1, rounds // n), max(1, chars // n)) for c in classes}


def settings(env: Mapping[str, str] | None = None, prefix: str = "AUDIT_") -> dict:
    """Limits from the environment, with defaults; values that are no positive number raise ValueError."""
    # Limits and their defaults.
    defaults = {"MAX_FILE_SIZE": 1_048_576, "MAX_CONTEXT_CHARS": 60_000, "MAX_AI_FINDINGS": 100, "MAX_AI_FINDINGS_LIMIT": 1000, "AI_TRIAGE_TARGET_CODE_FINDINGS": 25, "AI_AUDIT_MAX_FILES": 100, "AI_AUDIT_MAX_ROUNDS": 30, "AI_AUDIT_MAX_CHARS": 500_000}
    env = os.environ if env is None else env
    out: dict = {}
    for key, default in defaults.items():
        value = env.get(prefix + key, "")
        if value and not re.fullmatch(r"\d*[1-9]\d*", value):
            raise ValueError(f"{prefix}{key} must be a positive number")
        out[key.lower()] = int(value) if value else default
    for key in ("AI_AUDIT", "REDACT_SECRETS", "REQUIRE_APPROVAL"):
        out[key.lower()] = env.get(prefix + key, "true").lower() not in ("false", "0", "no", "off")
    return out


def strategy_text(config: ProjectConfig) -> str:
    """A project's scope and rules as instructions; empty for none."""
    out = []
    if config.vulnerability_classes:
        out += [f"Vulnerability classes in scope: {', '.join(config.vulnerability_classes)}.", "Treat out-of-scope vulnerability classes as lower priority unless the supplied evidence shows a clear chained impact into an in-scope class."]
    if rules := str(config.extra.get("rules_of_engagement", "")).strip():
        out.append(f"Rules of engagement: {rules}")
    f = config.report_filters
    if guidance := str(f.get("guidance", "")).strip():
        out.append(f"Report guidance: {guidance}")
    out += [f"Report minimum {name}: {f[key]}." for key, name in (("minSeverity", "severity"), ("minConfidence", "confidence")) if f.get(key)]
    return "\n".join(["Project scan strategy:", *(f"- {line}" for line in out)]) if out else ""


def workspaces(spark: SparkSession, root: str) -> list[dict]:
    """Workspaces below a folder and their state: empty, ready, or corrupt (a manifest that cannot be read)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for entry in fs.listStatus(base) if fs.exists(base) else []:
        stages, state = [], "empty"
        for stage in fs.listStatus(entry.getPath()) if entry.isDirectory() else []:
            path = f"{stage.getPath().toString()}/manifest"
            try:
                row = spark.read.schema("version int, stage string, fingerprint string").option("mode", "FAILFAST").json(path).first()
                state = "ready" if row and row["fingerprint"] else "corrupt"
                stages.append(stage.getPath().getName())
            except Exception:
                state = "corrupt"
        out.append({"name": entry.getPath().getName(), "state": state, "stages": sorted(stages)})
    return sorted(out, key=lambda w: w["name"])
