"""File trees as tables: index, chunks, symbols, imports and routes; and small configuration readers."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import javascript
from siltstone.functions.classify import language
from siltstone.functions.rules import ROUTES
from siltstone.functions.text import hits, line_count, lines, matches, may_match, normal_path, trim
from siltstone.schemas import ROUTE
from siltstone.session import Scratch, fresh_name, ship, small_batches

# Folders that a walk leaves out, and limits.
IGNORED_FOLDERS = (".git", "node_modules", "dist", "build", "coverage", ".next", "vendor", "target", "__pycache__", ".venv", "venv", ".cache", "tmp", ".idea", ".vscode")
MAX_FILE_BYTES = 1_048_576
CHUNK_LINES, CHUNK_OVERLAP, AUDIT_LINES = 120, 20, 180


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def ignored(path: Column, gitignore: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path is left out: a default folder, the last matching ignore rule (! takes back), an exclude glob."""
    out = matches(path, "(^|/)(" + "|".join(re.escape(f) for f in IGNORED_FOLDERS) + ")(/|$)")
    for rule in gitignore or []:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        back, body = rule.startswith("!"), rule.lstrip("!").rstrip("/")
        anchored = "/" in body
        pattern = glob_pattern(body.lstrip("/"))[1:-1]
        hit = matches(path, f"^{pattern}(/|$)" if anchored else f"(^|/){pattern}(/|$)")
        out = F.when(hit, F.lit(not back)).otherwise(out)
    for glob in exclude or []:
        out = out | matches(path, glob_pattern(glob)) | matches(path, glob_pattern(glob.rstrip("/") + "/**"))
    return out


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Files below a folder, by ascending path, with their bytes. Include globs apply to files only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    rows = found.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^" + re.escape(base), ""))
    rows = rows.where(~ignored(F.col("path"), gitignore, exclude))
    if include:
        rows = rows.where(F.greatest(*[matches(F.col("path"), glob_pattern(g)) for g in include], F.lit(False)))
    return rows.orderBy("path").limit(max_files) if max_files else rows


def tree_fingerprint(walked: DataFrame) -> DataFrame:
    """One hash of all paths, sizes and times, without reading contents.

    Paths are combined by parts of their hash: each part is hashed in order of its files' hashes, then the
    parts in order; neither a task nor a row holds all paths.
    """
    line = F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    each = walked.select(F.sha2(line, 256).alias("h")).groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sum(F.lit(1)).alias("n"), *[F.bit_xor(F.conv(F.substring("h", 5 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)], *[F.sum(F.conv(F.substring("h", 5 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    parts = F.concat_ws(":", "p", "n", *[F.col(f"{k}{i}").cast("string") for k in "xs" for i in range(4)])
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256).alias("fingerprint"))  # 65,536 parts at most


def index(walked: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, size_bytes, indexed, skipped_reason, sha256, language, content, line_count; large and binary files have no content.

    The limit on ``length`` is a pushed filter's expression: bytes of larger files are not decoded.
    """
    head = F.decode(F.substring("content", 1, 8000), "ISO-8859-1")
    reason = F.when(F.col("length") > max_bytes, "file too large").when(F.instr(head, "\0") > 0, "binary file")
    rows = walked.select("path", F.col("length").alias("size_bytes"), reason.alias("skipped_reason"), F.col("content").alias("_raw"))
    keep = F.col("skipped_reason").isNull()
    text = F.when(keep, F.decode("_raw", "UTF-8"))
    rows = rows.withColumn("content", text).withColumn("sha256", F.when(keep, F.sha2("_raw", 256))).drop("_raw")
    return rows.withColumn("indexed", keep).withColumn("language", language(F.col("path"), F.col("content"))).withColumn("line_count", line_count(F.col("content")))


def with_order(files: DataFrame) -> DataFrame:
    """Adds ``ord``, the file's place by path (from 1).

    Paths alone are sorted, by ranges, and numbered within each range behind those before it; contents
    join by path. No task orders the whole tree.
    """
    part, key, at, ahead, again = (fresh_name(files, n) for n in ("part", "key", "at", "ahead", "again"))
    paths = files.groupBy("path").agg(F.count(F.lit(1)).alias(again)).orderBy("path").withColumn(part, F.spark_partition_id()).withColumn(key, F.monotonically_increasing_id())
    ranked = Scratch(files.sparkSession, "files").table("paths", paths)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = ranked.groupBy(part).agg(F.sum(again).alias("n")).select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(ahead))
    before = F.coalesce(F.sum(again).over(Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.withColumn(at, before).join(sums, part).select(F.col("path").alias(key), (F.col(ahead) + F.col(at) + 1).alias("ord"))
    # Rows of one path share its place.
    return files.drop("ord").join(placed, F.col("path").eqNullSafe(F.col(key))).drop(key).select(*[c for c in files.columns if c != "ord"], F.col("ord").cast("long"))


def chunks(files: DataFrame, width: int = CHUNK_LINES, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows of lines: start_line, end_line, content, sha256. The last one ends the file."""
    rows = files.withColumn("_ls", lines(F.col("content"))).withColumn("_n", F.size("_ls"))
    step = width - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n") - overlap), F.lit(step))
    cut = rows.select("path", "_ls", "_n", F.explode(starts).alias("start_line"))
    cut = cut.withColumn("end_line", F.least(F.col("_n"), F.col("start_line") + width - 1))
    body = F.array_join(F.slice("_ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return cut.select("path", "start_line", "end_line", body.alias("content")).withColumn("sha256", F.sha2("content", 256))


def audit_chunks(files: DataFrame, width: int = AUDIT_LINES) -> DataFrame:
    """Windows that do not overlap, with chunk_index and chunk_count."""
    n = F.greatest(F.size(lines(F.col("content"))), F.lit(1))
    count = F.ceil(n / width)
    rows = files.select("path", n.alias("_n"), count.alias("chunk_count"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_index"))
    return rows.select("path", (F.col("chunk_index") * width + 1).alias("start_line"), F.least(F.col("_n").cast("long"), (F.col("chunk_index") + 1) * width).alias("end_line"), "chunk_index", "chunk_count")


def _route_of(methods: Column, paths: Column | None, path: Column, framework: str):
    """The k-th hit as a route; without a captured path the file's own stands."""
    return lambda h, k: F.struct(F.regexp_replace(F.upper(F.get(methods, k)), "MAPPING", "").alias("method"), (F.get(paths, k) if paths is not None else path).alias("route_path"), h["line"].alias("start_line"), F.lit(framework).alias("framework"))


def _symbol_of(kind: str):
    return lambda h: F.struct(F.lit(kind).alias("kind"), h["hit"].alias("name"), h["line"].alias("start_line"))


def _route_rows(content: Column, low: Column, path: Column) -> Column:
    out = []
    empty = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in (x.split(' ') for x in ROUTE.split(', ')))}>>")
    for framework, method, at, pattern in ROUTES:
        whole = hits(content, pattern, 0)
        methods = F.regexp_extract_all(content, F.lit(pattern), F.lit(method))
        paths = F.regexp_extract_all(content, F.lit(pattern), F.lit(at)) if at else None
        one = F.transform(whole, _route_of(methods, paths, path, framework))
        out.append(F.when(may_match(content, low, pattern), one).otherwise(empty))
    by_path = lambda cond, route, framework: F.when(cond, F.array(F.struct(F.lit("ANY").alias("method"), route.alias("route_path"), F.lit(1).alias("start_line"), F.lit(framework).alias("framework"))))
    slashed = F.concat(F.lit("/"), path)
    page = F.regexp_replace(F.regexp_replace(slashed, "^.*/(?:pages|app)/api", "/api"), r"\.[^.]+$", "")
    out.append(F.coalesce(by_path(matches(path, r"(^|/)(routes/web|routes/api)\.php$"), path, "laravel"), empty))
    out.append(F.coalesce(by_path(matches(path, r"(^|/)config/routes\.rb$"), path, "rails"), empty))
    out.append(F.coalesce(by_path(matches(slashed, "/pages/api/|/app/api/"), page, "nextjs"), empty))
    return F.concat(*out)


def _script(files: DataFrame) -> Column:
    """What the tokens of a script say (``javascript.facts``); for use in a select over ``files``."""
    ship(files.sparkSession)
    small_batches(files.sparkSession)
    return javascript.facts(F.col("path"), F.col("content"))


def script_facts(files: DataFrame) -> DataFrame:
    """path, imports, symbols and routes of JavaScript and TypeScript files, from their tokens alone."""
    return files.where(javascript.is_script(F.col("path"))).select("path", _script(files).alias("f")).where("f IS NOT NULL").select("path", "f.*")


def routes(files: DataFrame) -> DataFrame:
    """One row a route: the file's columns and ROUTE; ``k`` is the place in the file.

    Of a script first what its tokens say, then what patterns find, distinct and by line; of other
    files what patterns find, in the order of frameworks, then of the text.
    """
    said, low = fresh_name(files, "js"), fresh_name(files, "low")
    plain = lambda rs: F.transform(rs, lambda r: F.struct(r["start_line"].alias("start_line"), r["route_path"].alias("route_path"), r["framework"].alias("framework"), r["method"].alias("method")))
    both = F.concat(plain(F.col(said)["routes"]), plain(_route_rows(F.col("content"), F.col(low), F.col("path"))))
    sorted_ = F.transform(F.array_sort(F.array_distinct(both)), lambda r: F.struct(r["method"].alias("method"), r["route_path"].alias("route_path"), r["start_line"].alias("start_line"), r["framework"].alias("framework")))
    rows = files.withColumn(said, _script(files)).withColumn(low, F.lower("content")).select(*files.columns, F.posexplode(F.coalesce(sorted_, _route_rows(F.col("content"), F.col(low), F.col("path")))).alias("k", "r"))
    return rows.select(*files.columns, "k", "r.*")


# How languages name what they import and what they declare.
IMPORTS = (
    r"import\s+(?:[^'\";]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*from\s+([\w.]+)\s+import\b",
    r"(?m)^\s*import\s+([\w.]+)\s*(?:$|as\b|;|#)", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", r"(?m)^\s*use\s+([\w\\]+)\s*;",
)
SYMBOLS = (
    ("function", r"(?m)\bfunction\s+([A-Za-z_$][\w$]*)\s*\("), ("function", r"(?m)\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*=>"), ("class", r"(?m)\bclass\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"(?m)\binterface\s+([A-Za-z_$][\w$]*)"), ("type", r"(?m)^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="), ("enum", r"(?m)\benum\s+([A-Za-z_$][\w$]*)"), ("function", r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*[!?=]?)"),
    ("function", r"(?m)^func\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)\s*\("), ("struct", r"(?m)^type\s+([A-Za-z_]\w*)\s+struct\b"), ("module", r"(?m)^\s*module\s+([A-Z]\w*)"), ("function", r"(?m)\bfn\s+([A-Za-z_]\w*)\s*[(<]"),
    ("trait", r"(?m)\btrait\s+([A-Za-z_]\w*)"), ("method", r"(?m)^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\("),
)


def imports(files: DataFrame) -> DataFrame:
    """path, module: what each file imports, distinct: of scripts first what their tokens say, then by patterns, in order of the kinds of import."""
    said = fresh_name(files, "js")
    content, none = F.col("content"), F.array().cast("array<string>")
    # None of the patterns folds case, so that no text in lower case is needed.
    found = F.concat(*[F.when(may_match(content, content, p), F.regexp_extract_all(content, F.lit(p), F.lit(1))).otherwise(none) for p in IMPORTS])
    every = F.array_distinct(F.coalesce(F.concat(F.col(said)["imports"], found), found))
    return files.withColumn(said, _script(files)).select("path", F.posexplode(every).alias("k", "module"))


def symbols(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line; one row for each kind, name and line, by line. Tokens of scripts, and patterns for every language."""
    said = fresh_name(files, "js")
    plain = lambda ss: F.transform(ss, lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), s["start_line"].alias("start_line")))
    found = F.flatten(F.array(*[F.transform(hits(F.col("content"), p, 1), _symbol_of(kind)) for kind, p in SYMBOLS]))
    every = F.coalesce(F.concat(plain(F.col(said)["symbols"]), plain(found)), plain(found))
    return files.withColumn(said, _script(files)).select("path", F.explode(every).alias("s")).select("path", "s.kind", "s.name", "s.start_line").distinct()


def edges(files: DataFrame) -> DataFrame:
    """File-imports-module edges as stored: to_id stays null."""
    return imports(files).select(F.lit("file").alias("from_type"), F.col("path").alias("from_id"), F.lit("module").alias("to_type"), F.lit(None).cast("string").alias("to_id"), F.lit("imports").alias("edge_type"), F.to_json(F.struct("path", F.col("module").alias("imported"))).alias("metadata"))


def read_rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rules; unknown keys are ignored, missing ones are null."""
    kind = "id string, title string, severity string, category string, regex string, extensions array<string>, description string, fix string, cwe string, owasp string, confidence string, references array<string>"
    return spark.read.option("multiLine", True).schema(kind).json(path)


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")


@dataclass
class ProjectConfig:
    """A scan's project settings; names as in the configuration file, in snake case."""

    profile: str = "all"
    focus_paths: list[str] = field(default_factory=list)
    avoid_paths: list[str] = field(default_factory=list)
    vulnerability_classes: list[str] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    severity_overrides: dict[str, str] = field(default_factory=dict)
    report_filters: dict[str, str] = field(default_factory=dict)
    scanner_timeouts: dict[str, int] = field(default_factory=dict)
    fail_on: str = "none"
    incremental: bool = False
    extra: dict = field(default_factory=dict)


def _scalar(text: str):
    text = text.strip()
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_simple_yaml(text: str) -> dict:
    """The subset in use: scalars, block and inline lists, maps one level down; kebab-case keys become camelCase."""
    camel = lambda k: re.sub(r"-(\w)", lambda m: m[1].upper(), k.strip())
    out: dict = {}
    top = None
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        inner = body[0].isspace()
        item = re.match(r"\s*-\s+(.*)$", body)
        pair = re.match(r"\s*([^:]+):\s*(.*)$", body)
        if item and top is not None:
            if not isinstance(out.get(top), list):
                out[top] = []
            out[top].append(_scalar(item[1]))
        elif pair and inner and top is not None:
            if not isinstance(out.get(top), dict):
                out[top] = {}
            out[top][pair[1].strip()] = _scalar(pair[2])
        elif pair:
            top, value = camel(pair[1]), pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[top] = [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
            else:
                out[top] = _scalar(value) if value else None
    return out


def parse_config(text: str) -> ProjectConfig:
    """JSON or the YAML subset -> settings; keys that are not known stay in ``extra``."""
    found = json.loads(text) if text.lstrip().startswith("{") else parse_simple_yaml(text)
    config = ProjectConfig()
    for key, value in found.items():
        name = re.sub(r"(?<!^)([A-Z])", lambda m: "_" + m[1].lower(), key)
        if name != "extra" and hasattr(config, name):
            if value is not None:
                setattr(config, name, value)
        else:
            config.extra[name] = value
    return config


def changed_paths(spark: SparkSession, listing: str) -> DataFrame:
    """path of every line of a listing of changed files (one a line, as version control prints them); none if it is missing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(listing)
    except AnalysisException:
        return spark.createDataFrame([], "path string")
    return rows.select(normal_path(trim(F.col("value"))).alias("path")).where("path <> ''").distinct()


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files that a table of changed paths names."""
    named = changed.select(normal_path(F.col("path"), mount=True).alias("_p")).distinct()
    return files.withColumn("_n", normal_path(F.col("path"), mount=True)).join(named, F.col("_n") == F.col("_p"), "left_semi").drop("_n")


def missing_globs(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """Configured globs (field, pattern) that match no path: the preflight fails if there is one."""
    return globs.join(paths.select(normal_path(F.col("path"), root=True).alias("_p")), F.expr("_p = pattern OR startswith(_p, concat(rtrim('/', pattern), '/')) OR _p rlike regex"), "left_anti")


def glob_table(spark: SparkSession, field_name: str, globs: list[str]) -> DataFrame:
    rows = [(field_name, g, glob_pattern(g)) for g in globs]
    return spark.createDataFrame(rows, "field string, pattern string, regex string")


def path_aliases(files: DataFrame) -> DataFrame:
    """prefix, target of the path aliases in tsconfig and jsconfig files (JSON with comments)."""
    config = files.where(matches(F.col("path"), r"(^|/)(tsconfig|jsconfig)(\.[\w-]+)?\.json$"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[\s,{\[])//.*$", "$1"), r",(\s*[}\]])", "$1")
    parsed = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = config.select(folder.alias("_at"), F.coalesce(F.regexp_replace(parsed["baseUrl"], r"^\./?|/$", ""), F.lit("")).alias("_base"), F.explode(parsed["paths"]).alias("alias", "targets"))
    rows = rows.select("_at", "_base", "alias", F.explode("targets").alias("to"))
    base = F.concat("_at", F.when(F.col("_base").isin("", "."), "").otherwise(F.concat("_base", F.lit("/"))))
    return rows.select(F.regexp_replace("alias", r"\*$", "").alias("prefix"), F.concat(base, F.regexp_replace(F.regexp_replace("to", r"\*$", ""), r"^\./", "")).alias("target"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """path, package, version: direct dependencies of package.json, composer.json and Gemfile."""
    fields = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "require", "require-dev")
    maps = F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("content", f"$['{f}']"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for f in fields])
    jsons = files.where(matches(F.col("path"), r"(^|/)(package|composer)\.json$")).select("path", F.explode(maps).alias("package", "version"))
    gems = files.where(matches(F.col("path"), "(^|/)Gemfile$")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]"), F.lit(1))).alias("package"), F.lit(None).cast("string").alias("version"))
    return jsons.unionByName(gems)


def instructions(files: DataFrame, candidates: tuple[str, ...] = ("AI_INSTRUCTIONS.md", ".ai/instructions.md", "AGENTS.md", "docs/AI_INSTRUCTIONS.md", ".github/instructions.md"), most: int = 20_000) -> DataFrame:
    """The first candidate file that exists: path and its redacted head."""
    from siltstone.functions.text import redact

    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("path"))
    return files.where(F.col("path").isin(*candidates)).orderBy(place).limit(1).select("path", redact(F.substring("content", 1, most)).alias("content"))


