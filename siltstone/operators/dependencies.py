"""Whether code uses a vulnerable package, and which of its functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import dependency_impact, dependency_result
from siltstone.functions.text import explode_lines, matches, package_name, slug, trim
from siltstone.operators.core import first_wins, top_per_key
from siltstone.schemas import RESULTS, columns_of

_SOURCE_FILE = r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|py|php|rb|go|java|cs)$"
# Functions by package and by what a report says. (package, words, functions)
API_HINTS = (
    (r"(?i)^lodash(?:$|/)", r"(?i)\b(template|prototype|pollution|command|code execution|rce)\b", ("template", "merge", "defaultsDeep", "zipObjectDeep", "set")),
    (r"(?i)^(js-yaml|yaml)$", r"(?i)\b(load|deserialize|schema|code execution|rce)\b", ("load", "safeLoad", "parse")),
    (r"(?i)^eta$", r"(?i)\b(render|compile|template|rce|prototype)\b", ("render", "compile", "renderFile")),
    (r"(?i)^(handlebars|mustache|ejs|pug)$", r"(?i)\b(render|compile|template|prototype|rce)\b", ("render", "compile", "renderFile")),
    (r"(?i)^(axios|node-fetch|request|got)$", r"(?i)\b(ssrf|redirect|proxy|url)\b", ("get", "post", "request", "fetch")),
    (r"(?i)^(express-fileupload|multer|formidable)$", r"(?i)\b(upload|path traversal|file|dos)\b", ("mv", "single", "array", "fields", "parse")),
)
_NAMED_API = r"(?i)\b(?:function|method|api|call|sink)\s*[:=]\s*['\"`]?([A-Za-z_$][\w$-]*)"


def vulnerable_apis(package: Column, text: Column) -> Column:
    """Functions that a report on a package speaks of, eight at most."""
    parts = []
    for pkg, words, apis in API_HINTS:
        said = [F.lit(a) if len(apis) <= 3 else F.when(matches(text, rf"(?i)\b{a}\b"), F.lit(a)) for a in apis]
        parts.append(F.when(matches(package, pkg) & matches(text, words), F.array_compact(F.array(*said))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(*parts, F.regexp_extract_all(text, F.lit(_NAMED_API), F.lit(1)))), 1, 8)


def _package(specifier: Column) -> Column:
    """The package of an import: its first part, two for a scoped name; null for a relative one."""
    parts = F.split(specifier, "/")
    name = F.when(specifier.startswith("@"), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    return F.when(~specifier.startswith("."), name)


def package_lines(files: DataFrame) -> DataFrame:
    """path, line, code, package of every line that imports one. Parsed once for all packages."""
    rows = explode_lines(files.where(matches(F.col("path"), _SOURCE_FILE)))
    quoted = r"(?:\bfrom\s+|\bimport\s*\(\s*|\bimport\s+|\brequire\s*\(\s*)[\"']([^\"']+)[\"']"
    hit = rows.where(matches(F.col("line"), quoted)).select("path", "ord", (F.col("i") + 1).alias("line_no"), F.substring(trim(F.col("line")), 1, 220).alias("code"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(quoted), F.lit(1)))).alias("specifier"))
    return hit.select("path", "ord", F.col("line_no").alias("line"), "code", _package(F.col("specifier")).alias("package")).where("package IS NOT NULL").distinct()


def _import_of(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["l"].alias("l"), x["s"].alias("s"))


def bindings(files: DataFrame) -> DataFrame:
    """path, package, kind (default, namespace, require or named), local and imported name of every import."""
    name, spec = r"([A-Za-z_$][\w$]*)", r"[\"']([^\"']+)[\"']"
    kinds = (("default", rf"import\s+{name}\s+from\s+{spec}"), ("namespace", rf"import\s+\*\s+as\s+{name}\s+from\s+{spec}"), ("require", rf"(?:const|let|var)\s+{name}\s*=\s*require\({spec}\)"), ("named-import", rf"import\s+\{{([^}}]+)\}}\s+from\s+{spec}"), ("named-require", rf"(?:const|let|var)\s+\{{([^}}]+)\}}\s*=\s*require\({spec}\)"))
    found = [F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("l"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("s")), _import_of(k)) for k, p in kinds]
    rows = files.where(matches(F.col("path"), _SOURCE_FILE)).select("path", F.explode(F.concat(*found)).alias("b")).select("path", "b.*")
    many = F.col("kind").startswith("named")
    parts = F.when(many, F.filter(F.transform(F.split("l", ","), trim), lambda x: x != "")).otherwise(F.array("l"))
    each = rows.select("path", _package(F.col("s")).alias("package"), "kind", F.explode(parts).alias("part")).where("package IS NOT NULL")
    pair = F.when(F.col("kind") == "named-import", F.split("part", r"(?i)\s+as\s+")).when(F.col("kind") == "named-require", F.split("part", r"\s*:\s*")).otherwise(F.array("part"))
    return each.select("path", "package", F.when(many, "named").otherwise(F.col("kind")).alias("kind"), trim(F.element_at(pair, -1)).alias("local"), trim(pair[0]).alias("imported"))


def api_calls(files: DataFrame) -> DataFrame:
    """path, line, code, package, api of every call of an imported name: bindings meet calls by file and name."""
    rows = explode_lines(files.where(matches(F.col("path"), _SOURCE_FILE)))
    call = r"\b([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?\s*\("
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(call), F.lit(1)).alias("o"), F.regexp_extract_all("line", F.lit(call), F.lit(2)).alias("m"))
    calls = rows.select("path", "ord", (F.col("i") + 1).alias("line_no"), F.substring(trim(F.col("line")), 1, 220).alias("code"), F.explode(F.array_distinct(pairs)).alias("c"))
    joined = calls.join(bindings(files), "path").where((F.col("c.o") == F.col("local")) & (((F.col("kind") == "named") & (F.col("c.m") == "")) | ((F.col("kind") != "named") & (F.col("c.m") != ""))))
    return joined.select("path", "ord", F.col("line_no").alias("line"), "code", "package", F.when(F.col("kind") == "named", F.col("imported")).otherwise(F.col("c.m")).alias("api")).distinct()


def vulnerabilities(results: DataFrame) -> DataFrame:
    """Results of package scanners with ``package``, ``apis`` and ``impact``."""
    text = F.concat_ws(" ", "rule_id", "title", "message", F.coalesce("raw", F.lit("{}")))
    rows = results.where(dependency_result(F.col("scanner"), F.col("rule_id"), F.col("raw"))).withColumn("package", package_name(F.col("raw"), F.col("title")))
    return rows.withColumn("apis", vulnerable_apis(F.col("package"), text)).withColumn("impact", dependency_impact(text))


def reachability(files: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """Every vulnerability with its usage: status, confidence, package_usages and api_usages (the first of each)."""
    v = vulnerabilities(results)
    usage = lambda api: F.struct("path", "line", "code", api.alias("api"))
    gather = lambda df, keys, name: top_per_key(df, keys, [F.col("u_ord"), F.col("u.line"), F.col("u.api")], most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("u_ord", F.col("u.line").alias("l"), F.col("u.api").alias("a"), "u"))), lambda s: s["u"]).alias(name))
    imported = gather(package_lines(files).select("package", F.col("ord").alias("u_ord"), usage(F.lit(None).cast("string")).alias("u")), ["package"], "package_usages")
    wanted = v.select(F.col("ord").alias("v"), "package", F.explode("apis").alias("api"))
    called = api_calls(files).select(F.col("package").alias("p"), F.col("api").alias("a"), F.col("ord").alias("u_ord"), usage(F.col("api")).alias("u"))
    used = gather(wanted.join(called, (F.col("package") == F.col("p")) & (F.col("api") == F.col("a"))).select("v", "u_ord", "u"), ["v"], "api_usages")
    joined = v.join(imported, "package", "left").join(used, F.col("ord") == F.col("v"), "left").drop("v")
    status = F.when(F.size("api_usages") > 0, "vulnerable-api-reachable").when(F.size("package_usages") > 0, "package-imported").otherwise("not-reachable")
    return joined.withColumn("status", status).withColumn("confidence", F.when(status == "vulnerable-api-reachable", "high").when(status == "package-imported", "medium").otherwise("low"))


def reachable_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """A correlation result for each vulnerability whose package or function the code uses."""
    rows = reachability(files, results).where("status <> 'not-reachable' AND package <> 'unknown'")
    exact = F.col("status") == "vulnerable-api-reachable"
    usages = F.when(exact, F.col("api_usages")).otherwise(F.col("package_usages"))
    first, api = usages[0], F.get("api_usages", F.lit(0))["api"]
    pkg = slug(F.col("package"), "dependency")
    rule = F.when(exact, F.concat(F.lit("reachable-vulnerable-api-"), pkg, F.lit("-"), slug(api, "dependency"))).otherwise(F.concat(F.lit("reachable-"), "impact", F.lit("-"), pkg))
    title = F.when(exact, F.concat(F.lit("Reachable vulnerable API: "), "package", F.lit("."), api)).otherwise(F.concat(F.lit("Reachable vulnerable dependency: "), "package"))
    message = F.concat(F.lit("Dependency scanner reported "), "package", F.when(exact, F.concat(F.lit(", and indexed source calls vulnerable API "), api, F.lit("."))).otherwise(F.lit(", and indexed source imports or references it.")))
    evidence = F.concat(F.array(F.struct("path", F.col("start_line").alias("line"), F.concat(F.col("scanner"), F.lit("/"), F.col("rule_id"), F.lit(": "), F.col("title")).alias("note"))), F.transform(F.slice(usages, 1, 4), lambda u: F.struct(u["path"].alias("path"), u["line"].alias("line"), u["code"].alias("note"))))
    chain = F.struct(F.when(exact, "reachable-vulnerable-api").otherwise("reachable-vulnerable-dependency").alias("kind"), F.when(exact, "high").otherwise("medium").alias("confidence"))
    raw = F.to_json(F.struct(chain.alias("attackChain"), evidence.alias("evidence"), F.array(F.struct("scanner", "rule_id", "title", "category", "severity", "path", "start_line")).alias("relatedFindings")))
    made = {"scanner": F.lit("correlation"), "rule_id": rule, "title": title, "category": F.when(F.col("impact") == "rce", "rce").otherwise("dependency-reachability"), "severity": F.col("severity"), "path": first["path"], "start_line": first["line"], "end_line": first["line"], "message": message, "raw": raw, "ord": F.col("ord")}
    out = rows.select(*[made[c].alias(c) for c in columns_of(RESULTS)])
    return first_wins(out, ["rule_id", "path", "start_line"])


def package_rollup(results: DataFrame, direct: DataFrame, used: DataFrame) -> DataFrame:
    """One row a package: ids, titles, greatest severity, whether it is declared and used, and a score of 0 to 100."""
    from siltstone.schemas import SEVERITIES, rank

    v = vulnerabilities(results)
    rows = v.groupBy("package").agg(F.array_sort(F.collect_set("rule_id")).alias("ids"), F.array_sort(F.collect_set("title")).alias("titles"), F.min(rank(F.col("severity"), SEVERITIES)).alias("_r"), F.count(F.lit(1)).alias("n"))
    flag = lambda df, name: df.select("package").distinct().withColumn(name, F.lit(True))
    joined = rows.join(flag(direct, "direct"), "package", "left").join(flag(used, "used"), "package", "left").fillna(False, ["direct", "used"])
    base = F.get(F.array(*[F.lit(x) for x in (80, 65, 45, 20, 5)]), F.coalesce("_r", F.lit(4)))
    score = base + F.when(F.col("direct"), 10).otherwise(0) + F.when(F.col("used"), 15).otherwise(-10)
    return joined.withColumn("severity", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("_r"))).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score))).drop("_r").orderBy(F.col("score").desc(), "package")
