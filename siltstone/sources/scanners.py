"""Rows from the JSON reports of other scanners. Input: a table with ``stdout``, one report a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import first_of
from siltstone.functions.text import matches, mounted_path, redact
from siltstone.schemas import RESULTS, columns_of


def lenient_json(text: Column) -> Column:
    """A report as VARIANT: the whole text, else from its first brace to its last, else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(inner != "", inner)))


def _text(value: Column, *paths: str) -> Column:
    """The first of several paths that is there, as text."""
    return F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])


def _line(value: Column, *paths: str) -> Column:
    found = F.coalesce(*[F.try_variant_get(value, p, "int") for p in paths])
    return F.when(found != 0, found)


def _items(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.select("*", F.explode(F.try_variant_get(array, "$", "array<variant>")).alias(name))


def _level(value: Column, known: tuple[str, ...], other: str) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.isin(*known), low).otherwise(other)


def _rows(df: DataFrame, scanner: str, repo: str, **columns: Column) -> DataFrame:
    made = {"scanner": F.lit(scanner), "category": F.lit(None).cast("string"), "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"), "ord": F.monotonically_increasing_id(), **columns}
    made["path"] = mounted_path(F.coalesce(made["path"], F.lit("")), repo)
    return df.select(*[made[c].alias(c) for c in columns_of(RESULTS)])


def semgrep(reports: DataFrame, repo: str = "/repo") -> DataFrame:
    v = F.col("v")
    items = _items(reports.select(lenient_json(F.col("stdout")).alias("j")), F.try_variant_get("j", "$.results", "variant"), "v")
    severity = F.lower(F.coalesce(_text(v, "$.extra.severity"), F.lit("")))
    message = _text(v, "$.extra.message")
    return _rows(
        items, "semgrep", repo, rule_id=F.coalesce(_text(v, "$.check_id"), F.lit("semgrep")), title=F.coalesce(message, _text(v, "$.check_id"), F.lit("Semgrep finding")), severity=F.when(severity == "error", "high").when(severity == "warning", "medium").otherwise("low"),
        path=_text(v, "$.path"), start_line=_line(v, "$.start.line"), end_line=_line(v, "$.end.line"), message=F.coalesce(message, F.lit("")), raw=F.to_json(v),
    )


def gitleaks(reports: DataFrame, repo: str = "/repo") -> DataFrame:
    v = F.col("v")
    items = _items(reports.select(lenient_json(F.col("stdout")).alias("j")), F.col("j"), "v")
    raw = F.to_json(F.struct(_text(v, "$.RuleID").alias("RuleID"), _text(v, "$.File").alias("File"), _line(v, "$.StartLine").alias("StartLine"), _line(v, "$.EndLine").alias("EndLine"), _text(v, "$.Description").alias("Description"), redact(F.coalesce(_text(v, "$.Match"), F.lit(""))).alias("Match"), F.lit("[REDACTED]").alias("Secret")))
    return _rows(
        items, "gitleaks", repo, rule_id=F.coalesce(_text(v, "$.RuleID"), F.lit("secret")), title=F.lit("Secret detected"), category=F.lit("secrets"), severity=F.lit("high"), path=_text(v, "$.File"), start_line=_line(v, "$.StartLine"), end_line=_line(v, "$.EndLine"),
        message=redact(F.coalesce(_text(v, "$.Description"), F.lit("Secret candidate detected"))), raw=raw,
    )


_LEVELS = ("critical", "high", "medium", "low")


def trivy(reports: DataFrame, repo: str = "/repo") -> DataFrame:
    """Vulnerabilities, secrets and misconfigurations of every target."""
    sections = _items(reports.select(lenient_json(F.col("stdout")).alias("j")), F.try_variant_get("j", "$.Results", "variant"), "s")
    part = lambda name: _items(sections, F.try_variant_get("s", f"$.{name}", "variant"), "v")
    v, target = F.col("v"), _text(F.col("s"), "$.Target")
    common = {"severity": _level(_text(v, "$.Severity"), _LEVELS, "info"), "path": target, "raw": F.to_json(v)}
    vulnerable = _rows(part("Vulnerabilities"), "trivy", repo, rule_id=_text(v, "$.VulnerabilityID"), title=_text(v, "$.Title", "$.VulnerabilityID"), category=F.lit("dependency"), message=F.coalesce(_text(v, "$.Description"), F.lit("")), **common)
    secret = _rows(part("Secrets"), "trivy", repo, rule_id=_text(v, "$.RuleID"), title=F.coalesce(_text(v, "$.Title"), F.lit("Secret detected")), category=F.lit("secrets"), start_line=_line(v, "$.StartLine"), end_line=_line(v, "$.EndLine"), message=F.coalesce(_text(v, "$.Title"), F.lit("")), **common)
    wrong = _rows(part("Misconfigurations"), "trivy", repo, rule_id=_text(v, "$.ID"), title=_text(v, "$.Title", "$.ID"), category=F.lit("misconfiguration"), message=F.coalesce(_text(v, "$.Message", "$.Description"), F.lit("")), **common)
    return vulnerable.unionByName(secret).unionByName(wrong)


def osv(reports: DataFrame) -> DataFrame:
    results = _items(reports.select(lenient_json(F.col("stdout")).alias("j")), F.try_variant_get("j", "$.results", "variant"), "r")
    packages = _items(results, F.try_variant_get("r", "$.packages", "variant"), "p")
    items = _items(packages, F.try_variant_get("p", "$.vulnerabilities", "variant"), "v")
    v, name = F.col("v"), F.coalesce(_text(F.col("p"), "$.package.name", "$.package.purl", "$.name"), F.lit("unknown"))
    raw = F.regexp_replace(F.to_json(v), r"\}$", "")
    raw = F.concat(raw, F.when(raw == "{", "").otherwise(","), F.lit('"PkgName":'), F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"')), F.lit("}"))
    return _rows(items, "osv-scanner", "/repo", rule_id=_text(v, "$.id"), title=_text(v, "$.summary", "$.id"), category=F.lit("dependency"), severity=F.lit("high"), path=_text(F.col("r"), "$.source.path"), message=F.coalesce(_text(v, "$.summary"), F.lit("")), raw=raw)


_BUCKETS = (*_LEVELS, "warning")
#: How deep a report may lie inside reports.
_DEPTH = 3


def bearer(reports: DataFrame, repo: str = "/repo") -> DataFrame:
    """A report of any of its shapes: an array, a list under findings, results or issues, lists by severity, or a report in a report."""
    parsed = reports.select(lenient_json(F.col("stdout")).alias("j"))
    array = lambda v, path="$": F.try_variant_get(v, path, "array<variant>")
    tag = lambda items, level: F.transform(items, lambda v: F.struct(v.alias("v"), F.lit(level).alias("level")))
    empty = F.array().cast("array<struct<v:variant,level:string>>")

    def shapes(v: Column, depth: int) -> Column:
        plain = [tag(array(v, p), None) for p in ("$", "$.findings", "$.results", "$.issues")]
        plain = [x.cast("array<struct<v:variant,level:string>>") for x in plain]
        lists = F.concat(*[F.coalesce(tag(array(v, f"$.{b}"), b), empty) for b in _BUCKETS])
        deeper = shapes(F.try_variant_get(v, "$.report", "variant"), depth - 1) if depth else F.lit(None)
        return F.coalesce(*plain, F.when(F.size(lists) > 0, lists), deeper)

    items = parsed.select(F.explode(shapes(F.col("j"), _DEPTH)).alias("i")).select("i.v", "i.level")
    v = F.col("v")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(_text(v, p), F.lit("")) for p in ("$.category", "$.rule.category", "$.title", "$.description")]))
    # Categories by the report's words, in this order.
    category = first_of([(matches(text, "secret|token|key|credential"), "secrets"), (matches(text, "sql|injection|command"), "injection"), (matches(text, "xss|html|cross-site"), "xss"), (matches(text, "ssrf|request|url"), "ssrf"), (matches(text, "privacy|pii|data"), "privacy"), (matches(text, "crypto|encrypt|hash"), "weak-crypto")], "security")
    level = F.lower(F.coalesce(_text(v, "$.severity"), F.col("level"), _text(v, "$.level", "$.impact"), F.lit("")))
    return _rows(
        items, "bearer", repo, rule_id=F.coalesce(_text(v, "$.rule_id", "$.ruleId", "$.id", "$.check_id"), F.lit("bearer")), title=F.coalesce(_text(v, "$.title", "$.message", "$.description", "$.rule.title"), F.lit("Bearer finding")), category=category,
        severity=F.when(level.isin(*_LEVELS), level).when(level == "warning", "low").otherwise("info"), path=_text(v, "$.filename", "$.file", "$.path", "$.location.filename", "$.location.file"),
        start_line=_line(v, "$.line_number", "$.line", "$.start_line", "$.location.line_number", "$.location.line"), end_line=_line(v, "$.end_line", "$.location.end_line", "$.line_number", "$.line"),
        message=F.coalesce(_text(v, "$.description", "$.message", "$.title"), F.lit("Bearer finding")), raw=F.to_json(v),
    )


ADAPTERS = {"semgrep": semgrep, "gitleaks": gitleaks, "trivy": trivy, "osv-scanner": osv, "bearer": bearer}
