"""What is kept of the results: project policy, scan scope, suppressions, thresholds and exit codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import allowed_by_profile, dependency_result, matches_classes
from siltstone.functions.text import explode_lines, matches, normal_path, or_empty
from siltstone.operators.core import range_state
from siltstone.schemas import SEVERITIES, rank


def drop_disabled(results: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rows whose rule (``rule_id`` or ``scanner/rule_id``) is not in the table ``rule``."""
    d = disabled.select(F.col("rule").alias("_rule")).distinct()
    return results.join(d, (F.col("rule_id") == F.col("_rule")) | (F.concat_ws("/", "scanner", "rule_id") == F.col("_rule")), "left_anti")


def override_severity(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severity by rule_id, else by scanner/rule_id, from the table (rule, severity)."""
    o = lambda n: overrides.select(F.col("rule").alias(f"_r{n}"), F.col("severity").alias(f"_s{n}"))
    joined = results.join(o(1), F.col("rule_id") == F.col("_r1"), "left").join(o(2), F.concat_ws("/", "scanner", "rule_id") == F.col("_r2"), "left")
    return joined.withColumn("severity", F.coalesce("_s1", "_s2", "severity")).select(*results.columns)


def project_policy(results: DataFrame, disabled: list[str], overrides: dict[str, str], profile: str = "all") -> DataFrame:
    """The same for a project's own short lists, as literals: no join."""
    either = lambda names: F.col("rule_id").isin(names) | F.concat_ws("/", "scanner", "rule_id").isin(names)
    kept = results.where(~either(disabled)) if disabled else results
    kept = kept.where(allowed_by_profile(profile))
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        kept = kept.withColumn("severity", F.coalesce(F.try_element_at(table, F.col("rule_id")), F.try_element_at(table, F.concat_ws("/", "scanner", "rule_id")), F.col("severity")))
    return kept


def in_scope(results: DataFrame, files: DataFrame) -> DataFrame:
    """Rows without a path, and those whose path is indexed."""
    known = files.select(normal_path(F.col("path"), mount=True).alias("_p")).distinct()
    located = results.where(or_empty(F.col("path")) != "").withColumn("_n", normal_path(F.col("path"), mount=True)).join(known, F.col("_n") == F.col("_p"), "left_semi").drop("_n")
    return results.where(or_empty(F.col("path")) == "").unionByName(located)


def ignore_match(path: Column, pattern: str) -> Column:
    """Whether an ignore pattern covers a path: folder/, a * glob, or a file or folder by name."""
    clean = pattern.replace("\\", "/").lstrip("/")
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if clean.endswith("/"):
        return p.startswith(clean)
    if "*" in clean:
        return matches(p, "^" + ".*".join(map(re.escape, clean.split("*"))) + "$")
    return (p == clean) | p.startswith(f"{clean}/") | p.endswith(f"/{clean}")


def suppress(results: DataFrame, files: DataFrame, ignore: list[str] = (), marker: str = "audit", ignore_file: str = ".auditignore") -> DataFrame:
    """Adds ``suppressed``, the reason for which a row is suppressed, or null.

    In order: an ignored path; a ``<marker>:disable RULE`` that no ``:enable`` ended at the row's
    line (RULE, all or *); ``<marker>-disable-next-line`` above; ``<marker>-disable-line`` on it.
    Results meet only the lines that carry the marker.
    """
    m = re.escape(marker)
    by_path = F.lit(False)
    for pattern in ignore:
        by_path = by_path | ignore_match(or_empty(F.col("path")), pattern)
    # Few files carry the marker: a search for a plain text spares the others the cut into lines.
    low = F.lower("content")
    carries = low.contains(f"{marker.lower()}:") | low.contains(f"{marker.lower()}-disable") if marker.isascii() else F.lit(True)
    marked = explode_lines(files.select("path", "content").where(carries)).select("path", (F.col("i") + 1).alias("line"), F.col("line").alias("body"))
    marked = marked.where(matches(F.col("body"), f"(?i){m}(:|-disable)"))
    token = lambda kind: F.regexp_extract("body", rf"(?i){m}:{kind}\s+([A-Za-z0-9_./*-]+)", 1)
    both = F.array(F.struct(token("disable").alias("rule"), F.lit(True).alias("on"), F.lit(0).alias("nth")), F.struct(token("enable").alias("rule"), F.lit(False).alias("on"), F.lit(1).alias("nth")))
    events = marked.select("path", "line", F.explode(both).alias("e")).select("path", "line", "e.*").where("rule <> ''")
    # On one line a disable comes before an enable of the same rule.
    events = events.groupBy("path", "line", "rule").agg(F.max_by("on", "nth").alias("on")).select(F.concat_ws("\n", "path", "rule").alias("_pr"), "line", "on")
    rows = results.withColumn("_row", F.struct(*[F.col(c) for c in results.columns])).where("start_line IS NOT NULL AND start_line > 0 AND path IS NOT NULL")
    tokens = F.explode(F.array(F.col("rule_id"), F.lit("all"), F.lit("*")))
    points = rows.select("_row", "start_line", tokens.alias("_token"), "path").withColumn("_pr", F.concat_ws("\n", "path", "_token"))
    held = range_state(points, events, "_pr", "start_line").groupBy("_row").agg(F.bool_or(F.coalesce("state", F.lit(False))).alias("_range"))
    low, rule = F.lower("body"), F.lower("rule_id")
    says = lambda word: low.contains(f"{marker.lower()}-disable-{word}") & (low.contains(rule) | low.contains(" all") | matches(F.col("body"), rf"(?i){m}-disable-(?:next-)?line\s*($|--|#|//)"))
    near = rows.select("_row", "path", "rule_id", "start_line").join(marked, "path").where(F.col("line").between(F.greatest(F.col("start_line") - 1, F.lit(1)), F.col("start_line")))
    above = F.col("line") == F.greatest(F.col("start_line") - 1, F.lit(1))
    inline = near.groupBy("_row").agg(F.bool_or(above & says("next-line")).alias("_prev"), F.bool_or((F.col("line") == F.col("start_line")) & says("line")).alias("_same"))
    keyed = results.withColumn("_row", F.struct(*[F.col(c) for c in results.columns]))
    tagged = keyed.join(held, "_row", "left").join(inline, "_row", "left")
    at = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"))
    say = lambda text, where: F.concat(F.col("rule_id"), F.lit(f" {text} at "), where)
    reason = F.when(by_path, say(f"ignored by {ignore_file}", F.col("path"))).when(F.col("_range"), say("suppressed by disable/enable block", at)).when(F.col("_prev"), say("suppressed by previous-line comment", at)).when(F.col("_same"), say("suppressed by same-line comment", at))
    return tagged.withColumn("suppressed", reason).drop("_row", "_range", "_prev", "_same")


def suppression_summary(tagged: DataFrame, most: int = 100) -> DataFrame:
    """suppressed (how many) and the first reasons in order."""
    hit = tagged.where("suppressed IS NOT NULL")
    few = hit.orderBy("ord").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "suppressed"))), lambda s: s["suppressed"]).alias("reasons"))
    return hit.agg(F.count(F.lit(1)).alias("suppressed")).crossJoin(few)


def review_candidates(results: DataFrame, classes: list[str] = ()) -> DataFrame:
    """Results worth a review: at least medium, from code scanners, of the classes asked for."""
    kept = F.col("severity").isin("critical", "high", "medium") & ~F.col("scanner").isin("quality", "compliance") & ~dependency_result(F.col("scanner"), F.col("rule_id"), F.col("raw"))
    return results.where(kept & matches_classes(list(classes)))


def active(findings: DataFrame) -> DataFrame:
    return findings.where("status <> 'false_positive' AND category <> 'dependency'")


def exit_code(findings: DataFrame, fail_on: str, include_false_positives: bool = True) -> DataFrame:
    """One row: 2 if any finding is at or above the severity, else 0."""
    rows = findings if include_false_positives else findings.where("status <> 'false_positive'")
    hit = F.lit(False) if fail_on not in SEVERITIES else F.coalesce(rank(F.col("severity"), SEVERITIES) <= SEVERITIES.index(fail_on), F.lit(False))
    return rows.agg(F.when(F.coalesce(F.bool_or(hit), F.lit(False)), 2).otherwise(0).alias("exit_code"))


def allowed_requests(actions: DataFrame, executables: list[str], hosts: list[str], methods: list[str] = ("GET", "HEAD", "OPTIONS")) -> DataFrame:
    """Adds ``allowed`` to (executable, url, method): allow-lists as data; nothing is executed."""
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    ok = F.coalesce(F.col("executable").isin(executables), F.col("executable").isNull()) & (F.col("url").isNull() | (F.coalesce(host.isin([h.lower() for h in hosts]), F.lit(False)) & F.upper("method").isin(list(methods))))
    return actions.withColumn("allowed", F.coalesce(ok, F.lit(False)))
