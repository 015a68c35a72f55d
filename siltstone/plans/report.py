"""Report queries and their renderings: JSON, SARIF, CI annotations, rules, and tables for Markdown or HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.classify import SCANNER_WEIGHT, SEVERITY_WEIGHT, first_of
from siltstone.functions.text import html_escape, lines, numbered, or_empty, slug, table_cell, yaml_quote
from siltstone.operators import dependencies, intelligence, modelio
from siltstone.operators.audit import Round
from siltstone.operators.core import count_by, count_over, examples, first_wins
from siltstone.operators.policy import active, suppression_summary
from siltstone.schemas import SEVERITIES, rank, score
from siltstone.sources.files import ProjectConfig, manifest_dependencies

# Scanners that a report always lists.
SCANNERS = ("custom-rules", "source-patterns", "taint-lite", "taint-flow", "business-invariants", "config-checks", "quality", "compliance", "correlation", "semgrep", "gitleaks", "trivy", "osv-scanner", "bearer")
#: Rows that a report's table shows.
SHOWN = 500
_LEVEL = {"critical": "error", "high": "error", "medium": "warning"}


def health(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row (or one for each value of ``keys``), 100 less each finding's weight times how sure it is, at least 0; 100 without findings."""
    weight = score(F.col("severity"), {"critical": 25, "high": 12, "medium": 5, "low": 2, "info": 0}, 1)
    # Tenths as whole numbers: a sum of doubles depends on its order and may miss a half that is to be rounded up.
    tenths = F.when(F.col("status") == "false_positive", 0).when(F.col("status").isin("confirmed", "confirmed_true_positive"), 10).when(F.col("status") == "likely_true_positive", 8).otherwise(5)
    lost = F.coalesce(F.sum(weight.cast("long") * tenths), F.lit(0))
    return findings.groupBy(*keys).agg(F.floor(F.greatest(F.lit(0), 1005 - lost) / 10).cast("int").alias("health"))


def severity_share(findings: DataFrame) -> DataFrame:
    rows = count_by(findings, F.col("severity"), "severity")
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def scanner_counts(results: DataFrame) -> DataFrame:
    return count_over(results, "scanner", list(SCANNERS))


def status_buckets(findings: DataFrame) -> DataFrame:
    kind = F.when(F.col("status").isin("confirmed", "confirmed_true_positive", "likely_true_positive"), "confirmed").when(F.col("status").isin("needs_dynamic_test", "security_hotspot", "needs_context"), "needs_dynamic").when(F.col("status") == "suspected", "suspected").otherwise("other")
    return count_by(findings, kind, "bucket")


def additional_results(results: DataFrame, findings: DataFrame, most: int | None = None) -> DataFrame:
    """Groups of results that no finding stands for, by scanner, rule, severity and path, with three examples; the first ``most``, if it is given."""
    seen = findings.select(or_empty(F.col("path")).alias("_p"), or_empty(F.col("start_line")).alias("_l")).distinct()
    left = results.join(seen, (or_empty(F.col("path")) == F.col("_p")) & (or_empty(F.col("start_line")) == F.col("_l")), "left_anti")
    groups = examples(left, ["scanner", "rule_id", "severity", "path"], F.struct("start_line", "message"))
    weight = score(F.col("severity"), {k: v // 10 for k, v in SEVERITY_WEIGHT.items()}, 0) + score(F.col("scanner"), SCANNER_WEIGHT, 0)
    ordered = groups.orderBy(weight.desc(), F.col("n").desc(), "first_order")
    return ordered.limit(most) if most else ordered


def noise_bucket(results: DataFrame, most: int = 20) -> DataFrame:
    rows = results.where("severity IN ('low', 'info') OR scanner = 'quality'")
    return rows.groupBy("scanner", "rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "scanner", "rule_id").limit(most)


def compliance_counts(results: DataFrame) -> DataFrame:
    status = F.get_json_object("raw", "$.status")
    rows = results.where("scanner = 'compliance'")
    return rows.agg(*[F.count_if(status == s).alias(s) for s in ("pass", "fail", "unknown")])


def compliance_table(results: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("raw", f"$.{p}")
    evidence = F.from_json(get("evidence"), "array<struct<path:string,line:int,note:string>>")
    return results.where("scanner = 'compliance'").select("rule_id", get("status").alias("status"), F.from_json(get("controlIds"), "array<string>").alias("controls"), F.slice(evidence, 1, 3).alias("evidence"), get("remediation").alias("remediation"))


def attack_chains(results: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("raw", f"$.attackChain.{p}")
    return results.where("scanner = 'correlation'").select("rule_id", "title", "severity", "path", "start_line", get("kind").alias("kind"), get("confidence").alias("confidence"), "ord")


def report_score() -> Column:
    """Order in which a report lists findings: severity, confidence, status, then whether they have a place, 0 to 100."""
    out = score(F.col("severity"), {"critical": 60, "high": 45, "medium": 25, "low": 10, "info": 0}, 10) + score(F.col("confidence"), {"confirmed": 20, "high": 15, "medium": 8, "low": 0}, 0)
    out = out + score(F.col("status"), {"confirmed_true_positive": 20, "confirmed": 18, "likely_true_positive": 12, "false_positive": -100}, 5)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("exploitability_score"), out)))


def fix_first(findings: DataFrame, most: int = 10) -> DataFrame:
    return active(findings).withColumn("score", report_score()).orderBy(F.col("score").desc(), "ord").limit(most)


def top_fixes(findings: DataFrame, packages: DataFrame, least: int = 60, most: int = 5) -> DataFrame:
    """Code and packages to fix, together, at or above a score."""
    code = active(findings).select(F.lit("code").alias("kind"), F.col("title").alias("name"), report_score().alias("score"))
    deps = packages.select(F.lit("dependency").alias("kind"), F.col("package").alias("name"), "score")
    return code.unionByName(deps).where(F.col("score") >= least).orderBy(F.col("score").desc(), "kind", "name").limit(most)


def action_plan(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """fix-now (8), upgrade (5) and validate rows."""
    ranked = active(findings).withColumn("score", report_score())
    now = ranked.where("severity IN ('critical', 'high') AND confidence IN ('confirmed', 'high')").orderBy(F.col("score").desc(), "ord").limit(8).select(F.lit("fix-now").alias("action"), "title", "score")
    later = ranked.where("confidence IN ('medium', 'low')").orderBy(F.col("score").desc(), "ord").limit(8).select(F.lit("validate").alias("action"), "title", "score")
    upgrade = packages.orderBy(F.col("score").desc(), "package").limit(5).select(F.lit("upgrade").alias("action"), F.col("package").alias("title"), "score")
    return now.unionByName(upgrade).unionByName(later)


def snippets(findings: DataFrame, files: DataFrame, around: int = 4) -> DataFrame:
    """Each finding with its numbered lines."""
    text = files.select(F.col("path").alias("_p"), lines(F.col("content")).alias("_ls"))
    joined = findings.join(text, F.col("path") == F.col("_p"), "left")
    first = F.greatest(F.col("start_line") - around, F.lit(1))
    cut = F.slice("_ls", first, F.greatest(F.least(F.col("start_line") + around, F.size("_ls")) - first + 1, F.lit(0)))
    return joined.withColumn("snippet", F.when(F.col("_ls").isNotNull() & (F.col("start_line") > 0), numbered(cut, first, 5))).drop("_p", "_ls")


#: Rows that one document holds, about.
DOCUMENT_ROWS = 50_000


def _blocks(df: DataFrame, blocks: int) -> DataFrame:
    """The rows with ``block``, equal shares by a hash of their order."""
    return df.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int"))


def json_report(tables: dict[str, DataFrame], rows: int = DOCUMENT_ROWS) -> DataFrame:
    """block, document: every table as an array; one document, or as many as keep about ``rows`` rows of each table.

    Tables with a column ``ord`` are dealt by it and listed in its order, others go into the first document.
    """
    blocks = max(1, *(-(-df.count() // rows) for df in tables.values() if "ord" in df.columns), 1)
    out = tables[next(iter(tables))].sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    for name, df in tables.items():
        row = F.struct(*[F.col(c) for c in df.columns])
        dealt = _blocks(df, blocks) if "ord" in df.columns else df.withColumn("block", F.lit(0))
        listed = F.collect_list(F.struct(F.col("ord").alias("o"), row.alias("r"))) if "ord" in df.columns else F.collect_list(F.struct(F.lit(0).alias("o"), row.alias("r")))
        one = dealt.groupBy("block").agg(F.transform(F.array_sort(listed), lambda s: s["r"]).alias(name))
        empty = F.array().cast(one.schema[name].dataType)
        out = out.join(one, "block", "left").withColumn(name, F.coalesce(name, empty))
    return out.select("block", F.to_json(F.struct(*[F.col(n) for n in tables])).alias("document"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, level, message, fingerprint, uri, line: a row for each result of a SARIF run."""
    rule = F.coalesce(F.nullif(or_empty(F.col("sink")), F.lit("")), slug(F.col("category"), "security"))
    return findings.select(rule.alias("rule_id"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _LEVEL.items() for x in kv]), F.col("severity")), F.lit("note")).alias("level"), F.col("title"), F.col("reasoning").alias("message"), "fingerprint", F.col("path").alias("uri"), F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("line"), F.greatest(F.coalesce("end_line", "start_line", F.lit(1)), F.lit(1)).alias("end_line"), "ord")


def sarif(findings: DataFrame, tool: str, rows: int = DOCUMENT_ROWS) -> DataFrame:
    """block, document: SARIF 2.1.0 logs; in each, rules are unique by id, the first counts.

    One log, or as many as keep about ``rows`` results each, so that no task gathers all findings.
    """
    blocks = max(1, -(-findings.count() // rows))
    results = _blocks(sarif_results(findings), blocks)
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"))
    rules = first_wins(results, ["block", "rule_id"]).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", rule.alias("r")))), lambda s: s["r"]).alias("rules"))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    item = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.coalesce("message", "title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints"))
    listed = results.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))), lambda s: s["i"]).alias("results"))
    every = findings.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(rules, "block", "left").join(listed, "block", "left")
    full = every.select("block", *[F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c) for c in ("rules", "results")])
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return full.select("block", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def ci_annotations(findings: DataFrame, fail_on: str = "none") -> DataFrame:
    """A workflow command for each finding at or above the threshold that is no false positive."""
    limit = SEVERITIES.index(fail_on) if fail_on in SEVERITIES else len(SEVERITIES) - 1
    rows = findings.where((F.col("status") != "false_positive") & F.coalesce(rank(F.col("severity"), SEVERITIES) <= limit, F.lit(True)))
    text = F.replace(F.substring("reasoning", 1, 500), F.lit("\n"), F.lit("%0A"))
    return rows.select(F.format_string("::error file=%s,line=%d,title=[%s] %s: %s::%s", or_empty(F.col("path")), F.coalesce("start_line", F.lit(1)), "severity", "category", "title", or_empty(text)).alias("annotation"), "ord")


def rule_export(findings: DataFrame, most: int = 50) -> DataFrame:
    """A YAML rule for each of the first true positives."""
    rows = findings.where("status IN ('confirmed', 'confirmed_true_positive', 'likely_true_positive')").orderBy("ord").limit(most)
    level = F.when(F.col("severity").isin("critical", "high"), "ERROR").when(F.col("severity") == "medium", "WARNING").otherwise("INFO")
    name = F.concat_ws("-", slug(F.col("category"), "security"), slug(F.col("title"), "finding"))
    return rows.select(name.alias("id"), F.concat(F.lit("- id: "), name, F.lit("\n  severity: "), level, F.lit("\n  message: "), yaml_quote(F.col("title")), F.lit("\n  metadata:\n    category: "), yaml_quote(F.col("category")), F.lit("\n    path: "), yaml_quote(F.col("path")), F.lit("\n")).alias("rule"))


def package_usage(lines_with_package: DataFrame, packages: DataFrame, most: int = 5) -> DataFrame:
    """The first lines that import each package."""
    from siltstone.operators.core import top_per_key

    joined = lines_with_package.join(packages.select("package").distinct(), "package", "left_semi")
    return top_per_key(joined, ["package"], [F.col("ord"), F.col("line")], most)


def provenance(findings: DataFrame) -> DataFrame:
    """Adds ``origin``: where a finding's claim comes from."""
    source = F.col("scanner_source")
    return findings.withColumn("origin", first_of([(source == "ai-exploratory-audit", "model audit"), (source.isin("trivy", "osv-scanner"), "dependency database"), (source.isin("semgrep", "gitleaks", "bearer"), "external scanner")], "local detector"))


def markdown_table(df: DataFrame, columns: list[str], most: int = 500) -> str:
    """The first rows as a Markdown table; for small, aggregated tables."""
    cells = df.select(*[table_cell(F.col(c).cast("string")).alias(c) for c in columns]).limit(most).collect()
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in cells])


def html_table(df: DataFrame, columns: list[str], most: int = 500) -> str:
    """The first rows as a table that a field above it filters by what is typed."""
    rows = df.select(*[html_escape(or_empty(F.col(c))).alias(c) for c in columns]).limit(most).collect()
    body = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in rows)
    return '<input class="filter" placeholder="filter"><table><thead><tr>' + "".join(f"<th>{c}</th>" for c in columns) + f"</tr></thead><tbody>{body}</tbody></table>"


_PLACE = ["severity", "confidence", "title", "path", "start_line"]


def sections(results: DataFrame, findings: DataFrame, more: dict[str, DataFrame] | None = None) -> list[tuple[str, DataFrame, list[str]]]:
    """The sections of a report in order: title, table (aggregated or cut to its first rows) and columns.

    ``more`` gives tables that a scan does not always have, by section title; one without a table is left out.
    """
    more = dict(more or {})
    code = findings.where("category <> 'dependency'")
    packages = more.get("Dependency findings", findings.sparkSession.createDataFrame([], "package string, score int"))
    state = lambda *names: code.where(F.col("status").isin(*names)).withColumn("score", report_score()).orderBy(F.col("score").desc(), "ord").limit(SHOWN)
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    summary = counted(active(findings), "code findings").unionByName(counted(results, "results")).unionByName(counted(results.where("scanner = 'correlation'"), "attack chains")).unionByName(counted(results.where("scanner = 'compliance'"), "compliance rows")).unionByName(counted(code.where("status = 'false_positive'"), "false positives"))
    made = {
        "Summary": (summary, ["what", "n"]),
        "Health": (health(findings), ["health"]),
        "Scan strategy": None, "Security intelligence": None, "Static recon": None, "Static proof packs": None,
        "Action plan": (action_plan(findings, packages), ["action", "title", "score"]),
        "Fix first": (top_fixes(findings, packages), ["kind", "name", "score"]),
        "Attack chains": (attack_chains(results).orderBy("ord").limit(SHOWN), ["rule_id", "title", "severity", "path", "start_line", "kind"]),
        "Confirmed code findings": (state("confirmed", "confirmed_true_positive", "likely_true_positive"), _PLACE),
        "Suspected or to be validated": (state("suspected", "needs_dynamic_test", "security_hotspot", "needs_context"), _PLACE),
        "Dependency findings": None,
        "Compliance evidence": (compliance_table(results), ["rule_id", "status", "remediation"]),
        "False positives": (state("false_positive"), _PLACE),
        "Additional results": (additional_results(results, findings, SHOWN), ["scanner", "rule_id", "severity", "path", "n"]),
        "Noise": (noise_bucket(results), ["scanner", "rule_id", "n"]),
        "Baseline": None,
        "Severities": (severity_share(active(findings)).orderBy(rank(F.col("severity"), SEVERITIES)), ["severity", "n", "share"]),
        "Audit coverage": None, "Execution": None, "Model budget": None, "Model jobs": None,
        "Scanner results": (scanner_counts(results).orderBy("place"), ["scanner", "n"]),
        "Suppressions": None, "Warnings": None,
    }
    out = []
    for title, own in made.items():
        if title in more:
            out.append((title, more[title], [c for c in more[title].columns if c != "ord"]))
        elif own:
            out.append((title, *own))
    return out


def scan_sections(files: DataFrame, results: DataFrame, findings: DataFrame, suppressed: DataFrame | None = None, config: ProjectConfig | None = None, skipped: DataFrame | None = None, used: DataFrame | None = None, jobs: DataFrame | None = None, rounds: list[Round] | None = None) -> dict[str, DataFrame]:
    """The tables of ``sections`` that a scan's own data gives: what was set, read, found about the code, left out and spent.

    ``skipped``: path and skipped_reason of files that were not read; ``used``: responses with their usage; ``jobs``:
    model jobs with a status; ``rounds`` of an audit walk. A section whose data is not given is left out.
    """
    spark = files.sparkSession
    entries = intelligence.entrypoints(files)
    bounds = intelligence.boundaries(files, entries)
    long = lambda df: df.select(*[F.array_join(c, "; ").alias(c) if df.schema[c].dataType.simpleString() == "array<string>" else F.col(c) for c in df.columns])
    recon = intelligence.static_recon(files, results)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in recon.items()]
    out = {
        "Security intelligence": long(intelligence.high_risk_files(files, results, entries, most=SHOWN)),
        "Static recon": reduce(DataFrame.unionByName, counts),
        "Static proof packs": intelligence.proof_packs(findings).select("place", "id", "title", "severity", "location", "missing_control").orderBy("place"),
        "Dependency findings": long(dependencies.package_rollup(results, manifest_dependencies(files).select("package"), dependencies.package_lines(files).select("package"))).orderBy(F.col("score").desc(), "package").limit(SHOWN),
        "Baseline": findings.groupBy(F.coalesce("baseline_status", F.lit("not compared")).alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("status"),
        "Execution": results.groupBy("scanner").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("rule_id").alias("rules"), F.count_distinct("path").alias("files")).orderBy("scanner"),
    }
    read = [(r.number, len(r.ranges), len({p for p, _, _ in r.ranges}), r.chars) for r in rounds or []]
    out["Audit coverage"] = spark.createDataFrame(read, "round int, windows int, files int, characters int") if read else intelligence.coverage(files, entries, results, bounds)
    if config is not None:
        named = {"profile": config.profile, "focus": ", ".join(config.focus_paths), "left out": ", ".join(config.avoid_paths), "classes": ", ".join(config.vulnerability_classes), "disabled rules": ", ".join(config.disabled_rules), "fails on": config.fail_on, "incremental": str(config.incremental).lower()}
        out["Scan strategy"] = spark.createDataFrame([(k, v) for k, v in named.items() if v], "setting string, value string")
    if suppressed is not None:
        out["Suppressions"] = long(suppression_summary(suppressed))
    if skipped is not None:
        out["Warnings"] = skipped.where("skipped_reason IS NOT NULL").groupBy("skipped_reason").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first")).orderBy("skipped_reason")
    if used is not None:
        out["Model budget"] = modelio.usage_summary(used)
    if jobs is not None:
        out["Model jobs"] = modelio.job_summary(jobs)
    return out


def markdown(results: DataFrame, findings: DataFrame, more: dict[str, DataFrame] | None = None) -> str:
    """The sections as Markdown."""
    return "\n\n".join(f"## {title}\n\n{markdown_table(df, columns)}" for title, df, columns in sections(results, findings, more))


_FILTER = "document.querySelectorAll('.filter').forEach(f=>f.oninput=()=>f.nextElementSibling.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(f.value.toLowerCase())))"


def severity_chart(findings: DataFrame) -> str:
    """A bar for each severity, as inline SVG."""
    found = {r["severity"]: r["n"] for r in severity_share(active(findings)).collect()}  # a row a severity
    most = max([*found.values(), 1])
    bars = "".join(f'<text x="0" y="{22 * i + 15}">{s}</text><rect x="80" y="{22 * i + 3}" width="{300 * found.get(s, 0) // most}" height="16"/><text x="{90 + 300 * found.get(s, 0) // most}" y="{22 * i + 15}">{found.get(s, 0)}</text>' for i, s in enumerate(SEVERITIES))
    return f'<svg width="460" height="{22 * len(SEVERITIES)}" role="img" aria-label="findings by severity">{bars}</svg>'


def html(results: DataFrame, findings: DataFrame, more: dict[str, DataFrame] | None = None) -> str:
    """The sections as one HTML page: score, chart of severities, and tables with filters."""
    score_of = health(findings).first()["health"]
    body = "".join(f"<h2>{title}</h2>{html_table(df, columns)}" for title, df, columns in sections(results, findings, more))
    return f"<!doctype html><meta charset=utf-8><title>Report</title><h1>Health {score_of}/100</h1>{severity_chart(findings)}{body}<script>{_FILTER}</script>"
