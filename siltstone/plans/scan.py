"""A whole scan as one plan: files and external reports in, results, findings and diffs out.

Nothing here runs until a result is read, but for ``keep``: tables that several steps read are
written once, to the shared folder, and reread.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import finding_state, local_exploitability, result_score
from siltstone.functions.text import finding_fingerprint, result_fingerprint
from siltstone.operators import dedupe, dependencies, detectors, flow, history, policy
from siltstone.operators.core import breadth_first
from siltstone.operators.modelio import as_findings
from siltstone.schemas import PART_SPAN
from siltstone.session import Scratch
from siltstone.sources.files import ProjectConfig
from siltstone.sources.scanners import ADAPTERS

#: Local detectors in the order in which their rows are reported.
DETECTORS = {
    "custom-rules": detectors.custom_rules, "source-patterns": detectors.source_patterns, "taint-lite": flow.taint_lite, "taint-flow": flow.taint_flow,
    "business-invariants": detectors.business_invariants, "config-checks": detectors.config_checks, "quality": detectors.quality,
}


@dataclass
class ScanResult:
    results: DataFrame
    findings: DataFrame
    suppressed: DataFrame
    changed: DataFrame | None


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in order: each part's rows come after the parts' before it."""
    out = parts[0]
    for n, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("ord", F.col("ord") + n * PART_SPAN), allowMissingColumns=True)
    return out


def detect(files: DataFrame, changed: DataFrame | None = None, reports: dict[str, DataFrame] | None = None) -> DataFrame:
    """Local detectors on changed files (or all), external reports in scope, then compliance and correlation over all."""
    local = files if changed is None else changed
    parts = [run(local) for run in DETECTORS.values()]
    parts += [policy.in_scope(ADAPTERS[name](df), files) for name, df in (reports or {}).items()]
    # Four later steps read these rows: they are written once, and later plans stay small.
    preliminary = Scratch(files.sparkSession, "detect").table("preliminary", union_all(parts))
    more = [detectors.compliance(files, preliminary), detectors.pollution_chain(preliminary), dependencies.reachable_results(files, preliminary), detectors.header_gates(files)]
    return union_all([preliminary, union_all(more).withColumn("ord", F.col("ord") + len(parts) * PART_SPAN)])


def scan(files: DataFrame, config: ProjectConfig | None = None, reports: dict[str, DataFrame] | None = None, ignore: list[str] = (), cache: DataFrame | None = None, repo_path: str = "/repo", memory: DataFrame | None = None, baseline: DataFrame | None = None) -> ScanResult:
    """Detection, policy, suppression, merging and fingerprints; then findings with state, memory, score and merging."""
    config = config or ProjectConfig()
    scratch = Scratch(files.sparkSession, "scan")
    changed = history.changed_files(files, cache, repo_path) if cache is not None else None
    found = scratch.table("detected", detect(files, changed if config.incremental else None, reports))
    allowed = policy.project_policy(found, config.disabled_rules, config.severity_overrides, config.profile)
    tagged = scratch.table("tagged", policy.suppress(allowed, files, list(ignore)))
    kept = tagged.where("suppressed IS NULL").drop("suppressed")
    results = scratch.table("results", dedupe.reduce_noise(kept).withColumn("fingerprint", result_fingerprint()))
    findings = as_findings(results)
    findings = findings.withColumn("status", finding_state(F.col("status"), F.col("confidence"), F.col("severity"))).withColumn("fingerprint", finding_fingerprint())
    if memory is not None:
        findings = history.apply_memory(findings, memory, files)
    findings = findings.withColumn("exploitability_score", local_exploitability().cast("int"))
    merged = dedupe.dedupe_findings(findings)
    final = history.mark_baseline(merged, baseline)
    return ScanResult(results, scratch.table("findings", final), tagged.where("suppressed IS NOT NULL"), changed)


def plan_review(results: DataFrame, most: int, classes: list[str] = ()) -> DataFrame:
    """Results to review: by score, then breadth first over scanner, rule, severity and path."""
    rows = policy.review_candidates(results, list(classes)).withColumn("_score", result_score())
    key = F.concat_ws("|", "scanner", "rule_id", "severity", F.coalesce("path", F.lit("")))
    return breadth_first(rows, key, [("_score", True), ("ord", False)], most).drop("_score")


#: Settings that do not change what a scan finds.
_IGNORED = ("format", "out", "workspace", "resume", "verbose", "quiet", "ci", "failOn")


def resume_key(repo_path: str, options: dict, config: dict, tree: str = "") -> str:
    """Hash of all that a stage's snapshot depends on, with keys in order."""
    kept = {k: v for k, v in options.items() if k not in _IGNORED}
    body = json.dumps({"repo": repo_path, "options": kept, "config": config, "tree": tree}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def write_snapshot(df: DataFrame, folder: str, stage: str, key: str) -> None:
    """A stage's table and, after it, the manifest that makes it valid."""
    df.write.mode("overwrite").parquet(f"{folder}/{stage}/data")
    manifest = [(1, stage, key)]
    df.sparkSession.createDataFrame(manifest, "version int, stage string, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{folder}/{stage}/manifest")


def read_snapshot(spark, folder: str, stage: str, key: str, strict: bool = False) -> DataFrame | None:
    """The stage's table if its manifest has this key; else None, or ValueError if strict."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("version int, stage string, fingerprint string").json(f"{folder}/{stage}/manifest").first()
    except AnalysisException:
        found = None
    if found and found["fingerprint"] == key:
        return spark.read.parquet(f"{folder}/{stage}/data")
    if strict:
        raise ValueError(f"the snapshot of {stage} is missing or belongs to another scan")
    return None


def persist(tables: dict[str, DataFrame], warehouse: str, scan_id: str) -> None:
    """Append a scan's tables, each partitioned by scan_id."""
    for name, df in tables.items():
        df.withColumn("scan_id", F.lit(scan_id)).write.mode("append").partitionBy("scan_id").parquet(f"{warehouse}/{name}")


def bundle(spark, warehouse: str, scan_id: str, names: tuple[str, ...] = ("files", "results", "findings", "runs")) -> dict[str, DataFrame]:
    """One scan's tables; the filter on scan_id prunes partitions."""
    return {n: spark.read.parquet(f"{warehouse}/{n}").where(F.col("scan_id") == scan_id) for n in names}
