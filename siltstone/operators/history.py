"""State across scans: baselines, remembered verdicts, changed files, approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import derived_fingerprint, normal_path, or_empty
from siltstone.operators.core import latest_wins, multiset_diff


def latest_scan(scans: DataFrame, repo_path: str, current: str) -> DataFrame:
    """id of the repository's last completed scan before this one (no row for none)."""
    rows = scans.where((F.col("repo_path") == repo_path) & (F.col("id") != current) & (F.col("status") == "completed"))
    return rows.agg(F.max_by("id", F.struct("started_at", "id")).alias("id")).where("id IS NOT NULL")


def fingerprints(findings: DataFrame) -> DataFrame:
    """fingerprint of every finding that is not a false positive; stored, else derived."""
    return findings.where("status <> 'false_positive'").select(derived_fingerprint().alias("fingerprint"), "ord")


def baseline_diff(current: DataFrame, baseline: DataFrame, most: int = 50) -> DataFrame:
    """One row: numbers of new, resolved and unchanged findings, and the first new and resolved fingerprints."""
    new, resolved, unchanged = multiset_diff(fingerprints(current), fingerprints(baseline), "fingerprint")
    listed = lambda df, name: df.orderBy("ord").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fingerprint"))), lambda s: s["fingerprint"]).alias(name))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(new, "new_findings").crossJoin(count(resolved, "resolved_findings")).crossJoin(count(unchanged, "unchanged_findings")).crossJoin(listed(new, "new_fingerprints")).crossJoin(listed(resolved, "resolved_fingerprints"))


def mark_baseline(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """baseline_status new or unchanged; null where there is no baseline."""
    if baseline is None:
        return current.withColumn("baseline_status", F.lit(None).cast("string"))
    known = fingerprints(baseline).select(F.col("fingerprint").alias("_f")).distinct().withColumn("_known", F.lit(True))
    joined = current.join(known, F.col("fingerprint") == F.col("_f"), "left")
    return joined.withColumn("baseline_status", F.when(F.col("_known"), "unchanged").otherwise("new")).drop("_f", "_known")


def changed_files(files: DataFrame, cache: DataFrame, repo_path: str) -> DataFrame:
    """Files whose content differs from what the cache remembers of them."""
    cached = cache.where(F.col("repo_path") == repo_path).select(F.col("path").alias("_p"), F.col("sha256").alias("_sha"))
    now = files.withColumn("_n", normal_path(F.col("path"), mount=True))
    return now.join(cached, F.col("_n") == F.col("_p"), "left").where(~F.sha2("content", 256).eqNullSafe(F.col("_sha"))).select(*files.columns)


def upsert_cache(cache: DataFrame, files: DataFrame, repo_path: str, now) -> DataFrame:
    """The cache after a scan: new rows win over old ones of their key (Parquet has no MERGE)."""
    new = files.select(F.lit(repo_path).alias("repo_path"), normal_path(F.col("path"), mount=True).alias("path"), F.sha2("content", 256).alias("sha256"), "language", "line_count", F.lit(now).cast("timestamp").alias("updated_at"))
    return new.unionByName(cache.join(new, ["repo_path", "path"], "left_anti"))


def triage_memory(findings: DataFrame, scans: DataFrame, files: DataFrame, repo_path: str, current: str) -> DataFrame:
    """Last status and reasoning of each fingerprint in the repository's other scans, with the file's hash then.

    findings and files have scan_id; files has path and sha256.
    """
    s = scans.where((F.col("repo_path") == repo_path) & (F.col("id") != current)).select(F.col("id").alias("scan_id"), "started_at")
    old = findings.where("fingerprint IS NOT NULL").join(s, "scan_id").join(files.select("scan_id", "path", "sha256"), ["scan_id", "path"], "left")
    return latest_wins(old.select("fingerprint", "status", "reasoning", "sha256", F.struct("started_at", F.negative("ord")).alias("_at")), ["fingerprint"], "_at").drop("_at")


def apply_memory(findings: DataFrame, memory: DataFrame, files: DataFrame) -> DataFrame:
    """Reuse a remembered verdict where the file's content is what it was."""
    m = memory.select(F.col("fingerprint").alias("_f"), F.col("status").alias("_status"), F.col("reasoning").alias("_reason"), F.col("sha256").alias("_sha"))
    now = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_now"))
    joined = findings.join(m, F.col("fingerprint") == F.col("_f"), "left").join(now, F.col("path") == F.col("_p"), "left")
    same = F.coalesce(F.col("_sha") == F.col("_now"), F.lit(False))
    wrong, right = same & (F.col("_status") == "false_positive"), same & F.col("_status").isin("confirmed_true_positive", "confirmed")
    said = F.when(wrong, F.concat(or_empty(F.col("reasoning")), F.lit("\nTriage memory: previous scan marked this fingerprint false_positive. "), or_empty(F.col("_reason")))).when(right, F.concat(or_empty(F.col("reasoning")), F.lit("\nTriage memory: previous scan confirmed this fingerprint as true positive."))).otherwise(F.col("reasoning"))
    out = joined.withColumn("reasoning", said)
    out = out.withColumn("confidence", F.when(wrong, "low").when(right & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence")))
    return out.withColumn("status", F.when(wrong, "false_positive").when(right, "confirmed_true_positive").otherwise(F.col("status"))).select(*findings.columns)


def negative_evidence(findings: DataFrame, scans: DataFrame, repo_path: str, current: str, most: int = 80) -> DataFrame:
    """Candidates that earlier scans of the repository rejected, latest first."""
    s = scans.where((F.col("repo_path") == repo_path) & (F.col("id") != current)).select(F.col("id").alias("scan_id"), "started_at")
    rows = findings.where("status = 'false_positive'").join(s, "scan_id").orderBy(F.col("started_at").desc(), "ord").limit(most)
    return rows.select("title", "path", "start_line", F.coalesce("reasoning", F.lit("previous scan marked this candidate as false positive")).alias("reason"), "status", "fingerprint")


def resolve_approvals(approvals: DataFrame, decisions: DataFrame, now) -> DataFrame:
    """Pending rows with a decision (id, status) take it; resolved ones never change."""
    d = decisions.select(F.col("id").alias("_i"), F.col("status").alias("_d"))
    joined = approvals.join(d, (F.col("id") == F.col("_i")) & (F.col("status") == "pending"), "left")
    return joined.withColumn("resolved_at", F.when(F.col("_d").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("resolved_at"))).withColumn("status", F.coalesce("_d", "status")).select(*approvals.columns)


def finish_scans(scans: DataFrame, finished: DataFrame, now) -> DataFrame:
    """Running scans that ``finished`` (id, status) names take its status; others stay as they are."""
    d = finished.select(F.col("id").alias("_i"), F.col("status").alias("_d"))
    joined = scans.join(d, (F.col("id") == F.col("_i")) & F.col("finished_at").isNull(), "left")
    return joined.withColumn("finished_at", F.when(F.col("_d").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("finished_at"))).withColumn("status", F.coalesce("_d", "status")).select(*scans.columns)


def approved(actions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Actions (action_type, target) that someone approved."""
    return actions.join(approvals.where("status = 'approved'").select("action_type", "target"), ["action_type", "target"], "left_semi")
