"""Row types of the engine's tables, and ordered enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and order of the enumerations.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("confirmed", "high", "medium", "low")
STATUSES = ("confirmed", "suspected", "needs_dynamic_test", "confirmed_true_positive", "likely_true_positive", "security_hotspot", "needs_context", "false_positive")

EVIDENCE = "array<struct<path:string,line:int,note:string>>"
#: A file tree as a table; ``ord`` is the order of files (ascending path).
FILES = "path string, language string, content string, line_count int, ord long"
#: Detections; ``raw`` is the detector's JSON, ``ord`` the order in which they were reported.
RESULTS = "scanner string, rule_id string, title string, category string, severity string, path string, start_line int, end_line int, message string, raw string, ord long"
FINDINGS = (
    "title string, category string, severity string, confidence string, status string, path string, start_line int, end_line int, source string, sink string, "
    f"evidence {EVIDENCE}, reasoning string, remediation string, scanner_source string, raw string, fingerprint string, baseline_status string, exploitability_score int, ord long"
)
SCANS = "id string, repo_path string, started_at timestamp, finished_at timestamp, status string, provider string, model string, options_json string"
SCAN_CACHE = "repo_path string, path string, sha256 string, language string, line_count int, updated_at timestamp"
APPROVALS = "id string, scan_id string, action_type string, command_preview string, risk string, reason string, target string, status string, created_at timestamp, resolved_at timestamp"
ROUTE = "method string, route_path string, start_line int, framework string"


#: Orders of a file's rows: so many places (lines, or hits of a rule) for each of so many rules.
PLACES, RULES = 1 << 20, 1 << 8
#: What one file takes of the order; files are 2^30 at most before another part's order begins (PART).
FILE_SPAN = PLACES * RULES
PART_SPAN = FILE_SPAN << 30


def columns_of(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames()


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Position in an enumeration from 0; null for a value outside it."""
    return F.when(column.isin(*order), F.array_position(F.array(*map(F.lit, order)), column) - 1)


def score(column: Column, values: dict[str, int], default: int) -> Column:
    """Value by key, literal by literal, so that no join is planned."""
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out
