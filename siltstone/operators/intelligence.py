"""What a code base exposes: catalog, entry points, boundaries, ranked files, recon and proof packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import boundary, file_role
from siltstone.functions.rules import SANITIZER
from siltstone.functions.text import explode_lines, first_sentence, matches, normal_path, or_empty, squeeze, trim
from siltstone.operators.core import first_wins, top_per_key
from siltstone.operators.detectors import _SOURCE_FILE
from siltstone.operators.flow import occurrences
from siltstone.operators.policy import active
from siltstone.schemas import CONFIDENCES, FILE_SPAN, SEVERITIES, rank, score
from siltstone.sources.files import routes

# Lines that guard, and lines that read input.
GUARD = r"(?i)\b(requireAuth|isAuthenticated|authorize|isAuthorized|requireRole|requireAdmin|policy|permission|guard|can\?|csrf|jwt\.verify|passport\.authenticate)\b"
RECON_GUARD = r"(?i)\b(requireAuth|isAuthenticated|authorize|isAuthorized|requireRole|requireAdmin|policy|permission|guard|can\?|csrf|jwt\.verify|passport\.authenticate|current_user|req\.user|session\.user)\b"
RECON_INPUT = r"(?i)\b(req|request|ctx)\.(body|query|params|headers|cookies)\.([A-Za-z0-9_$-]+)|\b(searchParams|getParameter|getHeader)\s*\("
RECON_SINK = r"(?i)sink|injection|xss|ssrf|command|path|file|deserialization|template|authz|business"


def catalog(files: DataFrame) -> DataFrame:
    """kind (source, sink, sanitizer, guard), name, path, line, category, evidence of every line that is one."""
    flow = occurrences(files)
    source = F.col("kind") == "source"
    known = flow.select("kind", F.when(source, F.col("code")).otherwise(F.col("sink_id")).alias("name"), "path", "line", F.when(source, "request-input").otherwise(F.col("category")).alias("category"), F.col("code").alias("evidence"), "ord", F.when(source, 0).otherwise(1).alias("_n"))
    rows = explode_lines(files)
    kinds = F.array_compact(F.array(F.when(matches(F.col("line"), SANITIZER), F.struct(F.lit("sanitizer").alias("kind"), F.lit("sanitizer").alias("category"))), F.when(matches(F.col("line"), GUARD), F.struct(F.lit("guard").alias("kind"), F.lit("authz").alias("category")))))
    text = trim(F.col("line"))
    other = rows.select(F.explode(kinds).alias("c"), F.substring(text, 1, 120).alias("name"), "path", (F.col("i") + 1).alias("no"), F.substring(text, 1, 220).alias("evidence"), (F.col("ord") * FILE_SPAN + F.col("i")).alias("ord"))
    other = other.select("c.kind", "name", "path", F.col("no").alias("line"), "c.category", "evidence", "ord", F.lit(2).alias("_n"))
    return known.unionByName(other).withColumn("discovered_by", F.lit("deterministic"))


def model_catalog(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items that a reviewer named, restricted to known paths (kind, name, path, line, category, evidence)."""
    known = files.select(normal_path(F.col("path"), root=True).alias("_p")).distinct()
    rows = items.withColumn("path", normal_path(F.col("path"), root=True)).join(known, F.col("path") == F.col("_p"), "left_semi")
    return rows.select("kind", F.substring("name", 1, 160).alias("name"), "path", F.when(F.col("line") > 0, F.col("line")).alias("line"), F.coalesce("category", "kind").alias("category"), F.coalesce("evidence", "name").alias("evidence"), "ord", F.lit(3).alias("_n"), F.lit("ai").alias("discovered_by"))


def full_catalog(files: DataFrame, items: DataFrame | None = None, most: int = 400) -> DataFrame:
    """Both catalogs, one row for each kind, finder, path, line and name, cut to the first ``most``."""
    every = catalog(files)
    if items is not None:
        every = every.unionByName(model_catalog(items, files))
    return first_wins(every, ["kind", "discovered_by", "path", "line", "name"], ["_n", "ord"]).orderBy("_n", "ord", "kind").limit(most).drop("_n")


def entrypoints(files: DataFrame, most: int | None = None) -> DataFrame:
    """Every route of every file once, with its file's boundary; with ``most`` the first ones by ``ord``."""
    rows = routes(files).select("method", "route_path", "path", F.col("start_line").alias("line"), "framework", boundary(F.col("path"))["id"].alias("boundary"), (F.col("ord") * FILE_SPAN + F.col("k")).alias("ord"))
    unique = first_wins(rows, ["method", "route_path", "path", "line"])
    return unique.orderBy("ord").limit(most) if most is not None else unique


def boundaries(files: DataFrame, entries: DataFrame, most_paths: int = 20) -> DataFrame:
    """id, kind, name, paths (the first), file_count, entrypoint_count; most entry points first."""
    rows = files.select("path", "ord", boundary(F.col("path")).alias("b")).select("path", "ord", "b.*")
    counts = rows.groupBy("id", "kind", "name").agg(F.count(F.lit(1)).alias("file_count"))
    few = top_per_key(rows, ["id"], [F.col("ord")], most_paths).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]).alias("paths"))
    entered = entries.groupBy(F.col("boundary").alias("id")).agg(F.count(F.lit(1)).alias("entrypoint_count"))
    return counts.join(few, "id").join(entered, "id", "left").fillna(0, ["entrypoint_count"]).orderBy(F.col("entrypoint_count").desc(), F.col("file_count").desc(), "id")


def high_risk_files(files: DataFrame, results: DataFrame, entries: DataFrame, priority: DataFrame | None = None, most: int = 80) -> DataFrame:
    """path, score, reasons (the first eight different ones): what results, routes, a reviewer and roles add up to.

    ``priority`` has path, amount and reason.
    """
    path = lambda c="path": normal_path(F.col(c), root=True).alias("path")
    by_result = results.where("path IS NOT NULL").select(path(), score(F.col("severity"), {"critical": 60, "high": 45, "medium": 25, "low": 8, "info": 2}, 5).alias("amount"), F.concat_ws("/", "scanner", "rule_id").alias("reason"), F.lit(0).alias("k"), "ord")
    by_route = entries.select(path(), F.lit(20).alias("amount"), F.concat_ws(" ", "method", "route_path").alias("reason"), F.lit(1).alias("k"), "ord")
    every = by_result.unionByName(by_route)
    if priority is not None:
        every = every.unionByName(priority.select(path(), "amount", "reason", F.lit(2).alias("k"), F.lit(0).cast("long").alias("ord")))
    server = files.where(file_role(F.col("path"), F.col("language")) == "server-runtime").select(path(), F.lit(5).alias("amount"), F.lit("server-runtime file").alias("reason"), F.lit(3).alias("k"), "ord")
    every = every.unionByName(server.join(every.select("path").distinct(), "path", "left_anti"))
    total = every.groupBy("path").agg(F.sum("amount").alias("score"))
    few = top_per_key(first_wins(every.select("path", "reason", "k", "ord"), ["path", "reason"], ["k", "ord"]), ["path"], [F.col("k"), F.col("ord"), F.col("reason")], 8)
    why = few.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ord", "reason"))), lambda s: s["reason"]).alias("reasons"))
    return total.join(why, "path").orderBy(F.col("score").desc(), "path").limit(most)


def coverage(files: DataFrame, entries: DataFrame, results: DataFrame, bounds: DataFrame) -> DataFrame:
    one = lambda df, e, n: df.agg(e.alias(n))
    return one(files, F.count(F.lit(1)), "indexed_files").crossJoin(one(entries, F.count_distinct("path"), "entrypoint_files")).crossJoin(one(results, F.count_distinct("path"), "scanner_seed_files")).crossJoin(one(bounds, F.count(F.lit(1)), "boundaries"))


def recon_endpoints(files: DataFrame, most: int = 300) -> DataFrame:
    ids = F.regexp_extract_all("route_path", F.lit(r"[:{]([A-Za-z0-9_]*(?:id|Id|ID))[}?]?"), F.lit(1))
    return routes(files).orderBy("ord", "k").limit(most).select("method", "route_path", "path", F.col("start_line").alias("line"), "framework", ids.alias("object_id_parameters"))


def recon_lines(files: DataFrame, kind: str, pattern: str, most: int) -> DataFrame:
    rows = explode_lines(files.where(matches(F.col("path"), _SOURCE_FILE))).where(matches(F.col("line"), pattern))
    return rows.orderBy("ord", "i").limit(most).select(F.lit(kind).alias("kind"), "path", (F.col("i") + 1).alias("line"), F.substring(trim(F.col("line")), 1, 220).alias("detail"))


def recon_sinks(results: DataFrame, cat: DataFrame, most: int = 120) -> DataFrame:
    named = results.where(matches(F.concat_ws(" ", "rule_id", or_empty(F.col("category")), "title"), RECON_SINK))
    a = named.select(F.coalesce("category", "rule_id").alias("kind"), F.coalesce("path", F.lit("repository")).alias("path"), F.col("start_line").alias("line"), F.substring(F.concat(F.col("scanner"), F.lit("/"), F.col("rule_id"), F.lit(": "), F.col("title")), 1, 220).alias("detail"), F.lit(0).alias("_n"), "ord")
    b = cat.where("kind = 'sink'").select(F.col("category").alias("kind"), "path", "line", F.substring("evidence", 1, 220).alias("detail"), F.lit(1).alias("_n"), "ord")
    return first_wins(a.unionByName(b), ["kind", "path", "line", "detail"], ["_n", "ord"]).orderBy("_n", "ord").limit(most).drop("_n", "ord")


def static_recon(files: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The recon artifact's tables: endpoints, guards, inputs, sinks."""
    return {"endpoints": recon_endpoints(files), "guards": recon_lines(files, "guard", RECON_GUARD, 80), "inputs": recon_lines(files, "request-input", RECON_INPUT, 120), "sinks": recon_sinks(results, full_catalog(files))}


# What to test against a kind of finding, the first pattern that matches.
_GUIDANCE = (
    (r"(authz|authorization|idor|tenant|ownership|business-logic)", "Add a source-level test where an authenticated principal references another principal's object identifier.", "Assert the handler returns a denial path before any read/write side effect."),
    (r"(ssrf|server-side request)", "Add unit coverage for URL parsing and destination allowlisting.", "Assert localhost, link-local metadata, private-network, and non-HTTP schemes are rejected."),
    (r"(xss|cross-site|html|template)", "Add rendering tests for encoded HTML, attribute, URL, and script contexts.", "Assert attacker-controlled markup is displayed as text or rejected before rendering."),
    (r"(command|sql|injection|deserialization|template-injection)", "Add a unit test with metacharacters or structured payloads at the cited source.", "Assert the sink receives parameterized, escaped, allowlisted, or rejected data."),
    (r"(secret|credential|token|key)", "Add a repository secret-scanning fixture that rejects committed live credential formats.", "Assert runtime configuration reads secrets from an approved secret source, not source files."),
    ("", "Add a regression test around the cited source path and missing control.", "Assert unsafe input is rejected, normalized, or authorized before the sensitive operation."),
)


def _guidance(text: Column) -> Column:
    out = F.array(*map(F.lit, _GUIDANCE[-1][1:]))
    for pattern, *lines in reversed(_GUIDANCE[:-1]):
        out = F.when(matches(text, pattern), F.array(*map(F.lit, lines))).otherwise(out)
    return out


def proof_packs(findings: DataFrame, most: int = 50) -> DataFrame:
    """The gravest active findings with what is missing, what an attack needs and what keeps it from being sure."""
    top = active(findings).orderBy(F.coalesce(rank(F.col("severity"), SEVERITIES), F.lit(9)), F.coalesce(rank(F.col("confidence"), CONFIDENCES), F.lit(9)), "ord").limit(most)
    from pyspark.sql.window import Window

    order = Window.orderBy(F.coalesce(rank(F.col("severity"), SEVERITIES), F.lit(9)), F.coalesce(rank(F.col("confidence"), CONFIDENCES), F.lit(9)), "ord")
    place = F.row_number().over(order)
    reasoning, at = or_empty(F.col("reasoning")), F.concat("path", F.when(F.col("start_line") > 0, F.concat(F.lit(":"), F.col("start_line").cast("string"))).otherwise(""))
    missing = trim(F.regexp_extract(reasoning, r"(?is)Missing control:\s*(.*?)(?:\s+Preconditions:|\z)", 1))
    needs = F.regexp_extract(reasoning, r"(?i)Preconditions:\s*([^\n]+)", 1)
    listed = F.slice(F.filter(F.transform(F.split(needs, ";|,"), trim), lambda s: s != ""), 1, 6)
    source, sink = F.nullif(or_empty(F.col("source")), F.lit("")), F.nullif(or_empty(F.col("sink")), F.lit(""))
    conditions = F.when(needs != "", listed).when(source.isNotNull() & sink.isNotNull(), F.array(F.concat(F.lit("Untrusted data can reach "), sink, F.lit(" from "), source, F.lit(".")))).when(F.col("path").isNotNull(), F.array(F.concat(F.lit("The vulnerable code path at "), at, F.lit(" is reachable in production code.")))).otherwise(F.array(F.lit("Static reachability and production exposure must be confirmed before remediation is prioritized as exploitable.")))
    blockers = F.array_compact(F.array(F.when(F.col("confidence").isin("medium", "low"), "Static evidence is not high confidence."), F.when(F.col("status").isin("security_hotspot", "needs_context"), "Finding needs more source context before it should be treated as confirmed."), F.when(source.isNull(), "Source expression was not isolated."), F.when(sink.isNull(), "Sink or guard location was not isolated.")))
    evidence = F.slice(F.filter(F.transform(F.coalesce("evidence", F.array().cast(findings.schema["evidence"].dataType)), lambda e: squeeze(F.to_json(e))), lambda s: s != ""), 1, 6)
    return top.select(
        F.coalesce(F.nullif(F.substring("fingerprint", 1, 12), F.lit("")), F.concat(F.lit("proof-"), place.cast("string"))).alias("id"), "title", "category", "severity", "confidence", "status", F.coalesce(at, F.lit("repository-level finding")).alias("location"),
        F.coalesce(source, F.lit("source not isolated in static evidence")).alias("source"), F.coalesce(sink, F.lit("sink/control point not isolated in static evidence")).alias("sink"), F.when(F.size(evidence) > 0, evidence).otherwise(F.array(F.lit("No structured evidence was attached; inspect the cited source location and scanner context."))).alias("evidence"),
        F.coalesce(F.nullif(missing, F.lit("")), F.nullif(first_sentence(reasoning), F.lit("")), F.lit("Missing or insufficient security control must be verified in the cited code path.")).alias("missing_control"), conditions.alias("preconditions"), _guidance(F.lower(F.concat_ws(" ", "category", "title"))).alias("guidance"),
        F.when(F.size(blockers) > 0, blockers).otherwise(F.array(F.lit("No major static blockers recorded; still not runtime-validated."))).alias("confidence_blockers"), place.alias("place"),
    )
