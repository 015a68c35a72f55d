"""Classifiers and scores as ordered ``when`` chains: language, role, family, weights, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import extension, matches, normal_path, or_empty, semantic_bucket, semantic_title, token
from siltstone.schemas import score


def first_of(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default))


# Languages by extension.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "python": (".py",), "go": (".go",), "php": (".php",), "ruby": (".rb",),
    "java": (".java",), "kotlin": (".kt",), "csharp": (".cs",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".hpp"), "rust": (".rs",), "swift": (".swift",),
    "scala": (".scala",), "shell": (".sh", ".bash", ".zsh"), "json": (".json",), "yaml": (".yml", ".yaml"), "toml": (".toml",), "xml": (".xml",), "html": (".html",), "css": (".css",),
}


def language(path: Column, content: Column) -> Column:
    """By extension, else by the interpreter that a first line #! names."""
    ext, first = F.lower(extension(path)), F.coalesce(F.split(content, "\n", 2)[0], F.lit(""))
    script = first.startswith("#!")
    named = [(script & first.contains(word), lang) for word, lang in (("python", "python"), ("node", "javascript"), ("ruby", "ruby"), ("sh", "shell"))]
    return first_of([(ext.isin(*exts), lang) for lang, exts in LANGUAGES.items()] + named, "unknown")


# Path patterns of file roles, in the order in which they are tried.
_DEPENDENCY = r"(?i)(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Gemfile\.lock|poetry\.lock|go\.sum|Cargo\.lock|composer\.lock)$"
_GENERATED = r"(?i)(^|/)(node_modules|vendor|dist|build|coverage|out|target|\.next|generated|__generated__)(/|$)|\.min\.(js|css)$"
_TEST = r"(?i)(^|/)(test|tests|__tests__|spec|specs|cypress|e2e)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"
_CI = r"(?i)(^|/)(\.github/workflows|\.circleci|\.gitlab-ci|azure-pipelines|buildkite|\.drone)(/|$)|(^|/)(Jenkinsfile|Dockerfile)$"
_DOCS = r"(?i)(^|/)(docs?|documentation)(/|$)|(^|/)(README|CHANGELOG|CONTRIBUTING|LICENSE)(\.[a-z0-9]+)?$|\.(md|mdx|rst|adoc|txt)$"
_FIXTURE = r"(?i)(^|/)(fixtures?|samples?|examples?|mocks?|mock-data|seed|seeds|demo|demos|snippets?|testdata|data/static|codefixes)(/|$)"
_SERVER = r"(?i)(^|/)(routes?|controllers?|handlers?|middleware|api|server|backend|app/api|pages/api|workers?|jobs?|commands?|cli|bin|auth|policies?|services?)(/|$)|(^|/)(server|app|main|index|worker|job|cli)\.[cm]?[jt]sx?$"
_CLIENT = r"(?i)(^|/)(frontend|client|web|ui|assets|public|components?|pages|views?|screens?|stores?|hooks?|styles?)(/|$)|\.(vue|svelte|css|scss)$"
_CLIENT_TOP, _API_INSIDE = r"(?i)^(frontend|client|web|ui)/", r"(?i)(^|/)(app/api|pages/api)(/|$)"
_BOUNDARY_CLIENT = r"(?i)(^|/)(web|ui|frontend|client|public|components?|views?|pages)(/|$)"
_BOUNDARY_SERVER = r"(?i)(^|/)(api|routes?|controllers?|server|backend)(/|$)"
ROLE_SCORES = {"server-runtime": 18, "unknown": 0, "client": -6, "ci": -32, "fixture": -18, "test": -38, "docs": -42, "generated": -65, "dependency": -65}


def file_role(path: Column, lang: Column | None = None) -> Column:
    p = normal_path(or_empty(path))
    documents = matches(p, _DOCS)
    if lang is not None:
        documents = documents | F.coalesce(F.lower(lang).isin("markdown", "text"), F.lit(False))
    return first_of(
        [
            (p == "", "unknown"), (matches(p, _DEPENDENCY), "dependency"), (matches(p, _GENERATED), "generated"), (matches(p, _TEST), "test"), (matches(p, _CI), "ci"),
            (documents, "docs"), (matches(p, _FIXTURE), "fixture"), (matches(p, _CLIENT_TOP) & ~matches(p, _API_INSIDE), "client"), (matches(p, _SERVER), "server-runtime"), (matches(p, _CLIENT), "client"),
        ],
        "unknown",
    )


def role_score(role: Column) -> Column:
    return score(role, ROLE_SCORES, 0)


def reusable_role(role: Column) -> Column:
    return role.isin("test", "fixture", "docs", "generated", "dependency")


def boundary(path: Column) -> Column:
    """struct<id, kind, name>: role and first folder, two folders below apps, packages and services."""
    p = normal_path(path, root=True)
    parts = F.split(p, "/")
    kind = F.when(matches(p, _BOUNDARY_CLIENT) & ~matches(p, _BOUNDARY_SERVER), "client").otherwise(file_role(p))
    name = F.when(parts[0].isin("apps", "packages", "services"), F.concat(parts[0], F.lit("/"), F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")))).otherwise(parts[0])
    return F.struct(F.concat_ws(":", kind, name).alias("id"), kind.alias("kind"), name.alias("name"))


# Families of related detections; D: on the short text, T: on the whole text.
_SECRET = (r"(secret|credential|password|api[_ -]?key|token)", r"(hard.?coded|hardcoded|generic.secret|detected.generic.secret|secret.assignment|express.session.hardcoded.secret|session.secret)")
_COMMAND_D = r"(command.injection|code.injection|rce|eval|safeeval|notevil|vm.runincontext|child.process|exec\(|spawn\(|shell)"
_COOKIE = (r"(session|cookie|connect\.sid|express.cookie|express.session|cookie.settings|cookie.configuration|default.cookie)", r"(secure|httponly|http.only|same.?site|domain|expires|maxage|max.age|default|name|fingerprint|session.cookie)")
_XSS_D = r"(xss|cross.site.scripting|raw.html|script.tag)"
_FAMILY_T = (
    (r"(sql.injection|raw.sql|sequelize.query|\bsql\b)", "sql-injection"),
    (r"(ssrf|server.side.request.forgery|outbound.http|fetch\()", "ssrf"),
    (r"(open.redirect|redirect)", "open-redirect"),
    (r"(xxe|xml.external|noent|parsexml|doctype|entity.expansion)", "xxe"),
    (r"(nosql|\$where|mongo|mongodb)", "nosql-injection"),
    (r"(path.traversal|directory.traversal|non.literal.fs|filesystem|file.path|fs\.)", "path-traversal"),
    (r"(prototype.pollution|__proto__|constructor.prototype)", "prototype-pollution"),
    (r"(xss|cross.site.scripting|template|ejs|eta|raw.html|unescape|script.tag)", "template-xss"),
    (r"(command.injection|code.injection|rce|eval\(|safeeval|notevil|vm.runincontext|child_process|exec\(|spawn\(|shell)", "command-injection"),
    (r"(file.upload|zip.slip|archive|upload|originalname|mimetype|entry.path)", "file-upload"),
)
_BUSINESS_D, _BUSINESS_T = r"(business.logic|basket|cart|order|checkout|payment|coupon|discount|review|feedback|deluxe|quantity|price)", r"(product.review|user.review|reviewid|review.id|feedback.form|coupon.code|order.id|basket.id|cart.id)"
_CSRF_T = r"(csrf|cross.site.request.forgery)"
_HEADER_D = r"(helmet|x-powered-by|powered.by|fingerprint|security.header|http.header|reduce.server.fingerprint)"
_TRANSPORT_D = (r"(http\.createserver|https?|tls|ssl|secure.http|transport.security|insecure.transport)", r"(http.server|without.tls|missing.secure|https.protocol.missing|using.http.server|transport.security)")
_WIDE = ("session-cookie-hardening", "express-header-hardening")
_WIDER = ("sql-injection", "ssrf", "command-injection", "path-traversal", "template-xss", "file-upload")

SHORT_FIELDS = ("scanner", "rule_id", "title", "category", "message", "source", "sink")
WHOLE_FIELDS = (*SHORT_FIELDS, "reasoning", "remediation")


def searchable(fields: tuple[str, ...], have: list[str]) -> Column:
    """The tokens of a row's fields between spaces; a field that the table lacks is empty."""
    return F.concat_ws(" ", *[token(F.col(f)) if f in have else F.lit("") for f in fields])


def family(short: Column, whole: Column) -> Column:
    """Semantic family of a detection; null for none."""
    both = lambda text, pair: matches(text, pair[0]) & matches(text, pair[1])
    return first_of(
        [
            (both(whole, _SECRET), "hardcoded-secret"), (matches(short, _COMMAND_D), "command-injection"), (both(short, _COOKIE), "session-cookie-hardening"), (matches(short, _XSS_D), "template-xss"),
            *[(matches(whole, p), name) for p, name in _FAMILY_T],
            (matches(short, _BUSINESS_D) | matches(whole, _BUSINESS_T), "business-logic"), (matches(whole, _CSRF_T), "csrf-protection"), (matches(short, _HEADER_D), "express-header-hardening"), (both(short, _TRANSPORT_D), "transport-security"),
        ],
        None,
    )


def family_width(fam: Column) -> Column:
    """Lines that one bucket of a family spans."""
    return F.when(fam.isin(*_WIDE), 10).when(fam.isin(*_WIDER), 15).otherwise(5)


def semantic_key(fam: Column, path: Column, line: Column, dependency: Column) -> Column:
    """Key of detections that say the same; null where they must stay apart."""
    key = F.concat_ws("|", normal_path(path, lower=True), fam, semantic_bucket(line, family_width(fam)))
    return F.when(~dependency & (or_empty(path) != "") & fam.isNotNull(), key)


def exact_key(path: Column, category: Column, title: Column, line: Column) -> Column:
    return F.concat_ws("|", normal_path(path, lower=True, default="unknown"), token(F.coalesce(category, F.lit("security"))), semantic_title(title), or_empty(line))


# What makes one detection of a family more useful than another.
_COOKIE_BONUS = (
    (r"(no.secure|missing.secure|secure.flag|secure.not.set|`secure` not set)", 80),
    (r"(httponly|http.only|same.site|samesite)", 50),
    (r"(default.cookie.configuration|default.session.cookie.configuration)", 25),
    (r"(default.session.cookie.name|default.cookie.name|connect.sid|fingerprint)", 10),
    (r"(no.domain|domain.not.set|expires.not.set|no.expires)", 5),
)
_SECRET_BONUS = ((r"(express.session|session.secret|express_hardcoded_secret|express-session-hardcoded-secret)", 50), (r"(generic.secret|generic-secret-assignment)", -10))


def actionability(fam: Column, whole: Column, category: Column) -> Column:
    total = lambda rules: sum((F.when(matches(whole, p), n).otherwise(0) for p, n in rules), F.lit(0))
    cookie = total(_COOKIE_BONUS) - F.when(category == "xss", 15).otherwise(0)
    return F.when(fam == "session-cookie-hardening", cookie).when(fam == "hardcoded-secret", total(_SECRET_BONUS)).otherwise(0)


def dependency_result(scanner: Column, rule_id: Column, raw: Column) -> Column:
    """Whether a package scanner reported a vulnerability."""
    named = F.get_json_object(raw, "$.VulnerabilityID").isNotNull() | F.get_json_object(raw, "$.id").isNotNull()
    return F.coalesce(scanner.isin("trivy", "osv-scanner") & (named | matches(rule_id, r"(?i)^CVE-\d{4}-\d+$") | matches(rule_id, "(?i)^GHSA-")), F.lit(False))


# Scores of detections and findings.
SEVERITY_WEIGHT = {"critical": 500, "high": 400, "medium": 300, "low": 200, "info": 100}
SCANNER_WEIGHT = {"taint-flow": 55, "taint-lite": 50, "config-checks": 45, "bearer": 40, "semgrep": 35, "custom-rules": 30, "gitleaks": 30}
STATUS_WEIGHT = {"confirmed_true_positive": 90, "confirmed": 85, "likely_true_positive": 75, "security_hotspot": 65, "needs_context": 60, "needs_dynamic_test": 55, "suspected": 50, "false_positive": 0}
CONFIDENCE_WEIGHT = {"confirmed": 40, "high": 30, "medium": 20, "low": 0}
TRIAGE_SEVERITY = {"critical": 100, "high": 80, "medium": 50, "low": 20, "info": 5}
TRIAGE_SCANNERS = ("correlation", "taint-flow", "taint-lite", "gitleaks", "config-checks")
TRIAGE_CATEGORIES = ("command-injection", "deserialization", "ssrf", "secrets", "xxe", "file-upload", "open-redirect", "business-logic", "authorization")
TRIAGE_PATH = r"(?i)(route|controller|auth|admin|api|bin/|cli|command|worker|job)"


def result_score() -> Column:
    """Triage score of a result row."""
    scanner, path = F.col("scanner"), or_empty(F.col("path"))
    out = score(F.col("severity"), TRIAGE_SEVERITY, 10) + role_score(file_role(path))
    out = out + F.when(scanner.isin(*TRIAGE_SCANNERS), 12).otherwise(0) + F.when(scanner == "source-patterns", 35).otherwise(0)
    out = out + F.when(matches(path, TRIAGE_PATH), 10).otherwise(0) + F.when(F.coalesce(F.col("category").isin(*TRIAGE_CATEGORIES), F.lit(False)), 8).otherwise(0)
    out = out + F.when(F.coalesce(F.col("raw").contains("sourceLine"), F.lit(False)), 8).otherwise(0)
    return out - F.when(matches(F.col("rule_id"), "(?i)generic-secret-assignment"), 20).otherwise(0)


def result_weight(action: Column) -> Column:
    return score(F.col("severity"), SEVERITY_WEIGHT, 0) + score(F.col("scanner"), SCANNER_WEIGHT, 0) + action + result_score()


def finding_weight(action: Column) -> Column:
    out = score(F.col("severity"), SEVERITY_WEIGHT, 0) + score(F.col("status"), STATUS_WEIGHT, 0) + score(F.col("confidence"), CONFIDENCE_WEIGHT, 0)
    return out + action + F.coalesce(F.col("exploitability_score"), F.lit(0))


def finding_state(status: Column, confidence: Column, severity: Column) -> Column:
    """Status after review of what the detector claimed."""
    settled = ("confirmed_true_positive", "likely_true_positive", "security_hotspot", "needs_context", "false_positive")
    return (
        F.when(status.isin(*settled), status)
        .when(status == "needs_dynamic_test", "security_hotspot")
        .when((status == "confirmed") & confidence.isin("confirmed", "high"), "confirmed_true_positive")
        .when((confidence == "high") & severity.isin("critical", "high"), "likely_true_positive")
        .when(confidence == "low", "needs_context")
        .otherwise(status)
    )


def local_exploitability() -> Column:
    """0 to 100 from severity, confidence, status and where the finding lies."""
    out = score(F.col("severity"), {"critical": 85, "high": 70, "medium": 45, "low": 20, "info": 5}, 30) + score(F.col("confidence"), {"confirmed": 10, "high": 8, "medium": 0, "low": -10}, 0)
    text = F.lower(F.concat_ws(" ", *[or_empty(F.col(c)) for c in ("category", "path", "source", "sink")]))
    out = out + F.when(matches(text, r"(route|controller|api|admin|auth|bin/|cli)"), 8).otherwise(0) + F.when(matches(text, "(secret|command|deserialization|ssrf)"), 8).otherwise(0)
    out = out + score(F.col("status"), {"confirmed_true_positive": 8, "likely_true_positive": 3, "security_hotspot": -8, "needs_context": -8}, 0)
    return F.when(F.col("status") == "false_positive", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), out)))


# Classes of vulnerabilities and the words that belong to them.
CLASS_WORDS = {
    "injection": r"\b(sql|nosql|command|cmd|injection|rce|exec|eval|template|ssti|deserial|prototype|xpath|ldap)\b",
    "xss": r"\b(xss|cross[- ]site|html|dom|script|innerhtml|dangerouslysetinnerhtml|template)\b",
    "auth": r"\b(auth|authentication|login|logout|session|jwt|token|password|credential|csrf|mfa|oauth|oidc|sso)\b",
    "authz": r"\b(authz|authorization|authorisation|access[- ]?control|idor|tenant|role|permission|privilege|admin|object[- ]?level)\b",
    "ssrf": r"\b(ssrf|server[- ]side request forgery|metadata|169\.254|outbound|webhook|fetch|axios|http client|url fetch|internal service)\b",
    "exposure": r"\b(secret|credential|password|token|api[_ -]?key|data exposure|information disclosure|log|backup|export|debug|metrics|pii|personal data)\b",
    "validation": r"\b(validation|input|upload|file|path|traversal|redirect|coupon|quantity|size|type|extension|mime|archive|zip)\b",
    "dependency": r"\b(dependency|package|library|component|cve|ghsa|supply chain|prototype|deserial|vulnerable)\b",
    "crypto": r"\b(crypto|cryptographic|hash|md5|sha1|jwt|signature|signing|hmac|cipher|encrypt|decrypt|tls|ssl)\b",
    "misconfig": r"\b(misconfig|configuration|cors|csrf|cookie|session|header|helmet|debug|metrics|deprecated|default)\b",
    "xxe": r"\b(xxe|xml external|xml|doctype|entity|noent|libxml|parsexml|sax|documentbuilder)\b",
    "business-logic": r"\b(business|logic|basket|cart|order|checkout|payment|coupon|discount|review|feedback|deluxe|workflow|race|quantity|price)\b",
}


def result_text() -> Column:
    return F.lower(F.concat_ws(" ", *[or_empty(F.col(c)) for c in ("scanner", "rule_id", "title", "category", "path", "message")], F.coalesce(F.col("raw"), F.lit("{}"))))


def matches_classes(classes: list[str]) -> Column:
    """Whether a result speaks of any of the classes; all do if none is asked for."""
    text = result_text()
    return F.lit(True) if not classes else F.greatest(*[matches(text, CLASS_WORDS[c]) for c in classes], F.lit(False))


def seed_classes() -> Column:
    """Every class that a result belongs to, in the classes' order."""
    text = result_text()
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(c)) for c, p in CLASS_WORDS.items()]))


_COMPLEX = r"(correlation|taint-flow|auth|authorization|tenant|ssrf|deserialization|prototype|rce|template|command|path-traversal|file-upload|cors|csrf)"


def review_tier() -> Column:
    """low, medium or high effort for a result's review."""
    points = result_score()
    hard = matches(F.lower(F.concat_ws(" ", *[or_empty(F.col(c)) for c in ("scanner", "rule_id", "title", "category", "path")])), _COMPLEX)
    severity = F.col("severity")
    top = (F.col("scanner") == "correlation") | ((severity == "critical") & hard) | ((severity == "high") & hard & (points >= 105))
    return F.when(top, "high").when(severity.isin("critical", "high") | (points >= 75), "medium").otherwise("low")


def dependency_impact(text: Column) -> Column:
    low = F.lower(text)
    return first_of([(matches(low, "(rce|remote code execution|code execution|template injection|ssti|command injection)"), "rce"), (matches(low, "prototype pollution"), "prototype-pollution"), (matches(low, "xss|cross-site scripting"), "xss"), (matches(low, "ssrf"), "ssrf")], "vulnerability")


# Kinds of provider errors, in the order in which they are tried.
_ERRORS = (
    (r"(^|\b)(401|403)(\b|$)|unauthori[sz]ed|authentication|invalid api key|api key[^.:\n]*(invalid|missing)|forbidden|permission denied", "authentication", False),
    (r"spending cap|spending limit|cap reached|budget exceeded|billing|credit balance is too low|insufficient credits|usage is blocked due to insufficient credits|plans?\s*(?:&|and)\s*billing|billing limit reached", "billing", True),
    (r"(^|\b)429(\b|$)|rate limit|too many requests|quota exceeded|usage limit reached|daily rate limit|limit will reset", "rate_limit", True),
    (r"(^|\b)(500|502|503|504)(\b|$)|server error|temporarily unavailable|service unavailable|overloaded|timeout|timed out|econnreset|etimedout", "server", True),
    (r"(^|\b)400(\b|$)|invalid request|bad request|schema rejected|schema validation|json validation|invalid json|context length|max(?:imum)? output tokens", "invalid_request", False),
)


def error_kind(message: Column) -> Column:
    low = F.lower(or_empty(message))
    return first_of([(matches(low, p), kind) for p, kind, _ in _ERRORS], "unknown")


def error_retryable(kind: Column) -> Column:
    return kind.isin(*[k for _, k, again in _ERRORS if again])




# How much a path suggests code that outsiders reach, the first that matches.
_SURFACE = ((r"(?i)(routes?|controllers?|api|server|entry|webhook)", 60), (r"(?i)(auth|session|login|permission|policy|tenant|admin)", 55), (r"(?i)(upload|download|file|storage)", 45), (r"(?i)(bin/|cli|command|task|rake|worker|job)", 35), (r"(?i)(crypto|secret|env|config)", 25))


def attack_surface_weight(path: Column) -> Column:
    out = F.lit(0)
    for pattern, points in reversed(_SURFACE):
        out = F.when(matches(path, pattern), points).otherwise(out)
    return out


def allowed_by_profile(profile: str) -> Column:
    """Whether a result belongs to a profile (all, cli, web, php, laravel, ruby, rails, node, python)."""
    path = or_empty(F.col("path"))
    text = F.lower(F.concat_ws(" ", F.col("rule_id"), or_empty(F.col("category")), path))
    if profile == "cli":
        return matches(text, r"(cli|argv|command|shell|bin/|scripts/|task|rake|cobra|click|argparse)")
    if profile == "web":
        return ~matches(text, "(cli|argv|shell-script)")
    if profile in ("php", "laravel"):
        return text.contains("php") | text.contains("laravel") | matches(path, r"\.(php|blade\.php)$")
    if profile in ("ruby", "rails"):
        return text.contains("ruby") | text.contains("rails") | matches(path, r"\.(rb|erb)$")
    if profile == "node":
        return text.contains("js-") | text.contains("node") | matches(path, r"\.(js|jsx|ts|tsx)$")
    if profile == "python":
        return text.contains("python") | matches(path, r"\.(py)$")
    return F.lit(True)


def auditable(path: Column, lang: Column, lines: Column, content: Column) -> Column:
    """Whether a file is worth reading for an audit."""
    known = ~lang.isin("binary", "unknown") & ~reusable_role(file_role(path, lang))
    return (lines > 0) & known & ~matches(path, r"(?i)(package-lock\.json|yarn\.lock|dist/|build/|coverage/|pnpm-lock\.yaml)") & (F.length(content) <= 250_000)
