"""Detectors that scan texts by rules and windows. Each maps files (schemas.FILES) to results (schemas.RESULTS).

A line is tested by its own pattern first; only lines that pass get a window, cut from the file's
array of lines, so nothing is shuffled and no window is built for the rest.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import file_role, reusable_role
from siltstone.functions.rules import CATEGORIES, CONFIG_RULES, DEFAULT_RULES, RUNTIME_SECRETS
from siltstone.functions.text import explode_lines, extension, function_window, hits, line_slice, lines, matches, may_match, redact, required_literals, trim, window
from siltstone.operators.core import first_wins, top_per_key
from siltstone.schemas import FILE_SPAN, PLACES, RESULTS, RULES, columns_of
from siltstone.sources.files import routes


def _results(df: DataFrame, scanner: str, **columns: Column) -> DataFrame:
    made = {"scanner": F.lit(scanner), "end_line": columns["start_line"], "raw": F.lit(None).cast("string"), "ord": F.col("ord"), "path": F.col("path"), **columns}
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    return df.select(*[made[c].cast(kinds[c]).alias(c) for c in columns_of(RESULTS)])


def _order(rule: Column, place: Column) -> Column:
    """ord of a hit: the file's, then the rule's, then the hit's place among that rule's."""
    return F.col("ord") * FILE_SPAN + rule.cast("long") * PLACES + place


def _line_order(line: Column, rule: Column) -> Column:
    """ord of a hit: the file's, then the line's (or route's), then the rule's."""
    return F.col("ord") * FILE_SPAN + line.cast("long") * RULES + rule


# A secret's kind by its text; the original's classifier is not public, so this is our own contract.
def classify_secret(text: Column, path: Column) -> Column:
    """struct<kind, confidence>: placeholder or test values are low, known key formats high, the rest medium."""
    dummy = matches(text, r"(?i)(example|dummy|changeme|placeholder|your[_-]?|xxxx|<[a-z_]+>|\$\{)")
    known = matches(text, r"(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_|xox[baprs]-|-----BEGIN|eyJ[A-Za-z0-9_-]{10,}\.)")
    role = file_role(path)
    kind = F.when(dummy, "placeholder").when(role.isin("test", "fixture", "docs"), "test-fixture").when(known, "live-credential").otherwise("generic-secret")
    return F.struct(kind.alias("kind"), F.when(known & ~dummy, "high").when(dummy | role.isin("test", "fixture", "docs"), "low").otherwise("medium").alias("confidence"))


def _numbered_hit(rule: int, *fields: str):
    """A hit's fields with the number of its rule and its place among that rule's hits."""
    return lambda h, k: F.struct(F.lit(rule).alias("rule"), k.alias("nth"), *[h[f].alias(f) for f in fields])


# In Java \w is ASCII alone.
_ASCII_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b between ASCII letters, digits and _ and others alone, as rules are written; here it would count accents as letters."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + _ASCII_BOUND, pattern)


def custom_rules(files: DataFrame, rules: list[tuple] = DEFAULT_RULES) -> DataFrame:
    """Every match of every rule over whole contents, with the line it starts on.

    One scan: first the rules that a file's extension and plain texts that a pattern cannot do
    without leave, as an array; then one test of each pattern left; then a pass that locates matches.
    """
    ext, content = extension(F.col("path")), F.col("content")
    patterns = F.array(*[F.lit(f"(?im){ascii_bounds(r[5])}") for r in rules])
    lowered = files.select("path", "ord", "content", ext.alias("ext"), F.lower("content").alias("low")).where("content IS NOT NULL")
    maybe = []
    for r in rules:
        need = [F.col("low").contains(t) for t in required_literals(r[5])]
        held = reduce(lambda a, b: a | b, need) if need else F.lit(True)
        maybe.append(F.col("ext").isin(*r[3]) & held if r[3] else held)
    which = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(maybe)]))
    rows = lowered.select("path", "ord", "content", F.explode(which).alias("rule")).where(F.rlike("content", F.get(patterns, F.col("rule"))))
    rows = rows.select("path", "ord", "rule", F.posexplode(hits(content, F.get(patterns, F.col("rule")))).alias("nth", "h")).select("path", "ord", "rule", "nth", "h.*")
    meta = F.array(*[F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("category"), F.lit(r[4]).alias("title")) for r in rules])
    rows = rows.withColumn("r", F.get(meta, F.col("rule")))
    value = trim(F.regexp_extract("hit", r"(?s)[:=]\s*(.+)$", 1))
    plain = trim(F.regexp_replace(value, r"[),;\]}]+$", ""))
    runtime = F.greatest(*[matches(plain, f"(?i){p}") for p in RUNTIME_SECRETS])
    secret = F.col("r.category") == "secrets"
    rows = rows.where(~(secret & (value != "") & runtime)).withColumn("secret", F.when(secret, classify_secret(F.col("hit"), F.col("path"))))
    text = redact(F.substring("hit", 1, 300))
    message = F.when(secret, F.concat(text, F.lit(" (secret classification: "), F.col("secret.kind"), F.lit(", confidence: "), F.col("secret.confidence"), F.lit(")"))).otherwise(text)
    known = {c: (cwe, owasp) for c, cwe, owasp in CATEGORIES}
    of = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in known.items() for x in (c, v[k])]), F.col("r.category")), F.lit(known["security"][k]))
    raw = F.to_json(F.struct(F.struct(F.col("r.id").alias("id"), F.col("r.category").alias("category"), of(0).alias("cwe"), of(1).alias("owasp"), F.lit("medium").alias("confidence")).alias("rule"), F.col("secret").alias("secretClassification")))
    return _results(rows, "custom-rules", rule_id=F.col("r.id"), title=F.col("r.title"), category=F.col("r.category"), severity=F.col("r.severity"), start_line=F.col("line"), message=message, raw=raw, ord=_order(F.col("rule"), F.col("nth")))


def config_checks(files: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<rule:int,nth:int,line:int>>")
    out = []
    for i, (_, _, _, _, pattern, where, _, _) in enumerate(CONFIG_RULES):
        found = F.transform(hits(F.col("content"), pattern), _numbered_hit(i, "line"))
        held = may_match(F.col("content"), F.col("low"), pattern)
        out.append(F.when(matches(F.col("path"), where) & held if where else held, found).otherwise(empty))
    rows = files.select("path", "ord", "content", F.lower("content").alias("low")).select("path", "ord", F.explode(F.concat(*out)).alias("h")).select("path", "ord", "h.*")
    names = ("id", "title", "category", "severity", "pattern", "where", "cwe", "fix")
    meta = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r)]) for r in CONFIG_RULES])
    rows = rows.withColumn("r", F.get(meta, F.col("rule")))
    raw = F.to_json(F.struct("r.cwe", "r.fix", F.lit("A05:2021-Security Misconfiguration").alias("owasp")))
    return _results(rows, "config-checks", rule_id=F.col("r.id"), title=F.col("r.title"), category=F.col("r.category"), severity=F.col("r.severity"), start_line=F.col("line"), message=F.col("r.fix"), raw=raw, ord=_order(F.col("rule"), F.col("nth")))


def quality(files: DataFrame, most: int = 1000) -> DataFrame:
    """Files of more lines than that."""
    rows = files.where(F.col("line_count") > most)
    return _results(rows, "quality", rule_id=F.lit("large-file"), title=F.lit("Large source file"), category=F.lit("maintainability"), severity=F.lit("low"), start_line=F.lit(1), end_line=F.col("line_count"), message=F.lit("Large files are harder to review for security-critical behavior."))


# Patterns of the line rules below, each named by what it looks for.
_XML = r"(?i)(parseXml|DOMParser|SAXParser|DocumentBuilderFactory|libxml|xml2js|lxml|etree)"
_XML_OPEN = r"(?i)(noent\s*:\s*true|resolve_entities\s*=\s*true|external-general-entities|load-external-dtd|expandEntityReferences\s*\(\s*true)"
_XML_INPUT = r"(?i)(req\.|request\.|file\.buffer|body|params|query|\$_(POST|FILES|REQUEST)|input)"
_REQUEST = r"(?i)(req|request)\.(query|params|body|headers|url|originalUrl)|\$_(GET|POST|REQUEST|SERVER)|params\[|request\.(args|form|json)"
_SAFE_TARGET = r"(?i)(allowlist|whitelist|allowedRedirect|allowedOrigins|sameOrigin|URLPattern|new URL\([^)]*baseUrl|startsWith\(['\"]/|isLocalUrl|safeRedirect|validateRedirect)"
_OBJECT_ID = r"(?i)(req|request)\.(params|body|query)\.(userId|user_id|ownerId|owner_id|tenantId|tenant_id|accountId|account_id|customerId|customer_id|organizationId|organisationId|orgId|basketId|cartId|orderId|paymentId|invoiceId|profileId|reviewId|id)\b|params\[['\"](userId|user_id|ownerId|tenantId|accountId|customerId|orgId|basketId|cartId|orderId|paymentId|invoiceId|profileId|reviewId|id)['\"]\]"
_OWNER_GUARD = r"(?i)(authorize|authorize!|policy|can\?|requireOwner|requirePermission|isAuthorized|appendUserId|security\.isAuthorized|security\.authenticatedUsers|ownership|belongsTo|scopeToCurrentUser|current_user)"
_PRINCIPAL = r"(?i)(req\.user|request\.user|res\.locals\.user|ctx\.user|context\.user|session\.user|currentUser|current_user|principal|auth\.user)"
_COMPARED = r"(?i)(===|!==|==|!=|userId\s*:\s*(req\.user|request\.user|res\.locals\.user|ctx\.user|context\.user|session\.user|currentUser|current_user|principal|auth\.user)\.id|ownerId\s*:\s*(req\.user|request\.user|res\.locals\.user|ctx\.user|context\.user|session\.user|currentUser|current_user|principal|auth\.user)\.id|tenantId\s*:\s*(req\.user|request\.user|res\.locals\.user|ctx\.user|context\.user|session\.user|currentUser|current_user|principal|auth\.user)\.tenantId)"
_URL_GUARD = r"(?i)(allowlist|whitelist|allowedHost|allowedOrigin|URLPattern|validateUrl|validateURL|safeUrl|safeURL|isPrivateIp|privateIp|blockInternal|dns\.lookup|net\.isIP|ipaddr|new URL\(|hostname|protocol|startsWith\(['\"]https?://[^'\"]+['\"]\))"
_OUTBOUND = r"(?i)\b(?:fetch|axios\.(?:get|post|request)|instance\.(?:get|post|request)|request\s*\(|http\.get|https\.get)\s*\("
_LIMITER_OFF = r"(?i)^\s*//\s*if\s*\(\s*this\.limiter\s*\)\s*handlers\.unshift\s*\(\s*this\.limiter\s*\)"
_WRAPPERS = (
    r"(?i)(?:^|\n)\s*(?:export\s+)?(?:async\s+)?function\s+[A-Za-z_$][\w$]*\s*\(\s*([A-Za-z_$][\w$]*)",
    r"(?i)(?:^|\n)\s*(?:(?:public|private|protected|static|async)\s+)*(?:get|post|raw|request|getImage|getUrl|fetchUrl)\s*(?:<[^>\n]+>)?\s*\(\s*([A-Za-z_$][\w$]*)",
    r"(?i)(?:^|\n)\s*(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(?:async\s*)?\(\s*([A-Za-z_$][\w$]*)",
)
_TARGETS = (r"(?i)\b(?:res\.redirect|reply\.redirect|redirect_to|redirect)\s*\(\s*([^),;]+)", r"(?i)header\s*\(\s*['\"]Location:\s*\$\{?([^}'\"]+)", r"(?i)\blocation\.href\s*=\s*([^;]+)")
SENSITIVE_ROUTE = r"(?i)/(admin|internal|debug|metrics|logs?|export|users?|accounts?|basket|cart|orders?|checkout|payment|invoice|profile|settings|token|session|password|coupon|review|feedback|deluxe)\b"
ROUTE_GUARD = r"(?i)(requireAuth|isAuthenticated|isAuthorized|authorize|authenticated|security\.isAuthorized|appendUserId|csrf|permission|policy|role|guard|middleware)"


def _first_group(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches captures; null for none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def redirect_target(line: Column) -> Column:
    return trim(_first_group(line, _TARGETS))


def from_request(expression: Column, around: Column) -> Column:
    """Whether an expression is request input, or a variable that the window assigns from it."""
    name = F.regexp_extract(expression, r"^[A-Za-z_$][\w$]*", 0)
    pairs = F.arrays_zip(F.regexp_extract_all(around, F.lit(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*([^;\n]+)"), F.lit(1)).alias("k"), F.regexp_extract_all(around, F.lit(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*([^;\n]+)"), F.lit(2)).alias("v"))
    value = F.get(F.filter(pairs, lambda p: F.lower(p["k"]) == F.lower(name)), F.lit(0))["v"]
    return matches(expression, _REQUEST) | ((name != "") & matches(value, _REQUEST))


def safe_target(expression: Column, around: Column) -> Column:
    return matches(trim(expression), r"^['\"]/(?!/)") | matches(around, _SAFE_TARGET)


def owner_guarded(around: Column) -> Column:
    return matches(around, _OWNER_GUARD) | (matches(around, _PRINCIPAL) & matches(around, _COMPARED))


def wrapper_parameter(around: Column) -> Column:
    return _first_group(around, _WRAPPERS)


# The line rules' names, titles and patterns, with the conditions that go with each.
def _line_rules() -> list[tuple]:
    """(id, title, category, severity, pattern of the line, condition) with the line's file at hand."""
    line, ls, i = F.col("line"), F.col("lines"), F.col("i")
    around, within = lambda r: window(ls, i, r, r), lambda r: function_window(ls, i, r)
    has, lacks = matches, lambda c, p: ~matches(c, p)
    target, next_lines = redirect_target(line), window(ls, i, 0, 2)
    parameter = wrapper_parameter(around(20))
    called = F.transform(F.regexp_extract_all(next_lines, F.lit(r"(?i)\b(?:fetch|axios\.(?:get|post|request)|instance\.(?:get|post|request)|request|http\.get|https\.get)\s*\(\s*([A-Za-z_$][\w$]*)"), F.lit(1)), F.lower)
    todo_off = ~F.exists(F.slice(ls, i + 2, 3), lambda s: s.rlike(_LIMITER_OFF))
    return [
        ("source-xxe-unsafe-parser", "XML parser expands entities for user-controlled XML", "xxe", "high", _XML, has(around(4), _XML_OPEN) & has(F.col("content"), _XML_INPUT)),
        (
            "source-zip-slip-entry-path", "Archive entry path is written without base-directory enforcement", "file-upload", "high", r"(?i)(entry\.path|createWriteStream|writeFile|extract|pipe)",
            has(around(8), r"(?i)(entry\.path|zipEntry\.entryName|fileName|filename)") & has(around(8), r"(?i)(unzipper|adm-zip|yauzl|ZipFile|extract|archive)") & has(around(8), r"(?i)(createWriteStream|writeFile|copyFile|extract|pipe)") & lacks(around(8), r"(?i)(normalize|realpath|startsWith|basename|path\.isAbsolute|safeJoin|validate)"),
        ),
        ("source-nosql-where-concat", "NoSQL query uses string-built $where predicate", "injection", "high", r"\$where\s*:\s*['\"`][^'\"`]*['\"`]\s*\+", F.lit(True)),
        ("source-open-redirect-variable", "Redirect uses variable target that needs strict allowlist review", "open-redirect", "medium", "|".join(_TARGETS), from_request(target, around(6)) & ~safe_target(target, around(6))),
        (
            "source-session-regenerate-missing", "Login assigns a session principal without regenerating the session id", "auth", "high", r"\b(req|request)\.session\.(user|admin|account|principal)\s*=",
            has(within(18), r"(?i)(login|signin|password|compare|findOne|findBy|authenticate)") & lacks(within(18), r"(?i)\.session\.regenerate\s*\("),
        ),
        ("source-rate-limiter-disabled", "Rate limiter appears disabled on routed requests", "auth", "medium", r"(?i)limiter", has(line, _LIMITER_OFF) | (has(line, r"(?i)TODO:?\s+.*\blimiter\b") & has(around(3), r"(?i)this\.limiter|rateLimit|handlers\.unshift") & todo_off)),
        (
            "source-request-url-to-service-fetch", "Request-controlled URL is passed to an outbound fetch helper", "ssrf", "high", r"(?i)\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:req|request)\.(?:body|query|params)\.(?:url|uri|href|link|target)\b",
            has(within(14), r"(?i)\b(getImage|getUrl|fetchUrl|HttpService\.get|ScraperService\.getImage|axios\.get|fetch|request)\s*\(\s*[A-Za-z_$][\w$]*") & lacks(within(14), _URL_GUARD),
        ),
        ("source-ssrf-wrapper-unvalidated-url", "Outbound request wrapper accepts arbitrary URL input without validation", "ssrf", "high", _OUTBOUND, F.coalesce(F.array_contains(called, F.lower(parameter)), F.lit(False)) & lacks(around(20), _URL_GUARD)),
        (
            "source-next-path-proxy-fetch", "Next route proxies request pathname to fetch without path validation", "ssrf", "high", r"(?i)\bfetch\s*\(\s*[A-Za-z_$][\w$]*",
            has(within(14), r"(?i)request\.nextUrl\.pathname") & has(within(14), r"(?i)\bprepareUrl\s*\(") & lacks(within(14), r"(?i)(decodeURIComponent|path\.normalize|basename|\bstartsWith\b|\ballowlist\b|\ballowed\b|\bvalidate(?:Url|URL)?\b|\bsafePath\b|\breject\b|URLPattern)"),
        ),
        ("source-url-join-collapse-normalization", "URL builder collapses slash characters instead of validating URL path boundaries", "ssrf", "medium", r"(?i)\.replace\s*\(\s*/\[//\]\+/[gimyus]*\s*,\s*['\"]/['\"]\s*\)", F.lit(True)),
        (
            "source-request-controlled-object-id", "Request-controlled object identifier is used without an ownership check", "authorization", "high", r"(?i)(findOne|findByPk|findById|findUnique|findFirst|update|updateOne|delete|deleteOne|destroy|remove|where)\s*\(",
            has(within(18), _OBJECT_ID) & ~owner_guarded(within(18)),
        ),
        (
            "source-mass-assignment-user-fields", "Request body is assigned into a model update without field allowlisting", "business-logic", "medium", r"(?i)(update|create|assign|merge|save)\s*\(",
            has(within(12), r"(?i)(req|request)\.(body|json)\b") & has(within(12), r"(?i)(userId|ownerId|tenantId|role|isAdmin|price|quantity|discount|balance|credit|status)\b") & lacks(within(12), r"(?i)(pick|omit|allowlist|whitelist|schema|validate|zod|joi|yup|permitted|permit\()"),
        ),
        (
            "source-price-quantity-from-client", "Business-critical price or quantity field is trusted from request data", "business-logic", "medium", r"(?i)(create|update|save|charge|checkout|purchase|add|apply|calculate)",
            has(within(12), r"(?i)(checkout|order|payment|basket|cart|coupon|discount|price|quantity)") & has(within(12), r"(?i)(req|request)\.(body|query|params)\.(price|amount|total|quantity|qty|discount|coupon|role|isAdmin)\b") & lacks(within(12), r"(?i)(allowlist|whitelist|allowed|sameOrigin|URLPattern|startsWith\(['\"]/)"),
        ),
        (
            "source-file-extension-validation", "File upload validation relies on client-controlled filename or MIME metadata", "file-upload", "medium", "",
            has(around(5), r"(?i)(originalname|mimetype|contentType|filename)") & has(around(5), r"(?i)(substr|split|endsWith|includes|match|extension|extname)") & has(around(5), r"(?i)(upload|file|multer|multipart)"),
        ),
    ]


def _source_candidates(files: DataFrame) -> DataFrame:
    source = matches(F.col("path"), r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|py|php|rb|go|java|cs|vue|svelte)$") | F.lower("language").isin("javascript", "typescript", "python", "php", "ruby", "go", "java", "csharp")
    return files.where(source & ~reusable_role(file_role(F.col("path"), F.col("language"))))


def _source_result(df: DataFrame, rule_id, title, category, severity, line: Column, message: Column, order: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    text = F.substring(message, 1, 300)
    raw = F.to_json(F.struct(F.lit("Static source-pattern seed; validate before remediation.").alias("description"), F.lit("medium").alias("confidence"), message.alias("sourceLine")))
    return _results(df, "source-patterns", rule_id=lit(rule_id), title=lit(title), category=lit(category), severity=lit(severity), start_line=line, message=text, raw=raw, ord=order)


def source_patterns(files: DataFrame) -> DataFrame:
    """14 line rules, route guards, distinct login messages and state-changing GETs; unique by rule, path and line."""
    kept = _source_candidates(files)
    rules = _line_rules()
    rows = explode_lines(kept)
    passed = F.array_compact(F.array(*[F.when(matches(F.col("line"), p) & cond if p else cond, F.lit(k)) for k, (_, _, _, _, p, cond) in enumerate(rules)]))
    found = rows.select("path", "ord", "i", "line", F.explode(passed).alias("rule"))
    meta = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "title", "category", "severity"), r[:4])]) for r in rules])
    found = found.withColumn("r", F.get(meta, F.col("rule")))
    by_line = _source_result(found, F.col("r.id"), F.col("r.title"), F.col("r.category"), F.col("r.severity"), F.col("i") + 1, trim(F.col("line")), _line_order(F.col("i"), F.col("rule")))
    at = routes(kept.withColumn("ls", lines(F.col("content"))))
    label = F.concat_ws(" ", "method", "route_path")
    near = line_slice(F.col("ls"), F.col("start_line") - 1, F.col("start_line") + 3)
    bare = at.where(F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "ALL", "USE") & matches(F.col("route_path"), SENSITIVE_ROUTE) & ~matches(near, ROUTE_GUARD))
    shop = matches(F.col("route_path"), "(?i)(basket|cart|order|checkout|payment|coupon|review|feedback|deluxe)")
    grave = matches(F.col("route_path"), "(?i)(admin|internal|export|token|password|payment|checkout)")
    guards = _source_result(bare, "source-sensitive-route-without-guard", "Sensitive route lacks an obvious inline authentication or authorization guard", F.when(shop, "business-logic").otherwise("authorization"), F.when(grave, "high").otherwise("medium"), F.col("start_line"), label, _order(F.lit(RULES - 4), F.col("k")))
    gets = at.where((F.col("method") == "GET") & matches(F.col("route_path"), "(?i)(logout|signout|delete|destroy|revoke|disconnect|deactivate)") & ~matches(window(F.col("ls"), F.col("start_line") - 1, 4, 4), "(?i)(csrf|sameSite|idempotent|safeLogout)"))
    logout = _source_result(gets, "source-state-changing-get-logout", "State-changing logout route uses GET", "auth", "medium", F.col("start_line"), label, _order(F.lit(RULES - 2), F.col("k")))
    said = F.transform(F.regexp_extract_all("content", F.lit(r"(?i)message\s*:\s*(?:\{[^}]*content\s*:\s*)?['\"`]([^'\"`]+)['\"`]"), F.lit(1)), F.lower)
    who, what = "user .*not found|unknown user|no such user", "invalid password|wrong password|bad password"
    login = kept.where(F.exists(said, lambda m: m.rlike(who)) & F.exists(said, lambda m: m.rlike(what))).withColumn("ls", lines(F.col("content")))
    first = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.size("ls")), lambda k: F.get(F.col("ls"), k - 1).rlike(f"(?i){who}"))), F.lit(1))
    login = login.withColumn("_at", first)
    spoken = F.coalesce(F.nullif(trim(F.get("ls", F.col("_at") - 1)), F.lit("")), F.lit("distinct login failure messages"))
    distinct = _source_result(login, "source-login-distinct-failure-messages", "Login flow exposes distinct username and password failure messages", "auth", "medium", F.col("_at"), spoken, _order(F.lit(RULES - 3), F.lit(0)))
    every = by_line.unionByName(guards).unionByName(distinct).unionByName(logout)
    return first_wins(every, ["rule_id", "path", "start_line"])


_SOURCE_FILE = r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|py|php|rb|go|java|cs)$"
# What routes' bodies say about ownership, money and workflow.
_INV_OBJECT = r"(?i)\b(req|request)\.(params|body|query)\.(userId|user_id|ownerId|owner_id|tenantId|tenant_id|orgId|organizationId|accountId|customerId|basketId|cartId|orderId|invoiceId|paymentId|reviewId|id)\b"
_INV_CALL = r"(?i)(findById|findOne|findUnique|findFirst|update|delete|destroy|remove|save|create)\s*\("
_INV_PAY = r"(?i)(create|update|save|checkout|charge|purchase|add|apply|calculate)\s*\("
_INV_OWNER = r"(?i)\b(authorize|authorize!|policy|can\?|requireOwner|requirePermission|isAuthorized|ownership|belongsTo|scopeToCurrentUser|current_user|req\.user|request\.user|ctx\.user|session\.user|tenantId\s*:|ownerId\s*:|userId\s*:)\b"
_INV_MONEY = r"(?i)\b(req|request)\.(body|query|params)\.(price|amount|total|quantity|qty|discount|coupon|balance|credit)\b"
_INV_FLOW = r"(?i)\b(status|state|stage|approved|confirmed|paid|checkout|payment|publish|activate|deactivate|delete|cancel|refund)\b"
_INV_WRITE = r"(?i)\b(create|update|save|delete|destroy|remove|checkout|charge|refund|confirm|approve|publish|activate)\s*\("
_INV_TENANT = r"(?i)\b(tenantId|tenant_id|orgId|organizationId|organisationId|accountId|workspaceId)\b"
_ID_PARAMETER = r":([A-Za-z_]*(?:id|Id))\b"


def _routes_with_body(files: DataFrame, length: int) -> DataFrame:
    at = routes(files.where(matches(F.col("path"), _SOURCE_FILE)).withColumn("ls", lines(F.col("content"))))
    return at.withColumn("body", line_slice(F.col("ls"), F.col("start_line"), F.col("start_line") + length - 1))


def business_invariants(files: DataFrame) -> DataFrame:
    """Routes whose body lacks an ownership, price or workflow check."""
    at, body = _routes_with_body(files, 18), F.col("body")
    owner = (matches(body, _INV_OBJECT) | matches(F.col("route_path"), _ID_PARAMETER)) & matches(body, _INV_CALL) & ~matches(body, _INV_OWNER)
    money = matches(body, _INV_MONEY) & matches(body, _INV_PAY) & ~matches(body, r"(?i)\b(recalculate|serverCalculated|priceService|catalog|inventory|validate|schema|allowlist|pick)\b")
    flow = matches(body, _INV_FLOW) & matches(body, _INV_WRITE) & ~matches(body, r"(?i)\b(status\s*===|state\s*===|assertState|requireState|transition|nonce|csrf|approved|paid)\b")
    kinds = (
        (owner, "business-invariant-missing-ownership-guard", "Route uses request-controlled object identifiers without an obvious ownership guard", "high"),
        (money, "business-invariant-client-financial-field", "Business-critical financial field appears trusted from request data", "medium"),
        (flow, "business-invariant-missing-workflow-state-guard", "Workflow side effect lacks an obvious prior-state guard", "medium"),
    )
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("n"), F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(s).alias("severity"))) for k, (c, i, t, s) in enumerate(kinds)]))
    rows = at.select("path", "ord", "k", "method", "route_path", "start_line", F.explode(hit).alias("h"))
    raw = F.to_json(F.struct(F.when(F.col("h.severity") == "high", "high").otherwise("medium").alias("confidence")))
    out = _results(rows, "business-invariants", rule_id=F.col("h.id"), title=F.col("h.title"), category=F.lit("business-logic"), severity=F.col("h.severity"), start_line=F.col("start_line"), message=F.concat_ws(" ", "method", "route_path"), raw=raw, ord=_line_order(F.col("k"), F.col("h.n")))
    return first_wins(out, ["rule_id", "path", "start_line"])


def discover_invariants(files: DataFrame, most: int = 200) -> DataFrame:
    """id, title, category, path, line, rule, evidence, confidence: what each route must uphold."""
    at, body, path = _routes_with_body(files, 14), F.col("body"), F.col("route_path")
    kinds = (
        (matches(body, _INV_OBJECT) | matches(path, _ID_PARAMETER), "ownership", "Object ownership must be enforced", "must bind request object identifiers to the authenticated subject or tenant.", "high"),
        (matches(body, _INV_TENANT), "tenant-isolation", "Tenant scope must dominate data access", "must enforce tenant or organization scope on every read and write.", "high"),
        (matches(body, _INV_MONEY) | matches(path, r"(?i)\b(cart|basket|checkout|order|payment|coupon|discount)\b"), "financial-integrity", "Financial values must be server-trusted", "must compute prices, totals, discounts, and quantities server-side or validate them against trusted state.", "medium"),
        (matches(body, _INV_FLOW) & matches(body, _INV_WRITE), "workflow-state", "Workflow state must be enforced before side effects", "must enforce the prior workflow state before applying side effects.", "medium"),
    )
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("n"), F.lit(cat).alias("category"), F.lit(t).alias("title"), F.lit(r).alias("rule"), F.lit(conf).alias("confidence"))) for n, (c, cat, t, r, conf) in enumerate(kinds)]))
    rows = at.select("path", "ord", "k", "method", "route_path", F.col("start_line").alias("line"), "body", F.explode(hit).alias("h"))
    evidence = F.substring(F.array_join(F.slice(F.filter(F.transform(lines(F.col("body")), trim), lambda s: s != ""), 1, 6), " | "), 1, 700)
    rule = F.concat(F.lit("Route "), F.col("method"), F.lit(" "), F.col("route_path"), F.lit(" "), F.col("h.rule"))
    out = rows.select(F.concat_ws(":", "h.category", "path", "line").alias("id"), "h.title", "h.category", "path", "line", rule.alias("rule"), evidence.alias("evidence"), "h.confidence", _line_order(F.col("k"), F.col("h.n")).alias("ord"))
    return first_wins(out, ["category", "path", "line"]).orderBy("ord").limit(most)


# Controls, and the evidence that speaks for or against them. (id, title, ids of the frameworks, expectation, remediation)
_CONTROLS = (
    ("auth-access-control", "Access control evidence", ("SOC2 CC6.1", "SOC2 CC6.2", "ISO27001 A.5.15", "ISO27001 A.5.18"), "Sensitive actions should require server-side authentication and authorization checks.", "Document protected routes and add explicit auth/authz middleware or policy checks where sensitive actions are handled."),
    ("session-cookie-protection", "Session cookie protection", ("SOC2 CC6.1", "ISO27001 A.8.20", "ISO27001 A.8.24"), "Session cookies should use Secure and HttpOnly flags in production.", "Set Secure and HttpOnly on session cookies and enforce HTTPS in production."),
    ("audit-logging", "Security event logging evidence", ("SOC2 CC7.2", "SOC2 CC7.3", "ISO27001 A.8.15", "ISO27001 A.8.16"), "Security-relevant events should be logged for monitoring and investigation.", "Log authentication, authorization, admin, data export, and security-sensitive changes with stable event names and actor identifiers."),
    ("secret-management", "Secret management posture", ("SOC2 CC6.1", "ISO27001 A.5.17", "ISO27001 A.8.12"), "Secrets should be loaded from protected runtime stores and not committed to source.", "Document runtime secret storage and rotation ownership."),
    ("change-management", "Change management evidence", ("SOC2 CC8.1", "ISO27001 A.8.32"), "Code changes should have review ownership and CI evidence.", "Add CODEOWNERS and CI workflows that run tests/security checks before merge."),
    ("vulnerability-management", "Vulnerability management evidence", ("SOC2 CC7.1", "SOC2 CC7.2", "ISO27001 A.8.8"), "Dependencies and source should be scanned regularly with tracked remediation.", "Add scheduled dependency and code scanning in CI, then track remediation for high-risk results."),
    ("crypto-transport", "Cryptography and transport protection", ("SOC2 CC6.7", "ISO27001 A.8.20", "ISO27001 A.8.24"), "Production systems should use strong crypto and TLS validation.", "Remove weak cryptographic primitives, keep TLS verification enabled, and document approved crypto settings."),
)
# (kind, whether the pattern is of the path rather than of the text, pattern, note)
_EVIDENCE = (
    ("auth", False, r"(?i)\b(requireAuth|authenticate|authorize|permission|policy|can\?|current_user|currentUser|before_action\s+:authenticate_user|isAuthenticated|passport\.authenticate|jwt\.verify)\b", "authentication or authorization control"),
    ("cookie-off", False, r"(?i)(secure\s*[:=]\s*false|SESSION_COOKIE_SECURE\s*=\s*False|httponly\s*[:=]\s*false|SESSION_COOKIE_HTTPONLY\s*=\s*False|session\.cookie_(secure|httponly)\s*=\s*0)", "session cookie protection disabled"),
    ("cookie-secure", False, r"(?i)(secure\s*[:=]\s*true|SESSION_COOKIE_SECURE\s*=\s*True|session\.cookie_secure\s*=\s*1|config\.force_ssl\s*=\s*true)", "secure cookie or forced TLS evidence"),
    ("cookie-http", False, r"(?i)(httpOnly\s*[:=]\s*true|httponly\s*[:=]\s*true|SESSION_COOKIE_HTTPONLY\s*=\s*True|session\.cookie_httponly\s*=\s*1)", "HttpOnly cookie evidence"),
    ("audit", False, r"(?i)\b(audit[_-]?log|security[_-]?event|AuditLog|logger\.(info|warn|error)[^\n]*(auth|login|permission|admin|user[_-]?id|security))\b", "security/audit logging evidence"),
    ("secret", False, r"(?i)\b(process\.env|import\.meta\.env|Deno\.env|getenv|ENV\[|os\.environ|credentials|vault|secretsmanager|secret manager)\b", "runtime secret loading evidence"),
    ("scan", False, r"(?i)\b(npm audit|pnpm audit|yarn audit|bundle audit|pip-audit|safety|trivy|osv-scanner|semgrep|gitleaks|snyk)\b", "vulnerability scanning command"),
    ("tls", False, r"(?i)\b(force_ssl\s*=\s*true|Strict-Transport-Security|helmet\s*\(|HSTS|httpsOnly|sslmode=require)\b", "transport security hardening evidence"),
    ("owners", True, r"(?i)(^|/)(CODEOWNERS|\.github/CODEOWNERS)$", "CODEOWNERS review ownership evidence"),
    ("ci", True, r"(?i)(^|/)(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.ya?ml|bitbucket-pipelines\.ya?ml)$", "CI workflow evidence"),
    ("bots", True, r"(?i)(^|/)(dependabot\.ya?ml|renovate\.json|\.github/workflows/[^/]*(security|scan|semgrep|trivy|osv|snyk|gitleaks)[^/]*\.ya?ml)$", "dependency or security scanning automation"),
)
_SECRETS_FIX = "Move committed secrets into a secret manager, rotate exposed values, and scrub repository history."


def compliance(files: DataFrame, results: DataFrame) -> DataFrame:
    """Seven controls, a row each: pass, fail or unknown by what the files and earlier results show.

    Evidence is the first match of a file, in the order of files, ten a kind; the ten come from a
    minimum-like limit per kind, so a corpus of any size sends ten rows a kind and task.
    """
    first = lambda p: F.when(may_match(F.col("content"), F.col("low"), p) & matches(F.col("content"), p), hits(F.col("content"), p)[0]["line"])
    kinds = [F.struct(F.lit(k).alias("kind"), (F.when(matches(F.col("path"), p), 1) if of_path else first(p)).alias("line")) for k, of_path, p, _ in _EVIDENCE]
    seen = files.select("path", "ord", "content", F.lower("content").alias("low")).select("path", "ord", F.explode(F.array(*kinds)).alias("e")).where("e.line IS NOT NULL").select("e.kind", "path", "e.line", "ord")
    bad = results.where("category IN ('secrets', 'transport-security', 'weak-crypto')").select(F.when(F.col("category") == "secrets", "bad-secret").otherwise("bad-crypto").alias("kind"), "path", F.col("start_line").alias("line"), "ord", F.concat(F.col("scanner"), F.lit("/"), F.col("rule_id"), F.lit(": "), F.col("title")).alias("note"))
    notes = F.create_map(*[F.lit(x) for kind, _, _, note in _EVIDENCE for x in (kind, note)])
    every = seen.withColumn("note", F.element_at(notes, F.col("kind"))).unionByName(bad)
    few = top_per_key(every, ["kind"], [F.col("ord"), F.col("path"), F.col("line")], 10)
    lists = few.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "line", "note"))), lambda s: F.struct(s["path"].alias("path"), s["line"].alias("line"), s["note"].alias("note"))).alias("list"))
    one = lists.agg(F.map_from_entries(F.collect_list(F.struct("kind", "list"))).alias("m"))
    empty = F.array().cast("array<struct<path:string,line:int,note:string>>")
    get = lambda k, n=10: F.slice(F.coalesce(F.try_element_at("m", F.lit(k)), empty), 1, n)
    some = lambda k: F.size(get(k)) > 0
    unless = lambda fail, good: F.when(fail, "fail").when(good, "pass").otherwise("unknown")
    info, medium = F.lit("info"), F.lit("medium")
    parts = {
        "auth-access-control": (unless(F.lit(False), some("auth")), info, get("auth")),
        "session-cookie-protection": (unless(some("cookie-off"), some("cookie-secure") & some("cookie-http")), F.when(some("cookie-off"), medium).otherwise(info), F.when(some("cookie-off"), get("cookie-off")).otherwise(F.concat(get("cookie-secure", 2), get("cookie-http", 2)))),
        "audit-logging": (unless(F.lit(False), some("audit")), info, get("audit")),
        "secret-management": (unless(some("bad-secret"), some("secret")), F.when(some("bad-secret"), F.lit("high")).otherwise(info), F.when(some("bad-secret"), get("bad-secret", 5)).otherwise(get("secret"))),
        "change-management": (unless(F.lit(False), some("owners") | some("ci")), info, F.concat(get("owners"), get("ci"))),
        "vulnerability-management": (unless(F.lit(False), some("bots") | some("scan")), info, F.concat(get("bots"), get("scan"))),
        "crypto-transport": (unless(some("bad-crypto"), some("tls")), F.when(some("bad-crypto"), medium).otherwise(info), F.when(some("bad-crypto"), get("bad-crypto", 5)).otherwise(get("tls"))),
    }
    rows = []
    for n, (key, title, ids, expectation, fix) in enumerate(_CONTROLS):
        status, severity, evidence = parts[key]
        remedy = F.when(status == "fail", _SECRETS_FIX).otherwise(fix) if key == "secret-management" else F.lit(fix)
        rows.append(F.struct(F.lit(n).alias("n"), F.lit(f"compliance-{key}").alias("id"), F.lit(title).alias("title"), status.alias("status"), severity.alias("severity"), F.array(*map(F.lit, ids)).alias("ids"), F.lit(expectation).alias("expectation"), F.slice(evidence, 1, 10).alias("evidence"), remedy.alias("remediation")))
    flat = one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    head = F.get("evidence", F.lit(0))
    message = F.when(F.col("status") == "unknown", F.concat(F.col("expectation"), F.lit(" Evidence not found in indexed files."))).otherwise(F.col("remediation"))
    raw = F.to_json(F.struct("status", F.array(F.lit("SOC 2"), F.lit("ISO 27001")).alias("frameworks"), F.col("ids").alias("controlIds"), "expectation", "evidence", "remediation"))
    made = flat.withColumn("ord", F.col("n").cast("long")).withColumn("path", head["path"])
    return _results(made, "compliance", rule_id=F.col("id"), title=F.concat(F.upper("status"), F.lit(": "), F.col("title")), category=F.lit("compliance"), severity=F.col("severity"), start_line=head["line"], message=message, raw=raw)


# How frameworks read the host and the client's address. (name, extensions, host, address, context of a gate, real authentication)
_PACKS = (
    ("express/next/node", (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), r"req\.(host|hostname)\b|req\.headers\[['\"]host['\"]\]|req\.get\(['\"]host['\"]\)|x-forwarded-host", r"x-forwarded-for|x-real-ip|\breq\.ip\b|\breq\.ips\b|cf-connecting-ip", r"\b(admin|internal|debug|staff|superuser|NODE_ENV|production|subdomain|tenant|authorize|permission|allow|next\(\)|return\s+true)\b", r"\b(requireAuth|isAuthenticated|passport\.authenticate|authorize|requireRole|requireAdmin|rbac|session\.user|jwt\.verify)\b"),
    ("flask/django/python", (".py",), r"request\.host\b|request\.headers\.get\(['\"]host['\"]\)|request\.headers\[['\"]host['\"]\]|request\.META\[['\"]HTTP_HOST['\"]\]|request\.get_host\(\)|HTTP_X_FORWARDED_HOST|x-forwarded-host", r"HTTP_X_FORWARDED_FOR|x-forwarded-for|HTTP_X_REAL_IP|x-real-ip|request\.remote_addr\b|request\.META\[['\"]REMOTE_ADDR['\"]\]", r"\b(admin|internal|debug|staff|superuser|is_staff|is_superuser|settings\.DEBUG|production|authorize|permission|allow|return\s+True)\b", r"\b(login_required|permission_required|user_passes_test|IsAdminUser|is_authenticated|has_perm|staff_member_required)\b"),
    ("laravel/php", (".php",), r"\$_SERVER\[['\"]HTTP_HOST['\"]\]|\$_SERVER\[['\"]HTTP_X_FORWARDED_HOST['\"]\]|\$request->getHost\(\)|Request::getHost\(\)|headers->get\(['\"]host['\"]\)", r"\$_SERVER\[['\"]HTTP_X_FORWARDED_FOR['\"]\]|\$_SERVER\[['\"]REMOTE_ADDR['\"]\]|\$request->ip\(\)|headers->get\(['\"]x-forwarded-for['\"]\)", r"\b(admin|internal|debug|staff|superuser|APP_ENV|production|authorize|permission|Gate::|can\(|middleware\(['\"]admin|return\s+true)\b", r"\b(auth\(\)->check|Auth::check|middleware\(['\"]auth|Gate::allows|can\(|authorize\(|policy\()"),
    ("rails/ruby", (".rb",), r"request\.host\b|request\.host_with_port\b|request\.headers\[['\"]Host['\"]\]|request\.headers\[['\"]X-Forwarded-Host['\"]\]|request\.subdomain\b", r"request\.remote_ip\b|request\.ip\b|request\.headers\[['\"]X-Forwarded-For['\"]\]|HTTP_X_FORWARDED_FOR", r"\b(admin|internal|debug|staff|superuser|Rails\.env\.production\?|production|authorize|permission|before_action|return\s+true)\b", r"\b(before_action\s+:authenticate|authenticate_user!|authorize|policy\(|current_user|admin\?|can\?)\b"),
    ("spring/java", (".java",), r"getHeader\(['\"]Host['\"]\)|getHeader\(['\"]X-Forwarded-Host['\"]\)|getServerName\(\)", r"getHeader\(['\"]X-Forwarded-For['\"]\)|getHeader\(['\"]X-Real-IP['\"]\)|getRemoteAddr\(\)", r"\b(admin|internal|debug|staff|superuser|production|authorize|permission|return\s+true|hasRole)\b", r"\b(@PreAuthorize|hasRole|hasAuthority|isAuthenticated|SecurityContext|@Secured)\b"),
    ("aspnet/csharp", (".cs",), r"Request\.Host\b|Request\.Headers\[['\"]Host['\"]\]|Request\.Headers\[['\"]X-Forwarded-Host['\"]\]", r"Request\.Headers\[['\"]X-Forwarded-For['\"]\]|Request\.Headers\[['\"]X-Real-IP['\"]\]|RemoteIpAddress", r"\b(admin|internal|debug|staff|superuser|Production|Authorize|Permission|return\s+true)\b", r"\b(\[Authorize|User\.Identity\.IsAuthenticated|IsInRole|RequireAuthorization)\b"),
    ("go/http", (".go",), r"\br\.Host\b|\.Header\.Get\(['\"]Host['\"]\)|\.Header\.Get\(['\"]X-Forwarded-Host['\"]\)", r"\.Header\.Get\(['\"]X-Forwarded-For['\"]\)|\.Header\.Get\(['\"]X-Real-IP['\"]\)|\bRemoteAddr\b", r"\b(admin|internal|debug|staff|superuser|production|authorize|permission|return\s+true)\b", r"\b(requireAuth|authorize|isAdmin|session|jwt|middleware\.Auth)\b"),
)


def header_gates(files: DataFrame) -> DataFrame:
    """Lines that read the host or client address beside an admin gate, within ten lines."""
    out = []
    for n, (pack, exts, host, address, context, strong) in enumerate(_PACKS):
        own = F.col("ext").isin(*exts)
        near = window(F.col("lines"), F.col("i"), 10, 10)
        for m, (kind, pattern) in enumerate((("host", host), ("proxy", address))):
            out.append(F.when(own & matches(F.col("line"), f"(?i){pattern}") & matches(near, f"(?i){context}"), F.struct(F.lit(2 * n + m).alias("n"), F.lit(kind).alias("kind"), F.lit(pack).alias("pack"), matches(near, f"(?i){strong}").alias("strong"))))
    rows = explode_lines(files.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*[e for p in _PACKS for e in p[1]]))).select("path", "ord", "i", "line", F.explode(F.array_compact(F.array(*out))).alias("g"))
    host = F.col("g.kind") == "host"
    title = F.when(host, "Host header controls admin or internal access gate").otherwise("Proxy client IP header controls admin or internal access gate")
    message = F.concat(title, F.lit(". "), F.when(host, "Host headers").otherwise("Proxy client IP headers"), F.lit(" are attacker-controlled unless overwritten by trusted proxy middleware/configuration."), F.when(F.col("g.strong"), " Strong auth also appears nearby; validate whether it dominates the header gate.").otherwise(""))
    chain = F.struct(F.when(host, "host-header-auth-bypass").otherwise("proxy-header-auth-bypass").alias("kind"), F.when(F.col("g.strong"), "low").otherwise("medium").alias("confidence"))
    raw = F.to_json(F.struct(chain.alias("attackChain"), F.array(F.struct("path", (F.col("i") + 1).alias("line"), F.substring(trim(F.col("line")), 1, 220).alias("note"))).alias("evidence")))
    made = _results(rows, "correlation", rule_id=F.when(host, "host-header-admin-gate").otherwise("proxy-header-admin-gate"), title=F.concat(title, F.lit(" ("), F.col("g.pack"), F.lit(")")), category=F.lit("auth"), severity=F.when(F.col("g.strong"), "medium").otherwise("high"), start_line=F.col("i") + 1, message=message, raw=raw, ord=_line_order(F.col("i"), F.col("g.n")))
    return first_wins(made, ["rule_id", "path", "start_line"])


def pollution_chain(results: DataFrame) -> DataFrame:
    """One row if prototype pollution in the code meets a template engine that it turns into code execution: a pair of single rows."""
    code = results.where("category = 'prototype-pollution'").orderBy("ord").limit(1).select(F.struct("scanner", "rule_id", "title", "category", "severity", "path", "start_line").alias("p"))
    text = F.lower(F.concat_ws(" ", F.coalesce(*[F.get_json_object("raw", x) for x in ("$.PkgName", "$.package.name", "$.Package.Name", "$.name")], F.col("title")), "rule_id", "title", "message", F.coalesce("raw", F.lit("{}"))))
    engine = results.where(F.col("scanner").isin("trivy", "osv-scanner") & matches(text, r"\beta\b") & matches(text, "(rce|remote code execution|code execution|prototype pollution|template injection|ssti)"))
    engine = engine.orderBy("ord").limit(1).select(F.struct("scanner", "rule_id", "title", "category", "severity", "path", "start_line").alias("e"))
    both = code.join(engine, F.lit(True)).withColumn("path", F.coalesce("p.path", "e.path")).withColumn("ord", F.lit(0).cast("long"))
    say = lambda s: F.struct(F.col(f"{s}.path").alias("path"), F.col(f"{s}.start_line").alias("line"), F.concat(F.col(f"{s}.scanner"), F.lit("/"), F.col(f"{s}.rule_id"), F.lit(": "), F.col(f"{s}.title")).alias("note"))
    chain = F.struct(F.lit("prototype-pollution-rce").alias("kind"), F.lit("medium").alias("confidence"))
    raw = F.to_json(F.struct(chain.alias("attackChain"), F.array(say("p"), say("e")).alias("evidence"), F.array("p", "e").alias("relatedFindings")))
    return _results(both, "correlation", rule_id=F.lit("prototype-pollution-to-eta-rce"), title=F.lit("Prototype pollution can enable Eta template RCE"), category=F.lit("rce"), severity=F.lit("critical"), start_line=F.coalesce("p.start_line", "e.start_line"), message=F.lit("Prototype pollution evidence meets a dependency with template code-execution impact; treat as a chained path until disproven."), raw=raw)

