"""Rule tables: patterns and names that detectors look for, as data."""

from __future__ import annotations

JS, PY, PHP, RB, GO, C, SH = (".js", ".jsx", ".ts", ".tsx"), (".py",), (".php",), (".rb",), (".go",), (".c", ".h"), (".sh", ".bash")

# The default rule pack. (id, severity, category, extensions or None for all, title, pattern)
# Patterns are matched with the flags i and m.
# fmt: off
DEFAULT_RULES = (
    ("js-eval", "high", "injection", JS, "Dynamic eval usage", r"\beval\s*\("),
    ("js-function-constructor", "high", "injection", JS, "Function constructor usage", r"\bnew\s+Function\s*\("),
    ("js-prototype-pollution-assignment", "high", "prototype-pollution", JS, "Prototype pollution assignment candidate", r"(\b(?:__proto__|constructor\.prototype)\b\s*=|\[[^\]\n]*(?:__proto__|constructor|prototype)[^\]\n]*\]\s*=)"),
    ("js-prototype-pollution-unsafe-merge", "high", "prototype-pollution", JS, "User-controlled object merge candidate", r"\b(Object\.assign|(?:lodash\.)?merge|deepmerge|defaultsDeep|set)\s*\([^\n]*(req\.|request\.|params|query|body)"),
    ("js-dynamic-object-key-assignment", "medium", "prototype-pollution", JS, "Dynamic object key assignment from user input", r"\[[^\]\n]*(req\.|request\.|params|query|body)[^\]\n]*\]\s*="),
    ("node-child-process", "high", "command-injection", JS, "Child process execution sink", r"\b(exec|execSync|spawn|spawnSync)\s*\("),
    ("python-shell-true", "high", "command-injection", PY, "Python subprocess shell=True", r"shell\s*=\s*True"),
    ("sql-concat", "high", "sql-injection", (".js", ".ts", ".py", ".php", ".rb", ".go", ".java", ".cs"), "SQL query string concatenation candidate", r"(SELECT|INSERT|UPDATE|DELETE).*(\+|\$\{|%s|format\()"),
    ("raw-html", "medium", "xss", (".js", ".jsx", ".ts", ".tsx", ".vue"), "Raw HTML injection candidate", r"(innerHTML\s*=|v-html=|dangerouslySetInnerHTML)"),
    ("insecure-random", "medium", "weak-crypto", (".js", ".ts", ".py"), "Insecure random usage", r"\b(Math\.random|random\.random)\s*\("),
    ("hardcoded-jwt-secret", "high", "secrets", None, "Hardcoded JWT secret candidate", r"""(JWT_SECRET|jwtSecret|secretKey)\s*[:=]\s*['\"][^'\"]{8,}['\"]"""),
    ("generic-secret-assignment", "high", "secrets", None, "Hardcoded secret assignment candidate", r"""\b(api[_-]?key|token|password|secret|client[_-]?secret)\b\s*[:=]\s*['\"]?[^'\"\s]{8,}['\"]?"""),
    ("tls-disabled", "high", "transport-security", None, "TLS verification disabled", r"""(rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0|verify\s*=\s*False)"""),
    ("permissive-cors", "medium", "cors", None, "Permissive CORS candidate", r"""(Access-Control-Allow-Origin.*\*|origin\s*:\s*['\"]\*['\"]|cors\s*\(\s*\))"""),
    ("path-traversal", "high", "path-traversal", None, "Path traversal sink candidate", r"(sendFile|readFile|createReadStream|open)\s*\([^\n]*(req\.|request\.|params|query|body)"),
    ("ssrf-candidate", "high", "ssrf", None, "SSRF candidate", r"(fetch|axios\.|request\(|http\.get|https\.get)\s*\([^\n]*(req\.|request\.|params|query|body)"),
    ("open-redirect", "medium", "open-redirect", None, "Open redirect candidate", r"(redirect|location\.href|Location)\s*\([^\n]*(req\.|request\.|params|query|body)"),
    ("weak-crypto", "medium", "weak-crypto", None, "Weak cryptographic primitive", r"\b(md5|sha1|DES|RC4)\b"),
    ("debug-endpoint", "low", "debug", None, "Debug endpoint candidate", r"""(app\.(get|post)|router\.(get|post)).*['\"]/(debug|admin|internal|actuator)"""),
    ("default-password", "high", "secrets", None, "Default password candidate", r"""(password|passwd|pwd)\s*[:=]\s*['\"](admin|password|changeme|123456)['\"]"""),
    ("auth-bypass-comment", "medium", "auth", None, "Security-sensitive bypass comment", r"(TODO|FIXME|HACK).*(auth|csrf|xss|sql|security|bypass|permission|tenant)"),
    ("php-eval", "high", "code-injection", PHP, "PHP dynamic code execution", r"\b(eval|assert)\s*\("),
    ("php-command-exec-user-input", "high", "command-injection", PHP, "PHP command execution from user input", r"\b(system|exec|shell_exec|passthru|proc_open|popen)\s*\([^\n]*(\$_(GET|POST|REQUEST|COOKIE|SERVER)|argv|argc)"),
    ("php-file-include-user-input", "high", "file-inclusion", PHP, "PHP dynamic file include from user input", r"\b(include|include_once|require|require_once)\s*\(?\s*[^;\n]*(\$_(GET|POST|REQUEST|COOKIE)|argv)"),
    ("php-unserialize-user-input", "high", "deserialization", PHP, "PHP unsafe unserialize of user input", r"""\bunserialize\s*\([^\n]*(\$_(GET|POST|REQUEST|COOKIE)|file_get_contents\s*\(\s*['\"]php://input)"""),
    ("php-sql-user-input", "high", "sql-injection", PHP, "PHP SQL query built with user input", r"\b(mysqli_query|mysql_query|pg_query|sqlite_query|query|prepare)\s*\([^;\n]*(\$_(GET|POST|REQUEST|COOKIE)|\.\s*\$|\$\w+\s*\.)"),
    ("php-path-traversal-user-input", "high", "path-traversal", PHP, "PHP filesystem access from user input", r"\b(file_get_contents|fopen|readfile|unlink|copy|rename|ZipArchive::open)\s*\([^\n]*(\$_(GET|POST|REQUEST|COOKIE)|argv)"),
    ("php-ssrf-user-input", "high", "ssrf", PHP, "PHP outbound request from user input", r"\b(curl_setopt|file_get_contents|fopen)\s*\([^\n]*(\$_(GET|POST|REQUEST|COOKIE)|argv|CURLOPT_URL)"),
    ("php-tls-verification-disabled", "high", "transport-security", PHP, "PHP TLS verification disabled", r"""(CURLOPT_SSL_VERIFYPEER\s*,\s*false|CURLOPT_SSL_VERIFYHOST\s*,\s*0|verify_peer\s*['\"]?\s*=>\s*false)"""),
    ("php-header-open-redirect", "medium", "open-redirect", PHP, "PHP open redirect candidate", r"""\bheader\s*\(\s*['\"]Location:\s*['\"]?\s*\.\s*(\$_(GET|POST|REQUEST|COOKIE)|\$\w+)"""),
    ("ruby-eval", "high", "code-injection", RB, "Ruby dynamic code execution", r"\b(eval|class_eval|instance_eval|module_eval)\s*\("),
    ("ruby-command-exec-user-input", "high", "command-injection", RB, "Ruby command execution from user input", r"\b(system|exec|spawn|IO\.popen|Open3\.(capture2|capture2e|capture3|popen3))\s*\([^\n]*(params|ARGV|ENV\[|request\.)"),
    ("ruby-deserialization-user-input", "high", "deserialization", RB, "Ruby unsafe deserialization of user input", r"\b(Marshal\.load|YAML\.load|Psych\.load)\s*\([^\n]*(params|ARGV|request\.|File\.read|Base64\.decode64)"),
    ("rails-sql-interpolation", "high", "sql-injection", RB, "Rails SQL interpolation candidate", r"\b(where|find_by_sql|execute|order|pluck)\s*\([^\n]*#\{[^\n]*\}"),
    ("ruby-path-traversal-user-input", "high", "path-traversal", RB, "Ruby filesystem access from user input", r"\b(File\.(read|open|write|delete|unlink)|IO\.read|send_file)\s*\([^\n]*(params|ARGV|request\.)"),
    ("ruby-ssrf-user-input", "high", "ssrf", RB, "Ruby outbound request from user input", r"\b(Net::HTTP\.(get|get_response|post)|URI\.open|OpenURI\.open_uri|Faraday\.(get|post)|HTTParty\.(get|post))\s*\([^\n]*(params|ARGV|request\.)"),
    ("rails-open-redirect", "medium", "open-redirect", RB, "Rails open redirect candidate", r"\bredirect_to\s+[^\n]*(params|request\.params)"),
    ("rails-render-inline-user-input", "high", "xss", RB, "Rails inline render from user input", r"\brender\s+inline:\s*[^\n]*(params|request\.params)"),
    ("cli-argv-command-sink", "high", "command-injection", (".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".rb"), "CLI argument reaches command execution sink", r"\b(exec|execSync|spawn|spawnSync|system|shell_exec|passthru|proc_open|popen|subprocess\.(run|call|Popen)|os\.system)\s*\([^\n]*(argv|ARGV|process\.argv|sys\.argv|commander\.|yargs\.)"),
    ("cli-argv-filesystem-sink", "medium", "path-traversal", (".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".rb"), "CLI argument reaches filesystem sink", r"\b(readFile|writeFile|createReadStream|open|File\.(read|open|write|delete)|IO\.read|file_get_contents|fopen|readfile|unlink|os\.remove|Path\()\s*\([^\n]*(argv|ARGV|process\.argv|sys\.argv|commander\.|yargs\.)"),
    ("shell-script-unsafe-eval", "high", "command-injection", SH, "Shell script dynamic eval usage", r"\beval\s+\$"),
    ("shell-script-unquoted-args", "medium", "command-injection", SH, "Shell script unquoted argument expansion near command", r"\b(rm|cp|mv|tar|curl|wget|ssh|scp|rsync)\b[^\n]*(\$1|\$2|\$@|\$\*)"),
    ("insecure-file-permission", "medium", "misconfiguration", (".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".rb", ".sh", ".bash"), "Overly permissive file permission", r"""\b(chmod|File\.chmod)\s*\(?\s*(777|0o777|0777|['\"]777['\"])"""),
    ("go-command-exec-user-input", "high", "command-injection", GO, "Go command execution from variable input", r"\bexec\.Command\s*\([^\n]*(req\.|request\.|params|query|body|\$|fmt\.Sprintf|os\.Args|flag\.Arg)"),
    ("go-sql-concat", "high", "sql-injection", GO, "Go SQL query via string concat", r"\b(fmt\.Sprintf|fmt\.Sprintln|strings\.Join)\s*\([^\n]*(SELECT|INSERT|UPDATE|DELETE)"),
    ("go-ssrf-user-input", "high", "ssrf", GO, "Go outbound HTTP request from user input", r"\b(http\.(Get|Post|Do)|net/url\.Parse|NewRequest)\s*\([^\n]*(req\.|request\.|params|query|body|fmt\.Sprintf|\+)"),
    ("go-path-traversal", "high", "path-traversal", GO, "Go filesystem access from user input", r"\b(os\.(Open|ReadFile|Create|WriteFile|Remove|Stat)|ioutil\.(ReadFile|ReadDir|WriteFile)|filepath\.Join)\s*\([^\n]*(req\.|request\.|params|query|body|fmt\.Sprintf|os\.Args)"),
    ("go-html-template-xss", "high", "xss", GO, "Go template rendering unescaped HTML", r"template\.(HTML|HTMLAttr|URL|JS|Srcset)\s*\("),
    ("c-memcpy-overflow", "high", "memory-corruption", C, "Memory copy without bounds check", r"memcpy\([^,]+,[^,]+,\s*(strlen|sizeof\s*\(\s*[a-zA-Z]|n)"),
    ("c-kmalloc-sizeof", "high", "memory-corruption", C, "kmalloc with sizeof pointer instead of struct", r"kmalloc\s*\(\s*sizeof\s*\(\s*\("),
    ("c-copy-from-user", "high", "memory-corruption", C, "copy_from_user without proper size check", r"copy_from_user\s*\([^)]+"),
    ("c-sprintf-usage", "medium", "buffer-overflow", C, "unbounded sprintf usage (prefer snprintf)", r"sprintf\([^)]*%s"),
    ("c-stack-buffer", "medium", "stack-overflow", C, "Large stack buffer allocation", r"\[\s*[0-9]{5,}\s*\]"),
    ("c-user-pointer-deref", "high", "memory-corruption", C, "User-controlled pointer dereference", r"__user\s+\*"),
    ("c-goto-bug", "medium", "resource-leak", C, "Potential goto fail (missing cleanup)", r"goto\s+out\s*;\s*\n[^}]*\n\s*return"),
    ("c-unchecked-alloc", "high", "null-deref", C, "Unchecked allocation return value", r"(kmalloc|kzalloc|kcalloc|vmalloc)\s*\([^)]*\)\s*;\s*\n(?!\s*if)"),
    ("c-proc-entry-create", "medium", "information-disclosure", C, "/proc file creation without proper permissions", r"proc_create\s*\([^)]*0444"),
    ("c-debugfs-create", "low", "information-disclosure", C, "debugfs file creation (exposed to userspace)", r"debugfs_create_"),
)

# What a category stands for. (category, CWE, OWASP)
CATEGORIES = (
    ("command-injection", "CWE-78", "A03:2021-Injection"),
    ("sql-injection", "CWE-89", "A03:2021-Injection"),
    ("xss", "CWE-79", "A03:2021-Injection"),
    ("ssrf", "CWE-918", "A10:2021-Server-Side Request Forgery"),
    ("path-traversal", "CWE-22", "A01:2021-Broken Access Control"),
    ("file-inclusion", "CWE-98", "A03:2021-Injection"),
    ("deserialization", "CWE-502", "A08:2021-Software and Data Integrity Failures"),
    ("prototype-pollution", "CWE-1321", "A03:2021-Injection"),
    ("open-redirect", "CWE-601", "A01:2021-Broken Access Control"),
    ("transport-security", "CWE-295", "A02:2021-Cryptographic Failures"),
    ("weak-crypto", "CWE-327", "A02:2021-Cryptographic Failures"),
    ("secrets", "CWE-798", "A07:2021-Identification and Authentication Failures"),
    ("misconfiguration", "CWE-16", "A05:2021-Security Misconfiguration"),
    ("auth", "CWE-287", "A07:2021-Identification and Authentication Failures"),
    ("security", "CWE-200", "A01:2021-Broken Access Control"),
)

# A secret's assigned value that only names where the secret is kept at run time.
RUNTIME_SECRETS = (
    r"^process\.env(?:\.[A-Z0-9_]+|\[['\"][A-Z0-9_]+['\"]\])$",
    r"^import\.meta\.env(?:\.[A-Z0-9_]+|\[['\"][A-Z0-9_]+['\"]\])$",
    r"^Deno\.env\.get\($", r"^Deno\.env\.get\(\s*['\"]$", r"^Deno\.env\.get\(\s*['\"][A-Z0-9_]+['\"]?\s*$",
    r"^ENV\[$", r"^ENV\[\s*['\"]$", r"^ENV\[\s*['\"][A-Z0-9_]+['\"]\s*$",
    r"^os\.environ(?:\.get\(|\[)$", r"^os\.environ(?:\.get\(\s*['\"]|\[\s*['\"])$", r"^os\.environ(?:\.get\(\s*['\"][A-Z0-9_]+['\"]?\s*|\[\s*['\"][A-Z0-9_]+['\"]?\s*)$",
    r"^getenv\($", r"^getenv\(\s*['\"]$", r"^getenv\(\s*['\"][A-Z0-9_]+['\"]?\s*$",
)

# Configuration rules. (id, title, category, severity, pattern, path pattern or None, CWE, fix)
CONFIG_RULES = (
    ("rails-force-ssl-disabled", "Rails force_ssl disabled", "misconfiguration", "medium", r"config\.force_ssl\s*=\s*false", r"config/environments/production\.rb$", "CWE-319", "Enable config.force_ssl in production."),
    ("rails-secret-key-base-hardcoded", "Rails secret_key_base hardcoded", "secrets", "high", r"secret_key_base\s*=\s*['\"][^'\"]{16,}['\"]", None, "CWE-798", "Load secret_key_base from credentials or environment variables."),
    ("laravel-debug-enabled", "Laravel debug mode enabled", "misconfiguration", "medium", r"(?i)APP_DEBUG\s*=\s*true", r"(^|/)\.env(\.|$)?", "CWE-489", "Set APP_DEBUG=false outside local development."),
    ("php-display-errors-enabled", "PHP display_errors enabled", "misconfiguration", "medium", r"(?i)display_errors\s*=\s*(1|on|true)", None, "CWE-209", "Disable display_errors in production and log errors server-side."),
    ("django-debug-enabled", "Django DEBUG enabled", "misconfiguration", "medium", r"\bDEBUG\s*=\s*True\b", None, "CWE-489", "Set DEBUG=False in production settings."),
    ("flask-debug-enabled", "Flask debug mode enabled", "misconfiguration", "medium", r"(?i)\bdebug\s*=\s*True\b|FLASK_DEBUG\s*=\s*1", None, "CWE-489", "Disable Flask debug mode outside local development."),
    ("cookie-secure-disabled", "Cookie secure flag disabled", "misconfiguration", "medium", r"(?i)(secure\s*[:=]\s*false|SESSION_COOKIE_SECURE\s*=\s*False|httponly\s*[:=]\s*false)", None, "CWE-614", "Set Secure and HttpOnly cookie flags for session cookies."),
    ("permissive-bind-address", "Service binds to all interfaces", "misconfiguration", "low", r"(?i)(host\s*[:=]\s*['\"]0\.0\.0\.0['\"]|listen\s*\([^)]*0\.0\.0\.0)", None, "CWE-200", "Bind internal services to localhost or restrict network access."),
    ("wordpress-debug-enabled", "WordPress debug mode enabled", "misconfiguration", "medium", r"(?i)define\s*\(\s*['\"]WP_DEBUG['\"]\s*,\s*true\s*\)", None, "CWE-489", "Disable WP_DEBUG in production."),
)

# What counts as input from outside, as a cleaner of it, and where it does harm.
LITE_SOURCE = r"(?i)\b(?:req\.(?:query|body|params|headers)|request\.(?:query|body|params|headers)|params(?:\[[^\]]+\])?|\$_(?:GET|POST|REQUEST|COOKIE|SERVER)|ARGV|process\.argv|sys\.argv|ENV\[|os\.environ)\b"
LITE_SANITIZER = r"(?i)\b(?:htmlspecialchars|sanitize|sanitize_sql|sanitize_sql_like|prepared|parameterized|basename|realpath|path\.normalize|allowlist|whitelist|URI\.parse|Addressable::URI)\b"
ASSIGNMENT = r"^\s*(?:const|let|var)?\s*([A-Za-z_$][\w$]*)\s*=\s*(.+)$"
SOURCE = r"(?i)\b(?:req\.(?:query|body|params|headers|cookies|host|hostname|ip|ips)|req\.get\(['\"][^'\"]+['\"]\)|request\.(?:query|body|params|headers|args|form|json|files|host|remote_addr|META|GET|POST|COOKIES)|params(?:\[[^\]]+\])?|cookies(?:\[[^\]]+\])?|x-forwarded-(?:for|host)|x-real-ip|HTTP_(?:HOST|X_FORWARDED_FOR|X_FORWARDED_HOST|X_REAL_IP)|request\.get(?:Parameter|Header)\(|Request\.(?:Query|Form|Headers|Cookies|Host)|r\.(?:URL\.Query|FormValue|Header\.Get|Cookie|Host|RemoteAddr)\b|\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER)|ARGV|process\.argv|sys\.argv)\b"
SANITIZER = r"(?i)\b(?:sanitize\w*|escape\w*|validate\w*|schema|zod|joi|allowlist\w*|whitelist\w*|realpath|normalize|basename|prepared|parameterized|encodeURIComponent|htmlspecialchars)\b"
_COMMAND = r"\b(?:exec|execSync|spawn|spawnSync|system|shell_exec|passthru|proc_open|popen|subprocess\.(?:run|call|Popen)|os\.system|Open3\.(?:capture2|capture2e|capture3|popen3))\s*\("
_SQL = r"\b(?:query|execute|raw|find_by_sql|where|mysqli_query|pg_query)\s*\("
_PICKLE = r"\b(?:unserialize|Marshal\.load|YAML\.load|Psych\.load|pickle\.loads?)\s*\("
# (category, title, pattern, CWE), in the order in which they are tried
LITE_SINKS = (
    ("taint-command", "command-injection", "User-controlled value reaches command execution sink", _COMMAND, "CWE-78"),
    ("taint-sql", "sql-injection", "User-controlled value reaches SQL execution sink", _SQL, "CWE-89"),
    ("taint-filesystem", "path-traversal", "User-controlled value reaches filesystem sink", r"\b(?:readFile|writeFile|createReadStream|open|File\.(?:read|open|write|delete)|IO\.read|file_get_contents|fopen|readfile|unlink|send_file)\s*\(", "CWE-22"),
    ("taint-ssrf", "ssrf", "User-controlled value reaches outbound request sink", r"\b(?:fetch|axios\.|request\(|http\.get|https\.get|Net::HTTP\.(?:get|get_response|post)|URI\.open|Faraday\.(?:get|post)|HTTParty\.(?:get|post)|curl_setopt|file_get_contents)\s*\(", "CWE-918"),
    ("taint-deserialization", "deserialization", "User-controlled value reaches unsafe deserialization sink", _PICKLE, "CWE-502"),
)
SINKS = (
    ("flow-command", "command-injection", "User-controlled value reaches command execution sink", _COMMAND),
    ("flow-sql", "sql-injection", "User-controlled value reaches SQL execution sink", _SQL),
    ("flow-filesystem", "path-traversal", "User-controlled value reaches filesystem sink", r"\b(?:readFile|writeFile|createReadStream|open|File\.(?:read|open|write|delete)|IO\.read|file_get_contents|fopen|readfile|unlink|send_file|sendFile)\s*\("),
    ("flow-ssrf", "ssrf", "User-controlled value reaches outbound request sink", r"\b(?:fetch|axios\.|request\(|http\.get|https\.get|Net::HTTP\.(?:get|get_response|post)|URI\.open|Faraday\.(?:get|post)|HTTParty\.(?:get|post)|curl_setopt)\s*\("),
    ("flow-xss", "xss", "User-controlled value reaches HTML rendering sink", r"\b(?:innerHTML|dangerouslySetInnerHTML|render\s+inline|v-html)\b"),
    ("flow-template", "template-injection", "User-controlled value reaches template rendering sink", r"\b(?:res\.render|reply\.view|eta\.render|Eta\.render|renderFile|renderString|render_template|Template\(|template\.render|render_to_string|render\s+inline|ERB\.new|Twig\\Environment|Blade::render|view\s*\(|templateEngine\.process|ModelAndView|template\s*\()\s*\("),
    ("flow-deserialization", "deserialization", "User-controlled value reaches unsafe deserialization sink", _PICKLE),
)
# What makes a cleaner on the way sufficient for a kind of sink; None stands for all others.
SUFFICIENT = {
    "ssrf": r"(?i)\b(allowlist\w*|allowedHosts|URLPattern|isAllowedUrl|validateUrl|sameOrigin|privateIp|dnsLookup)\b",
    "path-traversal": r"(?i)\b(realpath|resolve|normalize|basename|safeJoin|startsWith|allowlist)\b",
    "sql-injection": r"(?i)\b(prepared|parameterized|bind|where\s*\(|queryBuilder|prisma|sequelize)\b",
    "command-injection": r"(?i)\b(execFile|shell\s*:\s*false|allowlist|shlex\.quote|spawn)\b",
    None: r"(?i)\b(sanitize|escape|encode|validate|allowlist|schema|zod|joi)\b",
}
FLOW_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".rb")
NOT_VARIABLES = ("req", "request", "res", "response", "await", "return", "true", "false", "null", "undefined", "http", "https")

# Routes by framework. (framework, group of the method, group of the path, pattern)
ROUTES = (
    ("express", 1, 2, r"(?i)\b(?:app|router)\.(get|post|put|patch|delete|head|options|all|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("custom-router", 1, 2, r"(?i)\b(?:this\.)?addRoute\s*\(\s*['\"`](get|post|put|patch|delete|head|options|all|use)['\"`]\s*,\s*['\"`]([^'\"`]+)['\"`]"),
    ("fastapi", 1, 2, r"(?i)@app\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("flask", 2, 1, r"(?i)@app\.route\s*\(\s*['\"]([^'\"]+)['\"][^)]*methods\s*=\s*\[?['\"]?([A-Z]+)"),
    ("spring", 1, 2, r"@(Get|Post|Put|Patch|Delete)Mapping\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("rails", 1, 2, r"(?im)^\s*(get|post|put|patch|delete|match)\s+['\"]([^'\"]+)['\"]"),
    ("sinatra", 1, 2, r"(?im)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]\s+do\b"),
    ("laravel", 1, 2, r"Route::(get|post|put|patch|delete|any|match)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("php", 1, 0, r"\$_SERVER\s*\[\s*['\"]REQUEST_METHOD['\"]\s*\]\s*={2,3}\s*['\"]([A-Z]+)['\"][\s\S]{0,240}?\$_SERVER\s*\[\s*['\"]REQUEST_URI['\"]\s*\]"),
)
# fmt: on
