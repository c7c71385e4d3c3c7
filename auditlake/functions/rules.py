"""The rules, as data. A rule is a row; operators turn rows into columns, and callers may pass their own.

All ids, severities, categories and texts below, and the patterns of prompt rules, are fixed values: results must carry
them exactly. The patterns of line rules hit the specified lines; two of them (INJ-002, DESER-001) are spelt shorter than
they might be. ``needles`` only saves work: every pattern hit contains at least one of them, so a text
without any is not given to the regex.
"""

from __future__ import annotations

from dataclasses import dataclass

CRITICAL, HIGH, MEDIUM = "critical", "high", "medium"


@dataclass(frozen=True)
class PromptRule:
    """Fires when any of ``patterns`` hits the case-folded prompt and ``unless`` does not.

    ``{pattern}`` in the description stands for the first pattern, in order, that hit.
    """

    rule_id: str
    severity: str
    patterns: tuple[str, ...]
    needles: tuple[str, ...]
    unless: str | None
    component: str
    description: str
    remediation: str
    category: str = "security"


@dataclass(frozen=True)
class LineRule:
    """Fires once on every source line that ``pattern`` hits."""

    rule_id: str
    severity: str
    category: str
    pattern: str
    needles: tuple[str, ...]
    description: str
    remediation: str
    ignore_case: bool = False


@dataclass(frozen=True)
class SecretRule:
    """Fires once on every line that ``pattern`` hits; group 1 is the variable name, never the value.

    ``bare`` rules read unquoted ``NAME=value`` and ``name: value`` lines of config files only.
    """

    kind: str
    pattern: str
    needles: tuple[str, ...]
    bare: bool = False
    ignore_case: bool = True


# Prompt rules, in evaluation order. Patterns are applied to the folded (lower-case) prompt.
PROMPT_RULES = (
    PromptRule(
        "PR-1", CRITICAL,
        (r"\b(raw sql|execute\(|cursor\.execute|f\"select|f'select)\b",), ("sql", "execute", "select"), None,
        "database layer",
        "Prompt references raw SQL execution. Risk of SQL Injection (OWASP A03:2021).",
        "Use an ORM (SQLAlchemy) or parameterized queries instead of string-interpolated SQL.",
    ),
    PromptRule(
        "PR-2", CRITICAL,
        (
            r"skip\w* auth", r"no auth", r"bypass.*auth", r"unauthenticated", r"public.*admin",
            r"admin.*endpoint.*bypass", r"bypass.*for.*internal",
        ), ("auth", "admin", "bypass"), None,
        "auth middleware",
        "Prompt matches pattern '{pattern}' — potential auth bypass (OWASP A01:2021).",
        "Ensure all sensitive endpoints are protected by JWT/OAuth2 dependency injection.",
    ),
    PromptRule(
        "PR-3", HIGH,
        (r"api[_-]?key\s*=\s*\S+", r"password\s*=\s*\S+", r"secret\s*=\s*\S+"), ("=",), None,
        "prompt payload",
        "Potential secret/credential detected in prompt text.",
        "Remove credentials from prompts; use environment variables or AWS Secrets Manager.",
    ),
    PromptRule(
        "PR-4", HIGH,
        (r"webhook",), ("webhook",), r"(signature|hmac|verify|secret|x-hub-signature)",
        "webhook handler",
        "Webhook route detected but no mention of signature verification.",
        "Always validate incoming webhook payloads using HMAC-SHA256 signature verification against a shared secret.",
    ),
    PromptRule(
        "PR-5", MEDIUM,
        (r"\b(route|endpoint|api)\b",), ("route", "endpoint", "api"), r"rate.?limit",
        "API gateway",
        "New endpoint added without mention of rate limiting.",
        "Add slowapi or AWS WAF rate limiting to prevent abuse.",
    ),
)

# What a registry conflict looks like.
VERBS = ("post", "put", "patch", "delete", "get")
PATH_MENTION = r"/[\w/{}:_-]+"
VERSION_MENTION = r"([\w-]+)[=><~!]+(\d[\d.]*)"
DRIFT_REMEDIATION = (
    "Use a versioned path (e.g. /v2{path}) or confirm the existing route should be overridden."
)
DRIFT_DESCRIPTION = (
    "Path '{path}' already registered as {method}. "
    "New feature implies {verb} — this will cause a routing collision."
)
COLLISION_DESCRIPTION = (
    "Model '{name}' already exists in the codebase. "
    "Adding fields or changing its shape may cause migration conflicts."
)
COLLISION_REMEDIATION = (
    "Create a migration script with Alembic and ensure backward-compatible schema changes. "
    "Consider a new model if the structure diverges significantly."
)
PIN_DESCRIPTION = (
    "Prompt requests '{name}=={version}' but codebase pins '{name}=={pin}'. "
    "Version mismatch could break transitive dependencies."
)
PIN_REMEDIATION = (
    "Audit changelog between {pin} and {version}. "
    "Update requirements.txt and run the full test suite before merging."
)

# Verdict messages and suggested tests.
MESSAGE_FAILED = "Audit FAILED — {n} critical issue(s) detected. Resolve all critical conflicts before proceeding."
MESSAGE_REVISE = "Audit requires revision — {n} high-severity issue(s) found. Address before merging to production."
MESSAGE_WARN = "Audit passed with warnings. Review medium/low issues."
MESSAGE_CLEAN = "Audit passed — no conflicts detected. Safe to proceed."
BASE_TESTS = (
    "Integration test: verify the new endpoint returns 401 for unauthenticated requests",
    "Integration test: ensure idempotency — calling the endpoint twice with the same payload produces the same result",
)
TEST_BY_CATEGORY = {
    "security": "Security test: validate that {component} rejects malformed / injected payloads",
    "api_drift": "Regression test: existing {component} contract still returns expected schema",
    "schema_collision": "Migration test: Alembic upgrade/downgrade on {component} leaves no data loss",
}

# Source line rules, in evaluation order.
LINE_RULES = (
    LineRule(
        "INJ-001", CRITICAL, "injection",
        r"cursor\.execute\s*\(\s*[fF]['\"]|cursor\.execute\s*\(\s*.*%.*['\"]",
        ("cursor.execute",),
        "Raw SQL via cursor.execute with string formatting — SQL Injection risk (OWASP A03)",
        "Use parameterized queries: cursor.execute('SELECT * FROM t WHERE id=%s', (val,))",
    ),
    LineRule(
        "INJ-002", CRITICAL, "injection",
        r"execute\s*\(\s*f['\"](SELECT|INSERT|UPDATE|DELETE)",
        ("execute",),
        "f-string SQL query passed to execute() — SQL Injection (OWASP A03)",
        "Use SQLAlchemy ORM or parameterized queries.",
    ),
    LineRule(
        "INJ-003", HIGH, "injection",
        r"subprocess\.(call|run|Popen)\s*\(.*shell\s*=\s*True",
        ("subprocess.",),
        "subprocess called with shell=True — Command Injection risk (OWASP A03)",
        "Pass command as a list: subprocess.run(['cmd', arg]) without shell=True.",
    ),
    LineRule(
        "INJ-004", HIGH, "injection",
        r"\beval\s*\(|__import__\s*\(",
        ("eval", "__import__"),
        "eval() or __import__() detected — arbitrary code execution risk",
        "Avoid eval(); use ast.literal_eval() for safe data parsing.",
    ),
    LineRule(
        "INJ-005", HIGH, "injection",
        r"\bos\.system\s*\(",
        ("os.system",),
        "os.system() call detected — prefer subprocess with a list of args",
        "Replace with subprocess.run(['cmd', arg], capture_output=True).",
    ),
    LineRule(
        "AUTH-001", CRITICAL, "auth",
        r"verify\s*=\s*False",
        ("verify",),
        "SSL certificate verification disabled — man-in-the-middle risk (OWASP A07)",
        "Remove verify=False; use a proper CA bundle or self-signed cert config.",
    ),
    LineRule(
        "AUTH-002", HIGH, "auth",
        r"jwt\.decode\s*\(.*algorithms\s*=\s*\[\s*['\"]none['\"]",
        ("jwt.decode",),
        "JWT decoded with algorithm 'none' — auth bypass vulnerability",
        "Always specify a strong algorithm: algorithms=['HS256'] and validate signature.",
    ),
    LineRule(
        "AUTH-003", HIGH, "auth",
        r"#\s*(no auth|skip auth|TODO.*auth|FIXME.*auth)",
        ("#",),
        "Comment suggests auth check is missing or skipped",
        "Implement proper authentication before this route goes to production.",
    ),
    LineRule(
        "AUTH-004", MEDIUM, "auth",
        r"allow_origins\s*=\s*\[?\s*['\"][*]['\"]",
        ("allow_origins",),
        "CORS allow_origins='*' — overly permissive cross-origin policy",
        "Restrict origins to known domains in production.",
    ),
    LineRule(
        "CRYPTO-001", CRITICAL, "crypto",
        r"\bmd5\s*\(|\bhashlib\.md5\b",
        ("md5",),
        "MD5 hash detected — cryptographically broken (OWASP A02)",
        "Use SHA-256 or better: hashlib.sha256(data).hexdigest()",
    ),
    LineRule(
        "CRYPTO-002", HIGH, "crypto",
        r"\bsha1\s*\(|\bhashlib\.sha1\b",
        ("sha1",),
        "SHA-1 hash detected — deprecated for security use (OWASP A02)",
        "Use SHA-256 or better for any security-sensitive hashing.",
    ),
    LineRule(
        "CRYPTO-003", HIGH, "crypto",
        r"random\.random\(\)|random\.randint\(|random\.choice\(",
        ("random.",),
        "Non-cryptographic random used — predictable values in security context",
        "Use secrets.token_hex() or secrets.choice() for security-sensitive randomness.",
    ),
    LineRule(
        "SEC-001", CRITICAL, "secrets",
        r"""(password|passwd|pwd)\s*=\s*['\"][^'"]{4,}['"]""",
        ("passw", "pwd"),
        "Hardcoded password string detected in source code",
        "Move credentials to environment variables or a secrets manager.",
        ignore_case=True,
    ),
    LineRule(
        "SEC-002", CRITICAL, "secrets",
        r"""(api[_-]?key|apikey|secret[_-]?key)\s*=\s*['\"][A-Za-z0-9\-_]{8,}['"]""",
        ("key",),
        "Hardcoded API key or secret detected in source code",
        "Use os.getenv('API_KEY') and store secrets in .env or AWS Secrets Manager.",
        ignore_case=True,
    ),
    LineRule(
        "SEC-003", HIGH, "secrets",
        r"""(token|auth[_-]?token|bearer)\s*=\s*['\"][A-Za-z0-9\.\-_]{20,}['"]""",
        ("token", "bearer"),
        "Hardcoded auth token detected in source code",
        "Load tokens from environment variables at runtime.",
        ignore_case=True,
    ),
    LineRule(
        "SEC-004", HIGH, "secrets",
        r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
        ("PRIVATE KEY-----",),
        "Private key embedded in source file",
        "Remove the key immediately. Store in a secrets vault, never in source.",
    ),
    LineRule(
        "CFG-001", HIGH, "config",
        r"DEBUG\s*=\s*True|debug\s*=\s*True",
        ("DEBUG", "debug"),
        "Debug mode enabled — may expose stack traces and internal details in production",
        "Set DEBUG=False in production; control via APP_ENV environment variable.",
    ),
    LineRule(
        "CFG-002", MEDIUM, "config",
        r"SECRET_KEY\s*=\s*['\"][\w\-]{1,20}['\"]",
        ("SECRET_KEY",),
        "Weak or short SECRET_KEY detected",
        'Generate a strong secret: python -c "import secrets; print(secrets.token_hex(32))"',
    ),
    LineRule(
        "CFG-003", MEDIUM, "config",
        r"host\s*=\s*['\"]0\.0\.0\.0['\"]",
        ("0.0.0.0",),
        "Server bound to 0.0.0.0 — exposed on all interfaces",
        "Bind to 127.0.0.1 in development; use a reverse proxy (nginx) in production.",
    ),
    LineRule(
        "DESER-001", CRITICAL, "injection",
        r"\bpickle\.loads?\s*\(",
        ("pickle.load",),
        "pickle.load(s) from untrusted input — arbitrary code execution (OWASP A08)",
        "Use JSON or MessagePack for serialization. Never unpickle untrusted data.",
    ),
    LineRule(
        "DESER-002", HIGH, "injection",
        r"\byaml\.load\s*\([^,)]+\)",
        ("yaml.load",),
        "yaml.load() without Loader — unsafe deserialization risk",
        "Use yaml.safe_load() instead.",
    ),
    LineRule(
        "PATH-001", HIGH, "injection",
        r"open\s*\(\s*.*\+|open\s*\(\s*f['\"]",
        ("open",),
        "open() called with dynamic/user-controlled path — path traversal risk (OWASP A01)",
        "Validate and sanitize file paths; use pathlib.Path.resolve() and check against a safe root.",
    ),
)

# The two syntax-tree rules (id, severity, category, description, remediation).
SWALLOWED_ERROR = (
    "CFG-004", MEDIUM, "config",
    "Bare 'except: pass' swallows all exceptions silently — hides security errors",
    "Catch specific exceptions and log them: except Exception as e: logger.error(e)",
)
ASSERTED_ACCESS = (
    "AUTH-005", HIGH, "auth",
    "assert used for security/auth check — disabled with python -O flag",
    "Replace with explicit if/raise: if not condition: raise PermissionError(...)",
)
ACCESS_WORDS = r"(auth|permission|role|admin|token|user)"
SNIPPET_CHARS = 120
SEVERITIES = (CRITICAL, HIGH, MEDIUM, "low", "info")

# Folders whose files are not scanned, and files that may hold configuration.
SKIP_DIRS = (".git", "__pycache__", "venv", "env", ".venv", "node_modules", "dist", "build")
CONFIG_SUFFIXES = (".env", ".yml", ".json", ".toml", ".cfg", ".py")

# Our choice (only the behaviour is given): kinds of secret, and how a line assigns one. A name is a run
# of word characters, dots and hyphens; it is only tried from the start of its run, which keeps the
# search linear on long unbroken lines.
_QUOTED = r"(?<![\w.-])([\w.-]*?{key}\w*)['\"]?\s*[:=]\s*['\"][^'\"\s]{{{least},}}['\"]"
_BARE = r"\A\s*(?:export\s+)?([\w.-]*?{key}\w*)\s*[:=]\s*[^\s'\"()$<{{][^\s'\"()]{{{rest},}}\s*\z"
_API_KEY, _PASSWORD, _TOKEN = r"(?:api[_-]?key|secret[_-]?key)", r"(?:password|passwd|pwd)", r"(?:token|bearer)"
SECRET_RULES = (
    SecretRule(
        "aws_key",
        r"(?:(?<![\w.-])([\w.-]+)['\"]?\s*[:=]\s*['\"]?|(?<![A-Za-z0-9]))(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
        ("akia", "asia"), ignore_case=False,
    ),
    SecretRule(
        "private_key", r"()-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
        ("private key-----",), ignore_case=False,
    ),
    SecretRule("api_key", _QUOTED.format(key=_API_KEY, least=8), ("key",)),
    SecretRule("api_key", _BARE.format(key=_API_KEY, rest=7), ("key",), bare=True),
    SecretRule("password", _QUOTED.format(key=_PASSWORD, least=4), ("passw", "pwd")),
    SecretRule("password", _BARE.format(key=_PASSWORD, rest=3), ("passw", "pwd"), bare=True),
    SecretRule("token", _QUOTED.format(key=_TOKEN, least=20), ("token", "bearer")),
    SecretRule("token", _BARE.format(key=_TOKEN, rest=19), ("token", "bearer"), bare=True),
)
BARE_SUFFIXES = (".env", ".yml", ".cfg")

# Ignore-file patterns that must be present.
REQUIRED_IGNORES = (".env", "*.pem", "*.key", "venv/", "__pycache__/", "*.pyc", "*.db", ".DS_Store", "*.log")
IGNORE_ADVICE = "Add missing patterns to .gitignore to prevent accidental secret commits."
IGNORE_OK = ".gitignore looks good for security-sensitive patterns."

# What the codebase inventory looks for.
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "options", "head")
MODEL_BASES = ("BaseModel", "Base", "DeclarativeBase")
UNPINNED = "unpinned"
