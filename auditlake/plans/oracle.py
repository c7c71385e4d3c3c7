"""The same results in plain SQL, for checking: one statement per registered query.

Written apart from the operators: other regex spellings (no look-around, no folding), joins on exploded
rows instead of nested lookups, regexes over lines instead of the syntax tree.
"""

from __future__ import annotations

from auditlake.functions import rules
from auditlake.plans import derive

W, N = r"[\pL\pN_]", r"[^\pL\pN_]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


def strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def with_(ctes: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + final


# ---- prompts and registry --------------------------------------------------------------------------

EVENT_INTAKE = {"intake": select(derive.INTAKE_COLUMNS, "events")}
INTAKE = {"intake": EVENT_INTAKE["intake"] + " UNION ALL " + select(derive.TURN_COLUMNS, "conversations")}
ACCEPTED = {
    "prompts": "SELECT prompt_id, prompt, project_id, coalesce(nullif(author, ''), 'anonymous') AS author, "
    "coalesce(nullif(branch, ''), 'main') AS branch, created_at FROM intake "
    "WHERE prompt IS NOT NULL AND project_id IS NOT NULL"
}
REQUIREMENTS = {
    "requirement_lines": select(derive.SEED_REQUIREMENT_COLUMNS, "nation") + " UNION ALL "
    + select(derive.PART_REQUIREMENT_COLUMNS, "part"),
    "parsed": "SELECT project_id, line_no, "
    "CASE WHEN contains(line, '==') THEN trim(split_part(line, '==', 1)) ELSE trim(line) END AS name, "
    "CASE WHEN contains(line, '==') THEN trim(substr(line, strpos(line, '==') + 2)) ELSE 'unpinned' END AS version "
    "FROM requirement_lines WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'",
    "dependencies": "SELECT project_id, name, arg_max(version, line_no) AS version FROM parsed GROUP BY project_id, name",
}
REGISTRY = {
    "endpoints": select(derive.SEED_ENDPOINT_COLUMNS, "nation") + " UNION ALL "
    + select(derive.PART_ENDPOINT_COLUMNS, "part"),
    "models": select(derive.SEED_MODEL_COLUMNS, "nation") + " UNION ALL " + select(derive.PART_MODEL_COLUMNS, "part"),
    **REQUIREMENTS,
    "latest": "SELECT project_id, path, arg_max(method, ord) AS method FROM endpoints GROUP BY project_id, path",
}

RAW_SQL = rf"""(?i)(?:^|{N})(?:raw sql|cursor\.execute|f"select|f'select)(?:$|{N})|(?:^|{N})execute\({W}"""
BYPASSES = {
    r"skip\w* auth": rf"(?i)skip{W}* auth",
    r"no auth": "(?i)no auth",
    r"bypass.*auth": "(?i)bypass.*auth",
    r"unauthenticated": "(?i)unauthenticated",
    r"public.*admin": "(?i)public.*admin",
    r"admin.*endpoint.*bypass": "(?i)admin.*endpoint.*bypass",
    r"bypass.*for.*internal": "(?i)bypass.*for.*internal",
}
SECRET = rf"(?i)(?:api[_-]?key|password|secret){SPACE}*={SPACE}*[^\t-\r\x1c-\x20]+"


def _rule_row(rule: rules.PromptRule, seq: int, condition: str, description: str) -> str:
    return (
        f"SELECT prompt_id, 0 AS chk, {seq} AS seq, 0 AS sub, {q(rule.severity)} AS severity, 'security' AS category, "
        f"{description} AS description, {q(rule.component)} AS affected_component, {q(rule.remediation)} AS remediation "
        f"FROM prompts WHERE {condition}"
    )


def _security() -> list[str]:
    sql, bypass, secret, webhook, rate = rules.PROMPT_RULES
    first = "CASE " + " ".join(f"WHEN regexp_matches(prompt, {q(p)}) THEN {q(shown)}" for shown, p in BYPASSES.items()) + " END"
    head, tail = bypass.description.split("{pattern}")
    return [
        _rule_row(sql, 1, f"regexp_matches(prompt, {q(RAW_SQL)})", q(sql.description)),
        _rule_row(bypass, 2, f"{first} IS NOT NULL", f"{q(head)} || {first} || {q(tail)}"),
        _rule_row(secret, 3, f"regexp_matches(prompt, {q(SECRET)})", q(secret.description)),
        _rule_row(
            webhook, 4, "regexp_matches(prompt, '(?i)webhook') AND NOT regexp_matches(prompt, '(?i)signature|hmac|verify|secret')",
            q(webhook.description),
        ),
        _rule_row(
            rate, 5, f"regexp_matches(prompt, '(?i)(?:^|{N})(?:route|endpoint|api)(?:$|{N})') "
            "AND NOT regexp_matches(prompt, '(?i)rate.?limit')", q(rate.description),
        ),
    ]


PATHS = r"regexp_extract_all(prompt, '/[\pL\pN_/{}:-]+')"
PINS = r"'([\pL\pN_-]+)[=><~!]+(\p{Nd}[\p{Nd}.]*)'"
CHECKS = {
    "security": " UNION ALL ".join(_security()),
    "mentions": f"SELECT prompt_id, project_id, prompt, unnest({PATHS}) AS path, generate_subscripts({PATHS}, 1) - 1 AS seq FROM prompts",
    "known": "SELECT m.*, l.method, list_filter(['POST', 'PUT', 'PATCH', 'DELETE', 'GET'], "
    "lambda v: contains(lower(m.prompt), lower(v))) AS verbs FROM mentions m JOIN latest l USING (project_id, path)",
    "implied": "SELECT prompt_id, seq, path, method, unnest(verbs) AS verb, generate_subscripts(verbs, 1) - 1 AS sub FROM known",
    "drift": "SELECT prompt_id, 1 AS chk, seq, sub, 'high' AS severity, 'api_drift' AS category, "
    "'Path ''' || path || ''' already registered as ' || method || '. New feature implies ' || verb || "
    "' — this will cause a routing collision.' AS description, 'route:' || path AS affected_component, "
    "'Use a versioned path (e.g. /v2' || path || ') or confirm the existing route should be overridden.' AS remediation "
    "FROM implied WHERE verb <> method",
    "tokens": rf"SELECT prompt_id, project_id, unnest(list_distinct(regexp_extract_all(lower(prompt), '{W}+'))) AS token FROM prompts",
    "collisions": "SELECT prompt_id, 2 AS chk, ord AS seq, 0 AS sub, 'medium' AS severity, 'schema_collision' AS category, "
    "'Model ''' || name || ''' already exists in the codebase. Adding fields or changing its shape may cause migration conflicts.' AS description, "
    f"'model:' || name AS affected_component, {q(rules.COLLISION_REMEDIATION)} AS remediation "
    "FROM tokens t JOIN models m ON t.project_id = m.project_id AND t.token = lower(m.name)",
    "asked": f"SELECT prompt_id, project_id, unnest(regexp_extract_all(prompt, {PINS}, 1)) AS name, "
    f"unnest(regexp_extract_all(prompt, {PINS}, 2)) AS version, generate_subscripts(regexp_extract_all(prompt, {PINS}), 1) - 1 AS seq FROM prompts",
    "pin_conflicts": "SELECT prompt_id, 3 AS chk, seq, 0 AS sub, 'medium' AS severity, 'dependency' AS category, "
    "'Prompt requests ''' || name || '==' || a.version || ''' but codebase pins ''' || name || '==' || d.version || "
    "'''. Version mismatch could break transitive dependencies.' AS description, 'dependency:' || name AS affected_component, "
    "'Audit changelog between ' || d.version || ' and ' || a.version || "
    "'. Update requirements.txt and run the full test suite before merging.' AS remediation "
    "FROM asked a JOIN dependencies d USING (project_id, name) WHERE d.version <> '' AND d.version <> a.version",
}
DETAILS = "severity, category, description, affected_component, remediation"


def _verdict(conflicts: str) -> dict[str, str]:
    failed, revise = (m.split("{n}") for m in (rules.MESSAGE_FAILED, rules.MESSAGE_REVISE))
    templates = {k: v.split("{component}") for k, v in rules.TEST_BY_CATEGORY.items()}
    test = "CASE category " + " ".join(
        f"WHEN {q(k)} THEN {q(a)} || affected_component || {q(b)}" for k, (a, b) in templates.items()
    ) + " END"
    flat = f"regexp_replace({strip('prompt')}, '{SPACE}+', ' ', 'g')"
    return {
        "conflicts": conflicts,
        "placed": "SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY chk, seq, sub) - 1 AS pos FROM conflicts",
        "counts": "SELECT prompt_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, "
        "count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM conflicts GROUP BY prompt_id",
        "all_tests": f"SELECT prompt_id, -2 AS pos, {q(rules.BASE_TESTS[0])} AS test FROM prompts UNION ALL "
        f"SELECT prompt_id, -1, {q(rules.BASE_TESTS[1])} FROM prompts UNION ALL "
        f"SELECT prompt_id, pos, {test} FROM placed WHERE category <> 'dependency'",
        "tests": "SELECT prompt_id, test, min(pos) AS pos FROM all_tests GROUP BY prompt_id, test",
        "summaries": f"SELECT prompt_id, CASE WHEN length(flat) <= 120 THEN flat ELSE ltrim(regexp_extract(flat, '^(.{{0,113}}[^ ]) ', 1) || ' [...]') END "
        f"AS prompt_summary FROM (SELECT prompt_id, {flat} AS flat FROM prompts)",
        "audits": "SELECT substr(sha256(CAST(p.prompt_id AS VARCHAR) || chr(31) || p.project_id || chr(31) || p.prompt), 1, 32) AS audit_id, "
        "p.prompt_id, p.project_id, p.author, p.branch, "
        "CASE WHEN c.critical > 0 THEN 'failed' WHEN c.high > 0 THEN 'needs_revision' ELSE 'passed' END AS status, "
        f"CASE WHEN c.critical > 0 THEN {q(failed[0])} || c.critical || {q(failed[1])} "
        f"WHEN c.high > 0 THEN {q(revise[0])} || c.high || {q(revise[1])} "
        f"WHEN c.n > 0 THEN {q(rules.MESSAGE_WARN)} ELSE {q(rules.MESSAGE_CLEAN)} END AS message, "
        "s.prompt_summary, coalesce(c.n, 0) AS n_conflicts, t.n_tests, p.created_at "
        "FROM prompts p LEFT JOIN counts c USING (prompt_id) JOIN summaries s USING (prompt_id) "
        "JOIN (SELECT prompt_id, count(*) AS n_tests FROM tests GROUP BY prompt_id) t USING (prompt_id)",
    }


ALL_CHECKS = "SELECT * FROM security UNION ALL SELECT * FROM drift UNION ALL SELECT * FROM collisions UNION ALL SELECT * FROM pin_conflicts"
AUDIT = INTAKE | ACCEPTED | REGISTRY | CHECKS | _verdict(ALL_CHECKS)
EVENT_AUDIT = AUDIT | EVENT_INTAKE
SECURITY_AUDIT = AUDIT | EVENT_INTAKE | _verdict("SELECT * FROM security")
FLAT = f"SELECT * REPLACE ({STAMP.removesuffix(' AS created_at')} AS created_at) FROM audits"

# ---- code ------------------------------------------------------------------------------------------


def _lines(source: str) -> dict[str, str]:
    return {
        "parts": f"SELECT path, regexp_split_to_array(content, '{BREAK}') AS parts FROM {source} WHERE content <> ''",
        "lines": "SELECT path, unnest(kept) AS line, generate_subscripts(kept, 1) AS line_no FROM "
        "(SELECT path, CASE WHEN parts[-1] = '' THEN parts[:len(parts) - 1] ELSE parts END AS kept FROM parts)",
    }


S = SPACE + "*"
# What each line rule looks for, spelt again by hand and apart from the rule table, so that a slip there shows.
LINE_SQL = {
    "INJ-001": rf"""cursor\.execute{S}\({S}(?:[fF]['"]|.*%.*['"])""",
    "INJ-002": rf"""execute{S}\({S}f['"](?:SELECT|INSERT|UPDATE|DELETE)""",
    "INJ-003": rf"subprocess\.(?:call|run|Popen){S}\(.*shell{S}={S}True",
    "INJ-004": rf"(?:(?:^|{N})eval|__import__){S}\(",
    "INJ-005": rf"(?:^|{N})os\.system{S}\(",
    "AUTH-001": rf"verify{S}={S}False",
    "AUTH-002": rf"""jwt\.decode{S}\(.*algorithms{S}={S}\[{S}['"]none['"]""",
    "AUTH-003": rf"#{S}(?:(?:no|skip) auth|(?:TODO|FIXME).*auth)",
    "AUTH-004": rf"""allow_origins{S}={S}\[?{S}['"]\*['"]""",
    "CRYPTO-001": rf"(?:^|{N})(?:md5{S}\(|hashlib\.md5(?:$|{N}))",
    "CRYPTO-002": rf"(?:^|{N})(?:sha1{S}\(|hashlib\.sha1(?:$|{N}))",
    "CRYPTO-003": r"random\.(?:random\(\)|randint\(|choice\()",
    "SEC-001": rf"""(?i)(?:password|passwd|pwd){S}={S}['"][^'"]{{4,}}['"]""",
    "SEC-002": rf"""(?i)(?:api|secret)[_-]?key{S}={S}['"][A-Za-z0-9_-]{{8,}}['"]""",
    "SEC-003": rf"""(?i)(?:token|bearer){S}={S}['"][A-Za-z0-9._-]{{20,}}['"]""",
    "SEC-004": r"-----BEGIN (?:|RSA |EC |OPENSSH )PRIVATE KEY-----",
    "CFG-001": rf"(?:DEBUG|debug){S}={S}True",
    "CFG-002": rf"""SECRET_KEY{S}={S}['"][\pL\pN_-]{{1,20}}['"]""",
    "CFG-003": rf"""host{S}={S}['"]0\.0\.0\.0['"]""",
    "DESER-001": rf"(?:^|{N})pickle\.loads?{S}\(",
    "DESER-002": rf"(?:^|{N})yaml\.load{S}\([^,)]+\)",
    "PATH-001": rf"""open{S}\((?:.*\+|{S}f['"])""",
}


def _findings() -> str:
    return " UNION ALL ".join(
        f"SELECT {q(r.severity)} AS severity, {q(r.category)} AS category, {q(r.rule_id)} AS rule_id, path AS file, "
        f"line_no AS line, 1 AS col, substr({strip('line')}, 1, 120) AS snippet, {q(r.description)} AS description, "
        f"{q(r.remediation)} AS remediation FROM lines WHERE regexp_matches(line, {q(LINE_SQL[r.rule_id])})"
        for r in rules.LINE_RULES
    )


FILES = {"files": select(derive.FILE_COLUMNS, "documents")}
CODE = FILES | _lines("files") | {"findings": _findings()}
SCANNED = {
    "scanned": "SELECT * FROM files WHERE path LIKE '%.py' AND len(list_intersect(string_split(path, '/'), "
    "['.git', '__pycache__', 'venv', 'env', '.venv', 'node_modules', 'dist', 'build'])) = 0"
}
EDITED = (
    "SELECT path, CASE WHEN length(path) % 3 = 0 THEN content || chr(10) || 'DEBUG = True' || chr(10) ELSE content END AS content "
    "FROM written WHERE length(path) % 3 <> 1"
)
SNIPPETS = {"snippets": "SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents"} | _lines("snippets") | {
    "findings": _findings()
}
FINDINGS = "SELECT * REPLACE (CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col) FROM findings"

BROKEN = r"content LIKE 'def broken syntax((%' OR regexp_matches(content, '\nclass Broken[0-9]+\(Base\)\n') OR regexp_matches(content, '\n  y = md5')"
PARSED = FILES | {"whole": f"SELECT * FROM files WHERE NOT ({BROKEN})"}


def _ast_row(rule: tuple, condition: str) -> str:
    rule_id, severity, category, description, remediation = rule
    return (
        f"SELECT {q(severity)} AS severity, {q(category)} AS category, {q(rule_id)} AS rule_id, path AS file, "
        "CAST(line_no AS BIGINT) AS line, CAST(1 + length(line) - length(ltrim(line)) AS BIGINT) AS col, trim(line) AS snippet, "
        f"{q(description)} AS description, {q(remediation)} AS remediation FROM following WHERE {condition}"
    )


AST = PARSED | _lines("files") | {
    "following": "SELECT *, lead(trim(line)) OVER (PARTITION BY path ORDER BY line_no) AS next_line FROM lines "
    "WHERE path IN (SELECT path FROM whole)"
}
AST_FINDINGS = (
    _ast_row(rules.SWALLOWED_ERROR, "trim(line) = 'except:' AND next_line = 'pass'")
    + " UNION ALL "
    + _ast_row(rules.ASSERTED_ACCESS, "regexp_matches(line, '(?i)^ *assert .*(?:auth|permission|role|admin|token|user)')")
)

# line and syntax-tree findings together, of all files and of the scanned ones
SCAN = AST | {"line_findings": _findings(), "findings": f"SELECT * FROM line_findings UNION ALL {AST_FINDINGS}"}
TREE_SCAN = SCAN | SCANNED | _lines("scanned")
ROUTE = r"'@[a-z]+\.(get|post|put|patch|delete|options|head)\(\"([^\"]*)\"\)\n *(?:async )?def ([A-Za-z_0-9]+)\(([^)]*)\)'".replace('\\"', '"')
MODEL = r"'\nclass ([A-Za-z_0-9]+)\((?:[^)]*[ .,])?(?:BaseModel|Base|DeclarativeBase)[,)]'"
INVENTORY = PARSED | {
    "routes": "SELECT path AS module, "
    + ", ".join(f"unnest(regexp_extract_all(content, {ROUTE}, {i})) AS {c}" for i, c in enumerate(["verb", "route", "handler", "args"], 1))
    + " FROM whole",
    "code_endpoints": "SELECT route AS path, upper(verb) AS method, handler, module, "
    "array_to_string(list_filter(list_transform(string_split(args, ','), lambda a: trim(a)), lambda a: a <> 'self' AND a <> ''), ',') AS parameters, "
    "'Any' AS return_type FROM routes",
    "code_models": f"SELECT unnest(regexp_extract_all(content, {MODEL}, 1)) AS name, path AS module FROM whole",
}
SNAPSHOT = REQUIREMENTS | INVENTORY | {
    "snapshot": "SELECT split_part(module, '/', 1) AS project_id, 'endpoint' AS kind, path AS name, "
    "method || ' ' || handler || ' ' || module || ' ' || parameters AS value FROM code_endpoints UNION ALL "
    "SELECT split_part(module, '/', 1), 'model', name, '' FROM code_models UNION ALL "
    "SELECT project_id, 'dependency', name, version FROM dependencies"
}

# ---- secrets and ignore files ----------------------------------------------------------------------

CONFIG = {"config_files": select(derive.CONFIG_COLUMNS, "documents")}
QUOTED = rf"(?:^|[^\pL\pN_.-])([\pL\pN_.-]*?%s{W}*)['\"]?{SPACE}*[:=]{SPACE}*['\"][^'\"\t-\r\x1c-\x20]{{%d,}}['\"]".replace('\\"', '"')
BARE = rf"^{SPACE}*(?:export{SPACE}+)?([\pL\pN_.-]*?%s{W}*){SPACE}*[:=]{SPACE}*[^\t-\r\x1c-\x20'\"()$<{{][^\t-\r\x1c-\x20'\"()]{{%d,}}{SPACE}*$".replace('\\"', '"')
KEY, PASS, TOKEN = "(?:api[_-]?key|secret[_-]?key)", "(?:password|passwd|pwd)", "(?:token|bearer)"
KINDS = [
    ("aws_key", rf"""(?:(?:^|[^\pL\pN_.-])([\pL\pN_.-]+)['"]?{SPACE}*[:=]{SPACE}*['"]?|^|[^A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?:$|[^A-Za-z0-9])""", False),
    ("private_key", "()-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", False),
    ("api_key", "(?i)" + QUOTED % (KEY, 8), False),
    ("api_key", "(?i)" + BARE % (KEY, 7), True),
    ("password", "(?i)" + QUOTED % (PASS, 4), False),
    ("password", "(?i)" + BARE % (PASS, 3), True),
    ("token", "(?i)" + QUOTED % (TOKEN, 20), False),
    ("token", "(?i)" + BARE % (TOKEN, 19), True),
]
BARE_FILE = "regexp_matches(path, '(?:\\.env|\\.yml|\\.cfg)$')"
SECRETS = {
    "hits": " UNION ALL ".join(
        f"SELECT path AS file, line_no AS line, {q(kind)} AS type, {i} AS place, regexp_extract(line, {q(p)}, 1) AS name "
        f"FROM lines WHERE regexp_matches(line, {q(p)})" + (f" AND {BARE_FILE}" if bare else "")
        for i, (kind, p, bare) in enumerate(KINDS)
    ),
    "named": "SELECT file, line, type, arg_min(name, place) AS name FROM hits "
    "WHERE regexp_matches(file, '(?:\\.env|\\.yml|\\.json|\\.toml|\\.cfg|\\.py)$') GROUP BY file, line, type",
    "secrets": "SELECT file, CAST(line AS BIGINT) AS line, type, CASE WHEN name = '' THEN 'an unnamed value' ELSE name END AS variable, "
    "'Hardcoded ' || type || ' found in ' || CASE WHEN name = '' THEN 'an unnamed value' ELSE name END AS description FROM named",
}
CONFIG_SECRETS = CONFIG | _lines("config_files") | SECRETS
PAGE_SECRETS = {"page_files": select(derive.PAGE_COLUMNS, "pages")} | _lines("page_files") | SECRETS

REQUIRED = "(VALUES " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(rules.REQUIRED_IGNORES)) + ") r(place, entry)"
IGNORES = {
    "ignore_files": select(derive.IGNORE_COLUMNS, "customer") + f" WHERE {derive.IGNORE_WHERE}",
    "ignore_lines": "SELECT path AS root, trim(unnest(string_split(content, chr(10)))) AS line FROM ignore_files",
    "entries": "SELECT DISTINCT root, rtrim(line, '/') AS entry FROM ignore_lines WHERE line <> '' AND line NOT LIKE '#%'",
    "roots": select(derive.ROOT_COLUMNS, "customer"),
    "needs": f"SELECT o.root, r.place, r.entry, e.entry IS NOT NULL AS present FROM roots o CROSS JOIN {REQUIRED} "
    "LEFT JOIN entries e ON e.root = o.root AND e.entry = rtrim(r.entry, '/')",
    "reports": "SELECT n.root, n.root IN (SELECT path FROM ignore_files) AS gitignore_found, bool_and(present) AS is_sufficient, "
    "coalesce(string_agg(entry, ' ' ORDER BY place) FILTER (present), '') AS present_patterns, "
    "coalesce(string_agg(entry, ' ' ORDER BY place) FILTER (NOT present), '') AS missing_patterns, "
    f"CASE WHEN bool_and(present) THEN {q(rules.IGNORE_OK)} ELSE {q(rules.IGNORE_ADVICE)} END AS recommendation "
    "FROM needs n GROUP BY n.root",
}

ANY = "(.*/)?"
#: (text, line, negated, folders alone, pattern) of the lines of derive.GLOB_TEXTS, by hand.
GLOB_RULES = [
    (0, 1, False, False, rf"^{ANY}\.env[^/]*$"), (0, 2, True, False, rf"^{ANY}\.env\.example$"), (1, 1, False, False, r"^\.env$"), (2, 1, False, False, rf"^{ANY}config/\.env$"),
    (3, 1, False, True, rf"^{ANY}secrets$"), (3, 2, True, False, r"^secrets/\.env$"), (4, 1, False, False, rf"^{ANY}[^/]*\.env$"), (4, 2, True, False, rf"^{ANY}prod\.env$"),
    (5, 1, False, False, rf"^{ANY}[._]env$"), (6, 1, False, False, rf"^{ANY}[^/]*$"), (6, 2, True, True, rf"^{ANY}[^/]*$"), (6, 3, True, False, rf"^{ANY}\.env\.example$"),
    (7, 1, False, False, r"^app/.+$"), (8, 1, False, False, r"^app/[^/]*$"), (8, 2, True, True, r"^app/config$"), (9, 3, False, False, rf"^{ANY}\.env\.[^/]ocal$"), (9, 4, True, False, rf"^{ANY}nothing$"),
    (10, 1, False, False, rf"^{ANY}\.env$"), (10, 2, True, False, rf"^{ANY}\.env$"),
]
GLOBS = {
    "rules": "SELECT * FROM (VALUES " + ", ".join(f"({t}, {n}, {neg}, {dirs}, {q(p)})" for t, n, neg, dirs, p in GLOB_RULES) + ") r(kind, line_no, negated, folders, pattern)",
    "files": f"SELECT 'proj-' || c_custkey AS root, CASE WHEN {derive.IGNORE_WHERE} THEN c_custkey % {len(derive.GLOB_TEXTS)} END AS kind, unnest([{', '.join(map(q, derive.GLOB_FILES))}]) AS name FROM customer",
    "levels": "SELECT root, kind, name, d, len(string_split(name, '/')) AS depth, array_to_string(string_split(name, '/')[1:d], '/') AS part "
    "FROM (SELECT *, unnest(range(1, len(string_split(name, '/')) + 1)) AS d FROM files)",
    "decided": "SELECT root, name, d, arg_max(negated, line_no) AS negated FROM levels JOIN rules USING (kind) "
    "WHERE regexp_matches(part, pattern) AND (NOT folders OR d < depth) GROUP BY root, name, d",
}

# ---- retrieval -------------------------------------------------------------------------------------


def _words(col: str) -> str:
    return f"unnest(list_distinct(list_filter(regexp_split_to_array(lower({col}), '{SPACE}+'), lambda w: w <> '')))"


def _keyword(docs: str, queries: str, k: int) -> str:
    """``docs``: (ord, content), ``queries``: (query_id, text)."""
    return (
        f"WITH d AS (SELECT ord, {_words('content')} AS w FROM ({docs})), q AS (SELECT query_id, {_words('text')} AS w FROM ({queries})), "
        "o AS (SELECT query_id, ord, count(*) AS overlap FROM q JOIN d USING (w) GROUP BY query_id, ord) "
        "SELECT query_id, ord, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, ord) AS rank "
        f"FROM o QUALIFY rank <= {k}"
    )


DOCS = "SELECT doc_id AS ord, text AS content FROM documents"
BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"
CONTEXT = "SELECT item_id AS ord, text AS content FROM benchmark"
ACCEPTED_SQL = with_(INTAKE | ACCEPTED, "SELECT prompt_id AS query_id, prompt AS text FROM prompts")

KNN = (
    "WITH elements AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "sums AS (SELECT label, i, sum(CAST(floor(CAST(x AS DOUBLE) * 1000000 + 0.5) AS BIGINT)) AS x FROM elements GROUP BY label, i), "
    "wanted AS (SELECT CAST(label AS BIGINT) AS query_id, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM sums GROUP BY label), "
    "scored AS (SELECT query_id, vec_id AS ord, round(list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))), 6) AS cosine "
    "FROM wanted, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) "
    "SELECT query_id, ord, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ord) AS rank FROM scored QUALIFY rank <= 5"
)

KNN_ROWS = (
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "scored AS (SELECT q.vec_id AS query_id, e.vec_id AS ord, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS cosine "
    "FROM e q, e WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, ord, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ord) AS rank FROM scored QUALIFY rank <= 6"
)


def _placed(name: str) -> str:
    return f"SELECT prompt_id, CAST(seq AS BIGINT) AS seq, CAST(sub AS BIGINT) AS sub, {DETAILS} FROM {name}"


def _rule(seq: int) -> str:
    return with_(INTAKE | ACCEPTED | {"security": CHECKS["security"]}, f"SELECT prompt_id, {DETAILS} FROM security WHERE seq = {seq}")


ORACLE: dict[str, str] = {
    "prompt_intake": with_(INTAKE | ACCEPTED, f"SELECT prompt_id, prompt, project_id, author, branch, {STAMP} FROM prompts"),
    "prompt_rejects": with_(
        INTAKE, "SELECT prompt_id, CASE WHEN prompt IS NULL THEN 'prompt' ELSE 'project_id' END AS missing_field "
        "FROM intake WHERE prompt IS NULL OR project_id IS NULL"
    ),
    "prompt_bulk_load": with_(
        INTAKE | ACCEPTED, "SELECT upper(project_id) AS label, prompt, project_id, author, branch FROM prompts"
    ),
    "prompt_bulk_array": with_(
        INTAKE | ACCEPTED, "SELECT upper(project_id) AS label, prompt, project_id, author, branch FROM prompts"
    ),
    "source_tree_scan": with_(FILES | SCANNED | _lines("scanned") | TREE_SCAN, FINDINGS),
    "snippet_scan": with_(SNIPPETS, FINDINGS),
    "snippet_scan_files": with_(SCAN, FINDINGS),
    "requirements_parse": with_(REQUIREMENTS, "SELECT * FROM parsed"),
    "audit_log_roundtrip": with_(AUDIT, FLAT),
    "audit_log_dedupe": with_(AUDIT, FLAT + " WHERE prompt_id < 1000000000000"),
    "doc_append": "SELECT source || '/' || lang AS id, count(*) AS n_docs, count(*) AS n_places, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source || '/' || lang",
    "doc_upsert": "SELECT source || '/' || lang AS id, max(doc_id) AS ord, CAST(length(arg_max(text, doc_id)) AS BIGINT) AS n_chars, lang "
    "FROM documents GROUP BY source, lang",
    "rule_raw_sql": _rule(1),
    "rule_auth_bypass": _rule(2),
    "rule_prompt_secret": _rule(3),
    "rule_webhook_unsigned": _rule(4),
    "rule_rate_limit": _rule(5),
    "api_drift": with_(AUDIT, _placed("drift")),
    "endpoint_latest": with_(REGISTRY, "SELECT * FROM latest"),
    "endpoint_latest_code": with_(
        PARSED, "SELECT split_part(module, '/', 1) AS project_id, route AS path, arg_max(upper(verb), place) AS method FROM (SELECT path AS module, "
        f"unnest(regexp_extract_all(content, {ROUTE}, 1)) AS verb, unnest(regexp_extract_all(content, {ROUTE}, 2)) AS route, "
        f"generate_subscripts(regexp_extract_all(content, {ROUTE}, 1), 1) AS place FROM whole) GROUP BY ALL"
    ),
    "schema_collision": with_(AUDIT, _placed("collisions")),
    "dependency_conflict": with_(AUDIT, _placed("pin_conflicts")),
    "audit_conflicts": with_(AUDIT, f"SELECT prompt_id, pos, {DETAILS} FROM placed"),
    "severity_counts": with_(
        AUDIT, "SELECT prompt_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium "
        "FROM prompts LEFT JOIN counts USING (prompt_id)"
    ),
    "audit_verdict": with_(AUDIT, FLAT),
    "audit_verdict_joined": with_(AUDIT, FLAT),
    "custom_rule": with_(
        INTAKE | ACCEPTED, "SELECT prompt_id, 'medium' AS severity, 'policy' AS category, 'Prompt names a password.' AS description, "
        "'prompt' AS affected_component, 'Leave it out.' AS remediation FROM prompts WHERE contains(lower(prompt), 'password')"
    ),
    "test_suggestions": with_(
        AUDIT, "SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY pos) - 1 AS pos, test FROM tests"
    ),
    "prompt_summary": with_(AUDIT, "SELECT * FROM summaries"),
    "file_lines": with_(FILES | _lines("files"), "SELECT path, line_no, line FROM lines"),
    "code_findings": with_(CODE, FINDINGS),
    "scan_summary": with_(SCAN, "SELECT severity, count(*) AS n FROM findings GROUP BY severity"),
    "scan_rollup": with_(
        SCAN, "SELECT f.*, s.total_lines, coalesce(n.total_findings, 0) AS total_findings, "
        + ", ".join(f"coalesce(n.{s}, 0) AS {s}" for s in rules.SEVERITIES)
        + " FROM (SELECT split_part(path, '/', 1) AS project_id, count(*) AS scanned_files FROM files GROUP BY 1) f "
        "JOIN (SELECT split_part(path, '/', 1) AS project_id, count(*) AS total_lines FROM lines GROUP BY 1) s USING (project_id) "
        "LEFT JOIN (SELECT split_part(file, '/', 1) AS project_id, count(*) AS total_findings, "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in rules.SEVERITIES)
        + " FROM findings GROUP BY 1) n USING (project_id)"
    ),
    "ast_findings": with_(AST, AST_FINDINGS),
    "parse_errors": with_(FILES, f"SELECT path, CASE WHEN content LIKE '# %' AND regexp_matches(content, '\\n  y = md5') THEN 'IndentationError' ELSE 'SyntaxError' END AS error FROM files WHERE {BROKEN}"),
    "secret_findings": with_(CONFIG_SECRETS, "SELECT * FROM secrets"),
    "page_secret_findings": with_(PAGE_SECRETS, "SELECT * FROM secrets"),
    "secret_rollup": with_(
        CONFIG_SECRETS | IGNORES,
        "SELECT r.root, count(s.file) AS n_findings, coalesce(string_agg(DISTINCT s.type, ' ' ORDER BY s.type), '') AS types, "
        "r.gitignore_found, r.is_sufficient FROM reports r LEFT JOIN secrets s ON split_part(s.file, '/', 1) = r.root "
        "GROUP BY r.root, r.gitignore_found, r.is_sufficient",
    ),
    "ignore_audit": with_(IGNORES, "SELECT * FROM reports"),
    "env_exposed": with_(
        CONFIG | IGNORES, "SELECT root, path FROM config_files WHERE path LIKE '%/.env' "
        "AND root NOT IN (SELECT root FROM entries WHERE entry = '.env')"  # these roots have no other line that says something of it
    ),
    "ignore_globs": with_(
        GLOBS, "SELECT root, root || '/' || name AS path, (root, name) IN (SELECT (root, name) FROM decided WHERE NOT negated) AS ignored FROM files"
    ),
    "extract_endpoints": with_(INVENTORY, "SELECT * FROM code_endpoints"),
    "extract_models": with_(INVENTORY, "SELECT * FROM code_models"),
    "dependency_latest": with_(REQUIREMENTS, "SELECT * FROM dependencies"),
    "context_snapshot": with_(SNAPSHOT, "SELECT * FROM snapshot"),
    "context_checksum": with_(
        SNAPSHOT, "SELECT project_id, count(*) FILTER (kind = 'endpoint') AS n_endpoints, count(*) FILTER (kind = 'model') AS n_models, "
        "count(*) FILTER (kind = 'dependency') AS n_dependencies, "
        "substr(sha256(CAST(sum(CAST('0x' || substr(sha256(kind || chr(31) || name || chr(31) || value), 1, 15) AS BIGINT)) AS VARCHAR) "
        "|| ':' || project_id), 1, 12) AS checksum FROM snapshot GROUP BY project_id"
    ),
    "keyword_topk": _keyword(DOCS, BENCHMARK, 5),
    "keyword_topk_large": _keyword(DOCS, BENCHMARK, 5),
    "keyword_documents": f"SELECT k.query_id, d.source || '/' || d.lang AS id, d.source, md5(d.text) AS content_md5 "
    f"FROM ({_keyword(DOCS, BENCHMARK, 1)}) k JOIN documents d ON d.doc_id = k.ord",
    "doc_count": "SELECT count(*) AS n_docs FROM documents",
    "knn_cosine": KNN,
    "knn_indexed": KNN_ROWS,
    "prompt_context_topk": _keyword(CONTEXT, ACCEPTED_SQL, 3),
    "audit_lookup": with_(AUDIT, FLAT + " WHERE prompt_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')"),
    "audit_history": with_(
        AUDIT, "SELECT audit_id, project_id, author, branch, status, prompt_summary, n_conflicts AS conflicts, "
        "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, message FROM audits ORDER BY audits.created_at DESC, audit_id LIMIT 50"
    ),
    "stream_audit": with_(EVENT_AUDIT, FLAT),
    "stream_dedupe": with_(SECURITY_AUDIT, FLAT),
    "stream_late_audits": with_(SECURITY_AUDIT, FLAT),
    "stream_lookup": with_(EVENT_AUDIT, FLAT + " WHERE prompt_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')"),
    "stream_code_scan": with_(SCAN, FINDINGS),
    "stream_edits": with_({"written": FILES["files"], "files": EDITED} | SCANNED | _lines("scanned") | {k: v for k, v in TREE_SCAN.items() if k != "files"}, FINDINGS),
}
