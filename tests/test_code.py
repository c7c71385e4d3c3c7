import pytest
from pyspark.sql import functions as F

from auditlake.functions.rules import LINE_RULES, LineRule
from auditlake.operators import code_scan, syntax
from auditlake.operators.scan import scan_snippets, scan_source
from auditlake.sources import files as tree

# rule -> (lines that hit, lines that do not)
CASES = {
    "INJ-001": (['cursor.execute(f"SELECT 1")', 'cursor.execute("a %s", (x,))', "cursor.execute (F'x')"], ["cursor.execute(q)", "db.execute(f'x')"]),
    "INJ-002": (["db.execute(f'SELECT 1')", 'execute ( f"DELETE")'], ["execute(f'select 1')", "execute('SELECT')"]),
    "INJ-003": (["subprocess.run(c, shell=True)", "subprocess.Popen (c, shell = True)"], ["subprocess.run(c)", "run(c, shell=True)"]),
    "INJ-004": (["x = eval(y)", "__import__('os')", "x__import__ ('os')"], ["medieval(1)", "retrieval (1)", "évaleval"]),
    "INJ-005": (["os.system('ls')"], ["pos.system('ls')", "os.system"]),
    "AUTH-001": (["get(u, verify=False)", "noverify = False"], ["verify=True"]),
    "AUTH-002": (["jwt.decode(t, k, algorithms=['none'])"], ["jwt.decode(t, k, algorithms=['None'])", "jwt.decode(t)"]),
    "AUTH-003": (["# no auth", "x = 1 #TODO: auth later", "# FIXME the auth"], ["# No auth", "# todo auth", "TODO auth"]),
    "AUTH-004": (["allow_origins=['*']", "allow_origins = '*'"], ["allow_origins=['a']"]),
    "CRYPTO-001": (["md5(x)", "hashlib.md5"], ["amd5(x)", "md5"]),
    "CRYPTO-002": (["sha1 (x)", "hashlib.sha1(x)"], ["hashlib.sha1x", "sha1"]),
    "CRYPTO-003": (["random.random()", "random.choice(x)"], ["random.random", "secrets.choice(x)"]),
    "SEC-001": (["password = 'abcd'", 'DB_PWD="p@ss w"', "PassWd='1234'"], ["password = 'abc'", "password == 'abcd'", "password = os.getenv('X')"]),
    "SEC-002": (["api_key = 'abcdefgh'", "SECRET-KEY='12345678'"], ["api_key='short'", "apikey = 'has a space'"]),
    "SEC-003": (["token = 'abcdefghij.klmnopq-rst'", "Bearer='aaaaaaaaaaaaaaaaaaaa'"], ["token = 'short'"]),
    "SEC-004": (["-----BEGIN PRIVATE KEY-----", "x = '-----BEGIN EC PRIVATE KEY-----'"], ["-----BEGIN DSA PRIVATE KEY-----"]),
    "CFG-001": (["DEBUG = True", "mydebug=True"], ["Debug = True", "DEBUG = False"]),
    "CFG-002": (["SECRET_KEY = 'é-1'"], ["SECRET_KEY = 'aaaaaaaaaaaaaaaaaaaaa'", "SECRET_KEY = ''"]),
    "CFG-003": (["host='0.0.0.0'"], ["host='10.0.0.0'", "'0.0.0.0'"]),
    "DESER-001": (["pickle.load(f)", "pickle.loads (b)"], ["cpickle.load(f)", "pickle.dump(f)"]),
    "DESER-002": (["yaml.load(f)"], ["yaml.load(f, L)", "yaml.load()", "yaml.safe_load(f)"]),
    "PATH-001": (["open(a + b)", "open(f'x')", "Popen(c + d)"], ["open('a')", "a + open('b')"]),
}


def scan(spark, **files):
    found = code_scan.line_findings(spark.createDataFrame(list(files.items()), "path string, content string"))
    return [(r["file"], r["line"], r["rule_id"]) for r in found.orderBy("file", "line", "rule_id").collect()]


def test_every_rule_hit_and_near_miss(spark):
    assert set(CASES) == {r.rule_id for r in LINE_RULES} and len(LINE_RULES) == 22
    lines = [(f"{rule}|{int(hit)}|{i}", line) for rule, pair in CASES.items() for hit, group in zip((1, 0), pair) for i, line in enumerate(group)]
    found = code_scan.line_findings(spark.createDataFrame(lines, "path string, content string"))
    hits = {r["file"] for r in found.collect() if r["file"].split("|")[0] == r["rule_id"]}
    assert hits == {name for name, _ in lines if name.split("|")[1] == "1"}


def test_golden_snippets(spark):
    # Snippets with hand-traced findings.
    one = (
        "password = 'supersecret123'\napi_key = 'sk-abcdef1234567890abcdef'\n"
        "cursor.execute(f\"SELECT * FROM users WHERE id={user_id}\")\n"
        "result = cursor.execute(\"SELECT * FROM orders WHERE name='\" + name + \"'\")\n"
    )
    two = (
        "DEBUG = True\nSECRET_KEY = 'abc123'\nimport hashlib\ntoken_hash = hashlib.md5(token.encode()).hexdigest()\n"
        "# TODO: skip auth for now\nsubprocess.call('rm -rf /tmp/' + user_dir, shell=True)\n"
    )
    three = "import os\npassword = os.getenv('DB_PASSWORD')\napi_key = os.getenv('API_KEY')\nh = hashlib.sha256(t).hexdigest()\n"
    assert scan(spark, a=one, b=two, c=three) == [
        ("a", 1, "SEC-001"), ("a", 2, "SEC-002"), ("a", 3, "INJ-001"), ("a", 3, "INJ-002"),
        ("b", 1, "CFG-001"), ("b", 2, "CFG-002"), ("b", 4, "CRYPTO-001"), ("b", 5, "AUTH-003"), ("b", 6, "INJ-003"),
    ]


def test_line_breaks_snippets_and_names(spark):
    content = "x\r\nDEBUG = True\x0cverify=False\r  " + "md5(" + "y" * 200 + "\n\n"
    found = scan_snippets(spark.createDataFrame([(content,)], "content string")).orderBy("line").collect()
    assert [(r["file"], r["line"], r["col"], r["rule_id"]) for r in found] == [
        ("<snippet>", 2, 1, "CFG-001"), ("<snippet>", 3, 1, "AUTH-001"), ("<snippet>", 4, 1, "CRYPTO-001")
    ]
    assert found[2]["snippet"] == "md5(" + "y" * 116


def test_short_key_is_also_a_secret(spark):
    assert [r[2] for r in scan(spark, a="SECRET_KEY = 'abc123'")] == ["CFG-002"]
    assert [r[2] for r in scan(spark, a="SECRET_KEY = 'abc12345'")] == ["CFG-002", "SEC-002"]


def test_own_rules_and_limits(spark, files_of):
    own = [LineRule("X", "low", "style", r"foo+\b", ("FOO", "foo"), "d", "r", ignore_case=False)]
    assert code_scan.line_findings(files_of(a="foo\nfood"), own).count() == 1
    with pytest.raises(ValueError):
        code_scan.line_findings(files_of(a="x"), [])
    many = [LineRule(f"R{i}", "low", "style", rf"\bw{i}\b", (f"w{i}",), "d", "r") for i in range(150)]
    found = code_scan.line_findings(files_of(a="w0 w62\nw63 w126 w149\nnone\nw64"), many).collect()
    assert sorted((r["line"], r["rule_id"]) for r in found) == [(1, "R0"), (1, "R62"), (2, "R126"), (2, "R149"), (2, "R63"), (4, "R64")]


def test_snippets_get_both_kinds_of_rule(spark):
    code = "try:\n    x = 1\nexcept:\n    pass\nassert user.is_admin\n"
    found = scan_snippets(spark.createDataFrame([(code,)], "content string")).collect()
    assert sorted(r["rule_id"] for r in found) == ["AUTH-005", "CFG-004"]


def test_totals(spark, files_of):
    files = files_of(**{"bad.py": "password = 'hunter2'\ncursor.execute(f\"SELECT {x}\")\n", "good.py": "import os\npw = 1\n", "empty.py": ""})
    findings = code_scan.line_findings(files)
    total = code_scan.scan_totals(files, findings).first()
    assert (total["scanned_files"], total["total_lines"], total["total_findings"], total["critical"], total["low"]) == (3, 4, 3, 3, 0)
    assert {r["severity"]: r["n"] for r in code_scan.severity_summary(findings).collect()} == {"critical": 3}
    per_file = code_scan.scan_totals(files.withColumn("f", F.col("path")), findings.withColumn("f", F.col("file")), ["f"])
    assert {r["f"]: r["total_findings"] for r in per_file.collect()} == {"bad.py": 3, "good.py": 0, "empty.py": 0}


def test_tree(spark, tmp_path):
    for name, content in {
        "pkg/__init__.py": "DEBUG = True\n", ".hidden.py": "md5(x)\n", "venv/lib/a.py": "md5(x)\n", "a/b/c/d/e.py": "md5(x)\n",
        "notes.txt": "md5(x)\n", "env.py": "md5(x)\n", "build": "md5(x)\n", ".py": "md5(x)\n", ".env": "API_KEY=abcdefgh1\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "latin.py").write_bytes(b"# caf\xe9\nmd5(x)\n")
    files = tree.read_tree(spark, str(tmp_path))
    contents = {r["path"]: r["content"] for r in files.collect()}
    assert set(contents) == {"pkg/__init__.py", ".hidden.py", "a/b/c/d/e.py", "env.py", "latin.py"}
    assert contents["latin.py"] is None
    assert {r["file"] for r in code_scan.line_findings(files).collect()} == set(contents) - {"latin.py"}
    assert [(r["path"], r["error"]) for r in syntax.parse_errors(files).collect()] == [("latin.py", "UnicodeDecodeError")]
    assert [r["path"] for r in tree.read_config_tree(spark, str(tmp_path), (".env",)).collect()] == [".env"]
    assert {r["path"] for r in tree.read_tree(spark, f"file:{tmp_path}", (".txt",)).collect()} == {"notes.txt"}


def test_linked_folders_and_missing_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("md5(x)\n")
    (tmp_path / "a" / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "y.py").symlink_to(tmp_path / "a" / "x.py")
    assert sorted(r["path"] for r in tree.list_tree(spark, str(tmp_path)).collect()) == ["a/x.py", "y.py"]
    gone = spark.createDataFrame([("a/x.py",), ("a/gone.py",)], "path string")
    files = tree.read_files(gone, str(tmp_path))
    assert [(r["path"], r["error"]) for r in syntax.parse_errors(files).collect()] == [("a/gone.py", "FileNotFoundError")]
    assert code_scan.line_findings(files).count() == 1


def test_folders_without_a_scheme_are_on_the_default_file_system(spark):
    assert tree.qualified(spark, "/data/code").startswith("file:/data/code")
    assert tree.qualified(spark, "file:/data/code").startswith("file:/data/code")


def test_scan_is_one_narrow_codegen_stage(spark, files_of):
    plan = code_scan.line_findings(files_of(a="x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan and "*(1) Filter" in plan and "*(2)" not in plan


SOURCE = '''import unittest.mock as mock
class Plain: pass
class Item(BaseModel): pass
class Row(db.Base, Mixin): pass
class Leaf(Item): pass
class Box(Generic[BaseModel]): pass

@app.get("/items/{id}")
def read(self, id, *, extra=1):
    try:
        return id
    except:
        pass

@router.post("/items", status=201)
@cached
async def create(body, user):
    @mock.patch("a.b")
    def inner(): pass
    assert user.is_admin
    assert (
        role)
    try:
        pass
    except:
        log(); pass
    try:
        pass
    except ValueError:
        pass

@router.delete(path="/x")
def remove(): pass

@get("/no")
def no(): pass

@app.get
def bare(): pass
'''


def test_syntax_findings(files_of):
    files = files_of(**{"a.py": SOURCE, "broken.py": "def broken syntax((:\n    assert user\nexcept: pass"})
    rows = syntax.ast_findings(files).orderBy("line").collect()
    assert [(r["rule_id"], r["file"], r["line"], r["col"], r["snippet"]) for r in rows] == [
        ("CFG-004", "a.py", 12, 5, "except:"), ("AUTH-005", "a.py", 20, 5, "assert user.is_admin")
    ]
    assert [(r["path"], r["error"]) for r in syntax.parse_errors(files).collect()] == [("broken.py", "SyntaxError")]


def test_long_snippet_is_not_cut_and_columns_count_bytes(files_of):
    row = syntax.ast_findings(files_of(a="x = 'é'; assert user_" + "y" * 200)).first()
    assert len(row["snippet"]) > 200 and row["col"] == 11


def test_scan_source(spark, tmp_path):
    (tmp_path / "a.py").write_text("DEBUG = True\ntry:\n    x\nexcept:\n    pass\n")
    (tmp_path / "a.txt").write_text("DEBUG = True\n")
    both = ["CFG-001", "CFG-004"]

    def rules_of(**source):
        return sorted(r["rule_id"] for r in scan_source(spark, **source).collect())

    assert rules_of(path=str(tmp_path)) == both
    assert rules_of(path=str(tmp_path / "a.py"), is_file=True) == both
    assert rules_of(path=str(tmp_path / "a.txt"), is_file=True) == []
    assert rules_of(path=str(tmp_path / "missing.py"), is_file=True) == []
    assert rules_of(code="md5(x)", path=str(tmp_path)) == ["CRYPTO-001"]
    assert scan_source(spark, code="md5(x)").first()["file"] == "<snippet>"
    with pytest.raises(ValueError):
        scan_source(spark)
