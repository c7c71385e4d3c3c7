"""The syntax-tree pass: one Arrow-batched walk per file, for findings and for the codebase inventory.

The only place where files go through Python. Each file is parsed once, by the standard parser; files
that cannot hold what is looked for are filtered out before they leave the JVM.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rules import ACCESS_WORDS, ASSERTED_ACCESS, MODEL_BASES, ROUTE_METHODS, SWALLOWED_ERROR

_ACCESS = re.compile(ACCESS_WORDS, re.IGNORECASE)
_ROWS_PER_BATCH = 4096

FACT_SCHEMA = (
    "path string, seq int, kind string, line int, col int, name string, detail string, handler string, "
    "parameters array<string>, snippet string"
)


def _fact(kind: str, node: ast.AST | None = None, **values) -> dict:
    base = {"kind": kind, "line": None, "col": None, "name": None, "detail": None, "handler": None,
            "parameters": None, "snippet": None}
    if node is not None:
        base.update(line=node.lineno, col=node.col_offset + 1)
    return base | values


class FileFacts:
    """All facts of one file from one breadth-first walk, each node handed to what collects its type."""

    def __init__(self, source: str, findings: bool, inventory: bool):
        self.lines = source.splitlines() if findings else []
        self.found: list[dict] = []
        self.collectors = {}
        if findings:
            self.collectors |= {ast.ExceptHandler: self.swallowed, ast.Assert: self.asserted}
        if inventory:
            self.collectors |= {ast.FunctionDef: self.routes, ast.AsyncFunctionDef: self.routes, ast.ClassDef: self.model}

    def walk(self, tree: ast.AST) -> list[dict]:
        level = [tree]
        while level:
            for node in level:
                if collect := self.collectors.get(type(node)):
                    collect(node)
            level = [child for node in level for child in ast.iter_child_nodes(node)]
        return self.found

    def add(self, kind: str, node: ast.AST, **values) -> None:
        self.found.append(_fact(kind, node, **values))

    def shown(self, node: ast.stmt | ast.ExceptHandler) -> str:
        return "".join(self.lines[node.lineno - 1 : node.lineno]).strip()

    def swallowed(self, node: ast.ExceptHandler) -> None:
        if node.type is None and [type(x) for x in node.body] == [ast.Pass]:
            self.add("finding", node, name=SWALLOWED_ERROR[0], snippet=self.shown(node))

    def asserted(self, node: ast.Assert) -> None:
        line = self.shown(node)
        if _ACCESS.search(line):
            self.add("finding", node, name=ASSERTED_ACCESS[0], snippet=line)

    def routes(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        takes = [name for name in (a.arg for a in node.args.args) if name != "self"]
        for call in node.decorator_list:
            match call:
                case ast.Call(func=ast.Attribute(attr=verb), args=[ast.Constant(value=route), *_]):
                    pass
                case ast.Call(func=ast.Attribute(attr=verb)):
                    route = ""
                case _:
                    continue
            if verb in ROUTE_METHODS:
                self.add("endpoint", node, name=str(route), detail=verb.upper(), handler=node.name, parameters=takes)

    def model(self, node: ast.ClassDef) -> None:
        for base in node.bases:
            if (isinstance(base, ast.Name) and base.id in MODEL_BASES) or (isinstance(base, ast.Attribute) and base.attr in MODEL_BASES):
                self.add("model", node, name=node.name)
                return


def file_facts(source: str, findings: bool, inventory: bool) -> list[dict]:
    """What one file holds, in walk order; a file that does not parse holds one ``error``."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        return [_fact("error", detail=type(exc).__name__)]
    return FileFacts(source, findings, inventory).walk(tree)


def _walker(findings: bool, inventory: bool):
    arrow_schema = pa.schema(
        [("path", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32()),
         ("name", pa.string()), ("detail", pa.string()), ("handler", pa.string()),
         ("parameters", pa.list_(pa.string())), ("snippet", pa.string())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, source in zip(batch.column("path"), batch.column("content"), strict=True):
                found = enumerate(file_facts(source.as_py(), findings, inventory))
                rows += ({"path": path.as_py(), "seq": seq, **fact} for seq, fact in found)
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return walk


def syntax_facts(files: DataFrame, findings: bool = True, inventory: bool = True) -> DataFrame:
    """Facts of every file that can be read; ``content`` null means it could not be decoded and is left out."""
    needed = files.select("path", "content").filter(F.col("content").isNotNull())
    return needed.mapInArrow(_walker(findings, inventory), FACT_SCHEMA)


def ast_findings(files: DataFrame) -> DataFrame:
    """Swallowed errors and asserted access checks; only from files that parse as a whole."""
    content = F.col("content")
    swallowing = content.contains("except") & content.contains("pass")
    asserting = content.contains("assert")
    possible = files.filter(swallowing | asserting)
    facts = syntax_facts(possible, inventory=False).filter("kind = 'finding'")
    table = {row[0]: row for row in (SWALLOWED_ERROR, ASSERTED_ACCESS)}

    def of_rule(i: int):
        chosen = F.lit(None).cast("string")
        for rule_id, row in table.items():
            chosen = F.when(F.col("name") == rule_id, F.lit(row[i])).otherwise(chosen)
        return chosen

    return facts.select(
        of_rule(1).alias("severity"), of_rule(2).alias("category"), F.col("name").alias("rule_id"),
        F.col("path").alias("file"), "line", "col", "snippet",
        of_rule(3).alias("description"), of_rule(4).alias("remediation"),
    )


def parse_errors(files: DataFrame) -> DataFrame:
    """Files without a syntax tree, and why; those that could not be read or decoded included."""
    broken = syntax_facts(files, findings=False, inventory=False).filter("kind = 'error'")
    reason = F.coalesce("error", F.lit("UnicodeDecodeError")) if "error" in files.columns else F.lit("UnicodeDecodeError")
    undecoded = files.filter(F.col("content").isNull()).select("path", reason.alias("error"))
    return broken.select("path", F.col("detail").alias("error")).unionByName(undecoded)
