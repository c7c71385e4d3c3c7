"""Ignore rules as version control reads them: globs, folders, anchors, negation, the last matching line wins.

A line is compiled to a JVM pattern over paths relative to the root. A line with a slash before its end is anchored at the root,
any other matches at every depth; a slash at the end means folders alone; ``!`` takes an earlier decision back. ``*`` and ``?`` stop
at slashes, ``**`` as a whole component does not. Every folder of a path is decided by itself, and what lies in an ignored
folder is ignored, whatever later lines say of it. Lines are trimmed; what ``#`` begins is a comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.sizing import known_only, sized_join

_RULES = pa.schema([("root", pa.string()), ("line_no", pa.int32()), ("negated", pa.bool_()), ("folders", pa.bool_()), ("pattern", pa.string())])


def _literal(c: str) -> str:
    return c if not c.isascii() or c.isalnum() or c == "/" else "\\" + c


def _set_pattern(body: str) -> str:
    """A class: its ranges and characters, all else literal. A range that runs backwards holds nothing."""
    negated = body[0] in "!^"
    chars = re.findall(r"\\.|.", body[negated:], re.S)
    chars, items, at = [c[-1] for c in chars], [], 0
    while at < len(chars):
        if at + 2 < len(chars) and chars[at + 1] == "-":
            if chars[at] <= chars[at + 2]:
                items.append(f"{_literal(chars[at])}-{_literal(chars[at + 2])}")
            at += 3
        else:
            items.append(_literal(chars[at]))
            at += 1
    if not items:
        return "[^/]" if negated else "(?!)"
    return f"(?!/)[{'^' * negated}{''.join(items)}]"


def glob_pattern(glob: str) -> str:
    """A JVM pattern for whole relative paths."""
    anchored = "/" in glob
    rest, out = glob.removeprefix("/"), "" if anchored else "(?:.*/)?"
    token = re.compile(r"(?P<any>\*\*/)|(?P<tail>/\*\*\Z)|(?P<between>/\*\*(?=/))|(?P<star>\*+)|(?P<one>\?)|\[(?P<set>[!^]?(?:\]|[^\]/])[^\]/]*)\]|\\(?P<literal>.)|(?P<plain>.)", re.S)
    at = 0
    while at < len(rest):
        m = token.match(rest, at)
        kind = m.lastgroup if m else "plain"
        if m is None:  # a lone backslash at the end
            m, kind = re.compile(".", re.S).match(rest, at), "plain"
        if kind == "any" and at and rest[at - 1] != "/":
            out += "[^/]*/"  # not a component of its own
        else:
            plain = m[0] if kind == "plain" else m[kind]
            out += {"any": "(?:.*/)?", "tail": "/.+", "between": "(?:/.*)?", "star": "[^/]*", "one": "[^/]"}.get(kind) or (_set_pattern(plain) if kind == "set" else _literal(plain))
        at = m.end()
    return rf"(?s)\A{out}\z"


@lru_cache(maxsize=65_536)
def compile_line(line: str) -> tuple[bool, bool, str] | None:
    """(negated, folders alone, pattern) of a trimmed line, None if it says nothing."""
    negated = line.startswith("!")
    glob = line[negated:]
    folders = glob.endswith("/")
    glob = glob.rstrip("/") if folders else glob
    return None if not glob or line.startswith("#") else (negated, folders, glob_pattern(glob))


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(root, n, *made) for root, n, line in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (made := compile_line(line or ""))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_RULES), _RULES, strict=True)], schema=_RULES)


def compiled(ignore_lines: DataFrame) -> DataFrame:
    """(root, line_no, negated, folders, pattern) of (root, line_no, line), one row per line that says something."""
    lines = ignore_lines.select("root", F.col("line_no").cast("int").alias("line_no"), text.strip(F.col("line")).alias("line"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).mapInArrow(_compile, "root string, line_no int, negated boolean, folders boolean, pattern string")


def matches(path: str, is_folder: Column) -> Column:
    """Whether the rule in a row says something of the path in column ``path``."""
    return (~F.col("folders") | is_folder) & F.expr(f"{path} RLIKE pattern")


def relative(root: Column, path: Column) -> Column:
    """The path below its root."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def ignored_paths(files: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """(root, path), each once, of the files (root, path) that their root's rules ignore.

    Lines of roots without files are left out before they are compiled, if the files' roots are few. Rules go to the files if
    they were measured to be few, else both meet by root, spread by path, so a root with most files is many tasks' work. Two
    aggregates decide, each combined before it is shuffled.
    """
    parts = F.split(relative(F.col("root"), F.col("path")), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.select("root", "path", F.size(parts).alias("depth"), F.posexplode(levels).alias("level", "name"))
    met = sized_join(each, compiled(known_only(ignore_lines, files, ["root"])), ["root"], F.col("path"))
    said = met.filter(matches("name", F.col("level") < F.col("depth") - 1))
    decided = said.groupBy("root", "path", "level").agg(F.max_by("negated", "line_no").alias("negated"))
    return decided.filter(~F.col("negated")).select("root", "path").distinct()


def with_ignored(files: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """The files with ``ignored``; a root without rules ignores nothing."""
    found = ignored_paths(files, ignore_lines).withColumn("ignored", F.lit(True))
    return files.join(found, ["root", "path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
