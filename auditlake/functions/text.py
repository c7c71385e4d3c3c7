"""Text columns: one regex dialect for every rule, line splitting, trimming, folding, summaries.

Rules are written in the usual Unicode-aware spelling (``\\w``, ``\\s``, ``\\b`` ...). ``regex`` spells
the classes out, because the JVM reads them as ASCII, and ends ``.`` at a line feed only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters str.isspace() accepts, and the line ends str.splitlines() accepts.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{L}\p{N}_"
_CLASSES = {"s": _SPACE, "w": _WORD, "d": r"\p{Nd}"}
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"

WORD_RUN = rf"[{_WORD}]+"
SPACE_RUN = rf"[{_SPACE}]+"


def _meets_word(rest: str) -> bool:
    """Whether what follows in a pattern is sure to start with a word character."""
    if rest[:1] == "(":
        group = rest[1:rest.find(")")]
        return all(alternative[:1].isalnum() for alternative in group.split("|"))
    return rest[:1].isalnum() or rest[:1] == "_"


def regex(pattern: str) -> str:
    """Spell a rule pattern for the JVM."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif nxt == "b" and not in_class:  # looking to one side is enough before a word character
                out.append(f"(?<![{_WORD}])" if _meets_word(pattern[i + 2:]) else _EDGE)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "(?d)" + "".join(out)


def worked_out(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` plus a column that is computed once per row, however many filters and projections read it.

    Going through a generator keeps the optimizer from copying the expression into each of them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(regex(pattern))


def contains_any(col: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(regex(pattern)), F.lit(group))


# The characters that case-insensitive matching equates to the ASCII letters s, i, i and k.
_FOLD_FROM, _FOLD_TO = "\u017f\u0131\u0130\u212a", "siik"


def fold(col: Column) -> Column:
    """Lower case, with the four characters above replaced.

    A lower-case ASCII pattern on the folded text hits exactly where the case-insensitive pattern hits
    the raw text, and needs no case folding inside the regex.
    """
    return F.lower(F.when(contains_any(col, _FOLD_FROM), F.translate(col, _FOLD_FROM, _FOLD_TO)).otherwise(col))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def squeeze(col: Column) -> Column:
    """Trim, and replace every run of white space by one blank."""
    return F.regexp_replace(strip(col), SPACE_RUN, " ")


def words(col: Column) -> Column:
    """Distinct lower-cased words between white space; punctuation stays attached."""
    parts = F.split(F.lower(strip(col)), SPACE_RUN)
    return F.array_remove(F.array_distinct(parts), "")


def lines_of(content: Column) -> Column:
    """The lines of a text, without the empty one behind a final line break. Use where content <> ''."""
    body = F.regexp_replace(content, rf"(?:{LINE_BREAK})\z", "")
    return F.split(body, LINE_BREAK, -1)


def line_count(content: Column) -> Column:
    return F.when(content == "", F.lit(0)).otherwise(F.size(lines_of(content)))


_LETTER = r"\p{L}"
_JOINED = r"[\p{L}\p{N}_!\"'&.,?]"
# A place where a shortened text may end: before a blank, after the hyphen of a hyphenated word,
# before or after a run of dashes between two words.
_CUT = (
    r"(?:(?= )"
    rf"|(?:(?<={_LETTER}{{2}}-)|(?<={_LETTER}-{_LETTER}-))(?={_LETTER}-?{_LETTER})"
    rf"|(?<={_JOINED})(?=-{{2,}}[{_WORD}])"
    rf"|(?<={_JOINED}-{{2,64}})(?=[{_WORD}]))"
)


def shorten(col: Column, width: int = 120, mark: str = " [...]") -> Column:
    """White space collapsed; a text longer than ``width`` is cut at a word end and marked."""
    flat = squeeze(col)
    keep = rf"\A([^\n]{{0,{width - len(mark) - 1}}}[^ \n]){_CUT}"
    cut = F.ltrim(F.concat(F.regexp_extract(flat, keep, 1), F.lit(mark)))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)
