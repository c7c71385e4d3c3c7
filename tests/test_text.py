import random
import textwrap

from pyspark.sql import functions as F

from auditlake.functions import text

ALPHABET = ["a", "bc", "é", "-", "--", " ", "  ", "\n", "\t", " ", " ", "\x1c", "x1", "word", "two-factor", "a-b-cd", ".", "_", "İ", "K", "ſ"]


def samples(n=400, longest=60):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t")).alias("r")).orderBy("i").collect()]


def test_shorten_agrees_with_the_standard_library(spark):
    words = ["alpha", "beta-gamma", "delta", "x", "multi-part-name", "end.", "3-4", "a-b", "dash--dash", "(para)"]
    rng = random.Random(7)
    values = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(400)] + samples()
    assert column(spark, values, text.shorten) == [textwrap.shorten(v, width=120) for v in values]


def test_lines_agree_with_splitlines(spark):
    values = [*samples(), "", "\n", "a\r\nb\rc\x0bd\x0ce", "a\n\n", "\r\n\r\n", "x\u0085y"]
    counts = column(spark, values, text.line_count)
    assert counts == [len(v.splitlines()) for v in values]
    lines = column(spark, [v for v in values if v], text.lines_of)
    assert lines == [v.splitlines() for v in values if v]


def test_words_agree_with_split(spark):
    values = samples()
    ours = column(spark, values, text.words)
    plain = [v for v in values if "İ" not in v]  # one character becomes two in either engine, differently ordered
    assert [sorted(o) for o, v in zip(ours, values) if v in plain] == [sorted(set(v.lower().split())) for v in plain]


def test_strip_and_fold(spark):
    values = ["\x1f a  ", "İKſı ÀB"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values[1:], text.fold) == ["iksi àb"]


def test_regex_spells_classes_out():
    assert r"\p{L}" in text.regex(r"\w") and r"\s" not in text.regex(r"a\s*b")
    assert text.regex(r"\b(a|b)").startswith(r"(?d)(?<![")
    assert "(?<![" in text.regex(r"\b(a|\.)") and "(?=[" in text.regex(r"\b(a|\.)")
