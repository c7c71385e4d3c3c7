"""Weak supervision over quality rules: each votes or abstains, expectation-maximisation weighs them.

Everything about texts is DataFrame work inside the JVM. One pass makes the measures and votes of each row; only the
numbers are kept. Equal vote patterns are counted, so the model is fitted on at most 3 ** rules counted rows, whatever
the input's size, and the posterior of each pattern is written back as an expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import stored

WINDOW = 8
ROUNDS = 100
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


#: Where the fit starts, and what GOOD and STRENGTH rows hold it to: a bad text breaks some of the rules, a good one hardly any.
#: Probabilities of a vote (bad, none, good) for a bad and for a good text.
START = ((0.4, 0.1, 0.5), (0.02, 0.08, 0.9))
GOOD = 0.85
STRENGTH = 10.0
PLAIN = "^\\p{L}+(?:['\\x{2019}-]\\p{L}+)*[.,;:!?]?\\z"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_plain, n_distinct) per row.

    Words are runs without ASCII white space; a null text has none. Windows are compared by a 64-bit hash of their word
    hashes, and distinct words by theirs. Plain words are letters, joined by - or ' if at all, and one mark at most behind.
    Columns named in ``carry`` follow as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", "")) > 0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words.alias("words"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.when(F.contains(text, F.lit("\n")), F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d"))).otherwise(F.struct(F.lit(1).alias("n"), F.lit(1).alias("d"))).alias("lines"),
        *carry,
    )
    n_plain = F.size(F.filter("words", lambda w: w.rlike(PLAIN))).cast("long")
    rows = rows.withColumn("n_plain", n_plain).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    h = F.col("h")
    windows = F.when(
        F.size(h) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("w", windows)
    w = F.col("w")
    # Equal windows, as (hash, position) pairs in order: only for the few rows that have any, so most sort nothing.
    pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("p", F.when(F.size(F.array_distinct(w)) < F.size(w), pairs))
    p = F.col("p")
    last = F.size(p) - 1
    found = F.filter(p, lambda a, i: ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["x"] == a["x"])) | ((i < last) & (F.get(p, i + 1)["x"] == a["x"])))
    rows = rows.withColumn("r", F.when(p.isNotNull(), F.sort_array(F.transform(found, lambda a: a["i"]))))
    r = F.col("r")
    covered = F.aggregate(F.transform(r, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(r, i + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id", F.size(h).cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"), "n_upper", "n_plain", F.size(F.array_distinct(h)).cast("long").alias("n_distinct"), *carry,
    )


def default_rules() -> list[Rule]:
    """Rules over the columns of ``measures``: far from what running text has votes bad, near it good, between neither."""
    n, c = F.col("n_words"), F.col
    return [
        Rule("symbols", c("n_symbols") * 5 > n, c("n_symbols") * 50 <= n),
        Rule("plain_words", c("n_plain") * 10 < n * 7, c("n_plain") * 10 >= n * 8),
        Rule("word_length", (c("word_chars") > n * 7) | (c("word_chars") * 2 < n * 7), c("word_chars").between(n * 4.4, n * 6.6)),
        Rule("vocabulary", c("n_distinct") * 10 < n * 3, c("n_distinct") * 20 >= n * 9),
        Rule("repeats", c("n_repeat_words") * 4 > n, c("n_repeat_words") * 10 <= n),
        Rule("upper_case", c("n_upper") * 10 > c("word_chars") * 4, c("n_upper") * 10 <= c("word_chars") * 2),
        Rule("duplicate_lines", c("n_dup_lines") * 2 > c("n_lines"), c("n_dup_lines") * 10 <= c("n_lines")),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good rows, and per rule the probability of its votes (bad, abstain, good) under (bad, good)."""

    good: float
    votes: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    def posterior(self, pattern: list[int]) -> float:
        score = math.log(self.good / (1 - self.good))
        for (bad, good), vote in zip(self.votes, pattern):
            score += math.log(good[vote + 1] / bad[vote + 1])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))


def fit(counts: list[tuple[list[int], int]], rules: int, good: float = GOOD, strength: float = STRENGTH, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over counted patterns of votes of so many ``rules``, from START and ``good``.

    ``strength`` pseudo-rows hold it to its start. Without rows the start is returned. Counts are taken in the order of
    patterns, so the result is reproducible.
    """
    start = (START,) * rules
    model = LabelModel(good, start)
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        mass = [strength * (1 - good), strength * good]
        seen = [[[strength * x for x in side] for side in pair] for pair in start]
        for pattern, n in counts:
            p = model.posterior(pattern)
            for side, share in ((0, n * (1 - p)), (1, n * p)):
                mass[side] += share
                for rule, vote in zip(seen, pattern):
                    rule[side][vote + 1] += share
        before = model.good
        model = LabelModel(mass[1] / sum(mass), tuple(tuple(tuple(x / sum(side) for x in side) for side in pair) for pair in seen))
        if abs(model.good - before) < 1e-9:
            break
    return model


def quality(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the measures, the columns in ``carry``, base_failed, the votes as an array, quality (posterior), kept.

    ``kept`` is false where the base rules fail (n_words < 20 or more than 30 % of the words in repeated windows), else
    whether the posterior reaches ``threshold``. Null and empty texts have no words and fail; null and repeated
    ids stay as they are, one row each; an empty table gives no rows; other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    measured = stored(measures(docs, carry))
    votes = F.array(*[F.when(r.bad, -1).when(r.good, 1).otherwise(0) for r in rules])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = measured.withColumn("base_failed", base).withColumn("votes", votes)
    counted = voted.groupBy("votes").count().collect()  # at most 3 ** rules rows
    model = fit([(list(v), n) for v, n in counted], len(rules))
    score = F.lit(math.log(model.good / (1 - model.good)))
    for i, (bad, good) in enumerate(model.votes):
        vote = F.get("votes", F.lit(i))
        score = score + F.when(vote < 0, math.log(good[0] / bad[0])).when(vote > 0, math.log(good[2] / bad[2])).otherwise(math.log(good[1] / bad[1]))
    scored = voted.withColumn("quality", 1 / (1 + F.exp(-score)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
