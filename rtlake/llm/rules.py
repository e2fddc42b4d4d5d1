"""Quality rules as a short-circuit cascade (native).

Every rule says of a text whether it is to be rejected; a document stays if none rejects it, so the order of the rules
never changes the verdict, only the work. On a bounded random sample each rule's cost is measured, as the time that it
takes over that of a job without a rule, and so is what it rejects. Rules are then ordered greedily: next comes the one
that rejects most, for its cost, of the sampled documents that those before it let pass. The order becomes one CASE
expression, whose later branches are not evaluated once one has matched; what fails the base rules meets no other.

Null and empty texts have no words and fail the base rules; null ids, rows that repeat an id and extra columns are
kept as they are, each row judged by its own text. Windows of words are compared by 64 bits of hash within one text.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import WORD, cut, let, release, table

#: Documents that a sample aims at, its seed, and runs of each rule of which the fastest counts.
SAMPLE, SEED, RUNS = 2_000, 12, 2
#: Of the contract: least words of a document, most words in repeated windows in per cent, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(items: Column, holds) -> Column:
    """How many items of an array ``holds`` is true of."""
    return F.size(F.filter(items, holds))


def less(text: Column, pattern: str) -> Column:
    """How many characters of a text match a pattern for one character."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in the text.

    Windows are hashed; where none repeats, nothing else is done. Else they are sorted with their places, those equal to
    a neighbour are kept, and each place covers what the one before it does not.
    """
    null_place = F.lit(None).cast("int")

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(x, j), x["i"]).otherwise(null_place)), lambda i: i.isNotNull()))

        add = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n"))
        return F.aggregate(let(ordered, places), F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n")), add, lambda a: a["n"])

    def of(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))
        return let(F.slice(hashed, F.lit(1), F.size(w) - (window - 1)), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(covered(keys)))

    return F.when(F.size(words) < window, 0).otherwise(let(words, of)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``words``, ``lines`` (those with a word) and the base counts of every row; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = docs.select("doc_id", text.alias("text")).withColumns(
        {"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))}
    )
    return taken.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.regexp_replace("text", BLANKS, "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")),
        }
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A rule by name: the condition that rejects a row of ``counted``."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    """Seconds that a rule takes on the sample, and the sampled rows that it rejects of those that it meets in its place."""

    rule: Rule
    cost: float
    rejected: int = field(default=0)


def default_rules() -> list[Rule]:
    """Rules on counts at hand first, then on characters, lines and words."""
    c, n, lines = F.col, F.col("n_words"), F.size("lines")
    return [
        Rule("symbols", 10 * c("n_symbols") > n),
        Rule("word_length", (c("word_chars") < 3 * n) | (c("word_chars") > 10 * n)),
        Rule("dup_lines", 2 * c("n_dup_lines") > lines),
        Rule("digits", 5 * less(c("text"), "[0-9]") > c("word_chars")),
        Rule("capitals", 10 * less(c("text"), r"\p{Lu}") > 3 * less(c("text"), r"\p{L}")),
        Rule("braces", 20 * less(c("text"), "[{}]") > n),
        Rule("letters", 5 * count_of(c("words"), lambda w: ~w.rlike(r"\p{L}")) > n),
        Rule("long_words", 20 * count_of(c("words"), lambda w: F.length(w) > 40) > n),
        Rule("ellipses", 10 * count_of(c("lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")) > 3 * lines),
        Rule("bullets", 10 * count_of(c("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]")) > 9 * lines),
    ]


def timed(rows: DataFrame, condition: Column, runs: int = RUNS) -> float:
    """Seconds of the fastest of ``runs`` jobs that count where ``condition`` holds."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        rows.agg(F.count_if(condition)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def measure(sample: DataFrame, rules: Sequence[Rule]) -> list[float]:
    """What each rule costs on stored rows of ``counted``: seconds over those of a job without a rule, a hundredth of a second at least."""
    floor = timed(sample, F.length("text") < 0)
    return [max(0.01, timed(sample, r.rejects) - floor) for r in rules]


def ordered(sample: DataFrame, rules: Sequence[Rule], costs: Sequence[float]) -> list[Measured]:
    """Greedily, the rule with most rejections for its cost among the rows that earlier rules let pass; of equals, the earlier given.

    What leaves Spark is one row for each set of rules that reject a sampled document.
    """
    masks = sample.groupBy(F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in rules]).alias("by")).count().collect() if rules else []
    left, out, masks = list(range(len(rules))), [], [(r["by"], r["count"]) for r in masks]
    while left:
        met = {k: sum(n for by, n in masks if by[k]) for k in left}
        best = max(left, key=lambda k: (met[k] / costs[k], -costs[k], -k))
        out.append(Measured(rules[best], costs[best], met[best]))
        left.remove(best)
        masks = [(by, n) for by, n in masks if not by[best]]
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] | None = None, sample: int = SAMPLE) -> list[Measured]:
    """The order of the rules for ``docs``, from a random sample of about ``sample`` rows that pass the base rules.

    The sample's size, and so what is stored for it and what leaves Spark, does not grow with the table.
    """
    rules, rows = default_rules() if rules is None else list(rules), docs.count()
    stored = cut(counted(docs.select("doc_id", "text").sample(min(1.0, sample / max(rows, 1)), SEED)).filter(~F.col("base_failed")))
    try:
        return ordered(stored, rules, measure(stored, rules))
    finally:
        release(stored)


def verdict(cascade: Sequence[Measured]) -> Column:
    """Whether a row of ``counted`` stays: false from the first rule on that rejects it, later ones then not being evaluated."""
    out = F.when(F.col("base_failed"), False)
    for m in cascade:
        out = out.when(m.rule.rejects, False)
    return out.otherwise(True)


def judged(docs: DataFrame, cascade: Sequence[Measured] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    cascade = plan(docs) if cascade is None else cascade
    return counted(docs).withColumn("kept", verdict(cascade)).select("doc_id", *BASE, "base_failed", "kept")


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every row of ``documents``."""
    return judged(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM p),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
b AS (SELECT w.*, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, len(lines) AS n_lines,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > n_lines
            OR 5 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > word_chars
            OR 10 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > 3 * (length(text) - length(regexp_replace(text, '\p{L}', '', 'g')))
            OR 20 * (length(text) - length(regexp_replace(text, '[{}]', '', 'g'))) > n_words
            OR 5 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words
            OR 20 * len(list_filter(words, lambda x: length(x) > 40)) > n_words
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) > 9 * n_lines) AS kept
FROM f
"""
