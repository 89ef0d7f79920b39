"""Document quality from a table of thresholds, compiled into one projection of built-in functions.

Measures are counts of one text: words, characters in words, symbols, exclamation marks, stop words, lines
and words in repeated five-word windows. A rule bounds the ratio of two measures; all ratios are compared as
whole numbers, so Spark and SQL agree exactly. Every measure is evaluated once per row: a value that several
expressions need is bound as a lambda variable of a one-element array.

Defined results: a null text counts as empty, has no words and fails; the verdict depends on the text alone,
so repeated rows and ties get equal verdicts; very long texts are measured whole; an empty table stays empty.
Windows and words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Words of a window, and the least number of words and the most repeated words in a hundred of a good document.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

# White space that separates words, symbols, and frequent short words of four languages.
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was", "be",
              "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "ist", "sich", "nicht",
              "le", "la", "les", "des", "et", "un", "une", "du", "en", "que", "qui", "pour", "par", "de",
              "el", "los", "las", "y", "a", "por", "con", "una", "se", "al")


@dataclass(frozen=True)
class Rule:
    """``part / whole`` lies between ``low`` and ``high`` thousandths in documents of ``least_words`` or more."""

    name: str
    part: str
    whole: str
    low: int
    high: int
    least_words: int = 0

    def holds(self, measure: Callable[[str], Column]) -> Column:
        part, whole = 1000 * measure(self.part), measure(self.whole)
        return (measure("n_words") < self.least_words) | ((part >= self.low * whole) & (part <= self.high * whole))

    def sql(self) -> str:
        return (f"(n_words < {self.least_words} OR (1000 * {self.part} >= {self.low} * {self.whole} "
                f"AND 1000 * {self.part} <= {self.high} * {self.whole}))")


#: Wide bounds: a rule rejects what is hardly prose, and leaves unusual prose alone.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols per word", "n_symbols", "n_words", 0, 100),
    Rule("exclamation marks per word", "n_exclamations", "n_words", 0, 500),
    Rule("stop words", "n_stop_words", "n_words", 10, 1_000, least_words=100),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0, 500),
    Rule("bullet lines", "n_bullet_lines", "n_lines", 0, 900),
    Rule("lines ending in an ellipsis", "n_ellipsis_lines", "n_lines", 0, 500),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines",
            "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; hashes are those of the words, in order."""
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), at + WINDOW) - at))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def among(ordered: Column) -> Column:
        same = lambda one, i: F.coalesce(F.get(ordered, i)["hash"] == one["hash"], F.lit(False))
        twice = F.filter(ordered, lambda one, i: F.when(i > 0, same(one, i - 1)).otherwise(False) | same(one, i + 1))
        return bound(F.array_sort(F.transform(twice, lambda one: one["at"])), covered)

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bound(F.array_sort(placed), among))

    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW, 0).otherwise(bound(windows, counted))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    def of_lines(lines: Column) -> dict[str, Column]:
        start = lambda line: F.substring(F.ltrim(line), 1, 1)
        return {
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": F.size(F.filter(lines, lambda line: start(line).isin("-", "•", "*", "‣"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))),
        }

    def of_text(t: Column) -> Column:
        words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda line: F.length(_without(line, " " + SPACES)) > 0)
        by_words = bound(words, lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.size(F.filter(w, lambda one: F.lower(one).isin(*STOP_WORDS))).alias("n_stop_words"),
            bound(F.transform(w, lambda one: F.xxhash64(one)), _repeated).alias("n_repeat_words")))
        by_lines = bound(lines, lambda some: F.struct(*[c.alias(n) for n, c in of_lines(some).items()]))
        by_characters = F.struct(
            F.length(_without(t, " " + SPACES)).alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).alias("n_symbols"),
            (F.length(t) - F.length(_without(t, "!"))).alias("n_exclamations"))
        return F.struct(by_words.alias("words"), by_lines.alias("lines"), by_characters.alias("characters"))

    def flat(found: Column) -> Column:
        place = {n: "words" for n in ("n_words", "n_stop_words", "n_repeat_words")}
        place |= {n: "lines" for n in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
        return F.struct(*[found[place.get(n, "characters")][n].cast("long").alias(n) for n in MEASURES])

    return bound(bound(F.coalesce(text, F.lit("")), of_text), flat)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of all measures, ``base_failed`` and ``kept``."""
    def judged(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
        good = ~failed
        for rule in rules:
            good = good & rule.holds(lambda name: m[name])
        return F.struct(*[m[n].alias(n) for n in MEASURES], failed.alias("base_failed"), good.alias("kept"))

    return bound(measures(text), judged)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its key, all measures, ``base_failed`` and ``kept``."""
    return docs.select(F.col(key), verdict(F.col(text), rules).alias("found")).select(key, "found.*")


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose verdict is good, with all their columns."""
    return docs.where(verdict(F.col(text), rules)["kept"])


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The result of ``judge`` on ``documents`` as DuckDB SQL, without the columns that only rules read."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rule = " AND ".join(r.sql() for r in rules)
    bare = r"regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda line: length({bare}) > 0) AS lines FROM texts),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + {WINDOW}), ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS pos FROM split WHERE len(w) >= {WINDOW})),
repeated AS (SELECT doc_id, pos FROM windows
    WHERE (doc_id, gram) IN (SELECT (doc_id, gram) FROM windows GROUP BY doc_id, gram HAVING count(*) > 1)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n FROM
    (SELECT doc_id, unnest(range(pos, pos + {WINDOW})) AS word FROM repeated) GROUP BY doc_id),
measured AS (SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(lines, lambda x: substring(ltrim(x, ' '), 1, 1) IN ('-', '•', '*', '‣'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines,
    coalesce(c.n, 0) AS n_repeat_words FROM split s LEFT JOIN covered c USING (doc_id)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND {rule} AS kept FROM failed"""
