"""Quality rules: a table of thresholds compiled into one projection, built-in functions only.

Every rule is a row of ``RULES``: a name, a ratio of two counted features and
the bounds it must keep. ``features`` counts all of them in one expression,
``apply_rules`` turns the table into one projection that says which rules a
text breaks. There is no shuffle and no user function; a text is scored where
its row lies, so a hot source or a large group of copies costs what its rows cost.

Defined cases: a NULL text has no words; an empty text breaks the word
minimum. Repeated rows are scored alike. Other columns stay as they are;
a column of the input that has the name of a feature is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.expressions import SPACE_CLASS, count_chars, let, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were which with "
    "das den der des die ein eine für im ist mit nicht sich und von zu auf als "
    "au dans des du est et la le les pour que qui un une "
    "con de del el en es las los para por se su y"
).split()

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Windows of so many words count as repeated when they occur again in the text.
REPEAT_WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; an empty bottom counts as 1."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None


#: The first two are the base rules; bounds of ratios follow published web-text filters, widened so that
#: prose in any of the four languages keeps clear of them.
RULES = (
    Rule("words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.06),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("capitals", "n_capitals", "word_chars", high=0.4),
    Rule("exclamations", "n_exclamations", "n_words", high=0.1),
)
BASE_RULES = ("words", "repeated_words")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more; linear but for one sort."""
    n = REPEAT_WINDOW

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(again(s), count))

    def again(s: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(s, j - 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def count(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(n)), F.lit(n)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def judged(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(words) >= n, let(words, judged)).otherwise(F.lit(0)).cast("long")


FEATURES = (
    "n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "n_symbols", "n_capitals",
    "n_exclamations",
)


def features(text: Column) -> Column:
    """All features of a text as one struct of longs."""
    body = F.coalesce(text, F.lit(""))
    lines = let(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")),
    )
    words = let(words_of(body), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"),
    ))
    return let(words, lambda w: let(lines, lambda x: F.struct(*[value.cast("long").alias(name) for name, value in zip(FEATURES, (
        w["n_words"], w["word_chars"], w["n_repeat_words"], w["n_stop_words"], x["all"], x["all"] - x["distinct"],
        count_chars(body, SYMBOLS), count_chars(body, "A-Z"), count_chars(body, "!"),
    ), strict=True)])))


def broken(rule: Rule, of: Column) -> Column:
    """The rule as a condition on a struct of features that is true where it is broken."""
    value = of[rule.top]
    if rule.bottom:
        value = value / F.greatest(of[rule.bottom], F.lit(1))
    return ((value < rule.low) if rule.low is not None else F.lit(False)) | (
        (value > rule.high) if rule.high is not None else F.lit(False)
    )


def any_broken(rules: Sequence[Rule], of: Column) -> Column:
    return reduce(lambda a, b: a | b, [broken(r, of) for r in rules], F.lit(False))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add the features, ``base_failed``, ``failed_rules array<string>`` and ``kept``."""
    judged = let(features(F.col(text)), lambda m: F.struct(
        *[m[name].alias(name) for name in FEATURES],
        any_broken([r for r in rules if r.name in BASE_RULES], m).alias("base_failed"),
        F.filter(F.array(*[F.when(broken(r, m), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()).alias("failed_rules"),
        (~any_broken(rules, m)).alias("kept"),
    ))
    names = (*FEATURES, "base_failed", "failed_rules", "kept")
    return docs.withColumn("_judged", judged).withColumns({n: F.col("_judged")[n] for n in names}).drop("_judged")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that keep every rule, as they are.

    The condition holds the features once: Spark evaluates what stands in a
    filter as often as it is written.
    """
    return docs.filter(let(features(F.col("text")), lambda m: ~any_broken(RULES, m)))
