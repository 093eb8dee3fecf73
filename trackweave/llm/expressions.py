"""Small column helpers shared by the operators that run on built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the white space that separates words (space, tab to carriage return).
SPACE_CLASS = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column named inside a lambda may be inlined by the optimizer and then be
    evaluated once per element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs without white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def count_chars(text: Column, char_class: str) -> Column:
    """How many code points of ``text`` belong to a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))).cast("long")


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``step`` over an array of long, the first element as it is.

    An array grows by copying, so this goes in blocks of about the root of the
    size: about n times the root of n numbers are copied, not n times n.
    """
    none = F.array().cast("array<bigint>")

    def grown(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.concat(
            acc, F.array(F.coalesce(step(F.get(acc, F.size(acc) - 1), x), x))
        ))

    def carried(parts: Column) -> Column:
        totals = grown(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda p, b: F.when(b == 0, p).otherwise(
            F.transform(p, lambda x: step(F.get(t, b - 1), x))
        ))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.transform(blocks(v), grown), carried)).otherwise(none))


def blocks(values: Column) -> Column:
    """A filled array cut into blocks of about the root of its size."""
    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    return let(width, lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / w).cast("int")), lambda b: F.slice(values, b * w + 1, w)
    ))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start long, end long, match string>>.

    Positions are code points, end exclusive. The pieces between the matches
    and the matches themselves add up to the text, so that a running sum of
    their lengths gives the positions.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column, pieces: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return F.zip_with(running(sizes, lambda a, x: a + x), found, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")
        ))

    return let(found, lambda m: let(pieces, lambda p: spans(m, p)))


def covers(spans: Column) -> Column:
    """The maximal runs of overlapping spans (sorted by start), as array<struct<start, end>>; touching ones stay apart."""
    def runs(s: Column, ends: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (x["start"] >= F.get(ends, i - 1)))
        last = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | (F.get(s, i + 1)["start"] >= e))
        return F.zip_with(first, last, lambda x, e: F.struct(x["start"].alias("start"), e.alias("end")))

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    return let(spans, lambda s: let(ends(s), lambda e: runs(s, e)))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each of some sorted spans that do not overlap replaced by ``by(span)``.

    A substring is found by walking from the start of its string, so the text is
    first cut into a stretch per block of spans.
    """
    def part(string: Column, start: Column, end: Column) -> Column:
        return F.substring(string, (start + 1).cast("int"), (end - start).cast("int"))

    def stretch(block: Column, before: Column) -> Column:
        whole = part(text, before, F.get(block, F.size(block) - 1)["end"])
        return let(whole, lambda own: F.array_join(F.transform(block, lambda x, i: F.concat(
            part(own, F.when(i == 0, 0).otherwise(F.get(block, i - 1)["end"] - before), x["start"] - before), by(x)
        )), ""))

    def end_of(block: Column) -> Column:
        return F.get(block, F.size(block) - 1)["end"]

    def whole(every: Column) -> Column:
        done = F.transform(every, lambda block, b: let(
            F.when(b == 0, F.lit(0).cast("long")).otherwise(end_of(F.get(every, b - 1))), lambda before: stretch(block, before)
        ))
        tail = part(text, end_of(F.get(every, F.size(every) - 1)), F.length(text).cast("long"))
        return F.concat(F.array_join(done, ""), tail)

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(blocks(s), whole))).otherwise(text)
