"""Column expressions for text, tolerant casts and defaults. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(col: Column) -> Column:
    """Strip Unicode white space at both ends.

    A character set instead of a regular expression: linear in the text, with
    no backtracking over long inner runs of blanks.
    """
    return F.btrim(col, F.lit(UNICODE_SPACE))


def text_or(col: Column, default: str | Column) -> Column:
    """``col``, or ``default`` where it is NULL or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col, F.lit("")), fallback)


def has_text(col: Column) -> Column:
    """Not NULL and longer than zero, tested on the untrimmed text."""
    return col.isNotNull() & (F.length(col) > 0)


def not_blank(col: Column) -> Column:
    """Something is left after stripping. NULL counts as blank."""
    return F.coalesce(F.length(strip_text(col)) > 0, F.lit(False))


def mentions(col: Column, word: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(col).contains(word.lower())


def remote_flag(location: Column, word: str = "remote") -> Column:
    """True where the location is missing or mentions ``word``; never NULL."""
    return location.isNull() | F.coalesce(mentions(location, word), F.lit(False))


def to_number(col: Column) -> Column:
    """Text to double; garbage becomes NULL instead of failing the job."""
    return col.try_cast("double")


def to_time(col: Column) -> Column:
    """ISO text to timestamp; garbage becomes NULL."""
    return F.try_to_timestamp(col)


def split_list(col: Column, separator: str = ",") -> Column:
    """Split on a literal separator, strip each part, drop the empty ones."""
    parts = F.transform(F.split(col, rf"\Q{separator}\E", -1), strip_text)
    return F.filter(parts, lambda part: part != "")


def zip_shortest(names: Column, values: Column) -> Column:
    """Pair two text arrays up to the shorter one.

    Gives ``array<struct<name, value>>``: names stripped, blank names dropped,
    values as double with an empty text read as NULL.
    """
    empty = F.array().cast("array<string>")
    left, right = F.coalesce(names, empty), F.coalesce(values, empty)
    size = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(
        F.slice(left, F.lit(1), size),
        F.slice(right, F.lit(1), size),
        lambda name, value: F.struct(
            strip_text(name).alias("name"),
            to_number(F.nullif(value, F.lit(""))).alias("value"),
        ),
    )
    return F.filter(pairs, lambda pair: F.coalesce(pair["name"], F.lit("")) != "")


def row_json(*cols: str | Column) -> Column:
    """The given columns as one JSON object; NULL fields are written out."""
    return F.to_json(
        F.struct(*cols),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss"},
    )


def json_fields(col: Column, schema: str) -> Column:
    """Parse a JSON object; NULL, empty or malformed text gives all-NULL fields."""
    parsed = F.from_json(F.nullif(col, F.lit("")), schema, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.from_json(F.lit("{}"), schema))


def json_values(col: Column, **fields: tuple[str, str]) -> list[Column]:
    """Typed values of a JSON text, as columns named like the arguments: each a path and a type.

    The text is parsed once, as a variant. Malformed text, a missing path and a
    value that is not of the type are NULL.
    """
    parsed = F.try_parse_json(col)
    return [F.try_variant_get(parsed, path, kind).alias(name) for name, (path, kind) in fields.items()]


def days_before(as_of: Column, days: int | Column) -> Column:
    """``as_of`` minus a number of days."""
    count = days if isinstance(days, Column) else F.lit(days)
    return as_of - F.make_interval(days=count)


def iso_time(col: Column) -> Column:
    """ISO text of a timestamp, microseconds only where there are any."""
    plain = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), plain).otherwise(exact)
