"""Small Column helpers used across the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as str.strip() and str.split() see it: Unicode spaces plus the four separators.
_BLANK = r"[\s\x1c-\x1f]"
SPACE = f"(?U){_BLANK}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it several times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose field names hold wherever the expression is used."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """str.strip(): trim every kind of white space at both ends."""
    return F.regexp_replace(col(c), f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def squeeze(c: Column | str) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def word_count(c: Column | str) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(col(c), F.lit(f"(?U)[^{_BLANK[1:-1]}]+")).cast("bigint")


def instant(df: DataFrame, column: str) -> Column:
    """A time column as an instant. Times without a zone count as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")
    return F.col(column).cast("timestamp")
