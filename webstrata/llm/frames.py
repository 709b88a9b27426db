"""Column and frame helpers shared by the operators of this package."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def name(column: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as one struct, so that working columns beside it cannot clash with its names."""
    return F.struct(*[name(c) for c in (df.columns if columns is None else columns)])


def with_results(df: DataFrame, row: str, results: dict[str, Column]) -> DataFrame:
    """The fields of the struct `row` and the results; a field named like a result gives way to it."""
    fields = df.schema[row].dataType.names
    return df.select(*[F.col(row)[f].alias(f) for f in fields if f not in results],
                     *[value.alias(key) for key, value in results.items()])


def text_key(text: Column) -> Column:
    """What tells texts apart: the SHA-256 of the text as it is, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
