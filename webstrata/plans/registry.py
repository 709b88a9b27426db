"""All views by name, and their registration as temporary views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webstrata.plans.legacy import LEGACY_VIEWS
from webstrata.plans.views import VIEWS, Tables

ALL_VIEWS = {**VIEWS, **LEGACY_VIEWS}


def build_views(tables: Tables, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Frames of the named views, by default of all whose tables are there."""
    built = {}
    for name, view in ALL_VIEWS.items():
        if names is None or name in names:
            try:
                built[name] = view(tables)
            except KeyError as missing:
                if names is not None:
                    raise ValueError(f"{name} needs table {missing}") from missing
    return built


def register_views(tables: Tables, names: list[str] | None = None) -> list[str]:
    """Create or replace a temporary view per analysis view; SQL can then use them by name."""
    built = build_views(tables, names)
    for name, df in built.items():
        df.createOrReplaceTempView(name)
    return sorted(built)
