"""CSV exports of views and query results. Every export is a folder of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def select_view(df: DataFrame, columns: list[str] | None = None, where: Column | str | None = None,
                limit: int | None = None) -> DataFrame:
    """Chosen columns (unknown names are ignored), matching rows, optionally the first `limit`."""
    out = df if where is None else df.where(where)
    known = [c for c in columns or [] if c in df.columns]
    out = out.select(*known) if known else out
    return out if limit is None else out.limit(limit)


def export_df(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_view(df: DataFrame, path: str, columns: list[str] | None = None, where: Column | str | None = None,
                limit: int | None = None) -> None:
    export_df(select_view(df, columns, where, limit), path)


def export_all_views(views: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One CSV folder per view; returns the paths written."""
    paths = []
    for name, df in sorted(views.items()):
        flat = df.select(*[df[c].cast("string").alias(c) if t.startswith(("array", "struct", "map")) else df[c]
                           for c, t in df.dtypes])
        paths.append(f"{out_dir.rstrip('/')}/{name}")
        export_df(flat, paths[-1])
    return paths
