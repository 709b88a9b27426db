"""Tables that streams write: one folder of rows per micro-batch, overwritten when a batch is replayed.

What a table holds is its rows folded by a rule: the latest row of a key, all rows a page's latest version wrote, or sums.
A fold of folded rows gives the same, so now and then the folded rows are written as a snapshot, and a read takes the last
snapshot and the batches after it. A batch only ever sees what batches before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators.tables import row_digest

#: Takes and gives rows with the number of their batch in column `batch`.
Fold = Callable[[DataFrame], DataFrame]
#: Batches between two snapshots.
SNAPSHOT_EVERY = 16


def write_batch(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{table}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str, table: str) -> DataFrame:
    """All batches of a table with their number in column `batch`."""
    return spark.read.parquet(f"{out.rstrip('/')}/{table}")


# ---- folds --------------------------------------------------------------------------------

def latest(keys: list[str], order: list[str] | None = None) -> Fold:
    """The row the latest batch wrote for each key; within a batch the last by `order`, then by content."""
    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        last = F.max_by(F.struct("batch", *rest), F.struct("batch", *(order or []), row_digest(rest)))
        return rows.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")
    return fold


def folded(keys: list[str], **values: Callable[[str], Column]) -> Fold:
    """One row per key, with an aggregate of each value that may be taken of its own results: a sum, a least, a greatest."""
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in values.items()], F.max("batch").alias("batch"))
    return fold


def of_version(key: str, versions: DataFrame, versions_key: str = "url") -> Fold:
    """All rows of a page from the batch that wrote the page last, as `versions` (url, batch) says.

    A page that no longer has any rows (links, items) writes none; rows of its earlier versions do not come back.
    """
    current = versions.select(F.col(versions_key).alias(key), "batch")
    return lambda rows: rows.join(current, [key, "batch"], "left_semi")


# ---- reading and snapshots ----------------------------------------------------------------

def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the complete folders `name=<number>` in `folder`."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found
                  if p.getName().startswith(f"{name}=") and files.exists(fs.Path(p, "_SUCCESS")))


def _snapshots(out: str, table: str) -> str:
    return f"{out.rstrip('/')}/_snapshots/{table}"


def rows_upto(spark: SparkSession, out: str, table: str, batch_id: int | None = None, snapshots_below: int | None = None) -> DataFrame | None:
    """The last snapshot and the batches after it, up to `batch_id` (default all); None if nothing was written."""
    def within(n: int, bound: int | None) -> bool:
        return bound is None or n <= bound

    snapshots, folder = _snapshots(out, table), f"{out.rstrip('/')}/{table}"
    least = None if snapshots_below is None else snapshots_below - 1
    base = max((n for n in _numbers(spark, snapshots, "upto") if within(n, batch_id) and within(n, least)), default=-1)
    parts = [spark.read.parquet(f"{snapshots}/upto={base}")] if base >= 0 else []
    fresh = [f"{folder}/batch={n}" for n in _numbers(spark, folder, "batch") if n > base and within(n, batch_id)]
    if fresh:
        parts.append(spark.read.option("basePath", folder).parquet(*fresh))
    return reduce(DataFrame.unionByName, parts) if parts else None


def merged(spark: SparkSession, out: str, table: str, fold: Fold, batch_id: int | None = None, schema: str | None = None) -> DataFrame:
    """What a table holds after a batch (default the last), with the batch that wrote each row in column `batch`.

    `schema` is that of an empty result, where no batch may have been written yet.
    """
    rows = rows_upto(spark, out, table, batch_id)
    if rows is None:
        if schema is None:
            raise FileNotFoundError(f"{out}: no batch of {table}")
        return spark.createDataFrame([], f"{schema}, batch int")
    return fold(rows)


def write_snapshot(spark: SparkSession, out: str, table: str, fold: Fold, batch_id: int) -> None:
    """Write what a table holds after a batch. A replayed batch writes its snapshot anew, from the snapshots before."""
    rows = rows_upto(spark, out, table, batch_id, snapshots_below=batch_id)
    if rows is not None:
        fold(rows).write.mode("overwrite").parquet(f"{_snapshots(out, table)}/upto={batch_id}")


def snapshot_due(batch_id: int, every: int) -> bool:
    return every > 0 and (batch_id + 1) % every == 0
