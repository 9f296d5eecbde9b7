"""Sinks: predictions by model, JSON lines, per-document records, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORT_ROWS = 1 << 19   # rows that a task sorts for one file, more or less
MOST_FILES = 100_000  # that part numbers of equal width can name


def _ordered(df: DataFrame, *order_by: str | None, files: int | None = None) -> DataFrame:
    """Rows ranged and sorted by the columns: reading the files in name order gives them in order, at any number of files (up
    to MOST_FILES). Equal keys stay in one file. ``files`` is the number wanted; large tables get more, as a task
    sorts one file's rows: their number follows the rows, not the other way round."""
    keys = [c for c in order_by if c]
    if not keys:
        return df
    if files:
        files = max(files, min(MOST_FILES, -(-df.count() // SORT_ROWS)))
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite", order_by: str | None = None,
                      files: int | None = None) -> None:
    """Predictions partitioned by ``model``: evaluating one model prunes the others. Overwriting
    replaces the models that ``df`` holds and leaves the others. With ``order_by``, each model's files are in order."""
    (_ordered(df, "model" if order_by else None, order_by, files=files).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", order_by: str | None = None, files: int | None = None) -> None:
    """JSON lines with explicit nulls."""
    _ordered(df, order_by, files=files).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Per-document results appended as they finish; one dataset keyed by id instead of tiny files."""
    df.write.mode("append").partitionBy("model").parquet(path)


def write_metric_table(df: DataFrame, path: str, decimals: int = 2) -> None:
    """Metric table as CSV, accuracy columns formatted with a fixed number of decimals."""
    out = df.select(*[F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if t == "double" else F.col(c)
                      for c, t in df.dtypes])
    out.repartition(1).write.mode("overwrite").option("header", True).csv(path)
