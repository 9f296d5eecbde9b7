"""Shared helpers of the corpus operators: table access, shared scratch tables, Arrow batches.

Row rules that hold for every operator unless its docstring says otherwise: a
null text is an empty text, a null id is kept as null and never equals or
precedes another id, repeated rows are separate rows that all get a result,
empty tables give empty results, and columns an operator does not name are
ignored (filters keep them).
"""

from __future__ import annotations

import sys
import types
from typing import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit.operators.batch import ship_by_value
from scopekit.session import shared_dir

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    ship_by_value()
    return df.mapInArrow(fn, schema)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker (functions are shipped by value, so their
    module globals are not shared between tasks). It only holds caches that can be rebuilt."""
    store = sys.modules.setdefault("_scopekit_worker_state", types.ModuleType("_scopekit_worker_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def text_bytes(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about max_bytes of text (always whole rows, at least one)."""
    sizes = [n or 0 for n in pa.compute.binary_length(batch.column(text_col)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that an operator's own columns clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
