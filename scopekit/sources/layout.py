"""Tables bucketed by id: prompts, records, responses and truth that are joined again and again on one key.

A bucketed table is shuffled and sorted once, when it is written; every later join or grouping on its key reads matching
buckets side by side, without an exchange. Tables of one ``buckets`` number and key type fit each other. A bucket is read by
one task, so their number follows the size (``buckets_for``); a key that holds a large share of all rows makes its bucket
large, and such a table is better joined unbucketed, where adaptive execution splits it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from scopekit.session import shared_dir

BUCKET_BYTES = 256 << 20
BUCKET_ROWS = 1 << 20  # rows that a task sorts for one bucket, more or less


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that a table that has grown can be bucketed anew to a multiple that still fits the old ones."""
    wanted, buckets = max(1, -(-total_bytes // bucket_bytes)), 1
    while buckets < wanted:
        buckets *= 2
    return buckets


def buckets_for_rows(rows: int, least: int = 1) -> int:
    """``least``, doubled until a bucket holds no more than BUCKET_ROWS rows (of evenly spread keys)."""
    buckets = least
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    return buckets


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> str:
    """Write a table bucketed and sorted by ``key`` to ``path`` (a shared folder by default); returns the catalog name under which
    the session knows it."""
    spark = df.sparkSession
    table = re.sub(r"\W", "_", name) + "_" + uuid.uuid4().hex[:12]
    # one task for each bucket, so a bucket is one sorted file
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path or shared_dir(spark, table)).saveAsTable(table))
    return table


def register_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> str:
    """Make a bucketed folder that another session wrote known to this one."""
    table = re.sub(r"\W", "_", name) + "_" + uuid.uuid4().hex[:12]
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path}'")
    return table
