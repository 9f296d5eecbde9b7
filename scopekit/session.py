"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "scopekit") -> SparkSession:
    """A session with the settings the engine relies on.

    UTC session time, ANSI on (Spark 4 default), adaptive execution with
    partition coalescing and skew-join splitting, no UI server.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a skewed join partition even when the aggregation after it then needs its own
        # shuffle (e.g. one document holding a large share of all pages before per-document assembly)
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("SCOPEKIT_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no context
        return None


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", None) or 8)


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that stand for much work each (files, blocks): a given number of partitions, which adaptive execution
    doesn't coalesce by the rows' few bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or a checkpoint dir set on
    the context). When neither is set, a private temporary folder is created and
    registered as checkpoint dir in local mode; on a cluster it is an error, as
    each executor would write to its own disk.
    """
    sc = _context(spark)
    base = sc.getCheckpointDir() if sc is not None else None
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^]]*\])?", master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="scopekit-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir() or base
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
