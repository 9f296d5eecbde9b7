"""Incremental collection of per-document model outputs.

Outputs arrive as one file per document (file stem = document id) in a run's
output directory. A file-source stream picks up only files it has not seen
(the checkpoint remembers them), validates each output strictly, turns
failures into the stub record, clips values and appends the batch to the
prediction table. Every micro-batch is written with overwrite to a directory of
its own, keyed by model, run (the checkpoint) and batch id: a replayed batch
replaces its earlier attempt, and other models and runs are never touched. The
default checkpoint lies beside the table, so a second call resumes.
"""

from __future__ import annotations

from hashlib import md5
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.paths import file_stem_of_metadata
from scopekit.operators.outputs import clip_records, records_or_stub


def output_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (id, response): whole files of the output directory."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(source_dir)
    return df.select(file_stem_of_metadata().alias("id"), F.col("value").alias("response"))


def default_checkpoint(table_dir: str, model: str, source_dir: str) -> str:
    """Beside the table's data, one for each model and source (readers skip names with an underscore)."""
    return f"{table_dir.rstrip('/')}/_checkpoints/{quote(model, safe='')}-{md5(source_dir.encode()).hexdigest()[:12]}"


def batch_dir(table_dir: str, model: str, checkpoint: str, batch_id: int) -> str:
    run = md5(checkpoint.encode()).hexdigest()[:12]
    return f"{table_dir.rstrip('/')}/m-{quote(model, safe='')}/run-{run}/batch-{batch_id}"


def _batch_writer(table_dir: str, model: str, marker: str, checkpoint: str, written: dict):
    def write(batch: DataFrame, batch_id: int) -> None:
        recs = clip_records(records_or_stub(batch, "response", marker))
        out = recs.select(F.lit(model).alias("model"), "id", "status", *FV.SCOPE_KEYS, "sources",
                          F.lit(batch_id).cast("bigint").alias("batch"))
        path = batch_dir(table_dir, model, checkpoint, batch_id)
        out.write.mode("overwrite").parquet(path)
        written[batch_id] = batch.sparkSession.read.parquet(path).count()  # runs on the driver
    return write


def collect_outputs_incrementally(spark: SparkSession, source_dir: str, table_dir: str, model: str,
                                  checkpoint_dir: str | None = None, marker: str = FV.EOS_MARKER,
                                  max_files_per_trigger: int | None = None) -> int:
    """Process every output file not yet collected, then stop (``availableNow``).

    Returns the number of micro-batches that read new files. Rerunning with
    the same checkpoint collects only new files.
    """
    ckpt = checkpoint_dir or default_checkpoint(table_dir, model, source_dir)
    written: dict[int, int] = {}
    q = (output_stream(spark, source_dir, max_files_per_trigger).writeStream
         .foreachBatch(_batch_writer(table_dir, model, marker, ckpt, written))
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return sum(1 for n in written.values() if n)


def read_collected(spark: SparkSession, table_dir: str) -> DataFrame:
    """The prediction table: one row per model and id, also where several runs have read the same files
    (the row of the highest batch, of equal ones the greatest)."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(table_dir)
    values = [c for c in rows.columns if c not in ("model", "id", "batch")]
    last = rows.groupBy("model", "id").agg(F.max(F.struct("batch", *values)).alias("r"))
    return last.select("model", "id", *[F.col(f"r.{c}").alias(c) for c in values])
