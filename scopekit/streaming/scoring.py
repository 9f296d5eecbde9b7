"""Incremental extraction over a directory of documents.

The streaming counterpart of the batch loop with resume: a file-source stream
remembers which document files it has processed (its checkpoint), so a rerun
only scores documents that arrived since. Each micro-batch runs the same
operators as the batch path (pages, budget, assembly, prompts, scoring,
validation) and writes its records with overwrite to a directory keyed by run
name, checkpoint and batch id, so a replayed batch replaces its earlier attempt
and other runs are never touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.paths import file_stem_of_metadata
from scopekit.operators import batch as B
from scopekit.operators import pages as P
from scopekit.operators import prompts as PR
from scopekit.sources.pages import check_mode, split_pages
from scopekit.streaming.collector import batch_dir, default_checkpoint, read_collected  # noqa: F401

PAGE_BREAK = "\f"  # page separator of plain-text renderings of paged documents


def document_stream(spark: SparkSession, documents_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (doc_id, text): one row per document file, id = file stem."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(documents_dir)
    return df.select(file_stem_of_metadata().alias("doc_id"), F.col("value").alias("text"))


def _batch_writer(output_dir: str, run_name: str, scorer: B.Scorer, mode: str, separator: str,
                  max_tokens: int, marker: str, checkpoint: str, written: dict,
                  instruction: str, chat: str):
    def write(docs: DataFrame, batch_id: int) -> None:
        units = P.page_units(split_pages(docs, separator=separator), mode)
        status = P.assemble_with_status(units, P.budget_chars(max_tokens))
        prompts = PR.build_prompts(docs.select("doc_id"), status, instruction=instruction, family=F.lit(chat))
        records = B.batch_records(prompts, scorer, marker, id_type="string")
        out = records.select(F.lit(run_name).alias("model"), F.col("doc_id").alias("id"), "status",
                             *FV.SCOPE_KEYS, "sources", F.lit(batch_id).cast("bigint").alias("batch"))
        path = batch_dir(output_dir, run_name, checkpoint, batch_id)
        out.write.mode("overwrite").parquet(path)
        written[batch_id] = docs.sparkSession.read.parquet(path).count()  # runs on the driver
    return write


def extract_incrementally(spark: SparkSession, documents_dir: str, output_dir: str, run_name: str,
                          scorer: B.Scorer, checkpoint_dir: str | None = None, mode: str = "xhtml",
                          separator: str = PAGE_BREAK, max_tokens: int = FV.DEFAULT_MAX_TOKENS,
                          marker: str = FV.EOS_MARKER, max_files_per_trigger: int | None = None,
                          instruction: str = FV.INSTRUCTION, chat: str = "mistral") -> int:
    """Score every document file not processed yet, then stop (``availableNow``).

    Returns the number of documents scored in this call (records written).
    """
    check_mode(mode)
    ckpt = checkpoint_dir or default_checkpoint(output_dir, run_name, documents_dir)
    written: dict[int, int] = {}
    q = (document_stream(spark, documents_dir, max_files_per_trigger).writeStream
         .foreachBatch(_batch_writer(output_dir, run_name, scorer, mode, separator, max_tokens, marker, ckpt, written, instruction, chat))
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return sum(written.values())
