"""End-to-end jobs: extraction with resume, evaluation to a metric table, training sets.

Each job writes its result, so lineage is cut at the boundaries where work is
expensive to redo (prompts before scoring, records after scoring).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.records import record_json
from scopekit.operators import batch as B
from scopekit.operators import evaluate as E
from scopekit.operators import pages as P
from scopekit.operators import prompts as PR
from scopekit.operators import training as T
from scopekit.sources import document_files as DF
from scopekit.sources import sinks
from scopekit.sources.config import read_chat_instruction, read_instruction


def _stored_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The record table, or None before the first run wrote it."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def build_prompt_table(pages: DataFrame, doc_ids: DataFrame, prompt_dir: str, mode: str = "xhtml",
                       max_tokens: int = FV.DEFAULT_MAX_TOKENS, instruction: str = FV.INSTRUCTION,
                       chat: str = "mistral", done: DataFrame | None = None, template: str | None = None) -> None:
    """Pages -> relevant pages -> budget -> assembly -> prompts, written as the prompt table.

    ``chat`` is the chat family of the prompts (``prompts.chat_family``); the pages of documents in ``done``
    (id) are not read further than their id. ``template`` names a file that holds the instruction."""
    if template:
        instruction = read_instruction(template)
    if done is not None:
        doc_ids = B.pending(doc_ids, done)
        pages = pages.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    units = P.page_units(pages, mode)
    prompts = PR.build_prompts(doc_ids, P.assemble_with_status(units, P.budget_chars(max_tokens)), instruction=instruction,
                               family=F.lit(chat))
    prompts.write.mode("overwrite").parquet(prompt_dir)


def run_extraction(spark: SparkSession, prompt_dir: str, output_dir: str, run_name: str, scorer: B.Scorer,
                   marker: str = FV.EOS_MARKER, slices: int = 1, tasks: int | None = None) -> int:
    """Score every prompt whose document has no stored record for ``run_name``; append the records.

    Each task commits its records in small files as it goes (``document_files``), so whatever dies, all records
    but the last few of each running task are kept, and the next call scores only the rest. ``slices`` parts (by a hash of
    the id) are scored one after the other; ``tasks`` is the number of tasks that score a slice (else Spark's choice by
    bytes, which says nothing about a model's time). Returns the number of documents scored in this call; a
    second call with nothing new scores nothing.
    """
    prompts = spark.read.parquet(prompt_dir)
    id_type = dict(prompts.dtypes)["doc_id"]
    stored = _stored_records(spark, output_dir)
    if stored is not None:
        done = stored.where(F.col("model") == run_name).select(F.col("id").cast(id_type).alias("id"))
        todo = B.pending(prompts, done)
    else:
        todo = prompts
    scored = 0
    for i in range(slices):
        part = todo.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i) if slices > 1 else todo
        if tasks:
            part = part.repartition(tasks, "doc_id")
        seen = Observation()
        records = B.batch_records(part, scorer, marker, id_type).observe(seen, F.count(F.lit(1)).alias("n"))
        DF.append_document_records(records.select(F.lit(run_name).alias("model"), F.col("doc_id").alias("id"),
                                                  "status", *FV.SCOPE_KEYS, "sources"), output_dir)
        scored += seen.get["n"]
    return scored


def evaluate_to_table(spark: SparkSession, predictions: DataFrame, truth: DataFrame, out_dir: str,
                      unmatched_dir: str | None = None, keys=FV.SCOPE_KEYS, which: str = "scope_1",
                      exclude_failed: bool = False) -> DataFrame:
    """Metric table (all modes, average, source accuracy) of ``keys`` written as CSV with two decimals; ``which`` truth pages count
    ('scope_1' or 'any'), and ``exclude_failed`` leaves failed rows out of the source accuracy. The predictions without a
    truth row are never dropped in silence: they are written (model, id) to ``unmatched_dir``, by default next to the table."""
    unmatched = unmatched_dir or out_dir.rstrip("/") + "-unmatched"
    predictions, truth = E.spread_by_id(predictions, truth)
    E.unmatched_predictions(predictions, truth).write.mode("overwrite").parquet(unmatched)
    table = E.metric_table(E.evaluation_counts(predictions, truth, which, keys), keys, exclude_failed=exclude_failed)
    sinks.write_metric_table(table, out_dir)
    return table


def evaluate_directory(spark: SparkSession, pred_dir: str, truth: DataFrame, out_dir: str, unmatched_dir: str | None = None,
                       keys=FV.SCOPE_KEYS, which: str = "scope_1", exclude_failed: bool = False) -> DataFrame:
    """``evaluate_to_table`` over a directory that holds one Parquet file per model."""
    from scopekit.sources.outputs import read_external_predictions
    return evaluate_to_table(spark, read_external_predictions(spark, pred_dir), truth, out_dir, unmatched_dir, keys, which, exclude_failed)


def write_training_set(records: DataFrame, out_dir: str, kind: str = "sft", id_col: str = "id") -> None:
    """(prompt, completion) rows to SFT or DPO JSON lines."""
    if kind == "sft":
        out = T.sft_records(records).select("prompt", "completion")
    elif kind == "dpo":
        out = T.dpo_records(records, F.col(id_col)).select("prompt", "chosen", "rejected")
    else:
        raise ValueError("dataset type must be sft or dpo")
    sinks.write_jsonl(out, out_dir)


def verify_documents(spark: SparkSession, manifest_path: str, store_glob: str) -> DataFrame:
    """Manifest (Parquet: id, url, sha256; other columns are not read) checked against the
    stored document files: (id, url, status) with 'ok', 'conflict', 'missing' or 'unchecked'."""
    from scopekit.operators import manifest as M
    from scopekit.sources.manifest import binary_digests
    manifest = spark.read.parquet(manifest_path).select("id", "url", "sha256")
    return M.verify_manifest(manifest, binary_digests(spark, store_glob))


def collect_output_dir(spark: SparkSession, json_dir: str, model: str, table_path: str) -> None:
    """One output file per document (file stem = id) -> validated, clipped records that replace
    ``model`` in the prediction table; an invalid output is stored as the stub with status 'failed'."""
    from scopekit.operators.outputs import clip_records, records_or_stub
    from scopekit.sources.outputs import read_text_files
    raw = read_text_files(spark, json_dir.rstrip("/") + "/*.json", "response")
    recs = clip_records(records_or_stub(raw, "response", marker=""))
    out = recs.select(F.lit(model).alias("model"), "id", "status", *FV.SCOPE_KEYS, "sources")
    sinks.write_predictions(out, table_path, order_by="id")


def prompt_statistics(spark: SparkSession, prompt_dir: str, approx: bool = False, vocabulary: str | None = None) -> DataFrame:
    """max, min, mean, median token estimate over the cached prompt files (``*.txt``), or exact counts by a tokenizer's file."""
    from scopekit.functions.tokens import exact_token_counts
    from scopekit.sources.outputs import read_text_files
    prompts = read_text_files(spark, prompt_dir.rstrip("/") + "/*.txt", "prompt")
    if vocabulary:
        return PR.prompt_stats(exact_token_counts(prompts, "prompt", vocabulary, special_tokens=True), approx=approx, tokens_col="n_tokens")
    return PR.prompt_stats(prompts, "prompt", approx)


def training_set_from_files(spark: SparkSession, responses_dir: str, prompt_dir: str, pages: DataFrame,
                            out_dir: str, kind: str = "sft", mode: str = "xhtml",
                            wrapper: tuple[str, str] = FV.CHAT_WRAPPERS["mistral"], rebuild: bool = False,
                            instruction: str = FV.INSTRUCTION, template: str | None = None) -> None:
    """Training records from a directory of raw responses (``*.json``, stem = id) or a prediction table
    (``*.parquet``), and a prompt cache (``*.txt``); documents without a cached prompt, or all of
    them with ``rebuild``, get a prompt made from ``pages`` with ``instruction``, or with that of a chat template
    file (``template``: JSON lines, the first one's content)."""
    if template:
        instruction = read_chat_instruction(template)
    from scopekit.sources.outputs import read_text_files
    if responses_dir.rstrip("/").endswith(".parquet"):
        responses = spark.read.parquet(responses_dir).select("id", record_json().alias("response"))
    else:
        responses = read_text_files(spark, responses_dir.rstrip("/") + "/*.json", "response")
    suffix = wrapper[1] + FV.ANSWER_START + "\n"
    cached = None if rebuild else read_text_files(spark, prompt_dir.rstrip("/") + "/*.txt", "text").select(
        "id", T.strip_wrapper("text", wrapper[0], suffix).alias("content"))
    needed = T.prompts_to_rebuild(responses, cached)
    pages = pages.withColumn("id", F.col("doc_id").cast("string")).join(needed, "id", "left_semi").drop("id")
    units = P.page_units(pages, mode)
    within = P.assemble_documents(units)
    rebuilt = within.select(F.col("doc_id").cast("string").alias("id"), "user_message")
    write_training_set(T.training_prompts(responses, cached, rebuilt, instruction), out_dir, kind)


def digest_round(spark: SparkSession, folders: DataFrame, state_dir: str, extension: str = ".pdf") -> DataFrame:
    """One round over a document store: lists the folders (folder), hashes only files that are new or changed since the last
    round, and stores and returns the digests (id, path, length, modified, sha256, hashed), hashed being true for
    those read now. ``state_dir`` keeps one folder per round; digests of vanished files are dropped."""
    from scopekit.operators import manifest as M
    last = _last_round(spark, state_dir)
    listing = DF.list_files(spark, folders, extension)
    if last is None:
        table = DF.file_digests(listing).withColumn("hashed", F.lit(True))
    else:
        same, changed = M.changed_files(listing, spark.read.parquet(f"{state_dir}/round={last}"))
        table = same.withColumn("hashed", F.lit(False)).unionByName(DF.file_digests(changed).withColumn("hashed", F.lit(True)))
    path = f"{state_dir}/round={0 if last is None else last + 1}"
    table.write.parquet(path)
    return spark.read.parquet(path)


def _last_round(spark: SparkSession, state_dir: str) -> int | None:
    """The latest finished round (its folder holds the marker that a finished write leaves)."""
    import re

    from pyarrow import fs
    system, root = DF.file_system(state_dir)
    found = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if re.fullmatch(r"round=\d+", i.base_name)]
    done = [i for i in found if system.get_file_info(f"{i.path}/_SUCCESS").type == fs.FileType.File]
    return max((int(i.base_name.split("=")[1]) for i in done), default=None)


def collect_document_files(spark: SparkSession, folders: DataFrame, path_table: str, model: str, table_path: str) -> DataFrame:
    """Output files (``.json``, the name made from the id) of the folders, listed and read by the tasks -> validated, clipped
    records that replace ``model`` in the prediction table; unreadable and invalid files become the stub with
    status 'failed'. The path table stays at ``path_table``. Returns the stored rows."""
    from scopekit.operators.outputs import clip_records, records_or_stub
    DF.write_path_table(DF.list_files(spark, folders), path_table)
    raw = DF.read_document_files(spark, path_table, "response").select("id", "response")
    recs = clip_records(records_or_stub(raw, "response", marker=""))
    sinks.write_predictions(recs.select(F.lit(model).alias("model"), "id", "status", *FV.SCOPE_KEYS, "sources"), table_path)
    return spark.read.parquet(table_path).where(F.col("model") == model)
