"""Named queries over files per document: sinks and sources that write and read real files in a shared folder.

Each query writes its files from the driver's whole tables, then reads them by path table in the tasks.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scopekit import fixed_values as FV
from scopekit.functions.records import trim_marker
from scopekit.functions.tokens import exact_token_counts, tokenizer_file, tokens_of_length
from scopekit.operators import batch as B
from scopekit.operators import evaluate as E
from scopekit.operators import manifest as M
from scopekit.operators import pages as P
from scopekit.operators import prompts as PR
from scopekit.operators import training as T
from scopekit.plans import fixtures as FX
from scopekit.plans import jobs
from scopekit.session import shared_dir
from scopekit.sources import document_files as DF
from scopekit.sources import layout as L
from scopekit.sources import manifest as SM
from scopekit.sources import sinks as K
from scopekit.sources.pages import split_page_files

FOLDERS = 4


def _folder(key):
    return F.concat(F.lit("part "), F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("string"))


def _stored(spark, rows, name, extension):
    """Rows (id, value) as one file each, spread over folders; (root, table of folders)."""
    root = shared_dir(spark, name)
    DF.write_document_files(rows.select(_folder("id").alias("folder"), "id", "value"), root, extension)
    return root, spark.range(FOLDERS).select(F.concat(F.lit(f"{root}/part "), F.col("id").cast("string")).alias("folder"))


def q_output_files(spark, sf):
    """Output files collected into validated, clipped records; broken files become stubs."""
    _, folders = _stored(spark, FX.output_files(spark, sf), "output-files", ".json")
    got = jobs.collect_document_files(spark, folders, shared_dir(spark, "output-paths"), "m", shared_dir(spark, "output-table"))
    return got.select("model", "id", "status", *FV.SCOPE_KEYS, "sources")


def q_response_files(spark, sf):
    """Raw responses by a path table that also names files which were never written."""
    rows = FX.output_files(spark, sf)
    root, folders = _stored(spark, rows.where("doc_id % 9 <> 0"), "response-files", ".json")
    found = DF.list_files(spark, folders).select("id", "path")
    lost = rows.where("doc_id % 9 = 0").select("id", F.concat(F.lit(f"{root}/nowhere/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    paths = shared_dir(spark, "response-paths")
    DF.write_path_table(found.unionByName(lost), paths, paths_per_file=500)
    return DF.read_document_files(spark, paths, "response")


def _prompt_files(spark, sf):
    _, folders = _stored(spark, FX.prompt_cache(spark, sf).select("id", F.col("text").alias("value")), "prompt-files", ".txt")
    paths = shared_dir(spark, "prompt-paths")
    DF.write_path_table(DF.list_files(spark, folders, ".txt"), paths)
    return DF.read_document_files(spark, paths, "text")


def q_prompt_files(spark, sf):
    """Cached prompt files without the chat wrapper."""
    pre, suf = FV.CHAT_WRAPPERS["mistral"][0], FV.CHAT_WRAPPERS["mistral"][1] + FV.ANSWER_START + "\n"
    return _prompt_files(spark, sf).select("id", T.strip_wrapper("text", pre, suf).alias("content"))


def q_prompt_file_stats(spark, sf):
    return PR.prompt_stats(_prompt_files(spark, sf), "text")


def q_extraction_records(spark, sf):
    """The resumable extraction job from pages to stored records, its tasks committing as they go; run twice, the second run
    has nothing to do."""
    prompts, out = shared_dir(spark, "extraction-prompts"), shared_dir(spark, "extraction-records")
    jobs.build_prompt_table(FX.report_pages(spark, sf), FX.documents(spark, sf, "doc_id"), prompts, mode="text")
    for _ in range(2):
        jobs.run_extraction(spark, prompts, out, "echo", B.chunk_echo_scorer)
    return spark.read.parquet(out).select("model", F.col("id").cast("string").alias("id"), "status", *FV.SCOPE_KEYS, "sources")


def q_page_split_files(spark, sf):
    """Documents stored as text files, read in blocks of 4 KB by many tasks and numbered by a prefix sum."""
    texts = FX.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("value"))
    _, folders = _stored(spark, texts, "page-files", ".txt")
    pages = split_page_files(DF.list_files(spark, folders, ".txt").select("id", "path", "length"), block_bytes=4096)
    return pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page_no", "page_text")


def q_ordered_outputs(spark, sf):
    """Predictions written in order to many files; each row's place when the files are read in name order."""
    path = shared_dir(spark, "ordered")
    K.write_predictions(FX.predictions(spark, sf), path, order_by="id", files=7)
    rows = spark.read.parquet(path).select("model", "id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("model", "file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("model").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("model", "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, ["model", "file"]).select("model", "id", (F.col("base") + F.col("row")).alias("place"))


def q_evaluate_directory(spark, sf):
    """The metric table over one file per model, whose types drift: whole numbers, doubles with NaN, no scope_3, whole numbers as ids."""
    root, p = shared_dir(spark, "model-files"), FX.predictions(spark, sf)

    def doubles(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    shapes = {"m0": ["id", *FV.SCOPE_KEYS, "sources"], "m1": ["id", *map(doubles, FV.SCOPE_KEYS), F.col("sources").cast("array<double>")],
              "m2": ["id", "sources", "scope_2", "scope_1"], "m3": [F.col("id").cast("bigint"), *FV.SCOPE_KEYS, "sources"]}
    for model, columns in shapes.items():
        p.where(F.col("model") == model).select(*columns).write.parquet(f"{root}/{model}.parquet")
    table = jobs.evaluate_directory(spark, root, FX.ground_truth(spark, sf), shared_dir(spark, "directory-metrics"))
    return table.select("model", "mode", *FV.SCOPE_KEYS, "average", "sources")


def q_merged_prompt_stats(spark, sf):
    """Length statistics merged from stored sketches of eight runs; is the median's rank within one percent of the middle?"""
    docs = FX.documents(spark, sf, "doc_id", "n_chars").withColumn("run", F.col("doc_id") % 8)
    stored = shared_dir(spark, "sketches")
    PR.prompt_sketches(docs, "run", chars_col="n_chars").write.parquet(stored)
    merged = PR.merged_stats(spark.read.parquet(stored))
    median = F.lit(merged.first()["quantile_tokens"])                # one number
    t = tokens_of_length("n_chars")
    close = (F.avg((t < median).cast("double")) <= 0.51) & (F.avg((t <= median).cast("double")) >= 0.49)
    exact = docs.where("n_chars IS NOT NULL").agg(F.lit(1).alias("k"), close.alias("median_close"))
    return merged.withColumn("k", F.lit(1)).join(exact, "k").select("max_tokens", "min_tokens", "mean_tokens", "n_prompts", "median_close")


def q_token_count(spark, sf):
    """Exact token counts of whole documents by a tokenizer's vocabulary."""
    return exact_token_counts(FX.documents(spark, sf), "text", tokenizer_file()).select("doc_id", "n_tokens")


def q_trim_model_markers(spark, sf):
    """Outputs that end with the end marker of their own model, or of another one (every fifth document)."""
    d = FX.document_models(spark, sf)
    families = F.array(*[F.lit(m) for m in FV.EOS_MARKERS.values()])
    own = PR.eos_marker("model")
    printed = F.when(F.col("doc_id") % 5 == 3, F.element_at(families, (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(own)
    text = F.concat(F.lit('{"doc":'), F.col("doc_id").cast("string"), F.lit("}"), printed)
    return d.select("doc_id", "model", trim_marker(text, own).alias("response"))


BUCKETS = 8


def _bucketed(spark, df, name, key="id", rows=0):
    """``rows``: those of the largest table of the join; all its tables get the number of buckets that this one needs."""
    return spark.table(L.write_bucketed(df, name, key, L.buckets_for_rows(rows, BUCKETS)))


def q_bucketed_evaluation(spark, sf):
    """The metric table from predictions and truth bucketed by id: one join without an exchange."""
    pred, truth = FX.predictions(spark, sf), FX.ground_truth(spark, sf)
    rows = max(pred.count(), truth.count())
    pred, truth = _bucketed(spark, pred, "predictions", rows=rows), _bucketed(spark, truth, "truth", rows=rows)
    return E.metric_table(E.evaluation_counts(pred, truth)).select("model", "mode", *FV.SCOPE_KEYS, "average", "sources")


def q_bucketed_resume(spark, sf):
    """Pending documents from documents and finished records bucketed by id."""
    docs, done = FX.documents(spark, sf, "doc_id"), FX.finished(spark, sf).select(F.col("id").cast("bigint").alias("id"))
    rows = max(docs.count(), done.count())
    return B.pending(_bucketed(spark, docs, "documents", "doc_id", rows), _bucketed(spark, done, "finished", rows=rows))


def q_bucketed_training(spark, sf):
    """Training prompts from responses, prompt cache and rebuilt messages bucketed by id: grouping and joins without an exchange."""
    pre, suf = FV.CHAT_WRAPPERS["mistral"][0], FV.CHAT_WRAPPERS["mistral"][1] + FV.ANSWER_START + "\n"
    raw, cached = FX.raw_responses(spark, sf).select("id", "seq", "response"), FX.prompt_cache(spark, sf)
    rows = max(raw.count(), cached.count())
    raw = _bucketed(spark, raw, "responses", rows=rows)
    cache = _bucketed(spark, cached, "cache", rows=rows).select("id", T.strip_wrapper("text", pre, suf).alias("content"))
    units = P.page_units(FX.report_pages(spark, sf), "text")
    messages = P.assemble_documents(units).select(F.col("doc_id").cast("string").alias("id"), "user_message")
    return T.training_prompts(T.last_response(raw), cache, _bucketed(spark, messages, "messages", rows=rows))


def q_manifest_rounds(spark, sf):
    """A round over a store that lacks every 13th document: what is kept, fetched, saved and failed; the fetch of every 17th
    document fails."""
    docs = FX.documents(spark, sf)
    stored = SM.text_digests(docs.where("doc_id % 13 <> 0"))
    planned = M.plan_round(FX.manifest(spark, sf), stored)
    return M.finish_round(planned, SM.text_digests(docs.where("doc_id % 17 <> 0")))


def q_digest_rounds(spark, sf):
    """Digests of stored files after a second round, which reads only what changed: every fourth document."""
    texts = FX.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("value"), "doc_id")
    root, folders = _stored(spark, texts, "store", ".pdf")
    state = shared_dir(spark, "digests")
    jobs.digest_round(spark, folders, state)
    again = texts.where("doc_id % 4 = 0").select(_folder("id").alias("folder"), "id", F.concat("value", F.lit("\n")).alias("value"))
    DF.write_document_files(again, root, ".pdf")
    return jobs.digest_round(spark, folders, state).select("id", "length", "sha256", "hashed")


QUERIES = {
    "output_files": q_output_files,
    "response_files": q_response_files,
    "prompt_files": q_prompt_files,
    "prompt_file_stats": q_prompt_file_stats,
    "extraction_records": q_extraction_records,
    "page_split_files": q_page_split_files,
    "ordered_outputs": q_ordered_outputs,
    "evaluate_directory": q_evaluate_directory,
    "merged_prompt_stats": q_merged_prompt_stats,
    "bucketed_evaluation": q_bucketed_evaluation,
    "bucketed_resume": q_bucketed_resume,
    "bucketed_training": q_bucketed_training,
    "token_count": q_token_count,
    "trim_model_markers": q_trim_model_markers,
    "manifest_rounds": q_manifest_rounds,
    "digest_rounds": q_digest_rounds,
}
