"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or tables Spark derives from them) in
full; none uses a row cap, id subset or sample.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions import paths as PF
from scopekit.functions.text import clean_markup, is_relevant, markup_to_text
from scopekit.functions.tokens import token_estimate
from scopekit.functions.records import record_json, trim_marker
from scopekit.operators import batch as B
from scopekit.operators import evaluate as E
from scopekit.operators import manifest as M
from scopekit.operators import outputs as O
from scopekit.operators import pages as P
from scopekit.operators import prompts as PR
from scopekit.operators import training as T
from scopekit.plans import files as file_queries
from scopekit.plans import fixtures as FX
from scopekit.session import shared_dir
from scopekit.sources import config as C
from scopekit.sources import manifest as SM
from scopekit.sources import outputs as SO
from scopekit.sources import sinks as K
from scopekit.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Budget of the over-budget query: low enough that the driver's short documents cross it.
OVER_BUDGET_TOKENS = 500
LORA_PATH = "adapters/emissions-lora"
MISTRAL_PREFIX, MISTRAL_SUFFIX = FV.CHAT_WRAPPERS["mistral"]
CACHE_SUFFIX = MISTRAL_SUFFIX + FV.ANSWER_START + "\n"


# ---------------------------------------------------------------- pages and prompts

def _units(spark, sf, mode="text"):
    return P.page_units(FX.report_pages(spark, sf), mode)


def _prompt_parts(spark, sf, mode="text", limit_chars=None, only=None):
    """(units, assembled with budget status, assembled within budget), of the documents in ``only`` (doc_id, each once)."""
    units = P.page_units(FX.report_pages(spark, sf), mode)
    if only is not None:
        units = P.units_of(units, only)
    status = P.assemble_with_status(units, limit_chars)
    within = status.where(~F.col("over_budget")).select("doc_id", "n_chunks", "user_message")
    return units, status, within


def q_page_split(spark, sf):
    return FX.report_pages(spark, sf)


def q_relevant_flag(spark, sf):
    return FX.report_pages(spark, sf).select("doc_id", "page_no", is_relevant("page_text").alias("relevant"))


def q_page_wrap(spark, sf):
    return _units(spark, sf).select("doc_id", "page_no", F.col("unit").alias("chunk"))


def q_relevant_pages(spark, sf):
    return P.relevant_pages(_units(spark, sf)).select("doc_id", "page_no", F.col("unit").alias("chunk"))


def q_page_plaintext(spark, sf):
    return FX.html_pages(spark, sf).select("page_id", markup_to_text("html").alias("text"))


def q_page_clean(spark, sf):
    return FX.html_pages(spark, sf).select("page_id", clean_markup("html", "page_id").alias("html"))


def q_odd_markup_clean(spark, sf):
    m = FX.odd_markup(spark, sf)
    return m.select("page_id", clean_markup("markup", "page_id").alias("markup"), markup_to_text("markup").alias("text"))


def q_assemble_documents(spark, sf):
    return _prompt_parts(spark, sf)[2]


def q_over_budget(spark, sf):
    units = _units(spark, sf, "xhtml")
    return P.document_budget(units, P.budget_chars(OVER_BUDGET_TOKENS)).select(
        "doc_id", "n_pages", "n_relevant", "relevant_chars", "chars_before_last_page", "over_budget")


def _prompts(spark, sf, family=None, with_model=False):
    _, status, _ = _prompt_parts(spark, sf)
    ids = FX.document_models(spark, sf) if with_model else FX.documents(spark, sf, "doc_id")
    fam = PR.chat_family("model") if with_model else None
    return PR.build_prompts(ids, status, family=fam)


def q_build_prompt(spark, sf):
    return _prompts(spark, sf)


def q_build_prompt_limited(spark, sf):
    """Prompts under a budget that some documents exceed."""
    _, status, _ = _prompt_parts(spark, sf, limit_chars=P.budget_chars(OVER_BUDGET_TOKENS))
    return PR.build_prompts(FX.documents(spark, sf, "doc_id"), status)


def _markup_parts(spark, sf):
    units = P.page_units(FX.markup_pages(spark, sf), "xhtml")
    return P.assemble_with_status(units)


def q_assemble_xhtml(spark, sf):
    return _markup_parts(spark, sf).where(~F.col("over_budget")).select("doc_id", "n_chunks", "user_message")


def q_build_prompt_xhtml(spark, sf):
    ids = FX.markup_pages(spark, sf).select("doc_id").distinct()
    return PR.build_prompts(ids, _markup_parts(spark, sf))


def _lengths(spark, sf, ids, family=None):
    return PR.prompt_lengths(ids, P.document_budget(_units(spark, sf)), family=family)


def q_context_plan(spark, sf):
    lengths = _lengths(spark, sf, FX.document_models(spark, sf), PR.chat_family("model"))
    return PR.context_plan(lengths, C.model_config(spark))


def q_context_plan_extended(spark, sf):
    """The plan for models of a 32nd of the context, which many prompts exceed."""
    lengths = _lengths(spark, sf, FX.document_models(spark, sf), PR.chat_family("model"))
    small = C.model_config(spark).select("model", F.expr("CAST(context_size DIV 32 AS INT)").alias("context_size"))
    return PR.context_plan(lengths, small)


def q_prompt_stats(spark, sf):
    lengths = _lengths(spark, sf, FX.documents(spark, sf, "doc_id"))
    cached = lengths.select((F.col("prompt_chars") + 1).alias("n"))   # the cache file ends with a line break
    return PR.prompt_stats(cached, chars_col="n")


def q_token_estimate(spark, sf):
    return FX.documents(spark, sf).select("doc_id", token_estimate("text").alias("n_tokens"))


def q_model_lookup(spark, sf):
    cfg = C.model_config(spark)
    return FX.document_models(spark, sf).join(cfg, "model", "inner").select(
        "doc_id", "model", "context_size", "model_path")


def _runs(spark, sf):
    cfg = C.model_config(spark)
    d = FX.document_models(spark, sf).join(cfg, "model", "inner")
    lora = F.when(F.col("doc_id") % 2 == 1, F.lit(LORA_PATH)).otherwise(F.lit(""))
    return d.select("doc_id", "model", "model_path", lora.alias("lora"))


def q_run_name(spark, sf):
    r = _runs(spark, sf)
    run = PF.run_name("model_path", "lora")
    uid = F.col("doc_id").cast("string")
    return r.select(
        "doc_id", "model", "lora", run.alias("run_name"),
        PF.join_path(F.lit("outputs"), run, F.concat(uid, F.lit(".json"))).alias("output_path"),
        PF.join_path(F.lit("prompts/generated"), PF.last_segment("model_path"),
                     F.concat(uid, F.lit(".txt"))).alias("prompt_path"))


def q_id_from_path(spark, sf):
    d = FX.documents(spark, sf, "doc_id")
    uid = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    path = (F.when(k == 0, F.concat(F.lit("pdfs/"), uid, F.lit(".pdf")))
             .when(k == 1, F.concat(F.lit("outputs/Mixtral-8x7B-Instruct-v0.1/"), uid, F.lit(".json")))
             .when(k == 2, F.concat(F.lit("/data/archive/"), uid, F.lit(".tar.gz")))
             .when(k == 3, F.concat(F.lit("runs/"), uid, F.lit("/")))
             .when(k == 4, uid)
             .otherwise(F.concat(F.lit("models/"), uid, F.lit(".v0.1.parquet"))))
    return d.select("doc_id", path.alias("path")).select("doc_id", "path", PF.path_stem("path").alias("stem"))


def q_location_kind(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", PF.url_scheme("url").alias("scheme"), PF.location_kind("url").alias("kind"))


def q_location_check(spark, sf):
    """Every manifest URL and every document's expected local path, checked against a store
    that holds the documents with doc_id % 4 != 0."""
    docs = FX.documents(spark, sf, "doc_id")
    local = docs.select(F.col("doc_id").cast("string").alias("id"),
                        F.concat(F.lit("pdfs/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("location"))
    remote = FX.manifest(spark, sf).select("id", F.col("url").alias("location"))
    stored = docs.where(F.col("doc_id") % 4 != 0).select(
        F.concat(F.lit("pdfs/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    return M.classify_locations(local.unionByName(remote), stored)


def q_scan_file_stem(spark, sf):
    d = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    return d.select("doc_id", PF.file_stem_of_metadata().alias("stem"))


# ---------------------------------------------------------------- manifest

def _verified(spark, sf):
    digests = SM.text_digests(FX.documents(spark, sf))
    return M.verify_manifest(FX.manifest(spark, sf), digests)


def q_scan_manifest(spark, sf):
    path = shared_dir(spark, "manifest")
    m = FX.manifest(spark, sf).join(FX.documents(spark, sf, "doc_id", "n_chars")
                                    .select(F.col("doc_id").cast("string").alias("id"), "n_chars"), "id", "left")
    m.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("id", "url", "sha256")


def q_verify_manifest(spark, sf):
    return _verified(spark, sf)


def q_failed_ids(spark, sf):
    return M.failed_ids(_verified(spark, sf))


# ---------------------------------------------------------------- batch scoring

def q_resume_pending(spark, sf):
    return B.pending(FX.documents(spark, sf, "doc_id").select(F.col("doc_id")),
                     FX.finished(spark, sf).select(F.col("id").cast("bigint").alias("id")))


def q_batch_score(spark, sf):
    todo = q_resume_pending(spark, sf)
    _, status, _ = _prompt_parts(spark, sf, only=todo.distinct())
    prompts = PR.build_prompts(todo, status)
    return B.batch_records(prompts, B.chunk_echo_scorer)


def q_batch_score_limited(spark, sf):
    """Batch scoring under a budget that some documents exceed."""
    todo = q_resume_pending(spark, sf)
    _, status, _ = _prompt_parts(spark, sf, limit_chars=P.budget_chars(OVER_BUDGET_TOKENS), only=todo.distinct())
    return B.batch_records(PR.build_prompts(todo, status), B.chunk_echo_scorer)


# ---------------------------------------------------------------- outputs

def q_trim_eos(spark, sf):
    r = FX.raw_responses(spark, sf)
    return r.select("model", "id", trim_marker("response").alias("response"))


def q_validate_output(spark, sf):
    r = FX.raw_responses(spark, sf)
    v = O.validate_responses(r.select("model", "id", trim_marker("response").alias("response")))
    return v.select("model", "id", "valid")


def q_stub_on_failure(spark, sf):
    return O.records_or_stub(FX.raw_responses(spark, sf))


def q_record_json(spark, sf):
    return FX.predictions(spark, sf).select("model", "id", record_json().alias("record"))


def q_collect_outputs(spark, sf):
    path = shared_dir(spark, "outputs")
    K.write_jsonl(FX.predictions(spark, sf), path, order_by="id")
    back = spark.read.schema("model string, id string, scope_1 bigint, scope_2 bigint, scope_3 bigint, "
                             "sources array<bigint>").json(path)
    return O.clip_records(back.select("model", "id", "scope_1", "scope_2", "scope_3", "sources"))


def q_scan_predictions(spark, sf):
    path = shared_dir(spark, "predictions")
    K.write_predictions(FX.predictions(spark, sf), path)
    return SO.read_predictions(spark, path).select("model", "id", "scope_1", "scope_2", "scope_3", "sources")


def q_collect_two_models(spark, sf):
    """Models stored one after the other, the first one twice: each row once."""
    path, p = shared_dir(spark, "two-models"), FX.predictions(spark, sf)
    for part in (p.where("model = 'm0'"), p.where("model <> 'm0'"), p.where("model = 'm0'")):
        K.write_predictions(part, path)
    return SO.read_predictions(spark, path).select("model", "id", "scope_1", "scope_2", "scope_3", "sources")


def q_drop_stubs(spark, sf):
    return T.drop_stubs(FX.raw_responses(spark, sf)).select("model", "id", "response")


def q_last_response(spark, sf):
    return T.last_response(FX.raw_responses(spark, sf))


# ---------------------------------------------------------------- evaluation

def _joined(spark, sf):
    return E.join_predictions(FX.predictions(spark, sf), FX.ground_truth(spark, sf))


def _counts(spark, sf):
    return E.evaluation_counts(FX.predictions(spark, sf), FX.ground_truth(spark, sf))


def _acc(spark, sf):
    return E.value_accuracy(_counts(spark, sf))


def q_scope2_truth(spark, sf):
    return E.truth_values(FX.ground_truth(spark, sf)).select("id", "scope_2")


def q_truth_pages(spark, sf):
    return E.truth_page_set(FX.ground_truth(spark, sf), "any")


def q_cited_pages(spark, sf):
    return E.cited_true_pages(FX.predictions(spark, sf), FX.ground_truth(spark, sf))


def q_pred_truth_join(spark, sf):
    return _joined(spark, sf)


def q_accuracy_strict(spark, sf):
    return E.mode_accuracy(_acc(spark, sf), "strict")


def q_accuracy_tolerant(spark, sf):
    return E.mode_accuracy(_acc(spark, sf), "tolerant")


def q_accuracy_graceful(spark, sf):
    return E.mode_accuracy(_acc(spark, sf), "graceful")


def q_accuracy_sources(spark, sf):
    return E.source_accuracy(_counts(spark, sf))


def q_accuracy_average(spark, sf):
    return E.average_accuracy(E.long_accuracy(_acc(spark, sf)))


def q_metric_table(spark, sf):
    return E.metric_table(_counts(spark, sf)).select("model", "mode", *FV.SCOPE_KEYS, "average", "sources")


def q_failure_count(spark, sf):
    return E.failure_count(FX.predictions(spark, sf))


# ---------------------------------------------------------------- training sets

def _stripped_cache(spark, sf):
    c = FX.prompt_cache(spark, sf)
    return c.select("id", T.strip_wrapper("text", MISTRAL_PREFIX, CACHE_SUFFIX).alias("content"))


def q_strip_wrapper(spark, sf):
    return _stripped_cache(spark, sf)


def q_drop_empty_prompts(spark, sf):
    return _stripped_cache(spark, sf).where(~T.is_empty_prompt("content"))


def q_training_prompts(spark, sf):
    # responses keyed by id, the one loaded last wins (then stubs are dropped)
    return _training(spark, sf, FX.raw_responses(spark, sf), _stripped_cache(spark, sf))


def _training(spark, sf, responses, cached, order_col="seq"):
    needed = T.prompts_to_rebuild(responses, cached, order_col)
    doc_id = F.col("id").try_cast("bigint")
    only = needed.where(doc_id.cast("string") == F.col("id")).select(doc_id.alias("doc_id"))  # so no two ids are one document
    rebuilt = _prompt_parts(spark, sf, only=only)[2].select(F.col("doc_id").cast("string").alias("id"), "user_message")
    return T.training_prompts(T.last_response(responses, order_col), cached, rebuilt)


def q_training_prompts_rebuilt(spark, sf):
    """All prompts made again, whatever the cache holds."""
    return _training(spark, sf, FX.raw_responses(spark, sf), None)


def q_training_prompts_from_parquet(spark, sf):
    """Responses from a Parquet prediction table, re-serialised as compact records per row."""
    pred = FX.predictions(spark, sf).select("id", "model", record_json().alias("response"))
    return _training(spark, sf, pred, _stripped_cache(spark, sf), order_col="model")


def _pair_id():
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def q_sft_records(spark, sf):
    return T.sft_records(FX.chat(spark, sf))


def q_dpo_records(spark, sf):
    return T.dpo_records(FX.chat(spark, sf), _pair_id())


def q_rejected_records(spark, sf):
    r = T.rejected_records(FX.chat(spark, sf), _pair_id())
    return r.select("conv_id", "turn", "rejected_scope_1", "rejected_scope_2", "rejected_scope_3",
                    "rejected_sources")


def q_render_training_text(spark, sf):
    names = F.array(*[F.lit(n) for n in T.TRAINING_TEMPLATES])
    pairs = FX.chat(spark, sf).withColumn(
        "template", F.element_at(names, (F.col("conv_id") % len(T.TRAINING_TEMPLATES) + 1).cast("int")))
    return T.render_training_text(pairs, T.template_table(spark)).select("conv_id", "turn", "template", "text")


def q_jsonl_roundtrip(spark, sf):
    path = shared_dir(spark, "sft")
    K.write_jsonl(T.sft_records(FX.chat(spark, sf)).select("prompt", "completion"), path)
    return spark.read.schema("prompt string, completion string").json(path)


QUERIES: dict[str, Query] = {
    # pages and prompts
    "page_split": q_page_split,
    "relevant_flag": q_relevant_flag,
    "page_wrap": q_page_wrap,
    "relevant_pages": q_relevant_pages,
    "page_plaintext": q_page_plaintext,
    "page_clean": q_page_clean,
    "odd_markup_clean": q_odd_markup_clean,
    "assemble_documents": q_assemble_documents,
    "over_budget": q_over_budget,
    "build_prompt": q_build_prompt,
    "build_prompt_limited": q_build_prompt_limited,
    "assemble_xhtml": q_assemble_xhtml,
    "build_prompt_xhtml": q_build_prompt_xhtml,
    "context_plan": q_context_plan,
    "context_plan_extended": q_context_plan_extended,
    "prompt_stats": q_prompt_stats,
    "token_estimate": q_token_estimate,
    "model_lookup": q_model_lookup,
    "run_name": q_run_name,
    "id_from_path": q_id_from_path,
    "location_kind": q_location_kind,
    "location_check": q_location_check,
    "scan_file_stem": q_scan_file_stem,
    # manifest
    "scan_manifest": q_scan_manifest,
    "verify_manifest": q_verify_manifest,
    "failed_ids": q_failed_ids,
    # batch
    "resume_pending": q_resume_pending,
    "batch_score": q_batch_score,
    "batch_score_limited": q_batch_score_limited,
    # outputs
    "trim_eos": q_trim_eos,
    "validate_output": q_validate_output,
    "stub_on_failure": q_stub_on_failure,
    "record_json": q_record_json,
    "collect_outputs": q_collect_outputs,
    "scan_predictions": q_scan_predictions,
    "collect_two_models": q_collect_two_models,
    "drop_stubs": q_drop_stubs,
    "last_response": q_last_response,
    # evaluation
    "scope2_truth": q_scope2_truth,
    "truth_pages": q_truth_pages,
    "cited_pages": q_cited_pages,
    "pred_truth_join": q_pred_truth_join,
    "accuracy_strict": q_accuracy_strict,
    "accuracy_tolerant": q_accuracy_tolerant,
    "accuracy_graceful": q_accuracy_graceful,
    "accuracy_sources": q_accuracy_sources,
    "accuracy_average": q_accuracy_average,
    "metric_table": q_metric_table,
    "failure_count": q_failure_count,
    # training sets
    "strip_wrapper": q_strip_wrapper,
    "drop_empty_prompts": q_drop_empty_prompts,
    "training_prompts": q_training_prompts,
    "training_prompts_rebuilt": q_training_prompts_rebuilt,
    "training_prompts_from_parquet": q_training_prompts_from_parquet,
    "sft_records": q_sft_records,
    "dpo_records": q_dpo_records,
    "rejected_records": q_rejected_records,
    "render_training_text": q_render_training_text,
    "jsonl_roundtrip": q_jsonl_roundtrip,
}
QUERIES.update(file_queries.QUERIES)
