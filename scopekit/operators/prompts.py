"""Prompt construction, context planning and prompt statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.tokens import token_estimate, tokens_of_length

STATUS_OK = "ok"
STATUS_EMPTY = "no_relevant_pages"
STATUS_OVER = "over_budget"


def chat_family(model_col) -> F.Column:
    """Chat template family of a configured model name."""
    m = F.lower(F.col(model_col) if isinstance(model_col, str) else model_col)
    return (F.when(m.startswith("qwen"), F.lit("chatml"))
             .when(m.startswith("openchat"), F.lit("openchat"))
             .otherwise(F.lit("mistral")))


def eos_marker(model_col) -> F.Column:
    """The end marker that a configured model's engine prints."""
    family = chat_family(model_col)
    out = F.lit(FV.EOS_MARKER)
    for name, marker in FV.EOS_MARKERS.items():
        out = F.when(family == name, F.lit(marker)).otherwise(out)
    return out


def _wrap(content: F.Column, family: F.Column | None) -> F.Column:
    def one(fam):
        pre, suf = FV.CHAT_WRAPPERS[fam]
        return F.concat(F.lit(pre), content, F.lit(suf))
    if family is None:
        return one("mistral")
    expr = F.when(family == "chatml", one("chatml"))
    if "openchat" in FV.CHAT_WRAPPERS:
        expr = expr.when(family == "openchat", one("openchat"))
    return expr.otherwise(one("mistral"))


def build_prompts(doc_ids: DataFrame, assembled: DataFrame,
                  instruction: str = FV.INSTRUCTION, family: F.Column | None = None,
                  answer_start: str = FV.ANSWER_START) -> DataFrame:
    """(doc_id, status, prompt) for every document.

    ``assembled`` is ``pages.assemble_with_status``. status 'ok': chat-wrapped
    ``instruction + "\\n" + pages`` plus the answer start; 'no_relevant_pages':
    no prompt (the record is all null with no sources); 'over_budget': no
    prompt (the record becomes the failure stub). ``doc_ids`` may carry extra
    columns (e.g. the model) used by ``family``.
    """
    a = assembled.select("doc_id", "over_budget", "user_message")
    j = doc_ids.join(a, "doc_id", "left")
    status = (F.when(F.coalesce(F.col("over_budget"), F.lit(False)), F.lit(STATUS_OVER))
               .when(F.col("user_message").isNull(), F.lit(STATUS_EMPTY))
               .otherwise(F.lit(STATUS_OK)))
    content = F.concat(F.lit(instruction + "\n"), F.col("user_message"))
    prompt = F.when(status == STATUS_OK, F.concat(_wrap(content, family), F.lit(answer_start)))
    keep = [c for c in doc_ids.columns if c != "doc_id"]
    return j.select("doc_id", *keep, status.alias("status"), prompt.alias("prompt"))


def prompt_lengths(doc_ids: DataFrame, budget: DataFrame, instruction: str = FV.INSTRUCTION,
                   family: F.Column | None = None, answer_start: str = FV.ANSWER_START) -> DataFrame:
    """(doc_id, status, prompt_chars): the length of the prompt that ``build_prompts`` would make (null where
    it makes none), from the page budget (``pages.document_budget``) alone: no page text is assembled."""
    b = budget.select("doc_id", "over_budget", "n_relevant", "relevant_chars")
    j = doc_ids.join(b, "doc_id", "left")
    relevant = F.coalesce(F.col("n_relevant"), F.lit(0)) > 0
    status = (F.when(relevant & F.col("over_budget"), F.lit(STATUS_OVER)).when(relevant, F.lit(STATUS_OK))
               .otherwise(F.lit(STATUS_EMPTY)))
    constant = F.length(F.concat(_wrap(F.lit(instruction + "\n"), family), F.lit(answer_start)))
    keep = [c for c in doc_ids.columns if c != "doc_id"]
    return j.select("doc_id", *keep, status.alias("status"),
                    F.when(status == STATUS_OK, F.col("relevant_chars") + constant).alias("prompt_chars"))


def context_plan(prompts: DataFrame, config: DataFrame, model_col: str = "model",
                 max_neighbour: int = FV.DEFAULT_MAX_NEIGHBOUR,
                 max_window: int = FV.DEFAULT_MAX_WINDOW) -> DataFrame:
    """Context size and context-extension parameters per prompt.

    context = tokens + 120; when it exceeds the model's context, neighbour =
    max_neighbour and window = min(int(model_context / 2), max_window), else 1 and 512.
    Tokens of the qwen family are scaled by 1.2 and truncated. Whether the
    configuration is broadcast is the optimizer's choice, by its size. ``prompts`` holds the
    prompts, or only their lengths (``prompt_lengths``).
    """
    cfg = config.select(F.col("model").alias(model_col), "context_size")
    size = "prompt_chars" if "prompt_chars" in prompts.columns else "prompt"
    j = prompts.where(F.col(size).isNotNull()).join(cfg, model_col, "inner")
    raw = tokens_of_length(size) if size == "prompt_chars" else token_estimate(size)
    tokens = F.when(F.lower(F.col(model_col)).startswith("qwen"),
                    F.floor(raw * F.lit(FV.QWEN_TOKEN_SCALE)).cast("bigint")).otherwise(raw)
    ctx = tokens + F.lit(FV.CONTEXT_MARGIN)
    extend = ctx > F.col("context_size")
    half = F.floor(F.col("context_size") / F.lit(2.0)).cast("bigint")
    return j.select(
        "doc_id", model_col, "context_size", tokens.alias("prompt_tokens"), ctx.alias("context"),
        F.when(extend, F.lit(max_neighbour)).otherwise(F.lit(FV.DISABLED_NEIGHBOUR)).cast("int").alias("group_neighbour"),
        F.when(extend, F.least(half, F.lit(max_window).cast("bigint"))).otherwise(F.lit(FV.DISABLED_WINDOW))
         .cast("int").alias("group_window"),
    )


def cached_prompt_text(prompt_col="prompt") -> F.Column:
    """Text of the prompt cache file: the prompt plus a newline."""
    p = F.col(prompt_col) if isinstance(prompt_col, str) else prompt_col
    return F.concat(p, F.lit("\n"))


def prompt_stats(prompts: DataFrame, text_col: str = "prompt", approx: bool = False,
                 chars_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """max, min, mean, median of the token estimate over all prompts (texts, or lengths in ``chars_col``), or of the
    counts in ``tokens_col`` (``tokens.exact_token_counts``).

    The exact median keeps a count per distinct value; token counts are bounded
    by the prompt budget, so that state stays small at any number of prompts.
    ``approx=True`` uses a quantile sketch instead (fixed-size state per task).
    """
    t = F.col(tokens_col) if tokens_col else tokens_of_length(chars_col) if chars_col else token_estimate(text_col)
    med = F.percentile_approx("t", 0.5) if approx else F.median("t")
    return prompts.where(F.col(tokens_col or chars_col or text_col).isNotNull()).select(t.alias("t")).agg(
        F.max("t").alias("max_tokens"), F.min("t").alias("min_tokens"),
        F.round(F.avg("t"), 6).alias("mean_tokens"), med.cast("double").alias("median_tokens"),
        F.count(F.lit(1)).alias("n_prompts"))


SKETCH_K = 400      # accuracy of a quantile sketch: a rank error of about 0.7 % at any number of values


def prompt_sketches(prompts: DataFrame, by: str, text_col: str = "prompt", chars_col: str | None = None) -> DataFrame:
    """(by, n, total, least, most, sketch): mergeable length statistics of each group (a run, a day, a shard), a few kilobytes each.
    Stored, they answer for any union of groups without reading a prompt again."""
    t = tokens_of_length(chars_col) if chars_col else token_estimate(text_col)
    rows = prompts.where(F.col(chars_col or text_col).isNotNull()).select(by, t.alias("t"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.min("t").alias("least"), F.max("t").alias("most"),
                                F.kll_sketch_agg_bigint("t", F.lit(SKETCH_K)).alias("sketch"))


def merged_stats(sketches: DataFrame, *by: str, quantile: float = 0.5) -> DataFrame:
    """max, min, mean, number and a quantile (the median) of token counts over stored sketches, in all or by groups: all but the
    quantile exact, it within the sketch's rank error."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n_prompts"), F.sum("total").alias("total"), F.min("least").alias("min_tokens"),
                                       F.max("most").alias("max_tokens"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, "max_tokens", "min_tokens", F.round(F.col("total") / F.col("n_prompts"), 6).alias("mean_tokens"),
                         F.kll_sketch_get_quantile_bigint("sketch", F.lit(quantile)).alias("quantile_tokens"), "n_prompts")
