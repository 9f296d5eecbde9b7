"""Training records: supervised (prompt, completion) and preference (prompt, chosen, rejected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scopekit import fixed_values as FV
from scopekit.functions.records import random_record, record_json

TURN_BLOCK = 4096  # turn numbers looked at together


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, completion): a user turn directly followed by an assistant turn.

    The next turn is the next number present, gaps don't matter. It is looked up within
    blocks of turn numbers, so one very long conversation is spread over many tasks;
    the last turn of a block takes the first one of the conversation's next block.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURN_BLOCK).alias("block"))
    turn = F.struct("turn", "role", "text")
    firsts = rows.groupBy("conv_id", "block").agg(F.min(turn).alias("first"))
    firsts = firsts.select("conv_id", "block", F.lead("first").over(Window.partitionBy("conv_id").orderBy("block")).alias("across"))
    inside = rows.withColumn("next", F.lead(turn).over(Window.partitionBy("conv_id", "block").orderBy("turn")))
    both = inside.join(firsts, ["conv_id", "block"]).withColumn("next", F.coalesce("next", "across"))
    return both.where((F.col("role") == "user") & (F.col("next.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col("next.text").alias("completion"))


def drop_stubs(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Responses textually equal to the failure stub are not training data."""
    return responses.where(F.col(text_col) != F.lit(FV.STUB_JSON))


def last_response(responses: DataFrame, order_col: str = "seq", text_col: str = "response") -> DataFrame:
    """(id, response): per id the response loaded last. ``max_by`` aggregates
    partially, so an id with very many rows does not land in one task whole."""
    return responses.groupBy("id").agg(F.max_by(F.col(text_col), F.col(order_col)).alias(text_col))


def strip_wrapper(text, prefix: str, suffix: str) -> F.Column:
    """Remove a known prefix and suffix when both are present; otherwise keep the text."""
    t = F.col(text) if isinstance(text, str) else text
    inner = t.substr(F.lit(len(prefix) + 1), F.length(t) - F.lit(len(prefix) + len(suffix)))
    return F.when(t.startswith(F.lit(prefix)) & t.endswith(F.lit(suffix)) &
                  (F.length(t) >= F.lit(len(prefix) + len(suffix))), inner).otherwise(t)


def is_empty_prompt(content) -> F.Column:
    """A prompt whose content ends with the instruction's format block has no page text."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(c.rlike(FV.FORMAT_END + r"\s*$"), F.lit(False))


def prompts_to_rebuild(responses: DataFrame, cached: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
    """(id): documents with a response that is kept and no cached prompt; only their pages need reading.
    With ``order_col`` the response loaded last counts, of which only a flag is aggregated, not the text."""
    if order_col is None:
        ids = drop_stubs(responses).select("id").distinct()
    else:
        kept = F.max_by(F.col("response") != F.lit(FV.STUB_JSON), F.col(order_col))
        ids = responses.groupBy("id").agg(kept.alias("kept")).where("kept").select("id")
    return ids if cached is None else ids.join(cached.select("id"), "id", "left_anti")


def training_prompts(responses: DataFrame, cached: DataFrame | None, rebuilt: DataFrame,
                     instruction: str = FV.INSTRUCTION) -> DataFrame:
    """(id, prompt, completion) with the prompt taken from the cache when present, else rebuilt.

    ``cached``: (id, content) with the chat wrapper already removed; an empty
    cached prompt drops the row (no fallback). ``rebuilt``: (id, user_message)
    from the documents; a missing document or one without relevant pages drops
    the row. The rebuilt prompt is ``instruction + "\\n" + pages`` without the
    last newline. Without ``cached`` (None) every prompt is rebuilt.
    """
    r = drop_stubs(responses).select("id", F.col("response").alias("completion"))
    b = rebuilt.select("id", F.col("user_message").alias("pages"))
    if cached is None:
        r = r.withColumn("cached", F.lit(None).cast("string"))
    else:
        r = r.join(cached.select("id", F.col("content").alias("cached")), "id", "left")
    j = r.join(b, "id", "left")
    rebuilt_prompt = F.when(
        F.coalesce(F.length("pages"), F.lit(0)) > 0,
        F.concat(F.lit(instruction + "\n"), F.col("pages").substr(F.lit(1), F.length("pages") - F.lit(1))))
    prompt = (F.when(F.col("cached").isNotNull(),
                     F.when(~is_empty_prompt("cached"), F.col("cached")))
               .otherwise(rebuilt_prompt))
    return j.select("id", prompt.alias("prompt"), "completion").where(F.col("prompt").isNotNull())


def sft_records(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[c for c in pairs.columns if c not in ("prompt", "completion")], "prompt", "completion")


def rejected_records(pairs: DataFrame, id_col: F.Column, seed: int = 0) -> DataFrame:
    """Adds the columns of a reproducible wrong record for every row."""
    r = random_record(id_col, seed)
    return pairs.withColumn("_rej", r).select(
        *pairs.columns, *[F.col(f"_rej.{k}").alias(f"rejected_{k}") for k in FV.SCOPE_KEYS],
        F.col("_rej.sources").alias("rejected_sources"))


def dpo_records(pairs: DataFrame, id_col: F.Column, seed: int = 0) -> DataFrame:
    """(…, prompt, chosen, rejected): the completion is chosen, a random record is rejected."""
    r = random_record(id_col, seed)
    rejected = record_json(r["scope_1"], r["scope_2"], r["scope_3"], r["sources"])
    keep = [c for c in pairs.columns if c not in ("prompt", "completion")]
    return pairs.select(*keep, "prompt", F.col("completion").alias("chosen"), rejected.alias("rejected"))


TRAINING_TEMPLATES = {
    "sft_mistral": FV.SFT_TEMPLATE_MISTRAL,
    "sft_qwen": FV.SFT_TEMPLATE_QWEN,
    "dpo_mistral": FV.DPO_TEMPLATE_MISTRAL,
}


def template_table(spark) -> DataFrame:
    """(template, format): the three training formats (a fixed three-row table)."""
    return spark.createDataFrame(list(TRAINING_TEMPLATES.items()), "template string, format string")


def render_training_text(pairs: DataFrame, templates: DataFrame, template_col: str = "template") -> DataFrame:
    """Adds ``text``: the template with its placeholder replaced by the prompt, then the completion."""
    t = templates.select(F.col("template").alias(template_col), "format")
    j = pairs.join(t, template_col, "inner")
    filled = F.replace(F.replace(F.col("format"), F.lit("{instruction}"), F.col("prompt")),
                       F.lit("{prompt}"), F.col("prompt"))
    return j.select(*pairs.columns, F.concat(filled, F.col("completion")).alias("text"))
