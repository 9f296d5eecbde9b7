"""Page selection, size budget and document assembly.

Plan shape: the budget alone is a plain aggregation by ``doc_id`` (partial
aggregation map-side, so a document holding a large share of all pages is
combined before the shuffle). Assembly is one pass of nested aggregations by page
block, which carry the budget along: one document's pages are concatenated by many
tasks, and a block beyond the budget drops its text at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.text import clean_markup, is_relevant, markup_to_text, wrap_chunk
from scopekit.sources.pages import check_mode


def budget_chars(max_tokens: int = FV.DEFAULT_MAX_TOKENS,
                 chars_per_token: float = FV.CHARACTERS_PER_TOKEN) -> float:
    return float(max_tokens) * float(chars_per_token)


def page_units(pages: DataFrame, mode: str = "xhtml") -> DataFrame:
    """Adds ``unit`` (the page as appended to the prompt) and ``relevant``.

    mode 'text': relevance on the page text, unit = CHUNK-wrapped text.
    mode 'xhtml': unit = cleaned markup + newline, relevance on its text nodes.
    """
    check_mode(mode)
    if mode == "text":
        unit = wrap_chunk("page_no", "page_text")
        relevant = is_relevant("page_text")
        return pages.select("doc_id", "page_no", unit.alias("unit"), relevant.alias("relevant"))
    cleaned = pages.select("doc_id", "page_no",
                           F.concat(clean_markup("page_text", "page_no"), F.lit("\n")).alias("unit"))
    return cleaned.select("doc_id", "page_no", "unit", is_relevant(markup_to_text("unit")).alias("relevant"))


def relevant_pages(units: DataFrame) -> DataFrame:
    return units.where(F.col("relevant")).select("doc_id", "page_no", "unit")


def units_of(units: DataFrame, only: DataFrame) -> DataFrame:
    """The units of the documents in ``only`` (doc_id, each once), without the text of irrelevant ones, which no document holds.

    The text is dropped before the join, so only relevant text is shuffled. The join is an inner one: Catalyst would move a
    semi join below the projection that drops the text, and an aggregate that makes the ids distinct here would
    keep adaptive execution from splitting a document with a large share of all pages.
    """
    narrow = units.withColumn("unit", F.when(F.col("relevant"), F.col("unit")))
    return narrow.join(only.select("doc_id"), "doc_id")


def document_budget(units: DataFrame, limit_chars: float | None = None) -> DataFrame:
    """Per document: pages, relevant pages, relevant characters and the budget flag.

    The sequential rule stops before a page once the relevant text gathered so
    far exceeds the limit; the running total only grows, so a document is over
    budget exactly when its relevant text before the last page exceeds it.
    """
    limit = budget_chars() if limit_chars is None else float(limit_chars)
    rel_len = F.when(F.col("relevant"), F.length("unit")).otherwise(F.lit(0)).cast("bigint")
    agg = (units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.max("page_no").alias("last_page"),
        F.count_if(F.col("relevant")).alias("n_relevant"),
        F.sum(rel_len).alias("relevant_chars"),
        F.max_by(rel_len, F.col("page_no")).alias("last_page_chars"),
    ))
    before_last = F.col("relevant_chars") - F.col("last_page_chars")
    return agg.select("doc_id", "n_pages", "n_relevant", "relevant_chars",
                      before_last.alias("chars_before_last_page"),
                      (before_last > F.lit(limit)).alias("over_budget"), "last_page")


# Pages (then blocks) that one group of the assembly joins; page numbers are ints, so three levels cover them all.
PAGE_BLOCK = 1024


def assemble_with_status(units: DataFrame, limit_chars: float | None = None, block_pages: int = PAGE_BLOCK) -> DataFrame:
    """(doc_id, over_budget, n_chunks, user_message) for every document with a relevant page.

    One pass over the units, which are neither joined nor read again for the budget. Pages are joined in blocks of
    ``block_pages`` page numbers, blocks in blocks of blocks, those in documents, each level an ordered
    ``listagg`` that also adds up what ``document_budget`` needs. A group whose relevant text before its last page exceeds
    the limit belongs to a document over budget and drops its text there and then; all other groups hold the limit plus
    one page at most. So a document with a large share of all pages is spread over many tasks, and no group
    is larger than one block. ``user_message`` is null for over-budget documents.
    """
    limit = F.lit(budget_chars() if limit_chars is None else float(limit_chars))
    n = int(block_pages)
    level = units.select("doc_id", F.col("page_no").cast("bigint").alias("at"), F.col("page_no").alias("last_page"),
                         F.col("relevant").cast("bigint").alias("n_chunks"),
                         F.when(F.col("relevant"), F.length("unit")).otherwise(F.lit(0)).cast("bigint").alias("chars"),
                         F.when(F.col("relevant"), F.col("unit")).alias("part"))
    level = level.withColumn("last_chars", F.col("chars"))
    for keys in (["doc_id", "block"], ["doc_id", "block"], ["doc_id"]):
        over = F.expr("sum(chars) - max_by(last_chars, last_page)") > limit
        parts = level.withColumn("block", F.expr(f"at DIV {n}")).groupBy(*keys).agg(
            F.max("last_page").alias("last_page"), F.sum("n_chunks").alias("n_chunks"), F.sum("chars").alias("chars"),
            F.max_by("last_chars", "last_page").alias("last_chars"), over.alias("over_budget"),
            F.when(~over, F.expr("listagg(part, '') WITHIN GROUP (ORDER BY at)")).alias("part"))
        level = parts.withColumnRenamed("block", "at")
    return level.where("n_chunks > 0").select(
        "doc_id", "over_budget", F.when(F.col("over_budget"), F.lit(0)).otherwise(F.col("n_chunks")).cast("bigint").alias("n_chunks"),
        F.col("part").alias("user_message"))


def assemble_documents(units: DataFrame, limit_chars: float | None = None) -> DataFrame:
    """(doc_id, n_chunks, user_message): ordered concatenation of the relevant pages of
    every document that has some and is within budget."""
    return (assemble_with_status(units, limit_chars).where(~F.col("over_budget"))
            .select("doc_id", "n_chunks", "user_message"))
