"""Exact token counts against the tokenizer itself, end markers by model, instructions from template files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions import tokens as TK
from scopekit.functions.records import trim_marker
from scopekit.operators import prompts as PR
from scopekit.plans import fixtures as FX
from scopekit.plans import jobs
from scopekit.session import shared_dir
from tests.conftest import SF_SMALL


def _local(uri):
    return uri[len("file:"):] if uri.startswith("file:") else uri


def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(TK.tokenizer_file())
    docs = FX.documents(spark, SF_SMALL)
    got = {r.doc_id: r.n_tokens for r in TK.exact_token_counts(docs, "text", TK.tokenizer_file()).collect()}
    want = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert got == want and len(got) > 100


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "word " * 20_000, 7)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in TK.exact_token_counts(df, "text", TK.tokenizer_file()).collect()}
    assert got[1] is None and got[2] == 0 and got[3] >= 20_000
    assert TK.exact_token_counts(df.limit(0), "text", TK.tokenizer_file()).collect() == []
    stats = PR.prompt_stats(TK.exact_token_counts(df, "text", TK.tokenizer_file()), tokens_col="n_tokens").first()
    assert stats.n_prompts == 2 and stats.max_tokens == got[3] and stats.min_tokens == 0


def test_a_file_that_is_no_vocabulary(tmp_path, monkeypatch, spark):
    monkeypatch.setattr(TK, "VOCABULARY_LIMIT", 10)
    with pytest.raises(ValueError):
        TK.exact_token_counts(spark.range(1).select(F.lit("x").alias("text")), "text", TK.tokenizer_file())


def test_marker_of_each_row(spark):
    rows = [("mistral", "x</s>"), ("openchat", "x<|end_of_turn|>"), ("qwen", "x[PAD151643]"), ("qwen", "x</s>"), ("miqu", "x</s></s>"), ("mixtral", None)]
    df = spark.createDataFrame(rows, "model string, t string")
    assert [r[0] for r in df.select(trim_marker("t", PR.eos_marker("model"))).collect()] == ["x", "x", "x", "x</s>", "x</s>", None]
    assert spark.range(1).select(trim_marker(F.lit("x</s>"), F.lit(None).cast("string"))).first()[0] == "x</s>"


def test_instructions_from_template_files(spark, tmp_path):
    plain, chat = tmp_path / "plain.txt", tmp_path / "chat.jsonl"
    plain.write_text("Read this:")
    chat.write_text(json.dumps({"role": "user", "content": "Asked:\nwell"}) + "\n" + json.dumps({"role": "assistant", "content": "no"}) + "\n")
    pages = spark.createDataFrame([(3, 0, "Scope 1 here")], "doc_id bigint, page_no int, page_text string")
    out = shared_dir(spark, "template-prompts")
    jobs.build_prompt_table(pages, pages.select("doc_id"), out, mode="text", template=str(plain))
    pre, suf = FV.CHAT_WRAPPERS["mistral"]
    chunk = '<CHUNK id="0">\nScope 1 here\n</CHUNK>\n'
    assert spark.read.parquet(out).first().prompt == pre + "Read this:\n" + chunk + suf + FV.ANSWER_START
    responses, cache, sets = (_local(shared_dir(spark, n)) for n in ("t-responses", "t-cache", "t-set"))
    os.makedirs(responses)
    os.makedirs(cache)
    (open(f"{responses}/3.json", "w")).write("{}")
    jobs.training_set_from_files(spark, responses, cache, pages, sets, mode="text", rebuild=True, template=str(chat))
    assert spark.read.json(sets).first().prompt == "Asked:\nwell\n" + chunk[:-1]
