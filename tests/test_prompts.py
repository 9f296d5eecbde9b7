
from scopekit import fixed_values as FV
from scopekit.operators import prompts as PR
from scopekit.sources.config import model_config


def test_context_plan_edges(spark):
    cfg = spark.createDataFrame([("m32k", 32768), ("m2k", 2048)], "model string, context_size int")
    # token estimate is ceil(len / 3.5): build prompts with a chosen token count
    def prompt(tokens):
        return "x" * int(tokens * 3.5)
    rows = [(1, "m32k", prompt(30000)), (2, "m32k", prompt(32648)), (3, "m32k", prompt(32649)),
            (4, "m2k", prompt(5000))]
    prompts = spark.createDataFrame(rows, "doc_id bigint, model string, prompt string")
    got = {r.doc_id: (r.context, r.group_neighbour, r.group_window)
           for r in PR.context_plan(prompts, cfg, max_neighbour=8, max_window=2048).collect()}
    assert got[1] == (30120, 1, 512)
    assert got[2] == (32768, 1, 512)
    assert got[3] == (32769, 8, 2048)
    assert got[4] == (5120, 8, 1024)


def test_qwen_tokens_scaled(spark):
    cfg = spark.createDataFrame([("qwen", 8192)], "model string, context_size int")
    prompts = spark.createDataFrame([(1, "qwen", "x" * 350)], "doc_id bigint, model string, prompt string")
    r = PR.context_plan(prompts, cfg).first()
    assert r.prompt_tokens == 120  # int(100 * 1.2)


def test_model_config_literal(spark):
    got = {r.model: (r.context_size, r.model_path) for r in model_config(spark).collect()}
    assert got["mistral"] == (32768, "models/Mistral-7B-Instruct-v0.2")
    assert got["miqu"][0] == 32764 and len(got) == 5


def test_build_prompts_statuses(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    assembled = spark.createDataFrame([(1, False, "PAGES"), (2, True, None)],
                                      "doc_id bigint, over_budget boolean, user_message string")
    got = {r.doc_id: (r.status, r.prompt) for r in PR.build_prompts(ids, assembled).collect()}
    assert got[1] == ("ok", "[INST] " + FV.INSTRUCTION + "\nPAGES [/INST]" + FV.ANSWER_START)
    assert got[2] == ("over_budget", None)
    assert got[3] == ("no_relevant_pages", None)


def test_prompt_stats_median_interpolates(spark):
    df = spark.createDataFrame([("x" * 7,), ("x" * 14,), ("x" * 35,), ("x" * 70,)], "prompt string")
    r = PR.prompt_stats(df).first()
    assert (r.max_tokens, r.min_tokens, r.median_tokens, r.n_prompts) == (20, 2, 7.0, 4)
    assert abs(r.mean_tokens - 9.0) < 1e-9


def test_prompt_stats_approx_median(spark):
    df = spark.createDataFrame([("x" * (7 * k),) for k in range(1, 102)], "prompt string")
    exact = PR.prompt_stats(df).first().median_tokens
    approx = PR.prompt_stats(df, approx=True).first().median_tokens
    assert exact == 102.0 and abs(approx - exact) <= 2


def test_run_settings_by_name_or_explicit(spark):
    import pytest
    from scopekit.sources.config import run_settings
    assert tuple(run_settings(spark, "openchat").first()) == ("openchat", 8192, "models/openchat-3.5-0106")
    assert tuple(run_settings(spark, model_path="models/x/", context_size=4096).first()) == ("x", 4096, "models/x/")
    with pytest.raises(KeyError):
        run_settings(spark, "nope")
    with pytest.raises(ValueError):
        run_settings(spark)


def test_prompt_lengths_are_those_of_the_prompts(spark):
    from scopekit.operators import pages as P
    rows = [(1, 0, "Scope 1"), (1, 1, "x" * 50), (2, 0, "scope 2 \u20ac"), (2, 1, "scope 3"), (3, 0, "none")]
    units = P.page_units(spark.createDataFrame(rows, "doc_id bigint, page_no int, page_text string"), "text")
    budget = P.document_budget(units, 33)   # units of 32 and 34 characters before the last page
    ids = spark.createDataFrame([(1, "qwen"), (2, "mistral"), (3, "openchat"), (4, "qwen")], "doc_id bigint, model string")
    family = PR.chat_family("model")
    made = PR.build_prompts(ids, P.assemble_with_status(units, 33), family=family)
    want = {r.doc_id: (r.status, len(r.prompt) if r.prompt else None) for r in made.collect()}
    assert {r.doc_id: (r.status, r.prompt_chars) for r in PR.prompt_lengths(ids, budget, family=family).collect()} == want
    assert {s for s, _ in want.values()} == {"ok", "over_budget", "no_relevant_pages"}
