"""Hot keys: one document or conversation that holds most rows."""

from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.operators import pages as P
from scopekit.operators import training as T


def test_hot_document(spark):
    """4,000 pages, every fourth relevant: the text is the relevant pages in order, at every partitioning."""
    rows = [(999, i, "Scope 3 y" if i % 4 == 0 else "z") for i in range(4000)] + [(d, 0, "Scope 1") for d in range(30)]
    pages = spark.createDataFrame(rows, "doc_id bigint, page_no int, page_text string").repartition(7)
    units = P.page_units(pages, "text")
    got = {r.doc_id: r.user_message for r in P.assemble_with_status(units, 10 ** 7).collect()}
    assert got[999] == "".join(f'<CHUNK id="{i}">\nScope 3 y\n</CHUNK>\n' for i in range(0, 4000, 4))
    assert all(got[d] == '<CHUNK id="0">\nScope 1\n</CHUNK>\n' for d in range(30))
    over = {r.doc_id: r.over_budget for r in P.document_budget(units, 500).collect()}
    assert over[999] and not any(over[d] for d in range(30))
    for limit, block in ((500, 1024), (500, 3), (39, 64)):   # blocks over the limit drop their text, others keep it
        got = {r.doc_id: (r.over_budget, r.n_chunks, r.user_message) for r in P.assemble_with_status(units, limit, block).collect()}
        assert got[999] == (True, 0, None) and len(got) == 31
        assert all(got[d] == (False, 1, '<CHUNK id="0">\nScope 1\n</CHUNK>\n') for d in range(30))


def test_assembly_reads_the_pages_once(spark):
    pages = spark.createDataFrame([(1, 0, "scope 1")], "doc_id bigint, page_no int, page_text string")
    plan = P.assemble_with_status(P.page_units(pages, "xhtml"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan


def test_prompts_to_rebuild_judges_the_last_response(spark):
    stub = FV.STUB_JSON
    rows = [("a", 1, stub), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, stub), ("c", 1, "x"), ("d", 1, None), ("e", 1, stub), ("e", 2, None)]
    df = spark.createDataFrame(rows, "id string, seq int, response string")
    cached = spark.createDataFrame([("c",)], "id string")
    assert sorted(r.id for r in T.prompts_to_rebuild(df, None, "seq").collect()) == ["a", "c"]
    assert [r.id for r in T.prompts_to_rebuild(df, cached, "seq").collect()] == ["a"]
    assert sorted(r.id for r in T.prompts_to_rebuild(T.last_response(df)).collect()) == ["a", "c"]


def test_long_conversation(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(3000)]
    turns += [(2, 0, "user", "q"), (2, 1, "user", "q2"), (2, 20000, "assistant", "a")]  # a gap over several blocks
    conv = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    pairs = T.chat_pairs(conv)
    assert pairs.where(F.col("conv_id") == 1).count() == 1500
    assert [(r.turn, r.prompt, r.completion) for r in pairs.where(F.col("conv_id") == 2).collect()] == [(1, "q2", "a")]
