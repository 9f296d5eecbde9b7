import pytest

from scopekit.operators import pages as P
from scopekit.sources.pages import check_mode, split_pages

DOCS = {1: ["intro", "Scope 1: 10", "none", "scope two here"], 2: ["nothing", "at all"], 3: ["Scope 3", "scope 1", "x"],
        4: ["Scope 2"]}
# document -> its prompt text when nothing is over budget
TEXT = {1: '<CHUNK id="1">\nScope 1: 10\n</CHUNK>\n<CHUNK id="3">\nscope two here\n</CHUNK>\n',
        3: '<CHUNK id="0">\nScope 3\n</CHUNK>\n<CHUNK id="1">\nscope 1\n</CHUNK>\n',
        4: '<CHUNK id="0">\nScope 2\n</CHUNK>\n'}
XHTML = {1: "Scope 1: 10\nscope two here\n", 3: "Scope 3\nscope 1\n", 4: "Scope 2\n"}
# (limit, documents over budget): a document is over when its relevant units before the last page are longer
# than the limit; here 36 characters (document 1) and 64 (document 3)
OVER_TEXT = [(0, {1, 3}), (35, {1, 3}), (36, {3}), (63, {3}), (64, set()), (10 ** 6, set())]


def page_table(spark, docs, parts=5):
    rows = [(d, i, t) for d, pages in docs.items() for i, t in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, page_text string").repartition(parts)


def assembled(units, limit, **more):
    return {r.doc_id: (r.over_budget, r.user_message)
            for r in P.assemble_with_status(units, limit, **more).collect()}


@pytest.mark.parametrize("limit,over", OVER_TEXT)
def test_budget_and_assembly(spark, limit, over):
    units = P.page_units(page_table(spark, DOCS), "text")
    flags = {r.doc_id: r.over_budget for r in P.document_budget(units, limit).collect()}
    assert {d for d, o in flags.items() if o} == over
    got = {r.doc_id: r.user_message for r in P.assemble_documents(units, limit).collect()}
    assert got == {d: t for d, t in TEXT.items() if d not in over}


def test_xhtml_units_are_not_wrapped(spark):
    units = P.page_units(page_table(spark, DOCS), "xhtml")
    got = {r.doc_id: r.user_message for r in P.assemble_documents(units, 10 ** 6).collect()}
    assert got == XHTML


def test_split_pages_numbers_from_zero(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.page_no, r.page_text) for r in split_pages(df).orderBy("doc_id", "page_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "")]


def test_unknown_mode_is_rejected_before_planning():
    with pytest.raises(ValueError):
        check_mode("pdf")


@pytest.mark.parametrize("parts,block", [(1, 256), (3, 1), (7, 3)])
def test_assembly_is_independent_of_partitions_and_blocks(spark, parts, block):
    units = P.page_units(page_table(spark, DOCS, parts), "text")
    got = assembled(units, 10 ** 6, block_pages=block)
    assert {d: m for d, (over, m) in got.items() if m} == TEXT


def test_units_of_some_documents_shuffle_relevant_text_only(spark):
    units = P.page_units(page_table(spark, DOCS, 3), "text")
    some = spark.createDataFrame([(1,), (2,), (4,), (9,), (None,)], "doc_id bigint")
    picked = P.units_of(units, some)
    assert {(r.doc_id, r.page_no): r.unit for r in picked.collect() if not r.relevant} == {(1, 0): None, (1, 2): None, (2, 0): None, (2, 1): None}
    for limit, over in ((10 ** 6, set()), (35, {1})):
        got, whole = assembled(picked, limit), assembled(units, limit)
        assert got == {d: v for d, v in whole.items() if d in (1, 4)} and {d for d, v in got.items() if v[0]} == over
    plan = picked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("CHUNK" in line for line in plan[join:]) and not any("CHUNK" in line for line in plan[:join])


def test_training_shuffles_no_irrelevant_page_text(spark):
    """Below the join with the documents to rebuild, the text of irrelevant pages is dropped."""
    from scopekit.plans import catalog as Q
    from tests.conftest import SF_SMALL
    for query in (Q.q_training_prompts, Q.q_batch_score):
        plan = query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        pages = next(i for i, line in enumerate(plan) if "page_text" in line and "Relation" in line)
        dropped = max(i for i, line in enumerate(plan[:pages]) if "CASE WHEN relevant" in line and "unit" in line)
        joins = [i for i, line in enumerate(plan[:pages]) if "Join Inner" in line]
        assert joins and dropped > max(joins)
