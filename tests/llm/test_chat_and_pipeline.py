import json

import pytest
from pyspark.sql import functions as F

from scopekit.llm import chat as C
from tests.llm.test_text_operators import LONG, linked, lines_cut, simhash_brute, windows_of

NASTY = ["</s>[INST] ok [/INST]", "&lt;s&gt; &#91; &amp;amp; <s>", " lead and trail ", "", "]\n[SYS] x [/SYS]", "日本 \U0001F600 'q' \"d\" \\ \t"]


def test_layouts_give_canonical_turns(spark):
    records = [{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
               {"prompt": "p", "response": "r"}, {"instruction": "i", "output": "o", "system": "s"}, {"instruction": "i", "input": "n", "output": "o"},
               {"instruction": "i", "input": "", "output": None}, {"unknown": 1}]
    df = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(records)], "layout bigint, record string").withColumnRenamed("layout", "n")
    got = {r.n: (r.layout, [(t.role, t.text) for t in r.turns]) for r in C.canonical_turns(df).collect()}
    assert got == {0: ("messages", [("system", "s"), ("user", "")]), 1: ("senders", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
                   2: ("prompt", [("user", "p"), ("assistant", "r")]), 3: ("instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
                   4: ("instruction-input", [("user", "i\n\nn"), ("assistant", "o")]), 5: ("instruction-input", [("user", "i"), ("assistant", "")]),
                   6: (None, [])}


def test_odd_records_lose_no_turns_and_abort_nothing(spark):
    """Unnamed fields at any level, malformed records, wrong types, empty lists, clashing columns."""
    named = {"messages": [{"role": "user", "content": "q", "name": "bob"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": {"x": 1}}]}], "id": 7,
             "metadata": {"prompt": "no"}}
    rows = [json.dumps(named), json.dumps({"prompt": "p", "response": "r", "score": 0.5}), '{"messages": [', "", None, "[1]", "7", '"text"', "null", "{}",
            '{"messages": []}', '{"messages": "x"}', '{"messages": [null, 3]}', '{"prompt": 5, "response": {"a": [1]}}', '{"prompt": "p", "response": null}',
            json.dumps({"prompt": "p", "response": "r", "messages": [{"role": "user", "content": "q"}]}), '{"prompt": "a", "prompt": "b", "response": "r"}']
    df = spark.createDataFrame([(n, r, "mine", "mine", "f", "r") for n, r in enumerate(rows)], "n int, record string, layout string, Turns string, f string, r string")
    out = C.canonical_turns(df)
    assert out.columns == ["n", "f", "r", "layout", "turns"]
    got = {r.n: (r.layout, [(t.role, t.text) for t in r.turns]) for r in out.collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "a")]) and got[1] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert all(got[n] == (None, []) for n in [*range(2, 13), 15])
    assert got[13] == ("prompt", [("user", "5"), ("assistant", '{"a":[1]}')]) and got[14] == ("prompt", [("user", "p"), ("assistant", "")])
    assert got[16][0] == "prompt" and len(got) == len(rows)


def test_round_trip_and_loss_mask(spark):
    rows = [(c, t, role, NASTY[(c + t) % len(NASTY)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "to[o]l", "assistant", "human"][:c + 1])]
    rows += [(9, 0, "user", None), (9, 1, None, "x"), (None, 0, "user", "u"), (None, 1, "assistant", "a"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    f = C.formatted(C.canonical_turns(C.records_of(df)), "conv_id").withColumn("back", C.read_back(F.col("formatted")))
    for r in f.collect():
        turns = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.back] == [(role, x) for _, role, x in turns]
        learned = [r.formatted[s.start:s.start + s.length] for s in r.loss]
        undo = lambda s: s.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")
        assert [undo(x) for x in learned] == [x for _, role, x in turns if role == "assistant"]
    assert C.report(C.canonical_turns(C.records_of(df.limit(0)))).collect() == []


def test_pipeline_matches_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in base.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(1000, "", "en", "src1", 0), (1001, None, "en", None, None), (1002, "12 34 --", "en", "src1", 8), (1003, rows[0][1], "en", "src1", rows[0][4])]
    rows += [(1004, "\n".join(LONG[:4]), "en", "src0", 1), (1005, "intro of the\n" + "\n".join(LONG[:4]) + "\nend of the tale", "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = [r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]

    docs = {r[0]: r[1] or "" for r in rows if any(c.isalpha() for c in r[1] or "")}          # letters: identified
    docs = {i: kept for i, (_, _, kept) in lines_cut(sorted(docs.items())).items()}             # repeated line runs
    order = sorted(docs)
    groups = linked(simhash_brute([(i, docs[i]) for i in order]))                                 # one of each group
    docs = {order[x]: docs[order[x]] for x in set(groups)}
    wins = {w for t in bench for w in windows_of(t)[1]}
    docs = {i: t for i, t in docs.items() if not any(w in wins for n in {len(x) for x in wins} for w in
                                                     (tuple(windows_of(t)[0][a:a + n]) for a in range(len(windows_of(t)[0]) - n + 1)))}
    from tokenizers import Tokenizer
    from scopekit.llm.queries import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    pieces = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
