import pandas as pd
from pyspark.sql import functions as F

from scopekit.operators import batch as B
from scopekit.session import shared_dir
from scopekit.sources import sinks


def test_resume_twice_scores_nothing(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"))
    out = shared_dir(spark, "resume")
    done = spark.createDataFrame([], "id bigint")
    first = B.pending(docs, done)
    assert first.count() == 50
    sinks.append_records(first.select(F.lit("m").alias("model"), F.col("doc_id").alias("id")), out)
    again = B.pending(docs, spark.read.parquet(out).select("id"))
    assert again.count() == 0


def test_scorer_errors_become_stubs(spark):
    def flaky(prompts: pd.Series) -> pd.Series:
        if (prompts == "boom").any():
            raise RuntimeError("model crashed")
        return prompts.map(lambda p: '{"scope_1":1,"scope_2":2,"scope_3":null,"sources":[3]}')
    prompts = spark.createDataFrame([(1, "ok", "fine"), (2, "ok", "boom"), (3, "over_budget", None),
                                     (4, "no_relevant_pages", None)], "doc_id bigint, status string, prompt string")
    got = {r.doc_id: (r.status, r.scope_1, r.sources) for r in B.batch_records(prompts, flaky).collect()}
    assert got == {1: ("ok", 1, [3]), 2: ("failed", -1, [-1]), 3: ("over_budget", -1, [-1]),
                   4: ("no_relevant_pages", None, [])}


def test_echo_scorer_output(spark):
    s = B.chunk_echo_scorer(pd.Series(['<CHUNK id="3">\nx\n</CHUNK>\n<CHUNK id="9">\n']))
    assert s.iloc[0].startswith('{"scope_1":2,') and s.iloc[0].endswith('"sources":[3,9]}</s>')
