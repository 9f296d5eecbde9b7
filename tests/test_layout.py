"""Bucketed tables: joins and groupings on the key without an exchange, known again to another session."""

from pyspark.sql import functions as F

from scopekit.operators import batch as B
from scopekit.operators import evaluate as E
from scopekit.operators import training as T
from scopekit.plans import files as Q
from scopekit.plans import fixtures as FX
from scopekit.session import shared_dir
from scopekit.sources import layout as L
from tests.conftest import SF_SMALL


def _plan(spark, df):
    """The physical plan with sort-merge joins, as large tables get it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _below_join(plan):
    """The part of a plan from its first join on downwards."""
    lines = plan.split("\n")
    return "\n".join(lines[next(i for i, line in enumerate(lines) if "Join" in line):])


def test_resume_evaluation_and_training_join_without_exchange(spark):
    resume = _plan(spark, lambda: Q.q_bucketed_resume(spark, SF_SMALL))
    assert "SortMergeJoin" in resume and "Exchange" not in resume
    pred, truth = Q._bucketed(spark, FX.predictions(spark, SF_SMALL), "p"), Q._bucketed(spark, FX.ground_truth(spark, SF_SMALL), "t")
    evaluation = _plan(spark, lambda: E.evaluation_counts(pred, truth))
    assert "SortMergeJoin" in evaluation and "Exchange" not in _below_join(evaluation)
    assert evaluation.count("Exchange") == 1                     # the partial counts of each model
    training = _plan(spark, lambda: Q.q_bucketed_training(spark, SF_SMALL))
    assert training.count("SortMergeJoin") == 2 and "Exchange" not in training
    plain = _plan(spark, lambda: B.pending(FX.documents(spark, SF_SMALL, "doc_id"), FX.finished(spark, SF_SMALL).select(F.col("id").cast("bigint").alias("id"))))
    assert plain.count("Exchange") == 2


def test_a_bucketed_folder_is_known_again(spark):
    path = shared_dir(spark, "bucketed")
    rows = spark.range(1000).select((F.col("id") % 300).cast("string").alias("id"), F.col("id").alias("seq"), F.lit("r").alias("response"))
    L.write_bucketed(rows, "first", "id", 4, path)
    again = spark.table(L.register_bucketed(spark, "again", path, "id string, seq bigint, response string", "id", 4))
    assert again.count() == 1000 and T.last_response(again).count() == 300
    assert "Exchange" not in _plan(spark, lambda: T.last_response(again))


def test_buckets_follow_the_rows_of_the_largest_table(spark, monkeypatch):
    used = []
    write = L.write_bucketed
    monkeypatch.setattr(L, "BUCKET_ROWS", 500)
    monkeypatch.setattr(L, "write_bucketed", lambda df, name, key, buckets, path=None: used.append(buckets) or write(df, name, key, buckets, path))
    training = Q.q_bucketed_training(spark, SF_SMALL)
    rows = FX.raw_responses(spark, SF_SMALL).count()
    assert len(used) == 3 and len(set(used)) == 1 and used[0] * 500 >= rows > used[0] * 250
    from scopekit.plans.catalog import q_training_prompts
    assert sorted(map(tuple, training.collect())) == sorted(map(tuple, q_training_prompts(spark, SF_SMALL).select(*training.columns).collect()))
    assert [L.buckets_for_rows(n, 8) for n in (0, 4000, 4001, 16001)] == [8, 8, 16, 64]


def test_derived_tables_deal_their_source_rows_only(spark, monkeypatch):
    """No derived row is shuffled for its file, and none is dealt round robin, which sorts all rows of a task first."""
    dealt, frame = [], type(spark.range(1))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *by: dealt.append((sorted(df.columns), len(by))) or repartition(df, n, *by))
    monkeypatch.setattr(FX, "_WRITTEN", {})
    for table in (FX.ground_truth, FX.predictions, FX.raw_responses, FX.report_pages, FX.prompt_cache):
        assert table(spark, SF_SMALL).count() > 0
    orders, docs = (["o_orderkey", "o_totalprice"], 1), (["doc_id", "text"], 1)
    assert sorted(dealt) == sorted([orders, orders, docs])


def test_rows_that_their_files_spread_are_not_dealt_again(spark, tmp_path):
    n = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("text"))
    for files, exchanges in ((8 * n, 0), (1, 1)):
        path = str(tmp_path / f"in{files}.parquet")
        rows.repartition(files).write.parquet(path)
        dealt = FX.spread(spark.read.parquet(path))
        assert dealt._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == exchanges
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    assert FX.spread(spark.read.parquet(path).where("doc_id < 0")).count() == 0


def test_buckets_follow_the_size():
    assert [L.buckets_for(n) for n in (0, 1, L.BUCKET_BYTES, L.BUCKET_BYTES + 1, 100 * 10 ** 12)] == [1, 1, 1, 2, 524288]
