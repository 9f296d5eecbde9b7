from pyspark.sql import functions as F

from scopekit.operators import evaluate as E
from scopekit.plans import fixtures as FX
from tests.conftest import SF_SMALL


def _acc(spark, pred, truth):
    return {(r.model, r.key): (r.n, r.strict_correct, r.tolerant_correct, r.graceful_correct)
            for r in E.value_accuracy(E.evaluation_counts(pred, truth)).collect()}


def test_permuted_truth_gives_same_accuracy(spark):
    pred, truth = FX.predictions(spark, SF_SMALL), FX.ground_truth(spark, SF_SMALL)
    shuffled = truth.orderBy(F.rand(3)).repartition(5)
    assert _acc(spark, pred, truth) == _acc(spark, pred, shuffled)


def test_partition_count_does_not_change_results(spark):
    pred, truth = FX.predictions(spark, SF_SMALL), FX.ground_truth(spark, SF_SMALL)
    a = _acc(spark, pred.repartition(1), truth)
    b = _acc(spark, pred.repartition(13), truth.repartition(3))
    assert a == b


def test_failed_rows_are_masked_and_nulls_count(spark):
    pred = spark.createDataFrame([("m", "1", -1, -1, -1, [-1]), ("m", "2", None, 5, 7, [1]), ("m", "3", 4, 5, 7, [])],
                                 "model string, id string, scope_1 bigint, scope_2 bigint, scope_3 bigint, sources array<bigint>")
    truth = spark.createDataFrame([("1", 1.0, 5.0, None, 7.0, [1], [1], [1], []), ("2", None, 5.0, None, 7.0, [1], [1], [1], []),
                                   ("3", 4.0, None, None, 70.0, [9], [1], [1], [])],
                                  "id string, scope_1 double, scope_2_market double, scope_2_location double, scope_3 double, "
                                  "scope_1_page array<int>, scope_2_market_page array<int>, scope_2_location_page array<int>, "
                                  "scope_3_page array<int>")
    acc = _acc(spark, pred, truth)
    assert acc[("m", "scope_1")] == (2, 2, 2, 2)
    assert acc[("m", "scope_2")] == (2, 1, 1, 1)
    assert acc[("m", "scope_3")] == (2, 1, 1, 2)
    counts = E.evaluation_counts(pred, truth)
    src = E.source_accuracy(counts).first()
    assert (src.n, src.correct) == (3, 1)  # failed row is wrong and counted
    src_ex = E.source_accuracy(counts, exclude_failed=True).first()
    assert (src_ex.n, src_ex.correct) == (2, 1)


def test_unmatched_predictions_are_reported(spark):
    pred = spark.createDataFrame([("m", "1"), ("m", "9")], "model string, id string")
    truth = spark.createDataFrame([("1",)], "id string")
    assert [r.id for r in E.unmatched_predictions(pred, truth).collect()] == ["9"]


def test_empty_input_gives_null_accuracy(spark):
    pred = FX.predictions(spark, SF_SMALL).where(F.lit(False))
    acc = E.value_accuracy(E.evaluation_counts(pred, FX.ground_truth(spark, SF_SMALL)))
    assert acc.count() == 0


def test_metric_table_shape(spark):
    pred, truth = FX.predictions(spark, SF_SMALL), FX.ground_truth(spark, SF_SMALL)
    t = E.metric_table(E.evaluation_counts(pred, truth))
    assert t.columns == ["model", "mode", "scope_1", "scope_2", "scope_3", "average", "sources"]
    assert t.count() == 4 * 3


def test_nan_and_huge_truth_values(spark):
    from scopekit.operators import evaluate as E
    nan = float("nan")
    truth = spark.createDataFrame([("a", nan, nan, 7.0, 1e19, [1]), ("b", 1e19, None, nan, None, [1])],
                                  "id string, scope_1 double, scope_2_market double, scope_2_location double, scope_3 double, scope_1_page array<int>")
    truth = truth.selectExpr("*", "scope_1_page AS scope_2_market_page", "scope_1_page AS scope_2_location_page", "scope_1_page AS scope_3_page")
    pred = spark.createDataFrame([("m", "a", None, 7, 1, [1]), ("m", "b", 1, None, None, [2])],
                                 "model string, id string, scope_1 bigint, scope_2 bigint, scope_3 bigint, sources array<bigint>")
    r = E.evaluation_counts(pred, truth).collect()[0]
    assert (r.strict__scope_1, r.strict__scope_2, r.strict__scope_3) == (1, 2, 1)
    assert (r.graceful__scope_1, r.graceful__scope_3) == (2, 2)   # 1e19 without trailing zeros is 1
