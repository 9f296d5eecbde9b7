"""Scoring predictions against ground truth.

Plan shape: one scan of all models, one equi-join on ``id`` (broadcast only if
the optimizer's size estimate of the truth side is below the broadcast
threshold; otherwise a shuffle join, with adaptive skew splitting), long format
by ``stack`` (narrow), and one aggregation by (model, key) that computes the
three modes together. The aggregation is partial map-side, so a model holding
most rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.metrics import graceful_correct, pages_overlap, strict_correct, tolerant_correct
from scopekit.functions.records import is_stub

MODES = ("strict", "tolerant", "graceful")
_CHECKS = {"strict": strict_correct, "tolerant": tolerant_correct, "graceful": graceful_correct}


def _truth_value_columns() -> list:
    def value(c):  # NaN is a missing value
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return [value("scope_1").alias("scope_1"),
            F.coalesce(value("scope_2_market"), value("scope_2_location")).alias("scope_2"),
            value("scope_3").alias("scope_3")]


def truth_values(truth: DataFrame) -> DataFrame:
    """(id, scope_1, scope_2, scope_3): scope 2 is the market value, else the location value."""
    return truth.select("id", *_truth_value_columns())


def truth_page_set(truth: DataFrame, which: str = "scope_1") -> DataFrame:
    """(id, true_pages): the first listed page column ('scope_1', as the original
    evaluation compares) or the union of all page columns ('any')."""
    return truth.select("id", _true_pages(which).alias("true_pages"))


def _true_pages(which: str):
    if which == "scope_1":
        pages = F.col("scope_1_page")
    elif which == "any":
        cols = ["scope_1_page", "scope_2_market_page", "scope_2_location_page", "scope_3_page"]
        pages = F.array_sort(F.array_distinct(F.flatten(F.array(
            *[F.coalesce(F.col(c), F.array().cast("array<int>")) for c in cols]))))
    else:
        raise ValueError("truth pages must be 'scope_1' or 'any'")
    return pages.cast("array<bigint>")


def join_predictions(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, id, pred_*, true_*): predictions matched to truth by id, never by position."""
    t = truth_values(truth).select("id", *[F.col(k).alias(f"true_{k}") for k in FV.SCOPE_KEYS])
    p = pred.select("model", "id", *[F.col(k).cast("bigint").alias(f"pred_{k}") for k in FV.SCOPE_KEYS])
    return p.join(t, "id", "inner")


JOIN_ROWS = 1 << 19  # predictions that a task of the spread join sorts, more or less


def spread_by_id(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by id over a number of tasks that follows the rows, at least one per core: what a task of the joins sorts
    stays as large as it is however large the tables get, and a union of many models is shuffled once, not joined file by file."""
    from scopekit.session import default_parallelism
    tasks = max(default_parallelism(pred.sparkSession), -(-max(pred.count(), truth.count()) // JOIN_ROWS))
    return pred.repartition(tasks, "id"), truth.repartition(tasks, "id")


def unmatched_predictions(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted ids without a truth row (reported instead of silently misaligned).

    An outer join with the distinct ids: an anti join would be carried below a union of models, where one task sorts for
    the joins of all models at once."""
    known = truth.select(F.col("id").alias("_known")).distinct()
    return pred.select("id", "model").join(known, F.col("id") == F.col("_known"), "left").where(F.col("_known").isNull()).drop("_known")


def evaluation_counts(pred: DataFrame, truth: DataFrame, which: str = "scope_1",
                      keys=FV.SCOPE_KEYS) -> DataFrame:
    """One row per model with every count the metrics need, from one join and one aggregation.

    Per key: ``n__k`` rows whose prediction is not the failure value -1 (null
    predictions stay) and ``<mode>__k`` correct rows per mode. Sources:
    ``src_n``/``src_correct`` over all rows, ``src_n_ok``/``src_correct_ok``
    without failed rows. All aggregates are counts, combined map-side.
    """
    vals = dict(zip(FV.SCOPE_KEYS, _truth_value_columns()))
    t = truth.select("id", *[vals[k].alias(f"true_{k}") for k in keys], _true_pages(which).alias("true_pages"))
    p = pred.select("model", "id", *[F.col(k).cast("bigint").alias(f"pred_{k}") for k in keys],
                    "sources", is_stub().alias("failed"))
    j = p.join(t, "id", "inner")
    aggs = []
    for k in keys:
        kept = F.col(f"pred_{k}").isNull() | (F.col(f"pred_{k}") != F.lit(FV.FAILED_VALUE))
        aggs.append(F.count_if(kept).alias(f"n__{k}"))
        aggs += [F.count_if(kept & _CHECKS[m](f"pred_{k}", f"true_{k}")).alias(f"{m}__{k}") for m in MODES]
    hit = pages_overlap("sources", "true_pages")
    aggs += [F.count(F.lit(1)).alias("src_n"), F.count_if(hit).alias("src_correct"),
             F.count_if(~F.col("failed")).alias("src_n_ok"), F.count_if(hit & ~F.col("failed")).alias("src_correct_ok")]
    return j.groupBy("model").agg(*aggs)


def _ratio(num: str, den: str) -> F.Column:
    return F.round(F.when(F.col(den) > 0, F.col(num) / F.col(den)), 6)


def value_accuracy(counts: DataFrame, keys=FV.SCOPE_KEYS) -> DataFrame:
    """(model, key, n, strict_correct, tolerant_correct, graceful_correct, *_accuracy).

    The per-model counts are unpivoted to one row per key (a few rows per model).
    n = 0 gives a null accuracy.
    """
    parts = ", ".join(f"'{k}', n__{k}, " + ", ".join(f"{m}__{k}" for m in MODES) for k in keys)
    cols = ", ".join(["n", *[f"{m}_correct" for m in MODES]])
    long = counts.selectExpr("model", f"stack({len(keys)}, {parts}) AS (key, {cols})")
    return long.select("model", "key", "n", *[f"{m}_correct" for m in MODES],
                       *[_ratio(f"{m}_correct", "n").alias(f"{m}_accuracy") for m in MODES])


def mode_accuracy(acc: DataFrame, mode: str) -> DataFrame:
    """(model, key, n, correct, accuracy) of one mode."""
    if mode not in MODES:
        raise ValueError("mode must be strict, tolerant or graceful")
    return acc.select("model", "key", "n", F.col(f"{mode}_correct").alias("correct"),
                      F.col(f"{mode}_accuracy").alias("accuracy"))


def long_accuracy(acc: DataFrame) -> DataFrame:
    """(model, key, mode, n, correct, accuracy)."""
    parts = ", ".join(f"'{m}', {m}_correct, {m}_accuracy" for m in MODES)
    return acc.selectExpr("model", "key", "n", f"stack({len(MODES)}, {parts}) AS (mode, correct, accuracy)")


def average_accuracy(long: DataFrame) -> DataFrame:
    """(model, mode, n_keys, average): mean of the per-key accuracies, only with more than one key."""
    return (long.groupBy("model", "mode")
            .agg(F.count(F.lit(1)).alias("n_keys"), F.avg("accuracy").alias("average"))
            .where(F.col("n_keys") > 1)
            .select("model", "mode", "n_keys", F.round("average", 6).alias("average")))


def source_accuracy(counts: DataFrame, exclude_failed: bool = False) -> DataFrame:
    """(model, n, correct, accuracy): a row is correct when cited and true pages share a page.

    As evaluated originally, failed rows count as wrong and stay in the
    denominator; ``exclude_failed`` drops them instead.
    """
    n, c = ("src_n_ok", "src_correct_ok") if exclude_failed else ("src_n", "src_correct")
    return counts.select("model", F.col(n).alias("n"), F.col(c).alias("correct"), _ratio(c, n).alias("accuracy"))


def cited_true_pages(pred: DataFrame, truth: DataFrame, which: str = "scope_1") -> DataFrame:
    """(model, id, cited): the cited pages that are also true pages, sorted."""
    j = pred.select("model", "id", "sources").join(truth_page_set(truth, which), "id", "inner")
    return j.select("model", "id", F.array_sort(F.array_intersect("sources", "true_pages")).alias("cited"))


def metric_table(counts: DataFrame, keys=FV.SCOPE_KEYS, with_sources: bool = True, exclude_failed: bool = False) -> DataFrame:
    """One row per (model, mode), one column per key, plus ``average`` and ``sources``.

    A single projection over the per-model counts (one join and one
    aggregation upstream, no self-join): modes are unpivoted with ``stack``;
    the average is the mean of the available per-key accuracies, only with
    more than one key.
    """
    parts = ", ".join(f"'{m}', " + ", ".join(f"{m}__{k}" for k in keys) for m in MODES)
    sources = ["src_n_ok AS src_n", "src_correct_ok AS src_correct"] if exclude_failed else ["src_n", "src_correct"]
    by_mode = counts.selectExpr("model", *[f"n__{k}" for k in keys], *sources,
                                f"stack({len(MODES)}, {parts}) AS (mode, {', '.join('c__' + k for k in keys)})")
    acc = by_mode.select("model", "mode", "src_n", "src_correct",
                         *[_ratio(f"c__{k}", f"n__{k}").alias(k) for k in keys])
    present = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in keys), F.lit(0.0))
    average = F.round(F.when(F.lit(len(keys) > 1) & (present > 0), total / present), 6)
    cols = ["model", "mode", *keys, average.alias("average")]
    if with_sources:
        cols.append(_ratio("src_correct", "src_n").alias("sources"))
    return acc.select(*cols)


def failure_count(pred: DataFrame) -> DataFrame:
    """(model, n_reports, n_failed): reports whose output is the failure stub."""
    return pred.groupBy("model").agg(F.count(F.lit(1)).alias("n_reports"),
                                     F.count_if(is_stub()).alias("n_failed"))
