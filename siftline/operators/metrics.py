"""Predictions against truth: alignment, overall and category metrics, error reports.

Both sides are tables (id, is_flaky, category) with unique ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.answers import YES
from siftline.functions.labels import CATEGORIES


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(a, b).cast("double"), F.lit(0.0))


def last_by_id(df: DataFrame, order: str) -> DataFrame:
    """One row for each id, the last by ``order``; ids are compared as integers, others dropped."""
    cols = [c for c in df.columns if c not in ("id", order)]
    kept = df.withColumn("id", F.expr("try_cast(id AS bigint)")).filter("id is not null")
    return kept.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("id", "r.*")


def align(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, pred_flaky, pred_category, true_flaky, true_category) of ids on both sides."""
    p = pred.select("id", F.col("is_flaky").alias("pred_flaky"), F.col("category").alias("pred_category"))
    t = truth.select("id", F.col("is_flaky").alias("true_flaky"), F.col("category").alias("true_category"))
    return p.join(t, "id")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose id is not in ``right``."""
    return left.join(right.select("id"), "id", "left_anti")


def overall_metrics(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """One row (one for each ``by``): counts, accuracies, confusion of the verdict, precision, recall
    and F1; every ratio with an empty denominator is 0."""
    verdict = F.col("pred_flaky") == F.col("true_flaky")
    category = F.col("pred_category") == F.col("true_category")
    p, t = F.col("pred_flaky") == YES, F.col("true_flaky") == YES
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    agg = aligned.groupBy(*by).agg(
        F.count("*").alias("total"),
        n(verdict & category).alias("both_right"),
        n(verdict).alias("verdict_right"),
        n(category).alias("category_right"),
        n(p & t).alias("tp"),
        n(p & ~t).alias("fp"),
        n(~p & ~t).alias("tn"),
        n(~p & t).alias("fn"),
    )
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return (
        agg.withColumn("overall_accuracy", ratio("both_right", "total"))
        .withColumn("verdict_accuracy", ratio("verdict_right", "total"))
        .withColumn("category_accuracy", ratio("category_right", "total"))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .drop("both_right", "verdict_right", "category_right")
    )


def per_category_metrics(aligned: DataFrame) -> DataFrame:
    """(category, total, tp, fn, fp, accuracy, precision, recall, f1) of true categories with rows. A
    false positive is charged to the predicted category only where the truth is a known one."""
    known = aligned.filter(F.col("true_category").isin(CATEGORIES))
    hit = F.coalesce(F.col("pred_category") == F.col("true_category"), F.lit(False))
    true = known.groupBy(F.col("true_category").alias("category")).agg(F.count("*").alias("total"), F.count_if(hit).alias("tp"))
    wrong = known.filter(~hit & F.col("pred_category").isin(CATEGORIES)).groupBy(F.col("pred_category").alias("category")).agg(F.count("*").alias("fp"))
    m = true.join(wrong, "category", "left").select("category", "total", "tp", (F.col("total") - F.col("tp")).alias("fn"), F.coalesce("fp", F.lit(0)).alias("fp"))
    m = m.withColumn("accuracy", ratio("tp", "total")).withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", "total"))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def error_cases(aligned: DataFrame) -> DataFrame:
    """(id, predicted, actual, error_type) of rows that are not fully right."""
    flaky = ~F.col("pred_flaky").eqNullSafe(F.col("true_flaky"))
    category = ~F.col("pred_category").eqNullSafe(F.col("true_category"))
    return aligned.filter(flaky | category).select(
        "id",
        F.concat_ws(" - ", "pred_flaky", "pred_category").alias("predicted"),
        F.concat_ws(" - ", "true_flaky", "true_category").alias("actual"),
        F.when(flaky & category, "both").when(flaky, "flaky").otherwise("category").alias("error_type"),
    )


def error_group_counts(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count_if(F.col("error_type").isin("flaky", "both")).alias("n_flaky"), F.count_if(F.col("error_type").isin("category", "both")).alias("n_category"))


def error_transitions(errors: DataFrame) -> DataFrame:
    """(actual_category, predicted_category, n) of category errors."""
    part = lambda c: F.get(F.split(c, " - "), F.lit(1))
    rows = errors.filter(F.col("error_type").isin("category", "both"))
    return rows.groupBy(part(F.col("actual")).alias("actual_category"), part(F.col("predicted")).alias("predicted_category")).agg(F.count("*").alias("n"))


def top_errors(errors: DataFrame, n: int = 20) -> DataFrame:
    """The first n errors by id of each kind (flaky and both; category and both)."""
    kinds = errors.select("*", F.explode(F.array_compact(F.array(F.when(F.col("error_type") != "category", "flaky"), F.when(F.col("error_type") != "flaky", "category")))).alias("kind"))
    w = Window.partitionBy("kind").orderBy("id")
    return kinds.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_distribution(truth: DataFrame) -> DataFrame:
    """(category, n, percent, bar): the bar has one block for each two percent."""
    n = truth.groupBy("category").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    share = F.col("n") * 100.0 / F.col("total")
    return n.join(F.broadcast(total)).select("category", "n", share.alias("percent"), F.repeat(F.lit("█"), F.floor(share / 2).cast("int")).alias("bar"))


def performance_bands(overall: DataFrame) -> DataFrame:
    """(flaky_band, category_band) of a metrics row."""
    band = lambda c, hi, mid: F.when(c >= hi, "excellent").when(c >= mid, "good").otherwise("poor")
    return overall.select(band(F.col("f1"), 0.9, 0.7).alias("flaky_band"), band(F.col("category_accuracy"), 0.8, 0.6).alias("category_band"))
