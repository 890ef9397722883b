"""Evaluation of predictions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.answers import extract_answer, normalize_category
from siftline.operators.metrics import overall_metrics


def parsed_stream(items: DataFrame, received: str = "received_at", late: str = "7 days", text: str = "output", key: str = "item_id") -> DataFrame:
    """Parsed answers of a stream of items: each key once within the watermark, unparsed ones dropped."""
    once = items.withWatermark(received, late).dropDuplicatesWithinWatermark([key])
    parsed = once.select(key, "id", received, extract_answer(F.col(text)).alias("a")).filter("a.is_flaky is not null")
    return parsed.select(key, "id", received, "a.is_flaky", normalize_category(F.col("a.category")).alias("category"))


def windowed_metrics(parsed: DataFrame, truth: DataFrame, received: str = "received_at", width: str = "1 day") -> DataFrame:
    """Metrics of each window of arrival, against a static table of truth."""
    p = parsed.select("id", "is_flaky", "category", F.window(received, width).alias("arrived"))
    t = truth.select("id", F.col("is_flaky").alias("true_flaky"), F.col("category").alias("true_category"))
    both = p.withColumnRenamed("is_flaky", "pred_flaky").withColumnRenamed("category", "pred_category").join(t, "id")
    return overall_metrics(both, ["arrived"])
