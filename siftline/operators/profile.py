"""Profiles of tables and of few-shot records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.ordering import with_position


def table_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_null, percent_null) of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("n_null")) for c, t in df.dtypes]))
    rows = counts.select(F.col("_rows").alias("n_rows"), cells.alias("c")).select("c.column", "c.dtype", "n_rows", "c.n_null")
    return rows.withColumn("percent_null", F.coalesce(F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")), F.lit(0.0)))


def null_percentages(df: DataFrame) -> DataFrame:
    """(column, n_null, percent_null) of columns with nulls."""
    return table_profile(df).filter("n_null > 0").select("column", "n_null", "percent_null")


def label_percentages(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent): nulls have no row but count in the percentages."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.filter(F.col(label).isNotNull()).join(F.broadcast(total)).select(label, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def preview_head(df: DataFrame, order: str = "id", n: int = 3) -> DataFrame:
    return df.orderBy(order).limit(n)


def median(values: DataFrame, value: str) -> DataFrame:
    """One row with the exact ``median`` of the values that are not null: they are put in order over all tasks, and the one or
    two in the middle are read by their positions. Null where there are none."""
    placed = with_position(values.select(value).filter(F.col(value).isNotNull()), [value], "_pos")
    last = placed.agg((F.count("*") - 1).alias("_last"))  # one row
    low, high = F.floor(F.col("_last") / 2), F.ceil(F.col("_last") / 2)
    middle = placed.join(F.broadcast(last)).filter(F.col("_pos").isin(low, high))
    return middle.agg((F.min(value) + (F.max(value) - F.min(value)) * 0.5).alias("median"))


def fewshot_similarity_stats(items: DataFrame) -> DataFrame:
    """One row over all few-shot examples: items, items with examples, usage rate and the mean,
    median, population deviation, minimum and maximum of the similarity."""
    n = items.agg(F.count("*").alias("n_items"), F.count_if(F.size(F.coalesce("few_shot_examples", F.array())) > 0).alias("n_with"))
    values = items.select(F.explode("few_shot_examples.similarity").alias("s"))
    s = values.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("low"), F.max("s").alias("high"))
    # tables of one row
    both = n.join(F.broadcast(s)).join(F.broadcast(median(values, "s")))
    return both.select("n_items", "n_with", "mean", "median", "std", "low", "high").withColumn("usage_rate", F.coalesce(F.try_divide("n_with", "n_items"), F.lit(0.0)))


def fewshot_distribution(items: DataFrame, field: str) -> DataFrame:
    """(value, n) of a field over all few-shot examples."""
    return items.select(F.explode("few_shot_examples").alias("e")).groupBy(F.col(f"e.{field}").alias("value")).agg(F.count("*").alias("n"))


def fewshot_low_quality(items: DataFrame, below: float = 0.3, key: str = "item_id") -> DataFrame:
    """(key, mean_similarity) of items whose examples are less similar than ``below`` on average."""
    mean = F.aggregate("few_shot_examples", F.lit(0.0), lambda a, e: a + e["similarity"]) / F.size("few_shot_examples")
    return items.filter(F.size("few_shot_examples") > 0).select(key, mean.alias("mean_similarity")).filter(F.col("mean_similarity") < below)
