"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.labels import project_key
from siftline.llm import crossover, entity_splits, leakage, neardup, packing, pairs, proportional, repetition, sentences, truncation
from siftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = proportional.sample_to_targets(table(spark, d, "dataset"), table(spark, d, "label_target"))
    return report.filter("shortfall").select("plan", "category")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportional.sample_to_targets(table(spark, d, "dataset"), table(spark, d, "label_target"))[0]


def p1_residuals(spark: SparkSession, d: str) -> DataFrame:
    return proportional.sample_to_targets(table(spark, d, "dataset"), table(spark, d, "label_target"))[1]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """What each target misses, and whether the sample holds it to less than one unit."""
    kept = F.abs(F.col("drawn") - F.least("need", "available")) < 1
    return p1_residuals(spark, d).select("plan", "category", "need", "available", F.greatest(F.col("need") - F.col("available"), F.lit(0.0)).alias("missing"), "shortfall", kept.alias("kept"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_off(table(spark, d, "alpaca_item"), "item_id", "output", "input").filter("cut").select("item_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_off(table(spark, d, "alpaca_item"), "item_id", "output", "input")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "alpaca_item")
    return truncation.truncation_rates(items, "item_id", "source", p2_reasons(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_splits.same_entity_spellings(entity_splits.project_components(table(spark, d, "dataset")))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return entity_splits.assign_splits(table(spark, d, "dataset"), table(spark, d, "split_target"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return entity_splits.split_report(p3_splits(spark, d), table(spark, d, "split_target"))


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """For each plan: its records, its projects by key, and whether every project is in one split."""
    key = F.coalesce(F.nullif(project_key("project"), F.lit("")), F.concat(F.lit("raw:"), "project"), F.lit("null:"))
    rows = p3_splits(spark, d).join(table(spark, d, "dataset").select("id", key.alias("entity")), "id")
    per = rows.groupBy("plan", "entity").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return per.groupBy("plan").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.bool_and(F.col("splits") == 1).alias("whole"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "alpaca_item"), "item_id", "input", "output").filter("defect is not null")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "alpaca_item").select("item_id", "source")
    return p4_found(spark, d).join(items, "item_id").groupBy("source", "defect").agg(F.count("*").alias("n_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped_pairs(p5_groups(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "dataset"), "id", ["test_name", "code"])[1]


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "dataset"), "id", ["test_name", "code"])[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_overlaps(spark, d).select(F.least("id_h", "id_t").alias("id_a"), F.greatest("id_h", "id_t").alias("id_b")).distinct()


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return crossover.split_overlaps(table(spark, d, "dataset"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return crossover.overlap_counts(p6_overlaps(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_documents(table(spark, d, "alpaca_item"), "item_id", "output").filter("bad").select("item_id")


def p7_measure(spark: SparkSession, d: str) -> DataFrame:
    return p7_scores(spark, d).select("item_id", "n_chars", "repeated_share", "bad")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_documents(table(spark, d, "alpaca_item"), "item_id", "output")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_spec"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, d), table(spark, d, "container_spec"))


def p8_fits(spark: SparkSession, d: str) -> DataFrame:
    """For each spec: its room, whether every container keeps to it and every document is whole that can be, and how
    many documents the packing holds, those without a token included."""
    room = F.col("capacity_tokens") - F.col("reserved_tokens")
    packed = p8_pack(spark, d)
    full = packed.groupBy("spec_id", "container_id").agg(F.sum(F.when(F.col("container_id").isNotNull(), F.col("tokens"))).alias("used")).groupBy("spec_id").agg(F.max("used").alias("most"))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("size"))
    spec = table(spark, d, "container_spec").select("spec_id", room.cast("bigint").alias("room"))
    cut_up = docs.join(F.broadcast(spec), "spec_id").groupBy("spec_id", "room").agg(F.count("*").alias("n_docs"), F.bool_and(F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("room")))).alias("whole"))  # a few specs
    return cut_up.join(full, "spec_id").select("spec_id", "room", "n_docs", ((F.col("most") <= F.col("room")) & F.col("whole")).alias("fits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter("verbatim").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if("verbatim").alias("n_verbatim"), F.max("coverage").alias("most_covered"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_units(spark, d).select("doc_id", "end_pos").distinct()


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text")


def p10_extent(spark: SparkSession, d: str) -> DataFrame:
    """Where the units of each document end, and whether each begins where the one before ended."""
    u = p10_units(spark, d)
    per = u.groupBy("doc_id").agg(F.max("end_pos").alias("end_pos"), F.count("*").alias("n"), F.countDistinct("end_pos").alias("ends"), F.sum("end_pos").alias("a"), F.sum("start_pos").alias("b"), F.min("start_pos").alias("first"))
    # distinct ends, and starts that are 0 and all ends but the last
    return per.select("doc_id", "end_pos", ((F.col("n") == F.col("ends")) & (F.col("first") == 0) & (F.col("a") - F.col("end_pos") == F.col("b"))).alias("chained"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
