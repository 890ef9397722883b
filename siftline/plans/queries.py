"""Named queries over the tables of a folder: every operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import prompts as P
from siftline.functions.answers import extract_answer, format_percentage, normalize_category, truth_category, truth_verdict
from siftline.operators import metrics as M
from siftline.operators import profile as R
from siftline.operators import splits as S
from siftline.operators.ordering import with_position
from siftline.operators.sampling import sample_data, shuffle_rows
from siftline.operators.signatures import signature_statistics, top_tokens, with_signature
from siftline.operators.similarity import frequency_overlap, jaccard, retrieve_top_k, retrieve_with_diversity, shared_tokens, similar_pairs, similarity
from siftline.plans import pipelines as L
from siftline.plans.inference import call_model, call_statistics, rule_model
from siftline.session import scratch, table
from siftline.sources.corpus import predictions_from_items, read_corpus, read_items, truth_from_labels
from siftline.sources.sinks import plain_items, project_lists, resume, save_folds, save_items, save_json, save_splits

Query = Callable[[SparkSession, str], DataFrame]
RARE = 0.02
TEMPLATE = "{project}/{test_name}\n{full_code}"


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return with_signature(table(spark, d, "dataset"))


def _searches(df: DataFrame) -> DataFrame:
    return df.filter("id % 100 = 0")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return truth_from_labels(table(spark, d, "dataset"))


def _verdict(c: Column) -> Column:
    v = F.lower(c)
    return F.when(v.isin("yes", "是"), "是").when(v.isin("no", "否"), "否")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prediction").withColumn("is_flaky", _verdict(F.col("is_flaky")))
    return p.filter("is_flaky is not null and category is not null").withColumn("category", normalize_category(F.col("category")))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("predicted_at", "received_at", "config_id", "is_flaky", "category")
    return M.last_by_id(_parsed(spark, d).select("id", "is_flaky", "category", order.alias("o")), "o")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return M.align(_predictions(spark, d), _truth(spark, d))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose project is on a test list, with that fold."""
    folds = table(spark, d, "fold_project").filter("side = 'test'").select("fold", "project")
    return table(spark, d, "dataset").join(folds, "project")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alpaca_item")


def _dataset(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "dataset"))


def _hits(k: int, least: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _signed(spark, d).select("id", "sig")
        return retrieve_top_k(_searches(df), df, k, least)

    return run


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each record that an item is about beside each record it has as an example, as two signatures."""
    df = _signed(spark, d).select("id", "sig")
    both = table(spark, d, "alpaca_item").select(F.col("id").alias("id_a"), F.explode("few_shot_examples.id").alias("id_b")).distinct()
    named = both.join(df.select(F.col("id").alias("id_a"), F.col("sig").alias("a")), "id_a")
    return named.join(df.select(F.col("id").alias("id_b"), F.col("sig").alias("b")), "id_b")


def _similarity_join(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens, distinct and with repeats, the searches share with every row that has one of theirs."""
    df = _signed(spark, d).select("id", "sig")
    return shared_tokens(_searches(df), df)


def _min_similarity(spark: SparkSession, d: str) -> DataFrame:
    df = _signed(spark, d).select("id", "sig")
    return similar_pairs(_searches(df), df, 0.5)


def _diverse(spark: SparkSession, d: str) -> DataFrame:
    df = _signed(spark, d).select("id", "sig")
    return retrieve_with_diversity(_searches(df), df, 3, 0.3)


def _row_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset").select(F.col("id").alias("cand_id"), "project", "label")
    return _hits(3, 0.1)(spark, d).join(rows, "cand_id").select("query_id", "rank", "project", "label")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dataset")
    return L.build_prompts(_searches(df), df, TEMPLATE, skip_self=True).select("id", "prompt")


def _shots(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dataset")
    one = L.few_shots(_searches(df), df, skip_self=True).select("id", F.posexplode("few_shot_examples").alias("rank", "e"))
    return one.select(F.col("id").alias("query_id"), (F.col("rank") + 1).alias("rank"), "e.similarity", "e.project", "e.test_name", "e.label", "e.code_preview", F.col("e.id").alias("example_id"))


def _instruction(spark: SparkSession, d: str) -> DataFrame:
    """Every record as an instruction item: its labelled verdict as output, with id and examples, which
    are those of the last item about the record."""
    text = P.format_prompt(P.DEFAULT_INPUT, project=F.coalesce("project", F.lit("Unknown")), test_name=F.coalesce("test_name", F.lit("Unknown")), full_code=F.col("code"))
    out = F.concat(F.lit("答案："), truth_verdict(F.col("label")), F.lit(" - "), truth_category(F.col("label")))
    item = table(spark, d, "alpaca_item").filter("id is not null").groupBy("id").agg(F.max_by("few_shot_examples", "item_id").alias("few_shot_examples"))
    rows = table(spark, d, "dataset").select("id", F.lit(P.DEFAULT_INSTRUCTION).alias("instruction"), text.alias("input"), out.alias("output"))
    return rows.join(item, "id", "left").select("instruction", "input", "output", "id", F.to_json(F.transform("few_shot_examples", lambda e: e["id"])).alias("examples"))


def _distilled(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dataset")
    items, _ = L.distill(_searches(df), df, wait=0, skip_self=True)
    return items.select("row_index", "id", "instruction", "input", "output", F.size("few_shot_examples").alias("n_examples"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return call_statistics(call_model(table(spark, d, "dataset").select("id", F.col("code").alias("prompt")), "prompt", wait=0))


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    """Projects on both sides of the table's own split, which is no split by projects."""
    sides = table(spark, d, "dataset").filter("project is not null").select(F.lit(1).alias("fold"), "project", F.when(F.col("split") == "train", "train").otherwise("test").alias("side"))
    return S.fold_overlap(sides)


def _kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.project_folds(table(spark, d, "dataset"), rare_share=RARE)


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of the folds that ``project_folds`` assigns, over all rows with a project."""
    df = table(spark, d, "dataset").select("id", "project", "category")
    return S.fold_sides(df, _kfold(spark, d))


def _scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """The records, written as a CSV corpus with multi-line code and read again."""
    at = scratch(spark, "corpus")
    rows = table(spark, d, "dataset").select("id", "project", "test_name", F.col("code").alias("full_code"), "label", "category", F.lit("all").alias("split"))
    save_splits(rows, at)
    return read_corpus(spark, f"{at}/split=all", line_end="\n")


def _scan_json(spark: SparkSession, d: str) -> DataFrame:
    """The items, written as one JSON line each and read again."""
    at = scratch(spark, "items")
    save_json(table(spark, d, "alpaca_item").select("instruction", "input", "output", "id", "few_shot_examples"), at)
    return read_items(spark, at, lines=True).select("instruction", "input", "output", "id", F.size(F.coalesce("few_shot_examples", F.array())).alias("n_examples"))


def _splits_written(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "splits")
    save_splits(S.split_dataset(table(spark, d, "dataset").select("id", "label"), stratify="label"), at, "json")
    return spark.read.schema("id bigint, label string, split string").json(at)


def _folds_written(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "folds")
    save_folds(_sides(spark, d), at, "parquet")
    return spark.read.parquet(at).groupBy("fold", "side").agg(F.count("*").alias("n_rows"), F.countDistinct("project").alias("n_projects")).withColumn("fold", F.col("fold").cast("int"))


def _items_written(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "dual")
    save_items(table(spark, d, "alpaca_item").select("instruction", "input", "output", "id", "few_shot_examples"), at, "run", True)
    n = lambda name, cols: spark.read.schema("id bigint, output string").json(f"{at}/{name}").agg(F.count("*").alias("n_rows"), F.count("output").alias("n_output"), F.count("id").alias("n_id")).select(F.lit(name).alias("name"), "*")
    return n("run", 3).unionByName(n("run_external", 5))


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of all records in batches of a run that was broken after the odd ids."""
    at = scratch(spark, "resume")
    df = table(spark, d, "dataset").select("id", "label")
    step = lambda x: x.select("id", truth_verdict(F.col("label")).alias("is_flaky"))
    resume(df.filter("id % 2 = 1"), at, step, batches=2)
    return resume(df, at, step, batches=4)


def _evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of the predictions, written as nested JSON and read again."""
    at = scratch(spark, "report")
    L.Evaluator(_predictions(spark, d), _truth(spark, d)).save_report(at)
    r = spark.read.json(f"{at}/metrics")
    m = F.col("flaky_detection.confusion_matrix")
    return r.select("total_samples", "overall_accuracy", "flaky_detection.precision", "flaky_detection.recall", "flaky_detection.f1", m["tp"].alias("tp"), m["fp"].alias("fp"), m["tn"].alias("tn"), m["fn"].alias("fn"), F.col("category_classification.accuracy").alias("category_accuracy"), F.size("error_cases").alias("n_errors"), "unmatched_predictions", "unmatched_labels")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """Records that a model which refuses sleeping tests has answered."""
    model = lambda system, prompt: None if "Thread.sleep" in prompt else rule_model(system, prompt)
    asked = call_model(table(spark, d, "dataset").select("id", F.col("code").alias("prompt")), "prompt", model, tries=2, wait=0)
    return asked.filter("output is not null").select("id", "calls", "failures")


def _explained(spark: SparkSession, d: str) -> DataFrame:
    """The explainer's report over the records, written as JSON and read again."""
    at = scratch(spark, "explained")
    L.explain(table(spark, d, "dataset"), folder=at)
    r = spark.read.json(f"{at}/explanation").select("total_records", "columns", F.explode("label_distribution").alias("l"))
    return r.select("total_records", F.size("columns").alias("n_columns"), "l.label", "l.n", "l.percent")


def _critical(spark: SparkSession, d: str) -> DataFrame:
    """Projects with a rare category, by size, dealt to four folds in turn."""
    df = table(spark, d, "dataset").filter("project is not null")
    has = df.join(S.rare_categories(df, share=RARE).select("category"), "category", "left_semi").select("project").distinct()
    size = df.groupBy("project").agg(F.count("*").alias("n_rows")).join(has, "project", "left_semi")
    placed = with_position(size.withColumn("_rank", -F.col("n_rows")), ["_rank", "project"], "turn")
    return placed.select("project", "n_rows", (F.col("turn") % 4 + 1).cast("int").alias("fold"))


def _not_critical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset").filter("project is not null").select("project").distinct().join(_critical(spark, d), "project", "left_anti")


def _compare(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("predicted_at", "received_at", "is_flaky", "category")
    p = _parsed(spark, d).filter("id is not null").groupBy("config_id", "id").agg(F.max_by(F.struct("is_flaky", "category"), order).alias("r"))
    p = p.select("config_id", "id", F.col("r.is_flaky").alias("pred_flaky"), F.col("r.category").alias("pred_category"))
    t = _truth(spark, d).select("id", F.col("is_flaky").alias("true_flaky"), F.col("category").alias("true_category"))
    return M.overall_metrics(p.join(t, "id"), ["config_id"])


def _formatted(spark: SparkSession, d: str) -> DataFrame:
    o = M.overall_metrics(_aligned(spark, d))
    return o.select(*[format_percentage(F.col(c)).alias(c) for c in ("overall_accuracy", "verdict_accuracy", "category_accuracy", "precision", "recall", "f1")])


def _shuffled(df: DataFrame) -> DataFrame:
    return shuffle_rows(df.select("id", "label"))


def queries() -> dict[str, Query]:
    e = lambda f: lambda spark, d: f(M.error_cases(_aligned(spark, d)))
    m = lambda f: lambda spark, d: f(_aligned(spark, d))
    i = lambda f: lambda spark, d: f(_items(spark, d))
    s = lambda f: lambda spark, d: f(_signed(spark, d))
    k = lambda f: lambda spark, d: f(_folded(spark, d))
    split = lambda **kw: _dataset(lambda df: S.split_dataset(df.select("id", "label"), **kw))
    return {
        # signatures and retrieval
        "extract_apis": s(lambda df: df.select("id", F.posexplode("sig").alias("pos", "token"))),
        "signature_statistics": s(signature_statistics),
        "top_tokens": s(top_tokens),
        "jaccard": lambda spark, d: _pairs(spark, d).select("id_a", "id_b", jaccard(F.col("a"), F.col("b")).alias("jaccard")),
        "frequency_overlap": lambda spark, d: _pairs(spark, d).select("id_a", "id_b", frequency_overlap(F.col("a"), F.col("b")).alias("overlap")),
        "compute_similarity": lambda spark, d: _pairs(spark, d).select("id_a", "id_b", similarity(F.col("a"), F.col("b")).alias("similarity")),
        "signature_union_intersection": lambda spark, d: _pairs(spark, d).select("id_a", "id_b", F.size(F.array_union("a", "b")).alias("n_union"), F.size(F.array_intersect("a", "b")).alias("n_inter")),
        "similarity_join": _similarity_join,
        "min_similarity_filter": _min_similarity,
        "retrieve_top_k": _hits(3, 0.1),
        "retrieve_top_k_padded": _hits(5, 0.0),
        "batch_retrieve": _hits(3, 0.0),
        "retrieve_with_diversity": _diverse,
        "row_fetch": _row_fetch,
        # prompts and items
        "format_prompt": _dataset(lambda df: df.select("id", P.format_prompt(TEMPLATE, project=F.col("project"), test_name=F.col("test_name"), full_code=F.col("code")).alias("prompt"))),
        "code_preview": _dataset(lambda df: df.select("id", P.code_preview(F.col("code")).alias("preview"))),
        "to_instruction": _instruction,
        "strip_metadata": i(lambda df: df.select("item_id", *plain_items(df).columns)),
        "fewshot_block": _prompts,
        "fewshot_examples": _shots,
        "explainer_prompt": lambda spark, d: L.explainer_prompt(table(spark, d, "dataset")),
        "distill": _distilled,
        "api_call_stats": _calls,
        # answers and metrics
        "extract_answer": i(lambda df: df.select("item_id", extract_answer(F.col("output")).alias("a")).select("item_id", "a.is_flaky", "a.category")),
        "normalize_category": lambda spark, d: table(spark, d, "prediction").select("category").distinct().select("category", normalize_category(F.col("category")).alias("known")),
        "truth_verdict": _dataset(lambda df: df.select("id", truth_verdict(F.col("label")).alias("is_flaky"), truth_category(F.col("label")).alias("category"))),
        "scan_predictions": i(lambda df: predictions_from_items(df, "item_id")),
        "scan_ground_truth": _truth,
        "drop_unparsed": lambda spark, d: _parsed(spark, d).select("id", "is_flaky", "category", "config_id"),
        "align_inner_join": _aligned,
        "unmatched_predictions": lambda spark, d: M.unmatched(_predictions(spark, d), _truth(spark, d)),
        "unmatched_labels": lambda spark, d: M.unmatched(_truth(spark, d), _predictions(spark, d)),
        "id_intersection": lambda spark, d: _predictions(spark, d).select("id").intersect(_truth(spark, d).select("id")),
        "overall_metrics": m(M.overall_metrics),
        "flaky_confusion": m(lambda a: M.overall_metrics(a).select("tp", "fp", "tn", "fn")),
        "flaky_prf": m(lambda a: M.overall_metrics(a).select("precision", "recall", "f1")),
        "per_category_metrics": m(M.per_category_metrics),
        "error_cases": m(M.error_cases),
        "error_transition_counts": e(M.error_transitions),
        "error_group_counts": e(M.error_group_counts),
        "top_errors_limit": e(M.top_errors),
        "category_distribution": lambda spark, d: M.category_distribution(_truth(spark, d)),
        "performance_bands": m(lambda a: M.performance_bands(M.overall_metrics(a))),
        "format_percentage": _formatted,
        "model_comparison": _compare,
        # samples and splits
        "sample_all": _dataset(lambda df: sample_data(df.select("id", "label"))),
        "sample_first": _dataset(lambda df: sample_data(df.select("id", "label"), "first", 100)),
        "sample_last": _dataset(lambda df: sample_data(df.select("id", "label"), "last", 100)),
        "sample_random": _dataset(lambda df: sample_data(df.select("id", "label"), "random", 100)),
        "shuffle_rows": _dataset(_shuffled),
        "random_split": split(),
        "ordered_split": split(shuffle=False),
        "stratified_split": split(stratify="label"),
        "split_summary": _dataset(lambda df: S.split_summary(S.split_dataset(df.select("id", "label"), stratify="label"), "label")),
        "concat_splits": _dataset(lambda df: df.filter("split = 'train'").select("id", "label").unionByName(df.filter("split <> 'train'").select("id", "label"))),
        # folds
        "category_project_spread": _dataset(S.category_project_spread),
        "project_category_counts": _dataset(S.project_category_counts),
        "rare_categories": _dataset(lambda df: S.rare_categories(df, share=RARE)),
        "fold_feasibility": _dataset(lambda df: S.fold_feasibility(df, 4, 20)),
        "kfold_round_robin": _critical,
        "project_difference": _not_critical,
        "kfold_greedy_assign": _kfold,
        "kfold_materialise": lambda spark, d: _sides(spark, d).select("fold", "side", "id", "project"),
        "fold_summary": k(S.fold_summary),
        "fold_violations": k(lambda df: S.fold_violations(df, 4, 40)),
        "overlap_check": _overlap,
        "save_folds": lambda spark, d: project_lists(table(spark, d, "fold_project")).select("fold", "side", "n_projects", F.array_join("projects", "\n").alias("projects")),
        "project_membership": lambda spark, d: table(spark, d, "dataset").join(table(spark, d, "fold_project").select("project"), "project", "left_anti").select("id", "project"),
        "categories_in_order": _dataset(lambda df: S.category_project_spread(df).orderBy("category")),
        "global_counts": _dataset(S.global_counts),
        # sources and sinks
        "scan_csv": _scan_csv,
        "scan_json": _scan_json,
        "save_splits": _splits_written,
        "save_fold_sides": _folds_written,
        "save_items": _items_written,
        "resume": _resumed,
        "evaluation_report": _evaluation_report,
        "explain_report": _explained,
        "drop_failed": _answered,
        # profiles
        "profile_table": _dataset(R.table_profile),
        "null_percentages": i(lambda df: R.null_percentages(df)),
        "label_percentages": _dataset(R.label_percentages),
        "preview_head": _dataset(lambda df: R.preview_head(df.select("id", "project", "label"))),
        "fewshot_similarity_stats": i(R.fewshot_similarity_stats),
        "fewshot_distribution": i(lambda df: R.fewshot_distribution(df, "label")),
        "fewshot_low_quality": i(R.fewshot_low_quality),
    }
