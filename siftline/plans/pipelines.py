"""Pipelines: distillation with few-shot retrieval, evaluation, explanation, and sequences of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import prompts as P
from siftline.functions.answers import format_percentage
from siftline.operators import metrics as M
from siftline.operators.ordering import with_position
from siftline.operators.profile import label_percentages, table_profile
from siftline.operators.sampling import sample_data
from siftline.operators.signatures import with_signature
from siftline.operators.similarity import retrieve_top_k
from siftline.plans.inference import Model, call_model, rule_model
from siftline.session import cut
from siftline.sources.corpus import code_column, predictions_from_items, truth_from_labels
from siftline.sources.sinks import join, save_json, save_text

#: least similarity of an example
MIN_SHOT = 0.1


def few_shots(queries: DataFrame, train: DataFrame, k: int = 3, code: str = "code", skip_self: bool = False) -> DataFrame:
    """(id, few_shot_examples, shot_cases) of each query with at least one example: records of the k
    most similar training rows, and what their text block needs, both by rank. ``skip_self`` is for
    queries that are rows of ``train``; elsewhere equal ids mean nothing."""
    c = code_column(train, code)
    hits = retrieve_top_k(with_signature(queries, code).select("id", "sig"), with_signature(train, c).select("id", "sig"), k, MIN_SHOT, skip_self)
    row = train.select(F.col("id").alias("cand_id"), "project", F.coalesce("test_name", F.lit("Unknown")).alias("test_name"), "label", F.col(c).alias("_code"))
    full = hits.join(row, "cand_id")
    shot = F.struct("rank", "similarity", "project", "test_name", "label", P.code_preview(F.col("_code")).alias("code_preview"), F.col("cand_id").alias("id"))
    case = F.struct("rank", "similarity", "project", "label", F.col("_code").alias("code"))
    got = full.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(shot)).alias("s"), F.sort_array(F.collect_list(case)).alias("shot_cases"))
    return got.select("id", F.transform("s", lambda x: x.dropFields("rank")).alias("few_shot_examples"), "shot_cases")


def build_prompts(queries: DataFrame, train: DataFrame | None, template: str = P.DEFAULT_INPUT, k: int = 3, code: str = "code", skip_self: bool = False) -> DataFrame:
    """(id, prompt, few_shot_examples) of each query row."""
    c = code_column(queries, code)
    base = P.format_prompt(template, project=F.coalesce("project", F.lit("Unknown")), test_name=F.coalesce("test_name", F.lit("Unknown")), full_code=F.col(c))
    rows = queries.select("id", F.col(c).alias("_code"), base.alias("_base"))
    if train is None or k <= 0:
        return rows.select("id", F.col("_base").alias("prompt"), F.lit(None).cast("array<struct<similarity:double,project:string,test_name:string,label:string,code_preview:string,id:bigint>>").alias("few_shot_examples"))
    shots = few_shots(queries.withColumn("_c", F.col(c)), train, k, c, skip_self)
    prompt = P.fewshot_insert(F.col("_base"), F.col("_code"), P.fewshot_block(F.col("shot_cases")))
    return rows.join(shots, "id", "left").select("id", prompt.alias("prompt"), "few_shot_examples")


def distill(test: DataFrame, train: DataFrame | None = None, model: Model = rule_model, instruction: str = P.DEFAULT_INSTRUCTION, template: str = P.DEFAULT_INPUT, k: int = 3, mode: str = "all", n: int | None = None, tries: int = 3, wait: float = 1.0, threads: int = 1, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Instruction items (instruction, input, output, id, few_shot_examples, row_index), to be put in the
    order of ``row_index`` where they are written, and the ids that failed.
    The model's outputs are written to the shared folder once; both results read them there."""
    rows = sample_data(test, mode, n)
    asked = cut(call_model(build_prompts(rows, train, template, k, skip_self=skip_self), "prompt", model, instruction, tries, wait, threads), "outputs")
    c = code_column(rows)
    plain = P.format_prompt(template, project=F.coalesce("project", F.lit("Unknown")), test_name=F.coalesce("test_name", F.lit("Unknown")), full_code=F.col(c))
    placed = with_position(rows.select("id", plain.alias("input")), ["id"], "row_index")
    items = asked.filter("output is not null").join(placed, "id").select(F.lit(instruction).alias("instruction"), "input", "output", "id", "few_shot_examples", "row_index")
    return items, asked.filter("output is null").select("id")


class Evaluator:
    """Predictions against truth, each (id, is_flaky, category): metrics as tables, a report as text."""

    def __init__(self, pred: DataFrame, truth: DataFrame):
        self.pred, self.truth = pred, truth
        self.aligned = M.align(pred, truth)
        self.errors = M.error_cases(self.aligned)
        self.overall = M.overall_metrics(self.aligned)
        self.per_category = M.per_category_metrics(self.aligned)

    def counts(self) -> DataFrame:
        a = M.unmatched(self.pred, self.truth).agg(F.count("*").alias("unmatched_predictions"))
        b = M.unmatched(self.truth, self.pred).agg(F.count("*").alias("unmatched_labels"))
        return a.join(F.broadcast(b))  # one row each

    def metrics(self) -> DataFrame:
        """One row of nested results: totals, verdict and category metrics, error cases."""
        o = self.overall.select(
            F.col("total").alias("total_samples"),
            "overall_accuracy",
            F.struct(F.col("verdict_accuracy").alias("accuracy"), "precision", "recall", "f1", F.struct("tp", "fp", "tn", "fn").alias("confusion_matrix")).alias("flaky_detection"),
            "category_accuracy",
        )
        cells = F.struct("total", "accuracy", "precision", "recall", "f1")
        per = self.per_category.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", cells)))).alias("per_category"))
        top = M.top_errors(self.errors).groupBy("id", "predicted", "actual", "error_type").agg(F.min("rank").alias("rank"))
        errors = top.agg(F.sort_array(F.collect_list(F.struct("id", "predicted", "actual", "error_type"))).alias("error_cases"))
        # tables of one row each
        both = o.join(F.broadcast(per)).join(F.broadcast(errors)).join(F.broadcast(self.counts()))
        return both.select("total_samples", "overall_accuracy", "flaky_detection", F.struct(F.col("category_accuracy").alias("accuracy"), "per_category").alias("category_classification"), "error_cases", "unmatched_predictions", "unmatched_labels")

    def report(self) -> str:
        """Text of the results: totals, bands, verdict metrics, distribution of the true categories,
        metrics of each, errors by number and the first ones; only rows of the closed vocabulary, at most
        50 other categories and the first errors are collected."""
        o = self.overall.select("*", *[format_percentage(F.col(c)).alias(f"_{c}") for c in ("overall_accuracy", "verdict_accuracy", "category_accuracy", "precision", "recall", "f1")]).first()
        if o is None or not o.total:
            return "no aligned rows"
        n, b = self.counts().first(), M.performance_bands(self.overall).first()
        lines = [
            f"rows {o.total}, predictions without truth {n.unmatched_predictions}, truth without prediction {n.unmatched_labels}",
            f"overall {o._overall_accuracy}, verdict {o._verdict_accuracy} ({b.flaky_band}), category {o._category_accuracy} ({b.category_band})",
            f"precision {o._precision}, recall {o._recall}, F1 {o._f1}",
            f"TP {o.tp}  FP {o.fp}  TN {o.tn}  FN {o.fn}",
        ]
        for r in M.category_distribution(self.truth).orderBy(F.desc("n"), "category").limit(50).collect():
            lines.append(f"{r.category}: {r.n} ({r.percent:.1f}%) {r.bar}")
        for r in self.per_category.orderBy(F.desc("total"), "category").collect():
            lines.append(f"{r.category}: {r.total} rows, precision {r.precision:.4f}, recall {r.recall:.4f}, F1 {r.f1:.4f}")
        for r in M.error_transitions(self.errors).orderBy(F.desc("n"), "actual_category", "predicted_category").limit(20).collect():
            lines.append(f"{r.actual_category} -> {r.predicted_category}: {r.n}")
        for r in M.top_errors(self.errors).orderBy("kind", "rank").collect():
            lines.append(f"[{r.kind}] {r.id}: {r.predicted} / {r.actual}")
        return "\n".join(lines)

    def save_report(self, folder: str) -> None:
        """``metrics`` as JSON and ``report`` as text, under ``folder``."""
        save_json(self.metrics(), join(folder, "metrics"))
        save_text(self.pred.sparkSession, join(folder, "report"), self.report())

    @classmethod
    def run(cls, predictions: DataFrame, labels: DataFrame, folder: str | None = None, order: str = "item_id", label_order: str | None = None) -> "Evaluator":
        """Evaluation of model texts (``order``, id, output) against labelled rows, with its reports written
        where a folder is given."""
        done = cls(predictions_from_items(predictions, order), truth_from_labels(labels, order=label_order))
        if folder:
            done.save_report(folder)
        return done


def explain(df: DataFrame, n: int = 5, template: str = "{sample_size}\n{samples}", model: Model = rule_model, seed: int = 42, folder: str | None = None) -> tuple[DataFrame, str | None]:
    """The profile of a table and the model's text about n rows drawn from it; with a folder, also written
    as JSON (profile, counts of the 1,000 most frequent labels, text) and as text."""
    prompt = explainer_prompt(df, n, template, seed)
    profile = table_profile(df)
    got = model("", prompt.first().prompt)
    text = got[0] if isinstance(got, tuple) else got
    if folder:
        cells = profile.agg(F.sort_array(F.collect_list(F.struct("column", "dtype", "n_null", "percent_null"))).alias("columns"), F.max("n_rows").alias("total_records"))
        labels = label_percentages(df).orderBy(F.desc("n"), "label").limit(1000) if "label" in df.columns else None
        if labels is not None:  # one row each
            cells = cells.join(F.broadcast(labels.agg(F.collect_list(F.struct("label", "n", "percent")).alias("label_distribution"))))
        save_json(cells.withColumn("explanation", F.lit(text).cast("string")), join(folder, "explanation"))
        lines = [f"{r.column} {r.dtype}: {r.n_null} of {r.n_rows} null" for r in profile.collect()]
        save_text(df.sparkSession, join(folder, "explanation_text"), "\n".join([*lines, "", text or ""]))
    return profile, text


def explainer_prompt(df: DataFrame, n: int = 5, template: str = "{sample_size}\n{samples}", seed: int = 42) -> DataFrame:
    """One row (prompt) over n sampled rows, numbered by id."""
    from pyspark.sql import Window

    rows = sample_data(df, "random", n, seed)
    rank = F.row_number().over(Window.orderBy("id"))  # over n rows
    texts = rows.select(rank.alias("rank"), "label", F.col(code_column(rows)).alias("code")).select("rank", P.explainer_sample(F.col("rank"), F.col("label"), F.col("code")).alias("text"))
    got = texts.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("s"))
    return got.select(P.format_prompt(template, sample_size=F.col("n"), samples=P.explainer_samples(F.col("s.text"))).alias("prompt"))


def run_steps(steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], df: DataFrame, order: list[int] | None = None) -> list[tuple[str, DataFrame | None, str]]:
    """Steps in turn over the same input: (name, result, error). A step that fails, or an index that
    does not exist, gives no result and the others go on."""
    out = []
    for i in order if order is not None else range(len(steps)):
        if not 0 <= i < len(steps):
            out.append((str(i), None, "no such step"))
            continue
        name, f = steps[i]
        try:
            out.append((name, f(df), ""))
        except Exception as e:  # noqa: BLE001 - reported with the result
            out.append((name, None, str(e)))
    return out
