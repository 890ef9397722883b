"""Golden cases and properties of the operators on small fixtures."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline.functions.answers import extract_answer, format_percentage, normalize_category, truth_category, truth_verdict
from siftline.functions.labels import label_category, project_key
from siftline.functions.prompts import fewshot_insert, format_prompt
from siftline.operators import metrics as M
from siftline.operators import splits as S
from siftline.operators.ordering import with_position
from siftline.operators.profile import median, null_percentages, table_profile
from siftline.operators.sampling import sample_data
from siftline.operators.signatures import signature
from siftline.operators.similarity import retrieve_top_k, retrieve_with_diversity, shared_tokens, similar_pairs, similarity
from siftline.plans.inference import Reply, call_model, call_statistics
from siftline.plans.pipelines import Evaluator, distill, explain, run_steps
from siftline.sources.corpus import RunConfig, display_config, list_datasets, list_prediction_files, load_config, predictions_from_items, read_corpus, read_items, save_config, truth_from_labels
from siftline.sources.sinks import join, resume, save_folds, save_items, save_json, save_splits


def sig_of(spark, code):
    return spark.createDataFrame([(code,)], "c string").select(signature(F.col("c")).alias("s")).first().s


def test_signature_rules(spark):
    assert sig_of(spark, "a.b.c (x); foo.bar();") == ["b", "foo"]
    got = sig_of(spark, 'assertNotNull(x); assertEqualsNoOrder(y); fail ("x")')
    assert got == ["assert_NotNull", "assert_Equals", "assert_fail ("]
    assert sig_of(spark, "@BeforeClass") == ["@Before", "@BeforeClass"]
    assert sig_of(spark, "CompletableFuture") == ["async_Future", "async_CompletableFuture"]
    assert "time_Thread_sleep" in sig_of(spark, "Thread.sleep(1)") and "Thread" in sig_of(spark, "Thread.sleep(1)")
    assert sig_of(spark, "List.of(1)") == ["List", "List"]
    assert sig_of(spark, "@Mock PowerMock") == ["@Mock", "mock_framework", "powermock"]
    assert sig_of(spark, None) == [] and sig_of(spark, "") == []
    assert sig_of(spark, "变量.调用(x)") == ["变量"]


@pytest.mark.parametrize("a,b,want", [(["a", "a", "b"], ["a", "a", "a", "c"], 0.3142857142857143), (["x"], ["x"], 0.8), ([], [], 0.0), ([], ["a"], 0.0)])
def test_similarity_golden(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(similarity(F.col("a"), F.col("b")).alias("s")).first().s == want
    assert score(a, b) == want


def score(a, b):
    x, y = Counter(a), Counter(b)
    inter, union = len(x.keys() & y.keys()), len(x.keys() | y.keys())
    return 0.6 * (inter / union if union else 0.0) + 0.4 * ((x & y).total() / (len(a) + len(b)) if a or b else 0.0)


def brute(sigs, qid, k, least=0.0):
    rows = [(score(sigs[qid], v), i) for i, v in sigs.items() if i != qid]
    return [(i, x) for x, i in sorted(rows, key=lambda r: (-r[0], r[1])) if x >= least][:k]


def test_retrieval_against_brute_force(spark):
    rnd = random.Random(3)
    sigs = {i: [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 6))] for i in range(60)}
    df = spark.createDataFrame(list(sigs.items()), "id bigint, sig array<string>").repartition(5)
    q = df.filter("id % 10 = 0")
    for least, k in ((0.0, 4), (0.4, 3)):
        got = {}
        for r in retrieve_top_k(q, df, k, least).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.cand_id, r.similarity)
        for i in range(0, 60, 10):
            assert [got.get(i, {})[n + 1] for n in range(len(got.get(i, {})))] == brute(sigs, i, k, least)


def test_retrieval_by_patterns_and_tokens(spark, monkeypatch):
    """Every row as a query: frequent tokens with repeats, rare ones in a few rows, ties, several blocks."""
    import numpy as np

    from siftline.operators import similarity as V

    monkeypatch.setattr(V, "QUERY_BLOCK", 100)
    monkeypatch.setattr(V, "ROW_BLOCK", 150)
    monkeypatch.setattr(V, "HOT_SHARE", 0.05)
    rnd = random.Random(11)
    sigs = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))] + [f"r{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 2))] for _ in range(700)]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sigs)], "id bigint, sig array<string>").repartition(4)
    sim = np.array([[score(a, b) for b in sigs] for a in sigs])
    np.fill_diagonal(sim, -1)
    for least in (0.0, 0.45):
        got = {}
        for r in retrieve_top_k(df, df, 3, least).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.cand_id, r.similarity))
        for i in range(len(sigs)):
            order = np.lexsort((np.arange(len(sigs)), -sim[i]))[:3]
            assert [x[1:] for x in sorted(got.get(i * 3, []))] == [(3 * int(j), sim[i, j]) for j in order if sim[i, j] >= least]


@pytest.mark.parametrize("block", [4096, 7])
def test_diversity_against_greedy_scan(spark, monkeypatch, block):
    from siftline.operators import similarity as V

    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "ROW_BLOCK", block)
    rnd = random.Random(5)
    sigs = {i: [rnd.choice("abcd") for _ in range(rnd.randint(0, 4))] for i in range(40)}
    df = spark.createDataFrame(list(sigs.items()), "id bigint, sig array<string>").repartition(3)
    got = {}
    for r in retrieve_with_diversity(df.filter("id % 8 = 0"), df, 3, 0.3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.cand_id
    for q in range(0, 40, 8):
        order = [i for i, _ in brute(sigs, q, 99)]
        taken = []
        for c in order:
            if len(taken) < 3 and all(score(sigs[c], sigs[t]) <= 0.3 for t in taken):
                taken.append(c)
        taken += [c for c in order if c not in taken][: 3 - len(taken)]
        assert [got[q][n] for n in (1, 2, 3)] == taken


def test_retrieval_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, sig array<string>")
    one = spark.createDataFrame([(1, None), (2, ["a"])], "id bigint, sig array<string>")
    assert retrieve_top_k(empty, one).count() == 0
    assert retrieve_top_k(one, empty).count() == 0
    assert [tuple(r) for r in retrieve_top_k(one.filter("id = 1"), one, 3).collect()] == [(1, 1, 2, 0.0)]


def brute_shared(sigs, queries):
    counts = {i: Counter(s or []) for i, s in sigs.items()}
    both = {(i, j): (len(counts[i].keys() & counts[j].keys()), sum((counts[i] & counts[j]).values())) for i in queries for j in sigs if i != j}
    return {k: v for k, v in both.items() if v[0]}


@pytest.mark.parametrize("share, most", [(0.001, 1024), (0.05, 1024), (0.05, 3), (2, 0)])
def test_shared_tokens_against_brute_force(spark, monkeypatch, share, most):
    """Tokens that are bits (more than one word of them), tokens that are joined, repeats of either kind; several blocks."""
    from siftline.operators import similarity as V

    for name, value in (("HOT_SHARE", share), ("HOT_TOKENS", most), ("ROW_PAIRS", 7), ("QUERY_PAIRS", 5), ("TASK_ROWS", 50), ("TASK_QUERIES", 10)):
        monkeypatch.setattr(V, name, value)
    rnd = random.Random(5)
    sigs = {i: [rnd.choice("abcdef") for _ in range(rnd.randint(0, 5))] + [f"r{rnd.randint(0, 150)}" for _ in range(rnd.randint(0, 6))] * rnd.randint(1, 2) for i in range(200)}
    sigs |= {200: None, 201: [], 202: ["alone"] * 70, 203: ["alone"] * 66, 210: ["x", "alone"]}
    df = spark.createDataFrame(list(sigs.items()), "id bigint, sig array<string>").repartition(4)
    got = shared_tokens(df.filter("id % 10 = 0"), df).collect()
    assert len({(r.query_id, r.cand_id) for r in got}) == len(got)
    assert {(r.query_id, r.cand_id): (r.inter, r.shared) for r in got} == brute_shared(sigs, [i for i in sigs if i % 10 == 0])


@pytest.mark.parametrize("share, most, least", [(0.001, 1024, 0.5), (0.05, 1024, 0.3), (0.05, 3, 0.5), (2, 0, 0.45), (0.001, 1024, 0.05)])
def test_similar_pairs_against_brute_force(spark, monkeypatch, share, most, least):
    from siftline.operators import similarity as V

    for name, value in (("HOT_SHARE", share), ("HOT_TOKENS", most), ("ROW_BLOCK", 20), ("QUERY_BLOCK", 9), ("COMPARED", 4), ("TASK_ROWS", 50), ("TASK_QUERIES", 10)):
        monkeypatch.setattr(V, name, value)
    rnd = random.Random(6)
    sigs = {i: [rnd.choice("abcdef") for _ in range(rnd.randint(0, 6))] + [f"r{rnd.randint(0, 90)}" for _ in range(rnd.randint(0, 3))] * rnd.randint(1, 2) for i in range(200)}
    sigs |= {200: None, 201: [], 202: ["alone"] * 70, 203: ["alone"] * 66, 210: ["x", "alone"]}
    df = spark.createDataFrame(list(sigs.items()), "id bigint, sig array<string>").repartition(4)
    got = similar_pairs(df.filter("id % 5 = 0"), df, least).collect()
    want = {(i, j): score(sigs[i] or [], sigs[j] or []) for i in sigs if i % 5 == 0 for j in sigs if i != j}
    assert len(got) == len({(r.query_id, r.cand_id) for r in got})
    assert {(r.query_id, r.cand_id): r.similarity for r in got} == {k: s for k, s in want.items() if s >= least}


def test_shared_tokens_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, sig array<string>")
    one = spark.createDataFrame([(1, ["a"]), (2, ["a"])], "id bigint, sig array<string>")
    assert shared_tokens(empty, one).count() == shared_tokens(one, empty).count() == shared_tokens(empty, empty).count() == 0
    assert similar_pairs(empty, one, 0.5).count() == similar_pairs(one, empty, 0.5).count() == 0
    parts = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (2, ["a", "a", "a"])], "id bigint, sig array<string>")
    assert sorted(map(tuple, shared_tokens(parts, parts).collect())) == [(1, 2, 1, 2), (2, 1, 1, 2)]


def shuffled(spark):
    """Records that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def common_token(spark, tmp_path_factory):
    """2,001 rows that share a token with each of 40 searches, 80,000 pairs. Rows 2i and 2i + 1 are near copies."""
    d = str(tmp_path_factory.mktemp("common"))
    code = F.concat(F.lit("@Test "), *[F.format_string(f"v{k}x%d.run( ", F.expr("id div 2")) for k in range(4)], F.when(F.expr("id % 2 = 1"), "Thread").otherwise(""))
    spark.range(1, 2002).select(F.when(F.col("id") % 50 == 0, F.col("id") * 2).otherwise(F.col("id") * 100 + 1).alias("id"), code.alias("code")).write.parquet(f"{d}/dataset.parquet")
    return d


def test_pairs_of_a_common_token_are_not_shuffled(spark, common_token):
    from siftline.plans.queries import queries

    before = shuffled(spark)
    got = queries()["similarity_join"](spark, common_token)
    assert got.agg(F.count("*"), F.count_if(F.col("inter") > 4)).first() == (80_000, 40)
    assert shuffled(spark) - before < 40_000


def test_similar_pairs_of_a_common_token_are_not_shuffled(spark, common_token):
    from siftline.plans.queries import queries

    before = shuffled(spark)
    got = {(r.query_id, r.cand_id) for r in queries()["min_similarity_filter"](spark, common_token).collect()}
    assert got == {(100 * k, (50 * k + 1) * 100 + 1) for k in range(1, 41)}
    assert shuffled(spark) - before < 40_000


def answer(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(extract_answer(F.col("t")).alias("a")).first().a
    return r.is_flaky, r.category


def test_answers(spark):
    assert answer(spark, "答案：是 - Async类型") == ("是", "Async类型")
    assert answer(spark, "Answer: yes – time") == ("是", "time")
    assert answer(spark, "Answer：No - OD. 答案：是 - UC") == ("是", "UC")
    assert answer(spark, "no answer") == (None, None)
    assert answer(spark, None) == (None, None)


def test_labels(spark):
    df = spark.createDataFrame([("non flaky",), ("Concurrency",), ("foo",), ("",), (None,), (" NON-flaky ",)], "c string")
    got = df.select(truth_verdict(F.col("c")).alias("v"), truth_category(F.col("c")).alias("t"), normalize_category(F.col("c")).alias("n"), label_category("c").alias("l")).collect()
    assert (got[0].v, got[0].t) == ("是", "Non-Flaky")
    assert got[1].n == "Conc" and got[2].n == "foo" and got[3].n == "Unknown" and got[4].n == "Unknown"
    assert (got[5].v, got[5].t, got[5].l) == ("否", "Non-Flaky", "Non-Flaky")
    assert got[2].l is None and got[3].l is None and got[4].l is None


def test_project_key(spark):
    same = ["Munharhar_knob", "munharhar-knob.git", "Munharhar/knob", " munharhar knob\xa0", "Munharhar＿knob.git "]
    df = spark.createDataFrame([(x,) for x in same], "p string")
    assert {r.k for r in df.select(project_key("p").alias("k")).collect()} == {"munharharknob"}
    other = spark.createDataFrame([("munharhar_knob2",), ("legit",)], "p string").select(project_key("p").alias("k")).collect()
    assert [r.k for r in other] == ["munharharknob2", "legit"]


def test_prompts(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(format_prompt("<{a}|{b}>", a=F.col("a"), b=F.col("b")).alias("p")).first().p == "<{b}|x>"
    with pytest.raises(KeyError):
        format_prompt("{missing}", a=F.col("a"))
    r = spark.createDataFrame([("p code q code", "code", "B")], "p string, c string, b string")
    got = r.select(fewshot_insert(F.col("p"), F.col("c"), F.col("b")).alias("x"), format_percentage(F.lit(0.12345)).alias("f")).first()
    assert got.x.count("B\n待分析的测试代码:\ncode") == 2 and got.f == "12.35%"


def test_fixed_decimals(spark):
    from siftline.functions.numbers import fixed

    rnd = random.Random(2)
    xs = [0.0, 0.365, 0.355, 0.375, 0.125, 0.005, 0.015, 0.8, 99.995, 84.0] + [rnd.randint(0, 20000) / 2000 for _ in range(500)] + [rnd.random() * 100 for _ in range(500)]
    xs += [-0.365, -12.005, -1.5] + [-rnd.random() * 100 for _ in range(100)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fixed(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:.2f}" for r in got]


def published(spark):
    rows = [("否", "Non-Flaky", "否", "Non-Flaky")] * 84
    rows += [("是", c, "否", "Non-Flaky") for c, n in (("Async", 8), ("Conc", 3), ("Time", 3), ("OD", 1)) for _ in range(n)]
    rows += [("是", "Async", "是", "Conc")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, pred_flaky string, pred_category string, true_flaky string, true_category string")


def test_published_confusion(spark):
    a = published(spark)
    o = M.overall_metrics(a).first()
    assert (o.tp, o.fp, o.tn, o.fn) == (1, 15, 84, 0)
    assert (o.overall_accuracy, o.verdict_accuracy, o.precision, o.recall) == (0.84, 0.85, 0.0625, 1.0)
    assert round(o.f1, 6) == 0.117647
    per = {r.category: r for r in M.per_category_metrics(a).collect()}
    assert set(per) == {"Non-Flaky", "Conc"} and round(per["Non-Flaky"].recall, 6) == 0.848485 and per["Non-Flaky"].precision == 1
    assert M.error_cases(a).count() == 16
    empty = M.overall_metrics(a.limit(0)).first()
    assert empty.total == 0 and empty.f1 == 0


def test_evaluator_report(spark):
    a = published(spark)
    ev = Evaluator(a.select("id", F.col("pred_flaky").alias("is_flaky"), F.col("pred_category").alias("category")), a.select("id", F.col("true_flaky").alias("is_flaky"), F.col("true_category").alias("category")))
    text = ev.report()
    assert "overall 84.00%" in text and "verdict 85.00% (poor)" in text and "Non-Flaky: 99 (99.0%)" in text and tuple(ev.counts().first()) == (0, 0)


def test_reports_written(spark, tmp_path):
    items = spark.createDataFrame([(1, 5, "答案：是 - OD"), (2, 6, "答案：否 - Non-Flaky"), (3, 7, "?")], "item_id bigint, id bigint, output string")
    labels = spark.createDataFrame([(5, "od"), (6, "time"), (9, "uc")], "id bigint, label string")
    Evaluator.run(items, labels, str(tmp_path / "e"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "e/metrics").glob("*.json")))
    assert got["total_samples"] == 2 and got["flaky_detection"]["confusion_matrix"] == {"tp": 1, "fp": 0, "tn": 0, "fn": 1} and got["unmatched_labels"] == 1
    assert got["error_cases"] == [{"id": 6, "predicted": "否 - Non-Flaky", "actual": "是 - Time", "error_type": "both"}]
    assert got["category_classification"]["per_category"]["OD"]["recall"] == 1.0
    assert "rows 2" in "".join(p.read_text() for p in (tmp_path / "e/report").glob("*.txt"))
    df = spark.createDataFrame([(1, "a();", "od"), (2, None, None)], "id bigint, code string, label string")
    _, text = explain(df, 1, folder=str(tmp_path / "x"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "x/explanation").glob("*.json")))
    assert got["total_records"] == 2 and got["explanation"] == text and got["label_distribution"] == [{"label": "od", "n": 1, "percent": 50.0}]
    assert "code string: 1 of 2 null" in "".join(p.read_text() for p in (tmp_path / "x/explanation_text").glob("*.txt"))


def test_positional_predictions(spark):
    rows = [(10, None, "答案：是 - OD"), (11, 0, "nothing"), (12, None, "答案：否 - Non-Flaky"), (13, 2, "Answer: Yes - time")]
    df = spark.createDataFrame(rows, "item_id bigint, id bigint, output string").repartition(3)
    got = {r.id: (r.is_flaky, r.category) for r in predictions_from_items(df, "item_id").collect()}
    assert got == {0: ("是", "OD"), 2: ("是", "Time")}


def test_split_sizes(spark):
    df = spark.range(10).withColumn("label", F.lit("a"))
    got = {r.split: r.n_rows for r in S.split_summary(S.split_dataset(df, stratify="label")).collect()}
    assert got == {"train": 7, "valid": 2, "test": 1}
    n = {r.split: r.n_rows for r in S.split_summary(S.split_dataset(spark.range(100), 0.29, 0.29, 0.42)).collect()}
    assert n == {"train": 28, "valid": 28, "test": 44}
    with pytest.raises(ValueError):
        S.check_ratios(0.5, 0.4)
    assert S.split_dataset(spark.range(0)).count() == 0
    a = {r.id: r.split for r in S.split_dataset(spark.range(200).repartition(7)).collect()}
    b = {r.id: r.split for r in S.split_dataset(spark.range(200).repartition(2)).collect()}
    assert a == b


def test_folds(spark):
    rnd = random.Random(1)
    rows = [(i, f"p{rnd.randint(0, 29)}", 0 if rnd.random() < 0.9 else rnd.randint(1, 5)) for i in range(600)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "id bigint, project string, category int")
    folds = S.project_folds(df)
    assert {r.project: r.fold for r in folds.collect()} == {r.project: r.fold for r in S.project_folds(df.repartition(9)).collect()}
    sides = S.fold_sides(df, folds)
    assert S.fold_overlap(sides).count() == 0 and sides.count() == 4 * 600
    sizes = [r["count"] for r in S.with_folds(df, folds).groupBy("fold").count().collect()]
    assert sum(sizes) == 600


def test_samples(spark):
    df = spark.range(50)
    assert [r.id for r in sample_data(df, "first", 3).collect()] == [0, 1, 2]
    assert sorted(r.id for r in sample_data(df, "last", 3).collect()) == [47, 48, 49]
    assert sample_data(df, "random", 7).count() == 7 and sample_data(df, "random", 99).count() == 50
    with pytest.raises(ValueError):
        sample_data(df, "some")


def test_positions(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(100)], "k bigint").repartition(6)
    assert [r.pos for r in with_position(df, ["k"]).orderBy("k").collect()] == list(range(100))


def test_paths_of_other_file_systems():
    assert join("hdfs://nn:8020/out/", "run") == "hdfs://nn:8020/out/run"


def test_folds_written(spark, tmp_path):
    rows = [(1, "train", "b", 7), (1, "train", "a", 8), (1, "test", "c", 9), (2, "test", "a", 8), (2, "train", None, 5)]
    save_folds(spark.createDataFrame(rows, "fold int, side string, project string, id bigint"), str(tmp_path / "f"), "json")
    assert spark.read.json(str(tmp_path / "f")).count() == 5
    text = "".join(p.read_text() for p in (tmp_path / "f/_lists/fold_1_projects").glob("*.txt"))
    assert text.split() == ["训练集项目", "(2):", "a", "b", "测试集项目", "(1):", "c"]
    with pytest.raises(ValueError):
        save_folds(spark.range(1), str(tmp_path / "x"), "xml")


def test_source_listings(spark, tmp_path):
    for n in ("z.csv", "fold_2.csv", "dataset.csv", "fold_1.csv", "a.json", "b_external.json"):
        (tmp_path / n).write_text("x")
    assert list_datasets(spark, str(tmp_path)) == ["dataset.csv", "fold_1.csv", "fold_2.csv", "z.csv"]
    assert list_prediction_files(spark, f"file://{tmp_path}") == ["b_external.json"] and list_datasets(spark, str(tmp_path / "none")) == []


def test_last_label_of_an_id_counts(spark):
    df = spark.createDataFrame([(1, "time", 2), (1, "uc", 1), (2, "od", 0)], "id bigint, label string, place int").coalesce(1)
    assert {r.id: r.category for r in truth_from_labels(df).collect()} == {1: "UC", 2: "OD"}
    assert {r.id: r.category for r in truth_from_labels(df, order="place").collect()} == {1: "Time", 2: "OD"}


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, `b c` string")
    assert {r.column: r.n_null for r in table_profile(df).collect()} == {"a": 0, "b c": 1}
    assert [tuple(r) for r in null_percentages(df).collect()] == [("b c", 1, 50.0)]


@pytest.mark.parametrize("values,want", [([3.0, 1.0, 2.0], 2.0), ([4.0, None, 1.0, 2.0, 2.5], 2.25), ([7.0] * 5, 7.0), ([], None)])
def test_median(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    assert median(df, "s").first().median == want


def test_corpus_round_trip(spark, tmp_path):
    rows = [(1, "p", None, 'say "x",\nline 2\r\n', "time", 3), (2, "q", "t", "中文", "non-flaky", 0)]
    df = spark.createDataFrame(rows, "id bigint, project string, test_name string, full_code string, label string, category int")
    save_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    back = read_corpus(spark, str(tmp_path / "s" / "split=train")).orderBy("id").collect()
    assert [tuple(r)[:3] for r in back] == [(1, "p", None), (2, "q", "t")] and back[0].full_code.startswith('say "x",\nline 2') and back[1].full_code == "中文"
    with pytest.raises(ValueError):
        save_splits(df, str(tmp_path / "x"), "xml")


def test_items_and_json(spark, tmp_path):
    items = spark.createDataFrame([("i", "in", "out", 7, None)], "instruction string, input string, output string, id bigint, few_shot_examples array<struct<similarity:double>>")
    save_items(items, str(tmp_path), "run", True)
    assert spark.read.json(str(tmp_path / "run")).columns == ["input", "instruction", "output"]
    assert "id" in spark.read.json(str(tmp_path / "run_external")).columns
    save_json(spark.createDataFrame([(2, float("nan")), (1, 0.5)], "id int, x double"), str(tmp_path / "doc"), lines=False)
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("*.txt"))
    assert json.loads(text) == [{"id": 1, "x": 0.5}, {"id": 2, "x": None}]
    (tmp_path / "one.json").write_text(json.dumps([{"instruction": "a", "input": "b", "output": "c"}]))
    assert read_items(spark, str(tmp_path / "one.json")).first().output == "c"


def test_model_calls(spark):
    state = {"n": 0}

    def flaky(system, prompt):
        state["n"] += 1
        if prompt == "bad" or state["n"] % 2:
            raise RuntimeError
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id bigint, prompt string").coalesce(1)
    got = {r.id: (r.output, r.calls) for r in call_model(df, "prompt", flaky, wait=0).collect()}
    assert got[1] == ("A", 2) and got[2] == (None, 3) and got[3] == (None, 0)
    s = call_statistics(call_model(df, "prompt", flaky, wait=0)).first()
    assert s.n_rows == 3 and s.n_output == 1


def test_calls_keep_their_rate(spark):
    import time

    def model(system, prompt):
        return Reply(str(time.time()), 3)

    df = spark.createDataFrame([(i, "x") for i in range(9)], "id bigint, prompt string").coalesce(1)
    rows = call_model(df, "prompt", model, threads=4, per_second=20).collect()
    at = sorted(float(r.output) for r in rows)
    assert min(b - a for a, b in zip(at, at[1:])) > 0.02 and at[-1] - at[0] > 0.35
    assert call_statistics(call_model(df, "prompt", model, workers=3)).first().tokens == 27


def test_equal_ids_of_other_tables_are_examples(spark):
    code = "@Test void f() { Thread.sleep(1); list.add(1); }"
    kind = "id bigint, project string, test_name string, code string, label string"
    test, train = spark.createDataFrame([(1, "p", "t", code, "time")], kind), spark.createDataFrame([(1, "q", "u", code, "time")], kind)
    assert [e.id for e in distill(test, train, wait=0)[0].first().few_shot_examples] == [1]
    assert distill(test, train, wait=0, skip_self=True)[0].first().few_shot_examples is None


def test_distill_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}", f"t{i}", "@Test void f() { Thread.sleep(1); list.add(1); }", "time") for i in range(6)], "id bigint, project string, test_name string, code string, label string")
    items, failed = distill(df.filter("id < 2"), df.filter("id >= 2"), wait=0)
    rows = items.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == [0, 1]
    assert len(rows) == 2 and failed.count() == 0 and len(rows[0].few_shot_examples) == 3
    assert rows[0].few_shot_examples[0].similarity == 0.8 and rows[0].output.endswith("</answer>")
    at = str(tmp_path / "r")
    assert resume(df.filter("id < 3"), at, lambda x: x.select("id"), batches=2).count() == 3
    assert sorted(r.id for r in resume(df, at, lambda x: x.select("id"), batches=2).collect()) == list(range(6))


def test_steps_and_config(spark, tmp_path):
    def broken(df):
        raise ValueError("no")

    out = run_steps([("a", lambda d: d), ("b", broken)], spark.range(1), [0, 1, 7])
    assert [x[2] for x in out] == ["", "no", "no such step"]
    save_config(str(tmp_path), "one", RunConfig(test_dataset="x/fold_1_test.csv", use_api_matching=True, top_k_shots=99))
    c = load_config(str(tmp_path), "one")
    assert c.top_k_shots == 10 and c.output_name == "fold_1_test_top10_all" and "top_k_shots: 10" in display_config(c)


def test_stream(spark, tmp_path):
    from siftline.streaming.evaluation import parsed_stream, windowed_metrics

    kind = "item_id bigint, id bigint, output string, received_at timestamp"
    rows = [(1, 1, "答案：是 - OD", "2025-01-01 00:00:00"), (1, 1, "答案：是 - OD", "2025-01-01 01:00:00"), (2, 2, "x", "2025-01-01 00:00:00"), (3, 2, "Answer: No - UC", "2025-01-02 00:00:00")]
    spark.createDataFrame(rows, "item_id bigint, id bigint, output string, t string").selectExpr("item_id", "id", "output", "timestamp(t) AS received_at").write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([(1, "是", "OD"), (2, "是", "UC")], "id bigint, is_flaky string, category string")
    s = windowed_metrics(parsed_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), truth)
    q = s.writeStream.outputMode("update").format("memory").queryName("m").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.total, r.tp, r.fn) for r in spark.sql("select * from m").collect())
    assert got == [(1, 0, 1), (1, 1, 0)]


def test_core_does_not_need_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "siftline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siftline.llm" not in p.read_text()
