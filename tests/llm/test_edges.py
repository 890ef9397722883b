"""Nulls, empty tables, repeated rows, clashing columns and odd texts, for every operator."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import crossover, entity_splits, leakage, neardup, packing, pairs, proportional, repetition, sentences, truncation
from siftline.llm.graph import connected_components
from siftline.llm.wordsets import overlaps

LONG = " ".join(f"word{i} middle" for i in range(30_000))


def test_proportional(spark):
    targets = spark.createDataFrame([("p", "Async", 0.5, 2, 1.0), ("p", "UC", 0.5, 1, 1.0), ("p", "OD", 0.0, 0, 1.0)], "plan string, category string, target_share double, min_rows int, sample_share double")
    rows = [(i, "async wait", "x") for i in range(10)] + [(50, None, "x"), (51, "?", None), (52, "", None), (53, "U.C", "y"), (53, "U.C", "y")]
    df = spark.createDataFrame(rows, "id bigint, label string, plan string").repartition(4)
    picked, report = proportional.sample_to_targets(df, targets)
    got = {r.category: (r.available, r.need, r.drawn, r.shortfall) for r in report.collect()}
    assert got["UC"] == (2, 7.5, 2, True) and got["OD"] == (0, 0.0, 0, False)
    assert got["Async"][0] == 10 and got["Async"][2] in (7, 8) and not got["Async"][3]
    assert picked.filter("category = 'UC'").count() == 2
    assert {r.id for r in picked.collect()} == {r.id for r in proportional.sample_to_targets(df, targets)[0].collect()}
    none, report = proportional.sample_to_targets(df.limit(0), targets)
    assert none.count() == 0 and {r.category: r.shortfall for r in report.collect()} == {"Async": True, "UC": True, "OD": False}


def test_flight_keeps_totals():
    ids = np.arange(1000)
    for p in (0.0, 0.123, 0.5, 0.9, 1.0):
        out = proportional._flight(ids, np.full(1000, p), np.uint64(5))
        assert abs(out.sum() - 1000 * p) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1
    want = np.array([0.1, 0.9, 0.3, 0.45, 0.25])
    means = np.mean([proportional._flight(ids[:5], want, np.uint64(s * 7919)) for s in range(4000)], axis=0)
    assert np.abs(means - want).max() < 0.04


def test_samples_of_plans_are_independent_and_keep_their_sizes(spark):
    names = ["Async", "Conc", "UC"]
    df = spark.createDataFrame([(i, names[i % 3]) for i in range(900)], "id bigint, label string").repartition(70)
    plans = [f"plan_{i}" for i in range(12)]
    rows = [(p, c, s, 0, 100.5 / 900) for p in plans for c, s in zip(names, (0.105, 0.345, 0.55))]
    picked, report = proportional.sample_to_targets(df, spark.createDataFrame(rows, "plan string, category string, target_share double, min_rows int, sample_share double"))
    got = {}
    for r in picked.collect():
        got.setdefault(r.plan, set()).add(r.id)
    assert {len(got[p]) for p in plans} == {100}
    assert all(abs(r.imbalance) < 1 for r in report.collect())
    # two samples of 100 of 900 share about 11 to 15 rows
    shared = [len(got[a] & got[b]) for a, b in itertools.combinations(plans, 2)]
    assert max(shared) < 35 and 5 < np.mean(shared) < 25


def test_entities(spark):
    rows = [(1, "A_b"), (2, "a-B.git"), (3, None), (4, None), (5, "___"), (6, "--"), (7, "A_b"), (8, "ab2")]
    df = spark.createDataFrame([(i, p, "time", 9) for i, p in rows], "id bigint, project string, label string, comp int")
    comps = {r.project: r.comp for r in entity_splits.project_components(df).collect()}
    assert comps["A_b"] == comps["a-B.git"] != comps["ab2"] and comps["___"] != comps["--"] and None in comps
    assert [tuple(r) for r in entity_splits.same_entity_spellings(entity_splits.project_components(df)).collect()] == [("A_b", "a-B.git")]
    targets = spark.createDataFrame([("p", "train", 0.5), ("p", "test", 0.5)], "plan string, split string, target_share double")
    out = {r.id: r.split for r in entity_splits.assign_splits(df, targets).collect()}
    assert len(out) == 8 and out[1] == out[2] == out[7] and out[3] == out[4]
    assert entity_splits.assign_splits(df.limit(0), targets).count() == 0


def test_entity_chain(spark):
    """A chain of nodes and entities far longer than its rounds."""
    n = 200
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node bigint")
    edges = spark.createDataFrame([(i, f"e{i + k}") for i in range(n) for k in (0, 1)], "node bigint, entity string")
    assert {r.comp for r in entity_splits.entity_components(nodes, edges).collect()} == {0}


def test_light_entities_mend_what_heavy_ones_left(spark, monkeypatch):
    """One project holds all of one label, in one split; the light ones bring the others to their labels."""
    monkeypatch.setattr(entity_splits, "HEAVY_SHARE", 0.2)
    rows = [(i, "big", "time") for i in range(300)] + [(1000 + i, f"p{i}q", "conc" if i % 4 else "uc") for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, project string, label string")
    targets = spark.createDataFrame([("p", "train", 0.7), ("p", "test", 0.3)], "plan string, split string, target_share double")
    out = entity_splits.assign_splits(df, targets).join(df, "id").groupBy("label", "split").count().collect()
    n = {(r.label, r.split): r["count"] for r in out}
    assert abs(n["conc", "test"] - 180) <= 2 and abs(n["uc", "test"] - 60) <= 2


ITEMS = "item_id bigint, input string, output string, cut string, tokens int"


def items(spark, outputs, prompt="[a_b] test\n@Test\npublic void f() { }"):
    return spark.createDataFrame([(i, prompt, o, "c", 1) for i, o in enumerate(outputs)], ITEMS)


def test_truncation(spark):
    whole = [f"The order of Foo{i}Bar is fixed by the list of checks.\nAnswer: No - Non-Flaky" for i in range(60)]
    odd = ["The order of Foo1Bar is fixed by the", "The order of Foo2Bar is fixed by the.", "The order of Foo3Bar is fixed by the list of che", "<think>\nThe order", "The order of Foo4Bar is fixed.\nAnswer: No - Non", None, "", "  \n", "ok", "…", LONG]
    got = {r.item_id: r.reason for r in truncation.cut_off(items(spark, whole + odd), "item_id", "output", "input").collect()}
    assert all(got[i] is None for i in range(60))
    assert [got[60 + i] is not None for i in range(8)] == [True, True, True, True, True, False, False, False]
    assert truncation.cut_off(items(spark, []), "item_id", "output", "input").count() == 0
    twice = items(spark, whole).unionByName(items(spark, whole))
    assert truncation.truncation_rates(twice, "item_id", "cut", truncation.cut_off(twice, "item_id", "output", "input")).first().n_items == 120


def test_truncation_of_short_texts_and_elements(spark):
    """The first words of texts that mostly go on, a last word far from the end, and elements that most texts close."""
    line = "The order of Foo{}Bar is fixed by the list."
    whole = [line.format(i) if i % 2 else f"<note>{line.format(i)}</note>" for i in range(120)]
    odd = ["The order", "The order.", "<note>The order of Foo1Bar is fixed by the list.", "<List> The order of Foo1Bar is fixed by the list.", "The order of Foo1Bar is fixed by the" + "\n-" * 30]
    got = {r.item_id: r.reason for r in truncation.cut_off(items(spark, whole + odd), "item_id", "output", "input").collect()}
    assert not any(got[i] for i in range(120))
    assert [got[120 + i] for i in range(4)] == ["sentence", "sentence", "tag", None] and got[124]


def test_pairs(spark):
    good = [f"The order of Foo{i}Bar is fixed by the list.\nAnswer: No - Non-Flaky" for i in range(20)]
    bad = ["I cannot help with Foo1Bar.", "I cannot help with Foo2Bar.", None, "<think> </think>", "public void f() { Foo1 a1 = b2; c3(d4); e5(f6); }", "这里没有任何等待，顺序由列表决定。\nAnswer: No - Non-Flaky"]
    rows = [(i, f"[a_b] test{i}\n@Test\npublic void f() {{ Foo1 a1 = b2; c3(d4); e5(f6); }}", o, None, 1) for i, o in enumerate(good + bad)]
    got = {r.item_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, ITEMS), "item_id", "input", "output").collect()}
    assert all(got[i] is None for i in range(20))
    assert [got[20 + i] for i in range(6)] == ["refusal", "refusal", "empty", "empty", "copy", "wrong_language"]
    assert pairs.defective_pairs(items(spark, []), "item_id", "input", "output").count() == 0
    assert pairs.defective_pairs(items(spark, [None, "", LONG], prompt=None), "item_id", "input", "output").count() == 3


def test_opening_clusters(spark, monkeypatch):
    """Pairs and chains of openings that all have frequent word pairs in common, against brute force."""
    monkeypatch.setattr(pairs, "BLOCK", 4, raising=False)
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    texts = [f"sorry but {own(i // 2, 5)} {own(1000 + i, 1)}" for i in range(80)] + [f"sorry but {own(2000 + i, 6)}" for i in range(40)]
    texts += [" ".join(f"c{k}" for k in range(s, s + 8)) for s in range(0, 12, 2)]
    texts += [f"i am sorry but for this test {own(3000 + i, 13)}" for i in range(600)] + [f"i am sorry but for this test {own(4000 + i, 2)}" for i in range(5)]
    sets = [set(pairs._shingles(t)) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    got = {r.opening: r.cluster for r in pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    parts = lambda label: {frozenset(t for t, x in zip(texts, label) if x == v) for v in set(label)}
    assert len(parts(root)) > 60 and parts([got[t] for t in texts]) == parts(root)


def test_short_copies_and_bracketed_names(spark):
    rows = [(1, "[a_b] it waits for one second only.\n@Test\npublic void f() { }", "it waits for one second only.", None, 1)]
    rows += [(2, "【Big window/journal】 testX1\n@Test\npublic void f() { }", "这里没有任何等待，顺序由列表决定。\n答案：否 - Non-Flaky", None, 1)]
    got = {r.item_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, ITEMS), "item_id", "input", "output").collect()}
    assert got == {1: "copy", 2: None}


def test_names_of_long_prompts():
    prompt = "[a_b] " + "filler words " * 60 + "my_module.py\n@Test\npublic void f() { }"
    assert {"my", "module"} <= pairs.prompt_names(prompt)


def test_near_duplicates(spark):
    words = [f"tok{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:36] + ["x1", "x2", "x3", "x4"]), " ".join(reversed(words)), None, "", " ".join(f"other{i}" for i in range(40)), "one", LONG, LONG + " more"]
    rows = [(i, t, None, "g") for i, t in enumerate(texts)] + [(100 + i, texts[0], None, "g") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, code string, test_name string, group_id string").repartition(3)
    links, members = neardup.near_duplicates(df, "id", ["test_name", "code"])
    g = {r.id: r.group_id for r in members.collect()}
    assert len(g) == len(rows) and g[0] == g[1] == g[2] == g[120] == 0 and g[3] == 3 and g[4] == 4 and g[5] == 5 and g[6] == 6 and g[7] == g[8]
    assert neardup.grouped_pairs(members).count() == 53 * 52 // 2 + 1
    links, members = neardup.near_duplicates(df.limit(0), "id", ["test_name", "code"])
    assert links.count() == 0 and members.count() == 0


def test_near_duplicates_in_one_large_bucket(spark, monkeypatch):
    """A family of distinct texts that fills whole buckets, beyond the size for all pairs."""
    monkeypatch.setattr(neardup, "BUCKET", 4)
    base = [f"tok{i}" for i in range(40)]
    rows = [(i, " ".join(base[:37] + [f"a{i}", f"b{i}", f"c{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, code string")
    _, members = neardup.near_duplicates(df, "id", ["code"])
    assert {r.group_id for r in members.collect()} == {0}


def brute_links(texts):
    b = [collections.Counter(t.split()) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(b)), 2) if sum((b[i] & b[j]).values()) >= 0.75 * max(b[i].total(), b[j].total())}


def found_links(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, code string")
    return {(r.a, r.b) for r in neardup.near_duplicates(df, "id", ["code"])[0].collect()}


def test_all_links_of_large_buckets(spark, monkeypatch):
    """Links between members that are both alike to a bucket's first, and a chain whose ends are not."""
    monkeypatch.setattr(neardup, "BUCKET", 4)
    base = [f"tok{i}" for i in range(40)]
    texts = [" ".join(base[:37] + [f"a{i}", f"b{i}", f"c{i}"]) for i in range(30)]
    texts += [" ".join(base[s:] + [f"z{k}" for k in range(s)]) for s in (6, 14)]
    want = brute_links(texts)
    assert (30, 31) in want and (0, 30) in want and (0, 31) not in want
    assert found_links(spark, texts) == want


@pytest.mark.parametrize("common", [28, 30])
def test_links_in_a_family_of_frequent_words(spark, common):
    """70 to 75 % of the words are the family's; pairs share two of their own words."""
    base = [f"tok{i}" for i in range(common)]
    texts = [" ".join(base + [f"p{i // 2}", f"q{i // 2}"] + [f"o{i}x{k}" for k in range(38 - common)]) for i in range(150)]
    want = brute_links(texts)
    assert len(want) == (75 if common == 28 else 150 * 149 // 2)
    assert found_links(spark, texts) == want


@pytest.mark.parametrize("share", [0.1, 0.14, 0.2])
def test_links_of_planted_clusters(spark, share):
    """A cluster of a few hundred variants of one text of 120 words, words replaced, and some others."""
    rnd = np.random.default_rng(int(share * 100))
    base = [f"tok{i}" for i in range(120)]
    texts = [" ".join(f"n{i}x{k}" if rnd.random() < share else w for k, w in enumerate(base)) for i in range(200)]
    texts += [" ".join(f"o{i}x{k}" if k % 3 else base[k] for k in range(120)) for i in range(50)]
    assert found_links(spark, texts) == brute_links(texts)


def test_repeated_ids_of_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, one), (4, one)]
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, "id bigint, code string"), "id", ["code"])
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2), (1, 3)} and members.count() == 6
    assert {r.group_id for r in members.collect()} == {1}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (200, 100), (300, 300)], "a bigint, b bigint")
    got = {r.node: r.comp for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[i] for i in (100, 101, 200)} == {100} and got[300] == 300
    assert connected_components(links.limit(0)).count() == 0


def binary(rows):
    return pa.array([np.array(r, "<u4").tobytes() for r in rows], pa.binary())


def test_alignment():
    a, b = [[1, 2, 3, 4, 5], [1, 2], [], [7] * 20], [[1, 9, 3, 4, 5], [2, 1], [1], [7] * 18 + [8, 8]]
    assert neardup.banded_lcs(binary(a), binary(b)).tolist() == [4, 1, 0, 18]
    assert overlaps(binary(a), binary(b)).tolist() == [4, 2, 0, 18]


def test_crossover(spark):
    w = [f"tok{i}" for i in range(30)]
    rows = [(1, " ".join(w), "train"), (2, " ".join(w[:27]) + " z1 z2", "test"), (3, " ".join(w), "valid"), (4, None, "test"), (5, "", "train"), (6, " ".join(w), None), (7, "solo", "train"), (8, "solo", "test"), (9, " ".join(w), "train")]
    df = spark.createDataFrame([(i, c, s, "p", "x") for i, c, s in rows], "id bigint, code string, split string, project string, train string")
    got = {(r.id_h, r.id_t) for r in crossover.split_overlaps(df).collect()}
    assert got == {(2, 1), (3, 1), (2, 9), (3, 9), (8, 7)}
    assert crossover.split_overlaps(df.limit(0)).count() == 0
    assert crossover.overlap_counts(crossover.split_overlaps(df)).filter("split = 'test'").first().n_records == 2


@pytest.mark.parametrize("block", [1024, 4])
def test_crossover_of_frequent_words(spark, monkeypatch, block):
    """Short copies of frequent words, scattered words, and a third of the rows as variants of one text."""
    monkeypatch.setattr(crossover, "BLOCK", block)
    base = [f"tok{i}" for i in range(42)]
    rows = [" ".join(f"v{i}x{k // 7}" if k % 7 == 3 else w for k, w in enumerate(base)) for i in range(150)]
    rows += [f"tok0 tok1 own{i} tok2 tok3 rare{i}" for i in range(300)] + ["tok0 tok1", "tok0 tok1 tok2", "tok2 tok1 tok0"]
    rows += [" ".join(f"s{k}" for k in range(20)), " ".join(f"s{19 - k}" for k in range(20))]
    split = ["test" if i % 3 == 0 or i == len(rows) - 1 else "train" for i in range(len(rows))]
    bags = [collections.Counter(t.split()) for t in rows]
    want = {(h, t) for h, t in itertools.product(range(len(rows)), repeat=2) if (split[h], split[t]) == ("test", "train") and sum((bags[h] & bags[t]).values()) >= 0.8 * bags[h].total()}
    df = spark.createDataFrame([(i, c, s, "p") for i, (c, s) in enumerate(zip(rows, split))], "id bigint, code string, split string, project string")
    assert {(r.id_h, r.id_t) for r in crossover.split_overlaps(df).collect()} == want and (0, 1) in want and (450, 451) in want


def test_repetition(spark):
    unit = "The same words stand here once more and again. "
    outs = [unit * 20, "short", None, "", "1. x\n2. x\n", LONG, "\n".join(f"{i}. {unit}" for i in range(9))]
    got = {r.item_id: r for r in repetition.repeated_documents(items(spark, outs), "item_id", "output").collect()}
    assert [got[i].bad for i in range(7)] == [True, False, False, False, False, False, True]
    assert got[2].n_chars == 0 and got[0].repeated_share > 0.9
    assert repetition.repeated_documents(items(spark, []), "item_id", "output").count() == 0


def test_repetition_beyond_the_sample(spark, monkeypatch):
    """The sample has one bad row, far off; the others are plainer than that and still bad."""
    monkeypatch.setattr(repetition, "SAMPLE_ROWS", 60)
    drawn = {r.id for r in spark.range(200).filter(f"pmod(xxhash64(id, 11), {1 << 30}) < {int(60 / 200 * (1 << 30))}").collect()}

    def text(i, again):
        w = [f"w{i:03}x{k:02}" for k in range(50 - again)]
        return " ".join(w + w[:again])

    outs = [text(i, i % 19 if i in drawn else 22) for i in range(200)]
    outs[min(drawn)] = "The same words stand here once more and again. " * 20
    got = {r.item_id: r for r in repetition.repeated_documents(items(spark, outs), "item_id", "output").collect()}
    want = {i for i, r in got.items() if r.repeated_share >= 0.4}
    assert want == set(range(200)) - drawn | {min(drawn)} and {i for i, r in got.items() if r.bad} == want


def test_forest_of_all_rows(spark, monkeypatch):
    """A few rows far off and many repeated ones: trees, scores and the median are of all rows, on the driver or in tasks."""
    rng = np.random.default_rng(3)
    outs = [" ".join(f"w{rng.integers(15 + i % 40)}" for _ in range(40)) for i in range(400)] + ["plain words"] * 300 + ["The same words stand here once more and again. " * 20]
    df = items(spark, outs).repartition(5)
    scores = []
    for most in (20_000, 60):
        monkeypatch.setattr(repetition, "SAMPLE_ROWS", most)
        scores.append({r.item_id: r for r in repetition.repeated_documents(df, "item_id", "output").collect()})
    assert len(scores[0]) == 701 and scores[0] == scores[1]
    stats = repetition.repetition_statistics(df, "item_id", "output")
    assert repetition.middle(spark.createDataFrame([(r.score,) for r in scores[0].values()], "score double").repartition(3)) == np.median([r.score for r in scores[0].values()])
    assert repetition.middle(spark.createDataFrame([(0.25,), (0.25,), (0.5,), (1.0,)], "score double")) == 0.375
    x = stats.select(*repetition.FEATURES).toPandas().to_numpy()
    forest = repetition.grown(stats)
    for tree in range(repetition.TREES):
        todo = [(0, 0, np.arange(len(x)))]
        while todo:
            node, level, rows = todo.pop()
            f, at = forest.feature[tree, node], forest.at[tree, node]
            if f < 0:
                assert level == repetition.DEPTH or len(rows) == 1 or (x[rows] == x[rows[0]]).all()
                assert forest.length[tree, node] == level + repetition._expected(len(rows))
            else:
                left = x[rows, f] < at
                assert x[rows, f].min() <= at <= x[rows, f].max()
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]


def test_packing(spark):
    docs = spark.createDataFrame([(i, "word " * n, 3) for i, n in enumerate([1, 5, 5, 5, 30, 0, 100])] + [(50, None, 3), (1, "word " * 5, 3)], "doc_id bigint, text string, rank int")
    spec = spark.createDataFrame([(1, 12, 2), (2, 1000, 0)], "spec_id int, capacity_tokens int, reserved_tokens int")
    out = packing.pack(docs, spec).toPandas()
    assert out[out.spec_id == 1].groupby("container_id").tokens.sum().max() <= 10
    assert out[out.spec_id == 2].container_id.nunique() == 1
    assert out[(out.spec_id == 1) & out.doc_id.isin([5, 50])].container_id.isna().all()
    assert packing.pack(docs.limit(0), spec).count() == 0 and packing.pack(docs, spec.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, spark.createDataFrame([(1, 5, 5)], spec.schema))


def test_histogram_packing():
    rng = np.random.default_rng(1)
    for cap in (7, 50, 333):
        h = {int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(1, cap + 1), min(cap, 25), replace=False)}
        back: dict = {}
        for n, lengths in packing.pack_histogram(h, cap):
            assert sum(lengths) <= cap
            for x in lengths:
                back[x] = back.get(x, 0) + n
        assert back == h


def test_shortest_pack_first():
    assert sorted(packing.pack_histogram({7: 1, 4: 1, 2: 1}, 10)) == [(1, (4, 2)), (1, (7,))]
    # piece by piece: each goes into the container with the most room, or into a new one
    rng = np.random.default_rng(2)
    for _ in range(30):
        h = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, 41, 9)}
        room: list[int] = []
        for x in sorted((k for k, n in h.items() for _ in range(n)), reverse=True):
            room.sort()
            if room and room[-1] >= x:
                room[-1] -= x
            else:
                room.append(40 - x)
        assert sorted(40 - sum(w) for n, w in packing.pack_histogram(h, 40) for _ in range(n)) == sorted(room)


def leak_tables(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    mixed = " or ".join(" ".join(w[a : a + 7]) for a in (21, 14, 0, 7))
    docs = [item.upper(), " ".join(w[15:30]) + " and " + " ".join(w[:14]), " ".join(w[:11]), None, "", "x" + LONG, "甲乙丙丁戊己庚辛壬癸" * 4, mixed, mixed[:60]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    ev = spark.createDataFrame([(1, item, "en"), (2, "甲乙丙丁戊己庚辛壬癸" * 3, "zh"), (3, "short", "en"), (4, None, "en")], "item_id bigint, text string, lang string")
    return df, ev


LEAKS = {(0, 1): (1, 30, 30, True), (1, 1): (2, 29, 15, True), (6, 2): (1, 30, 30, True), (7, 1): (4, 28, 7, False)}


@pytest.mark.parametrize("most", [20_000_000, 100])
def test_leakage(spark, monkeypatch, most):
    """Whole passages, passages in another order, with the items sent whole and joined by seed."""
    monkeypatch.setattr(leakage, "BLOCK_CHARS", most)
    df, ev = leak_tables(spark)
    assert {(r.doc_id, r.item_id): (r.tiles, r.covered, r.longest, r.verbatim) for r in leakage.leaked_items(df, ev).collect()} == LEAKS
    assert leakage.leaked_items(df.limit(0), ev).count() == 0 and leakage.leaked_items(df, ev.limit(0)).count() == 0
    twice = leakage.leaked_items(df.filter("doc_id = 0").unionByName(df.filter("doc_id = 0")), ev)
    assert twice.count() == 2


def test_joined_leaks_are_the_same(spark, small, monkeypatch):
    docs, ev = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "eval_item"))
    rows = lambda: sorted(tuple(r) for r in leakage.leaked_items(docs, ev).collect())
    whole = rows()
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1)
    assert rows() == whole and whole


def test_tiles_of_repetitive_texts():
    text, item = np.tile(np.arange(3, dtype=np.uint64), 400), np.tile(np.arange(3, dtype=np.uint64), 20)
    hits = [(p, q) for p in range(0, 1100, 7) for q in range(0, 50, 5) if (p - q) % 3 == 0]
    assert leakage.tile(text, item, hits, 6)[0][2] == 60


def cut(text):
    out, p = [], 0
    for e in sentences.sentence_units(text):
        out.append(text[p:e].strip())
        p = e
    return out


@pytest.mark.parametrize(
    "units",
    [
        ["It took approx. 5.3 s, e.g. on v2.1.", "The job starts at 4 a.m.", "That is early."],
        ['He said it is "all done."', "Tests run."],
        ['It printed "all done!" and stopped.'],
        ["Mehrere Tests, z. B. dieser, schlugen am 3. Mai zum 333. Mal fehl.", "Dateien, Sockets usw.", "Danach half nichts."],
        ["La console affiche « Terminé ! » puis rien.", "Pourquoi deux fois ?"],
        ["Con 7.18 todo era estable... hasta que cambió.", "¿Por qué?", "¡Vuelve!"],
        ["Файлы, сокеты и т. д.", "Проверьте ещё раз.", "Он возвращает, т. е. рано."],
    ],
)
def test_sentences(units):
    assert cut(" ".join(units)) == units


@pytest.mark.parametrize(
    "units",
    [["評審意見是：“不可靠。”", "控制台打印“完成！”之后就停了。", "本地复现不了……但服务器上有。"], ["担当者は「完了？」と書きました。", "画面には「空です。」と出ました。", "なぜですか？"], ["यह ठीक था!", "क्रम निर्भर है।", "क्यों?"]],
)
def test_sentences_without_blanks(units):
    assert cut("".join(units)) == units or cut(" ".join(units)) == units


def test_spans_hold_quotations_whole():
    many = " ".join(f"Part {i} is done." for i in range(40))
    assert cut(f'The log said "{many}" and stopped. Then all was well.') == [f'The log said "{many}" and stopped.', "Then all was well."]
    # one that is never closed binds nothing
    assert cut("He wrote (and left. Then the job ran twice. It passed.") == ["He wrote (and left.", "Then the job ran twice.", "It passed."]


def test_best_spans_against_all():
    rnd = np.random.default_rng(3)
    size = lambda z: sentences._LENGTH[z] if z <= sentences.LONG else sentences._LENGTH[sentences.LONG] + (sentences.LONG - z) / sentences.LONG_STEP
    for _ in range(300):
        *place, n = sorted(rnd.choice(np.arange(1, 1800), int(rnd.integers(2, 24)), replace=False).tolist())
        cand = [(p, rnd.uniform(-6, 3), rnd.uniform(-3, 1), int(rnd.integers(0, 3))) for p in place]
        at = {c[0]: c for c in cand}

        def score(a, b):
            begin = at[a][2] - sentences.UNBALANCED * at[a][3] if a in at else 0
            end = at[b][1] - sentences.UNBALANCED * at[b][3] if b in at else 0
            return begin + end + size(b - a)

        best = {0: 0.0}
        for b in [*place, n]:
            best[b] = max(v + score(a, b) for a, v in best.items())
        ends = sentences.best_spans(cand, n)
        assert abs(sum(score(a, b) for a, b in zip([0, *ends], ends)) - best[n]) < 1e-9


def test_layout():
    text = "﻿# Head. Two\n\nplain line one that is long enough to have been wrapped by an editor at\nsome width. Next.\r\n- one\n- two. Three\n> q one\n> q two\n```\ncode. Code\n\nx\n```\nlast"
    assert cut(text) == ["# Head. Two", "plain line one that is long enough to have been wrapped by an editor at\nsome width.", "Next.", "- one", "- two.", "Three", "> q one", "> q two", "```\ncode. Code\n\nx\n```", "last"] or cut(text)[0].endswith("# Head. Two")
    assert cut("第一行\n第二行") == ["第一行", "第二行"]


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n\t​", 5), (4, "One. Two.", 5), (4, "One. Two.", 5), (5, "```\nopen", 5), (6, LONG, 5)], "doc_id bigint, text string, unit int")
    got = {}
    for r in sentences.split_sentences(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, set()).add((r.unit, r.start_pos, r.end_pos))
    assert set(got) == {4, 5, 6} and got[4] == {(0, 0, 4), (1, 4, 9)} and got[5] == {(0, 0, 8)} and got[6] == {(0, 0, len(LONG))}
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0
