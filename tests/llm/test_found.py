"""The operators on small tables, against brute force."""

import collections
import itertools
import re

import pyarrow.parquet as pq
import pytest
from oracle import check

from siftline.llm import oracle, queries

Q = queries.queries()
SQL = oracle.oracle_sql()
W = re.compile(r"\w+")


def frame(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    check(spark, small, Q[name], SQL[name])


def test_p2_rates(spark, small):
    """Rates add up over the sources, and p2_found are the rows with a reason."""
    items = frame(small, "alpaca_item")
    reasons = {r.item_id: r.reason for r in Q["p2_reasons"](spark, small).collect()}
    assert reasons.keys() == set(items.item_id)
    cut = {i for i, x in reasons.items() if x}
    assert cut == {r.item_id for r in Q["p2_found"](spark, small).collect()} and not cut & set(items.item_id[items.output.isna()])
    for r in Q["p2_rates"](spark, small).collect():
        mine = items.item_id[items.source == r.source]
        assert (r.n_items, r.n_cut) == (len(mine), sum(i in cut for i in mine)) and r.rate == r.n_cut / r.n_items


def test_p4_counts(spark, small):
    found = Q["p4_found"](spark, small).toPandas()
    assert not found.item_id.duplicated().any() and set(found.defect) <= {"empty", "truncated", "refusal", "copy", "wrong_language"}
    items = frame(small, "alpaca_item")
    assert set(items.item_id[items.output.isna()]) <= set(found.item_id[found.defect == "empty"])
    want = found.merge(items[["item_id", "source"]]).groupby(["source", "defect"]).size().to_dict()
    assert {(r.source, r.defect): r.n_items for r in Q["p4_counts"](spark, small).collect()} == want


def test_p3_report(spark, small):
    for r in Q["p3_report"](spark, small).collect():
        assert abs(r.share - r.target_share) < 0.15
    assert sum(r.n_rows for r in Q["p3_report"](spark, small).collect()) == 4 * len(frame(small, "dataset"))


def test_p5_links(spark, small):
    """Links and their likeness, and that an alignment never has more words than the multisets share."""
    d = frame(small, "dataset")
    b = dict(zip(d.id, bags([(t + "\n" if t else "") + c for t, c in zip(d.test_name, d.code)])))
    links = Q["p5_links"](spark, small).collect()
    assert links
    for r in links:
        assert abs(r.overlap - sum((b[r.a] & b[r.b]).values()) / max(b[r.a].total(), b[r.b].total())) < 1e-9 and r.aligned <= r.overlap + 1e-9


def test_p9_items(spark, small):
    leaks = Q["p9_leaks"](spark, small).toPandas()
    assert {tuple(r) for r in Q["p9_found"](spark, small).collect()} == set(leaks[leaks.verbatim][["doc_id", "item_id"]].itertuples(index=False, name=None))
    assert (leaks.covered >= leaks.longest).all() and (leaks.coverage <= 1).all()
    assert {r.item_id: r.n_docs for r in Q["p9_items"](spark, small).collect()} == leaks.groupby("item_id").size().to_dict()


def test_p10_units(spark, small):
    """Units follow one another to the last visible character of every text."""
    text = dict(zip(frame(small, "documents").doc_id, frame(small, "documents").text))
    units = Q["p10_units"](spark, small).toPandas().sort_values(["doc_id", "unit"])
    for i, g in units.groupby("doc_id"):
        assert list(g.start_pos) == [0, *g.end_pos[:-1]] and g.end_pos.is_monotonic_increasing
        assert not re.search(r"\w", text[i][g.end_pos.iloc[-1] :]) and all(text[i][a:b].strip() for a, b in zip(g.start_pos, g.end_pos))
    assert {i for i, t in text.items() if t and re.search(r"\w", t)} <= set(units.doc_id)


def test_p1_totals(spark, small):
    rep = Q["p1_residuals"](spark, small).collect()
    assert len(rep) == 66
    for r in rep:
        assert abs(r.drawn - min(r.need, r.available)) < 1 and r.shortfall == (r.available < r.need)
    s = Q["p1_sample"](spark, small).toPandas()
    assert not s.duplicated(["plan", "id"]).any()


def test_p3_splits(spark, small):
    out = Q["p3_splits"](spark, small).toPandas()
    d = frame(small, "dataset")
    assert len(out) == 4 * len(d) and not out.duplicated(["plan", "id"]).any()
    key = d.project.str.lower().str.replace(r"[.]git\W*$", "", regex=True).str.replace(r"[\W_]", "", regex=True)
    m = out.merge(d.assign(key=key)[["id", "key"]], on="id")
    assert (m.groupby(["plan", "key"]).split.nunique() == 1).all()


def bags(texts):
    return [collections.Counter(W.findall(t)) for t in texts]


def groups(b, ids, like):
    par = list(range(len(b)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, j in itertools.combinations(range(len(b)), 2):
        if b[i] and b[j] and sum((b[i] & b[j]).values()) >= like * max(b[i].total(), b[j].total()):
            par[max(root(i), root(j))] = min(root(i), root(j))
    by = collections.defaultdict(list)
    for i in range(len(b)):
        by[root(i)].append(ids[i])
    return {(min(x), max(x)) for g in by.values() for x in itertools.combinations(g, 2)}


def test_p5_brute_force(spark, small):
    d = frame(small, "dataset")
    b = bags([(t + "\n" if t else "") + c for t, c in zip(d.test_name, d.code)])
    assert {tuple(r) for r in Q["p5_found"](spark, small).collect()} == groups(b, d.id.tolist(), 0.75)


def test_p6_brute_force(spark, small):
    d = frame(small, "dataset")
    b = bags(d.code)
    want = set()
    for i, j in itertools.permutations(range(len(d)), 2):
        if d.split[i] != "train" and d.split[j] == "train" and sum((b[i] & b[j]).values()) >= 0.8 * b[i].total():
            want.add((min(d.id[i], d.id[j]), max(d.id[i], d.id[j])))
    assert {tuple(r) for r in Q["p6_found"](spark, small).collect()} == want


def test_p7_brute_force(spark, small):
    d = frame(small, "alpaca_item")
    want = set()
    for i, t in zip(d.item_id, d.output):
        t = re.sub(r"(?m)^[ \t]*[(（]?\d+[.)）、．:：][ \t]*", "", t or "").lower()
        s = "".join(c for c in t if c.isalnum())
        seen, hit = set(), [0] * len(s)
        for k in range(len(s) - 29):
            if s[k : k + 30] in seen:
                hit[k : k + 30] = [1] * 30
            seen.add(s[k : k + 30])
        if s and sum(hit) >= 0.4 * len(s):
            want.add(i)
    assert {r.item_id for r in Q["p7_found"](spark, small).collect()} == want


def test_p8_packing(spark, small):
    out = Q["p8_pack"](spark, small).toPandas()
    spec = frame(small, "container_spec").set_index("spec_id")
    room = spec.capacity_tokens - spec.reserved_tokens
    use = out.groupby(["spec_id", "container_id"]).tokens.sum().reset_index()
    assert (use.tokens <= use.spec_id.map(room)).all()
    whole = out.groupby(["spec_id", "doc_id"]).tokens.sum().unstack(0)
    assert whole.nunique(axis=1).eq(1).all() and len(whole) == len(frame(small, "documents"))
    split = out.groupby(["spec_id", "doc_id"]).size().reset_index(name="parts").merge(whole.iloc[:, 0].rename("n"), left_on="doc_id", right_index=True)
    assert ((split.parts > 1) == (split.n > split.spec_id.map(room))).all()
    fill = Q["p8_report"](spark, small).toPandas()
    assert (fill.containers <= fill.least_containers * 1.05 + 1).all()


def test_p9_brute_force(spark, small):
    docs, items = frame(small, "documents"), frame(small, "eval_item")

    def units(t, chars):
        w = re.findall(r"[^\W_]+", t.casefold())
        return list("".join(w)) if chars else w

    want = set()
    for chars, n in ((False, 12), (True, 30)):
        seeds = collections.defaultdict(set)
        for i, t, lang in zip(items.item_id, items.text, items.lang):
            if (lang in ("zh", "ja")) == chars:
                u = units(t, chars)
                for k in range(len(u) - n + 1):
                    seeds[tuple(u[k : k + n])].add(i)
        for d, t in zip(docs.doc_id, docs.text):
            u = units(t, chars)
            for k in range(len(u) - n + 1):
                want |= {(d, i) for i in seeds.get(tuple(u[k : k + n]), ())}
    assert {tuple(r) for r in Q["p9_found"](spark, small).collect()} == want


def test_names():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} <= Q.keys() and "p8_pack" in Q
