"""Problem 3: splits that keep the records of an entity together.

Records and entity values (raw spellings and their keys) form a bipartite graph. Records with
the same entity values are one node, so the graph has as many nodes as there are distinct
combinations, not records. The smallest label spreads along the edges until nothing changes;
then whole components are assigned to splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.labels import label_category, project_key
from siftline.session import Cut, cut

#: a component of at least this share of all rows is assigned on the driver, so at most its inverse of them
HEAVY_SHARE = 0.002
#: components that one task assigns, on average
BLOCK = 4000


def entity_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) by min-label propagation over ``edges`` (node, entity): each entity takes the
    smallest label of its nodes, each node the smallest of its entities and then the label of that
    label, so that long chains shrink fast. A hot entity costs one row for each node in two map-side combined aggregations, never pairs. Nodes without an edge
    keep their own label. Labels only fall, so the rounds end."""
    held = Cut(nodes.select("node", F.col("node").alias("comp"), F.lit(True).alias("moved")), "minlabel")
    while True:
        state = held.df.select("node", "comp")
        low = edges.join(state, "node").groupBy("entity").agg(F.min("comp").alias("low"))
        seen = edges.join(low, "entity").groupBy("node").agg(F.min("low").alias("low"))
        step = state.join(seen, "node", "left").select("node", "comp", F.least("comp", F.coalesce("low", "comp")).alias("low"))
        jump = step.join(state.select(F.col("node").alias("low"), F.col("comp").alias("jump")), "low", "left")
        low = F.least("low", F.coalesce("jump", "low"))
        new = Cut(jump.select("node", low.alias("comp"), (low < F.col("comp")).alias("moved")), "minlabel")
        held.drop()
        held = new
        if held.df.filter("moved").isEmpty():
            return held.df.select("node", "comp")


def project_components(dataset: DataFrame) -> DataFrame:
    """(project, comp): the component of every raw spelling; a null project is its own component."""
    # a node stands for all records with one combination of entity values
    nodes = dataset.groupBy("project").agg(F.min("id").alias("node"))
    nodes = Cut(nodes, "nodes").df
    key = project_key("project")
    # a name without any letter or digit has no key to share; its raw spelling stands alone
    edges = nodes.select(
        "node",
        F.explode(F.array(F.concat(F.lit("raw:"), "project"), F.when(key != "", F.concat(F.lit("key:"), key)))).alias("entity"),
    ).filter("entity is not null")
    return nodes.join(entity_components(nodes, edges), "node").select("project", "comp")


def same_entity_spellings(components: DataFrame) -> DataFrame:
    """(project_a, project_b): pairs of different raw values in one component, in code point order."""
    a = components.filter("project is not null").select("comp", F.col("project").alias("project_a"))
    b = components.filter("project is not null").select("comp", F.col("project").alias("project_b"))
    return a.join(b, "comp").filter("project_a < project_b").select("project_a", "project_b")


def _greedy(hist: np.ndarray, want: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Split of each group: largest first, to the split where the squared deviation of the
    label counts from the wanted ones, each label weighted by its inverse total, grows least."""
    total = np.maximum(hist.sum(0), 1e-9)
    have = np.zeros_like(want)
    out = np.zeros(len(hist), np.int64)
    weight = 1 / (total[None, :] * np.maximum(want.sum(1, keepdims=True), 1e-9))
    for i in np.lexsort((ids, -hist.sum(1))):
        h = hist[i]
        gain = ((2 * (have - want) * h + h * h) * weight).sum(1)
        out[i] = k = int(np.argmin(gain))
        have[k] += h
    return out


def assign_splits(dataset: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, id, split) for every record and plan of ``targets`` (plan, split, target_share),
    all records of one component in one split.

    Components of at least ``HEAVY_SHARE`` of the rows (so at most its inverse) are assigned on
    the driver; the others in blocks of about ``BLOCK`` components by hash, each aiming at what
    the heavy ones left to fill of each label. Repeated ids follow their rows."""
    comps = cut(project_components(dataset), "comps")
    cat = F.coalesce(label_category("label"), F.lit("none"))
    labels = ["Async", "Conc", "Time", "UC", "OD", "Non-Flaky", "none"]
    per = dataset.withColumn("lab", cat).groupBy("project").agg(*[F.count(F.when(F.col("lab") == x, 1)).alias(f"l{i}") for i, x in enumerate(labels)])
    cols = [f"l{i}" for i in range(len(labels))]
    hist = per.join(comps, per.project.eqNullSafe(comps.project)).groupBy("comp").agg(*[F.sum(c).alias(c) for c in cols])
    hist = cut(hist, "hist")
    all_ = hist.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]).first()
    rows = sum(all_[c] for c in cols)
    size = sum((F.col(c) for c in cols), F.lit(0))
    heavy = hist.filter(size >= max(1, HEAVY_SHARE * rows)).toPandas()
    plans: dict[str, list[tuple[str, float]]] = {}
    for r in targets.orderBy("plan", "split").collect():  # a table of wanted shares: plans x splits
        plans.setdefault(r.plan, []).append((r.split, r.target_share))
    totals = np.array([all_[c] for c in cols], float)
    heavy_hist = heavy[cols].to_numpy(float)
    fixed, left = [], {}
    for plan, splits in plans.items():
        share = np.array([s for _, s in splits])
        want = share[:, None] / share.sum() * totals[None, :]
        out = _greedy(heavy_hist, want, heavy["comp"].to_numpy())
        fixed += [(plan, int(c), splits[k][0]) for c, k in zip(heavy["comp"], out)]
        rest = want - np.array([heavy_hist[out == k].sum(0) for k in range(len(splits))])
        # what is still to fill of each label, as shares of what the light groups hold of it; a split
        # that is over full asks for nothing, a label without light rows is shared as wanted
        rest = np.maximum(rest, 0)
        full = rest.sum(0)
        left[plan] = (splits, np.where(full > 0, rest / np.maximum(full, 1e-9), share[:, None] / share.sum()))
    blocks = max(1, round(all_.groups / BLOCK))

    def light(key, pdf):
        pdf = pdf.sort_values("comp")
        h, ids, parts = pdf[cols].to_numpy(float), pdf["comp"].to_numpy(), []
        for plan, (splits, share) in left.items():
            k = _greedy(h, share * h.sum(0)[None, :], ids)
            parts.append(pd.DataFrame({"plan": plan, "comp": ids, "split": [splits[i][0] for i in k]}))
        return pd.concat(parts) if parts else pd.DataFrame({"plan": [], "comp": [], "split": []})

    kind = "plan string, comp bigint, split string"
    given = (
        hist.filter(size < max(1, HEAVY_SHARE * rows))
        .withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(light, kind)
        .unionByName(hist.sparkSession.createDataFrame(fixed, kind))
    )
    where = comps.join(given, "comp").select("project", "plan", "split")
    return dataset.select("id", "project").join(where, dataset.project.eqNullSafe(where.project)).select("plan", "id", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, split, n_rows, share, target_share)."""
    n = assigned.groupBy("plan", "split").agg(F.count("*").alias("n_rows"))
    total = n.groupBy("plan").agg(F.sum("n_rows").alias("total"))
    return (
        targets.join(n, ["plan", "split"], "left")
        .join(total, "plan", "left")
        .select("plan", "split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.try_divide("n_rows", "total"), F.lit(0.0)).alias("share"), "target_share")
    )
