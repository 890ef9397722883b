"""Problem 1: samples whose categories have wanted shares, by the cube method.

The balancing variables are the category indicators. Units of one category then lie in one
line of the kernel of the balancing matrix, so a flight step moves two undecided units of a
category against each other until one of them is decided; a flight pairs all undecided units
and does so round by round. The flight runs in every partition and leaves at most one undecided
unit for each plan and category; these merge upward through a tree of groups of ``FAN_IN``
partitions, each running the same flight, until one group is left. The landing gives up the
category constraints last: the units that are left of one plan, at most one for each category,
move against each other, so that the plan's total is kept, and the last of them is drawn. The sample's
category totals and its size differ from the wanted ones by less than one unit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.labels import label_category
from siftline.llm.textscan import BASE, MASK, mix
from siftline.session import cut

#: undecided units of so many partitions (or groups) meet in one task of the next level
FAN_IN = 64
UNITS = "plan string, category string, id bigint, prob double, state int, part bigint"


def _seed(*names: str) -> np.uint64:
    """A seed of all that is in the names, so that samples of different plans are independent."""
    return np.uint64(int.from_bytes(hashlib.blake2b("\0".join(names).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _flight(ids: np.ndarray, prob: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One flight: probabilities after it are 0 or 1 but for at most one, and their sum is kept.

    Units come in a random order that depends on seed and ids only. Neighbours duel, all pairs at
    once: of two with a sum below 1 one gets all, else one is drawn and the other keeps the rest, with
    chances that keep every unit's probability. The undecided ones meet in the next round."""
    p = np.where(prob >= 1 - 1e-9, 1.0, np.where(prob <= 1e-9, 0.0, prob))
    key = mix(ids.astype(np.int64).view(np.uint64) + seed)
    left = np.argsort(key, kind="stable")
    left = left[(p[left] > 0) & (p[left] < 1)]
    turn = 0
    while len(left) > 1:
        turn += 1
        a, b = left[: len(left) - 1 : 2], left[1::2]
        chance = (mix(key[a] + np.uint64(turn * int(BASE) & MASK)) >> np.uint64(11)).astype(float) / 2**53
        pa, pb = p[a], p[b]
        total = pa + pb
        low = total < 1
        first = chance < np.where(low, pa / total, (1 - pb) / np.maximum(2 - total, 1e-300))
        best, rest = np.where(low, total, 1.0), np.where(low, 0.0, total - 1)
        p[a], p[b] = np.where(first, best, rest), np.where(first, rest, best)
        p[p >= 1 - 1e-9], p[p <= 1e-9] = 1.0, 0.0
        left = left[(p[left] > 0) & (p[left] < 1)]
    return p


def _settle(plan: str, category: str, ids: np.ndarray, prob: np.ndarray, part: int) -> pd.DataFrame:
    p = _flight(ids, prob, _seed(plan, category))
    keep = p > 0
    return pd.DataFrame({"plan": plan, "category": category, "id": ids[keep], "prob": p[keep], "state": np.where(p[keep] >= 1, 1, 0), "part": part})


def _land(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The drawn ones of a plan's last undecided units, one for each category at most."""
    pdf = pdf.sort_values(["category", "id"])
    seed = _seed(key[0])
    p = _flight(np.arange(len(pdf)), pdf.prob.to_numpy(), seed)
    chance = float(mix(np.array([seed]))[0] >> np.uint64(11)) / 2**53  # for the last one
    return pdf.assign(state=1)[p > np.where(p < 1, chance, 0)]


def cube_sample(df: DataFrame, quotas: DataFrame) -> DataFrame:
    """Balanced sample of ``df`` (id, category) for each plan of ``quotas`` (plan, category,
    need, available): (plan, category, id). A category with fewer rows than needed is drawn whole.

    ``quotas`` is as large as the table of targets, plans x categories, checked to be under 100,000
    rows, and reaches the tasks in their closure. Empty ``df``: empty sample. A null category is in
    no plan. Repeated ids are drawn as separate units, ties have an order fixed by id."""
    rows = quotas.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 plan-category targets")
    prob = {}
    for r in rows:
        if r.available:
            prob.setdefault(r.category, []).append((r.plan, min(1.0, r.need / r.available)))

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        none = (np.zeros(0, np.int64), np.zeros(0))
        for pdf in batches:
            for category, ids in pdf.groupby("category")["id"]:
                ids = ids.to_numpy(np.int64)
                for plan, p in prob.get(category, []):
                    old = held.pop((plan, category), none)
                    out = _settle(plan, category, np.concatenate([old[0], ids]), np.concatenate([old[1], np.full(len(ids), p)]), part)
                    open_ = out[out.state == 0]
                    if len(open_):
                        held[plan, category] = (open_.id.to_numpy(np.int64), open_.prob.to_numpy())
                    yield out[out.state == 1]
        for (plan, category), (ids, p) in held.items():
            yield pd.DataFrame({"plan": plan, "category": category, "id": ids, "prob": p, "state": 0, "part": part})

    def merge(key, pdf):
        # probabilities and ids are put in one order, so that a repeated task decides alike
        pdf = pdf.sort_values(["id", "prob"])
        return _settle(key[0], key[1], pdf.id.to_numpy(np.int64), pdf.prob.to_numpy(), int(key[2]))

    units = df.filter(F.col("category").isNotNull()).select("id", "category")
    level = cut(units.mapInPandas(first, UNITS), "cube")
    drawn, open_ = level.filter("state = 1"), level.filter("state = 0")
    width = (open_.agg(F.max("part").alias("last")).first().last or 0) + 1
    while width > 1:
        width = -(-width // FAN_IN)
        level = cut(open_.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint")).groupBy("plan", "category", "part").applyInPandas(merge, UNITS), "cube")
        drawn, open_ = drawn.unionByName(level.filter("state = 1")), level.filter("state = 0")
    landed = open_.groupBy("plan").applyInPandas(_land, UNITS)
    return drawn.unionByName(landed).select("plan", "category", "id")


def quotas(dataset: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, category, need, available): need is the greater of the share of the plan's sample
    size and the minimum; the size is ``sample_share`` x all rows of the dataset, rounded down."""
    have = dataset.select(label_category("label").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = have.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # one row for each category and one in all: both are bounded by the closed vocabulary
    return (
        targets.join(F.broadcast(have), "category", "left")
        .join(F.broadcast(total))
        .select(
            "plan",
            "category",
            F.greatest(F.round(F.col("target_share") * F.floor(F.round(F.col("sample_share") * F.col("total"), 6)), 6), F.col("min_rows").cast("double")).alias("need"),
            F.coalesce("n", F.lit(0)).alias("available"),
        )
    )


def sample_to_targets(dataset: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples (plan, category, id) and the report (plan, category, need, available, drawn,
    imbalance, shortfall) over all plan-category targets, met or not. Null or unknown labels
    belong to no category but count in the sample size. An empty dataset draws nothing and
    reports every target above zero as short."""
    q = cut(quotas(dataset, targets), "quota")
    picked = cube_sample(dataset.select("id", label_category("label").alias("category")), q)
    got = picked.groupBy("plan", "category").agg(F.count("*").alias("drawn"))
    report = q.join(got, ["plan", "category"], "left").select(
        "plan",
        "category",
        "need",
        "available",
        F.coalesce("drawn", F.lit(0)).alias("drawn"),
        (F.coalesce("drawn", F.lit(0)) - F.col("need")).alias("imbalance"),
        # drawn whole and still too few
        ((F.coalesce("drawn", F.lit(0)) >= F.col("available")) & (F.col("available") < F.col("need"))).alias("shortfall"),
    )
    return picked, report
