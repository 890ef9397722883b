"""Train, validation and test splits: random, stratified, ordered, and project-wise folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.ordering import with_position
from siftline.operators.sampling import shuffle_key

SPLITS = ("train", "valid", "test")
#: groups that one stratum is numbered in, so that a hot stratum is not one task
GROUPS = 64
#: project-category counts that the fold assignment takes to the driver, at most
MOST_COUNTS = 5_000_000


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be non-negative and sum to 1")


def _cut(place: Column, total: Column, train: float, valid: float) -> Column:
    # double products, truncated: 100 * 0.29 gives 28
    a = F.floor(total * F.lit(train))
    b = a + F.floor(total * F.lit(valid))
    return F.when(place < a, "train").when(place < b, "valid").otherwise("test")


def split_dataset(df: DataFrame, train: float = 0.7, valid: float = 0.2, test: float = 0.1, stratify: str | None = None, seed: int = 42, shuffle: bool = True, key: str = "id") -> DataFrame:
    """``df`` with a column ``split``. Each stratum (all rows where ``stratify`` is null or no column)
    is put in a reproducible random order, or in the order of ``key``, and cut at the truncated
    shares; what is left is test. Rows of a null stratum are dropped, as their stratum equals
    nothing. An empty table gives an empty table.

    Rows are ranked by range of the order, then shifted by the counts of the ranges before, so a
    hot stratum is spread over tasks."""
    check_ratios(train, valid, test)
    order = shuffle_key(key, seed) if shuffle else F.col(key)
    rows = df.withColumn("_order", order)
    if stratify is None or stratify not in df.columns:
        total = df.agg(F.count("*").alias("_total"))
        placed = with_position(rows, ["_order", key], "_place").join(F.broadcast(total))  # a table of one row
        return placed.withColumn("split", _cut(F.col("_place"), F.col("_total"), train, valid)).drop("_order", "_place", "_total")
    rows = rows.filter(F.col(stratify).isNotNull())
    if shuffle:  # the order is a hash: its first two digits are groups of equal size, in order
        rows = rows.withColumn("_group", F.floor(F.conv(F.substring("_order", 1, 2), 16, 10).cast("int") * GROUPS / 256))
    else:
        rows = with_position(rows, [key], "_pos").withColumn("_group", F.floor(F.col("_pos") / 1_000_000)).drop("_pos")
    sizes = rows.groupBy(stratify, "_group").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(stratify)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(stratify, "_group", before.alias("_shift"), F.sum("_n").over(w).alias("_total"))
    place = F.row_number().over(Window.partitionBy(stratify, "_group").orderBy("_order", key)) - 1
    placed = rows.withColumn("_rank", place).join(sizes, [stratify, "_group"])
    return placed.withColumn("split", _cut(F.col("_rank") + F.col("_shift"), F.col("_total"), train, valid)).select(*df.columns, "split")


def split_summary(split: DataFrame, by: str | None = None) -> DataFrame:
    """(split[, by], n_rows, percent)."""
    n = split.groupBy("split", *([by] if by else [])).agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(by)) if by else F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("percent", F.col("n_rows") * 100.0 / total)


def category_project_spread(df: DataFrame, project: str = "project", category: str = "category") -> DataFrame:
    """(category, n_rows, n_projects); null categories left out."""
    return df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n_rows"), F.countDistinct(project).alias("n_projects"))


def global_counts(df: DataFrame, project: str = "project", category: str = "category") -> DataFrame:
    """One row: rows, distinct projects and distinct categories, nulls left out of both."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(project).alias("n_projects"), F.countDistinct(category).alias("n_categories"))


def project_category_counts(df: DataFrame, project: str = "project", category: str = "category") -> DataFrame:
    """(project, category, n_rows); a null category counts in the size of its project only."""
    return df.groupBy(project, category).agg(F.count("*").alias("n_rows"))


def rare_categories(df: DataFrame, category: str = "category", share: float = 0.01) -> DataFrame:
    """(category, n_rows) of categories with fewer rows than ``share`` of all."""
    n = df.groupBy(category).agg(F.count("*").alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("total"))
    return n.filter(F.col(category).isNotNull()).join(F.broadcast(total)).filter(F.col("n_rows") < F.col("total") * F.lit(share)).drop("total")


def fold_feasibility(df: DataFrame, n_folds: int = 4, min_samples: int = 4, category: str = "category") -> DataFrame:
    """(category, n_rows, per_fold) of categories that cannot give every fold ``min_samples`` rows."""
    n = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n_rows"))
    return n.withColumn("per_fold", F.col("n_rows") / F.lit(float(n_folds))).filter(F.col("per_fold") < min_samples)


def project_folds(df: DataFrame, n_folds: int = 4, min_samples: int = 4, project: str = "project", category: str = "category", rare_share: float = 0.01) -> DataFrame:
    """(project, fold), folds from 1: projects with a rare category are dealt in turn by size, the
    others go, by size, to the fold where sizes and category counts stray least. A rare category
    below ``min_samples`` in a fold draws a project that has it. Equal sizes go by name, equal
    scores to the first fold. Null projects are in no fold.

    The assignment depends on its own past, so it runs on the driver, over one count for each
    project and category (checked to be at most ``MOST_COUNTS``), never over rows."""
    counts = project_category_counts(df.filter(F.col(project).isNotNull()), project, category).limit(MOST_COUNTS + 1).collect()
    if len(counts) > MOST_COUNTS:
        raise ValueError("too many project-category counts for one driver")
    sizes: dict[str, int] = {}
    per: dict[str, dict] = {}
    total: dict = {}
    for r in counts:
        p, c, n = r[0], r[1], r[2]
        sizes[p] = sizes.get(p, 0) + n
        if c is not None:
            per.setdefault(p, {})[c] = n
            total[c] = total.get(c, 0) + n
    rows = sum(sizes.values())
    rare = {c for c, n in total.items() if n < rare_share * rows}
    by_size = sorted(sizes, key=lambda p: (-sizes[p], p))
    critical = [p for p in by_size if rare & per.get(p, {}).keys()]
    size = [0] * n_folds
    have = [dict.fromkeys(total, 0) for _ in range(n_folds)]
    fold: dict[str, int] = {}

    def put(p: str, f: int) -> None:
        fold[p] = f
        size[f] += sizes[p]
        for c, n in per.get(p, {}).items():
            have[f][c] += n

    for k, p in enumerate(critical):
        put(p, k % n_folds)
    want, goal = {c: n / n_folds for c, n in total.items()}, rows / n_folds
    for p in by_size:
        if p in fold:
            continue
        own, scores = per.get(p, {}), []
        for f in range(n_folds):
            stray = 0.0
            for c in total:
                n = own.get(c, 0)
                stray += -100 if c in rare and have[f][c] < min_samples and n else abs(have[f][c] + n - want[c])
            scores.append(0.1 * abs(size[f] + sizes[p] - goal) + stray)
        put(p, scores.index(min(scores)))
    return df.sparkSession.createDataFrame([(p, f + 1) for p, f in sorted(fold.items())], f"{project} string, fold int")


def with_folds(df: DataFrame, folds: DataFrame, project: str = "project") -> DataFrame:
    """``df`` with its ``fold``; the training side of fold i is every row with another fold."""
    return df.join(folds, project)


def fold_sides(df: DataFrame, folds: DataFrame, n_folds: int = 4, project: str = "project") -> DataFrame:
    """Rows of every fold with ``side`` train or test: each row is once in a test side."""
    every = F.explode(F.sequence(F.lit(1), F.lit(n_folds)))
    own = with_folds(df, folds, project).withColumnRenamed("fold", "_own").withColumn("fold", every)
    return own.withColumn("side", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def fold_summary(df: DataFrame, category: str = "category", project: str = "project") -> DataFrame:
    """(fold, category, n_rows, n_projects) of rows with a fold."""
    return df.groupBy("fold", category).agg(F.count("*").alias("n_rows"), F.countDistinct(project).alias("n_projects"))


def fold_violations(df: DataFrame, n_folds: int = 4, min_samples: int = 4, category: str = "category") -> DataFrame:
    """(fold, category, n_rows) of the cells below ``min_samples``, empty cells included."""
    cats = df.filter(F.col(category).isNotNull()).select(category).distinct()
    cells = cats.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    n = df.groupBy("fold", category).agg(F.count("*").alias("n_rows"))
    return cells.join(n, ["fold", category], "left").select("fold", category, F.coalesce("n_rows", F.lit(0)).alias("n_rows")).filter(F.col("n_rows") < min_samples)


def fold_overlap(sides: DataFrame, project: str = "project") -> DataFrame:
    """(fold, project) of projects on both sides of a fold: none in a valid set of folds."""
    train = sides.filter("side = 'train'").select("fold", project)
    return train.join(sides.filter("side = 'test'").select("fold", project), ["fold", project], "left_semi").distinct()
