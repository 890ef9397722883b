"""Problem 7: repetition inside one document, by an isolation forest over rule statistics.

One pass measures rule statistics of every text. A forest of isolation trees is grown on all rows,
level by level, over the statistics of lines, sentences and short grams; a text's score is
2 ** (-mean path length / expected length), high for texts that few random splits set apart. Every
row is scored, and the threshold is calibrated on all rows (label: the rule of the problem,
which is no statistic of the forest). The rows above the threshold are checked exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.textscan import chunks, codes, kinds, mix, prefix, spans_hash
from siftline.session import Cut, cut, spread

#: letters and digits that a repeated stretch has at least
STRETCH = 30
#: repeated share from which a text is bad
BAD_SHARE = 0.4
#: rows of different values up to which the forest is grown on the driver; more are read in tasks. Either way all
#: rows are read and the forest is the same
SAMPLE_ROWS = 20_000
TREES = 60
#: splits above a leaf at most; rows still together there count the expected length of the rest
DEPTH = 8
LIST_NUMBER = re.compile(r"(?m)^[ \t]*[(（]?\d+[.)）、．:：][ \t]*")
#: what the forest sees
FEATURES = ["line_share", "sentence_share", "gram_share", "top_gram_share"]
STATISTICS = ["repeated_share", *FEATURES]
SCHEMA = "n_chars bigint, " + ", ".join(f"{f} double" for f in STATISTICS)
#: code points that end a sentence; line ends do, too
ENDS = np.array([ord(x) for x in ".!?。！？…।"], np.uint32)


def _first_seen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether an equal one stood before, and how many equal ones there are.
    The place takes the low bits of the sorted values, the hash the others."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(key)).bit_length()))
    s = np.sort((key >> bits << bits) | np.arange(len(key), dtype=np.uint64))
    at = (s & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s >>= bits
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    again = np.empty(len(key), bool)
    again[at] = ~new
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(s)))
    size = np.empty(len(key), np.int64)
    size[at] = np.repeat(many, many)
    return again, size


def _share(part: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(doc, part, len(n)) / np.maximum(n, 1)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Rule statistics of each text: shares of repeated content in 0..1, all 0 where nothing is
    left of the text. ``repeated_share`` is exact: the share of letters and digits that lie in
    stretches of ``STRETCH`` or more that began earlier in the same text too."""
    texts = [LIST_NUMBER.sub("", t).lower() for t in texts]
    c, begin = codes(texts)
    k = kinds(c) == 1
    keep = np.flatnonzero(k)
    ch = mix(c[keep].astype(np.uint64) + np.uint64(1))
    doc = np.searchsorted(begin, keep, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    salt = mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(77))
    pre = prefix(ch)

    def grams(size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(doc) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
        return first, spans_hash(pre, first, first + size) ^ salt[doc[first]]

    first, h = grams(STRETCH)
    again, _ = _first_seen(h)
    edge = np.zeros(len(doc) + 1, np.int64)
    edge[first[again]] += 1
    edge[first[again] + STRETCH] -= 1
    repeated = np.cumsum(edge[:-1]) > 0
    out = {"n_chars": n, "repeated_share": _share(repeated.astype(float), doc, n)}
    g, h = grams(8)
    again8, size8 = _first_seen(h)
    out["gram_share"] = _share(again8.astype(float), doc[g], n)
    top = np.zeros(len(texts))
    start = np.flatnonzero(np.diff(doc[g], prepend=-1))
    if len(start):
        top[doc[g[start]]] = np.maximum.reduceat(size8, start)
    out["top_gram_share"] = np.minimum(1, 8 * np.where(top > 1, top, 0) / np.maximum(n, 1))
    line = c == 10
    for name, ends in (("line_share", line), ("sentence_share", line | np.isin(c, ENDS))):
        cuts = np.unique(np.concatenate([begin[:-1], np.flatnonzero(ends) + 1, begin[1:] - 1]))
        at = np.searchsorted(keep, cuts)
        a, b = at[:-1], at[1:]
        a, b = a[b > a], b[b > a]
        same, _ = _first_seen(spans_hash(pre, a, b) ^ salt[doc[a]])
        out[name] = _share(np.where(same, b - a, 0).astype(float), doc[a], n)
    return out


def repetition_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, rule statistics) of every row; a null text counts as empty. Other columns
    of ``df`` are not read, whatever their names."""
    kind = f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at, part in chunks(texts):
                m = measure(part)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *[pa.array(m[x]) for x in ["n_chars", *STATISTICS]]], names=[key, "n_chars", *STATISTICS])

    return spread(df.select(key, text)).mapInArrow(run, kind)


def _expected(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees over all rows, grown level by level: ``look`` takes rows into the numbers and ranges of a level's
    nodes, in any order and any parts, and ``split`` draws the splits of the level from them. Node k of a tree
    has the children 2 k + 1 and 2 k + 2, so a forest is bounded by ``TREES`` x 2 ** (``DEPTH`` + 1) nodes."""

    def __init__(self):
        self.deep = DEPTH
        self.expected = 0.0
        self.feature = np.full((TREES, (2 << DEPTH) - 1), -1, np.int8)
        self.at = np.zeros(self.feature.shape)
        self.length = np.zeros(self.feature.shape)

    def _reach(self, tree: int, x: np.ndarray, levels: int) -> np.ndarray:
        """The node each row stands in after so many levels, or the leaf above."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(levels):
            f = self.feature[tree, node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            old = node[rows]
            node[rows] = 2 * old + 1 + (x[rows, f] >= self.at[tree, old])
        return node

    def look(self, level: int, x: np.ndarray, n: np.ndarray, seen: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of rows, lowest and highest values of each tree's nodes of a level, those in ``seen`` included;
        ``n`` rows have the values ``x``."""
        many, low, high = seen or (np.zeros((TREES, 1 << level), np.int64), *(np.full((TREES, 1 << level, len(FEATURES)), v) for v in (np.inf, -np.inf)))
        for tree in range(TREES):
            node = self._reach(tree, x, level) - ((1 << level) - 1)
            order = np.argsort(node, kind="stable")
            order = order[np.searchsorted(node[order], 0) :]
            if not len(order):
                continue
            node = node[order]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            at = node[first]
            many[tree, at] += np.add.reduceat(n[order], first)
            low[tree, at] = np.minimum(low[tree, at], np.minimum.reduceat(x[order], first))
            high[tree, at] = np.maximum(high[tree, at], np.maximum.reduceat(x[order], first))
        return many, low, high

    def split(self, level: int, many: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> None:
        """Nodes of one row or of equal rows become leaves, and all at the last level. A draw depends on the seed
        and the node's place only."""
        if level == 0:
            rows = int(many[0, 0])
            self.deep = min(DEPTH, int(np.ceil(np.log2(max(rows, 2)))))
            self.expected = float(_expected(rows))
        span = np.where(many[..., None] > 1, high - low, 0)
        wide = (span > 0).sum(-1)
        inner = (wide > 0) & (level < self.deep)
        pick, where = np.random.default_rng([seed, level]).random((2, *many.shape))
        nth = np.minimum((pick * wide).astype(int), wide - 1) + 1
        f = np.argmax((span > 0) & (np.cumsum(span > 0, -1) == nth[..., None]), -1)
        part = slice((1 << level) - 1, (2 << level) - 1)
        self.feature[:, part] = np.where(inner, f, -1)
        start, width = (np.take_along_axis(v, f[..., None], -1)[..., 0] for v in (low, span))
        self.at[:, part] = np.where(inner, start + where * width, 0)
        self.length[:, part] = level + _expected(many)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in range(TREES):
            out += self.length[tree, self._reach(tree, x, self.deep)]
        return 2 ** (-out / TREES / max(self.expected, 1e-9))


def _looked(rows: DataFrame, forest: IsolationForest, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``IsolationForest.look`` over all rows of a table, in its tasks; one row for each node reaches the driver."""
    ends = [f"{e}_{f}" for e in ("low", "high") for f in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy() for f in FEATURES])
            seen = forest.look(level, x, b.column("n").to_numpy(), seen)
        if seen:
            many, low, high = seen
            node = np.flatnonzero(many)
            values = np.concatenate([v.reshape(many.size, -1)[node] for v in (low, high)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node, many.ravel()[node], *values.T)], names=["node", "n", *ends])

    parts = rows.mapInArrow(run, "node bigint, n bigint, " + ", ".join(f"{e} double" for e in ends))
    got = parts.groupBy("node").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in ends]).toPandas()
    many, low, high = forest.look(level, np.zeros((0, len(FEATURES))), np.zeros(0, np.int64))
    node = got["node"].to_numpy()
    many.reshape(-1)[node] = got["n"]
    low.reshape(many.size, -1)[node] = got[ends[: len(FEATURES)]]
    high.reshape(many.size, -1)[node] = got[ends[len(FEATURES) :]]
    return many, low, high


def grown(stats: DataFrame) -> IsolationForest:
    """The forest over all rows of ``stats``; rows of equal values are looked at once."""
    rows = Cut(spread(stats.groupBy(*FEATURES).agg(F.count("*").alias("n"))), "vectors")
    here = rows.df.toPandas() if rows.df.count() <= SAMPLE_ROWS else None
    forest = IsolationForest()
    for level in range(DEPTH + 1):
        if level <= forest.deep:
            forest.split(level, *(_looked(rows.df, forest, level) if here is None else forest.look(level, here[FEATURES].to_numpy(float), here["n"].to_numpy())))
    rows.drop()
    return forest


def middle(scored: DataFrame) -> float:
    """The exact median score of all rows, 0 where there are none. Equal scores are one row with their number, so no
    task holds a frequent one; these are put in order over all tasks."""
    held = cut(scored.groupBy("score").agg(F.count("*").alias("n")).repartitionByRange("score").withColumn("part", F.spark_partition_id()), "middle")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("part").agg(F.sum("n").alias("in_part"))  # one row for each partition
    before = sizes.select("part", F.coalesce(F.sum("in_part").over(upto), F.lit(0)).alias("before"))
    rows = held.agg(F.sum("n").alias("rows"))  # one row
    end = F.sum("n").over(Window.partitionBy("part").orderBy("score")) + F.col("before")
    placed = held.join(F.broadcast(before), "part").withColumn("end", end).join(F.broadcast(rows))
    low, high = (F.min(F.when(F.col("end") > at, F.col("score"))) for at in (F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)))
    return placed.agg(F.coalesce((low + high) / 2, F.lit(0.0)).alias("mid")).first().mid


def repeated_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, rule statistics, score, anomalous, bad) of every row.

    The forest sees all rows, so it is the same whatever the partitioning. The threshold is the lowest score of a
    labelled bad row less a tenth of its distance from the median score of all rows, so no bad row lies
    below it; without a bad row, every row above the median is anomalous. ``bad`` rows are anomalous and pass the exact
    rule. Null, empty and very short texts have share 0. Repeated keys keep their rows."""
    stats = cut(repetition_statistics(df, key, text), "rules")
    forest = grown(stats)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack(cols)) if len(cols[0]) else [])

    scored = cut(stats.withColumn("score", score(*FEATURES)), "scores")
    mid = middle(scored)
    low = scored.filter(F.col("repeated_share") >= BAD_SHARE).agg(F.min("score").alias("low")).first().low
    low = mid if low is None else low
    threshold = low - 0.1 * max(low - mid, 0)
    return scored.withColumn("anomalous", F.col("score") >= threshold).withColumn("bad", F.col("anomalous") & (F.col("repeated_share") >= BAD_SHARE))
