"""Problem 5: near-duplicate records with small edits.

Every record is an array of word hashes. Records with the same multiset of words are one class
(exact copies cost one row each). The words of a class, with their occurrence, are put in one
order, rare ones first; two classes that share ``LIKE`` of the longer one's words have ``SHARED`` of
their first words in common, where ``first`` is about a quarter (prefix filter). So classes that share
these are all candidates there are, whichever words are frequent; a candidate pair is
verified on the whole texts and its order by a banded alignment. Groups are the connected
components of verified links.

Order MinHash, which this replaces, finds a link only with some probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.wordsets import block_pairs, overlaps, ranked, reach, text_classes, unpack, word_arrays, word_ranks
from siftline.llm.graph import connected_components
from siftline.session import Cut, cut

#: records are alike from this share of the longer one's words
LIKE = 0.75
#: members of a bucket that are joined at once; larger buckets go block by block, all pairs
BUCKET = 1024
BAND = 16
#: first words that two alike classes have in common (a class of one word is alike to no other)
SHARED = 2


def _first_words(classes: DataFrame) -> DataFrame:
    """(id, n, key, at): the first words of each class and their places in its order."""
    sent = classes.sparkSession.sparkContext.broadcast(word_ranks(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = unpack(b.column(2))
            doc, place, key = ranked(words, at, sent.value)
            keep = place < (reach(np.diff(at), LIKE) + SHARED - 1)[doc]
            row = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(key[keep].view(np.int64)), pa.array(place[keep].astype(np.int32))], names=["id", "n", "key", "at"])

    kind = f"id {classes.schema['id'].dataType.simpleString()}, n int, key bigint, at int"
    return classes.select("id", "n", "words").mapInArrow(run, kind)


def banded_lcs(a: pa.Array, b: pa.Array, band: int = BAND) -> np.ndarray:
    """Length of the longest common subsequence of words whose partners lie within ``band`` of the
    diagonal of each pair, for all pairs at once."""
    (wa, at), (wb, bt) = unpack(a), unpack(b)
    n = len(a)
    na, nb = np.diff(at), np.diff(bt)
    out = np.zeros(n, np.int64)
    for part in np.array_split(np.argsort(na, kind="stable"), max(1, n // 4096)):
        if not len(part):
            continue
        width = 2 * band + 1
        best = np.zeros((len(part), width + 1), np.int16 if na[part].max() < 32000 else np.int64)
        steps = np.arange(width)
        for i in range(int(na[part].max()) if len(part) else 0):
            live = na[part] > i
            # the band follows the straight line from corner to corner
            mid = i * nb[part] // np.maximum(na[part], 1)
            shift = mid - (i - 1) * nb[part] // np.maximum(na[part], 1) if i else np.zeros(len(part), np.int64)
            j = mid[:, None] + steps[None, :] - band
            ok = (j >= 0) & (j < nb[part][:, None]) & live[:, None]
            same = ok & (wb[np.minimum(bt[part][:, None] + np.maximum(j, 0), max(len(wb) - 1, 0))] == wa[np.minimum(at[part] + i, len(wa) - 1)][:, None])
            # best[:, s] is the value of the row before at column mid_before - band - 1 + s
            idx = np.minimum(steps[None, :] + shift[:, None], width)
            diag = np.take_along_axis(best, idx, 1)
            up = np.take_along_axis(best, np.minimum(idx + 1, width), 1)
            row = np.maximum.accumulate(np.maximum(up, diag + same), axis=1)
            new = np.concatenate([np.take_along_axis(best, np.minimum(shift[:, None], width), 1), row], 1)
            best = np.where(live[:, None], np.maximum(new, 0), best).astype(best.dtype)
        out[part] = best[:, -1]
    return out


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, overlap, aligned) of the candidate pairs that are alike. The multiset overlap bounds
    any alignment from above, so it goes first; the banded alignment of what is left tells how
    much of the likeness keeps its order."""
    w = classes.select("id", "n", "words")
    both = pairs.join(w.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wa, wb = b.column(2), b.column(3)
            longer = np.maximum(np.maximum(np.diff(unpack(wa)[1]), np.diff(unpack(wb)[1])), 1)
            shared = overlaps(wa, wb)
            ok = pa.array(np.flatnonzero(shared >= LIKE * longer))
            if len(ok):
                pick = ok.to_numpy()
                aligned = banded_lcs(wa.take(ok), wb.take(ok))
                yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(shared[pick] / longer[pick]), pa.array(aligned / longer[pick])], names=["a", "b", "overlap", "aligned"])

    t = classes.schema["id"].dataType.simpleString()
    return both.select("a", "b", "wa", "wb").mapInArrow(run, f"a {t}, b {t}, overlap double, aligned double")


def alike_links(classes: DataFrame) -> DataFrame:
    """(a, b, overlap, aligned) between classes (id, n, words) of different texts."""
    # what is left of both from their first common words on must reach LIKE of the longer
    left = lambda x: x["n"] - x["at"] + (SHARED - 1)
    met = block_pairs(cut(_first_words(classes), "first"), BUCKET, lambda x, y: F.least(left(x), left(y)) >= F.lit(LIKE) * F.greatest(x["n"], y["n"]))
    return cut(_verified(met.filter(F.col("n") >= SHARED).select("a", "b"), classes).groupBy("a", "b").agg(F.max("overlap").alias("overlap"), F.max("aligned").alias("aligned")), "links")


def near_duplicates(df: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """The links between classes (a, b, overlap, aligned; a and b are the smallest ids of their
    classes) and the membership (id, class_id, group_id, n_links) of every row.

    Rows without any word (null or blank texts) are alike to nothing: each is its own group.
    Repeated rows are members of one class; other columns are not read."""
    arrays = Cut(word_arrays(df, key, texts), "words")
    classes, member = text_classes(arrays.df.filter("n > 0"))
    blank = cut(arrays.df.filter("n = 0").select("id"), "blank")
    arrays.drop()
    links = alike_links(classes)
    comp = connected_components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = comp.select(F.col("node").alias("class_id"), F.col("comp").alias("group_id")).join(degree, "class_id")
    out = member.join(groups, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    blank = blank.select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"))
    return links, out.unionByName(blank)


def grouped_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b): every two records of one group, smaller id first. The members of a large group are
    dealt to blocks, and each two blocks are joined on their own."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("m")).filter("m > 1").select("group_id", F.ceil(F.col("m") / F.lit(BUCKET)).cast("int").alias("blocks"))
    m = members.join(sizes, "group_id").select("group_id", "id", "blocks").distinct()
    own, each = F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = m.select("group_id", own.alias("i"), each.alias("j"), F.col("id").alias("id_a"))
    b = m.select("group_id", each.alias("i"), own.alias("j"), F.col("id").alias("id_b"))
    return a.join(b, ["group_id", "i", "j"]).filter("id_a < id_b").select("id_a", "id_b")
