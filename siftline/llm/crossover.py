"""Problem 6: records of held-out splits that stand in the training split too.

Held-out and training records are arrays of word hashes; records with the same words are one
class. The words of a held-out record, with their occurrence, are put in one order, rare ones
first; a training record with ``CONTAINED`` of them has ``SHARED`` of the first fifth or so
(prefix filter). These words are joined with the words of the training records, so that
every overlap is a candidate whichever words are frequent, and the containment of the held-out
record is computed on the whole texts. Words that many records of either side have are dealt to blocks, so that
no task holds all of one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.wordsets import dealt, drawn, hot_blocks, is_in, labelled, overlaps, ranked, reach, text_classes, unpack, word_arrays, word_ranks
from siftline.session import Cut, cut

#: a held-out record stands in a training record from this share of its words
CONTAINED = 0.8
#: words that an overlap must show among the first ones, which are as many more; fewer only if it has fewer
SHARED = 2
#: records of one word that are joined at once; more go block by block
BLOCK = 1024
TRAIN, HELD_OUT = "train", ["valid", "test"]


def _first_words(held: DataFrame, ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, need, word, known): the first words of each held-out class, how many of them an overlap
    has at least, and whether ``ranks`` has them."""
    sent = held.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = unpack(b.column(1))
            doc, place, key = ranked(words, at, sent.value)
            n = np.diff(at)
            first = reach(n, CONTAINED)
            need = np.minimum(SHARED, n - first + 1).astype(np.int8)
            keep = place < (first + need - 1)[doc]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[keep])), pa.array(need[doc[keep]]), pa.array(key[keep].view(np.int64)), pa.array(is_in(key[keep], sent.value[0]))], names=["h", "need", "word", "known"])

    return held.select("id", "words").mapInArrow(run, f"h {held.schema['id'].dataType.simpleString()}, need tinyint, word bigint, known boolean")


def _all_words(train: DataFrame, unused: np.ndarray) -> DataFrame:
    """(t, word): the words of each training class but those that no held-out class begins with."""
    sent = train.sparkSession.sparkContext.broadcast(unused)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = unpack(b.column(1))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            key = labelled(words, doc)
            keep = ~is_in(key, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[keep])), pa.array(key[keep].view(np.int64))], names=["t", "word"])

    return train.select("id", "words").mapInArrow(run, f"t {train.schema['id'].dataType.simpleString()}, word bigint")


def _dealt(rows: DataFrame, blocks: tuple[np.ndarray, np.ndarray], left: bool) -> DataFrame:
    """``rows`` (.., word) with the words of hot places dealt to blocks, for one side of the join."""
    mine, theirs = blocks if left else blocks[::-1]
    if mine.max() == 1 and theirs.max() == 1:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast((mine, theirs))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(b.num_columns - 2).to_numpy().view(np.uint64)
            own = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
            at, word = dealt(word, own, *sent.value, left)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(at)) for i in range(b.num_columns - 2)], pa.array(word.view(np.int64))], names=names)

    return rows.select(*names, F.xxhash64(names[0]).alias("own")).mapInArrow(run, rows.schema)


def _contained(pairs: DataFrame, held: DataFrame, train: DataFrame) -> DataFrame:
    """(h, t, containment) of the candidate pairs (h, t) from ``CONTAINED`` on."""
    both = pairs.join(held.select(F.col("id").alias("h"), F.col("words").alias("wh")), "h").join(train.select(F.col("id").alias("t"), F.col("words").alias("wt")), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.maximum(np.diff(unpack(b.column(2))[1]), 1)
            share = overlaps(b.column(2), b.column(3)) / own
            ok = pa.array(np.flatnonzero(share >= CONTAINED - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(share[ok.to_numpy()])], names=["h", "t", "containment"])

    kind = held.schema["id"].dataType.simpleString()
    return both.select("h", "t", "wh", "wt").mapInArrow(run, f"h {kind}, t {kind}, containment double")


def split_overlaps(df: DataFrame, key: str = "id", text: str = "code", split: str = "split", also: list[str] = ["project"]) -> DataFrame:
    """(id_h, id_t, split, containment, further columns of the held-out record): every held-out
    record with every training record it stands in.

    Rows of other or null splits take no part. Texts without a word overlap with nothing. Repeated
    ids and texts are reported for every id; other columns are not read."""
    rows = df.filter(F.col(split).isin(TRAIN, *HELD_OUT))
    arrays = Cut(word_arrays(rows, key, [text], [split, *also]).filter("n > 0"), "words")
    classes, member = text_classes(arrays.df.withColumn("train", F.col(split) == TRAIN), ["train"])
    arrays.drop()
    held, train = classes.filter("not train"), classes.filter("train")
    ranks = word_ranks(classes)
    first = cut(_first_words(held, ranks), "first")
    used = first.filter("known").select("word").distinct().toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    unused = ranks[0][~is_in(ranks[0], np.sort(used))]
    blocks = hot_blocks(drawn(first, "h"), "word", BLOCK), hot_blocks(_all_words(drawn(train), unused), "word", BLOCK)
    met = _dealt(first.select("h", "need", "word"), blocks, True).join(_dealt(_all_words(train, unused), blocks, False), "word")
    pairs = met.groupBy("h", "t").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("h", "t")
    found = cut(_contained(pairs, held, train).groupBy("h", "t").agg(F.max("containment").alias("containment")), "contained")
    h = member.filter("not train").withColumnRenamed("id", "id_h").withColumnRenamed("class_id", "h").drop("train")
    t = member.filter("train").select(F.col("id").alias("id_t"), F.col("class_id").alias("t"))
    return found.join(h, "h").join(t, "t").select("id_h", "id_t", split, "containment", *also)


def overlap_counts(found: DataFrame, split: str = "split", source: str = "project") -> DataFrame:
    """(split, source, n_records, n_overlaps) of the held-out records that overlap."""
    return found.groupBy(split, source).agg(F.countDistinct("id_h").alias("n_records"), F.count("*").alias("n_overlaps"))
