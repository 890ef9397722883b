"""Texts as arrays of word hashes, written once and shared by the near-duplicate operators.

A word is a maximal run of letters, digits and underscores, case kept. The arrays hold 32 bits
of each word's hash in text order, 4 bytes a word; two texts are compared through them. As only the words of
one pair of texts are ever compared for good, two different ones agree with a chance of 1 in 4 billion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.textscan import BASE, Words, chunks, mix, occurrence
from siftline.session import cut, spread


def word_arrays(df: DataFrame, key: str, texts: list[str], extra: list[str] = []) -> DataFrame:
    """(id, extra columns, n, sig_a, sig_b, words) of every row, its texts taken together, nulls
    left out. The two signatures depend on the multiset of words only; ``words`` is little-endian
    uint32."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in extra)
    kind = f"id {df.schema[key].dataType.simpleString()}, {kinds + ', ' if extra else ''}n int, sig_a bigint, sig_b bigint, words binary"
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(1 + len(extra) + i).to_pylist() for i in range(len(texts))]
            joined = ["\n".join(t for t in row if t) for row in zip(*given)]
            for at, part in chunks(joined):
                w = Words(part)
                m = mix(w.hash ^ BASE)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (w.hash, m)]
                sig = [(s[w.at[1:]] - s[w.at[:-1]]).view(np.int64) for s in sums]
                low = (w.hash & np.uint64(0xFFFFFFFF)).astype("<u4")
                binary = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((w.at * 4).astype(np.int32)), pa.py_buffer(low)])
                cols = [b.column(i).slice(at, len(part)) for i in range(1 + len(extra))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(w.at).astype(np.int32)), pa.array(sig[0]), pa.array(sig[1]), binary], names=names)

    return spread(df.select(key, *extra, *texts)).mapInArrow(run, kind)


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a binary column and the bounds of each row's words."""
    if not len(col):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", "<u4")[off[0] // 4 : off[-1] // 4]
    return data.astype(np.uint64), (off - off[0]) // 4


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Words that the rows of ``a`` and ``b`` share, counted with multiplicity."""
    n = len(a)
    keys = []
    for col in (a, b):
        words, at = unpack(col)
        doc = np.repeat(np.arange(n), np.diff(at))
        key = np.sort(mix(words ^ mix(doc.astype(np.uint64))) >> np.uint64(24) | (doc.astype(np.uint64) << np.uint64(40)))
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        place = np.arange(len(key))
        occ = place - np.maximum.accumulate(np.where(new, place, 0)) if len(key) else place
        keys.append((mix(key + np.uint64(0x632BE59BD9B4E019) * occ.astype(np.uint64)), (key >> np.uint64(40)).astype(np.int64)))
    (ka, da), (kb, _) = keys
    return np.bincount(da[is_in(ka, np.sort(kb))], minlength=n)


def text_classes(arrays: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """The classes (by, id, n, words) of rows with the same multiset of words and the same ``by``, ``id`` being
    the smallest of a class, and the membership (columns of ``arrays`` but n and words, class_id) of every row.
    Copies are collapsed before the shuffle. A repeated id of different texts may name several
    classes; it is then alike to what any of them is alike to."""
    keys = ["sig_a", "sig_b", *by]
    classes = cut(arrays.groupBy(*keys).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min_by("words", "id").alias("words")), "classes")
    rows = arrays.drop("n", "words").join(classes.select(*keys, F.col("id").alias("class_id")), keys)
    return classes.drop("sig_a", "sig_b"), cut(rows.drop("sig_a", "sig_b"), "members")


#: one in so many ids tells which keys are hot
HOT_SAMPLE = 16
#: places of the tables of hot keys that reach the tasks; they never grow
HOT_PLACES = 1 << 20


def drawn(rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows of one in ``HOT_SAMPLE`` ids, by hash."""
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(HOT_SAMPLE)) == 0)


def hot_blocks(rows: DataFrame, key: str, block: int) -> np.ndarray:
    """By place (the low bits of a key): in how many blocks of about ``block`` rows the rows of its most
    frequent key go, as the drawn ``rows`` show. At most HOT_PLACES rows reach the driver."""
    n = rows.groupBy(key).agg(F.least(F.lit(65535), F.ceil(F.count("*") * HOT_SAMPLE / F.lit(block))).cast("int").alias("blocks")).filter("blocks > 1")
    found = n.groupBy(F.col(key).bitwiseAND(F.lit(HOT_PLACES - 1)).alias("place")).agg(F.max("blocks").alias("blocks")).toPandas()
    out = np.ones(HOT_PLACES, np.uint16)
    out[found["place"].to_numpy(np.int64)] = found["blocks"].to_numpy(np.uint16)
    return out


def dealt(key: np.ndarray, own: np.ndarray, mine: np.ndarray, theirs: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the rows of one side of a join, with hot keys made into keys of two blocks: a row
    is in one block of its own side, by its hash ``own``, and in every block of the other, so that it meets
    each row of the other side once, in one of many tasks."""
    place = (key & np.uint64(HOT_PLACES - 1)).astype(np.int64)
    times = theirs[place].astype(np.int64)
    at = np.repeat(np.arange(len(key)), times)
    other = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    block = own[at] % mine[place[at]].astype(np.uint64)
    i, j = (block, other) if left else (other, block)
    hot = (mine[place[at]] > 1) | (times[at] > 1)
    return at, np.where(hot, mix(key[at] ^ mix((i << np.uint64(32)) + j + np.uint64(1))), key[at])


def block_pairs(rows: DataFrame, block: int, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b, n), a < b: every two ids of ``rows`` (key, id, ..., read several times, so a written
    table) with keys in common, and on how many of these their rows pass ``fits``; pairs without one
    that passes are left out.

    Rows are shuffled by key once and joined with themselves. Keys that a draw of ids by hash shows
    to have more than about ``block`` rows are not joined in one task: their rows are dealt
    to blocks, and each two blocks are joined on their own. The draw decides on the way only; nothing is
    left out on either."""
    hot = drawn(rows).groupBy("key").agg(F.ceil(F.count("*") * HOT_SAMPLE / F.lit(block)).cast("int").alias("blocks")).filter("blocks > 1")
    placed = rows.join(cut(hot, "hot"), "key", "left")
    row = F.struct(*[c for c in rows.columns if c != "key"])
    few = placed.filter("blocks is null")
    near = few.select("key", row.alias("x")).join(few.select("key", row.alias("y")), "key")
    many = placed.filter("blocks is not null")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = many.select("key", own.alias("i"), each.alias("j"), row.alias("x"))
    y = many.select("key", each.alias("i"), own.alias("j"), row.alias("y"))
    both = near.select("x", "y").unionByName(x.join(y, ["key", "i", "j"]).select("x", "y"))
    met = both.filter((F.col("x.id") < F.col("y.id")) & fits(F.col("x"), F.col("y")))
    return met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("n"))


#: rows by which the rarity of words is told; it orders them and leaves none out
RANK_ROWS = 30_000
#: ranked words that reach the tasks at most, the most frequent ones; all others count as rare
RANK_WORDS = 1_000_000


def labelled(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words with their occurrence in the row, so that a multiset of words is a set of these."""
    return mix(words + np.uint64(0x5851F42D4C957F2D) * (occurrence(words, doc) + 1).astype(np.uint64))


def word_ranks(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted labelled words that stand in two rows or more of about ``RANK_ROWS`` rows drawn by
    hash, and in how many; ``RANK_WORDS`` of them at most. Together with the word itself this is one order of all words, the rare
    ones first; any order is right, a good one only makes fewer candidates."""
    share = min(1.0, RANK_ROWS / max(classes.count(), 1))
    drawn = classes.filter(F.pmod(F.xxhash64(F.col("id"), F.lit(13)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = unpack(b.column(0))
            u, c = np.unique(labelled(words, np.repeat(np.arange(len(at) - 1), np.diff(at))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])

    counts = cut(drawn.select("words").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "ranks")
    least, total = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect():  # no more than rows drawn
        total += r.m
        if total > RANK_WORDS:
            break
        least = r.n
    found = counts.filter(F.lit(False) if least is None else F.col("n") >= least).toPandas()
    word = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], found["n"].to_numpy(np.int64)[order]


def ranked(words: np.ndarray, at: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, labelled word) of all words, each row's in the order of ``ranks``."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    g = labelled(words, doc)
    n = np.zeros(len(g), np.int64)
    if len(ranks[0]):
        known = is_in(g, ranks[0])
        n[known] = ranks[1][np.searchsorted(ranks[0], g[known])]
    g = g[np.lexsort((g, n, doc))]
    return doc, np.arange(len(g)) - at[doc], g


def reach(n: np.ndarray, share: float) -> np.ndarray:
    """How many of its first words a row of ``n`` must show so that a row with which it shares at
    least ``share`` of ``n`` words has one of these among its own first ones."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
