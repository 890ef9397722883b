"""Problem 9: evaluation texts leaking into training text, by greedy string tiling.

Evaluation items become a table of seeds: Karp-Rabin hashes of their windows of ``SEED_WORDS`` words
(items in scripts without blanks: ``SEED_CHARS`` letters or digits). Every document is scanned once
with the same rolling hash and joined with the seeds; where a document and an item share enough of
them, the longest matches that do not overlap are marked one after the other (tiles). A document
gives an item away if one tile is a whole passage (``WORDS`` or ``CHARS``), or if its tiles, in
whatever order they stand, cover ``COVERAGE`` of the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.textscan import Words, chunks, codes, kinds, mix, prefix, spans_hash, windows
from siftline.session import cut, spread

#: a passage in words, and in letters and digits for items of UNSPACED languages
WORDS = 12
CHARS = 30
UNSPACED = {"zh", "ja"}
#: least tile
SEED_WORDS = 6
SEED_CHARS = 15
#: share of an item that smaller tiles have to cover
COVERAGE = 0.6
#: items of at most so many characters reach the tasks whole; more are joined by seed
BLOCK_CHARS = 20_000_000
#: bits of the table that tells which seeds there are, where they are joined; it never grows
SEED_BITS = 1 << 26
FOUND = "tiles int, covered int, longest int, coverage double, verbatim boolean"
NAMES = ["doc_id", "item_id", "tiles", "covered", "longest", "coverage", "verbatim"]


class Seeds:
    """Units (word or character hashes) of each item and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int, str]], chars: bool):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.chars = chars
        self.size, self.passage = (SEED_CHARS, CHARS) if chars else (SEED_WORDS, WORDS)
        units, doc = hashed_units([t for _, t in items], chars)
        start, end = _slices(doc, len(items))
        self.units = [units[a:b] for a, b in zip(start, end)]
        first, h = windows(units, doc, self.size)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], doc[first[order]], first[order] - start[doc[first[order]]]


def _slices(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(n), side="right")


def hashed_units(texts: list[str], chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits) or of all letters and digits, case
    ignored, and the text each is from."""
    texts = [t.casefold() for t in texts]
    if not chars:
        w = Words(texts, underscore=False)
        return w.hash, w.doc
    c, begin = codes(texts)
    keep = np.flatnonzero(kinds(c) == 1)
    return mix(c[keep].astype(np.uint64) + np.uint64(1)), np.searchsorted(begin, keep, side="right") - 1


def tile(text: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed hits (place in text, place in item): tiles (text, item,
    length), longest first, of at least ``least`` units, that overlap in neither."""
    open_: list[tuple[int, int, int]] = []
    last_d, last_end = None, 0
    for d, p in sorted((p - q, p) for p, q in hits):  # hits of one match lie on one diagonal; each is extended once
        if d == last_d and p < last_end:
            continue
        a, b = p, p
        while a > 0 and a - d > 0 and text[a - 1] == item[a - 1 - d]:
            a -= 1
        while b < len(text) and b - d < len(item) and text[b] == item[b - d]:
            b += 1
        last_d, last_end = d, b
        if b - a >= least:
            open_.append((a - b, a, d))
    heapq.heapify(open_)
    in_text, in_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while open_:
        n, a, d = heapq.heappop(open_)
        n = -n
        free = ~(in_text[a : a + n] | in_item[a - d : a - d + n])
        if free.all():
            in_text[a : a + n] = True
            in_item[a - d : a - d + n] = True
            tiles.append((a, a - d, n))
            continue
        # what is left of a match that was partly marked competes again
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= least:
                heapq.heappush(open_, (x - y, a + x, d))
    return tiles


def _verdict(text: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], size: int, passage: int) -> tuple | None:
    """(tiles, covered, longest, coverage, verbatim) of a document and an item it gives away."""
    tiles = tile(text, item, hits, size)
    covered = sum(n for _, _, n in tiles)
    if not tiles or (tiles[0][2] < passage and covered < COVERAGE * len(item)):
        return None
    return len(tiles), covered, tiles[0][2], covered / len(item), tiles[0][2] >= passage


def _promising(pair: np.ndarray, place: np.ndarray, length: np.ndarray, size: int, passage: int) -> np.ndarray:
    """Of hits sorted by pair and place in the item (of ``length``): True for those of pairs that can have
    a whole passage (so many seeds in a row) or windows over ``COVERAGE`` of the item."""
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    group = np.cumsum(new) - 1
    step = np.where(new, size, np.minimum(size, place - np.concatenate([[0], place[:-1]])))
    most = np.bincount(group, step)
    count = np.bincount(group)
    return ((count > passage - size) | (most >= COVERAGE * length[new]))[group]


def _scan(texts: list[str], seeds: Seeds) -> list[tuple]:
    units, doc = hashed_units(texts, seeds.chars)
    first, h = windows(units, doc, seeds.size)
    if not len(seeds.hash) or not len(h):
        return []
    lo = np.searchsorted(seeds.hash, h)
    hit = np.flatnonzero(seeds.hash[np.minimum(lo, len(seeds.hash) - 1)] == h)
    if not len(hit):
        return []
    many = np.searchsorted(seeds.hash, h[hit], side="right") - lo[hit]
    s = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    at = np.repeat(first[hit], many)
    start, end = _slices(doc, len(texts))
    d, i, q = doc[at], seeds.item[s], seeds.place[s]
    pair = d * len(seeds.ids) + i
    order = np.lexsort((q, pair))
    pair, d, i, p, q = pair[order], d[order], i[order], (at - start[d])[order], q[order]
    n = np.array([len(u) for u in seeds.units])
    keep = np.flatnonzero(_promising(pair, q, n[i], seeds.size, seeds.passage))
    out = []
    if len(keep):
        for part in np.split(keep, np.flatnonzero(np.diff(pair[keep])) + 1):
            k = part[0]
            found = _verdict(units[start[d[k]] : end[d[k]]], seeds.units[i[k]], list(zip(p[part].tolist(), q[part].tolist())), seeds.size, seeds.passage)
            if found:
                out.append((int(d[k]), int(seeds.ids[i[k]]), *found))
    return out


def _rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], names=NAMES)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, tiles, covered, longest, coverage, verbatim) for every document and item it
    gives away; ``verbatim`` where one tile is a whole passage.

    The items' size is measured first. Up to ``BLOCK_CHARS`` characters they reach the tasks whole, and nothing
    is shuffled; beyond that, seeds are joined (``_joined``). Either way the documents are read once.
    Null and empty texts leak nothing, items shorter than a window cannot be found,
    repeated rows are reported once each."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if size > BLOCK_CHARS:
        return _joined(docs, items)
    rows = items.filter(F.col("text").isNotNull()).select("item_id", "text", "lang").orderBy("item_id").collect()
    parts = [Seeds([(r.item_id, r.text) for r in rows if (r.lang in UNSPACED) == chars], chars) for chars in (False, True)]
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at, part in chunks(texts):
                found = [(at + d, *rest) for seeds in sent.value for d, *rest in _scan(part, seeds)]
                if found:
                    yield _rows(ids, found)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint, {FOUND}")


def _seed_table(texts: DataFrame, key: str, both: bool, bits: np.ndarray | None = None) -> DataFrame:
    """(row, key, chars, units, places, hashes): the unit hashes of a text and its windows, those that are marked in
    ``bits`` where given (rows without one left out); of all texts (``both``) as words and as
    characters, else as their language says."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(3).to_pylist()
            for at, part in chunks(b.column(2).to_pylist()):
                for chars in (False, True):
                    mine = [i for i in range(len(part)) if both or (langs[at + i] in UNSPACED) == chars]
                    units, doc = hashed_units([part[i] for i in mine], chars)
                    start, end = _slices(doc, len(mine))
                    first, h = windows(units, doc, SEED_CHARS if chars else SEED_WORDS)
                    if sent.value is not None:
                        bit = h & np.uint64(SEED_BITS - 1)
                        known = (sent.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                        first, h = first[known > 0], h[known > 0]
                    a, z = _slices(doc[first], len(mine))
                    rows = [k for k in range(len(mine)) if z[k] > a[k]]
                    take = pa.array([at + mine[k] for k in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(take), b.column(1).take(take), pa.array([chars] * len(rows), pa.bool_()),
                            pa.array([units[start[k] : end[k]].tobytes() for k in rows], pa.binary()),
                            pa.array([(first[a[k] : z[k]] - start[k]).tolist() for k in rows], pa.list_(pa.int32())),
                            pa.array([h[a[k] : z[k]].view(np.int64).tolist() for k in rows], pa.list_(pa.int64())),
                        ],
                        names=["row", key, "chars", "units", "places", "hashes"],
                    )

    lang = F.lit("") if both else F.coalesce("lang", F.lit(""))
    df = spread(texts.filter("text is not null")).select(F.monotonically_increasing_id().alias("row"), key, "text", lang.alias("lang"))
    return df.mapInArrow(run, f"row bigint, {key} {texts.schema[key].dataType.simpleString()}, chars boolean, units binary, places array<int>, hashes array<bigint>")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``leaked_items`` for items of any size: only windows of documents whose bit is set in a table of
    fixed size are joined with the items' seeds, and only documents that have one are kept."""
    own = cut(_seed_table(items, "item_id", False), "items")
    seen = own.select(F.explode("hashes").alias("h")).select(F.col("h").bitwiseAND(F.lit(SEED_BITS - 1)).alias("bit"))
    # a byte of the table for each row: at most SEED_BITS / 8 rows reach the driver
    marks = seen.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(SEED_BITS // 8, np.uint8)
    bits[marks["byte"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.uint8)
    hit = cut(_seed_table(docs, "doc_id", True, bits), "hits")
    p = hit.select(F.col("row").alias("d"), "chars", F.inline(F.arrays_zip(F.col("places").alias("p"), F.col("hashes").alias("h"))).alias("p", "h"))
    q = own.select(F.col("row").alias("i"), "chars", F.inline(F.arrays_zip(F.col("places").alias("q"), F.col("hashes").alias("h"))).alias("q", "h"))
    pairs = p.join(q, ["chars", "h"]).groupBy("d", "i", "chars").agg(F.collect_list(F.struct("p", "q")).alias("hits"))
    both = pairs.join(hit.select(F.col("row").alias("d"), "chars", "doc_id", F.col("units").alias("text")), ["d", "chars"]).join(own.select(F.col("row").alias("i"), "item_id", F.col("units").alias("item")), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, (item_id, chars, text, item, hits) in enumerate(zip(*[b.column(c).to_pylist() for c in range(1, 6)])):
                size, passage = (SEED_CHARS, CHARS) if chars else (SEED_WORDS, WORDS)
                got = _verdict(np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64), [(x["p"], x["q"]) for x in hits], size, passage)
                if got:
                    found.append((k, item_id, *got))
            if found:
                yield _rows(b.column(0), found)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint, {FOUND}"
    return both.select("doc_id", F.col("item_id").cast("bigint").alias("item_id"), "chars", "text", "item", "hits").mapInArrow(run, kind)
