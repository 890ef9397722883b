"""Similarity of signatures and retrieval of the most similar rows for many queries.

Tokens in many rows (``HOT_SHARE``) make up a row's pattern, the others are indexed. Rows that share a rare token with a
query are found by an equi-join and scored in full. Of all other rows the score depends on pattern and sizes only, so
patterns are scored instead of rows, block by block, and each brings its lowest ids. The better of
both is exact, and neither grows with queries times rows.

All pairs that share a token (``shared_tokens``) are as many as queries times rows where a token is in every row, so none is
shuffled: frequent tokens are bits, which blocks of queries and rows compare where their pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut

#: queries that are scored together
QUERY_BLOCK = 1000
#: rows (or patterns of rows) that are scored together
ROW_BLOCK = 4096
#: a token in this share of the rows belongs to the patterns; so many tokens at most, the others are indexed
HOT_SHARE = 0.001
HOT_TOKENS = 1024
#: rows and queries whose pairs are made from one row of two blocks; what comes of it is held in memory until it is read
ROW_PAIRS, QUERY_PAIRS = 64, 256
#: queries that are compared with a block of rows at once
COMPARED = 64
#: rows and queries that meet in one task
TASK_ROWS, TASK_QUERIES = 16_384, 8_192
JACCARD_WEIGHT, OVERLAP_WEIGHT = 0.6, 0.4


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 if there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def frequency_overlap(a: Column, b: Column) -> Column:
    """Shared tokens counted with multiplicity over the tokens of both; at most 0.5."""
    common = F.array_intersect(a, b)
    count = lambda s, t: F.size(F.filter(s, lambda x: x == t))
    shared = F.aggregate(common, F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return F.lit(JACCARD_WEIGHT) * jaccard(a, b) + F.lit(OVERLAP_WEIGHT) * frequency_overlap(a, b)


def _similarity(inter: np.ndarray, shared: np.ndarray, u: np.ndarray, t: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Similarity of all pairs from their shared tokens (distinct, and with repeats) and both sides' sizes."""
    both = u[:, None] + v[None, :] - inter
    j = np.divide(inter, both, out=np.zeros_like(inter), where=both > 0)
    total = t[:, None] + w[None, :]
    f = np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)
    return JACCARD_WEIGHT * j + OVERLAP_WEIGHT * f


def _occurrence(row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """How often the same token stood before in the same row."""
    order = np.lexsort((token, row))
    new = np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(token[order]) != 0)])[: len(order)]
    place = np.arange(len(order))
    occ = np.empty(len(order), np.int64)
    occ[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return occ


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of each query's k best rows by (similarity desc, id)."""
    if sim.shape[1] > k:  # no worse than the k-th; ties are told apart below
        q, r = np.nonzero(sim >= -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k])
    else:
        q, r = (x.ravel() for x in np.indices(sim.shape))
    s = sim[q, r]
    order = np.lexsort((ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    keep = (np.arange(len(q)) - np.searchsorted(q, q) < k) & (s > -np.inf)
    return q[keep], r[keep], s[keep]


def _hot_tokens(rows: DataFrame) -> list[str]:
    """Tokens that stand in at least ``HOT_SHARE`` of the rows, the ``HOT_TOKENS`` most frequent at most."""
    n = rows.select(F.explode(F.array_distinct("sig")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    least = max(2, rows.count() * HOT_SHARE)
    return [r.t for r in n.filter(F.col("n") >= least).orderBy(F.desc("n"), "t").limit(HOT_TOKENS).collect()]


def _patterns(rows: DataFrame, hot: list[str]) -> DataFrame:
    """(id, sig, u, t, pattern, rare): distinct tokens and all tokens of each row, its hot tokens with their
    occurrences as sorted codes, and its other tokens once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot, pa.string())
        for b in batches:
            sig = b.column(1)
            n = pc.fill_null(pc.list_value_length(sig), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            flat = sig.flatten()
            token = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            occ = _occurrence(row, token)
            code = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.flatnonzero(code >= 0)
            own = own[np.lexsort((occ[own], code[own], row[own]))]
            rare = np.flatnonzero((code < 0) & (occ == 0))
            bounds = lambda at: pa.array(np.searchsorted(row[at], np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), sig, pa.array(np.bincount(row[occ == 0], minlength=b.num_rows)), pa.array(n),
                    pa.ListArray.from_arrays(bounds(own), pa.array(code[own] << 32 | occ[own])), pa.ListArray.from_arrays(bounds(rare), flat.take(pa.array(rare))),
                ],
                names=["id", "sig", "u", "t", "pattern", "rare"],
            )

    return rows.select(F.col("id").cast("bigint"), "sig").mapInArrow(run, "id bigint, sig array<string>, u bigint, t bigint, pattern array<bigint>, rare array<string>")


def _in_blocks(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``rows``: the rows in blocks of about ``size`` by hash of the first column."""
    blocks = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(columns[0], F.lit(7)), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(*columns)).alias("rows")).select("rows")


def _codes(rows: list[dict], columns: np.ndarray) -> np.ndarray:
    """1 where a pattern has the code of a column."""
    n = [len(r["pattern"]) for r in rows]
    flat = np.fromiter((x for r in rows for x in r["pattern"]), np.int64, sum(n))
    at = np.searchsorted(columns, flat)
    known = columns[np.minimum(at, len(columns) - 1)] == flat if len(columns) else np.zeros(len(flat), bool)
    out = np.zeros((len(rows), len(columns)), np.float32)
    out[np.repeat(np.arange(len(rows)), n)[known], at[known]] = 1
    return out


def _scored(queries: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """(q, r, sim): the k best row patterns of each query pattern in each two blocks, by similarity, then id."""
    both = queries.withColumnRenamed("rows", "q").crossJoin(rows.withColumnRenamed("rows", "r"))  # blocks of a query set against blocks of all patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, r = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                columns = np.unique(np.fromiter((x for row in q for x in row["pattern"]), np.int64))
                first = columns & 0xFFFFFFFF == 0
                x, y = _codes(q, columns), _codes(r, columns)
                inter, shared = (x[:, first] @ y[:, first].T).astype(float), (x @ y.T).astype(float)
                size = lambda rows, c: np.array([row[c] for row in rows], float)
                sim = _similarity(inter, shared, size(q, "u"), size(q, "t"), size(r, "u"), size(r, "t"))
                sim[sim < least] = -np.inf
                at, to, best = _best(sim, np.array([row["key"] for row in r]), k)
                yield pa.RecordBatch.from_arrays([pa.array([q[j]["key"] for j in at], pa.int64()), pa.array([r[j]["key"] for j in to], pa.int64()), pa.array(best)], names=["q", "r", "sim"])

    return both.mapInArrow(run, "q bigint, r bigint, sim double")


def retrieve_top_k(queries: DataFrame, rows: DataFrame, k: int = 3, min_similarity: float = 0.0, skip_self: bool = True) -> DataFrame:
    """(query_id, rank, cand_id, similarity): the k rows of ``rows`` (id, sig) most similar to each
    query (id, sig), among those of at least ``min_similarity``; equal ones by ascending id. With 0
    every query gets min(k, rows) rows. ``skip_self`` leaves out the row of the query's own id.
    Repeated query ids are an error, null signatures count as empty."""
    signed = cut(rows.select("id", "sig"), "signatures")
    hot = _hot_tokens(signed)
    r, q = cut(_patterns(signed, hot), "patterns"), cut(_patterns(queries.select("id", "sig"), hot), "patterns")
    if not q.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("query ids must be unique")
    kind = ["pattern", "u", "t"]
    # a pattern is named by its lowest id and stands for its k + 1 lowest ones
    low = F.row_number().over(Window.partitionBy(*kind).orderBy("id"))
    lowest = cut(r.select("id", *kind).withColumn("_n", low).filter(F.col("_n") <= k + 1).groupBy(*kind).agg(F.sort_array(F.collect_list("id")).alias("ids")), "lowest")
    named = q.groupBy(*kind).agg(F.min("id").alias("key"))
    row = ["key", "u", "t", "pattern"]
    met = _scored(_in_blocks(named, row, QUERY_BLOCK), _in_blocks(lowest.withColumn("key", F.col("ids")[0]), row, ROW_BLOCK), k + 1, min_similarity)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "r"))
    met = met.withColumn("_n", best).filter(F.col("_n") <= k + 1).join(lowest.select(F.col("ids")[0].alias("r"), "ids"), "r")
    by_pattern = q.select(F.col("id").alias("query_id"), *kind).join(named, kind).select("query_id", F.col("key").alias("q")).join(met, "q").select("query_id", F.explode("ids").alias("cand_id"), "sim")
    # rows with a rare token of the query
    x = q.select(F.col("id").alias("query_id"), F.explode("rare").alias("token"))
    y = r.select(F.col("id").alias("cand_id"), F.explode("rare").alias("token"))
    pairs = x.join(y, "token").select("query_id", "cand_id").distinct()
    full = pairs.join(q.select(F.col("id").alias("query_id"), F.col("sig").alias("a")), "query_id").join(r.select(F.col("id").alias("cand_id"), F.col("sig").alias("b")), "cand_id")
    by_token = full.select("query_id", "cand_id", similarity(F.col("a"), F.col("b")).alias("sim")).filter(F.col("sim") >= min_similarity)
    found = by_pattern.unionByName(by_token)
    if skip_self:
        found = found.filter("query_id <> cand_id")
    one = found.groupBy("query_id", "cand_id").agg(F.max("sim").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "cand_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "cand_id", "similarity")


def _labelled(sigs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, label, occurrence) of all tokens, where equal labels are the same token at its same occurrence."""
    n = np.fromiter(map(len, sigs), np.int64, len(sigs))
    row = np.repeat(np.arange(len(sigs)), n)
    token = pa.array([t for s in sigs for t in s], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    occ = _occurrence(row, token)
    return row, token << 32 | occ, occ


def _all_scores(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Similarity of every two signatures of both sides."""
    row, label, occ = _labelled(left + right)
    mine = row < len(left)
    columns = np.intersect1d(label[mine], label[~mine])  # only shared tokens count
    at = np.minimum(np.searchsorted(columns, label), max(len(columns) - 1, 0))
    both = np.zeros((len(left) + len(right), len(columns)), np.float32)
    if len(columns):
        keep = columns[at] == label
        both[row[keep], at[keep]] = 1
    x, y, first = both[: len(left)], both[len(left) :], columns & 0xFFFFFFFF == 0
    u, t = np.bincount(row[occ == 0], minlength=len(both)).astype(float), np.bincount(row, minlength=len(both)).astype(float)
    return _similarity((x[:, first] @ y[:, first].T).astype(float), (x @ y.T).astype(float), u[: len(left)], t[: len(left)], u[len(left) :], t[len(left) :])


def _next_pick(queries: DataFrame, rows: DataFrame, threshold: float, skip_self: bool) -> DataFrame:
    """(query_id, cand_id, sim): in each two blocks the best row of each query (id, sig, taken) that is not taken and is
    similar to no taken one by more than ``threshold``."""
    both = queries.withColumnRenamed("rows", "q").crossJoin(rows.withColumnRenamed("rows", "r"))  # blocks of a query set against blocks of all rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, r = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                taken = [(j, t) for j, x in enumerate(q) for t in x["taken"]]
                own, ids = np.array([x["id"] for x in q]), np.array([x["id"] for x in r])
                sim = _all_scores([x["sig"] for x in q] + [t["sig"] for _, t in taken], [x["sig"] for x in r])
                near, sim = sim[len(q) :] > threshold, sim[: len(q)]
                if skip_self:
                    sim[own[:, None] == ids[None, :]] = -np.inf
                for (j, t), close in zip(taken, near):
                    sim[j, close | (ids == t["cand_id"])] = -np.inf
                at, to, best = _best(sim, ids, 1)
                yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int64()), pa.array(ids[to], pa.int64()), pa.array(best)], names=["query_id", "cand_id", "sim"])

    return both.mapInArrow(run, "query_id bigint, cand_id bigint, sim double")


def retrieve_with_diversity(queries: DataFrame, rows: DataFrame, k: int = 3, threshold: float = 0.3, skip_self: bool = True) -> DataFrame:
    """(query_id, rank, cand_id, similarity): going down the rows by similarity, those are taken
    whose similarity to every one taken before is at most ``threshold``; if that gives fewer than
    k, the best of the others follow.

    Taken as k rounds: each finds the best row of every query among those not too similar to the
    rows taken before, so the result is that of the greedy scan. Blocks of queries with what they have taken
    meet blocks of rows; nothing reaches the driver."""
    sig = F.coalesce("sig", F.array().cast("array<string>")).alias("sig")
    rows = cut(rows.select(F.col("id").cast("bigint").alias("id"), sig), "signatures")
    queries = cut(queries.select(F.col("id").cast("bigint").alias("id"), sig), "queries")
    if not queries.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("query ids must be unique")
    by_id = rows.select(F.col("id").alias("cand_id"), F.col("sig").alias("cand_sig")).dropDuplicates(["cand_id"])
    blocks = cut(_in_blocks(rows, ["id", "sig"], ROW_BLOCK), "blocks")
    state = queries.withColumn("taken", F.array().cast("array<struct<cand_id:bigint,sim:double,sig:array<string>>>"))
    first = Window.partitionBy("query_id").orderBy(F.desc("sim"), "cand_id")
    for _ in range(k):
        found = _next_pick(_in_blocks(state, ["id", "sig", "taken"], QUERY_BLOCK), blocks, threshold, skip_self)
        best = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").join(by_id, "cand_id")
        pick = best.select(F.col("query_id").alias("id"), F.array(F.struct("cand_id", "sim", F.col("cand_sig").alias("sig"))).alias("pick"))
        more = F.concat("taken", F.coalesce("pick", F.array().cast("array<struct<cand_id:bigint,sim:double,sig:array<string>>>")))
        state = cut(state.join(pick, "id", "left").select("id", "sig", more.alias("taken")), "taken")
    picked = state.select(F.col("id").alias("query_id"), F.posexplode("taken").alias("n", "x")).select("query_id", (F.col("n") + 1).alias("rank"), "x.cand_id", F.col("x.sim").alias("similarity"))
    short = state.filter(F.size("taken") < k)
    if short.isEmpty():
        return picked
    rest = retrieve_top_k(short.select("id", "sig"), rows, 2 * k, 0.0, skip_self).join(picked.select("query_id", "cand_id"), ["query_id", "cand_id"], "left_anti")
    have = short.select(F.col("id").alias("query_id"), F.size("taken").alias("have"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "cand_id")) + F.col("have")
    fill = rest.join(have, "query_id").withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "cand_id", "similarity")
    return picked.unionByName(fill)


def _tokens(sig: pa.Array, rows: int) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each row, distinct tokens; row, token's index and occurrence of every token)."""
    n = pc.fill_null(pc.list_value_length(sig), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(rows), n)
    coded = sig.flatten().dictionary_encode()
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return n, coded.dictionary, row, token, _occurrence(row, token)


def _hot_labels(rows: DataFrame) -> list[tuple[str, int]]:
    """(token, occurrence) of at least ``HOT_SHARE`` of the rows, the ``HOT_TOKENS`` most frequent at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, words, _, token, occ = _tokens(b.column(0), b.num_rows)
            label, n = np.unique(token << 32 | occ, return_counts=True)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(label >> 32)), pa.array(label & 0xFFFFFFFF), pa.array(n)], names=["token", "occ", "n"])

    n = rows.select("sig").mapInArrow(run, "token string, occ bigint, n bigint").groupBy("token", "occ").agg(F.sum("n").alias("n"))
    least = max(2, rows.count() * HOT_SHARE)
    return [(r.token, r.occ) for r in n.filter(F.col("n") >= least).orderBy(F.desc("n"), "token", "occ").limit(HOT_TOKENS).collect()]


def _masks(rows: DataFrame, hot: list[tuple[str, int]]) -> tuple[DataFrame, list[str], list[str]]:
    """(id, u, t, x0 ..., y0 ..., rare): distinct tokens and all tokens of each row, bits of its hot tokens, bits of their
    repeats, and its other tokens with their occurrences; names of both kinds of bits."""
    words = sorted({token for token, _ in hot})
    at = {token: i for i, token in enumerate(words)}
    first, again = [h for h in hot if h[1] == 0], [h for h in hot if h[1] > 0]
    kinds = [[f"{kind}{i}" for i in range(-(-len(labels) // 64))] for kind, labels in (("x", first), ("y", again))]
    place = [*range(len(first)), *(64 * len(kinds[0]) + i for i in range(len(again)))]
    coded = sorted((at[token] << 32 | occ, p) for (token, occ), p in zip(first + again, place))
    labels, places = np.array([c for c, _ in coded], np.int64), np.array([p for _, p in coded], np.int64)
    columns = kinds[0] + kinds[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for b in batches:
            n, own, row, token, occ = _tokens(b.column(1), b.num_rows)
            code = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[token]
            label = np.where(code < 0, -1, code << 32 | occ)
            to = np.minimum(np.searchsorted(labels, label), max(len(labels) - 1, 0))
            is_hot = labels[to] == label if len(labels) else np.zeros(len(label), bool)
            bits = np.zeros((len(columns), b.num_rows), np.uint64)
            p = places[to[is_hot]] if len(labels) else places
            np.bitwise_or.at(bits, (p // 64, row[is_hot]), np.uint64(1) << (p % 64).astype(np.uint64))
            rare = np.flatnonzero(~is_hot)
            bounds = pa.array(np.searchsorted(row[rare], np.arange(b.num_rows + 1)), pa.int32())
            others = pa.StructArray.from_arrays([own.take(pa.array(token[rare])), pa.array(occ[rare])], names=["token", "occ"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.bincount(row[occ == 0], minlength=b.num_rows)), pa.array(n), *(pa.array(x.view(np.int64)) for x in bits), pa.ListArray.from_arrays(bounds, others)],
                names=["id", "u", "t", *columns, "rare"],
            )

    schema = "id bigint, u bigint, t bigint, " + "".join(f"{c} bigint, " for c in columns) + "rare array<struct<token: string, occ: bigint>>"
    return rows.select("id", "sig").mapInArrow(run, schema), *kinds


def _common(a: Callable[[str], Column], b: Callable[[str], Column], columns: list[str]) -> Column:
    return sum((F.bit_count(a(c).bitwiseAND(b(c))) for c in columns), F.lit(0)).cast("bigint")


def _met(queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str], list[str]]:
    """Masks of queries (id, sig) and rows (id, sig), where signatures of one id are one; pairs that share a token, at an
    occurrence, which is no bit (query_id, cand_id, inter, shared: how many such ones, distinct and all); names of the bits.

    A token at its n-th occurrence in a row is a label; frequent labels are bits, the others are joined."""
    whole = lambda df: df.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.flatten(F.collect_list("sig")).alias("sig"))
    signed = cut(whole(rows), "signatures")
    hot = _hot_labels(signed)
    masks, x, y = _masks(signed, hot)
    r, q = cut(masks, "masks"), cut(_masks(whole(queries), hot)[0], "masks")
    label = lambda df, name: df.select(F.col("id").alias(name), F.inline("rare"))
    both = label(q, "query_id").join(label(r, "cand_id"), ["token", "occ"])
    pairs = both.groupBy("query_id", "cand_id").agg(F.count_if(F.col("occ") == 0).alias("inter"), F.count("*").alias("shared"))
    return q, r, pairs, x, y


def _block_pairs(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int) -> DataFrame:
    """(r, q): each block of rows with each block of queries, in tasks of so many rows and queries at most."""
    n, m, cores = rows.count(), queries.count(), rows.sparkSession.sparkContext.defaultParallelism
    r = _in_blocks(rows, rows.columns, row_block).repartition(max(-(-n // TASK_ROWS), min(4 * cores, -(-n // 1024)), 1))
    q = _in_blocks(queries, queries.columns, query_block).repartition(max(1, -(-m // TASK_QUERIES)))
    return r.withColumnRenamed("rows", "r").crossJoin(q.withColumnRenamed("rows", "q").hint("shuffle_replicate_nl"))


def shared_tokens(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, cand_id, inter, shared): how many tokens, distinct and with repeats, each query (id, sig) shares with
    each row (id, sig) of another id, where it shares one. Signatures of one id are one.

    Pairs that share a rare token are found by a join, all others are made block by block from their bits, so
    that none of these is shuffled."""
    q, r, pairs, x, y = _met(queries, rows)
    own = ["id", *x, *y]
    met = pairs.groupBy(F.col("cand_id").alias("id")).agg(F.collect_list(F.struct("query_id", "inter", "shared")).alias("met"))
    r = cut(r.select(*own).join(met, "id", "left"), "met")

    def counted(df: DataFrame, inter: Column, shared: Column) -> DataFrame:
        """``df`` (q, r), with what both share besides their bits."""
        a, b = F.col("q").getField, F.col("r").getField
        first = _common(a, b, x) + inter
        two = df.select(a("id").alias("query_id"), b("id").alias("cand_id"), first.alias("inter"), (first + _common(a, b, y) + shared - inter).alias("shared"))
        return two.filter("inter > 0 and query_id <> cand_id")

    few = r.filter("met is not null").select(F.struct(*own).alias("r"), F.explode("met").alias("m"))
    by_label = counted(few.join(q.select(F.col("id").alias("_id"), F.struct(*own).alias("q")), F.col("m.query_id") == F.col("_id")), F.col("m.inter"), F.col("m.shared"))
    both = _block_pairs(q.select(*own), r.withColumn("met", F.col("met.query_id")), QUERY_PAIRS, ROW_PAIRS)
    every = both.select(F.explode("r").alias("r"), "q").select("r", F.explode("q").alias("q"))
    by_bits = counted(every.filter("r.met is null or not array_contains(r.met, q.id)"), F.lit(0), F.lit(0))
    return by_bits.unionByName(by_label)


def _fields(block: pa.ListScalar, columns: list[str]) -> list[np.ndarray]:
    return [block.values.field(c).to_numpy(zero_copy_only=False) for c in columns]


def _bits_in_common(a: list[np.ndarray], b: list[np.ndarray], outer: bool) -> np.ndarray:
    """Common bits of all words, of every two sides or of the pairs as they stand."""
    first = np.zeros((len(a[0]), len(b[0])) if outer else len(a[0]), np.int32)
    for x, y in zip(a[1:], b[1:]):
        first += np.bitwise_count((x[:, None] & y[None, :] if outer else x & y).view(np.uint64))
    return first


def similar_pairs(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(query_id, cand_id, similarity) of each query (id, sig) and each row (id, sig) of another id, where that is at least
    ``least``, which is above 0. Signatures of one id are one.

    The overlap is at most 0.5, so the Jaccard similarity has a lower bound; blocks of bits are compared with it, and what is
    left is scored in full. Pairs that share a rare token, too, are scored by a join; theirs is the higher score."""
    if least <= 0:
        raise ValueError("least must be above 0")
    q, r, pairs, x, y = _met(queries, rows)
    own = ["id", "u", "t", *x, *y]
    j = max(0.0, (least - OVERLAP_WEIGHT / 2) / JACCARD_WEIGHT)
    share = j / (1 + j)  # of both sides' distinct tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, m = (_fields(block[i], own) for block in (b.column(0), b.column(1)))  # rows, queries
                low = [np.floor(side[1] * (share * 1024) - 1).astype(np.int32) for side in (n, m)]
                words = [[side[0], *side[3 : 3 + len(x)]] for side in (n, m)]
                for at in range(0, len(m[0]), COMPARED):
                    inter = _bits_in_common([w[at : at + COMPARED] for w in words[1]], words[0], True)
                    to, of = np.nonzero((inter * 1024 >= low[1][at : at + COMPARED, None] + low[0][None, :]) & (inter > 0))
                    to += at
                    a, c = [f[to] for f in m], [f[of] for f in n]
                    first = _bits_in_common([a[0], *a[3 : 3 + len(x)]], [c[0], *c[3 : 3 + len(x)]], False).astype(float)
                    shared = first + _bits_in_common([a[0], *a[3 + len(x) :]], [c[0], *c[3 + len(x) :]], False)
                    sim = JACCARD_WEIGHT * (first / (a[1] + c[1] - first)) + OVERLAP_WEIGHT * (shared / (a[2] + c[2]))
                    keep = (sim >= least) & (a[0] != c[0])
                    yield pa.RecordBatch.from_arrays([pa.array(a[0][keep]), pa.array(c[0][keep]), pa.array(sim[keep])], names=["query_id", "cand_id", "similarity"])

    has_id = lambda df: df.select(*own).filter("id is not null")
    by_bits = _block_pairs(has_id(q), has_id(r), QUERY_BLOCK, ROW_BLOCK).select("r", "q").mapInArrow(run, "query_id bigint, cand_id bigint, similarity double")
    side = lambda df, key, name: df.select(F.col("id").alias(key), F.struct(*own).alias(name))
    full = pairs.filter("query_id <> cand_id").join(side(q, "query_id", "q"), "query_id").join(side(r, "cand_id", "r"), "cand_id")
    a, b = F.col("q").getField, F.col("r").getField
    first = _common(a, b, x) + F.col("inter")
    shared = first + _common(a, b, y) + F.col("shared") - F.col("inter")
    sim = F.lit(JACCARD_WEIGHT) * F.try_divide(first, a("u") + b("u") - first) + F.lit(OVERLAP_WEIGHT) * F.try_divide(shared, a("t") + b("t"))
    by_label = full.select("query_id", "cand_id", sim.alias("similarity")).filter(F.col("similarity") >= least)
    return by_bits.unionByName(by_label).groupBy("query_id", "cand_id").agg(F.max("similarity").alias("similarity"))
