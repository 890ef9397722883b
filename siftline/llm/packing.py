"""Problem 8: filling containers of fixed capacity, by shortest-pack-first histogram packing.

Token counts are taken once. The driver sees only the histogram of lengths, which the capacity
bounds: lengths are placed longest first, each into the shortest open pattern, which is the one
with the most room, or into a new container if it does not fit there; patterns are counted, not
containers. A pattern is split when only part of its containers get the next length. Documents
then find their container by their rank among the pieces of the same length.
"""

from __future__ import annotations

import base64
import os
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut, spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: how a text is cut before byte pairs are merged: the public pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces of one length are ranked in groups, so that a hot length is no hot task: so many at least,
RANK_GROUPS = 64
#: and more where one group would hold more pieces than this
GROUP_ROWS = 1_000_000

_encoders: dict[str, object] = {}


def encoder(ranks_path: str):
    """The tokenizer of a rank file, loaded once for each Python worker."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


def token_counts(docs: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0 tokens. The rank file is read where
    the driver finds it and sent to the executors."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = os.path.basename(ranks_path)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, kind)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of one container) patterns that hold every item of the histogram."""
    room: dict[int, list[list]] = {}  # free space -> [count, lengths] of open patterns
    spaces: list[int] = []  # the free spaces in use, ascending

    def put(free: int, count: int, lengths: tuple) -> None:
        if free not in room:
            room[free] = []
            insort(spaces, free)
        room[free].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:
                # not even the shortest has room: new containers, each the shortest until it is full
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, left // per, (length,) * per)
                    left %= per
                if left:
                    put(capacity - left * length, 1, (length,) * left)
                break
            free = spaces[-1]
            count, lengths = room[free].pop()
            if not room[free]:
                del room[free]
                spaces.pop()
            took = min(count, left)  # one piece makes a container longer than the others like it
            put(free - length, took, (*lengths, length))
            left -= took
            if count > took:
                put(free, count - took, lengths)
    return [(n, lengths) for free in sorted(room) for n, lengths in room[free]]


def pack(docs: DataFrame, specs: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(spec_id, container_id, doc_id, part, tokens): every document with at least one token stands
    in one container of each spec, whole unless it alone exceeds the usable capacity; then it is
    cut into full parts and a rest (``part`` from 0). Documents without a token need no room and get
    a row with a null container. Container ids are unique for each spec. A spec without usable
    room is an error. Repeated rows of a doc_id are packed as separate items with equal ids."""
    sizes = cut(token_counts(docs, ranks_path), "tokens")
    plans = [(r.spec_id, r.capacity_tokens - r.reserved_tokens) for r in specs.select("spec_id", "capacity_tokens", "reserved_tokens").orderBy("spec_id").collect()]
    if any(c <= 0 for _, c in plans):
        raise ValueError("a container without usable room")
    if not plans:
        return sizes.limit(0).select(F.lit(0).alias("spec_id"), F.lit(None).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("part"), "tokens")
    spec = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("cap")) for s, c in plans]))
    cut_up = (
        sizes.filter("tokens > 0")
        .select("doc_id", "tokens", spec.alias("s"))
        .select("doc_id", "s.spec_id", "s.cap", F.col("tokens").alias("whole"))
        .select("doc_id", "spec_id", "cap", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(whole - 1) div cap"))).alias("part"))
        .select("doc_id", "spec_id", F.col("part").cast("int").alias("part"), F.least("cap", F.col("whole") - F.col("part") * F.col("cap")).alias("tokens"))
    )
    groups = max(RANK_GROUPS, -(-sizes.count() // GROUP_ROWS))
    grouped = cut_up.withColumn("grp", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)))
    # at most capacity x groups rows for each spec
    counts = cut(grouped.groupBy("spec_id", "tokens", "grp").agg(F.count("*").alias("n")), "histogram")
    before = F.sum("n").over(_by("spec_id", "tokens").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("spec_id", "tokens", "grp", F.coalesce(before, F.lit(0)).alias("offset"))
    histograms: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("spec_id", "tokens").agg(F.sum("n").alias("n")).collect():
        histograms.setdefault(r.spec_id, {})[r.tokens] = r.n
    # for each length, ascending ranks at which a run of containers begins: rank r of the run takes
    # container first + (r - low) // per
    runs = []
    for s, cap in plans:
        first, taken = 0, {}
        for n, lengths in pack_histogram(histograms.get(s, {}), cap):
            for length in sorted(set(lengths)):
                per = lengths.count(length)
                low = taken.get(length, 0)
                runs.append((s, length, low, low + n * per, first, per))
                taken[length] = low + n * per
            first += n
    kind = "spec_id int, tokens bigint, low bigint, high bigint, first bigint, per bigint"
    spark = docs.sparkSession
    # patterns are as many as the histogram's lengths in order; one array for each length
    table = spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(list(zip(*runs)) or [()] * 6, [pa.int32(), *[pa.int64()] * 5])], names=[f.split()[0] for f in kind.split(", ")]))
    rank = F.row_number().over(_by("spec_id", "tokens", "grp").orderBy("doc_id", "part")) - 1
    # capacity x groups rows may be too many to broadcast, so this join is told to shuffle
    ranked = grouped.join(offsets.hint("merge"), ["spec_id", "tokens", "grp"]).withColumn("rank", rank + F.col("offset"))
    runs_by = table.groupBy("spec_id", "tokens").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "per"))).alias("runs"))
    placed = ranked.join(runs_by, ["spec_id", "tokens"]).select(
        "spec_id",
        F.filter("runs", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0].alias("run"),
        "doc_id",
        "part",
        "tokens",
        "rank",
    )
    placed = placed.select("spec_id", (F.col("run.first") + F.expr("(rank - run.low) div run.per")).alias("container_id"), "doc_id", "part", "tokens")
    none = sizes.filter("tokens = 0").select(spec.alias("s"), "doc_id", "tokens").select("s.spec_id", F.lit(None).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("part"), "tokens")
    return placed.unionByName(none)


def _by(*cols: str):
    return Window.partitionBy(*cols)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill, least_containers): fill is the used share of the usable
    room; no packing needs fewer than least_containers."""
    use = packed.filter("container_id is not null").groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    cap = F.col("capacity_tokens") - F.col("reserved_tokens")
    return specs.join(use, "spec_id").select("spec_id", "containers", "tokens", F.try_divide(F.col("tokens"), F.col("containers") * cap).alias("fill"), F.ceil(F.col("tokens") / cap).alias("least_containers"))
