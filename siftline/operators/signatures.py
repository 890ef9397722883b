"""API signatures of Java test code: nine keyword and pattern rules as built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import spread

# What the rules look for, in the order in which tokens are emitted. Quantifiers are
# possessive for speed; the matches are those of the plain ones.
RECEIVER = r"\b(\w++)\.\w++\s*+\("
ANNOTATIONS = ["@Test", "@Before", "@After", "@BeforeClass", "@AfterClass", "@RunWith", "@Mock", "@InjectMocks", "@Spy"]
ASSERTS = r"\bassert(True|False|Equals|NotEquals|Null|NotNull|Same|NotSame|ArrayEquals|Throws)"
CALLS = ["fail", "verify", "when", "thenReturn", "mock"]
CONCURRENCY = [
    "Thread", "Runnable", "ExecutorService", "Future", "CompletableFuture", "synchronized",
    "volatile", "CountDownLatch", "CyclicBarrier", "Semaphore", "Lock", "ReentrantLock",
]
TIME = ["Thread.sleep", "TimeUnit", "System.currentTimeMillis", "System.nanoTime", "Calendar", "Date", "LocalDateTime", "Instant"]
COLLECTIONS = ["List", "Set", "Map", "Queue", "ArrayList", "HashSet", "HashMap", "LinkedList", "TreeSet", "TreeMap"]
IO = ["InputStream", "OutputStream", "Reader", "Writer", "File", "FileInputStream", "FileOutputStream", "BufferedReader", "BufferedWriter"]
MOCKS = [(["Mockito", "mock(", "@Mock"], "mock_framework"), (["PowerMock"], "powermock")]
DATABASE = ["Connection", "Statement", "PreparedStatement", "ResultSet", "Transaction", "EntityManager", "Session"]


def _all(code: Column, pattern: str, group: int, prefix: str = "", has: str = "") -> Column:
    """All matches, words being Unicode words; plain ASCII texts take the faster classes, and texts
    without the literal ``has`` are not searched."""
    found = lambda flags: F.regexp_extract_all(code, F.lit(flags + pattern), F.lit(group))
    every = F.when(code.rlike(r"[^\x00-\x7F]"), found("(?U)")).otherwise(found(""))
    if has:
        every = F.when(code.contains(has), every).otherwise(F.array().cast("array<string>"))
    return F.transform(every, lambda x: F.concat(F.lit(prefix), x)) if prefix else every


def _present(code: Column, words: list[str], prefix: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(code.contains(w), prefix + w.replace(".", "_")) for w in words]))


def signature(code: Column) -> Column:
    """The tokens of a text, in rule order, with repeats; of a null text none."""
    c = F.coalesce(code, F.lit(""))
    return F.flatten(
        F.array(
            _all(c, RECEIVER, 1),
            _present(c, ANNOTATIONS),
            _all(c, ASSERTS, 1, "assert_", "assert"),
            *[_all(c, rf"\b{x}\s*\(", 0, "assert_", x) for x in CALLS],
            _present(c, CONCURRENCY, "async_"),
            _present(c, TIME, "time_"),
            F.array_compact(F.array(*[F.when(c.contains(x) & c.rlike(rf"(?U)\b{x}\b"), x) for x in COLLECTIONS])),
            _present(c, IO, "io_"),
            F.array_compact(F.array(*[F.when(reduce(or_, [c.contains(w) for w in words]), token) for words, token in MOCKS])),
            _present(c, DATABASE, "db_"),
        )
    )


def with_signature(df: DataFrame, code: str = "code", to: str = "sig") -> DataFrame:
    return spread(df).withColumn(to, signature(F.col(code)))


def signature_statistics(df: DataFrame, sig: str = "sig") -> DataFrame:
    """One row: rows, distinct tokens, all tokens, mean tokens a row (empty signatures count)."""
    rows = df.agg(F.count("*").alias("n_rows"))
    per = df.select(F.explode(sig).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    tokens = per.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    # two aggregates of one row each
    return rows.join(F.broadcast(tokens)).select("n_rows", "n_distinct", "n_tokens", F.coalesce(F.try_divide("n_tokens", "n_rows"), F.lit(0.0)).alias("mean_tokens"))


def top_tokens(df: DataFrame, n: int = 10, sig: str = "sig") -> DataFrame:
    """The n most frequent tokens; of equally frequent ones the first by name."""
    return df.select(F.explode(sig).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)
