"""A pluggable model call over rows: retries, back-off, rate limit and counters for each task."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reply(NamedTuple):
    """A model's text with the tokens it was charged for."""

    text: str | None
    tokens: int = 0


Model = Callable[[str, str], "Reply | str | None"]


class Step(Protocol):
    """A step of a pipeline: a table to a table, with the system prompt it gives its model."""

    system_prompt: str

    def __call__(self, df: DataFrame) -> DataFrame: ...


def rule_model(system: str, prompt: str) -> str:
    """An offline stand-in: a fixed rule over the prompt, for tests and dry runs."""
    kind = "Time" if "currentTimeMillis" in prompt else "Async" if "Thread.sleep" in prompt else "Conc" if "synchronized" in prompt else "Non-Flaky"
    return f"<think>rule</think>\n<answer>答案：{'否' if kind == 'Non-Flaky' else '是'} - {kind}</answer>"


class Pace:
    """Gives calls their turn, ``per_second`` at most, whatever the number of threads."""

    def __init__(self, per_second: float | None):
        self.gap = 1 / per_second if per_second else 0.0
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            turn = max(self.next, time.monotonic())
            self.next = turn + self.gap
        time.sleep(max(0.0, turn - time.monotonic()))


def call_model(df: DataFrame, prompt: str, model: Model = rule_model, system: str = "", tries: int = 3, wait: float = 1.0, threads: int = 1, per_second: float | None = None, workers: int | None = None) -> DataFrame:
    """``df`` with ``output`` (null where every try failed), ``calls``, ``failures`` and ``tokens`` (0
    where the model does not tell). Tries wait 1, 2, 4 ... times ``wait`` seconds. The limit holds
    for each task and counts every try; ``workers`` tasks share the rows where it is given. A null
    prompt is not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)

        def ask(text: str | None) -> tuple[str | None, int, int, int]:
            tokens = 0
            if text is None:
                return None, 0, 0, tokens
            for k in range(tries):
                pace.wait()
                try:
                    got = model(system, text)
                    reply = got if isinstance(got, tuple) else Reply(got)
                    tokens += reply[1]
                    if reply[0] is not None:
                        return reply[0], k + 1, k, tokens
                except Exception:  # noqa: BLE001 - any failure of a remote model is one more try
                    pass
                if k + 1 < tries and wait:
                    time.sleep(wait * 2**k)
            return None, tries, tries, tokens

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(ask, pdf[prompt]))
                yield pdf.assign(**{c: [g[i] for g in got] for i, c in enumerate(("output", "calls", "failures", "tokens"))})

    kind = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", output string, calls int, failures int, tokens bigint"
    return (df.repartition(workers) if workers else df).mapInPandas(run, kind)


def call_statistics(df: DataFrame) -> DataFrame:
    """One row: rows, calls, failed calls, rows with an output, tokens, success rate of the calls."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    s = df.agg(F.count("*").alias("n_rows"), total("calls"), total("failures"), F.count("output").alias("n_output"), total("tokens"))
    return s.withColumn("success_rate", F.coalesce(F.try_divide(F.col("calls") - F.col("failures"), F.col("calls")), F.lit(0.0)))


def failed_rows(df: DataFrame) -> DataFrame:
    return df.filter("output is null")
