"""Verdicts and categories: from model text, from labels, and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.labels import LABEL_NAMES
from siftline.functions.numbers import fixed

YES, NO = "是", "否"
# The two answer patterns; the first one wins wherever it stands.
ANSWER_PATTERNS = [
    r"答案[：:]\s*(是|否)\s*[-–—]\s*(\w+[-\w]*)",
    r"Answer[：:]\s*(Yes|No|是|否)\s*[-–—]\s*(\w+[-\w]*)",
]


def extract_answer(text: Column) -> Column:
    """struct(is_flaky, category) of the leftmost match of the first pattern that matches; both
    null where none does or the text is null. Words are Unicode words, case is ignored."""
    found = [[F.nullif(F.regexp_extract(text, f"(?iU){p}", g), F.lit("")) for g in (1, 2)] for p in ANSWER_PATTERNS]
    verdict = F.lower(F.coalesce(*[f[0] for f in found]))
    return F.struct(
        F.when(verdict.isin("yes", YES), YES).when(verdict.isin("no", NO), NO).alias("is_flaky"),
        F.coalesce(*[f[1] for f in found]).alias("category"),
    )


def normalize_category(category: Column) -> Column:
    """The known name of a category, ignoring case; another value unchanged; null or empty: Unknown."""
    known = F.create_map(*[F.lit(x) for kv in LABEL_NAMES.items() for x in kv])
    return F.when(category.isNull() | (category == ""), "Unknown").otherwise(F.coalesce(F.element_at(known, F.upper(category)), category))


def truth_verdict(label: Column) -> Column:
    """是 unless the trimmed label is non-flaky in one of two spellings; a null label is the text nan."""
    bare = F.lower(F.trim(F.coalesce(label, F.lit("nan"))))
    return F.when(bare.isin("non-flaky", "nonflaky"), NO).otherwise(YES)


def truth_category(label: Column) -> Column:
    bare = F.lower(F.trim(F.coalesce(label, F.lit("nan"))))
    return F.when(bare.isin("non-flaky", "nonflaky"), "Non-Flaky").otherwise(normalize_category(bare))


def format_percentage(value: Column, decimals: int = 2) -> Column:
    return F.concat(fixed(value * 100, decimals), F.lit("%"))
