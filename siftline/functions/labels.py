"""Label vocabulary: known label names and the category each stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known label names and their categories, in report order of the categories.
LABEL_NAMES = {
    "ASYNC": "Async",
    "ASYNC WAIT": "Async",
    "ASYNC.": "Async",
    "CONC": "Conc",
    "CONC.": "Conc",
    "CONCURRENCY": "Conc",
    "TIME": "Time",
    "TIME.": "Time",
    "UC": "UC",
    "UNORDERED COLLECTIONS": "UC",
    "UNORDERED COLLECTION": "UC",
    "OD": "OD",
    "ORDER DEPENDENCY": "OD",
    "TEST ORDER DEPENDENCY": "OD",
    "NON-FLAKY": "Non-Flaky",
    "NONFLAKY": "Non-Flaky",
    "NON FLAKY": "Non-Flaky",
}
CATEGORIES = ["Async", "Conc", "Time", "UC", "OD", "Non-Flaky"]


def letters_and_digits(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def label_category(c: Column) -> Column:
    """Category of a label whose spelling differs from a known name only in case, spacing or
    punctuation; null for every other value, nulls and blanks included."""
    known = {"".join(ch for ch in k if ch.isalnum()).lower(): v for k, v in LABEL_NAMES.items()}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.element_at(F.create_map(*pairs), letters_and_digits(c))


def project_key(c: Column) -> Column:
    """What is left of a project name without case, blanks, separators and a version-control suffix."""
    bare = F.regexp_replace(F.lower(c), r"[.](git|hg|svn|bzr|cvs)[^\p{L}\p{N}]*$", "")
    return letters_and_digits(bare)
