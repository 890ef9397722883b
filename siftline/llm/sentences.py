"""Problem 10: sentence units across languages and scripts, by semi-Markov dynamic programming.

A document is divided into blocks by its layout: fenced code, headings, list entries, quoted
lines, paragraphs; lines that were merely wrapped stay together. In each block every place where
a sentence might end is a candidate. A span between two candidates is scored as a whole: by its
length, the word that opens it, the words and marks that close it, and the quotations and brackets
that it does not hold whole. One that is never closed in the block binds nothing. The best
sequence of spans is the block's sentences; any span may be one, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.session import spread

#: a line break is a wrap if the next word had made the line longer than this
WRAP_WIDTH = 66
#: what a span loses for each quotation or bracket that is cut at one of its ends
UNBALANCED = 2.0
#: the usual length of a sentence; what a span loses grows with the square of the logarithm of its
#: share of it, and beyond LONG code points in proportion to what is over
USUAL, LENGTH_WEIGHT, LONG, LONG_STEP = 60, 0.05, 400, 300.0

# Abbreviations that do not end a sentence, and those that may.
NEVER_ENDS = [
    r"e\.\s*g", r"i\.\s*e", r"vs", r"approx", r"figs?", r"sect", r"sec", r"acc", r"cf", r"mr", r"mrs", r"dr", r"prof", r"vol", r"pp", r"ed",
    r"z\.\s*b", r"d\.\s*h", r"u\.\s*a", r"ca", r"nr", r"abb", r"bzw", r"vgl", r"ggf", r"evtl", r"inkl", r"zzgl", r"sog",
    r"p\.\s*ex", r"env", r"p\.\s*ej", r"núm", r"aprox", r"pág", r"art",
    r"т\.\s*е", r"рис", r"ок", r"см", r"стр", r"напр", r"гл",
]
MAY_END = [r"etc", r"usw", r"a\.\s*m", r"p\.\s*m", r"u\.\s*s", r"u\.\s*k", r"и\s+т\.\s*д", r"и\s+т\.\s*п", r"и\s+др", r"al", r"inc", r"ltd", r"u\.\s*s\.\s*w"]
ORDINAL_NOUNS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Mal Jahrhundert Stock Tag Lauf Versuch Woche".split()

# before the abbreviations are tried: a short word with a full stop behind it
_SHORT = r"(?<![^\W\d_])(?=[^\W\d_]{1,6}\.)"
_NEVER = re.compile("(?i)" + _SHORT + r"(?:(?:" + "|".join(NEVER_ENDS) + r")\.|no\.(?=\s*\d))")
_MAY = re.compile("(?i)" + _SHORT.replace(r"\.)", r"\.|и\s)") + "(?:" + "|".join(MAY_END) + r")\.")
_ORDINAL = re.compile(r"(?<![\w.,])\d{1,3}\.(?=\s+(?:" + "|".join(ORDINAL_NOUNS) + r")\b)")
_INITIAL = re.compile(r"(?<![\w.])[^\W\d_]\.(?=\s)")
_BLANK = " \t\r\n\f\v 　​﻿  ‎‏⁠"
_SPACES = f"[{_BLANK}]"
_EVENT = re.compile(r"[.!?…。！？．।॥]+|[„“”«»「」『』（）()\"]")
_THAI = re.compile(r"[฀-๿]")
_GAP = re.compile(_SPACES + "+")
_TOKEN = re.compile(r"[^\W_][\w]*")
_PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "«": "»", "„": "“", "“": "”"}
_CLOSE = set(_PAIRS.values()) | {'"'}
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]")
_QUOTED = re.compile(r"[ \t]*>")
_ENTRY = re.compile(r"[ \t]*(?:[-*•‣·+–][ \t ​]+|\(?\d{1,3}[.)、][ \t ​]+)")
_UNSPACED = re.compile(r"[฀-๿ぁ-ヿ㐀-鿿]")
# Chinese and Japanese words that go on after a closed quotation.
_GOES_ON = ("之后", "以后", "后", "的", "就", "并", "而", "，", "、", "；", "：", ",")


_LENGTH = [0.0] + [-LENGTH_WEIGHT * math.log(n / USUAL) ** 2 - (2.4 if n < 4 else 0.0) for n in range(1, LONG + 1)]


def _visible_end(text: str, end: int, start: int) -> int:
    while end > start and text[end - 1] in _BLANK:
        end -= 1
    return end


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of each layout block; a whole block is one unit."""
    n, at = len(text), 0
    start = -1  # of the open paragraph or entry
    last = (0, 0)
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        a = at
        while a < stop and text[a] in "﻿​":
            a += 1
        line_end = _visible_end(text, stop, a)
        m_fence = _FENCE.match(text, a, stop)
        if m_fence:
            if start >= 0:
                yield start, last[1], False
                start = -1
            mark, close = m_fence.group(1), stop
            while close < n:
                nxt = text.find("\n", close + 1)
                nxt = n if nxt < 0 else nxt
                if text[close + 1 : nxt].strip(_BLANK).startswith(mark):
                    close = nxt
                    break
                close = nxt
            yield a, close, True
            at = close + 1
            continue
        kind = ""
        if line_end == a or not text[a:line_end].strip(_BLANK):
            kind = "blank"
        elif _HEADING.match(text, a, stop):
            kind = "heading"
        elif _QUOTED.match(text, a, stop):
            kind = "quoted"
        elif _ENTRY.match(text, a, stop):
            kind = "entry"
        if kind:
            if start >= 0:
                yield start, last[1], False
                start = -1
            if kind == "heading":
                yield a, line_end, True
            elif kind == "quoted":
                m = _QUOTED.match(text, a, stop)
                yield m.end(), line_end, False
            elif kind == "entry":
                start = _ENTRY.match(text, a, stop).end()
                if start >= line_end:  # a marker without content is its own unit
                    start = a
                last = (a, line_end)
        elif start < 0:
            start, last = a, (a, line_end)
        else:
            if not _wrapped(text, last, (a, line_end)):
                yield start, last[1], False
                start = a
            last = (a, line_end)
        at = stop + 1
    if start >= 0:
        yield start, last[1], False


def _wrapped(text: str, before: tuple[int, int], after: tuple[int, int]) -> bool:
    """Whether the break between two plain lines is a mere wrap."""
    left, right = text[before[1] - 1], text[after[0]]
    if _UNSPACED.match(left) or _UNSPACED.match(right):
        return False
    if left in "。！？":
        return False
    gap = _GAP.search(text, after[0], after[1])
    word = (gap.start() if gap else after[1]) - after[0]
    return before[1] - before[0] + 1 + word > WRAP_WIDTH


def _opens(s: str, at: int, mark: str) -> float:
    """How well the text at ``at`` opens a sentence."""
    ch = s[at]
    if ch in "¿¡«“„「『":
        return 1.0
    if ch in "(（":
        return -3.0
    if ch in ",，、;；:：":
        return -6.0
    m = _TOKEN.match(s, at)
    if not m:
        return 0.0
    word = m.group(0)
    first = word[0]
    if first.isdigit():
        return -0.5
    if first.isupper():
        return 1.5
    if first.islower():
        name = any(c.isupper() or c.isdigit() or c == "_" for c in word) or s[m.end() : m.end() + 1] in ("_", "-")
        return 0.5 if name else -1.5
    return 0.5  # a script without case


def sentence_ends(s: str) -> list[int]:
    """Ends of the sentences of one block."""
    n = len(s)
    thai = 0 if s.isascii() else len(_THAI.findall(s))
    thai = thai >= 5 and thai * 4 >= n
    never: set[int] = set()
    may: set[int] = set()
    if "." in s:
        for m in _MAY.finditer(s):
            may.add(m.end())
            never.update(i + 1 for i in range(m.start(), m.end() - 1) if s[i] == ".")
        for m in _NEVER.finditer(s):
            if m.end() not in may:
                never.update(i + 1 for i in range(m.start(), m.end()) if s[i] == ".")
        for m in _ORDINAL.finditer(s):
            never.add(m.end())
    # place, closing score, opening score of what follows, the quotations that are open there
    cand: list[tuple[int, float, float, tuple[int, ...]]] = []
    stack: list[str] = []
    begun: list[int] = []  # where those of the stack begin
    whole: set[int] = set()  # quotations that are closed, too
    skip = -1
    for e in _EVENT.finditer(s):
        if e.start() < skip:
            continue
        g = e.group(0)
        if len(g) == 1 and g in "„“”«»「」『』（）()\"":
            if stack and g == stack[-1]:
                stack.pop()
                whole.add(begun.pop())
            elif g == '"' or g in _PAIRS:
                stack.append(_PAIRS.get(g, g))
                begun.append(e.start())
            elif g in stack:
                k = stack.index(g)
                whole.add(begun[k])
                del stack[k:], begun[k:]
            continue
        pos, quoted = e.end(), False
        while stack and pos < n:
            if s[pos] == stack[-1]:
                pos += 1
            elif s[pos] in "   " and pos + 1 < n and s[pos + 1] == stack[-1] == "»":
                pos += 2
            else:
                break
            quoted |= stack[-1] not in ")）"
            stack.pop()
            whole.add(begun.pop())
        stars = pos  # emphasis marks close with the sentence
        while stars < n and s[stars] == "*":
            stars += 1
        if stars > pos and (stars >= n or s[stars] in _BLANK):
            pos = stars
        skip = pos
        if pos >= n:
            break
        wide = g[-1] in "。！？．।॥"
        if not wide and s[pos] not in _BLANK and not (g[-1] in "!?…" and _UNSPACED.match(s[pos])):
            continue
        gap = _GAP.match(s, pos)
        nxt = gap.end() if gap else pos
        if nxt >= n:
            break
        score = 0.0
        if g[-1] in "。！？।॥．":
            score += 2.5
            if quoted and not gap:
                follows = s[nxt : nxt + 2]
                if g[-1] != "。" or follows.startswith(_GOES_ON) or "ぁ" <= s[nxt] <= "ゖ":
                    score -= 6
        elif "…" in g or g.startswith(".."):
            score -= 2.0
        elif g[-1] in "!?":
            score += 2.0
            if quoted:
                score -= 3.0 if s[nxt].isupper() else 6.0
        else:
            dot = e.end()
            last = s[dot - 2] if dot > 1 else ""
            if dot in never:
                score -= 8
            elif dot in may:
                score -= 0.5 if s[nxt].isupper() else 4.0
            elif _single(s, dot - 1):
                score -= 6
            else:
                score += 1.6 if dot > 2 and not last.isdigit() else 1.2
                if quoted and not s[nxt].isupper() and not _named(s, nxt):
                    score -= 4
                if last.isdigit() and s[nxt].islower() and not _named(s, nxt):
                    score -= 3
        cand.append((pos, score, _opens(s, nxt, g), tuple(begun)))
    if thai:
        taken = {c[0] for c in cand}
        for m in _GAP.finditer(s):
            if 0 < m.start() and m.end() < n and m.start() not in taken and s[m.start() - 1] not in "。！？.!?…(（," and s[m.end()] not in ")）":
                sides = bool(_THAI.match(s[m.start() - 1])) + bool(_THAI.match(s[m.end()])) + (s[m.start() - 1].isdigit())
                cand.append((m.start(), 1.5 * sides - 1.0, -4.0 if s[m.end()] in "(（" else 0.0, ()))
        cand.sort()
    return best_spans([(p, c, o, sum(q in whole for q in open_)) for p, c, o, open_ in cand], n)


def best_spans(cand: list[tuple[int, float, float, int]], n: int) -> list[int]:
    """Ends of the spans of the best sequence over a block of ``n`` code points. A candidate has
    its place, closing score, opening score of what follows and the number of quotations it cuts. Spans up to
    ``LONG`` are tried one by one; of the longer ones, whose loss by length is linear, only the best
    beginning is kept, so that the time is linear in the block's length."""
    if not cand:
        return [n]
    place = [0, *[c[0] for c in cand], n]
    left = [0.0, *[c[2] - UNBALANCED * c[3] for c in cand], 0.0]  # what a span that begins here has
    right = [0.0, *[c[1] - UNBALANCED * c[3] for c in cand], 0.0]  # and one that ends here
    best, back = [0.0], [0]
    near, far, far_at = 0, -1e18, 0  # beginnings before ``near`` are far
    for j in range(1, len(place)):
        end = place[j]
        while end - place[near] > LONG:
            v = best[near] + left[near] + place[near] / LONG_STEP
            if v > far:
                far, far_at = v, near
            near += 1
        top, arg = far + _LENGTH[LONG] + (LONG - end) / LONG_STEP, far_at
        for i in range(near, j):
            v = best[i] + left[i] + _LENGTH[end - place[i]]
            if v > top:
                top, arg = v, i
        best.append(top + right[j])
        back.append(arg)
    ends, j = [], len(place) - 1
    while j > 0:
        ends.append(place[j])
        j = back[j]
    return ends[::-1]


def _named(s: str, at: int) -> bool:
    m = _TOKEN.match(s, at)
    return bool(m) and (any(c.isupper() or c.isdigit() or c == "_" for c in m.group(0)) or s[m.end() : m.end() + 1] in ("_", "-"))


def _single(s: str, end: int) -> bool:
    """Whether one letter stands before the full stop at ``end``, other than a unit behind a number."""
    if not end or not s[end - 1].isalpha():
        return False
    at = end - 2
    if at >= 0 and (s[at].isalnum() or s[at] in "_.)"):
        return False
    while at >= 0 and s[at] in _BLANK:
        at -= 1
    return not (at >= 0 and s[at].isdecimal())


def sentence_units(text: str) -> list[int]:
    """Code points of ``text`` up to and including the last visible one of each unit, ascending.
    A blank text has none."""
    out = []
    for a, b, whole in blocks(text):
        ends = [b] if whole else [a + x for x in sentence_ends(text[a:b])]
        start = a
        for e in ends:
            v = _visible_end(text, e, start)
            if v > start and text[start:v].strip(_BLANK):
                out.append(v)
            start = e
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, start_pos, end_pos): the sentence units of every row, numbered from 0; the text
    from ``start_pos`` to ``end_pos`` (code points, the first one excluded) holds the unit and the
    blanks and markers before it.

    Null, empty and blank texts have no units. Repeated rows are divided alike; texts of any
    length are divided block by block; other columns are not read."""
    kind = f"{key} {df.schema[key].dataType.simpleString()}, unit int, start_pos int, end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, unit, starts, ends = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                found = sentence_units(t)
                rows += [i] * len(found)
                unit += range(len(found))
                starts += [0, *found[:-1]] if found else []
                ends += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(np.array(x, np.int32)) for x in (unit, starts, ends)]], names=[key, "unit", "start_pos", "end_pos"])

    return spread(df.select(key, text)).mapInArrow(run, kind)
