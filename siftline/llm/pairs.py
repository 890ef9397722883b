"""Problem 4: prompt and response pairs with a defect.

Every response gets its facts in one scan: what is visible of it, how much of it stands in its
prompt, the languages of both, whether it reaches a verdict, and its opening (the first sentence's
last clause, with names, identifiers and numbers as ``X``). Openings are clustered by
Jaccard similarity, all pairs that can be alike being compared. A cluster whose openings recur over unrelated prompts and hardly ever lead
to a verdict, in the prompts' own language, is a template of refusal. Copy, language and
termination checks label the other defects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.textscan import Words, chunks, mix
from siftline.llm.truncation import IDENTIFIER, cut_off
from siftline.llm.wordsets import block_pairs, is_in
from siftline.llm.graph import connected_components
from siftline.session import cut, spread

#: a response is a copy from this share of its words in the prompt
COPIED = 0.85
#: openings of one cluster share this much of their word pairs
OPENING_LIKE = 0.5
#: openings with a word pair in common that are joined at once; more go block by block, all pairs
BLOCK = 1024
#: a template recurs over at least so many prompts, and at most this share of its responses has a verdict
PROMPTS = 2
VERDICT_SHARE = 0.2

_TAG = re.compile(r"</?[A-Za-z]+>")
_FENCE = re.compile(r"(?s)```.*?(?:```|$)")
_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"[\"“„«「][^\"”“»」\n]*[\"”“»」]")
_IDENT = re.compile(IDENTIFIER)
_VERDICT_LINE = re.compile(r"(?im)^[\s*#]*(?:答案|answer)\s*[：:].*$")
_VERDICT = re.compile(r"(?i)(?:答案|answer)\s*[：:]\s*(?:是|否|yes|no)\s*[-–—]\s*\w+")
_VISIBLE = re.compile(r"[^\s​-‏⁠﻿­]")
_SENTENCE = re.compile(r".+?(?:[。！？!?…]+|\.(?=\s|$)|\n|$)")
_HEADING = re.compile(r"^\s*(?:#+\s*\S.*\n|[-*•]\s+)+")
_NAME = re.compile(r"(?<![^\W_])[^\W_]+(?:[-_/.＿][^\W_]+)+")
_LATIN = re.compile(r"[a-zà-öø-ÿœ']+")
_ASCII = re.compile(r"[\x00-\x7f]+")
_SCRIPTS = {
    "kana": re.compile(r"[ぁ-ヿ]"), "han": re.compile(r"[㐀-鿿]"), "ko": re.compile(r"[가-힣]"),
    "ru": re.compile(r"[Ѐ-ԯ]"), "th": re.compile(r"[฀-๿]"), "hi": re.compile(r"[ऀ-ॿ]"),
}
_BRACKETED = re.compile(r"【[^】\n]*】|\[[^\]\n]*\]")
_CODE_START = re.compile(r"(?m)^\s*(?:@\w+|public |private |protected )")
# Common words by which the Latin languages are told apart.
STOP_WORDS = {
    "en": "the and of to in is it that for on with as was are be by this no not from at which or an its when so after only any every",
    "de": "der die das und ist nicht ein eine den dem des zu mit auf für von sich auch nach bei wird dass im am nur noch war einen nirgends",
    "fr": "le la les et est pas un une des du de que qui dans pour sur avec au aux ne se sans il elle par ce cette fois plus deux",
    "es": "el la los las y es no un una de que en por con para se su al del como pero más sin cada vez si dos",
}
_STOP = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}


def prose_language(text: str) -> str:
    """Language of prose without code: zh, ja, ko, ru, th, hi, en, de, fr, es, or "" if too little
    is left to tell."""
    n = dict.fromkeys(_SCRIPTS, 0)
    if not text.isascii():
        high = _ASCII.sub("", text)
        for k, p in _SCRIPTS.items():
            if n["han"] + n["kana"] <= len(high) // 2:
                n[k] = len(p.findall(high))
    latin = _LATIN.findall(text.lower())
    score = {"ko": n["ko"], "ru": n["ru"] / 2.5, "th": n["th"] / 2, "hi": n["hi"] / 2}
    score["ja" if n["kana"] * 6 > n["han"] else "zh"] = n["han"] + n["kana"]
    best = max(score, key=lambda k: score[k])
    if score[best] >= max(2, 0.8 * len(latin)):
        return best
    if len(latin) < 3:
        return ""
    hits = {k: sum(map(s.__contains__, latin)) for k, s in _STOP.items()}
    top = max(hits, key=lambda k: (hits[k], k == "en"))
    return top if hits[top] else "en"


def _prose(text: str) -> str:
    if "`" in text:
        text = _SPAN.sub(" ", _FENCE.sub(" ", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _IDENT.sub(" ", _QUOTED.sub(" ", _VERDICT_LINE.sub(" ", text)))


def prompt_language(prompt: str) -> str:
    """Language of what stands around the code of a prompt; where that is only a bracketed name,
    wide brackets count as Chinese and others as English."""
    m = _CODE_START.search(prompt)
    head = prompt[: m.start()] if m else prompt
    tail = prompt[prompt.rfind("}") + 1 :] if m else ""
    around = _IDENT.sub(" ", _BRACKETED.sub(lambda b: b.group()[0], head) + " " + tail)
    if any(0x3000 <= ord(c) < 0xA000 or 0xFF00 <= ord(c) < 0xFFF0 for c in around):
        return prose_language(around) or "zh"
    return prose_language(around) or "en"


def prompt_names(prompt: str) -> set[str]:
    """Words of the compound names before the code of a prompt."""
    m = _CODE_START.search(prompt)
    head = prompt[: m.start()] if m else prompt
    return {w for name in _NAME.findall(head) for w in re.findall(r"[^\W_]+", name)}


def opening(text: str, names: set[str]) -> str:
    """The last clause of the first sentence of what is visible, in lower case, with identifiers,
    numbers and the prompt's names as X. Courtesies stand in the clauses before it."""
    body = _HEADING.sub("", _TAG.sub("\n", text).lstrip()).strip()
    m = _SENTENCE.match(body)
    clauses = [c for c in re.split(r"[,，、;；:：]\s*", _IDENT.sub("X", m.group(0) if m else "")) if re.search(r"\w", c)]
    first = clauses[-1] if clauses else ""
    return " ".join("x" if w in names else w.lower() for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", re.sub(r"([㐀-鿿ぁ-ヿ])", r" \1 ", first)))


FACTS = "prompt_key bigint, empty boolean, copied double, prompt_lang string, lang string, verdict boolean, opening string"


def response_facts(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, FACTS) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, prompts in chunks(b.column(1).to_pylist()):
                texts = [t or "" for t in b.column(2).slice(at, len(prompts)).to_pylist()]
                plain = [_TAG.sub(" ", t) for t in texts]
                both = [Words([p.lower() for p in prompts]), Words([_VERDICT_LINE.sub(" ", t).lower() for t in plain])]
                keys = [w.hash ^ mix(w.doc.astype(np.uint64)) for w in both]
                own = np.bincount(both[1].doc, minlength=len(texts))
                copied = np.bincount(both[1].doc, is_in(keys[1], np.sort(keys[0])), len(texts)) / np.maximum(own, 1)
                pre = np.concatenate([[np.uint64(0)], np.cumsum(both[0].hash)])
                prompt_key = (pre[both[0].at[1:]] - pre[both[0].at[:-1]]).view(np.int64)
                rows = []
                for p, t, s in zip(prompts, texts, plain):
                    rows.append((not _VISIBLE.search(s), prompt_language(p), prose_language(_prose(t)), bool(_VERDICT.search(t)), opening(t, prompt_names(p))))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(prompts)), pa.array(prompt_key), pa.array(cols[0], pa.bool_()), pa.array(copied), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.string(), pa.bool_(), pa.string()))]],
                    names=[key, *(f.split()[0] for f in FACTS.split(", "))],
                )

    kind = f"{key} {df.schema[key].dataType.simpleString()}, {FACTS}"
    return spread(df.select(key, prompt, response)).mapInArrow(run, kind)


def _shingles(text: str) -> list[int]:
    w = ["^", *text.split(), "$"]
    return [_hash(x) for x in sorted({f"{a} {b}" for a, b in zip(w, w[1:])})]


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) of distinct openings: two with Jaccard similarity of word pairs of at
    least ``OPENING_LIKE`` share one of their first word pairs, rare ones first (prefix filter), so
    these are the candidates, large buckets block by block; connected components are clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.array(_shingles(t), np.uint64).view(np.int64).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["opening", "shingles"])

    signed = cut(openings.select("opening").mapInArrow(run, "opening string, shingles array<bigint>").withColumn("node", F.xxhash64("opening")), "openings")
    sets = signed.select("node", "shingles")
    rows = sets.select("node", F.explode("shingles").alias("key"))
    ranked = rows.join(rows.groupBy("key").agg(F.count("*").alias("m")), "key")
    order = F.array_sort(F.collect_list(F.struct("m", "key")))
    # alike sets share OPENING_LIKE of the larger one at least
    size = F.size("order")
    first = F.slice("order", 1, size - F.ceil(F.lit(OPENING_LIKE) * size).cast("int") + 1)
    first = ranked.groupBy("node").agg(order.alias("order")).select(F.col("node").alias("id"), size.alias("n"), F.posexplode(first).alias("at", "e"))
    left = lambda x: x["n"] - x["at"]
    rows = cut(first.filter("e.m > 1").select("id", "n", "at", F.col("e.key").alias("key")), "first")
    pairs = block_pairs(rows, BLOCK, lambda x, y: F.least(left(x), left(y)) >= F.lit(OPENING_LIKE) * F.greatest(x["n"], y["n"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    links = cut(both.filter(F.size(F.array_intersect("sa", "sb")) >= OPENING_LIKE * F.size(F.array_union("sa", "sb"))).select("a", "b"), "links")
    comp = connected_components(links)
    return signed.select("opening", "node").join(comp, "node", "left").select("opening", F.coalesce("comp", "node").alias("cluster"))


def defective_pairs(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, defect) of every row, null where none: the first that holds of ``empty`` (null, or
    nothing visible beside tags), ``copy``, ``refusal``, ``wrong_language``, ``truncated``.

    A null or blank prompt is never copied and its language counts as English. Rows delivered
    again are judged alike; other columns are not read."""
    facts = cut(response_facts(df, key, prompt, response), "facts")
    fits = F.col("prompt_lang") == F.col("lang")
    # the openings' own counts come first, so that clustering sees each distinct opening once
    per = facts.filter(~F.col("empty") & ((F.col("copied") < COPIED) | F.col("verdict")) & (F.col("opening") != "")).groupBy("opening").agg(
        F.count("*").alias("n"),
        F.count_if("verdict").alias("verdicts"),
        F.count_if(fits | (F.col("lang") == "")).alias("fitting"),
        F.countDistinct("prompt_key").alias("prompts"),
    )
    per = cut(per, "openings")
    named = cut(per.join(opening_clusters(per), "opening"), "clusters")
    judged = named.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "verdicts", "fitting", "prompts")])
    refusing = judged.filter((F.col("prompts") >= PROMPTS) & (F.col("verdicts") <= VERDICT_SHARE * F.col("n")) & (F.col("fitting") >= 0.5 * F.col("n"))).select("cluster")
    templates = named.join(refusing, "cluster", "left_semi").select("opening", F.lit(True).alias("refusing"))
    ends = cut_off(df, key, response, prompt).groupBy(key).agg(F.max("cut").alias("cut"))
    known = facts.join(templates, "opening", "left").join(ends, key, "left")
    defect = (
        F.when(F.col("empty"), "empty")
        .when((F.col("copied") >= COPIED) & ~F.col("verdict"), "copy")
        .when(F.col("refusing") & ~F.col("verdict"), "refusal")
        .when(~fits & (F.col("lang") != ""), "wrong_language")
        .when(F.col("cut"), "truncated")
    )
    return known.select(key, defect.alias("defect"))
