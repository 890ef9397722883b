"""Problem 2: texts that were cut off, by counting word trigrams inside sentences and at ends.

All in SQL expressions. Texts become tokens: words (a Han character is a word; identifiers and
numbers are all the one word ``X``), sentence marks, line ends and tags. Of each trigram of words
the corpus tells how often it goes on, how often a mark follows and how often the line ends
without one. The last trigram of a text is joined with these counts: a text that stops where the
corpus nearly always goes on was cut, whatever mark or tag was put behind the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import cut, spread

#: a trigram counts as inner from so many occurrences, at most TERMINAL_SHARE of them at an end
INNER_LEAST = 8
TERMINAL_SHARE = 0.04
#: at ends, a mark is expected where at least this share of a trigram's ends has one
MARKED_SHARE = 0.5
# Verdict lines, whole.
VERDICT_HEADS = ["答案", "Answer"]
VERDICT_WORDS = ["是", "否", "Yes", "No"]
VERDICT_KINDS = ["Async", "Conc", "Time", "UC", "OD", "Non-Flaky"]
VERDICT = r"(?i)^(答案|answer)\s*[：:]\s*(是|否|yes|no)\s*[-–—]\s*(async|conc|time|uc|od|non-flaky)\b"

TAG = r"</?[A-Za-z]+>"
CLOSERS = r"(?:[\s*\x{200b}\x{feff}]|" + TAG + r")++$"
CLOSING = [" ", "\t", "\n", "\x0b", "\f", "\r", "*", "\u200b", "\ufeff", ">"]
MARKS = r".!?。！？…"
#: an identifier has an inner capital, a digit or an underscore
IDENTIFIER = r"(?<![A-Za-z0-9_$])[A-Z$]*+[a-z$]*+[A-Z0-9_][A-Za-z0-9_$]*+(?:\.[A-Za-z0-9_$]++)*+(?:\(\))?"
HAN = r"\u3400-\u9fff\uf900-\ufaff"
# frequent kinds first: a Han character, a word (ASCII runs of it at once), a mark, a line end, a tag
TOKEN = "[" + HAN + r"]|(?:[A-Za-z0-9]++|[\p{L}\p{M}\p{N}&&[^" + HAN + "]])++|[" + MARKS + r"]++|\n\s*+|<"
#: tokens at the end of a text among which its last words are looked for first, then among all
LAST_TOKENS = 16
#: stands before a text's first word, so that short texts have trigrams, too
START = "^"
#: places of the table that tells which word pairs end a text; it is broadcast, so it never grows
PAIR_PLACES = 1 << 20


def _plain(text: Column) -> Column:
    """Text without fenced code, with spans of code and identifiers as the word X."""
    # a text without the first sign of a pattern is not searched for it
    t = F.when(text.contains("```"), F.regexp_replace(text, r"(?s)```.*?(```|$)", "\n")).otherwise(text)
    t = F.when(t.contains("`"), F.regexp_replace(t, r"`[^`\n]*`", " X ")).otherwise(t)
    t = F.when(t.contains("<"), F.regexp_replace(t, TAG, "\n<")).otherwise(t)
    return F.regexp_replace(t, IDENTIFIER, " X ")


def _last_line(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(body, "\n", -1), r"^[\s*#\-•>]+|^\d+[.)]\s+", ""))


def _is_mark(t: Column) -> Column:
    return F.substring(t, 1, 1).isin(*MARKS)


def _is_end(t: Column) -> Column:
    return F.substring(t, 1, 1).isin("<", "\n")


def _is_word(t: Column) -> Column:
    return ~F.substring(t, 1, 1).isin("<", "\n", *MARKS)


def _pair_place(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(PAIR_PLACES))


def ending_counts(tokens: DataFrame, tails: DataFrame) -> DataFrame:
    """(v1, v2, w1, w2, w3, inner, marked, bare) over all texts: how often each trigram of words
    w1 w2 w3, after the two tokens v1 v2, goes on with a word, is followed by a mark, or ends its
    line or text without one. Counted are all trigrams whose first two words are those of one of
    the last trigrams ``tails``, as no other count is looked up (and some more, where two word pairs share a
    place)."""
    padded = F.concat(F.array(*[F.lit(START)] * 4), F.col("tokens"), F.array(F.lit("\n")))
    n = F.size("tokens")
    names = ("v1", "v2", "w1", "w2", "w3", "nxt")
    # slices side by side stay in generated code, unlike a function for each place
    rows = tokens.select(F.inline(F.arrays_zip(*[F.slice(padded, k + 1, n).alias(c) for k, c in enumerate(names)])).alias(*names))
    rows = rows.filter(_is_word(F.col("w1")) & _is_word(F.col("w2")) & _is_word(F.col("w3")))
    ends = tails.select(_pair_place(F.col("w1"), F.col("w2")).alias("place")).distinct()
    # at most PAIR_PLACES rows
    rows = rows.withColumn("place", _pair_place(F.col("w1"), F.col("w2"))).join(F.broadcast(ends), "place", "left_semi")
    kind = F.when(_is_mark(F.col("nxt")), "marked").when(_is_end(F.col("nxt")), "bare").otherwise("inner")
    return rows.groupBy("v1", "v2", "w1", "w2", "w3").agg(*[F.sum(F.when(kind == k, 1).otherwise(0)).alias(k) for k in ("inner", "marked", "bare")])


def cut_off(df: DataFrame, key: str, text: str, prompt: str) -> DataFrame:
    """(key, cut, reason) of every row. Reasons of cut texts: ``sentence`` (the last trigram nearly
    always goes on) and ``word`` (the last word is the beginning of one that often stands in its place, or of
    a name of the prompt), else the first that holds of ``bytes`` (ends in a broken character), ``tag``
    (an element was never closed, or the text ends inside a tag), ``verdict`` (ends inside a
    verdict line), ``quote`` (ends inside a quotation or code span), ``mark`` (the last
    trigram nearly always takes a mark and here has none).

    Null and blank texts are not cut, texts without a word are judged by tags and quotes. Repeated rows are judged alike. ``prompt`` (null: none) is only searched for
    the identifier that the text's last word may be the beginning of."""
    base = spread(df.select(key, *{text, prompt})).select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(prompt, F.lit("")).alias("_prompt"))
    t = base.withColumn("body", F.when(F.right("_text", F.lit(1)).isin(CLOSING), F.regexp_replace("_text", CLOSERS, "")).otherwise(F.col("_text"))).withColumn("line", _last_line(F.col("body")))
    t = t.withColumn("last", F.regexp_extract("line", r"(?<![A-Za-z0-9_$])([A-Za-z0-9_$]++)[" + MARKS + r"]*+$", 1))
    last = F.col("last")
    # only an identifier can be the beginning of another one, so few prompts are searched
    at = lambda rest: F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), last, F.lit(r"\E" + rest))
    begun_name = F.when((F.length(last) > 3) & last.rlike("[a-z][A-Z]|[0-9]"), F.regexp("_prompt", at("[A-Za-z0-9_$]")) & ~F.regexp("_prompt", at("(?![A-Za-z0-9_$])"))).otherwise(False)
    verdicts = F.array(*[F.lit(f"{h}{c}{w} - {k}") for h in VERDICT_HEADS for c in ("：", ": ") for w in VERDICT_WORDS for k in VERDICT_KINDS])
    bare_line = F.regexp_replace("line", r"[\s*" + MARKS + r"]+$", "")
    whole_verdict = F.col("line").rlike(VERDICT)
    begun_verdict = F.when(bare_line.rlike("^[" + "".join(h[0] for h in VERDICT_HEADS) + "]") & ~whole_verdict, F.exists(verdicts, lambda v: v.startswith(bare_line) & (v != bare_line))).otherwise(False)
    code_end = F.col("body").endswith("```") | F.right("body", F.lit(1)).isin(";", "{", "}")
    found = lambda p: F.when(F.col("_text").contains("<"), F.array_distinct(F.regexp_extract_all("_text", F.lit(p), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    opened = found("<([A-Za-z]+)>")
    odd = lambda ch: (F.length("line") - F.length(F.replace("line", F.lit(ch), F.lit("")))) % 2 == 1
    t = t.select(
        "_key",
        F.regexp_extract_all(_plain(F.col("body")), F.lit(TOKEN), F.lit(0)).alias("tokens"),
        F.col("line").rlike("[" + MARKS + r"][\"”’»」)）]*\z").alias("has_mark"),
        whole_verdict.alias("whole_verdict"),
        code_end.alias("code_end"),
        F.col("line").rlike(r"(…|\.\.\.)\z").alias("dots"),
        (F.col("_text").contains("\ufffd") & F.col("_text").rlike(r"\x{FFFD}[\s" + MARKS + r"]*\z")).alias("bytes"),
        F.col("line").rlike(r"</?[A-Za-z]*\z").alias("tag"),
        opened.alias("opened"),
        F.array_except(opened, found(r"</([A-Za-z]+)>")).alias("unclosed"),
        begun_verdict.alias("verdict"),
        ((odd('"') | odd("`")) & ~code_end).alias("quote"),
        begun_name.alias("word"),
        (F.col("body") == "").alias("blank"),
    )
    t = cut(t, "tokens")
    end = F.slice("tokens", F.greatest(F.size("tokens") - LAST_TOKENS + 1, F.lit(1)), LAST_TOKENS)
    at = F.size("tokens")
    # the last word's place among all tokens: behind it stand marks only
    place = at - 1 - F.when(_is_mark(F.get(F.col("tokens"), at - 1)), 1).otherwise(0)
    near = F.filter(end, _is_word)
    words = F.when(F.size(near) >= 3, near).otherwise(F.filter("tokens", _is_word))
    facts = t.withColumn("words", words).select(
        "_key", "has_mark", "whole_verdict", "code_end", "dots", "bytes", "tag", "verdict", "quote", "word", "blank",
        F.size("words").alias("n"),
        *[F.coalesce(F.get(F.col("words"), F.size("words") - i), F.lit(START)).alias(f"w{4 - i}") for i in (3, 2, 1)],
        F.coalesce(F.get("tokens", place - 4), F.lit(START)).alias("v1"),
        F.coalesce(F.get("tokens", place - 3), F.lit(START)).alias("v2"),
    )
    facts = cut(facts, "ends")
    # a last word that never stands here, as the beginning of one that often does
    tails = facts.filter("n >= 1").select("w1", "w2", "w3").distinct()
    counts5 = cut(ending_counts(t, tails), "endings")
    counts = counts5.groupBy("w1", "w2", "w3").agg(*[F.sum(k).alias(k) for k in ("inner", "marked", "bare")])
    seen = counts.select("w1", "w2", "w3", "inner", "marked", "bare")
    first = F.substring("w3", 1, 1).alias("first")
    longer = counts.filter(F.col("inner") + F.col("marked") + F.col("bare") >= INNER_LEAST).select("w1", "w2", first, F.col("w3").alias("full"), (F.col("inner") + F.col("marked") + F.col("bare")).alias("often"))
    begun = tails.select("*", first).join(longer, ["w1", "w2", "first"]).filter(F.col("full").startswith(F.col("w3")) & (F.col("full") != F.col("w3"))).groupBy("w1", "w2", "w3").agg(F.max("often").alias("often"))
    # a mark may be the text's own: then the longer ending must be one that goes on, too
    wide = counts5.filter((F.col("inner") >= INNER_LEAST / 2) & (F.col("marked") + F.col("bare") <= 2 * TERMINAL_SHARE * F.col("inner"))).select("v1", "v2", "w1", "w2", "w3", F.lit(True).alias("goes_on"))
    # an element is a tag that most texts that open it close, too
    named = t.filter(F.size("opened") > 0).select(F.explode("opened").alias("name"), "unclosed").groupBy("name").agg(F.count("*").alias("m"), F.count_if(F.array_contains("unclosed", F.col("name"))).alias("lost"))
    elements = named.filter(2 * F.col("lost") <= F.col("m")).select("name")
    left_open = t.filter(F.size("unclosed") > 0).select("_key", F.explode("unclosed").alias("name")).join(elements, "name").select("_key", F.lit(True).alias("left_open")).distinct()
    facts = facts.join(left_open, "_key", "left").withColumn("tag", F.col("tag") | F.col("left_open").isNotNull()).drop("left_open")
    known = facts.join(seen, ["w1", "w2", "w3"], "left").join(begun, ["w1", "w2", "w3"], "left").join(wide, ["v1", "v2", "w1", "w2", "w3"], "left")
    total = F.coalesce(F.col("inner") + F.col("marked") + F.col("bare"), F.lit(0))
    ends = F.coalesce(F.col("marked") + F.col("bare"), F.lit(0))
    # one letter before a mark is rather a unit or an initial than the beginning of a word
    part = F.col("often").isNotNull() & (total <= 0.05 * F.col("often")) & (~F.col("has_mark") | (F.length("w3") > 1) | F.col("w3").rlike("[" + HAN + "]"))
    inner = (F.coalesce("inner", F.lit(0)) >= INNER_LEAST) & (ends <= TERMINAL_SHARE * total) & (~F.col("has_mark") | F.col("goes_on").isNotNull())
    # a rare trigram is the text's own, so its bare ends prove nothing
    unmarked = ~F.col("has_mark") & ((total < INNER_LEAST) | (F.coalesce("bare", F.lit(0)) <= (1 - MARKED_SHARE) * ends))
    done = F.col("whole_verdict") | F.col("code_end") | F.col("blank")
    reason = (
        F.when(F.col("bytes"), "bytes")
        .when(F.col("tag"), "tag")
        .when(F.col("blank"), None)
        .when(F.col("verdict"), "verdict")
        .when(F.col("quote"), "quote")
        .when(F.col("dots"), "mark")
        .when(done, None)
        .when(F.col("word"), "word")
        .when(F.col("n") < 1, None)
        .when(part, "word")
        .when(inner, "sentence")
        .when(unmarked, "mark")
    )
    # what the trigrams say comes first
    reason = F.when(reason.isNull(), None).when((F.col("n") >= 1) & inner, "sentence").when((F.col("n") >= 1) & part, "word").otherwise(reason)
    return known.select(F.col("_key").alias(key), reason.isNotNull().alias("cut"), reason.alias("reason"))


def truncation_rates(df: DataFrame, key: str, source: str, found: DataFrame) -> DataFrame:
    """(source, n_items, n_cut, rate) of every source; a null source is one too. ``found`` has one
    row for each row of ``df``, repeated keys being judged alike."""
    per = df.groupBy(key, source).agg(F.count("*").alias("_m")).join(found.groupBy(key).agg(F.max("cut").alias("_cut")), key)
    return per.groupBy(source).agg(F.sum("_m").alias("n_items"), F.sum(F.when(F.col("_cut"), F.col("_m")).otherwise(0)).alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_items"))
